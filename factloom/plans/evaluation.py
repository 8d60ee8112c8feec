"""End-to-end scoring: every gold field against its claim on seven axes, ingredient records, and their summaries.

``gold`` has ``document, field, state, derivation, rule, value`` and arrays ``evidence, premises`` of (page, text, box);
``alternative_state, accepted, ambiguous`` may be added. ``predictions`` has ``document, field, state, value, derivation,
rule, evidence`` (one such struct or null), ``premises``; ``confidence, seq`` may be added. ``pages`` has ``document,
page, text, row_text``. Gold and claims meet in one join keyed by claim; spans of a claim are compared inside its row, and
page texts move only once, to the citations that name them. Null arrays count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..functions import text as T
from ..functions import values as V
from ..operators import scoring as S
from ..operators.joins import merged
from ..operators.near import partial_ratio
from ..operators.search import on_page
from . import derivation as D

LOCAL = ("page", "span", "bbox")
SPANS = "array<struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
FORM_FIELD = "substance_or_mixture"
GOLD_DERIVED = ("ONTOLOGY", "COMPOSITION_IMPLIED")


def _with(rows: DataFrame, **defaults: Column) -> DataFrame:
    return reduce(lambda d, kv: d if kv[0] in rows.columns else d.withColumn(*kv), defaults.items(), rows)


def _spans(c: Column) -> Column:
    return F.coalesce(c.cast(SPANS), F.array().cast(SPANS))


def _by_field(field: Column, choose) -> Column:
    """``choose(kind, tolerance)`` of each product field, by the row's field."""
    out = F
    for name, kind, tolerance, _ in Q.FIELDS:
        out = out.when(field == name, choose(kind, tolerance))
    return out


def _audited(claims: DataFrame, keys: list[str], spans: str) -> DataFrame:
    """``claims`` with the audit of their spans (null for claims without one)."""
    texts = claims.where(F.size(spans) > 0).select(*keys, F.explode(F.transform(spans, lambda s: s["text"])).alias("text"))
    return merged(claims, D.audit(texts, keys), keys, "left")


def target_groups(gold: DataFrame, keys: list[str]) -> DataFrame:
    """``gold`` with ``groups``, an array of (role, needed, at: places in ``targets``), and ``described``.

    Direct evidence is one group of alternatives. Premises are grouped by the roles that their rule needs; where they leave
    a role short, they are one group too and ``described`` is false. ``gold`` has ``derived`` and ``targets``."""
    derived = _audited(gold.where("derived").select(*keys, "rule", "value", "targets"), keys, "targets")
    one = F.array(F.struct(F.lit("form_declaration").alias("role"), F.lit(1).alias("needed")))
    identifier = F.when(F.size("declared") == 1, one).otherwise(D.required_roles(D.established_form()))
    required = F.when(F.col("rule") == D.COMPOSITION_RULE, D.required_roles(F.col("value"))).when(F.col("rule") == D.IDENTIFIER_RULE, identifier)
    roles = F.transform("targets", lambda t: Q.premise_roles(t["text"]))
    filled = F.transform("required", lambda r: F.struct(r["role"], r["needed"], places("roles", lambda x: F.array_contains(x, r["role"])).alias("at")))
    found = derived.select(*keys, required.alias("required"), roles.alias("roles")).select(*keys, filled.alias("filled"))
    whole = F.coalesce(F.forall("filled", lambda g: F.size(g["at"]) >= g["needed"]), F.lit(False))
    every = lambda role: F.array(F.struct(F.lit(role).alias("role"), F.lit(1).alias("needed"), places("targets", lambda _: F.lit(True)).alias("at")))
    return merged(gold, found, keys, "left").select(
        *gold.columns,
        F.when(~F.col("derived"), every("evidence")).when(whole, F.col("filled")).otherwise(every("premises")).alias("groups"),
        (~F.col("derived") | whole).alias("described"),
    )


def places(array: str, ok) -> Column:
    """Places, from 0, of an array's items that are ``ok``."""
    return F.filter(F.transform(array, lambda x, i: F.when(ok(x), i)), lambda i: i.isNotNull())


def verbatim(cited: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, verbatim``: whether all spans of ``cited`` (keys, page, text) stand on the pages that they name."""
    one = cited.groupBy(*dict.fromkeys(["document", *keys]), "page").agg(F.collect_set("text").alias("quotes"))
    held = F.forall("quotes", lambda q: F.coalesce(on_page(F.col("_text"), F.col("_row_text"), q), F.lit(False)))
    named = pages.select("document", F.col("page").cast("int").alias("page"), F.col("text").alias("_text"), F.col("row_text").alias("_row_text"))
    met = merged(one, named, ["document", "page"], "left").withColumn("held", F.col("_text").isNotNull() & held)
    return met.groupBy(*keys).agg(F.bool_and("held").alias("verbatim"))


def nearest_quotes(cited: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, verbatim_fuzzy_score``: of the spans of ``cited`` that do not stand on the pages that they name, the largest
    likeness there, in reading order or in rows. Diagnostic; only pages with such a span go to Python, with that span."""
    named = pages.select("document", F.col("page").cast("int").alias("page"), F.col("text").alias("_text"), F.col("row_text").alias("_row_text"))
    met = cited.select(*dict.fromkeys(["document", *keys]), "page", "text").join(named, ["document", "page"])
    lost = met.where(~F.coalesce(on_page(F.col("_text"), F.col("_row_text"), F.col("text")), F.lit(False)))
    orders = F.array_distinct(F.array_compact(F.array(T.search_form(F.col("_text")), T.search_form(F.col("_row_text")))))
    tried = lost.select(*keys, T.search_form(F.col("text")).alias("quote"), F.explode(orders).alias("form"))
    return tried.select(*keys, partial_ratio(F.col("form"), F.col("quote")).alias("score")).groupBy(*keys).agg(F.max("score").alias("verbatim_fuzzy_score"))


def evaluate(gold: DataFrame, predictions: DataFrame, pages: DataFrame, by: tuple[str, ...] = (), fuzzy: bool = False) -> DataFrame:
    """One row a gold field with its seven axes (satisfied, violated, undecidable, n/a), ``joint`` and diagnostics.

    A field without a claim fails all that applies. Of claims with a ``seq`` only those of the document's largest count.
    ``by`` names further key columns of ``gold`` and ``predictions``. A page that is not in ``pages`` has no quotes.
    ``support_note`` says why a claim's support is as it is; ``bbox_provenance`` is the first cited span's (predictions may
    carry it; a box without one is the system's). With ``fuzzy``, ``verbatim_fuzzy_score`` tells how near lost quotes come."""
    keys = [*by, "document", "field"]
    g = _with(gold, alternative_state=F.lit(None).cast("string"), accepted=F.array().cast("array<string>"), ambiguous=F.lit(False))
    g = g.where(F.col("field").isin(*[name for name, *_ in Q.FIELDS])).withColumn("derived", F.coalesce(F.col("derivation").isin(*GOLD_DERIVED), F.lit(False)))
    g = g.select(
        *keys, "state", "derivation", "rule", "value", "alternative_state", "ambiguous", "derived",
        F.array_compact(F.array_distinct(F.concat(F.array("value"), F.coalesce("accepted", F.array().cast("array<string>"))))).alias("values"),
        F.when(F.col("derived"), _spans(F.col("premises"))).otherwise(_spans(F.col("evidence"))).alias("targets"),
    )
    g = target_groups(g, keys).withColumn("located_needed", (F.col("state") != "NOT_STATED") & (F.size("targets") > 0))

    p = _with(predictions, confidence=F.lit(0.0), bbox_provenance=F.lit(None).cast("string"))
    if "seq" in p.columns:
        p = p.withColumn("_last", F.max("seq").over(Window.partitionBy(*by, "document"))).where("seq = _last")
    single = F.when(F.col("evidence").isNotNull(), F.array("evidence")).otherwise(F.array())
    p = p.select(*keys, "state", "value", "derivation", "rule", "confidence", "bbox_provenance", F.when(F.col("derivation") == "DERIVED", _spans(F.col("premises"))).otherwise(_spans(single)).alias("cited"))
    quotes = verbatim(p.select(*keys, F.inline("cited")), pages, keys)
    # Only derived claims are audited; their verdict joins as one column.
    checked = _audited(p.where("derivation = 'DERIVED'").select(*keys, "rule", "state", "value", "cited"), keys, "cited")
    asked = (F.col("rule"), F.col("field"), F.col("state"), F.col("value"), F.size("cited"))
    checked = checked.select(*keys, D.check_rule(*asked).alias("checked"), D.check_note(*asked).alias("checked_note"))
    p = merged(merged(p, quotes, keys, "left"), checked, keys, "left")
    near = F.lit(0.0)
    if fuzzy:
        p = p.join(nearest_quotes(p.select(*keys, F.inline("cited")), pages, keys), keys, "left")
        near = F.coalesce("verbatim_fuzzy_score", F.lit(0.0))
    claim = F.struct(
        "state", "value", "derivation", "rule", "confidence", "cited", F.coalesce("verbatim", F.lit(True)).alias("verbatim"),
        "checked", "checked_note", near.alias("near"), "bbox_provenance",
    )
    met = merged(g, p.select(*keys, claim.alias("p")), keys, "left")
    return _axes(met, keys)


def _axes(met: DataFrame, keys: list[str]) -> DataFrame:
    c, p = F.col, F.col("p")
    none = p.isNull()
    ok = lambda x: F.when(F.coalesce(x, F.lit(False)), "satisfied").otherwise("violated")
    empty = F.struct(F.lit(0).alias("page_match"), *[F.lit(0.0).alias(m) for m in S.MEASURES[1:]])
    cited = F.coalesce(p["cited"], F.array().cast(SPANS))
    nearest = F.transform("targets", lambda t: F.coalesce(F.array_max(F.transform("cited", lambda s: S.measured(s, t))), empty))
    met = met.withColumn("cited", cited).withColumn("near", nearest)
    filled = lambda axis: F.size(F.filter("groups", lambda g: F.size(F.filter(g["at"], lambda i: S.located(F.get(c("near"), i), axis))) >= g["needed"]))
    met = met.select("*", F.coalesce(F.array_max("near"), empty).alias("best"), *[filled(a).alias(f"n_{a}") for a in LOCAL])

    said = F.coalesce(p["value"], F.lit("")) != ""
    equal = F.exists("values", lambda v: _by_field(c("field"), lambda kind, tolerance: V.values_equal(p["value"], v, kind, tolerance)))
    value = F.when(none, "violated").when(c("state") == "PRESENT", ok(said & equal)).otherwise(ok(~said))
    local = {a: F.when(~c("located_needed"), "n/a").when(none, "violated").otherwise(ok(c(f"n_{a}") == F.size("groups"))) for a in LOCAL}
    same_kind = (p["derivation"] == "DERIVED") == c("derived")
    derivation = (
        F.when(none, F.when(c("located_needed"), "violated").otherwise("n/a"))
        .when((c("state") == "NOT_STATED") | (p["state"] == "NOT_STATED"), "n/a")
        .otherwise(ok(same_kind & (~c("derived") | p["rule"].eqNullSafe(c("rule")))))
    )
    blank = F.exists("cited", lambda s: F.coalesce(T.collapse(s["text"]), F.lit("")) == "")
    first = F.get("cited", 0)["text"]
    direct = S.support(p["state"], p["value"], first, _by_field(c("field"), lambda kind, _: F.lit(kind)), p["verbatim"])
    support = (
        F.when(none, F.when(c("located_needed"), "violated").otherwise("n/a"))
        .when(p["state"] == "NOT_STATED", F.when(F.size("cited") > 0, "violated").otherwise("n/a"))
        .when((F.size("cited") == 0) | blank | ~p["verbatim"], "violated")
        .when(p["derivation"] == "DERIVED", p["checked"])
        .otherwise(direct)
    )
    declared, cue = Q.form_cue(first), F.coalesce(Q.state_cue(Q.value_part(first)), Q.state_cue(first))
    backed = (
        F.when(none, "")
        .when(p["state"] == "NOT_STATED", F.when(F.size("cited") > 0, "a citation for what is not stated"))
        .when((F.size("cited") == 0) | blank, "no citation")
        .when(~p["verbatim"], "the citation is not verbatim")
        .when(p["derivation"] == "DERIVED", p["checked_note"])
        .when(support == "satisfied", "")
        .when(p["state"] != "PRESENT", F.coalesce(F.concat(F.lit("the citation says "), cue), F.lit("the citation has no cue of a state")))
        .when(~said, "no value")
        .when(c("field") == FORM_FIELD, F.coalesce(F.concat(F.lit("the citation declares "), declared), F.lit("the citation declares no form")))
        .otherwise("the value is not in the citation")
    )
    provenance = F.coalesce(p["bbox_provenance"], F.when(F.get("cited", 0)["box"].isNotNull(), "system"), F.lit("none"))
    notes = F.array(
        F.when(none, "no claim"),
        F.when(~p["verbatim"], "a citation is not on its page"),
        F.when(c("located_needed") & (F.size("groups") > 1) & (c("n_span") < F.size("groups")), F.concat(F.lit("premise roles found: "), c("n_span").cast("string"), F.lit(" of "), F.size("groups").cast("string"))),
        F.when(derivation == "violated", F.when(none, None).when(~same_kind, "direct and derived differ").otherwise("rules differ")),
    )
    scored = met.select(
        *keys,
        c("state").alias("gold_state"), p["state"].alias("predicted_state"), c("value").alias("gold_value"), p["value"].alias("predicted_value"),
        c("derivation").alias("gold_derivation"), p["derivation"].alias("predicted_derivation"), c("rule").alias("gold_rule"), p["rule"].alias("predicted_rule"),
        F.when(c("derived"), "premise").otherwise("direct").alias("evidence_role"),
        F.array_sort(F.array_distinct(F.transform("targets", lambda t: t["page"]))).alias("gold_pages"), F.get("cited", 0)["page"].alias("predicted_page"),
        F.array_join(F.transform("targets", lambda t: t["text"]), " | ").alias("gold_evidence"), F.array_join(F.transform("cited", lambda t: t["text"]), " | ").alias("predicted_evidence"),
        ok(p["state"] == c("state")).alias("state"), value.alias("value"), *[v.alias(k) for k, v in local.items()], derivation.alias("derivation"), support.alias("support"),
        c("located_needed").alias("gold_requires_evidence"), c("ambiguous").alias("gold_ambiguous"),
        F.coalesce((p["state"] == c("state")) | F.coalesce(p["state"] == c("alternative_state"), F.lit(False)), F.lit(False)).alias("state_lenient"),
        *[F.when(c("located_needed"), c("best")[m]).otherwise(F.lit(0.0)).alias(m) for m in S.MEASURES[1:]],
        F.coalesce(p["verbatim"], F.lit(True)).alias("verbatim"), (F.size("cited") > 0).alias("cites"), F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(c("located_needed") & ~none, F.size("groups")).otherwise(0).alias("target_groups"), F.when(c("located_needed") & ~none, c("n_span")).otherwise(0).alias("groups_located"),
        (c("described") | none | ~c("located_needed")).alias("premise_roles_described"), F.array_join(F.array_compact(notes), "; ").alias("note"),
        F.coalesce(backed, F.lit("")).alias("support_note"), provenance.alias("bbox_provenance"), F.coalesce(p["near"], F.lit(0.0)).alias("verbatim_fuzzy_score"),
    )
    return scored.withColumn("joint", S.joint())


def summary(instances: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one a group) of counts and rates over scored fields, in one aggregate; 0 where nothing is counted."""
    bearing, rate = F.col("gold_requires_evidence"), lambda ok: F.coalesce(F.avg(ok.cast("int")), F.lit(0.0))
    grouped = instances.groupBy(*by) if by else instances
    return grouped.agg(
        F.count("*").alias("n"),
        F.count_if(bearing).alias("n_evidence"),
        F.count_distinct("document").alias("documents"),
        rate(F.col("joint")).alias("joint"),
        rate(F.when(bearing, F.col("joint"))).alias("joint_evidence"),
        rate(F.col("state") == "satisfied").alias("state_strict"),
        rate(F.col("state_lenient")).alias("state_lenient"),
        *[F.coalesce(F.avg(F.when(bearing, F.col(m))), F.lit(0.0)).alias(f"mean_{m}") for m in S.MEASURES[1:]],
        F.count_if(F.col("cites")).alias("n_cited"),
        F.count_if(F.col("cites") & F.col("verbatim")).alias("n_verbatim"),
        F.count_if(S.undecidable()).alias("n_undecidable"),
        F.count_if(bearing & (F.col("target_groups") > 1)).alias("n_multi_role"),
        F.count_if(bearing & (F.col("target_groups") > 1) & S.passes(F.col("span"))).alias("n_multi_role_located"),
        F.count_if(bearing & ~F.col("premise_roles_described")).alias("n_undescribed"),
    )


def field_rates(instances: DataFrame) -> DataFrame:
    """Rates of each axis and of the joint by field, and over all fields (``field`` null); null where none applies."""
    rate = lambda a: F.try_divide(F.count_if(F.col(a) == "satisfied"), F.count_if(F.col(a) != "n/a")).alias(a)
    return instances.rollup("field").agg(F.count("*").alias("n"), *[rate(a) for a in S.AXES], F.avg(F.col("joint").cast("int")).alias("joint"))


def family_rates(instances: DataFrame, manifest: DataFrame) -> DataFrame:
    """Joint rate by the manifest's ``template_family`` of the scored documents (``manifest`` has one row a document)."""
    met = instances.join(manifest.select("document", "template_family"), "document")
    return met.groupBy("template_family").agg(F.count_distinct("document").alias("documents"), F.count("*").alias("instances"), F.avg(F.col("joint").cast("int")).alias("joint"))


def evaluate_ingredients(gold: DataFrame, predicted: DataFrame, pages: DataFrame) -> DataFrame:
    """Matched ingredient records: ``document, gold_pos, predicted_pos, matched_on`` and ``name_ok, cas_ok,
    concentration_ok, evidence_ok, verbatim, record_ok, record_with_evidence_ok``.

    Items have ``document, pos, name, cas, cas_state, concentration, evidence``: of gold an array of (page, text, box), of
    predictions one such struct or null. A record is matched by its registry number, else by its name, once."""

    def keyed(items: DataFrame) -> DataFrame:
        state = S.effective_cas_state(F.col("cas"), F.col("cas_state"))
        shaped = items.select("document", "pos", "name", "cas", "concentration", "evidence", state.alias("cas_state"))
        return shaped.withColumn("cas_key", F.when(F.col("cas_state") == "PRESENT", T.normalize_cas(F.col("cas")))).withColumn("name_key", T.name_key(F.col("name")))

    g, p = keyed(gold), keyed(predicted)
    matches = S.match_records(g, p, ["cas_key", "name_key"])
    packed = lambda items, side: items.select("document", F.col("pos").alias(f"{side}_pos"), F.struct(*[c for c in items.columns if c not in ("document", "pos")]).alias(side))
    quotes = verbatim(p.where("evidence is not null").select("document", F.col("pos").alias("predicted_pos"), F.inline(_spans(F.array("evidence")))), pages, ["document", "predicted_pos"])
    met = matches.join(packed(g, "gold"), ["document", "gold_pos"]).join(packed(p, "predicted"), ["document", "predicted_pos"]).join(quotes, ["document", "predicted_pos"], "left")
    a, b = F.col("gold"), F.col("predicted")
    quoted = F.coalesce(F.col("verbatim"), F.lit(False))
    # A cited row spans its page's width, so it must cover a gold box and not be much higher.
    covers = F.exists(_spans(a["evidence"]), lambda t: S.row_evidence_ok(b["evidence"]["page"], t["page"], b["evidence"]["box"], t["box"], F.lit(True)))
    scored = met.select(
        "document", "gold_pos", "predicted_pos", F.regexp_replace("matched_on", "_key$", "").alias("matched_on"),
        T.names_equal(b["name"], a["name"]).alias("name_ok"),
        F.coalesce(F.when(a["cas_state"] == "PRESENT", a["cas_key"] == b["cas_key"]).otherwise(a["cas_state"] == b["cas_state"]), F.lit(False)).alias("cas_ok"),
        F.coalesce(V.concentrations_equal(b["concentration"], a["concentration"]), F.lit(False)).alias("concentration_ok"),
        (quoted & F.coalesce(covers, F.lit(False))).alias("evidence_ok"), quoted.alias("verbatim"),
    )
    record = F.col("name_ok") & F.col("cas_ok") & F.col("concentration_ok")
    return scored.withColumn("record_ok", record).withColumn("record_with_evidence_ok", record & F.col("evidence_ok"))


def ingredient_summary(records: DataFrame, gold: DataFrame, predicted: DataFrame, gold_blocks: DataFrame, predicted_blocks: DataFrame) -> DataFrame:
    """One row: items of gold, of predictions for gold's documents and matched, attribute rates (null without a match),
    precision and recall of whole records, recall of keys, and agreeing block states (``document, state``)."""
    flags = ("name_ok", "cas_ok", "concentration_ok", "evidence_ok")
    matched = records.agg(
        F.count("*").alias("matched"),
        *[F.avg(F.col(f).cast("int")).alias(f[:-3] + "_rate") for f in flags],
        F.count_if("record_ok").alias("records_exact"),
        F.count_if("record_with_evidence_ok").alias("records_with_evidence"),
    )
    states = gold_blocks.join(predicted_blocks.select("document", F.col("state").alias("_said")), "document", "left")
    states = states.agg(F.count("*").alias("blocks"), F.count_if(F.col("state") == F.col("_said")).alias("blocks_agreeing"))
    known = predicted.join(gold_blocks.select("document"), "document", "left_semi")
    # Each side is one row, so these are no products of tables.
    one = matched.crossJoin(gold.agg(F.count("*").alias("gold_rows"))).crossJoin(known.agg(F.count("*").alias("predicted_rows"))).crossJoin(states)
    return one.select(
        "*",
        F.try_divide("records_exact", "predicted_rows").alias("precision"),
        F.try_divide("records_exact", "gold_rows").alias("recall"),
        F.try_divide("matched", "gold_rows").alias("key_recall"),
    )
