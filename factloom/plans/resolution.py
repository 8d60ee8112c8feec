"""References to spans, resolved on the pages: gold building, loading with its checks, and the gold report.

A reference names a page, a text, which of its occurrences and whether case counts. ``pages`` has ``document, page, text`` and
``words`` (array of start, end, box over ``text``). References of a page travel to its text in one row, so a page is read once
for all of them. What cannot be resolved becomes a row of problems, not a failed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..functions import geometry as G
from ..functions import text as T
from ..operators import near, search
from . import derivation as D
from . import evaluation as E

REFERENCES = "array<struct<page: int, text: string, occurrence: int, case_sensitive: boolean>>"
FORM_FIELD = "substance_or_mixture"
#: Likeness from which a fuzzy place on the OCR layer is taken as a span's anchor.
OCR_SCORE = 85.0


class GoldError(ValueError):
    """Gold annotations do not resolve."""


def references(c: Column) -> Column:
    """References with their defaults: the first occurrence, case not counted."""
    some = F.coalesce(c.cast(REFERENCES), F.array().cast(REFERENCES))
    return F.transform(some, lambda r: F.struct(r["page"].alias("page"), r["text"].alias("text"), F.coalesce(r["occurrence"], F.lit(1)).alias("occurrence"), F.coalesce(r["case_sensitive"], F.lit(False)).alias("case_sensitive")))


def premise_references(fields: DataFrame) -> DataFrame:
    """``fields`` (document, field, derivation, evidence) with ``refs``: the field's own references and, for an ontology
    field, those of the form field that it lacks, each (page, text, occurrence) once."""
    f = fields.withColumn("own", references(F.col("evidence")))
    form = f.where(F.col("field") == FORM_FIELD).groupBy(F.col("document").alias("of")).agg(F.first("own").alias("form_refs"))
    met = f.join(form, F.col("document") == F.col("of"), "left")
    same = lambda a, b: (a["page"] == b["page"]) & (a["text"] == b["text"]) & (a["occurrence"] == b["occurrence"])

    def lent(refs: Column) -> Column:
        fresh = F.filter(refs, lambda r: ~F.exists("own", lambda o: same(o, r)))
        return F.filter(fresh, lambda r, i: ~F.exists(F.slice(fresh, F.lit(1), i), lambda e: same(e, r)))

    more = F.when((F.col("derivation") == "ONTOLOGY") & F.col("form_refs").isNotNull(), lent(F.col("form_refs")))
    return met.withColumn("refs", F.concat("own", F.coalesce(more, F.array().cast(REFERENCES)))).drop("own", "of", "form_refs")


def _anchor(page: Column, words: Column, places: Column, at: Column, size: Column) -> Column:
    """Span of ``size`` characters of the search form from ``at`` (from 0): its text, characters and box of the words under it."""
    start, end = F.get(places, at), F.get(places, at + size - 1) + 1

    def cut(x: Column) -> Column:
        under = F.filter(words, lambda w: (w["start"] < x["e"]) & (w["end"] > x["s"]))
        return F.struct(F.substring(page, x["s"] + 1, x["e"] - x["s"]).alias("text"), x["s"].alias("char_start"), x["e"].alias("char_end"), F.when(F.size(under) > 0, G.union(F.transform(under, lambda w: w["box"]))).alias("box"))

    return T.let(F.struct(start.alias("s"), end.alias("e")), cut)


def resolve(cited: DataFrame, pages: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """``cited`` (document, page, text, occurrence, case_sensitive and others) with ``span``, ``occurrences`` and ``problem``.

    ``span`` is the n-th exact place on the page, null where ``problem`` says why there is none; with ``ocr`` pages it
    carries the place there, exact or the best of a likeness of 85 or more."""
    rest = [c for c in cited.columns if c not in ("document", "page")]
    one = cited.groupBy("document", "page").agg(F.collect_list(F.struct(*rest)).alias("refs"))
    held = pages.select(F.col("document").alias("of"), F.col("page").cast("int").alias("at"), F.col("text").alias("body"), "words")
    met = one.join(held, (F.col("document") == F.col("of")) & (F.col("page") == F.col("at")), "left")
    met = met.withColumns({"low": T.search_form(F.col("body")), "exact": T.search_form(F.col("body"), casefold=False), "low_at": search.offsets(F.col("body")), "exact_at": search.exact_offsets(F.col("body"))})

    def place(r: Column) -> Column:
        quote = F.when(r["case_sensitive"], T.search_form(r["text"], casefold=False)).otherwise(T.search_form(r["text"]))
        form, places = F.when(r["case_sensitive"], F.col("exact")).otherwise(F.col("low")), F.when(r["case_sensitive"], F.col("exact_at")).otherwise(F.col("low_at"))
        starts = T.let(quote, lambda q: F.struct(search.positions(form, q).alias("all"), F.length(q).alias("size")))

        def found(x: Column) -> Column:
            hit = F.get(x["all"], r["occurrence"] - 1)
            span = F.when(hit.isNotNull(), _anchor(F.col("body"), F.col("words"), places, hit, x["size"]))
            return T.let(span, lambda s: F.struct(*[r[c].alias(c) for c in rest], F.size(x["all"]).alias("occurrences"), s.alias("span")))

        return T.let(starts, found)

    out = met.select("document", "page", F.col("of").isNotNull().alias("there"), F.inline(F.transform("refs", place)))
    problem = (
        F.when(~F.col("there"), F.concat(F.lit("no page "), F.col("page").cast("string")))
        .when(F.coalesce(F.col("occurrences"), F.lit(0)) < 1, F.concat(F.lit("not verbatim on page "), F.col("page").cast("string")))
        .when(F.col("span").isNull(), F.concat(F.lit("occurrence "), F.col("occurrence").cast("string"), F.lit(" of "), F.col("occurrences").cast("string")))
        .when(F.col("span.box").isNull(), F.lit("no words under the span"))
    )
    out = out.withColumn("problem", problem).withColumn("span", F.when(problem.isNull(), F.col("span"))).drop("there")
    return out if ocr is None else _on_ocr(out, ocr)


def _on_ocr(resolved: DataFrame, ocr: DataFrame) -> DataFrame:
    """Adds ``ocr_box, ocr_char_start, ocr_char_end, ocr_exact, ocr_score`` of the first exact place, else of the likest one."""
    held = ocr.select(F.col("document").alias("of"), F.col("page").cast("int").alias("at"), F.col("text").alias("body"), "words")
    met = resolved.join(held, (F.col("document") == F.col("of")) & (F.col("page") == F.col("at")) & F.col("span").isNotNull(), "left")
    met = met.withColumns({"form": T.search_form(F.col("body")), "quote": T.search_form(F.col("text")), "places": search.offsets(F.col("body"))})
    exact = F.coalesce(search.contains(F.col("form"), F.col("quote")), F.lit(False))
    # Only quotes that do not stand there go to Python.
    likest = search.likest_window(F.when(~exact, F.col("form")), F.when(~exact, F.col("quote")))
    met = met.withColumn("exact", exact).withColumn("near", likest)
    near = ~F.col("exact") & (F.coalesce(F.col("near.score"), F.lit(0.0)) >= OCR_SCORE)
    at = F.when(F.col("exact"), F.position(F.col("quote"), F.col("form")) - 1).when(near, F.col("near.start"))
    size = F.when(F.col("exact"), F.length("quote")).when(near, F.col("near.end") - F.col("near.start"))
    met = met.withColumn("there", F.when(at.isNotNull(), _anchor(F.col("body"), F.col("words"), F.col("places"), at, size)))
    keep = resolved.columns
    return met.select(
        *keep, F.col("there.box").alias("ocr_box"), F.col("there.char_start").alias("ocr_char_start"), F.col("there.char_end").alias("ocr_char_end"),
        F.when(F.col("there").isNotNull(), F.col("exact")).alias("ocr_exact"), F.when(F.col("exact"), F.lit(100.0)).when(near, F.col("near.score")).alias("ocr_score"),
    )


def build_gold(fields: DataFrame, pages: DataFrame, ocr: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Gold with resolved spans, and its problems (``document, place, problem``).

    ``fields`` has ``document, split, product_form, field, state, derivation, rule, value, evidence`` (references). A derived
    field's references become ``premises``, any other's ``evidence``; spans keep the order in which they were written."""
    wanted = premise_references(fields)
    keys = ["document", "field"]
    cited = wanted.select(*keys, F.posexplode("refs").alias("nr", "r")).select(*keys, "nr", "r.*")
    found = resolve(cited, pages, ocr)
    extra = [c for c in found.columns if c.startswith("ocr_")]
    span = F.struct("nr", "page", F.col("span.text").alias("text"), F.col("span.box").alias("box"), F.col("span.char_start").alias("char_start"), F.col("span.char_end").alias("char_end"), "occurrences", *extra)
    packed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("span").isNotNull(), span))).alias("spans"))
    derived = F.col("derivation").isin(*E.GOLD_DERIVED)
    none = F.filter("spans", lambda s: F.lit(False))
    gold = wanted.drop("refs", "evidence").join(packed, keys, "left").withColumns({"evidence": F.when(derived, none).otherwise(F.col("spans")), "premises": F.when(derived, F.col("spans")).otherwise(none)}).drop("spans")
    where = F.concat(F.col("field"), F.lit("["), F.col("nr").cast("string"), F.lit("]"))
    lost = found.where("problem is not null").select("document", where.alias("place"), "problem")
    codes = fields.withColumn("n_evidence", F.size(references(F.col("evidence")))).select("document", F.col("field").alias("place"), F.explode(D.gold_problems()).alias("problem"))
    missing = D.missing_fields(fields).select("document", F.col("field").alias("place"), F.lit("missing_field").alias("problem"))
    return gold, lost.unionByName(codes).unionByName(missing)


def load_gold(fields: DataFrame, pages: DataFrame, ocr: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """Gold of a split (None or ``all``: every one), resolved again; any problem raises."""
    some = fields if split in (None, "all") else fields.where(F.col("split") == split)
    gold, problems = build_gold(some, pages, ocr)
    first = problems.orderBy("document", "place", "problem").limit(20).collect()
    if first:
        raise GoldError("; ".join(f"{r['document']}/{r['place']}: {r['problem']}" for r in first))
    return gold


def premise_verifiable(gold: DataFrame) -> DataFrame:
    """``document, field, verifiable``: whether a derived field's premises establish a form; null for the others."""
    keys = ["document", "field"]
    derived = gold.where(F.col("derivation").isin(*E.GOLD_DERIVED))
    audited = D.audit(derived.select(*keys, F.explode(F.transform("premises", lambda p: p["text"])).alias("text")), keys)
    told = audited.select(*keys, D.established_form().isNotNull().alias("established"))
    return gold.select(*keys, F.col("derivation").isin(*E.GOLD_DERIVED).alias("derived")).join(told, keys, "left").select(*keys, F.when(F.col("derived"), F.coalesce("established", F.lit(False))).alias("verifiable"))


def gold_report(gold: DataFrame) -> DataFrame:
    """``what, name, n``: fields by state and derivation, spans, premises, spans that occur more than once or lack an OCR
    place, derived fields that the rules cannot verify or whose premises do not fill their rule's roles (``ungrouped``), and
    the sets of roles, with the number needed of each, that the premises of the others are grouped by (``role_sets``)."""
    spans = gold.select("document", "field", F.inline_outer(F.concat("evidence", "premises")))
    flags = {"spans": F.col("page").isNotNull(), "ambiguous_spans": F.col("occurrences") > 1}
    if "ocr_box" in spans.columns:
        flags["spans_without_ocr"] = F.col("page").isNotNull() & F.col("ocr_box").isNull()
    counted = spans.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    pairs = F.array(*[F.struct(F.lit("spans").alias("what"), F.lit(n).alias("name"), F.col(n).alias("n")) for n in flags])
    out = counted.select(F.inline(pairs))
    for what in ("state", "derivation"):
        out = out.unionByName(gold.groupBy(F.col(what).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n"))
    out = out.unionByName(gold.agg(F.sum(F.size("premises")).alias("n")).select(F.lit("spans").alias("what"), F.lit("premise_spans").alias("name"), F.coalesce("n", F.lit(0)).alias("n")))
    unproven = premise_verifiable(gold).where(~F.col("verifiable")).agg(F.count("*").alias("n"))
    out = out.unionByName(unproven.select(F.lit("rules").alias("what"), F.lit("unverifiable").alias("name"), "n"))
    filled = role_cover(gold)
    loose = filled.where(~F.col("grouped")).agg(F.count("*").alias("n"))
    out = out.unionByName(loose.select(F.lit("rules").alias("what"), F.lit("ungrouped").alias("name"), "n"))
    sets = filled.where("grouped").groupBy(F.col("needs").alias("name")).agg(F.count("*").alias("n"))
    return out.unionByName(sets.select(F.lit("role_sets").alias("what"), "name", "n"))


def role_cover(gold: DataFrame) -> DataFrame:
    """``document, field, rule, roles, minimal, grouped, needs`` of every derived field: the roles that its premises fill together,
    the least number of premises that fill them all, whether they fill what the rule needs, and that (``2x role + 1x role``).

    A span's roles are bits; a field's are the ``bit_or`` of its spans'. Of the few subsets of the five roles, a span's mask is
    one, so the least cover is found over the distinct masks by trying sets of masks in order of size."""
    keys = ["document", "field"]
    order = F.array(*[F.lit(r) for r in D.ROLES])
    bits = F.aggregate(F.transform(order, lambda r, i: F.when(F.array_contains("_roles", r), F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda s, x: s + x)
    derived = gold.where(F.col("derivation").isin(*E.GOLD_DERIVED))
    spans = derived.select(*keys, F.explode(F.transform("premises", lambda p: p["text"])).alias("text")).withColumn("_roles", Q.premise_roles(F.col("text")))
    masks = spans.select(*keys, bits.alias("mask")).groupBy(*keys).agg(F.bit_or("mask").alias("cover"), F.array_sort(F.collect_set("mask")).alias("masks"))
    join = lambda a, b: a.bitwiseOR(b)
    # Covers of one mask, of two, and so on: five roles need five masks at most.
    level, least = F.col("masks"), F.when(F.array_contains("masks", F.col("cover")), 1)
    for size in range(2, len(D.ROLES) + 1):
        level = F.array_distinct(F.flatten(F.transform(level, lambda a: F.transform("masks", lambda b: join(a, b)))))
        masks = masks.withColumn(f"_level{size}", level)
        level = F.col(f"_level{size}")
        least = least.when(F.array_contains(level, F.col("cover")), size)
    roles = F.filter(F.transform(order, lambda r, i: F.when(F.col("cover").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0, r)), lambda r: r.isNotNull())
    told = masks.select(*keys, roles.alias("roles"), F.when(F.col("cover") == 0, 0).otherwise(least).alias("minimal"))
    shaped = derived.select(*keys, "rule", "value", F.lit(True).alias("derived"), E._spans(F.transform("premises", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), p["box"].alias("box")))).alias("targets"))
    needs = F.array_join(F.transform("groups", lambda g: F.concat(g["needed"].cast("string"), F.lit("x "), g["role"])), " + ")
    grouped = E.target_groups(shaped, keys).select(*keys, "rule", F.col("described").alias("grouped"), F.when(F.col("described"), needs).alias("needs"))
    none = F.array().cast("array<string>")
    return grouped.join(told, keys, "left").select(*keys, "rule", F.coalesce("roles", none).alias("roles"), F.coalesce("minimal", F.lit(0)).alias("minimal"), "grouped", "needs")




def best_place(pages: DataFrame, needles: DataFrame, least: float = 90.0) -> DataFrame:
    """``document, needle, page, start, exact, score``: a needle's place in its document (``document, needle``), exact places
    first, then by likeness of ``least`` or more, earlier pages first. Diagnostic."""
    forms = pages.select("document", F.col("page").cast("int").alias("page"), T.search_form(F.col("text")).alias("form"))
    asked = needles.select("document", "needle", T.search_form(F.col("needle")).alias("quote")).where("quote <> ''").distinct()
    met = asked.join(forms, "document").withColumn("exact", F.contains("form", F.col("quote")))
    # Pages of a needle that stands somewhere verbatim need no likeness.
    met = met.withColumn("some", F.max("exact").over(Window.partitionBy("document", "needle"))).where("exact or not some")
    found = near.best_of(met, ["document", "needle", "page", "exact"], least)
    best = found.groupBy("document", "needle").agg(F.max_by(F.struct("page", "start", "exact", "score"), F.struct("exact", "score", -F.col("page"))).alias("b"))
    return best.select("document", "needle", "b.*")


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``document, problem``: files without a row, rows without a file, unknown splits, rows without a template family."""
    rows, held = manifest.select("document").distinct(), files.select("document").distinct()
    checks = F.array_compact(F.array(F.when(~F.coalesce(F.col("split").isin("dev", "locked"), F.lit(False)), "unknown split"), F.when(F.coalesce(F.col("template_family"), F.lit("")) == "", "no template family")))
    return (
        held.join(rows, "document", "left_anti").withColumn("problem", F.lit("file without a row"))
        .unionByName(rows.join(held, "document", "left_anti").withColumn("problem", F.lit("row without a file")))
        .unionByName(manifest.select("document", F.explode(checks).alias("problem")))
    )


def template_families(manifest: DataFrame) -> DataFrame:
    """``template_family, documents`` with the sorted names."""
    return manifest.groupBy("template_family").agg(F.array_sort(F.collect_set("document")).alias("documents"))


LAYERS = ("native", "ocr")


def on_layer(tokens: DataFrame, layer: str = "native") -> DataFrame:
    """Rows of one text layer; a name that is no layer raises."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; layers are {', '.join(LAYERS)}")
    return tokens.where(F.col("layer") == layer)


def span_offsets_off(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans whose characters on the page are not their text: ``document, field, page, text, found``."""
    spans = gold.select("document", "field", F.inline(F.concat("evidence", "premises")))
    held = pages.select("document", F.col("page").cast("int").alias("page"), F.col("text").alias("body"))
    found = F.substring(F.col("body"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return spans.join(held, ["document", "page"], "left").withColumn("found", found).where(~F.col("found").eqNullSafe(F.col("text"))).select("document", "field", "page", "text", "found")


def page_counts_off(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """``document, pages, found`` where a layer's pages are not as many as the manifest says (0: not said)."""
    counted = pages.groupBy("document").agg(F.count_distinct("page").alias("found"))
    return manifest.where("pages > 0").select("document", "pages").join(counted, "document").where("pages <> found")


FIELD_NAMES = tuple(name for name, *_ in Q.FIELDS)
