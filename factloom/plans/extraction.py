"""Whole-document extraction: every field's claim from visual rows or reading-order lines.

``rows`` has ``document, page, row_no, text`` and, where boxes are known, ``words`` (array of text, x0, x1 from left to
right). Candidates of all fields come from one window over a page's rows and one aggregate keyed by document and field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..functions import text as T
from ..functions import values as V
from ..operators import extract as X
from ..operators.joins import merged
from ..operators.layout import composition_rows
from . import derivation as D

# Confidence before reading, by field; a declared and a derived form's; tokens ahead of a label; a gap.
PRIORS = {"product_name": 0.9, "supplier_name": 0.85, "product_cas_number": 0.9, "chemical_formula": 0.85, "molecular_weight": 0.9, "flash_point": 0.9}
DECLARED_CONFIDENCE, DERIVED_CONFIDENCE = 0.8, 0.5
LINE_PREFIX = r"^(?:\d+(?:\.\d+)*\.?|[•·*\-–])$"
COLUMN_GAP = 0.015
FORM_FIELD = "substance_or_mixture"
LAYOUTS = ("rows", "linear")


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _phrase_at(words: Column, at: Column, label: str) -> Column:
    """Words from ``at`` on read as the label, a colon behind it aside; ``form`` is each word's search form."""
    n = len(label.split())
    forms = F.transform(F.slice(words, at + 1, n), lambda w: w["form"])
    return (at + n <= F.size(words)) & (F.rtrim(F.array_join(F.array_remove(forms, ""), " "), F.lit(":")) == label)


def _formed(words: Column, boxed: bool) -> Column:
    """Words with their search form, folded once for all labels."""
    edges = ("x0", "x1") if boxed else ()
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), T.search_form(w["text"]).alias("form"), *[w[e].alias(e) for e in edges]))


def _without_separators(value: Column) -> Column:
    return F.regexp_replace(value, r"^(?:[:=](?:\s+|$))+", "")


def label_slot(words: Column, labels: tuple[str, ...], gaps: bool = True) -> Column:
    """Struct (label, rest): the first label in order that opens a row of words, behind list marks only, and the words
    behind it. A colon, ``=``, the row's end or, with ``gaps``, a column gap must follow. Null without one."""

    def read(x: Column) -> Column:
        words, at, out = x["words"], x["at"], None
        for label in labels:
            end = at + len(label.split())
            last, after = F.get(words, end - 1), F.get(words, end)
            ends = last["text"].rlike(r":\s*$") | (end >= F.size(words)) | after["text"].isin(":", "=")
            if gaps:
                ends = ends | (after["x0"] - last["x1"] >= COLUMN_GAP)
            hit = F.struct(F.lit(label).alias("label"), F.slice(words, end + 1, F.size(words)).alias("rest"))
            met = _phrase_at(words, at, label) & F.coalesce(ends, F.lit(False))
            out = F.when(met, hit) if out is None else out.when(met, hit)
        return out

    opened = F.filter(F.transform(words, lambda w, i: F.when(~w["text"].rlike(LINE_PREFIX), i)), lambda i: i.isNotNull())
    return T.let(F.struct(words.alias("words"), F.coalesce(F.array_min(opened), F.size(words)).alias("at")), read)


def row_candidates(rows: DataFrame, document: str = "document", fields: tuple[str, ...] = tuple(X.LABELS)) -> DataFrame:
    """``document, page, row_no, field, label, value`` and the row's own ``row``: an empty slot takes the next row unless that holds a label."""
    boxed = "words" in rows.columns
    source = "words" if boxed else "text"
    place = Window.partitionBy(document, "page").orderBy("row_no")
    if boxed:
        rows = rows.withColumn("words", _formed(F.col("words"), True))
    met = rows.withColumn("_after", F.lead("text").over(place)).withColumn("_next", F.lead(source).over(place))
    if not boxed:  # most rows hold no label and end here
        met = met.where(F.lower(T.collapse(F.col("text"))).rlike(X.slot_pattern([label for field in fields for label in X.LABELS[field]])))

    def candidate(field: str) -> Column:
        read = lambda c: (label_slot if boxed else X.label_slot)(c, X.LABELS[field])

        def shaped(slot: Column) -> Column:
            value = _without_separators(_joined(slot["rest"])) if boxed else slot["value"]
            full = F.when(value != "", value).when(read(F.col("_next")).isNull(), T.collapse(F.col("_after")))
            return F.when(slot.isNotNull(), F.struct(F.lit(field).alias("field"), slot["label"].alias("label"), F.coalesce(full, F.lit("")).alias("value")))

        return T.let(read(F.col(source)), shaped)

    kept = [c for c in ("text", "confidence") if c in rows.columns]
    row = F.struct(*kept).alias("row")
    return met.select(document, "page", "row_no", row, F.inline(F.array_compact(F.array(*map(candidate, fields)))))


def page_stream(lines: DataFrame, document: str = "document") -> DataFrame:
    """``document, page, tokens``: a page's words in reading order with their search form, whether they open their line, and its number."""
    words = F.col("words") if "words" in lines.columns else F.transform(F.split(T.collapse(F.col("text")), " "), lambda w: F.struct(w.alias("text")))
    some = lines.select(document, "page", "row_no", F.filter(words, lambda w: w["text"] != "").alias("_words")).where(F.size("_words") > 0)
    token = lambda w, i: F.struct(w["text"].alias("text"), T.search_form(w["text"]).alias("form"), (i == 0).alias("opens"), F.col("row_no").alias("row_no"))
    line = some.select(document, "page", "row_no", F.transform("_words", token).alias("_tokens"))
    return line.groupBy(document, "page").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_tokens"))), lambda x: x["_tokens"])).alias("tokens"))


class _Trie:
    """All labels of all fields as one table: the words of a label, joined, to the fields that it opens and its rank there."""

    def __init__(self, fields: tuple[str, ...]):
        opened: dict[str, list[tuple[str, int]]] = {}
        for field in fields:
            for rank, label in enumerate(X.LABELS[field]):
                opened.setdefault(label, []).append((field, rank))
        self.longest = max(len(label.split()) for label in opened)
        self.first = sorted({label.split()[0] for label in opened})
        entry = lambda label, field, rank: F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"), F.lit(label).alias("label"), F.lit(len(label.split())).alias("n"))
        pairs = [x for label, to in sorted(opened.items()) for x in (F.lit(label), F.array(*[entry(label, *t) for t in to]))]
        self.table = F.create_map(*pairs)

    def may_open(self, token: Column) -> Column:
        """Most tokens end here: no label begins with their word. A token of several words, or of none, is looked up."""
        form = token["form"]
        return (form == "") | F.contains(form, F.lit(" ")) | F.rtrim(form, F.lit(":")).isin(*self.first) | form.isin(*self.first)

    def at(self, tokens: Column, start: Column) -> Column:
        """Entries of all labels that the tokens from ``start`` on spell, a colon behind the last word aside."""

        def spelt(n: int) -> Column:
            forms = F.filter(F.transform(F.slice(tokens, start + 1, n), lambda w: w["form"]), lambda f: f != "")
            found = F.try_element_at(self.table, F.rtrim(F.array_join(forms, " "), F.lit(":")))
            return F.when(start + n <= F.size(tokens), F.filter(found, lambda e: e["n"] == n))

        return F.flatten(F.array_compact(F.array(*[spelt(n) for n in range(1, self.longest + 1)])))


def linear_candidates(lines: DataFrame, document: str = "document", fields: tuple[str, ...] = tuple(X.LABELS)) -> DataFrame:
    """The reading-order variant over a page's stream of words: ``document, page, row_no, field, label, value``.

    A label opens a line, behind one list mark at most, and may run over the line's end; a colon or ``=`` follows it, or a
    line's start or the page's end. The value runs on over the following lines up to twelve tokens or the next label of the
    field. All labels of all fields are looked up at once where a word begins one; nothing leaves the page's row."""
    trie = _Trie(fields)
    most = X.MAX_LINEAR_TOKENS

    def opening(t: Column, i: Column) -> Column:
        own, before = F.get(t, i), F.get(t, i - 1)
        return (own["opens"] | ((i > 0) & before["opens"] & before["text"].rlike(LINE_PREFIX))) & trie.may_open(own)

    def closed(t: Column, end: Column) -> Column:
        after = F.get(t, end)
        return F.coalesce((end >= F.size(t)) | F.rtrim(F.get(t, end - 1)["text"]).endswith(":") | after["text"].isin(":", "=") | after["opens"], F.lit(False))

    tokens = F.col("tokens")
    pages = page_stream(lines, document)
    places = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: opening(tokens, i))
    met = pages.withColumn("start", F.explode(places)).withColumn("entries", trie.at(tokens, F.col("start"))).where(F.size("entries") > 0)
    valid = F.filter("entries", lambda e: closed(tokens, F.col("start") + e["n"]))
    best = T.let(valid, lambda v: F.filter(v, lambda e: ~F.exists(v, lambda o: (o["field"] == e["field"]) & (o["rank"] < e["rank"]))))
    met = met.withColumn("e", F.explode(best)).withColumn("end", F.col("start") + F.col("e.n"))
    apart = F.filter(F.sequence(F.col("end"), F.greatest(F.col("end"), F.size("tokens") - 1)), lambda i: ~F.coalesce(F.get(tokens, i)["text"].isin(":", "="), F.lit(True)))
    met = met.withColumn("value", F.slice("tokens", F.coalesce(F.get(apart, 0), F.size("tokens")) + 1, most))
    # The next label is looked for from the label's end on, separators counted.
    next_label = F.filter(
        F.sequence(F.lit(0), F.size("value") - 1),
        lambda o: trie.may_open(F.get(tokens, F.col("end") + o)) & F.exists(trie.at(tokens, F.col("end") + o), lambda e: e["field"] == F.col("e.field")),
    )
    size = F.when(F.size("value") > 0, F.coalesce(F.get(next_label, 0), F.size("value"))).otherwise(F.lit(0))
    value = F.array_join(F.transform(F.slice("value", 1, size), lambda w: w["text"]), " ")
    return met.select(document, "page", F.get(tokens, F.col("start"))["row_no"].alias("row_no"), F.col("e.field").alias("field"), F.col("e.label").alias("label"), value.alias("value"))


def _by_field(choices: dict[str, Column]) -> Column:
    return reduce(lambda out, kv: out.when(F.col("field") == kv[0], kv[1]), list(choices.items())[1:], F.when(F.col("field") == next(iter(choices)), next(iter(choices.values()))))


def read_candidates(found: DataFrame) -> DataFrame:
    """Candidates that give a state or a value, with ``state`` and ``parsed``."""
    flash = F.when((F.col("field") == "flash_point") & T.search_form(F.col("value")).rlike("|".join(X.FLASH_CUES)), "NOT_APPLICABLE")
    parsed = _by_field({f: p(F.col("value")) for f, p in X.PARSERS.items()})
    read = found.where("value <> ''").withColumn("parsed", parsed).withColumn("state", F.coalesce(flash, Q.state_cue(F.col("value")), F.when(F.col("parsed").isNotNull(), "PRESENT")))
    return read.where("state is not null").withColumn("parsed", F.when(F.col("state") == "PRESENT", F.col("parsed")))


def first_claims(found: DataFrame, document: str = "document") -> DataFrame:
    """Of each field the first candidate by page and row that gives a state or a value: one aggregate for all fields. Its
    ``row`` comes along where candidates carry it."""
    carried = ["row"] if "row" in found.columns else []
    best = read_candidates(found).groupBy(document, "field").agg(F.min(F.struct("page", "row_no", "state", "parsed", *carried)).alias("b"))
    return best.select(document, "field", F.col("b.state").alias("state"), F.col("b.parsed").alias("value"), F.col("b.page").alias("page"), F.col("b.row_no").alias("row_no"), *[f"b.{c}" for c in carried])


def composition_form(rows: DataFrame, document: str = "document") -> DataFrame:
    """``document, form, premises`` where section 3 gives one set of premises that the composition rule accepts (``compositions``)."""
    return compositions(rows, document).where("form is not null")


def compositions(rows: DataFrame, document: str = "document") -> DataFrame:
    """``document, form, premises`` of every document with constituents; ``form`` is null where the rule accepts none.

    SUBSTANCE: one share of 100, no partial share, a completeness statement. MIXTURE: no share of 100, a header and at
    least two partial shares, the first two cited."""
    place = F.struct("page", "row_no", "at", "text")
    read = X.ingredient_rows(rows, document).withColumn("share", V.parse_concentration(F.col("concentration")))
    shares = read.groupBy(document).agg(
        F.array_sort(F.collect_list(F.when(Q.whole_share(F.col("share")), place))).alias("whole"),
        F.array_sort(F.collect_list(F.when(Q.partial_share(F.col("share")), place))).alias("partial"),
    )
    marked = composition_rows(rows, document).withColumn("at", F.lit(0)).withColumn("roles", Q.premise_roles(F.col("text")))
    first = lambda role: F.min(F.when(F.array_contains("roles", role), place))
    stated = marked.groupBy(document).agg(first("composition_header").alias("header"), first("completeness_statement").alias("complete"))
    substance = (F.size("whole") == 1) & (F.size("partial") == 0) & F.col("complete").isNotNull()
    mixture = (F.size("whole") == 0) & (F.size("partial") >= 2) & F.col("header").isNotNull()
    tried = merged(shares, stated, document, "left").select(
        document,
        F.when(substance, "SUBSTANCE").when(mixture, "MIXTURE").alias("form"),
        F.when(substance, F.array(F.get("whole", 0), F.col("complete"))).when(mixture, F.array(F.col("header"), F.get("partial", 0), F.get("partial", 1))).alias("premises"),
    )
    audited = D.audit(tried.where("form is not null").select(document, F.inline("premises")), [document])
    verdict = D.check_rule(F.lit(D.COMPOSITION_RULE), F.lit(FORM_FIELD), F.lit("PRESENT"), F.col("form"), F.size("premises"))
    held = F.col("form").isNotNull() & F.coalesce(verdict == "satisfied", F.lit(False))
    return merged(tried, audited, document, "left").select(document, F.when(held, F.col("form")).alias("form"), F.when(held, F.col("premises")).alias("premises"))


def product_form(rows: DataFrame, document: str = "document") -> DataFrame:
    """``document, form, rule, confidence, premises``: a declaration, else a section heading of a document with
    constituents, else a justified composition. The cited rows are ``premises``, a declaration's too."""
    premise = "array<struct<page: int, row_no: int, at: int, text: string>>"

    def stated(b: Column) -> Column:
        cited = F.array(F.struct(b["page"], b["row_no"], F.lit(0).alias("at"), b["text"]).cast(premise[6:-1]))
        return F.when(b.isNotNull(), F.struct(b["form"].alias("form"), F.lit(None).cast("string").alias("rule"), F.lit(DECLARED_CONFIDENCE).alias("confidence"), cited.alias("premises")))

    told = X.declared_forms(rows, document, {"declared": X.FORM_DECLARATIONS, "headed": X.HEADING_DECLARATIONS})
    composed = F.struct(F.col("form"), F.lit(D.COMPOSITION_RULE).alias("rule"), F.lit(DERIVED_CONFIDENCE).alias("confidence"), F.col("premises").cast(premise).alias("premises"))
    found = told.select(document, stated(F.col("declared")).alias("declared"), stated(F.col("headed")).alias("headed"), F.lit(None).cast("boolean").alias("held"))
    derived = compositions(rows, document).select(document, F.lit(True).alias("held"), F.when(F.col("form").isNotNull(), composed).alias("derived"))
    # Each side has one row a document.
    met = found.unionByName(derived, allowMissingColumns=True).groupBy(document).agg(*[F.max(c).alias(c) for c in ("declared", "headed", "held", "derived")])
    best = F.coalesce("declared", F.when(F.col("held"), F.col("headed")), "derived")
    return met.select(document, best.alias("b")).where("b is not null").select(document, "b.form", "b.rule", "b.confidence", "b.premises")


def confidence_of(prior: Column, seen: Column) -> Column:
    """The prior, or its mean with the OCR confidence of what was read (0 to 100; null or negative: none)."""
    return F.when(seen >= 0, F.bround((prior + seen / 100) / 2, 4)).otherwise(prior)


def row_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean ``confidence`` of the words of each row (keys), negative ones left out."""
    return words.groupBy(*keys).agg(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("confidence"))


def ingredient_blocks(rows: DataFrame, document: str = "document") -> DataFrame:
    """``document, state, evidence`` of the ingredient block: PRESENT where section 3 has items, citing its first row that
    holds the word CAS if any; else NOT_STATED."""
    items = X.ingredient_rows(rows, document).select(document).distinct().withColumn("held", F.lit(True))
    heads = composition_rows(rows, document).where(F.lower("text").rlike(r"(?<![a-z])cas(?![a-z])")).groupBy(document).agg(F.min(F.struct("page", "row_no", "text")).alias("head"))
    met = merged(merged(rows.select(document).distinct(), items, document, "left"), heads, document, "left")
    return met.select(document, F.when(F.col("held"), "PRESENT").otherwise("NOT_STATED").alias("state"), F.when(F.col("held"), F.col("head")).alias("evidence"))


def extract_documents(rows: DataFrame, layout: str = "rows", document: str = "document") -> DataFrame:
    """One claim a document and product field: ``document, field, state, value, derivation, rule, evidence, premises,
    confidence, rationale``. An explicit state other than PRESENT wins over a licensed derivation, that over an explicit
    value; nothing found is NOT_STATED. A registry number with a wrong check digit stays, with a rationale. Rows of an OCR
    layer may carry ``confidence``, the mean of their words' 0 to 100."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    # A document's rows are dealt out once and stay where they are: what follows is keyed by document.
    rows = rows.repartition(document)
    found = (row_candidates if layout == "rows" else linear_candidates)(rows, document)
    explicit = first_claims(found, document)
    forms = product_form(rows, document)
    audited = D.audit(forms.select(document, F.inline("premises")), [document]).select(document, F.struct(*D.ROLES, "declared").alias("audit"))
    # The verdict of the identifier rule depends on the premises only, so it is taken once a document.
    licensed = D.check_rule(F.lit(D.IDENTIFIER_RULE), F.lit("chemical_formula"), F.lit("NOT_APPLICABLE"), F.lit(None).cast("string"), F.size("premises")) == "satisfied"
    forms = merged(forms, audited, document).select(document, "form", F.col("rule").alias("form_rule"), "confidence", "premises", "audit.*").withColumn("licensed", licensed).drop(*D.ROLES, "declared")
    if layout == "rows":
        texts = explicit.select("*", "row.*")
    else:
        kept = [c for c in ("text", "confidence") if c in rows.columns]
        texts = merged(explicit, rows.select(document, "page", "row_no", *kept), [document, "page", "row_no"], "left")
    seen = F.col("confidence").cast("double") if "confidence" in rows.columns else F.lit(None).cast("double")
    texts = texts.withColumn("seen", seen)
    by_field = texts.groupBy(document).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("state", "value", F.struct("page", "row_no", "text").alias("evidence"), "seen")))).alias("explicit"))
    names = F.array(*[F.lit(name) for name, *_ in Q.FIELDS])
    base = merged(merged(rows.select(document).distinct(), by_field, document, "left"), forms, document, "left").withColumn("field", F.explode(names))
    base = base.withColumn("e", F.try_element_at("explicit", F.col("field")))
    is_form, e = F.col("field") == FORM_FIELD, F.col("e")
    known = F.coalesce(F.col("form") != "UNDETERMINED", F.lit(False))
    told = e.isNotNull() & (e["state"] != "PRESENT")
    barred = ~told & known & ~Q.field_defined(F.col("field"), F.col("form")) & F.coalesce(F.col("licensed"), F.lit(False))
    derived_form = is_form & known & F.col("form_rule").isNotNull()
    read = e.isNotNull() & ~is_form & ~barred
    flagged = read & (F.col("field") == "product_cas_number") & (e["state"] == "PRESENT") & ~F.coalesce(T.cas_valid(e["value"]), F.lit(False))
    spot = lambda p: F.struct(p["page"].alias("page"), p["row_no"].alias("row_no"), p["text"].alias("text"))
    return base.select(
        document,
        "field",
        F.when(is_form, F.when(known, "PRESENT")).when(barred, "NOT_APPLICABLE").when(read, e["state"]).alias("state"),
        F.when(is_form, F.when(known, F.col("form"))).when(read, e["value"]).alias("value"),
        F.when(derived_form | barred, "DERIVED").otherwise("DIRECT").alias("derivation"),
        F.when(derived_form, F.col("form_rule")).when(barred, D.IDENTIFIER_RULE).alias("rule"),
        F.when(is_form & known & ~derived_form, spot(F.get("premises", 0))).when(read, spot(e["evidence"])).alias("evidence"),
        F.when(derived_form | barred, F.transform("premises", spot)).alias("premises"),
        F.when((is_form & known) | barred, F.col("confidence")).when(read, confidence_of(_by_field({k: F.lit(v) for k, v in PRIORS.items()}), e["seen"])).alias("confidence"),
        F.when(flagged, "CAS check digit failed").when(derived_form, "composition table").when(barred, F.concat(F.lit("identifiers are undefined for "), F.col("form"))).alias("rationale"),
    ).withColumn("state", F.coalesce("state", F.lit("NOT_STATED")))
