"""Oracle flags and diagnostic probes: what a text layer holds of the gold, and which step of the extraction loses it.

Tables are as in ``evaluation``; gold rows also carry ``product_form``. ``rows`` are visual rows (``document, page, row_no,
text``). A page is read once for all fields of its document.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..functions import text as T
from ..functions import values as V
from ..operators import alignment as A
from ..operators import extract as X
from ..operators import joins as J
from ..operators import near as N
from ..operators import ranges as R
from ..operators import scoring as S
from ..operators import search
from . import derivation as D
from . import evaluation as E
from . import extraction as P

KEYS = ["document", "field"]


def ingredient_fields(items: DataFrame) -> DataFrame:
    """Each ingredient's registry number as a gold row of its own, ``ingredient_cas[pos]``."""
    some = items.where(F.coalesce(F.col("cas"), F.lit("")) != "")
    return some.select(
        "document", F.format_string("ingredient_cas[%d]", F.col("pos").cast("int")).alias("field"), F.lit("PRESENT").alias("state"), F.lit("EXPLICIT").alias("derivation"), F.lit(None).cast("string").alias("rule"),
        F.col("cas").alias("value"), F.array().cast("array<string>").alias("accepted"), E._spans(F.col("evidence")).alias("evidence"), F.array().cast(E.SPANS).alias("premises"),
    )


def _values(state: Column, value: Column, accepted: Column) -> Column:
    """The values of a gold field that are looked for."""
    none = F.array().cast("array<string>")
    values = F.filter(F.concat(F.array(value), F.coalesce(accepted, none)), lambda v: F.coalesce(v != "", F.lit(False)))
    return F.when(state == "PRESENT", values).otherwise(none)


def _needles(gold: DataFrame) -> DataFrame:
    """``document, field, kind, values, spans, pages``: what is looked for."""
    g = E._with(gold, accepted=F.array().cast("array<string>"))
    kind = reduce(lambda out, f: out.when(F.col("field") == f[0], f[1]), Q.FIELDS, F.when(F.col("field").startswith("ingredient_cas"), "identifier"))
    targets = F.when(F.col("derivation").isin(*E.GOLD_DERIVED), E._spans(F.col("premises"))).otherwise(E._spans(F.col("evidence")))
    g = g.withColumn("_t", targets)
    return g.select(
        *KEYS, "state", "derivation", "value", kind.alias("kind"),
        _values(F.col("state"), F.col("value"), F.col("accepted")).alias("values"),
        F.filter(F.transform("_t", lambda t: t["text"]), lambda t: F.coalesce(t != "", F.lit(False))).alias("spans"),
        F.array_distinct(F.transform("_t", lambda t: t["page"])).alias("pages"),
    )


def _holds(page: Column, quote: Column) -> Column:
    return search.contains(page, T.search_form(quote))


def oracle_flags(gold: DataFrame, pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``document, field, value_exact, value_typed, value_pages, value_located, located_pages, value_on_gold_page, span_exact,
    note`` for one text layer.

    A value is located where one of its exact places has a word with a box under it: ``words`` (``document, page, start, end,
    text, box``) or the ``words`` that pages carry tell; without either every place counts. ``value_on_gold_page`` goes by
    located pages. Flags are null where gold has no value or span; a document without pages holds nothing."""
    needles = _needles(gold)
    forms = lambda c: F.array_distinct(F.transform(c, lambda v: T.search_form(v)))
    packed = needles.groupBy("document").agg(F.collect_list(F.struct("field", "kind", "values", forms("values").alias("quotes"), forms("spans").alias("spans"))).alias("needles"))
    boxed = words is not None or "words" in pages.columns
    texts = pages.select("document", F.col("page").cast("int").alias("page"), "text", "row_text", T.search_form(F.col("text")).alias("form"), *(["words"] if boxed and words is None else []))
    if words is not None:
        texts = J.merged(texts, _by_page(words), ["document", "page"], "left")
    own = None if boxed and "text" in texts.schema["words"].dataType.elementType.names else "text"
    kinds = (*S.KINDS, "categorical")
    yes = lambda c: F.coalesce(c, F.lit(False))
    held = lambda q: yes(search.contains(F.col("form"), q))
    # Each is an array beside ``needles``: what a caller does not ask for is not computed.
    read = J.streamed(texts, packed, "document").withColumn("quotes", F.transform("needles", lambda n: F.filter(n["quotes"], held)))
    read = read.withColumns({"typed": _typed(kinds), "span": F.transform("needles", lambda n: F.exists(n["spans"], held))})
    if boxed:
        read = read.withColumn("boxed", R.boxed_hits("form", "quotes", *R.packed_words("words", own)))
    at_needle = lambda c: F.get(c, F.col("i"))
    found = read.select("document", "page", "quotes", "typed", "span", *(["boxed"] if boxed else []), F.posexplode(F.transform("needles", lambda n: n["field"])).alias("i", "field"))
    exact = F.size(at_needle("quotes")) > 0
    found = found.select("document", "page", "field", exact.alias("exact"), at_needle("typed").alias("typed"), at_needle("span").alias("span"), (yes(at_needle("boxed")) if boxed else exact).alias("boxed"))
    at = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("page"))))
    held = found.groupBy(*KEYS).agg(F.bool_or("exact").alias("e"), F.bool_or("typed").alias("t"), F.bool_or("span").alias("s"), at("exact").alias("at"), at("boxed").alias("located"))
    met = needles.join(held, KEYS, "left")
    valued, spanned = F.size("values") > 0, F.size("spans") > 0
    none = F.array().cast("array<int>")
    at, located = F.coalesce("at", none), F.coalesce("located", none)
    return met.select(
        *KEYS, F.col("state").alias("gold_state"), F.col("derivation").alias("gold_derivation"), F.col("value").alias("gold_value"),
        F.when(valued, yes(F.col("e"))).alias("value_exact"), F.when(valued, yes(F.col("t"))).alias("value_typed"), F.when(valued, at).alias("value_pages"),
        F.when(valued, F.size(located) > 0).alias("value_located"), F.when(valued, located).alias("located_pages"),
        F.when(valued, F.arrays_overlap(located, F.filter("pages", lambda p: p.isNotNull()))).alias("value_on_gold_page"), F.when(spanned, yes(F.col("s"))).alias("span_exact"),
        F.concat_ws("; ", F.when(valued & (F.size(located) == 0), "value not found"), F.when(spanned & ~yes(F.col("s")), "span not found")).alias("note"),
    )


def oracle_flags_rows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``oracle_flags`` where a row holds a document's only page and its gold, so that nothing moves: ``document, page, text``, ``words``
    (``ranges.FLAT``) and ``golds``, an array of ``field, state, value, accepted``; rows may differ by more columns, such as a layer.
    ``document, by, field, value_exact, value_located, located_pages``."""
    needle = lambda g: T.let(_values(g["state"], g["value"], g["accepted"]), lambda v: F.struct(g["field"].alias("field"), (F.size(v) > 0).alias("valued"), F.array_distinct(F.transform(v, lambda x: T.search_form(x))).alias("quotes")))
    held = lambda q: F.coalesce(search.contains(F.col("form"), q), F.lit(False)) & F.col("document").isNotNull()
    read = rows.select("document", *by, F.col("page").cast("int").alias("page"), "words", T.search_form(F.col("text")).alias("form"), F.transform("golds", needle).alias("needles"))
    read = read.withColumn("quotes", F.transform("needles", lambda n: F.filter(n["quotes"], held)))
    asked = read.select("document", *by, "page", "words", "form", "quotes", F.transform("needles", lambda n: F.struct(n["field"].alias("field"), n["valued"].alias("valued"))).alias("needles"))
    found = R.flat_hits(asked, ["document", *by, "page", "needles"])
    found = found.select("document", *by, "page", "quotes", "boxed", F.posexplode("needles").alias("i", "n"))
    at, valued = lambda c: F.get(c, F.col("i")), F.col("n.valued")
    boxed = F.coalesce(at("boxed"), F.lit(False))
    return found.select(
        "document", *by, "n.field", F.when(valued, F.size(at("quotes")) > 0).alias("value_exact"), F.when(valued, boxed).alias("value_located"),
        F.when(valued, F.when(boxed, F.array("page")).otherwise(F.array().cast("array<int>"))).alias("located_pages"),
    )


def _typed(kinds: tuple[str, ...]) -> Column:
    """For each of a row's ``needles`` whether one of its values is supported by the page's text or rows; the page is normalised
    once for each kind that is looked for."""

    def of(kind: str) -> Column:
        def read(forms: Column) -> Column:
            some = lambda n: F.exists(n["values"], lambda v: F.exists(forms, lambda f: F.coalesce(V.supported_in(v, f, kind), F.lit(False))))
            return F.transform("needles", lambda n: F.coalesce((n["kind"] == kind) & some(n), F.lit(False)))

        forms = F.transform(F.array_distinct(F.array("text", "row_text")), lambda c: V.support_form(c, kind))
        asked = F.exists("needles", lambda n: F.coalesce(n["kind"] == kind, F.lit(False)))
        return F.when(asked, T.let(forms, read)).otherwise(F.array().cast("array<boolean>"))

    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    return reduce(lambda out, kind: F.zip_with(out, of(kind), either), kinds, F.transform("needles", lambda n: F.lit(False)))


def _by_page(words: DataFrame) -> DataFrame:
    """``document, page, words`` of words that are rows."""
    word = F.struct(*[F.col(c) for c in ("start", "end", "text", "box")])
    return words.groupBy("document", F.col("page").cast("int").alias("page")).agg(F.collect_list(word).alias("words"))


def fuzzy_flags(gold: DataFrame, pages: DataFrame, least: float = 90.0) -> DataFrame:
    """``document, field, value_fuzzy, span_fuzzy``: diagnostic likeness of ``least`` or more on some page of the document."""
    needles = _needles(gold)
    said = lambda what: F.transform(f"{what}s", lambda v: F.struct(F.lit(what).alias("what"), T.search_form(v).alias("quote")))
    wanted = needles.select(*KEYS, F.inline(F.concat(said("value"), said("span")))).distinct()
    texts = pages.select("document", F.col("page").cast("int").alias("page"), T.search_form(F.col("text")).alias("form"))
    near = N.best_of(texts.join(wanted, "document"), [*KEYS, "what", "quote", "page"], least)
    some = near.groupBy(*KEYS).agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("value", "span")])
    paged = needles.join(texts.select("document").distinct(), "document", "left_semi").where((F.size("values") > 0) | (F.size("spans") > 0))
    return paged.select(*KEYS).join(some, KEYS, "left").select(*KEYS, *[F.coalesce(F.col(w) > 0, F.lit(False)).alias(f"{w}_fuzzy") for w in ("value", "span")])


# Columns of an oracle row over both text layers.
ORACLE_COLUMNS = (
    "document", "field", "gold_state", "gold_derivation", "gold_value", "value_exact_native", "value_exact_ocr", "value_typed_native", "value_typed_ocr", "value_fuzzy_native", "value_fuzzy_ocr",
    "value_located_native", "value_located_ocr", "value_located_pages_native", "value_located_pages_ocr", "value_on_gold_page_native", "value_on_gold_page_ocr", "span_exact_native", "span_exact_ocr", "span_fuzzy_ocr", "note",
)


def oracle_rows(gold: DataFrame, native: DataFrame, ocr: DataFrame | None = None, words: dict[str, DataFrame] | None = None) -> DataFrame:
    """The oracle's 21 text columns for every gold field: yes, no, or blank where a flag does not apply or the document has no
    such layer. ``words`` has the words of a layer (``native``, ``ocr``) whose pages do not carry them."""
    flag = lambda c: F.when(c, "yes").when(~c, "no").otherwise("")
    out, notes = None, []
    for name, pages in (("native", native), ("ocr", ocr)):
        base = oracle_flags(gold, native if pages is None else pages, (words or {}).get(name))
        held = (native.limit(0) if pages is None else pages).select(F.col("document").alias("of")).distinct()
        near = fuzzy_flags(gold, native.limit(0) if pages is None else pages)
        met = base.join(near, KEYS, "left").join(held, F.col("document") == F.col("of"), "left")
        there = F.col("of").isNotNull()
        valued, spanned = there & F.col("value_exact").isNotNull(), there & F.col("span_exact").isNotNull()
        on = lambda cond, c: F.when(cond, flag(F.coalesce(F.col(c), F.lit(False)))).otherwise("")
        cells = {
            f"value_exact_{name}": on(valued, "value_exact"), f"value_typed_{name}": on(valued, "value_typed"), f"value_fuzzy_{name}": on(valued, "value_fuzzy"), f"value_located_{name}": on(valued, "value_located"),
            f"value_located_pages_{name}": F.when(valued, F.array_join(F.transform("located_pages", lambda p: p.cast("string")), ";")).otherwise(""), f"value_on_gold_page_{name}": on(valued, "value_on_gold_page"),
            f"span_exact_{name}": on(spanned, "span_exact"), f"span_fuzzy_{name}": on(spanned, "span_fuzzy"),
        }
        one = met.select(*KEYS, "gold_state", "gold_derivation", F.coalesce("gold_value", F.lit("")).alias("gold_value"), *[c.alias(k) for k, c in cells.items()])
        out = one if out is None else out.join(one.drop("gold_state", "gold_derivation", "gold_value"), KEYS)
        notes += [F.when(F.col(f"value_located_{name}") == "no", f"value not found on {name}"), F.when(F.col(f"span_exact_{name}") == "no", f"span not found on {name}")]
    return out.withColumn("note", F.concat_ws("; ", *notes)).select(*ORACLE_COLUMNS)


def oracle_summary(rows: DataFrame) -> DataFrame:
    """``part, flag, yes, decided, rate`` over oracle rows: product values, ingredient numbers, spans by kind of gold."""
    item = F.col("field").startswith("ingredient_")
    parts = {"product": ~item & (F.col("gold_state") == "PRESENT"), "ingredient": item & (F.col("gold_state") == "PRESENT"), "direct": F.col("gold_derivation") == "EXPLICIT", "premise": F.col("gold_derivation").isin(*E.GOLD_DERIVED)}
    flags = [c for c in ORACLE_COLUMNS if c.startswith(("value_", "span_")) and "pages" not in c]
    tags = F.array_compact(F.array(*[F.when(cond, name) for name, cond in parts.items()]))
    cells = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("said")) for c in flags])
    long = rows.select(F.explode(tags).alias("part"), cells.alias("cells")).select("part", F.inline("cells")).where("said <> ''")
    return long.groupBy("part", "flag").agg(F.count_if(F.col("said") == "yes").alias("yes"), F.count("*").alias("decided")).withColumn("rate", F.col("yes") / F.col("decided"))


def oracle_misses(rows: DataFrame) -> DataFrame:
    """``document, field, layer``: product values that are stated but not located on a layer."""
    miss = F.array_compact(F.array(*[F.when(F.col(f"value_located_{n}") == "no", n) for n in ("native", "ocr")]))
    return rows.where(~F.col("field").startswith("ingredient_")).select(*KEYS, F.explode(miss).alias("layer"))


def cited_range(text: Column, start: Column, end: Column) -> Column:
    """First character and end of the lines around the characters ``start`` to ``end``, with the line before when that ends in a
    colon and these have none."""
    begin = start - F.length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1))
    stop = end + F.length(F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1))

    def led(x: Column) -> Column:
        before = F.substring_index(F.substring(text, F.lit(1), x["start"] - 1), "\n", -1)
        bare = lambda before: (x["start"] > 0) & F.rtrim(before).endswith(":") & ~F.contains(F.substring(text, x["start"] + 1, x["end"] - x["start"]), F.lit(":"))
        return T.let(before, lambda b: F.struct(F.when(bare(b), x["start"] - 1 - F.length(b)).otherwise(x["start"]).alias("start"), x["end"].alias("end")))

    return T.let(F.struct(begin.alias("start"), stop.alias("end")), led)


def span_between(page: Column, text: Column, words: Column | None, start: Column, end: Column, box_under=R.box_under) -> Column:
    """The span of a page's characters ``start`` to ``end``: its text without space at its ends and the box of the words under it."""
    box = F.lit(None) if words is None else box_under(words, start, end)
    return _span(page, F.regexp_replace(F.substring(text, start + 1, end - start), r"^\s+|\s+$", ""), box)


def _first_place(n: Column) -> Column:
    """The first of a needle's ``quotes`` that the page's ``form`` holds, and its first and last character there."""
    places = F.transform(n["quotes"], lambda q: F.struct(q.alias("quote"), F.position(q, F.col("form")).alias("at"), F.length(q).alias("size")))
    first = F.get(F.filter(places, lambda p: (p["at"] > 0) & (p["size"] > 0)), 0)
    return T.let(first, lambda p: F.struct(n["field"].alias("field"), p["quote"].alias("quote"), (p["at"] - 1).alias("first"), (p["at"] + p["size"] - 2).alias("last")))


def _cite(words: Column | None, box_under=R.box_under):
    """The lines around a value found, whose characters are two of the page's ``places``."""

    def cite(x: Column, i: Column) -> Column:
        lines = cited_range(F.col("text"), F.get("places", i * 2), F.get("places", i * 2 + 1) + 1)
        span = T.let(lines, lambda at: span_between(F.col("page"), F.col("text"), words, at["start"], at["end"], box_under))
        return F.struct(x["field"].alias("field"), x["quote"].alias("quote"), span.alias("span"))

    return cite


def locate_rows(rows: DataFrame) -> DataFrame:
    """As ``locate_values`` where a row holds a document's only page and its gold, so that nothing moves: ``document, page, text``,
    ``words`` (``ranges.FLAT``) and ``golds``, an array of ``field, state, value, accepted``."""
    quotes = lambda g: F.transform(_values(g["state"], g["value"], g["accepted"]), lambda v: T.search_form(v))
    needles = F.transform("golds", lambda g: F.struct(g["field"].alias("field"), quotes(g).alias("quotes")))
    met = rows.where("document is not null").select("document", F.col("page").cast("int").alias("page"), "text", "words", T.search_form(F.col("text")).alias("form"), needles.alias("needles"))
    met = met.withColumn("found", F.filter(F.transform("needles", _first_place), lambda x: x["quote"].isNotNull())).drop("form", "needles")
    met = search.with_places(met.withColumn("asked", F.flatten(F.transform("found", lambda x: F.array(x["first"], x["last"])))), "text", "asked")
    hits = met.select("document", "page", F.inline(F.transform("found", _cite(F.col("words"), R.flat_box))))
    return hits.select(*KEYS, "page", F.col("span.text").alias("text"), "span")


def locate_values(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """``document, field, page, text, span``: the first page that holds an accepted value, and the lines around its first place.

    Of several values that a page holds the first counts. Where pages carry their ``words``, the span has their box."""
    sought = F.when(F.size("values") > 0, F.struct("field", F.transform("values", lambda v: T.search_form(v)).alias("quotes")))
    wanted = _needles(gold).groupBy("document").agg(F.collect_list(sought).alias("needles"))
    held = "words" in pages.columns
    texts = pages.select("document", F.col("page").cast("int").alias("page"), "text", T.search_form(F.col("text")).alias("form"), *(["words"] if held else []))

    # The page stays in its row: places are asked for once, and only lines with their boxes leave it.
    met = J.streamed(texts, wanted, "document").withColumn("found", F.filter(F.transform("needles", _first_place), lambda x: x["quote"].isNotNull()))
    asked = F.flatten(F.transform("found", lambda x: F.array(x["first"], x["last"])))
    met = met.withColumn("places", search.offsets_at(F.when(F.size("found") > 0, F.col("text")), asked))

    hits = met.select("document", "page", F.inline(F.transform("found", _cite(F.col("words") if held else None))))
    first = hits.groupBy(*KEYS).agg(F.min_by(F.struct("page", "span"), F.struct("page", "quote")).alias("b"))
    return first.select(*KEYS, "b.page", F.col("b.span.text").alias("text"), "b.span")


def _span(page: Column, text: Column, box: Column | None = None) -> Column:
    return F.struct(page.cast("int").alias("page"), text.alias("text"), (F.lit(None) if box is None else box).alias("box")).cast(E.SPANS[6:-1])


def _claims(rows: DataFrame, state, value, evidence=None, premises=None, rule=None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        *KEYS, state.alias("state"), (none("string") if value is None else value).alias("value"), F.lit("DIRECT" if premises is None else "DERIVED").alias("derivation"),
        (none("string") if rule is None else rule).alias("rule"), (none(E.SPANS[6:-1]) if evidence is None else evidence).alias("evidence"), (F.array().cast(E.SPANS) if premises is None else E._spans(premises)).alias("premises"),
    )


def _derived_claims(rows: DataFrame, form: Column, premises: Column) -> DataFrame:
    is_form = F.col("field") == P.FORM_FIELD
    return _claims(rows, F.when(is_form, "PRESENT").otherwise("NOT_APPLICABLE"), F.when(is_form, form), premises=premises, rule=F.col("rule"))


def gold_value_claims(gold: DataFrame, pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Value, state and form are given; evidence is looked for. Spans have boxes where ``pages`` carry ``words`` and ``rows`` a ``box``."""
    box = F.col("box") if "box" in rows.columns else F.lit(None).cast(E.SPANS[6:-1])["box"]
    boxed = rows.withColumn("box", box)
    g = gold.where("state <> 'NOT_STATED'").withColumn("derived", F.col("derivation").isin(*E.GOLD_DERIVED))
    told = boxed.withColumn("form", Q.form_cue(F.col("text"))).where("form is not null").groupBy("document", "form").agg(F.min(F.struct("page", "row_no", "text", "box")).alias("b"))
    told = told.select("document", "form", _span(F.col("b.page"), F.col("b.text"), F.col("b.box")).alias("declared"))
    formed = g.where(F.col("derived") | (F.col("field") == P.FORM_FIELD)).withColumn("form", F.when(F.col("derived"), F.col("product_form")).otherwise(F.col("value"))).join(told, ["document", "form"], "left")
    row = boxed.select("document", F.col("page"), "row_no", "box").dropDuplicates(["document", "page", "row_no"])
    items = X.ingredient_rows(rows).join(row, ["document", "page", "row_no"], "left")
    items = items.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "row_no", "at", "text", "box"))).alias("items"))
    items = items.select("document", F.transform(F.slice("items", 1, 2), lambda i: _span(i["page"], i["text"], i["box"])).alias("items"))
    formed = formed.join(items, "document", "left")
    found = F.when(F.col("declared").isNotNull(), F.array("declared")).when(F.col("rule") == D.COMPOSITION_RULE, F.col("items"))
    derived = formed.where("derived").withColumn("found", found).where(F.size("found") > 0)
    out = _derived_claims(derived, F.col("form"), F.col("found"))
    out = out.unionByName(_claims(formed.where("not derived and declared is not null"), F.lit("PRESENT"), F.col("value"), F.col("declared")))
    plain = g.where(~F.col("derived") & (F.col("field") != P.FORM_FIELD))
    cited = locate_values(plain, pages).join(plain.select(*KEYS, "value"), KEYS)
    out = out.unionByName(_claims(cited, F.lit("PRESENT"), F.col("value"), F.col("span")))
    read = P.read_candidates(P.row_candidates(rows)).withColumnRenamed("value", "slot")
    same = read.join(plain.where("state <> 'PRESENT'").select(*KEYS, "state"), [*KEYS, "state"])
    best = same.groupBy(*KEYS).agg(F.min(F.struct("page", "row_no", "state")).alias("b")).select(*KEYS, "b.*")
    met = best.join(boxed.select("document", "page", "row_no", "text", "box"), ["document", "page", "row_no"])
    return out.unionByName(_claims(met, F.col("state"), None, _span(F.col("page"), F.col("text"), F.col("box"))))


def after_label(text: Column, field: str) -> Column:
    """A span's text behind its first label of the field and the separators that follow; all of it without one."""
    labels = "|".join(re.escape(label) for label in X.LABELS[field])
    return F.regexp_replace(T.collapse(text), rf"(?i)^.*?(?<![a-z0-9])(?:{labels})(?![a-z0-9])\s*(?:[:=]\s*)*", "")


def spans_on_layer(gold: DataFrame, native: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """``gold`` with its ``evidence`` and ``premises`` as they stand on a layer; a span that is not there is left out.

    Native spans are cut by their own characters. On an OCR layer a span's place is that which resolving it found
    (``ocr_char_start, ocr_char_end``), else what aligning the two layers finds. Both layers carry ``words``; spans of
    ``gold`` carry ``char_start, char_end``."""
    layer = native if ocr is None else ocr
    arrays = ("evidence", "premises")
    long = None
    for name in arrays:
        one = gold.select(*KEYS, F.lit(name).alias("part"), F.posexplode(name).alias("nr", "s"))
        fields = [f.name for f in one.schema["s"].dataType.fields]
        at = [F.col("s.ocr_char_start" if "ocr_char_start" in fields else "s.char_start"), F.col("s.ocr_char_end" if "ocr_char_end" in fields else "s.char_end")]
        known = F.lit(ocr is None or "ocr_char_start" in fields) & at[0].isNotNull()
        one = one.select(*KEYS, "part", "nr", F.col("s.page").cast("int").alias("page"), F.col("s.text").alias("text"), F.col("s.char_start").alias("char_start"), F.col("s.char_end").alias("char_end"), known.alias("known"), at[0].alias("at"), at[1].alias("stop"))
        long = one if long is None else long.unionByName(one)
    held = layer.select("document", F.col("page").cast("int").alias("page"), F.col("text").alias("_body"), F.col("words").alias("_words"))
    start, stop = (F.col("char_start"), F.col("char_end")) if ocr is None else (F.col("at"), F.col("stop"))
    cut = long.where("known").join(held, ["document", "page"]).select(*KEYS, "part", "nr", span_between(F.col("page"), F.col("_body"), F.col("_words"), start, stop).alias("span"))
    if ocr is not None:
        carried = A.carry(long.where("not known"), native, ocr).where("there is not null")
        cut = cut.unionByName(carried.select(*KEYS, "part", "nr", _span(F.col("there.page"), F.col("there.text"), F.col("there.box")).alias("span")))
    packed = cut.groupBy(*KEYS).agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("nr", "span")))).alias(f"_{name}") for name in arrays])
    met = gold.drop(*arrays).join(packed, KEYS, "left")
    spans = {name: F.coalesce(F.transform(f"_{name}", lambda x: x["span"]), F.array().cast(E.SPANS)) for name in arrays}
    return met.withColumns(spans).drop(*[f"_{name}" for name in arrays])


def gold_evidence_claims(gold: DataFrame) -> DataFrame:
    """The gold spans are given; state and value are read off them. ``spans_on_layer`` puts them on a layer first."""
    g = gold.where("state <> 'NOT_STATED'").withColumn("premises", E._spans(F.col("premises"))).withColumn("first", F.get(E._spans(F.col("evidence")), 0))
    g = g.withColumn("derived", F.col("derivation").isin(*E.GOLD_DERIVED))
    audited = E._audited(g.where(F.col("derived") & (F.size("premises") > 0)).select(*KEYS, "rule", "premises"), KEYS, "premises").withColumn("form", D.established_form())
    limited = ~F.col("field").isin(*[name for name, *_, forms in Q.FIELDS if forms]) | F.col("form").isin("MIXTURE", "ARTICLE")
    out = _derived_claims(audited.where(F.col("form").isNotNull() & limited), F.col("form"), F.col("premises"))
    direct = g.where("not derived and first is not null")
    formed = direct.where(F.col("field") == P.FORM_FIELD).withColumn("form", Q.form_cue(F.col("first.text"))).where("form is not null")
    out = out.unionByName(_claims(formed, F.lit("PRESENT"), F.col("form"), F.col("first")))
    slot = P._by_field({f: after_label(F.col("first.text"), f) for f in X.LABELS})
    read = P.read_candidates(direct.where(F.col("field") != P.FORM_FIELD).select(*KEYS, "first", slot.alias("value")))
    return out.unionByName(_claims(read, F.col("state"), F.col("parsed"), F.col("first")))


def gold_claims(gold: DataFrame) -> DataFrame:
    """The gold itself as claims, for the support check."""
    derived = F.col("derivation").isin(*E.GOLD_DERIVED)
    g = gold.withColumn("spans", F.when(derived, E._spans(F.col("premises"))).otherwise(E._spans(F.col("evidence"))))
    g = g.where((F.col("state") == "NOT_STATED") | (F.size("spans") > 0))
    cited = F.when(~derived & (F.col("state") != "NOT_STATED"), F.get("spans", 0))
    return g.select(*KEYS, "state", "value", F.when(derived, "DERIVED").otherwise("DIRECT").alias("derivation"), F.when(derived, F.col("rule")).alias("rule"), cited.alias("evidence"), F.when(derived, F.col("spans")).otherwise(F.array().cast(E.SPANS)).alias("premises"))


def run_probes(gold: DataFrame, pages: DataFrame, rows: DataFrame, pipeline: DataFrame | None = None, native: DataFrame | None = None) -> DataFrame:
    """Scored claims of each probe (``probe`` and the columns of ``evaluate``); fields that gold calls NOT_STATED are left out.

    A field for which a probe found no claim has ``predicted_state`` null. ``pages`` are of the layer that is probed; with
    ``native`` pages it is an OCR layer, and gold spans are read as they stand on it."""
    asked = gold.where("state <> 'NOT_STATED'")
    spans = asked if native is None else spans_on_layer(asked, native, pages)
    made = {"gold_value": gold_value_claims(asked, pages, rows), "gold_evidence": gold_evidence_claims(spans), "gold_verify": gold_claims(asked)}
    if pipeline is not None:
        made["pipeline"] = pipeline.select(*gold_claims(asked).columns)
    claims = reduce(DataFrame.unionByName, [c.withColumn("probe", F.lit(name)) for name, c in made.items()])
    return E.evaluate(asked.withColumn("probe", F.explode(F.array(*map(F.lit, made)))), claims, pages, by=("probe",))


def probe_rates(scored: DataFrame) -> DataFrame:
    """Per probe the share of evidence-bearing fields that pass: localisation for ``gold_value``, state and value for
    ``gold_evidence``, support for ``gold_verify`` (of claims made), all axes for the pipeline."""
    has = F.col("predicted_state").isNotNull()
    ok = F.when(F.col("probe") == "gold_value", has & S.joint(E.LOCAL)).when(F.col("probe") == "gold_evidence", has & S.joint(("state", "value"))).when(F.col("probe") == "gold_verify", F.col("support") == "satisfied").otherwise(F.col("joint"))
    counted = scored.where(F.col("gold_requires_evidence") & (has | (F.col("probe") != "gold_verify")))
    return counted.groupBy("probe").agg(F.count("*").alias("n"), F.count_if(has).alias("claims"), F.count_if(ok).alias("passed"), F.avg(ok.cast("int")).alias("rate"))


# Columns of a diagnostics row.
PROBE_COLUMNS = (
    "document", "field", "gold_state", "gold_derivation", "value_cited", "value_page", "value_span", "value_bbox", "value_support", "value_localized",
    "evidence_available", "evidence_read", "evidence_state", "evidence_value", "evidence_support", "verify_available", "verify_support", "verify_note", "pipeline_joint",
)


def diagnostics_rows(scored: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``run_probes`` as one row a field, a probe's axes side by side (n/a where it found no claim).

    ``spans`` is the gold as it stands on the probed layer (``spans_on_layer``): a field's evidence is available where one of its
    spans is there. ``pipeline_joint`` is blank without a pipeline."""
    made = lambda probe: (F.col("probe") == probe) & F.col("predicted_state").isNotNull()
    axis = lambda probe, name: F.coalesce(F.max(F.when(made(probe), F.col(name))), F.lit("n/a"))
    some = lambda probe, ok=None: F.coalesce(F.bool_or(made(probe) & (F.lit(True) if ok is None else ok)), F.lit(False))
    joint = F.max(F.when(F.col("probe") == "pipeline", F.when(F.col("joint"), "yes").otherwise("no")))
    held = spans.select(*KEYS, ((F.size(E._spans(F.col("evidence"))) + F.size(E._spans(F.col("premises")))) > 0).alias("evidence_available"))
    rows = scored.groupBy(*KEYS).agg(
        F.first("gold_state").alias("gold_state"), F.first("gold_derivation").alias("gold_derivation"), some("gold_value").alias("value_cited"),
        *[axis("gold_value", a).alias(f"value_{a}") for a in ("page", "span", "bbox", "support")], some("gold_value", S.joint(E.LOCAL)).alias("value_localized"),
        some("gold_evidence").alias("evidence_read"), *[axis("gold_evidence", a).alias(f"evidence_{a}") for a in ("state", "value", "support")],
        some("gold_verify").alias("verify_available"), axis("gold_verify", "support").alias("verify_support"),
        F.coalesce(F.max(F.when(made("gold_verify"), F.col("support_note"))), F.lit("")).alias("verify_note"), F.coalesce(joint, F.lit("")).alias("pipeline_joint"),
    )
    met = rows.join(held, KEYS, "left").withColumn("evidence_available", F.coalesce("evidence_available", F.lit(False)))
    return met.select(*PROBE_COLUMNS)
