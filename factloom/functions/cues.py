"""State and form cues, field definitions and premise roles as Spark columns over fixed word tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import values as V

# Cue phrases by state.
NOT_APPLICABLE_CUES = (
    "not applicable", "non-applicable", "non applicable", "not relevant", "n/a", "nap", "does not apply",
    "does not sustain combustion", "does not flash", "non-combustible", "noncombustible", "not combustible", "no flash point",
)
NO_DATA_CUES = (
    "no applicable data available", "no data available", "no data is available", "no data", "not available",
    "no information available", "not determined", "not established", "not specified", "not known", "unknown", "nav", "n/d", "no information",
)
# Form words, ties of position in this order.
FORM_CUES = {"ARTICLE": ("article", "articles"), "MIXTURE": ("mixture", "mixtures", "preparation", "preparations"), "SUBSTANCE": ("substance", "substances", "mono-constituent")}
NEGATED_ENTRY = r"(?:(?<![a-z0-9])3\.1\.?\s*)?(?<![a-z])substances?(?![a-z])\W{0,3}(?:not applicable|non-applicable|non applicable|n/a|not relevant|does not apply)|(?<![a-z0-9])3\.1\.?\s*n/a(?![a-z0-9])"
NEGATED_FORM = r"\bnot\s+(?:a\s+|an\s+)?(?:hazardous\s+)?(?:substance|mixture|article)\b"
BOTH_HEADINGS = r"^(?:3\.1\.?\s*)?substances\s+(?:or|/|and)\s+(?:3\.2\.?\s*)?mixtures(?![a-z])"
HEADING = r"^(?:3\.[12]\.?\s*)?(mixtures|substances)(?![a-z])"
# Product fields, their kinds, tolerances and the forms for which they are defined (empty: all).
FIELDS = (
    ("product_name", "name", 0.0, ()),
    ("supplier_name", "name", 0.0, ()),
    ("substance_or_mixture", "categorical", 0.0, ()),
    ("product_cas_number", "identifier", 0.0, ("SUBSTANCE",)),
    ("chemical_formula", "formula", 0.0, ("SUBSTANCE",)),
    ("molecular_weight", "quantity", 0.05, ("SUBSTANCE",)),
    ("flash_point", "temperature", 0.6, ()),
)
# Sections of a sheet where a field is usually found.
SECTIONS = {
    "product_name": ("1.1",),
    "supplier_name": ("1.3",),
    "substance_or_mixture": ("3.1", "3.2"),
    "product_cas_number": ("1.1", "3.1"),
    "chemical_formula": ("1.1", "3.1", "9.1"),
    "molecular_weight": ("3.1", "9.1", "9.2"),
    "flash_point": ("9.1",),
}
# What each field is, as queries for it say.
DESCRIPTIONS = {
    "product_name": "Trade name / product identifier.",
    "supplier_name": "Supplier, manufacturer or distributor named on the SDS.",
    "substance_or_mixture": "Whether the product is a substance, mixture or article.",
    "product_cas_number": "CAS of the product itself. Defined only for a substance.",
    "chemical_formula": "Molecular formula of the product. Defined only for a substance.",
    "molecular_weight": "Molecular weight in g/mol. Defined only for a substance.",
    "flash_point": "Flash point, compared in degrees Celsius.",
}
# A composition header, registry and EC numbers, completeness statements.
_CAS_WORD = r"(?<![a-z])(?:cas|c\.a\.s\.?)(?![a-z])"
_SHARE_WORD = r"%|(?<![a-z])wt(?![a-z])|weight|concentration|(?<![a-z])conc(?![a-z])|content"
COMPOSITION_HEADER = rf"{_CAS_WORD}.*?(?:{_SHARE_WORD})|(?:{_SHARE_WORD}).*?{_CAS_WORD}"
CAS_NUMBER = r"(?<![\d-])\d{2,7}-\d{2}-\d(?![\d-])"
EC_NUMBER = r"(?<![\d-])\d{3}-\d{3}-\d(?![\d-])"
COMPLETENESS = (
    r"no (?:other |further )?(?:impurit(?:y|ies)|stabili[sz]ers?|additives?)|no (?:other|further) (?:ingredient|component|constituent|substance)s?"
    r"|contains? no (?:other|further)|100\s*%\s*(?:pure|purity)|purity\s*(?:of\s*)?100\s*%"
)


def any_cue(cues: tuple[str, ...]) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(map(re.escape, cues)) + ")(?![a-z0-9])"


def has_cue(cue: str, c: Column) -> Column:
    return c.rlike(any_cue((cue,)))


def empty_slot(c: Column) -> Column:
    """The text ends in a lone dash."""
    return c.rlike(r"[\s:]*[-–—]\s*$")


def state_cue(c: Column) -> Column:
    """NO_DATA, NOT_APPLICABLE or null; no-data phrases are tried first."""
    low = F.trim(T.collapse(F.lower(c)), F.lit(" .:;"))
    return F.when(low == "", None).when(low.rlike(any_cue(NO_DATA_CUES)), "NO_DATA").when(low.rlike(any_cue(NOT_APPLICABLE_CUES)), "NOT_APPLICABLE").when(empty_slot(low), "NO_DATA")


def value_part(c: Column) -> Column:
    """The text after the last colon if there is any, else all of it."""
    return T.let(T.collapse(F.lower(c)), _value_part)


def _value_part(low: Column) -> Column:
    tail = F.trim(F.substring_index(low, ":", -1), F.lit(" .;"))
    return F.when(F.contains(low, F.lit(":")) & (tail != ""), tail).otherwise(F.trim(low, F.lit(" .;")))


def form_cue(c: Column) -> Column:
    """The product form that a span declares, or null."""
    return T.let(T.collapse(F.lower(c)), declared_form)


def _any_of(c: Column, *words: str) -> Column:
    """One of the words is in the text: a plain search, ahead of the expressions that need one of them."""
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


_FORM_WORD = r"(?s)^.*?(?<![a-z0-9])(" + "|".join(re.escape(cue) for cues in FORM_CUES.values() for cue in cues) + r")(?![a-z0-9])"


def declared_form(low: Column) -> Column:
    """``form_cue`` of a lower-cased text with single spaces: the first form word decides."""
    first = lambda part: T.let(F.regexp_extract(part, _FORM_WORD, 1), lambda word: _form_by(part, word))
    return F.when(_form_words(low), F.coalesce(_headed(low), F.when(~low.rlike(BOTH_HEADINGS), T.let(_value_part(low), first))))


def _form_words(low: Column) -> Column:
    """Every expression of ``declared_form`` needs one of these."""
    return _any_of(low, "3.1", *(cue for cues in FORM_CUES.values() for cue in cues if not cue.endswith("s")))


def _headed(low: Column) -> Column:
    """The form that a negated entry or a heading declares."""
    heading = F.when(F.regexp_extract(low, HEADING, 1) == "mixtures", "MIXTURE").otherwise("SUBSTANCE")
    return F.when(low.rlike(NEGATED_ENTRY), "MIXTURE").when(~low.rlike(BOTH_HEADINGS) & low.rlike(HEADING), heading)


def _form_by(part: Column, word: Column) -> Column:
    """The form of the first form word in a value part."""
    form = F.lit(None).cast("string")
    for name, cues in FORM_CUES.items():
        form = F.when(word.isin(*cues), name).otherwise(form)
    return F.when((word != "") & ~part.rlike(NEGATED_FORM), form)


def field_defined(field: Column, form: Column) -> Column:
    """Whether a product field exists for a form; an unknown form allows all."""
    limited = [name for name, _, _, forms in FIELDS if forms]
    return ~field.isin(*limited) | form.isNull() | form.isin("UNDETERMINED", "SUBSTANCE")


def typical_sections(field: Column) -> Column:
    """Sections where a product field is usually found; none for any other field."""
    table = F.create_map(*[x for name, at in SECTIONS.items() for x in (F.lit(name), F.array(*map(F.lit, at)))])
    return F.coalesce(F.try_element_at(table, field), F.array().cast("array<string>"))


def constituent_shares(c: Column) -> Column:
    """Array of (cas, share): the share behind a registry number up to the next, else the one before it."""
    return T.let(T.collapse(F.lower(c)), _shares_of)


def _shares_of(low: Column) -> Column:
    def read(low: Column) -> Column:
        numbers = F.regexp_extract_all(low, F.lit(f"({CAS_NUMBER})"), F.lit(1))
        gaps = F.split(low, CAS_NUMBER, -1)
        return F.struct(numbers.alias("numbers"), gaps.alias("gaps"))

    def share_in(gap: Column) -> Column:
        return T.let(gap, lambda g: T.let(V.share_form(_share_text(g)), V.share_of))

    def paired(x: Column) -> Column:
        return F.transform(x["numbers"], lambda n, i: F.struct(n.alias("cas"), F.coalesce(share_in(F.get(x["gaps"], i + 1)), share_in(F.get(x["gaps"], i))).alias("share")))

    share = "struct<low: double, high: double, low_inclusive: boolean, high_inclusive: boolean>"
    return F.when(low.rlike(CAS_NUMBER), T.let(read(low), paired)).otherwise(F.array().cast(f"array<struct<cas: string, share: {share}>>"))


def _share_text(gap: Column) -> Column:
    """A gap without EC numbers if it may state a share: that has a figure, which composition may make of a character beyond
    ASCII."""
    bare = F.when(F.contains(gap, F.lit("-")), F.regexp_replace(gap, EC_NUMBER, " ")).otherwise(gap)
    return F.when(gap.rlike(r"\d|[^\x00-\x7f]"), bare)


def whole_share(s: Column) -> Column:
    return F.coalesce((F.abs(s["low"] - 100.0) < 1e-6) & (F.abs(s["high"] - 100.0) < 1e-6), F.lit(False))


def partial_share(s: Column) -> Column:
    return F.coalesce((s["high"] < 100.0 - 1e-6) | ((F.abs(s["high"] - 100.0) < 1e-6) & ~s["high_inclusive"]), F.lit(False))


def _is_header(low: Column) -> Column:
    return F.coalesce(_any_of(low, "cas", "c.a.s") & low.rlike(COMPOSITION_HEADER), F.lit(False))


def _is_complete(low: Column) -> Column:
    return F.coalesce(_any_of(low, "no ", "contain", "100", "purity") & low.rlike(COMPLETENESS), F.lit(False))


def premise(c: Column) -> Column:
    """What one span gives an audit: its form, header and completeness flags, whole and partial registry numbers."""
    def split(shares: Column) -> Column:
        return F.struct(
            F.transform(F.filter(shares, lambda x: whole_share(x["share"])), lambda x: x["cas"]).alias("whole"),
            F.transform(F.filter(shares, lambda x: ~whole_share(x["share"]) & partial_share(x["share"])), lambda x: x["cas"]).alias("partial"),
        )

    def read(low: Column) -> Column:
        return F.struct(
            declared_form(low).alias("form"),
            _is_header(low).alias("header"),
            _is_complete(low).alias("complete"),
            T.let(_shares_of(low), split).alias("shares"),
        )

    return T.let(T.collapse(F.lower(c)), read)


def premise_rows(spans: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``premise`` of whole tables, in compiled steps: keys, ``form, header, complete, cas, whole, partial``, a row for each
    registry number of a span or one for a span without any. The span's own flags stand on its first row only."""
    low, part, gaps = F.col("_low"), F.col("_part"), F.col("_gaps")
    read = T.staged(
        spans.select(*keys, T.collapse(F.lower(F.col(text))).alias("_low")),
        {"_formed": F.when(_form_words(low), low)},
        {"_headed": _headed(F.col("_formed"))},
        {"_part": F.when(F.col("_headed").isNull() & ~F.col("_formed").rlike(BOTH_HEADINGS), _value_part(F.col("_formed")))},
        {"_word": F.regexp_extract(part, _FORM_WORD, 1)},
        {"form": F.coalesce(F.col("_headed"), _form_by(part, F.col("_word"))), "header": _is_header(low), "complete": _is_complete(low)},
        {"cas": F.regexp_extract_all(low, F.lit(f"({CAS_NUMBER})"), F.lit(1))},
        # No line ends are left in the text, so one can stand for a number; a plain split compiles no expression a row.
        {"_gaps": F.when(F.size("cas") > 0, F.split(F.regexp_replace(low, CAS_NUMBER, "\n"), "\n", -1))},
        {"_before": F.slice(gaps, F.lit(1), F.size("cas")), "_after": F.slice(gaps, F.lit(2), F.size("cas"))},
    )
    flags = ("form", "header", "complete")
    each = read.select(*keys, *flags, F.posexplode_outer(F.arrays_zip("cas", "_before", "_after")).alias("_i", "_n"))
    first = F.coalesce(F.col("_i") == 0, F.lit(True))
    each = each.select(*keys, *[F.when(first, F.col(c)).alias(c) for c in flags], "_n.cas", F.col("_n._before").alias("_before"), _share_text(F.col("_n._after")).alias("_after"))
    # The share behind a number counts, else the one before it, which is only then looked for.
    near = V.with_share(each, "_after", "_share").withColumn("_before", F.when(F.col("_share").isNull(), _share_text(F.col("_before"))))
    met = V.with_share(near, "_before", "_other").withColumn("_share", F.coalesce("_share", "_other"))
    share = F.col("_share")
    return met.select(*keys, *flags, "cas", whole_share(share).alias("whole"), (~whole_share(share) & partial_share(share)).alias("partial"))


def premise_roles(c: Column) -> Column:
    """Sorted array of the roles that one span fills."""
    found = lambda p: F.array(
        F.when(p["form"].isNotNull(), "form_declaration"),
        F.when(p["header"], "composition_header"),
        F.when(F.size(p["shares"]["whole"]) > 0, "sole_constituent"),
        F.when(F.size(p["shares"]["partial"]) > 0, "partial_constituent"),
        F.when(p["complete"], "completeness_statement"),
    )
    return F.array_sort(F.array_compact(T.let(premise(c), found)))
