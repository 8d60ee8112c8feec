"""Rule-based extraction over visual rows: labels, value slots, declared forms, ingredient rows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..functions import text as T
from .layout import composition_rows

# Labels by field, in the order in which they are tried.
LABELS = {
    "product_name": ("ghs product identifier", "product identifier", "product description", "identification of the substance", "product name", "material name", "trade name", "product"),
    "supplier_name": (
        "manufacturer/importer/supplier/distributor information", "details of the supplier of the safety data sheet", "details of the supplier of the data sheet",
        "uk entity/business name", "manufacturer's name", "supplier's details", "company name", "contact address", "manufactured by", "manufacturer", "distributor", "supplier", "company",
    ),
    "flash_point": ("closed-cup flash point", "flash point [method]", "flash point", "flashpoint", "flash pt"),
    "chemical_formula": ("chemical formula", "molecular formula", "formula"),
    "molecular_weight": ("average molecular weight", "molecular weight", "molecular mass", "molar mass"),
    "product_cas_number": ("cas registry number", "cas number", "c.a.s. no.", "cas no.", "cas no", "cas #", "cas#", "cas"),
}
# Form declarations in order, section headings, flash-point cues, address words, cell tokens.
FORM_DECLARATIONS = (
    ("defined by osha as an", "ARTICLE"), ("substance/mixture : substance", "SUBSTANCE"), ("substance/mixture: substance", "SUBSTANCE"), ("3.1. substances not applicable", "MIXTURE"),
    ("3.1 substances not applicable", "MIXTURE"), ("substance: non-applicable", "MIXTURE"), ("substances not applicable", "MIXTURE"), ("regulated as a mixture", "MIXTURE"),
    ("defined as a mixture", "MIXTURE"), ("mixture of substances", "MIXTURE"), ("chemical description: mixture", "MIXTURE"), ("substance or preparation: preparation", "MIXTURE"),
    ("mixture identification", "MIXTURE"), ("3.1 n/a", "MIXTURE"), ("3.2 mixtures", "MIXTURE"), ("3.2. mixtures", "MIXTURE"),
)
HEADING_DECLARATIONS = (("3.1. substances", "SUBSTANCE"), ("3.1 substances", "SUBSTANCE"))
FLASH_CUES = ("does not sustain combustion", "does not flash", "non-combustible", "noncombustible", "not combustible")
ADDRESS = r"(?i)^(apartado|address|tel|tel\.|telephone|phone|fax|e-?mail|www|http|street|str\.|\d{1,5}$)"
SHARE_TOKEN = (
    r"(?i)^(?:<=|>=|[<>≤≥~≈])?\d+(?:[.,]\d+)?%?$|^\d+(?:[.,]\d+)?%?\s*[-–~]\s*<?\d+(?:[.,]\d+)?%?$|^%$|^(?:[-–—~]|to)$|^(?:<=|>=|[<>≤≥≈~])$"
    r"|^(?:nmt|nlt|max\.?|min\.?|approx\.?|ca\.?)$"
)
EC_TOKEN = r"^\d{3}-\d{3}-\d$"
LABEL_TOKEN = r"(?i)^(?:cas|cas[:#]|cas-?no\.?:?|c\.a\.s\.?|no\.?:?|number:?|nr\.?:?|ec|ec-?no\.?:?|einecs|index|reach|reg\.?|registration:?|#|:|\||-)$"
MAX_COMPANY_TOKENS, MAX_LINEAR_TOKENS = 8, 12


def slot_pattern(labels: Iterable[str]) -> str:
    """What a row's text opens with, lower-cased, where it holds one of the labels."""
    return rf"^(?:[·•*\-]|\d+(?:\.\d+)*\.?)?\s*({'|'.join(map(re.escape, labels))})\s*(?:[:=]\s*|$)"


def label_slot(row: Column, labels: tuple[str, ...]) -> Column:
    """Struct (label, value) of the first label in order that opens the row's text, ahead of a colon, ``=`` or the end."""
    pattern = slot_pattern(labels)

    def read(bare: Column) -> Column:
        slot = lambda label: F.when(label != "", F.struct(label.alias("label"), F.regexp_replace(bare, f"(?i){pattern}", "").alias("value")))
        return T.let(F.regexp_extract(F.lower(bare), pattern, 1), slot)

    return T.let(T.collapse(row), read)


def candidates(rows: DataFrame, field: str, document: str = "document") -> DataFrame:
    """Label candidates of a field: ``document, page, row_no, label, value``; an empty slot takes the next row unless
    that holds a label itself. ``rows`` has ``document, page, row_no, text``."""
    labels = LABELS[field]
    place = Window.partitionBy(document, "page").orderBy("row_no")
    met = rows.withColumn("slot", label_slot(F.col("text"), labels)).withColumn("after", F.lead("text").over(place)).withColumn("after_slot", F.lead(label_slot(F.col("text"), labels)).over(place))
    value = F.when(F.col("slot.value") != "", F.col("slot.value")).when(F.col("after_slot").isNull(), T.collapse(F.col("after")))
    return met.where("slot is not null").select(document, "page", "row_no", F.col("slot.label").alias("label"), F.coalesce(value, F.lit("")).alias("value"))


def parse_free_text(raw: Column) -> Column:
    return F.nullif(F.trim(raw, F.lit(" :;,.")), F.lit(""))


def parse_company(raw: Column) -> Column:
    """Up to the first address word (if anything stands before it) and at most eight tokens."""
    words = F.split(T.collapse(raw), " ")
    stops = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(ADDRESS) & (i > 0), i)), lambda i: i.isNotNull())
    n = F.least(F.coalesce(F.array_min(stops), F.size(words)), F.lit(MAX_COMPANY_TOKENS))
    return parse_free_text(F.array_join(F.slice(words, 1, n), " "))


def parse_formula(raw: Column) -> Column:
    c = F.trim(raw, F.lit(" :;,."))
    bare = F.replace(c, F.lit(" "), F.lit(""))
    shaped = c.rlike(r"^[A-Za-z0-9\[\]\(\)\.·\*\s₀-₉]+$") & c.rlike("[A-Z]") & (F.length(c) <= 40)
    return F.when(shaped & (c.rlike(r"\d") | (F.length(bare) <= 3)), c)


def parse_numeric(raw: Column, punctuation: str = " :;,.") -> Column:
    c = F.trim(raw, F.lit(punctuation))
    return F.when(c.rlike(r"\d"), c)


def parse_cas(raw: Column) -> Column:
    """The first token that has a registry number's shape."""
    return F.get(F.filter(F.transform(F.split(T.collapse(raw), " "), lambda t: T.cas_word(t)), lambda t: t.rlike(T.CAS)), F.lit(0))


PARSERS = {
    "product_name": parse_free_text,
    "supplier_name": parse_company,
    "flash_point": lambda raw: parse_numeric(raw, " :;,"),
    "chemical_formula": parse_formula,
    "molecular_weight": parse_numeric,
    "product_cas_number": parse_cas,
}


def first_usable(found: DataFrame, field: str, document: str = "document") -> DataFrame:
    """The first candidate in (page, row) order that gives a state or a value: ``document, state, value, page, row_no``."""
    state = Q.state_cue(F.col("value"))
    if field == "flash_point":
        state = F.when(T.search_form(F.col("value")).rlike("|".join(FLASH_CUES)), "NOT_APPLICABLE").otherwise(state)
    parsed = PARSERS[field](F.col("value"))
    read = found.where("value <> ''").withColumn("state", F.coalesce(state, F.when(parsed.isNotNull(), "PRESENT"))).withColumn("parsed", F.when(F.col("state") == "PRESENT", parsed))
    best = read.where("state is not null").groupBy(document).agg(F.min(F.struct("page", "row_no", "state", "parsed")).alias("b"))
    return best.select(document, F.col("b.state").alias("state"), F.col("b.parsed").alias("value"), F.col("b.page").alias("page"), F.col("b.row_no").alias("row_no"))


def declared_form(rows: DataFrame, document: str = "document", phrases: tuple[tuple[str, str], ...] = FORM_DECLARATIONS) -> DataFrame:
    """Per document the first (phrase, page, row) whose text holds the phrase and is read as its form."""
    return declared_forms(rows, document, {"b": phrases}).select(document, "b.form", "b.page", "b.row_no", "b.text")


def declared_forms(rows: DataFrame, document: str, tables: dict[str, tuple[tuple[str, str], ...]]) -> DataFrame:
    """``declared_form`` by several tables of phrases at once: per document a struct (phrase, page, row_no, form, text) by the name
    of each table, null where none of its phrases is met. A row's text is folded once, and read where it holds a phrase."""

    def hits(low: Column) -> Column:
        held = reduce(Column.__or__, [F.contains(low, F.lit(p)) for phrases in tables.values() for p, _ in phrases])
        return F.when(held, T.let(Q.form_cue(F.col("text")), lambda form: F.struct(*[hit(low, form, phrases).alias(name) for name, phrases in tables.items()])))

    def hit(low: Column, form: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
        met = [F.when(F.contains(low, F.lit(p)) & (form == f), F.struct(F.lit(i).alias("phrase"), F.lit(f).alias("form"))) for i, (p, f) in enumerate(phrases)]
        return F.array_min(F.array_compact(F.array(*met)))

    # No filter ahead of the aggregate: it would move in front of the shuffle, to as few tasks as the file has splits.
    found = rows.withColumn("hit", T.let(T.search_form(F.col("text")), hits))
    first = lambda h: F.min(F.when(h.isNotNull(), F.struct(h["phrase"].alias("phrase"), "page", "row_no", h["form"].alias("form"), "text")))
    best = found.groupBy(document).agg(*[first(F.col(f"hit.{name}")).alias(name) for name in tables])
    return best.where(reduce(Column.__or__, [F.col(name).isNotNull() for name in tables]))


def share_run(words: Column) -> Column:
    """Struct (start, end) of the run of share tokens with most figures; of equals the last. Null without a figure."""
    start = F.struct(F.lit(-1).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("best_n"), F.lit(-1).alias("best_s"), F.lit(-1).alias("best_e"), F.lit(0).alias("i"))

    # Each word is matched once: null outside of a share, else its figures, none or one.
    figures = F.transform(words, lambda w: F.when(w.rlike(SHARE_TOKEN), w.rlike(r"\d").cast("int")))

    def step(a: Column, w: Column) -> Column:
        inside = w.isNotNull()
        s = F.when(inside, F.when(a["s"] >= 0, a["s"]).otherwise(a["i"])).otherwise(F.lit(-1))
        n = F.when(inside, F.when(a["s"] >= 0, a["n"]).otherwise(F.lit(0)) + w).otherwise(F.lit(0))
        better = inside & (n > 0) & (n >= a["best_n"])
        return F.struct(
            s.alias("s"), n.alias("n"), F.when(better, n).otherwise(a["best_n"]).alias("best_n"), F.when(better, s).otherwise(a["best_s"]).alias("best_s"),
            F.when(better, a["i"] + 1).otherwise(a["best_e"]).alias("best_e"), (a["i"] + 1).alias("i"),
        )

    run = lambda best: F.when(best["best_n"] > 0, F.struct(best["best_s"].alias("start"), best["best_e"].alias("end")))
    return T.let(F.aggregate(figures, start, step), run)


def ingredient_rows(rows: DataFrame, document: str = "document") -> DataFrame:
    """One item per registry number of section 3, its first row: ``document, cas, name, concentration, page, row_no, at, text``."""
    inside = composition_rows(rows, document).withColumn("words", F.split(T.collapse(F.col("text")), " "))
    # Only a word with a dash, or beyond ASCII, can be read as a number of a registry; only first items are searched for shares.
    dashed = lambda w: F.contains(w, F.lit("-")) | T.beyond_ascii(w)
    worded = inside.select("*", F.posexplode("words").alias("at", "word")).where(dashed(F.col("word")))
    numbered = worded.withColumn("cas", T.cas_word(F.col("word"))).where(F.col("cas").rlike(T.CAS))
    first = numbered.withColumn("n", F.row_number().over(Window.partitionBy(document, "cas").orderBy("page", "row_no", "at"))).where("n = 1")
    first = first.withColumn("run", share_run(F.col("words")))
    kept = F.filter(
        F.transform("words", lambda w, i: F.when((i != F.col("at")) & ~F.coalesce((i >= F.col("run.start")) & (i < F.col("run.end")), F.lit(False)) & ~(dashed(w) & T.cas_word(w).rlike(EC_TOKEN)) & ~w.rlike(LABEL_TOKEN), w)),
        lambda w: w.isNotNull(),
    )
    share = F.when(F.col("run").isNotNull(), F.array_join(F.slice("words", F.col("run.start") + 1, F.col("run.end") - F.col("run.start")), " "))
    return first.select(document, "cas", F.nullif(F.trim(F.array_join(kept, " "), F.lit(" :;,|-")), F.lit("")).alias("name"), share.alias("concentration"), "page", "row_no", "at", "text")
