"""Text functions as Spark columns: folding, names, formulas, registry numbers, tokens and span overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lookalike characters of the search form.
FOLD_FROM = "º–—−‘’“” "
FOLD_TO = "°---''\"\" "
DROPPED = "™®"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl"}
# Subscript digits, trade marks, company suffixes, token punctuation.
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
MARKS = "™®©"
SUFFIXES = ("inc", "ltd", "co", "corp", "llc", "gmbh", "sa", "bv", "plc", "kg", "pty")
TOKEN_PUNCTUATION = ".,:;()[]{}\"'"

#: White space as the contract counts it: Unicode white space and the four separators U+001C to U+001F.
#: Single characters make one table, and one range keeps most others from the tests inside it.
SPACE = r"[\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"


def nfkc(c: Column) -> Column:
    """Compatibility composition by the ICU library that Spark ships, on the JVM; ASCII texts pass untouched."""

    return let(c, composed)


def composed(x: Column) -> Column:
    """``nfkc`` of a column that is computed already."""
    return F.when(beyond_ascii(x), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(True))).otherwise(x)


def beyond_ascii(c: Column) -> Column:
    """Characters and bytes differ in number; no regular expression is needed for it."""
    return F.length(c) != F.octet_length(c)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambdas have no common-subexpression elimination."""
    return F.transform(F.array(value), body)[0]


def staged(rows: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Rows with the columns of each step in turn. Where whole tables are read this stands for ``let``: a step's columns are
    computed once, and compiled, while bodies of lambdas are interpreted node by node."""
    return reduce(lambda out, step: out.withColumns(step), steps, rows)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    """Search folding: lookalikes to one form, marks dropped, ligatures spelled out. All of them lie beyond ASCII."""
    out = F.translate(c, FOLD_FROM + DROPPED, FOLD_TO)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(beyond_ascii(c), out).otherwise(c)


def search_form(c: Column, casefold: bool = True) -> Column:
    """Folded, lower-cased text with single spaces and none at its ends."""
    out = fold(c)
    return collapse(F.lower(out) if casefold else out)


def normalize_text(c: Column, compat: bool = True) -> Column:
    """Lower-cased text without trade marks, in compatibility composition."""
    out = F.replace(c, F.lit("º"), F.lit("°"))
    out = nfkc(out) if compat else out
    return F.lower(collapse(F.translate(out, MARKS, "")))


def normalize_name(c: Column, compat: bool = True) -> Column:
    out = F.trim(normalize_text(c, compat), F.lit(" .,:;-–—"))
    return collapse(F.regexp_replace(out, rf"\b({'|'.join(SUFFIXES)})\.", "$1"))


def name_key(c: Column, compat: bool = True) -> Column:
    """Key of name equality: a break ``x- y`` inside a word is closed; null for a missing or empty name."""
    key = F.regexp_replace(normalize_name(c, compat), r"(?<=[a-z])- (?=[a-z])", "")
    return F.when(c.isNotNull() & (c != ""), key)


def names_equal(a: Column, b: Column, compat: bool = True) -> Column:
    return F.coalesce(name_key(a, compat) == name_key(b, compat), F.lit(False))


def normalize_formula(c: Column, compat: bool = True) -> Column:
    out = F.translate(nfkc(c) if compat else c, SUBSCRIPTS + "·•", "0123456789**")
    return F.regexp_replace(out, SPACE, "")


def normalize_cas(c: Column, compat: bool = True) -> Column:
    out = F.regexp_replace(nfkc(c) if compat else c, SPACE, "")
    return F.trim(F.translate(out, "–—−", "---"), F.lit(" .,:;"))


def cas_word(word: Column) -> Column:
    """``normalize_cas`` of a word without white space; plain ASCII words need no composition."""
    return F.when(beyond_ascii(word), normalize_cas(word)).otherwise(F.trim(word, F.lit(" .,:;")))


CAS = r"^(\d{2,7})-(\d{2})-(\d)$"


def cas_valid(c: Column) -> Column:
    """Check digit: the digits before it, from the right, times their places, modulo 10."""
    cas = normalize_cas(c)
    digits = F.split(F.reverse(F.concat(F.regexp_extract(cas, CAS, 1), F.regexp_extract(cas, CAS, 2))), "")
    total = F.aggregate(F.transform(digits, lambda d, i: d.cast("int") * (i + 1)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.when(cas.rlike(CAS), total % 10 == F.regexp_extract(cas, CAS, 3).cast("int")).otherwise(F.lit(False)), F.lit(False))


def span_tokens(c: Column, compat: bool = True) -> Column:
    """Lower-cased tokens without the punctuation at their ends; empty ones dropped."""
    out = F.replace(c, F.lit("º"), F.lit("°"))
    out = F.lower(collapse(F.translate(nfkc(out) if compat else out, "–—", "--")))
    return F.filter(F.transform(F.split(out, " "), lambda t: F.trim(t, F.lit(TOKEN_PUNCTUATION))), lambda t: t != "")


def longest_common_run(gold: Column, other: Column) -> Column:
    """Longest run of tokens (without spaces) that both arrays hold side by side.

    The best length grows by one at a time: at each token of ``gold`` only the run one longer than the best that ends there is
    looked for in the other tokens' text."""

    def grow(text: Column) -> Column:
        def step(best: Column, at: Column) -> Column:
            run = F.concat(F.lit(" "), F.array_join(F.slice(gold, F.greatest(at - best, F.lit(1)), best + 1), " "), F.lit(" "))
            return best + F.when((at > best) & F.contains(text, run), 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.size(gold)), F.lit(0), step)

    return F.when(F.size(gold) > 0, let(F.concat(F.lit(" "), F.array_join(other, " "), F.lit(" ")), grow)).otherwise(F.lit(0))


def span_overlap(predicted: Column, gold: Column) -> Column:
    """Struct of matched, gold_tokens, predicted_tokens, coverage, dilution and iou of two texts' tokens."""
    zero = F.lit(0.0)

    def measures(x: Column) -> Column:
        ng, np_, m = x["ng"], x["np"], x["m"]
        some = (ng > 0) & (np_ > 0)
        return F.struct(
            F.when(some, m).otherwise(F.lit(0)).alias("matched"),
            ng.alias("gold_tokens"),
            np_.alias("predicted_tokens"),
            F.when(some, m / ng).otherwise(zero).alias("coverage"),
            F.when(some, np_ / ng).otherwise(zero).alias("dilution"),
            F.when(some, m / (ng + np_ - m)).otherwise(zero).alias("iou"),
        )

    both = F.struct(span_tokens(gold).alias("g"), span_tokens(predicted).alias("p"))
    counted = let(both, lambda t: F.struct(F.size(t["g"]).alias("ng"), F.size(t["p"]).alias("np"), longest_common_run(t["g"], t["p"]).alias("m")))
    return let(counted, measures)


def token_count(c: Column) -> Column:
    """White-space tokens; none in a blank text."""
    bare = collapse(c)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))
