"""Typed values as Spark columns: temperatures, quantities, concentration intervals, equality and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# A number, and comparator words in the order in which they are tried.
NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
COMPARATORS = (
    (r">=|≥|at\s+least|not\s+less\s+than|nlt", ">="),
    (r"<=|≤|not\s+more\s+than|nmt|at\s+most", "<="),
    (r">|greater\s+than|more\s+than|above|over|higher\s+than", ">"),
    (r"<|less\s+than|below|under|lower\s+than", "<"),
)
MOLAR = r"g\s*/\s*mol(?:e)?"
# Words that a share may carry, a range, a single share.
NOISE = r"%|w/w|v/v|(?<![a-z])wt\.?(?![a-z])|weight|percent|by\s+wt"
RANGE = rf"({NUMBER})\s*(?:-|~|to|\.\.)\s*(<=|<|≤)?\s*({NUMBER})"
SINGLE = rf"(<=|>=|≤|≥|<|>|~|≈|nmt|nlt|not\s+more\s+than|not\s+less\s+than|at\s+most|at\s+least|max(?:imum)?\.?|min(?:imum)?\.?|approx\.?|about|ca\.?)?\s*({NUMBER})"


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).cast("double")


def comparator(prefix: Column) -> Column:
    return T.let(prefix, _comparator)


def _comparator(p: Column) -> Column:
    out = F.when(p == "", "=")
    for pattern, symbol in COMPARATORS:
        out = out.when(p.rlike(pattern), symbol)
    return out.otherwise("=")


def _first(low: Column, pattern: str, unit: str, read, other: Column | None = None) -> Column:
    """The first figure of a text by a pattern of (what stands before, figure), each taken once; without one ``other``."""

    def quantity(figure: Column) -> Column:
        out = F.when(figure != "", F.struct(read(number(figure)).alias("value"), F.lit(unit).alias("unit"), comparator(F.regexp_extract(low, pattern, 1)).alias("comparator")))
        return out if other is None else out.otherwise(other)

    return T.let(F.regexp_extract(low, pattern, 2), quantity)


def _fahrenheit(n: Column) -> Column:
    return (n - 32.0) * 5.0 / 9.0


def _temperature_figure(unit: str) -> str:
    return rf"({NUMBER})\s*°?\s*{unit}\b"


def with_quantity(rows: DataFrame, kind: str, read: dict[str, str]) -> DataFrame:
    """Rows with ``parse_temperature`` or ``parse_quantity`` of columns of texts, each under its new name, in compiled steps."""
    mark = F.lit("º"), F.lit("°")
    c, steps = (lambda part, out: F.col(f"_{part}_{out}")), [{}, {}, {}, {}, {}, {}]
    for out, text in read.items():
        low, found, other, before = c("low", out), c("found", out), c("other", out), c("before", out)
        raw, size = F.col(text), lambda figure: F.length(figure) > 0
        steps[0][f"_low_{out}"] = F.replace(raw, *mark) if kind == "temperature" else raw
        steps[1][f"_low_{out}"] = T.composed(low)
        steps[2][f"_low_{out}"] = F.lower(low)
        # A figure is found as the first place of its pattern; only what stands before it needs the whole text.
        ahead = lambda figure: rf"(?s)^(.*?){figure}"
        if kind == "temperature":
            in_c, in_f = map(_temperature_figure, "cf")
            steps[3][f"_found_{out}"] = F.regexp_extract(low, in_c, 1)
            steps[4][f"_other_{out}"] = F.when(found == "", F.regexp_extract(low, in_f, 1))
            steps[5][f"_before_{out}"] = F.when(size(found), F.regexp_extract(low, ahead(in_c), 1)).when(size(other), F.regexp_extract(low, ahead(in_f), 1))
        else:
            plain = f"({NUMBER})"
            steps[3][f"_found_{out}"] = F.regexp_extract(low, plain, 1)
            steps[4][f"_other_{out}"] = F.lit(None).cast("string")
            steps[5][f"_before_{out}"] = F.when(size(found), F.regexp_extract(low, ahead(plain), 1))
    last = {}
    for out in read:
        found, other, before = c("found", out), c("other", out), c("before", out)
        value = F.when(F.length(found) > 0, number(found)).otherwise(_fahrenheit(number(other)))
        unit = "C" if kind == "temperature" else "g/mol"
        last[out] = F.when(before.isNotNull(), F.struct(value.alias("value"), F.lit(unit).alias("unit"), _comparator(before).alias("comparator")))
    return T.staged(rows, *steps, last).drop(*[f"_{part}_{out}" for out in read for part in ("low", "found", "other", "before")])


def parse_temperature(c: Column, compat: bool = True) -> Column:
    """Struct value (Celsius), unit, comparator; the first Celsius figure wins over Fahrenheit; null without a unit."""
    low = F.replace(c, F.lit("º"), F.lit("°"))
    low = F.lower(T.nfkc(low) if compat else low)

    def pattern(unit: str) -> str:
        return rf"(?s)^(.*?)({NUMBER})\s*°?\s*{unit}\b"

    def read(low: Column) -> Column:
        in_f = _first(low, pattern("f"), "C", _fahrenheit)
        return _first(low, pattern("c"), "C", lambda n: n, in_f)

    return T.let(low, read)


def parse_quantity(c: Column, unit: str = MOLAR, compat: bool = True) -> Column:
    low = F.lower(T.nfkc(c) if compat else c)
    pattern = rf"(?s)^(.*?)({NUMBER})\s*(?:{unit})?"
    return T.let(low, lambda low: _first(low, pattern, "g/mol", lambda n: n))


def close(a: Column, b: Column, tolerance: float | Column) -> Column:
    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), limit)


def quantities_match(a: Column, b: Column, tolerance: float | Column) -> Column:
    return F.coalesce((a["comparator"] == b["comparator"]) & close(a["value"], b["value"], tolerance), F.lit(False))


def parse_concentration(c: Column, compat: bool = True) -> Column:
    """Struct low, high, low_inclusive, high_inclusive in percent; a null bound is none; null when nothing is read."""
    return T.let(c, lambda c: F.when(c.isNotNull() & (c != ""), T.let(share_form(c, compat), share_of)))


def share_form(c: Column, compat: bool = True) -> Column:
    return _bare_share(T.nfkc(c) if compat else c)


def _bare_share(c: Column) -> Column:
    low = F.translate(F.lower(c), "–—−", "---")
    return T.collapse(F.regexp_replace(low, f"(?i){NOISE}", " "))


# Marks before a single share, with the bound that they set and whether it is part of the interval.
MARKS = (
    (r"<=|≤|nmt|at most|not more.*|max.*", "high", True),
    (r"<", "high", False),
    (r">=|≥|nlt|at least|not less.*|min.*", "low", True),
    (r">", "low", False),
)


def share_of(low: Column) -> Column:
    """The interval that a text in share form states."""

    def single(found: Column) -> Column:
        both = F.struct(_mark(found).alias("mark"), _figure(found).alias("value"))
        return T.let(both, lambda x: _marked(x["mark"], x["value"]))

    # Only the stretch that matched is taken apart, and only once; a match has a figure, so it is not empty.
    one = T.let(F.regexp_extract(low, SINGLE, 0), lambda found: F.when(found != "", single(found)))
    return T.let(F.regexp_extract(low, RANGE, 0), lambda found: F.when(found != "", _ranged(found)).otherwise(one))


def _ranged(found: Column) -> Column:
    part = lambda i: F.regexp_extract(found, RANGE, i)
    return _interval(number(part(1)), number(part(3)), F.lit(True), part(2) != "<")


def _mark(found: Column) -> Column:
    return F.trim(F.regexp_extract(found, SINGLE, 1))


def _figure(found: Column) -> Column:
    return number(F.regexp_extract(found, SINGLE, 2))


def _marked(mark: Column, value: Column) -> Column:
    none, plain = F.lit(None).cast("double"), _interval(value, value, F.lit(True), F.lit(True))
    out = F.when(mark == "", plain)
    for pattern, bound, inclusive in MARKS:
        high = bound == "high"
        set_ = _interval(none if high else value, value if high else none, F.lit(high or inclusive), F.lit(inclusive or not high))
        out = out.when(mark.rlike(f"^(?:{pattern})$"), set_)
    return out.otherwise(plain)


def with_share(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Rows with the interval that a column of texts states (``share_of`` its ``share_form``), in compiled steps."""
    c = lambda name: F.col(f"_{name}")
    found = T.staged(
        rows,
        {"_form": T.composed(F.col(text))},
        {"_form": _bare_share(c("form"))},
        {"_range": F.regexp_extract(c("form"), RANGE, 0)},
        {"_single": F.when(c("range") == "", F.regexp_extract(c("form"), SINGLE, 0))},
        {"_mark": _mark(c("single")), "_figure": F.when(c("single") != "", _figure(c("single")))},
        {out: F.when(c("range") != "", _ranged(c("range"))).when(c("single") != "", _marked(c("mark"), c("figure")))},
    )
    return found.drop("_form", "_range", "_single", "_mark", "_figure")


def _interval(a: Column, b: Column, a_in: Column, b_in: Column) -> Column:
    return F.struct(a.alias("low"), b.alias("high"), a_in.alias("low_inclusive"), b_in.alias("high_inclusive"))


def _bound(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close(a, b, 1e-6))


def _of_both(a: Column, b: Column, read) -> Column:
    """``read`` of two columns that are computed once."""
    return T.let(F.struct(a.alias("a"), b.alias("b")), lambda x: read(x["a"], x["b"]))


def concentrations_equal(a: Column, b: Column) -> Column:
    def compared(a: Column, b: Column) -> Column:
        def intervals(x: Column, y: Column) -> Column:
            same = _bound(x["low"], y["low"]) & _bound(x["high"], y["high"]) & (x["low_inclusive"] == y["low_inclusive"]) & (x["high_inclusive"] == y["high_inclusive"])
            return F.when(x.isNull() & y.isNull(), T.normalize_text(a) == T.normalize_text(b)).when(x.isNull() | y.isNull(), False).otherwise(same)

        no_a, no_b = a.isNull() | (a == ""), b.isNull() | (b == "")
        return F.when(no_a & no_b, True).when(no_a | no_b, False).otherwise(_of_both(parse_concentration(a), parse_concentration(b), intervals))

    return _of_both(a, b, compared)


def six_digits(value: Column) -> Column:
    """A number to six significant digits, no zeros at the end, with an exponent below -4 and from 6 on; a value whose shortest
    form lies halfway between two rounds up."""

    def parts(e: Column) -> Column:
        return T.let(F.struct(e.alias("e"), _power(e).alias("power"), _digits(e).alias("digits")), lambda x: _shown(x["e"], x["power"], x["digits"]))

    return F.when(value.isNotNull(), T.let(F.format_string("%.5e", value), parts))


def _power(e: Column) -> Column:
    return F.substring_index(e, "e", -1).cast("int")


def _digits(e: Column) -> Column:
    return F.translate(F.substring_index(e, "e", 1), "-.", "")


def _shown(e: Column, power: Column, digits: Column) -> Column:
    trim = lambda c: F.rtrim(F.rtrim(c, F.lit("0")), F.lit("."))  # each holds a point
    long = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))
    far = F.concat(trim(long), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    whole = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    sign = F.when(F.startswith(e, F.lit("-")) & (digits != "000000"), "-").otherwise("")
    return F.concat(sign, F.when(digits == "000000", "0").when((power < -4) | (power >= 6), far).when(power < 0, trim(small)).when(power == 5, digits).otherwise(trim(whole)))


def with_canonical(rows: DataFrame, kind: str, read: dict[str, str]) -> DataFrame:
    """Rows with ``canonical_value`` of columns of texts that state temperatures or quantities, each under its new name, in
    compiled steps."""
    c, steps = (lambda part, out: F.col(f"_{part}_{out}")), [{}, {}, {}]
    parsed = with_quantity(rows, kind, {f"_q_{out}": text for out, text in read.items()})
    for out, text in read.items():
        q, e = c("q", out), c("e", out)
        steps[0][f"_e_{out}"] = F.when(q["value"].isNotNull(), F.format_string("%.5e", q["value"]))
        steps[1] |= {f"_power_{out}": _power(e), f"_digits_{out}": _digits(e)}
        shown = F.concat(F.when(q["comparator"] == "=", "").otherwise(q["comparator"]), _shown(e, c("power", out), c("digits", out)), F.lit(" "), q["unit"])
        steps[2][out] = F.coalesce(shown, T.normalize_text(F.col(text)))
    return T.staged(parsed, *steps).drop(*[f"_{part}_{out}" for out in read for part in ("q", "e", "power", "digits")])


def canonical_value(c: Column, kind: str) -> Column:
    """Canonical string of a value of one kind: name, identifier, formula, categorical, temperature or quantity."""
    if kind == "formula":
        return T.normalize_formula(c)
    if kind == "identifier":
        return T.normalize_cas(c)
    if kind == "categorical":
        return F.replace(F.upper(T.normalize_text(c)), F.lit(" "), F.lit("_"))
    if kind in ("temperature", "quantity"):
        parse = parse_temperature if kind == "temperature" else parse_quantity
        shown = lambda q: F.concat(F.when(q["comparator"] == "=", "").otherwise(q["comparator"]), six_digits(q["value"]), F.lit(" "), q["unit"])
        return T.let(c, lambda c: F.coalesce(T.let(parse(c), shown), T.normalize_text(c)))
    return T.normalize_name(c)


def values_equal(a: Column, b: Column, kind: str, tolerance: float = 0.0) -> Column:
    if kind in ("temperature", "quantity"):
        parse = parse_temperature if kind == "temperature" else parse_quantity
        told = lambda a, b: lambda x, y: F.when(x.isNotNull() & y.isNotNull(), quantities_match(x, y, tolerance)).when(x.isNull() & y.isNull(), T.normalize_text(a) == T.normalize_text(b)).otherwise(False)
        return _of_both(a, b, lambda a, b: _of_both(parse(a), parse(b), told(a, b)))
    return canonical_value(a, kind) == canonical_value(b, kind)


def with_equality(rows: DataFrame, kind: str, a: str, b: str, out: str, tolerance: float = 0.0) -> DataFrame:
    """Rows with ``values_equal`` of two columns of texts that state temperatures or quantities, in compiled steps."""
    x, y = F.col("_a"), F.col("_b")
    same = F.when(x.isNotNull() & y.isNotNull(), quantities_match(x, y, tolerance)).when(x.isNull() & y.isNull(), T.normalize_text(F.col(a)) == T.normalize_text(F.col(b))).otherwise(False)
    return with_quantity(rows, kind, {"_a": a, "_b": b}).withColumn(out, same).drop("_a", "_b")


def value_supported_by(value: Column, span: Column, kind: str) -> Column:
    """Whether the span holds the value: numbers by the span's first figure, else by the normalised text."""
    return _of_both(value, span, lambda value, span: _supported(value, span, kind))


# How far a span's figure may lie from a value of a kind, and the forms in which other kinds are compared.
_FIGURES = {"temperature": (parse_temperature, 0.6), "quantity": (parse_quantity, 0.05)}
_TEXT_FORMS = {"formula": T.normalize_formula, "identifier": T.normalize_cas}


def _supported(value: Column, span: Column, kind: str) -> Column:
    some = F.coalesce((value != "") & (span != ""), F.lit(False))
    if kind in ("temperature", "quantity"):
        parse, limit = _FIGURES[kind]
        told = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), quantities_match(y, x, limit)).otherwise(F.contains(T.normalize_text(span), T.normalize_text(value)))
        held = _of_both(parse(value), parse(span), told)
    else:
        form = _TEXT_FORMS.get(kind, T.normalize_name)
        held = F.contains(form(span), form(value))
    return F.when(some, held).otherwise(False)


def support_form(span: Column, kind: str) -> Column:
    """What ``supported_in`` reads of a span, once for all values; null for a missing or empty one."""
    if kind in ("temperature", "quantity"):
        form = F.struct(_FIGURES[kind][0](span).alias("figure"), T.normalize_text(span).alias("text"))
    else:
        form = F.struct(_TEXT_FORMS.get(kind, T.normalize_name)(span).alias("text"))
    return F.when(span != "", form)


def supported_in(value: Column, form: Column, kind: str) -> Column:
    """``value_supported_by`` of a span in ``support_form``."""
    if kind in ("temperature", "quantity"):
        parse, limit = _FIGURES[kind]
        told = lambda q: F.when(q.isNotNull() & form["figure"].isNotNull(), quantities_match(form["figure"], q, limit)).otherwise(F.contains(form["text"], T.normalize_text(value)))
        held = T.let(parse(value), told)
    else:
        held = F.contains(form["text"], _TEXT_FORMS.get(kind, T.normalize_name)(value))
    return F.when(F.coalesce(value != "", F.lit(False)) & form.isNotNull(), held).otherwise(False)
