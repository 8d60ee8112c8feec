"""Figures that must not grow faster than the input: expressions evaluated once, words that stay in their page's row."""

import re

from pyspark.sql import functions as F

from factloom.functions import cues as Q
from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import alignment as A
from factloom.operators import extract as X
from factloom.operators import layout as L
from factloom.operators import ranges as R
from factloom.operators import search
from factloom.plans import derivation as D
from factloom.plans import probes as B


def _times(df, needle):
    return df._jdf.queryExecution().analyzed().toString().count(needle)


def test_concentrations_are_parsed_once_a_side(spark):
    """Before, each bound of either side stated the whole parse again."""
    df = spark.createDataFrame([("5 - 10 %", "5~10", True), ("NMT 5", "≤ 5 ％", True), ("< 5", "≤ 5", False), (None, "", True), ("", "5", False), ("n/a", "N/A", True), ("5", "n/a", False)], "a string, b string, same boolean")
    out = df.select("same", V.concentrations_equal(F.col("a"), F.col("b")).alias("found"))
    assert _times(out, "w/w|v/v") <= 2
    assert all(r.same == r.found for r in out.collect())


def test_canonical_values_are_parsed_once(spark):
    """Before, every part of the canonical form stated the pattern of the figure again."""
    df = spark.createDataFrame([("at least 12,50 ℃", ">=12.5 C"), ("212 °F", "100 C"), ("none °", "none °"), (None, None), ("below 1234567 ºc", "<1.23457e+06 C"), ("0.00001234 C", "1.234e-05 C")], "a string, shown string")
    out = df.select("shown", V.canonical_value(F.col("a"), "temperature").alias("found"))
    assert _times(out, "format_string") == 1 and _times(out, "compose") <= 2
    assert all(r.shown == r.found for r in out.collect())


def test_quantities_are_parsed_once_a_side(spark):
    """Before, comparators and values each stated the pattern of the figure again."""
    df = spark.createDataFrame([("18,0 g/mol", "18.04 G / Mole", True), ("above 18", "18", False), ("none", "None", True), ("none", "18", False), (None, "18", False)], "a string, b string, same boolean")
    out = df.select("same", V.values_equal(F.col("a"), F.col("b"), "quantity", 0.05).alias("found"))
    assert _times(out, "regexp_extract") <= 4
    assert all(r.same == r.found for r in out.collect())


def test_words_of_two_layers_stay_in_their_rows(spark):
    """Before, every word was a row of its own in several shuffles, which filled the disk."""
    words = lambda text: [(m.start(), m.end(), m.group(), (0.1 * m.start(), 0.1, 0.1 * m.end(), 0.2)) for m in re.finditer(r"\S+", text)]
    here, there = "one two three four five six seven", "one two thr#e four five  six seven"
    word = "array<struct<start: int, end: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
    native = spark.createDataFrame([("d", 1, here, words(here))], f"document string, page int, text string, words {word}")
    other = spark.createDataFrame([("d", 1, there, words(there))], f"document string, page int, text string, words {word}")
    spans = spark.createDataFrame([("d", 1, 8, 18, "three four"), ("e", 1, 0, 3, "one")], "document string, page int, char_start int, char_end int, text string")
    out = A.carry(spans, native, other)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan and plan.count("Join") == 2
    got = {r.document: r.there for r in out.collect()}
    assert got["e"] is None and (got["d"].text, got["d"].char_start, got["d"].char_end) == ("thr#e four", 8, 18)
    assert got["d"].box.x0 == 0.1 * 8 and got["d"].box.x1 == 0.1 * 18
    rows = spark.createDataFrame([("d", 1, words(here), there, words(there), [(8, 18, "three four")])], f"document string, page int, words {word}, other_text string, other_words {word}, spans array<struct<char_start: int, char_end: int, text: string>>")
    assert A.carry_rows(rows).first().there == got["d"]


_WORD = "array<struct<start: int, end: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"


_tenths = lambda start, end: (start * 0.1, start * 0.0, end * 0.1, end * 0.0 + 1)  # noqa: E731  (a lambda goes to the workers whole)


def _structs(words):
    """``FLAT`` words as an array of structs."""
    boxes = F.arrays_zip(*[f"{words}.box.{x}" for x in ("x0", "y0", "x1", "y1")])
    boxes = F.transform(boxes, lambda b: F.when(b["x0"].isNotNull(), b))
    return F.arrays_zip(f"{words}.start", f"{words}.end", F.split(f"{words}.lines", "\n", -1).alias("text"), boxes.alias("box")).cast(_WORD)


def _shuffles(df):
    return len(re.findall("Exchange|EvalPython", df._jdf.queryExecution().executedPlan().toString()))


def test_spans_are_carried_from_flat_words(spark):
    """Before, a page's anchors left Python as arrays, to be counted in lambdas, windows and their places took a step each, and pages
    waited for the answers of three steps; a word was a struct."""
    texts = [("d", "one two three four five six seven", "one two thr#e four five six seven"), ("e", "a a b\u2003c\nd a", "x"), ("f", "", "a"), ("g", None, "a b")]
    spans = F.expr("array(named_struct('char_start', 8, 'char_end', 18, 'text', 'three four'), named_struct('char_start', null, 'char_end', null, 'text', 'a'))")
    rows = spark.createDataFrame(texts, "document string, here string, other_text string")
    rows = R.flat_words(rows, {"here": "words", "other_text": "other_words"}, " ", _tenths).select("document", F.lit(1).alias("page"), "words", "other_text", "other_words", spans.alias("spans"))
    out = A.carry_rows(rows)
    assert _shuffles(out) == 1  # short stretches alone wait for their likest windows
    structs = rows.withColumns({c: _structs(c) for c in ("words", "other_words")})
    got, want = ({(r.document, r.text): r.there for r in df.collect()} for df in (out, A.carry_rows(structs)))
    assert got == want and (got["d", "three four"].text, got["d", "three four"].box.x1) == ("thr#e four", 0.1 * 18)
    assert got["g", "a"].text == "a" and got["e", "a"] is None


def test_flat_words_in_many_batches(spark):
    texts = ["", " ", "a", "b  c\td", None, "é\n𝒳 y", "x\n"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for r in R.flat_words(df, {"t": "w"}, " \n", _tenths).collect():
        parts = re.split("[ \n]", r.t) if r.t is not None else []
        starts = [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))]
        assert (r.w.lines, r.w.start) == (None if r.t is None else "\n".join(parts), starts) and r.w.end == [s + len(p) for s, p in zip(starts, parts, strict=True)]
        assert r.w.box.x0 == [s * 0.1 for s in starts]
    assert list(R.runs_of([5, 1, 0, 9], 6)) == [slice(0, 2), slice(2, 4)] and list(R.runs_of([1, 1], 6)) == [slice(0, 2)]


def _rows_with_gold(spark):
    """One page a document, with ``FLAT`` words of which the second of three has no box, and its gold; the same as tables."""
    made = [("d", "Name:\nRED  ﬁre ™ two"), ("e", "x y"), ("f", None), (None, "x y"), ("g", "")]
    golds = "array(named_struct('field', 'product_name', 'state', 'PRESENT', 'value', 'none', 'accepted', array('FIRE', null)), named_struct('field', 'supplier_name', 'state', 'PRESENT', 'value', 'RED', 'accepted', cast(null as array<string>)), named_struct('field', 'flash_point', 'state', 'NO_DATA', 'value', 'x', 'accepted', array('x')))"
    rows = spark.createDataFrame(made, "document string, text string").select("document", F.lit(1).alias("page"), "text", F.expr(golds).alias("golds"))
    rows = R.flat_words(rows, {"text": "words"}, " \n", _tenths)
    holes = F.transform(F.col("words.box.x0"), lambda x, i: F.when(i % 3 != 1, x))
    rows = rows.withColumn("words", F.col("words").withField("box", F.col("words.box").withField("x0", holes)))
    none = "array<struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
    gold = rows.select("document", F.inline("golds")).withColumns({"derivation": F.lit("EXPLICIT"), "rule": F.lit(None).cast("string"), "evidence": F.array().cast(none), "premises": F.array().cast(none)})
    return rows, gold, rows.select("document", "page", "text", F.col("text").alias("row_text"), _structs("words").alias("words"))


def test_oracle_flags_of_rows_move_nothing(spark):
    """Before, a page's words met its gold in a shuffle of twenty times the text, and waited for Python beside it."""
    rows, gold, pages = _rows_with_gold(spark)
    out = B.oracle_flags_rows(rows.withColumn("layer", F.lit("native")), ("layer",))
    assert _shuffles(out) == 0
    want = B.oracle_flags(gold, pages)
    key = lambda df: sorted((str(r.document), r.field, r.value_exact, r.value_located, str(r.located_pages)) for r in df.collect())
    assert key(out) == key(want) and {("d", "product_name", True, True, "[1]"), ("d", "supplier_name", True, False, "[]")} <= set(key(out))


def test_values_of_rows_are_located_in_place(spark):
    """Before, a page's words met its gold in a shuffle of twelve times the text, and waited for Python beside it."""
    rows, gold, pages = _rows_with_gold(spark)
    out = B.locate_rows(rows)
    assert _shuffles(out) == 0
    got, want = ({(r.document, r.field): r for r in df.collect()} for df in (out, B.locate_values(gold, pages)))
    assert got == want and set(got) == {("d", "product_name"), ("d", "supplier_name")} and got["d", "product_name"].text == "Name:\nRED  ﬁre ™ two"


def test_starts_of_words_in_sliced_batches(spark):
    df = spark.createDataFrame([(i, [1] * (i % 4)) for i in range(50)], "i int, n array<int>").repartition(3)
    for r in df.where("i % 3 > 0").select("i", R.word_starts(F.col("n")).alias("s")).collect():
        assert r.s == [2 * k for k in range(r.i % 4)]


def test_composition_rows_meet_once(spark):
    """Before, a document's rows were joined twice with bounds of their own; shares were matched in rows without a number too."""
    texts = ["intro", "4. First aid", "3. Composition", "iron 7439-89-6 10 - 20 %", "no number 5 %", "iron 7439-89-6 5 %", "4. First aid", "zinc 7440-66-6 5 %"]
    rows = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)] + [("e", 1, 0, "zinc 7440-66-6 5 %"), (None, 1, 0, "3. Composition"), (None, 1, 1, "zinc 7440-66-6 5 %")], "document string, page int, row_no int, text string")
    out = X.ingredient_rows(rows)
    assert _times(out, "Join") == 0
    assert [(r.document, r.cas, r.name, r.concentration, r.row_no) for r in out.collect()] == [("d", "7439-89-6", "iron", "10 - 20 %", 3)]


def test_space_is_that_of_unicode(spark):
    """The listed white space is Java's Unicode class and Python's, and is found without a property lookup a character."""
    assert "(?U)" not in T.SPACE
    df = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x3100)], "i int, c string")
    got = df.select("i", F.col("c").rlike(T.SPACE).alias("a"), F.col("c").rlike(r"(?U)[\s\x1c-\x1f]+").alias("b")).collect()
    assert all(r.a == r.b == chr(r.i).isspace() for r in got)


def test_shares_are_read_where_figures_stand(spark):
    df = spark.createDataFrame([("iron 7439-89-6 100 %", 1, 0), ("5 - 10 % iron 7439-89-6 pure", 0, 1), ("iron 7439-89-6 ５ %", 0, 1), ("a 200-001-8 7439-89-6 none", 0, 0)], "t string, whole int, partial int")
    for r in df.select("*", Q.premise(F.col("t")).alias("p")).collect():
        assert (len(r.p.shares.whole), len(r.p.shares.partial)) == (r.whole, r.partial), r.t


def test_oracle_flags_keep_words_in_their_pages(spark):
    """Before, each word was a row in four sorted unions; a page was normalised for each value, asked for or not."""
    word = "array<struct<start: int, end: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
    text, box = "ﬁne  ™ red FINE  end", (0.0, 0.0, 1.0, 1.0)
    words = [(m.start(), m.end(), m.group(), None if m.group() in ("ﬁne", "red") else box) for m in re.finditer(r"\S+", text)]
    pages = spark.createDataFrame([("d", 1, text, text, words[::-1]), ("e", 1, None, None, None)], f"document string, page int, text string, row_text string, words {word}")
    none = "array<struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
    gold = [("d", f, "PRESENT", "EXPLICIT", v, [], [], []) for f, v in (("product_name", "fine"), ("supplier_name", "RED"), ("flash_point", "fine red"), ("molecular_weight", "blue"))] + [("e", "product_name", "PRESENT", "EXPLICIT", "x", [], [], [])]
    golds = spark.createDataFrame(gold, f"document string, field string, state string, derivation string, value string, accepted array<string>, evidence {none}, premises {none}")
    out = B.oracle_flags(golds, pages).select("document", "field", "value_exact", "value_located")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Union" not in plan and "compose" not in plan
    # The mark between two words has a box; the second "fine" has one, the first has none.
    want = {("d", "product_name"): (True, True), ("d", "supplier_name"): (True, False), ("d", "flash_point"): (True, True), ("d", "molecular_weight"): (False, False), ("e", "product_name"): (False, False)}
    assert {(r.document, r.field): (r.value_exact, r.value_located) for r in out.collect()} == want
    rows = pages.select("document", "page", F.inline("words"))
    again = B.oracle_flags(golds, pages.drop("words"), rows).select("document", "field", "value_exact", "value_located")
    assert {(r.document, r.field): (r.value_exact, r.value_located) for r in again.collect()} == want


def test_located_values_leave_their_page_once(spark):
    """Before, a page's text and words met its values, and then again the first places of these."""
    pages = spark.createDataFrame([("d", 2, "a\nName:\nred  ﬁre"), ("d", 3, "fire"), ("e", 1, None)], "document string, page int, text string")
    none = "array<struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
    gold = [("d", "product_name", "PRESENT", "EXPLICIT", "none", ["FIRE"], [], []), ("d", "supplier_name", "PRESENT", "EXPLICIT", "", [], [], []), ("e", "product_name", "PRESENT", "EXPLICIT", "x", [], [], [])]
    golds = spark.createDataFrame(gold, f"document string, field string, state string, derivation string, value string, accepted array<string>, evidence {none}, premises {none}")
    out = B.locate_values(golds, pages)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert [tuple(r)[:4] for r in out.collect()] == [("d", "product_name", 2, "Name:\nred  ﬁre")]


def test_offsets_of_batches(spark):
    """Places of many rows at once are those of a walk over each text's characters."""

    def walk(text, low):
        out, space, last = [], True, 0
        for i, ch in enumerate(text):
            if ch not in T.DROPPED:
                ch = T.LIGATURES.get(ch, ch)
                if ch.isspace():
                    out += [] if space else [i]
                    space = True
                else:
                    out += [i] * len(ch.lower() if low else ch)
                    space, last = False, len(out)
        return out[:last]

    texts = ["", " ", "a", " a b ", "a ™ b", "™", " ﬁ  İx ", "𝒳 y", "a\n\n", "\tb", "x ®"] * 3
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, t string").coalesce(1)
    for r in df.select("t", search.offsets("t").alias("a"), search.exact_offsets("t").alias("b"), search.offsets_at("t", F.array(F.lit(0), F.lit(2), F.lit(-1))).alias("c")).collect():
        if r.t is None:
            assert r.a is None and r.b is None and r.c == [None] * 3
        else:
            assert (r.a, r.b) == (walk(r.t, True), walk(r.t, False)), repr(r.t)
            assert r.c == [r.a[i] if 0 <= i < len(r.a) else None for i in (0, 2, -1)]


def test_pages_are_normalised_once_a_kind(spark):
    """Before, a page was normalised again for each value of its document, and also where no typed flag was asked for."""
    none = "array<struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
    gold = [("d", f, "PRESENT", "EXPLICIT", v, [], [], []) for f, v in (("product_name", "Acme  Co."), ("supplier_name", "none"), ("flash_point", "142 °F"), ("chemical_formula", "H₂O"), ("product_cas_number", ".,:"))]
    golds = spark.createDataFrame(gold, f"document string, field string, state string, derivation string, value string, accepted array<string>, evidence {none}, premises {none}")
    pages = spark.createDataFrame([("d", 1, "acme co H2O", "flash point 61 °C")], "document string, page int, text string, row_text string")
    flags = B.oracle_flags(golds, pages)
    assert "compose" not in flags.select("document", "value_exact", "note")._jdf.queryExecution().optimizedPlan().toString()
    assert {r.field: r.value_typed for r in flags.collect()} == {"product_name": True, "supplier_name": False, "flash_point": True, "chemical_formula": True, "product_cas_number": True}


def test_premises_are_read_in_compiled_steps(spark):
    """Before, a span's whole reading was one lambda, interpreted node by node for each row, with sets of arrays in its aggregate."""
    texts = (
        "3.1. Substances", "Substances or 3.2 Mixtures", "3.1. Substances Not applicable", "Mixture", "not a mixture", "Use: preparation", "C.A.S. No. % by Wt", "100 % pure", "no further ingredients", "", None, "x\n5 % 7439-89-6",
        "iron 7439-89-6 100 % zinc 7440-66-6 5 - 10 %", "7439-89-6 231-096-4 ５ %", "max 99,5 % 7439-89-6 and 7440-66-6 < 100 % 7440-66-6 > 3", "7439-89-6", "a 7440-02-0 ≤ 100 w/w a 7440-02-0 NMT 100",
    )
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    both = df.crossJoin(spark.range(1, 4).withColumnRenamed("id", "n")).select(F.expr("if(n = 1, k, div(k, n) + 100 * n)").alias("k"), "text")
    out = D.audit(both, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "collect_set" not in plan and plan.count("Exchange hashpartitioning") == 1
    p = both.select("k", Q.premise(F.col("text")).alias("p")).groupBy("k")
    numbers = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(f"p.shares.{c}")))).cast("long")
    want = p.agg(F.count("p.form"), F.count_if("p.header"), numbers("whole"), numbers("partial"), F.count_if("p.complete"), F.array_sort(F.collect_set("p.form")))
    assert {tuple(map(str, r)) for r in out.collect()} == {tuple(map(str, r)) for r in want.collect()}


_FIGURES = (
    "at least 12,50 ℃", "212 °F", "none °", None, "", "below 1234567 ºc", "0.00001234 C", "-0.0 C", "5 cm above 5 c", "5 f, over 7.25 c", "not more than\n-40 f", "1.2.3 c", "100000 c", "999999.95 C", "123456.5 C", "0.5 g / mole",
    "NLT 18,0 g/mol", "≥ 20", "1e5", "２０ ℃", "0 c", "10.00 C", "-12345678.9 °f", "x 9",
)


def _interpreted(df):
    plan = df._jdf.queryExecution().analyzed().toString()
    return [x for x in ("regexp_extract(lambda", "format_string(%.5e, lambda", "rlike(lambda") if x in plan]


def test_canonical_values_of_tables_are_compiled(spark):
    """Before, the query read each figure in nested lambdas, interpreted node by node for each row."""
    df = spark.createDataFrame([(t,) for t in _FIGURES], "a string").withColumn("b", F.reverse("a"))
    for kind in ("temperature", "quantity"):
        out = V.with_canonical(df, kind, {"x": "a", "y": "b"})
        assert _interpreted(out) == [] and out.columns == ["a", "b", "x", "y"]
        want = df.select("a", "b", V.canonical_value(F.col("a"), kind).alias("x"), V.canonical_value(F.col("b"), kind).alias("y"))
        assert _interpreted(want) != [] and out.collect() == want.collect()


def test_quantities_of_tables_are_compiled(spark):
    """Before, the query read both sides in nested lambdas, interpreted node by node for each row."""
    df = spark.createDataFrame([(t,) for t in _FIGURES], "a string")
    df = df.crossJoin(df.withColumnRenamed("a", "b"))
    for kind in ("temperature", "quantity"):
        out = V.with_equality(df, kind, "a", "b", "same", 0.05)
        assert _interpreted(out) == []
        want = df.select("a", "b", V.values_equal(F.col("a"), F.col("b"), kind, 0.05).alias("same"))
        assert out.collect() == want.collect()


def test_words_and_texts_of_pages_meet_once(spark):
    """Before, a page's words went through three exchanges and a join; each place of a page was tried for every quote."""
    words = [(1, 1, 0, 1, "b"), (1, 1, 0, 0, "a"), (1, 1, 2, 0, "cc"), (1, 2, None, 0, "x"), (1, 2, 0, 0, ""), (1, 2, 0, 0, None), (2, 1, 5, 1, "é"), (2, 1, 5, 0, "ff"), (2, 1, 6, 0, "g")]
    tokens = spark.createDataFrame([(*w, float(i)) for i, w in enumerate(words)], "document int, page int, line_no int, word_no int, text string, box double")
    out = L.placed_words(tokens, ["document", "page"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.document, r.page): r for r in out.collect()}
    some = tokens.where("text is not null")
    assert {k: r.text for k, r in got.items()} == {(r.document, r.page): r.text for r in L.page_text(some, ["document", "page"]).collect()}
    for r in L.char_spans(some, ["document", "page"]).collect():
        page = got[r.document, r.page]
        assert (r.char_start, r.char_end, r.box) in [tuple(w) for w in page.words] and page.text[r.char_start : r.char_end] == r.text
    cases = [("aaaa", "aa", [0, 1, 2]), ("abcab", "ab", [0, 3]), ("ab", "abc", []), ("ab", "", []), ("", "a", []), ("xéa", "éa", [1]), ("ab", "c", []), (None, "a", []), ("a", None, [])]
    at = spark.createDataFrame(cases, "p string, q string, want array<int>").select("want", search.positions(F.col("p"), F.col("q")).alias("got"))
    assert all(r.want == r.got for r in at.collect()) and _times(at, "position(") >= 1
