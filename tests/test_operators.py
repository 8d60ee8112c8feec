"""Derivation rules, layout, extraction, matching and guards on small tables."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import contracts as K
from factloom.operators import extract as X
from factloom.operators import layout as L
from factloom.operators import retrieval as R
from factloom.operators import scoring as S
from factloom.plans import derivation as D
from factloom.streaming.events import windowed_counts

HEADER = "Ingredient C.A.S. No. % by Wt"


def form_of(spark, *texts):
    a = D.audit(spark.createDataFrame([(1, t) for t in texts], "k int, text string"), ["k"])
    return a.select(D.established_form().alias("f")).first()["f"]


def rule_of(spark, rule, field, state, value, *texts):
    a = D.audit(spark.createDataFrame([(1, t) for t in texts], "k int, text string"), ["k"])
    lit = lambda v: F.lit(v).cast("string")
    return a.select(D.check_rule(lit(rule), lit(field), lit(state), lit(value), F.lit(len(texts))).alias("r")).first()["r"]


def test_forms(spark):
    assert form_of(spark, HEADER, "Aluminum 7429-90-5 1~10", "Copper 7440-50-8 1~15") == "MIXTURE"
    assert form_of(spark, HEADER, "x 7429-90-5 90 - 100", "y 7440-50-8 1 - <2,5") is None
    assert form_of(spark, "Sand 14808-60-7 >95") is None
    assert form_of(spark, "argon 7440-37-1 100") is None
    assert form_of(spark, "argon 7440-37-1 100", "There are no impurities or stabilizers") == "SUBSTANCE"
    assert form_of(spark, "Substance/mixture : Mixture", "Substance/mixture : Substance") is None


def test_rules(spark):
    ident, comp = D.IDENTIFIER_RULE, D.COMPOSITION_RULE
    argon = ("argon 7440-37-1 100", "There are no impurities or stabilizers")
    assert rule_of(spark, ident, "chemical_formula", "NOT_APPLICABLE", None, "Chemical description: Mixture of substances") == "satisfied"
    assert rule_of(spark, ident, "flash_point", "NOT_APPLICABLE", None, "Chemical description: Mixture of substances") == "violated"
    assert rule_of(spark, ident, "chemical_formula", "NOT_APPLICABLE", None, "Section 3") == "undecidable"
    assert rule_of(spark, comp, "substance_or_mixture", "PRESENT", "SUBSTANCE", *argon) == "satisfied"
    assert rule_of(spark, comp, "substance_or_mixture", "PRESENT", "MIXTURE", *argon) == "undecidable"
    assert rule_of(spark, comp, "substance_or_mixture", "PRESENT", "MIXTURE", "Substance/mixture : Mixture") == "violated"
    assert rule_of(spark, "other", "substance_or_mixture", "PRESENT", "MIXTURE", *argon) == "violated"


def test_rows_and_text(spark):
    tokens = [(1, 0.10 + 0.07 * i, y, 0.16 + 0.07 * i, y + 0.012, w) for y, line in ((0.40, "Flash Point: 61 °C"), (0.42, "Boiling point: 100 °C")) for i, w in enumerate(line.split())]
    rows = L.visual_rows(spark.createDataFrame(tokens, "page int, x0 double, y0 double, x1 double, y1 double, text string"), ["page"])
    got = {r["row_no"]: r["text"] for r in L.row_texts(rows, ["page"]).collect()}
    assert got == {0: "Flash Point: 61 °C", 1: "Boiling point: 100 °C"}
    words = spark.createDataFrame([(1, 0, 0, "ab"), (1, 0, 1, "c"), (1, 1, 0, "d")], "page int, line_no int, word_no int, text string")
    assert [(r["char_start"], r["char_end"]) for r in L.char_spans(words, ["page"]).orderBy("line_no", "word_no").collect()] == [(0, 2), (3, 4), (5, 6)]
    assert L.page_text(words, ["page"]).first()["text"] == "ab c\nd"


def test_section_scope(spark):
    texts = ["4. First aid", "3. Composition", "a", "SECTION 4: x", "3. again"]
    rows = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "document string, page int, row_no int, text string")
    assert [r["text"] for r in L.composition_rows(rows).orderBy("row_no").collect()] == ["3. Composition", "a"]


def test_extraction(spark):
    texts = ["Product name: Foo", "Flash point:", "12 °C (53.6 °F)", "3. Composition", "Sand CAS No. 14808-60-7 20 - 60 %", "Sand again 14808-60-7 1", "4. First aid"]
    rows = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "document string, page int, row_no int, text string")
    got = X.first_usable(X.candidates(rows, "flash_point"), "flash_point").first()
    assert (got["state"], got["value"], got["row_no"]) == ("PRESENT", "12 °C (53.6 °F)", 1)
    item = X.ingredient_rows(rows).collect()
    assert [(r["cas"], r["name"], r["concentration"]) for r in item] == [("14808-60-7", "Sand", "20 - 60 %")]
    form = X.declared_form(spark.createDataFrame([("d", 1, 0, "3.2 Mixtures"), ("d", 1, 1, "defined by OSHA as an article")], "document string, page int, row_no int, text string")).first()
    assert form["form"] == "ARTICLE"


def test_records_match_once(spark):
    gold = spark.createDataFrame([("d", 0, "1", "a"), ("d", 1, None, "b"), ("d", 2, "1", "c")], "document string, pos int, cas string, name string")
    said = spark.createDataFrame([("d", 0, "1", "x"), ("d", 1, None, "b")], "document string, pos int, cas string, name string")
    got = sorted(tuple(r) for r in S.match_records(gold, said, ["cas", "name"]).collect())
    assert got == [("d", 0, 0, "cas"), ("d", 1, 1, "name")]
    rates = S.record_rates(S.match_records(gold, said, ["cas", "name"]), gold, said).first()
    assert (rates["precision"], round(rates["recall"], 6)) == (1.0, 0.666667)


def test_axes_and_groups(spark):
    best = spark.createDataFrame([(1, "a", 1, 1, 1.0, 1.0, 1.0, 1.0), (1, "b", 1, 0, 0.0, 0.0, 0.0, 0.0)], "claim int, role string, needed int, page_match int, span_coverage double, span_iou double, box_coverage double, box_iou double")
    got = S.group_axes(best, ["claim"]).first()
    assert (got["page"], got["span"], got["bbox"]) == ("violated", "violated", "violated")
    t = spark.createDataFrame([("satisfied", "n/a"), ("n/a", "violated")], "a string, b string")
    assert [r["j"] for r in t.select(S.joint(("a", "b")).alias("j")).collect()] == [True, False]
    empty = S.stage_rates(t.limit(0), ("a", "b")).first()
    assert (empty["n"], empty["stage_1_a"]) == (0, 0.0)


def test_budget_stops_at_first_overflow(spark):
    r = spark.createDataFrame([("d", 1, 300), ("d", 2, 400), ("d", 3, 10)], "document string, rank int, n_tokens int")
    assert [x["rank"] for x in R.within_budget(r, ["document"], 500).collect()] == [1]


def test_guards(spark):
    docs = spark.createDataFrame([("a", "dev"), ("b", "locked")], "document string, split string")
    with pytest.raises(K.LockedSplitError):
        K.guard_split(docs)
    with pytest.raises(K.PredictionSetError):
        K.guard_predictions(docs, docs.where("document = 'a'"), "dev")
    K.guard_predictions(docs, docs.where("document = 'a'"), "all")
    pid = lambda names: spark.range(1).select(K.prediction_id(F.lit("s"), F.create_map(F.lit("k"), F.lit("v")), F.array(*map(F.lit, names))).alias("i")).first()["i"]
    assert pid(["a", "b"]) == pid(["b", "a"]) != pid(["a"])


def test_contract_and_repair(spark):
    c = spark.createDataFrame([("PRESENT", "x", "DERIVED", None, 1, False), ("NO_DATA", "x", "DIRECT", None, 0, True)], "state string, value string, derivation string, rule string, n_premises long, has_evidence boolean")
    assert [r["b"] for r in c.select(K.claim_breaches().alias("b")).collect()] == [["derived_without_rule"], ["value_without_present"]]
    assert all(r["b"] == [] for r in K.repaired(c).select(K.claim_breaches().alias("b")).collect())


def test_model_calls_keep_errors(spark):
    def caller(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r["key"]: (r["response"], r["error"]) for r in K.call_model(spark.createDataFrame([("1", "ok"), ("2", "bad")], "key string, prompt string"), caller).collect()}
    assert got == {"1": ("OK", None), "2": (None, "no")}


def test_event_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 01:00:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("event_counts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.sql("select * from event_counts").collect()] == [("a", 2, 3.0)]
