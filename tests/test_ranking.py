"""Retrieval runs: exclusions, metrics, slices, a judge with a cache, cases and tables."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import retrieval as R
from factloom.plans import ranking as N

SPAN = "array<struct<page: int, text: string>>"


@pytest.fixture(scope="module")
def gold(spark):
    rows = [
        ("a", "dev", "flash_point", "PRESENT", "EXPLICIT", [(2, "Flash point: 61 C")], []),
        ("a", "dev", "chemical_formula", "NOT_APPLICABLE", "ONTOLOGY", [], [(1, "Mixture"), (3, "Section 3")]),
        ("a", "dev", "product_name", "NOT_STATED", "ABSENT", [(1, "x")], []),
        ("a", "dev", "supplier_name", "PRESENT", "EXPLICIT", [], []),
        ("a", "dev", "ingredients", "PRESENT", "EXPLICIT", [(1, "y")], []),
        ("b", "dev", "flash_point", "PRESENT", "EXPLICIT", [(1, "61")], []),
        ("c", "locked", "flash_point", "PRESENT", "EXPLICIT", [(1, "61")], []),
    ]
    raw = spark.createDataFrame(rows, f"document string, split string, field string, state string, derivation string, evidence {SPAN}, premises {SPAN}")
    sets = R.evidence_sets(raw)
    lost = raw.where("field = 'ingredients'").select("document", "field", "state", "derivation", F.array().cast("array<struct<page: int, text: string, kind: string>>").alias("pieces"), F.lit(1).alias("n_pieces"), F.lit(1).alias("n_pages"), F.lit(False).alias("cross_page"))
    splits = raw.select("document", "split").distinct()
    return sets.unionByName(lost).join(splits, "document").persist()


@pytest.fixture(scope="module")
def units(spark):
    texts = [(1, "Mixture of substances name", 100), (2, "the flash point compared in degrees celsius", 450), (3, "nothing", 300)]
    return spark.createDataFrame([("a", p, t, n) for p, t, n in texts], "document string, unit int, text string, n_tokens int").persist()


def test_field_queries(spark):
    got = {r["query_id"]: r["text"] for r in N.field_queries(spark).collect()}
    assert got["flash_point"] == "flash point Flash point, compared in degrees Celsius." and len(got) == 7


def test_run_layer(spark, gold, units):
    counts, instances, sums = N.run_layer(units, gold)
    c = counts.first()
    assert (c["n_total"], c["n_excluded"], c["n_ingredients"], c["n_empty"], c["n_absent"], c["n_included"]) == (6, 3, 1, 1, 1, 3)
    got = {(r["method"], r["document"], r["field"]): r for r in instances.collect()}
    flash, formula = got["bm25", "a", "flash_point"], got["naive", "a", "chemical_formula"]
    assert flash["complete_1"] and flash["hits_1"] == 1 and flash["recall_500tok"] == 1.0
    assert got["naive", "a", "flash_point"]["complete_2"] and not got["naive", "a", "flash_point"]["complete_1"] and not got["naive", "a", "flash_point"]["complete_500tok"]
    assert formula["recall_1"] == 0.5 and not formula["complete_2"] and formula["complete_3"] and formula["recall_500tok"] == 0.5 and formula["complete_1000tok"]
    assert got["bm25", "b", "flash_point"]["recall_10"] == 0  # a document without pages
    table = {(r["method"], r["slice"]): r for r in sums.collect()}
    assert table["naive", "all"]["n"] == 3 and table["naive", "derived"]["n"] == table["naive", "cross_page_true"]["n"] == table["naive", "multi_evidence"]["n"] == 1
    assert round(table["naive", "all"]["micro_recall_3"], 6) == 0.75 and round(table["naive", "all"]["recall_3"], 6) == round(2 / 3, 6)
    for r in instances.collect():
        assert all(r[f"recall_{c}"] >= r[f"complete_{c}"] for c in N.CUTS)


def test_judge(spark, gold, units):
    sets = R.rankable(gold.where("split = 'dev' and field <> 'ingredients'"))
    asked = N.judge_requests(units, sets, limit=1)
    assert asked.count() == 6 and asked.select("key").distinct().count() == 6
    first = asked.where("field = 'flash_point' and unit = 1").first()["key"]
    cache = spark.createDataFrame([(first, 0.9, 1), (first, 0.2, 2)], "key string, score double, seq int")

    def caller(prompt):
        if "nothing" in prompt:
            raise RuntimeError("no answer")
        return "0.75" if "degrees celsius" in prompt.split("\n\n")[-1] else "0"

    scores = N.judged(asked, cache, caller).persist()
    got = {(r["field"], r["unit"]): r for r in scores.collect()}
    assert got["flash_point", 1]["score"] == 0.2 and got["flash_point", 1]["cached"] and got["flash_point", 2]["score"] == 0.75
    assert got["flash_point", 3]["score"] is None and "no answer" in got["flash_point", 3]["error"]
    instances, sums = N.judge_layer(scores, units, sets)
    rows = {r["field"]: r for r in instances.collect()}
    assert rows["flash_point"]["complete_1"] and len(rows) == 2 and sums.where("slice = 'all'").first()["n"] == 2
    whole = scores.withColumn("score", F.coalesce("score", F.lit(0.0)))
    cases = {r["field"]: r for r in N.judged_instances(whole, sets).collect()}
    assert cases["chemical_formula"]["gold_pages"] == [1, 3] and cases["chemical_formula"]["piece_scores"] == [0.0, 0.0] and cases["flash_point"]["page_scores"] == {1: 0.2, 2: 0.75, 3: 0.0}
    texts = {r["field"]: r["markdown"] for r in N.case_text(N.judged_instances(whole, sets)).collect()}
    assert "| 2 | 0.75 | gold | [direct] Flash point: 61 C |" in texts["flash_point"] and "page 2 at 0.75" in texts["chemical_formula"] and "below one half" in texts["chemical_formula"]
    picked = R.case_picks(N.judged_instances(whole, sets))
    assert {r["stratum"] for r in picked.collect()} == {"contrast", "ontology_cross_page"}


def test_series_and_tables(spark, tmp_path):
    def put(name, n):
        path = tmp_path / name
        path.write_text(json.dumps({"native": {"n_included": n, "overall": {"macro": {"complete": {"1": 0.5, "10": 1.0}}}}}))
        return str(path), "overall"

    series = N.load_series(spark, {"x": put("x.json", 125), "y": put("y.json", 125)}, "native")
    assert {(r["name"], r["metric"], r["cut"], r["value"]) for r in series.collect()} == {(n, "complete", c, v) for n in "xy" for c, v in ((1, 0.5), (10, 1.0))}
    with pytest.raises(N.SeriesError):
        N.load_series(spark, {"x": put("x.json", 125), "z": put("z.json", 124)}, "native")
    wide = series.groupBy("name").pivot("cut", [1, 10]).agg(F.first("value"))
    lines = [r["line"] for r in N.table_markdown(wide, "name", ["1", "10"]).orderBy("line_no").collect()]
    assert lines == ["| name | 1 | 10 |", "|---|---|---|", "| x | 0.500 | 1.000 |", "| y | 0.500 | 1.000 |"]


def test_percentile_row(spark):
    values = spark.createDataFrame([(g, n) for g in ("a", "b") for n in range(10 if g == "a" else 1)] + [("a", None)], "g string, n int")
    assert {r["g"]: r["p90"] for r in R.percentile_row(values, ["g"], "n").collect()} == {"a": 9, "b": 0}


def test_unusable_vectors_take_no_part(spark):
    """Null, empty, zero, ragged and non-finite vectors neither ask nor answer, and crash nothing."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["rank"]) for r in R.nearest_by_cosine(table, F.col("vec_id") % 5 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert R.nearest_by_cosine(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_query_sets_are_checked(spark):
    units = spark.createDataFrame([("a", 1), ("a", 2)], "document string, unit int")
    scores = spark.createDataFrame([("a", 1, "q", 2.0)], "document string, unit int, query_id string, score double")
    queries = spark.createDataFrame([("q",), ("r",)], "query_id string")
    got = sorted(tuple(r[c] for c in ("unit", "query_id", "score")) for r in R.all_scores(scores, units, queries).collect())
    assert got == [(1, "q", 2.0), (1, "r", 0.0), (2, "q", 0.0), (2, "r", 0.0)]
    assert R.all_scores(scores, units, queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.all_scores(scores, units, queries, most=1)
