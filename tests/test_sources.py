"""Readers and sinks on small files: schemas, defaults, order, headers."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import contracts as K
from factloom.operators import layout as L
from factloom.plans import resolution as N
from factloom.sources import reports
from factloom.sources import tables as S


def put(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
    return str(path)


def test_annotations_have_the_loaders_defaults(spark, tmp_path):
    note = {
        "document": "a.pdf", "product_form": "MIXTURE",
        "fields": {
            "product_name": {"state": "PRESENT", "value": "X", "evidence": [{"page": 1, "text": "X"}]},
            "chemical_formula": {"state": "NOT_APPLICABLE", "derivation": "ONTOLOGY", "evidence": []},
            "substance_or_mixture": {"state": "PRESENT", "derivation": "COMPOSITION_IMPLIED", "value": "MIXTURE", "accepted_values": ["PREPARATION"], "ambiguous": True},
        },
        "ingredients": {"state": "PRESENT", "items": [{"name": "w", "cas_number": "7732-18-5"}, {"name": "v", "cas_state": "NOT_STATED"}]},
    }
    path = put(tmp_path / "a.json", note)
    rows = {r["field"]: r for r in S.annotations(spark, path).collect()}
    assert rows["product_name"]["split"] == "dev" and rows["product_name"]["derivation"] == "EXPLICIT" and rows["product_name"]["rule"] is None
    assert rows["chemical_formula"]["rule"] == "identifier_undefined_for_form" and rows["substance_or_mixture"]["rule"] == "composition_implies_form"
    assert rows["substance_or_mixture"]["accepted_values"] == ["PREPARATION"]
    items = {r["pos"]: r for r in S.ingredients(spark, path).collect()}
    assert items[0]["cas_state"] == "PRESENT" and items[1]["cas_state"] == "NOT_STATED" and items[1]["cas_number"] is None


def test_manifest(spark, tmp_path):
    path = put(tmp_path / "m.csv", "document,split,supplier,template_family,regime,language,scan,pages,product_form,note\na.pdf,dev,s,f,EU,en, Yes ,12,MIXTURE,\nb.pdf,other,s,,EU,en,no,,,x\n")
    rows = {r["document"]: r for r in S.manifest(spark, path).collect()}
    assert rows["a.pdf"]["scan"] and rows["a.pdf"]["pages"] == 12 and not rows["b.pdf"]["scan"] and rows["b.pdf"]["pages"] == 0
    files = spark.createDataFrame([("a.pdf",), ("c.pdf",)], "document string")
    got = {tuple(r) for r in N.manifest_problems(S.manifest(spark, path), files).collect()}
    assert got == {("c.pdf", "file without a row"), ("b.pdf", "row without a file"), ("b.pdf", "unknown split"), ("b.pdf", "no template family")}
    assert {r["template_family"]: r["documents"] for r in N.template_families(S.manifest(spark, path)).collect()} == {"f": ["a.pdf"], None: ["b.pdf"]}


def test_ocr_words_and_lines(spark, tmp_path):
    word = lambda t, x, y: {"text": t, "confidence": 90.0, "bbox": [x, y, x + 50, y + 20]}
    path = put(tmp_path / "o.json", {"document": "a.pdf", "pages": [{"page_number": 1, "image_width": 1000, "image_height": 2000, "words": [word("Flash", 100, 200), word(" ", 160, 200), word("point", 220, 204), word("next", 100, 260)]}]})
    words = S.ocr_words(spark, path)
    rows = words.orderBy("word_no").collect()
    assert [r["text"] for r in rows] == ["Flash", "point", "next"] and rows[0]["x0"] == 0.1 and rows[0]["y0"] == 0.1 and rows[0]["confidence"] == 90.0
    lined = L.ocr_lines(words, ["document", "page"]).orderBy("word_no").collect()
    assert [r["line_no"] for r in lined] == [0, 0, 1]


def test_predictions_last_entry_wins(spark, tmp_path):
    claim = lambda v: {"product_name": {"state": "PRESENT", "value": v, "derivation": "DIRECT", "evidence": {"page": 1, "text": v}}}
    data = {"system": "s", "configuration": {"split": "dev"}, "documents": [{"document": "a", "fields": claim("old")}, {"document": "b", "error": "broke"}, {"document": "a", "fields": claim("new")}]}
    rows = {(r["document"], r["field"]): r for r in S.predictions(spark, put(tmp_path / "p.json", data)).collect()}
    assert rows["a", "product_name"]["claim"]["value"] == "new" and rows["b", None]["error"] == "broke" and len(rows) == 2


def test_units_and_files(spark, tmp_path):
    path = put(tmp_path / "u.jsonl", '{"document":"a","split":"dev","page":2,"layer":"native","text":"x y","n_tokens":2}\n')
    assert S.units(spark, path).first().asDict() == {"document": "a", "split": "dev", "page": 2, "layer": "native", "text": "x y", "n_tokens": 2}
    folder = tmp_path / "docs"
    folder.mkdir()
    for name in ("b.pdf", "a.pdf", "c.txt"):
        put(folder / name, "12")
    assert [tuple(r) for r in S.page_files(spark, str(folder)).collect()] == [("a.pdf", 2), ("b.pdf", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny", 1)], "system string, text string, n int")
    S.write_json(df, str(tmp_path / "j"), ["system"])
    assert spark.read.json(str(tmp_path / "j")).first()["text"] == "x\ny" and (tmp_path / "j" / "system=a").is_dir()
    S.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first()["text"] == "x y"
    log = str(tmp_path / "log")
    for n in ("1", "2"):
        reports.append_run(reports.run_row(spark, date="2020-01-01", split="locked", prediction_id=n), log)
    reports.write_log(spark, log, str(tmp_path / "shown"))
    lines = [x for f in sorted((tmp_path / "shown").glob("part-*")) for x in f.read_text().splitlines()]
    assert sum(x.startswith("date,") for x in lines) == 1 and len(lines) == 3
    assert {r["prediction_id"] for r in reports.read_log(spark, log).collect()} == {"1", "2"}


def test_layers(spark):
    tokens = spark.createDataFrame([("native", 1), ("ocr", 2)], "layer string, n int")
    assert [r["n"] for r in N.on_layer(tokens, "ocr").collect()] == [2] and N.on_layer(tokens).count() == 1
    with pytest.raises(ValueError):
        N.on_layer(tokens, "scan")


def test_reports_have_fixed_columns(spark):
    one = spark.createDataFrame([("a", "product_name", [1, 2], 0.123456, True, None, "x\r\ny")], "document string, field string, gold_pages array<int>, span_coverage double, joint boolean, gold_value string, gold_evidence string")
    row = reports.instance_report(one.withColumn("span_dilution", F.lit(1.0))).first()
    assert row.__fields__ == list(reports.INSTANCE_COLUMNS) and len(row) == 40
    assert (row["gold_pages"], row["span_coverage"], row["joint_correct"], row["gold_value"], row["gold_evidence"], row["span_dilution"]) == ("1,2", "0.1235", "True", "", "x y", "1.00")
    items = spark.createDataFrame([("a", 0, "w", "1 %"), ("a", 3, "W", None)], "document string, pos int, name string, concentration string")
    records = spark.createDataFrame([("a", 0, 3, "cas", True, False)], "document string, gold_pos int, predicted_pos int, matched_on string, name_ok boolean, verbatim boolean")
    row = reports.ingredient_report(records, items, items).first()
    assert row.__fields__ == list(reports.INGREDIENT_COLUMNS) and (row["gold_name"], row["predicted_name"], row["predicted_concentration"], row["name_ok"], row["key"]) == ("w", "W", "", "True", "cas")
    breaches = spark.createDataFrame([("b", None, "schema_invalid"), ("a", "product_name", "x")], "document string, field string, code string")
    assert [tuple(r) for r in reports.contract_report(breaches).collect()] == [("a", "product_name", "x"), ("b", "", "schema_invalid")]


def test_pdf_words(spark):
    rows = [("a", 1, 2, 0, 0, "c", 10.0, 40.0, 20.0, 50.0, 100.0, 200.0), ("a", 1, 1, 0, 5, "b", 30.0, 20.0, 40.0, 30.0, 100.0, 200.0), ("a", 1, 1, 0, 1, "a", 10.0, 20.0, 20.0, 30.0, 100.0, 200.0), ("a", 1, 1, 0, 2, "  ", 0.0, 0.0, 0.0, 0.0, 100.0, 200.0)]
    words = spark.createDataFrame(rows, "document string, page int, block int, line int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double")
    got = S.pdf_words(words).orderBy("line_no", "word_no").collect()
    assert [(r["line_no"], r["word_no"], r["text"]) for r in got] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")] and (got[0]["x0"], got[0]["y1"]) == (0.1, 0.15)


def test_checked_predictions(spark, tmp_path):
    claim = {"state": "PRESENT", "value": "v", "derivation": "DIRECT", "evidence": {"page": 1, "text": "v"}}
    good = put(tmp_path / "g.json", {"system": "s", "configuration": {"split": "dev"}, "documents": [{"document": "b", "fields": {"product_name": claim}}, {"document": "a", "fields": {"product_name": claim}}]})
    rows = S.checked_predictions(spark, good)
    assert rows.count() == 2 and K.document_names(rows).first()["documents"] == ["a", "b"] and rows.select(K.declared_split(F.col("configuration")).alias("s")).first()["s"] == "dev"
    bad = put(tmp_path / "b.json", {"system": "s", "documents": [{"document": "a", "fields": {"product_name": {**claim, "value": None}}}]})
    with pytest.raises(K.PredictionSetError, match="present_without_value"):
        S.checked_predictions(spark, bad)
    flat = rows.select("document", "field", "claim.*")
    S.write_predictions(flat, str(tmp_path / "w"), "s", {"split": "dev", "layer": "native"})
    again = S.predictions(spark, str(tmp_path / "w"), multi_line=False)
    assert {(r["document"], r["field"], r["claim"]["value"], r["configuration"]["layer"]) for r in again.collect()} == {("a", "product_name", "v", "native"), ("b", "product_name", "v", "native")}


def test_exploration(spark):
    ref = "array<struct<page: int, text: string>>"
    rows = [("a", "MIXTURE", "x", "EXPLICIT", [(1, "p"), (2, "q")]), ("a", "MIXTURE", "y", "ONTOLOGY", []), ("b", None, "x", "EXPLICIT", None)]
    got = {(r["what"], r["name"]): r["n"] for r in S.exploration(spark.createDataFrame(rows, f"document string, product_form string, field string, derivation string, evidence {ref}")).collect()}
    assert got["product_form", "MIXTURE"] == got["product_form", "UNKNOWN"] == 1 and got["derivation", "EXPLICIT"] == 2 and got["evidence", "x"] == 2 and got["multi_evidence", "x"] == 1 and got["multi_evidence", "y"] == 0


def test_calls_are_tried_again_and_counted(spark):
    asked = spark.createDataFrame([("k", "p")], "key string, prompt string")
    seen = []

    def caller(prompt):
        seen.append(prompt)
        if len(seen) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert K.call_model(asked, caller, tries=3).first()["response"] == "ok" and K.call_model(asked, caller).first()["error"] == "busy"
    calls = spark.createDataFrame([("a", "m", False, 1_000_000, 500_000, 2.0, None), ("b", "m", True, 10, 10, 0.0, None), ("c", "free", False, 5, 5, 1.0, "lost")], "document string, model string, cached boolean, input_tokens long, output_tokens long, latency_seconds double, error string")
    prices = spark.createDataFrame([("m", 3.0, 8.0)], "model string, price_in double, price_out double")
    breaches = spark.createDataFrame([("a", "x"), ("a", "y")], "document string, code string")
    r = K.run_record(K.call_records(calls, prices), breaches).first()
    assert (r["calls"], r["cached"], r["failed"], r["cost_usd"], r["latency_seconds"], r["breaches"], r["documents_with_breaches"]) == (3, 1, 1, 7.0, 3.0, 2, 1)
