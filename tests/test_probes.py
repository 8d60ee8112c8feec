"""Oracle flags and probes on one small document."""

import pytest
from test_evaluation import GOLD, SPAN, TEXT, gold, span

from factloom.plans import derivation as D
from factloom.plans import probes as B

FORM = "Chemical description: mixture"


@pytest.fixture
def layer(spark):
    pages = spark.createDataFrame([("d", 1, TEXT, TEXT), ("d", 2, "Supplier:\nAcme Inc", "Supplier: Acme Inc")], "document string, page int, text string, row_text string")
    rows = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(TEXT.split("\n"))] + [("d", 2, 0, "Supplier: Acme Inc")], "document string, page int, row_no int, text string")
    return pages, rows


@pytest.fixture
def golds(spark):
    made = [
        gold("product_name", "PRESENT", "Foo", [span("Product name: Foo")]),
        gold("supplier_name", "PRESENT", "Acme Ltd", [span("Supplier: Acme Inc", 2)], accepted=["Acme Inc"]),
        gold("flash_point", "PRESENT", "142 °F", [span("Flash point: 61 °C")]),
        gold("chemical_formula", "NO_DATA", None, [span("Formula: no data available")]),
        gold("molecular_weight", "NOT_APPLICABLE", premises=[span(FORM)], derivation="ONTOLOGY", rule=D.IDENTIFIER_RULE),
        gold("product_cas_number", "NOT_STATED", derivation="ABSENT"),
    ]
    return spark.createDataFrame([(*g, "MIXTURE") for g in made], GOLD + ", product_form string")


def test_oracle_flags(spark, golds, layer):
    got = {r["field"]: r for r in B.oracle_flags(golds, layer[0]).collect()}
    flags = {f: (r["value_exact"], r["value_typed"], r["value_pages"], r["value_on_gold_page"], r["span_exact"]) for f, r in got.items()}
    assert flags["product_name"] == (True, True, [1], True, True)
    assert flags["supplier_name"] == (True, True, [2], True, True)
    assert flags["flash_point"] == (False, True, [], False, True) and got["flash_point"]["note"] == "value not found"
    assert flags["chemical_formula"] == (None, None, None, None, True)
    assert flags["product_cas_number"] == (None,) * 5
    items = spark.createDataFrame([("d", 0, "7429-90-5", []), ("d", 1, None, []), ("e", 0, "7440-50-8", [])], f"document string, pos int, cas string, evidence array<{SPAN}>")
    cas = {(r["document"], r["field"]): r["value_exact"] for r in B.oracle_flags(B.ingredient_fields(items), layer[0]).collect()}
    assert cas == {("d", "ingredient_cas[0]"): True, ("e", "ingredient_cas[0]"): False}
    fuzzy = {r["field"]: (r["value_fuzzy"], r["span_fuzzy"]) for r in B.fuzzy_flags(golds, layer[0]).collect()}
    assert fuzzy["product_name"] == (True, True) and fuzzy["flash_point"][0] is False


def test_probes(spark, golds, layer):
    claims = {r["field"]: r for r in B.gold_value_claims(golds, *layer).collect()}
    assert claims["product_name"]["evidence"]["text"] == "Product name: Foo"
    assert (claims["supplier_name"]["evidence"]["page"], claims["supplier_name"]["evidence"]["text"]) == (2, "Supplier:\nAcme Inc")
    assert claims["chemical_formula"]["evidence"]["text"] == "Formula: no data available"
    assert [p["text"] for p in claims["molecular_weight"]["premises"]] == [FORM]
    assert "flash_point" not in claims and "product_cas_number" not in claims
    read = {r["field"]: (r["state"], r["value"]) for r in B.gold_evidence_claims(golds).collect()}
    assert read == {
        "product_name": ("PRESENT", "Foo"),
        "supplier_name": ("PRESENT", "Acme Inc"),
        "flash_point": ("PRESENT", "61 °C"),
        "chemical_formula": ("NO_DATA", None),
        "molecular_weight": ("NOT_APPLICABLE", None),
    }
    rates = {r["probe"]: (r["n"], r["claims"], r["passed"]) for r in B.probe_rates(B.run_probes(golds, *layer)).collect()}
    # The flash point in Fahrenheit is nowhere in the text; cited lines have no boxes here.
    assert rates == {"gold_value": (5, 4, 0), "gold_evidence": (5, 5, 5), "gold_verify": (5, 5, 4)}


def test_oracle_rows(spark, golds, layer):
    ocr = layer[0].where("page = 1")
    rows = {r["field"]: r for r in B.oracle_rows(golds, layer[0], ocr).collect()}
    one = rows["supplier_name"]
    assert one.__fields__ == list(B.ORACLE_COLUMNS) and len(one) == 21
    assert (one["value_exact_native"], one["value_exact_ocr"], one["value_located_pages_native"], one["value_on_gold_page_ocr"], one["span_exact_ocr"]) == ("yes", "no", "2", "no", "no")
    assert one["note"] == "value not found on ocr; span not found on ocr"
    assert rows["product_cas_number"]["value_exact_native"] == "" == rows["product_cas_number"]["note"]
    bare = {r["field"]: r for r in B.oracle_rows(golds, layer[0]).collect()}
    assert bare["product_name"]["value_exact_native"] == "yes" and bare["product_name"]["value_exact_ocr"] == "" and bare["product_name"]["span_fuzzy_ocr"] == ""
    table = B.oracle_rows(golds, layer[0], ocr)
    told = {(r["part"], r["flag"]): (r["yes"], r["decided"]) for r in B.oracle_summary(table).collect()}
    assert told["product", "value_exact_native"] == (2, 3) and told["product", "value_exact_ocr"] == (1, 3) and told["premise", "span_exact_native"] == (1, 1)
    assert {tuple(r) for r in B.oracle_misses(table).collect()} == {("d", "flash_point", "native"), ("d", "flash_point", "ocr"), ("d", "supplier_name", "ocr")}
