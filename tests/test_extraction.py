"""Whole-document extraction on small pages."""

from factloom.functions import text as T
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans import derivation as D
from factloom.plans import extraction as P

ROWS = "document string, page int, row_no int, text string"


def rows_of(spark, **documents):
    return spark.createDataFrame([(d, 1, i, t) for d, texts in documents.items() for i, t in enumerate(texts)], ROWS)


def boxed(spark, *lines):
    """Lines of (text, x0, x1) words."""
    data = [("d", 1, i, " ".join(w[0] for w in line), line) for i, line in enumerate(lines)]
    return spark.createDataFrame(data, ROWS + ", words array<struct<text: string, x0: double, x1: double>>")


def test_column_gap_opens_a_slot(spark):
    near = [("Product", 0.1, 0.2), ("name", 0.205, 0.3), ("Foo", 0.305, 0.4)]
    apart = [("1.1", 0.05, 0.08), ("Product", 0.1, 0.2), ("name", 0.205, 0.3), ("Foo", 0.33, 0.4)]
    above, below = [("Supplier", 0.1, 0.2), (":", 0.21, 0.22)], [("Acme", 0.1, 0.2), ("Inc", 0.21, 0.3)]
    got = [(r["row_no"], r["field"], r["label"], r["value"]) for r in P.row_candidates(boxed(spark, near, apart, above, below)).orderBy("row_no").collect()]
    assert got == [(1, "product_name", "product name", "Foo"), (2, "supplier_name", "supplier", "Acme Inc")]


def test_linear_values_run_over_lines(spark):
    rows = rows_of(spark, d=["- Flash point:", "12 °C", "closed cup", "Flash point: 13 °C", "a Flash point: 14 °C", "1 2 Flash point: 15 °C", "Flash point 16"])
    got = [(r["row_no"], r["value"]) for r in P.linear_candidates(rows, fields=("flash_point",)).orderBy("row_no").collect()]
    assert got == [(0, "12 °C closed cup"), (3, "13 °C a")]


def test_documents(spark):
    rows = rows_of(
        spark,
        declared=["Product name: Foo", "Chemical description: Mixture of substances", "CAS No.: not applicable", "Formula: H2O"],
        mixture=["SECTION 3: Composition", "Ingredient C.A.S. No. % by Wt", "Aluminum 7429-90-5 1~10", "Copper 7440-50-8 1~15", "SECTION 4: First aid"],
        pure=["SECTION 3: Composition", "argon 7440-37-1 100", "There are no impurities or stabilizers", "CAS No.: 7440-37-2", "Flash point: does not flash"],
        bare=["nothing here"],
    )
    got = {(r["document"], r["field"]): r for r in P.extract_documents(rows).collect()}
    assert len(got) == 4 * 7
    read = lambda d, f: tuple(got[d, f][c] for c in ("state", "value", "derivation", "rule"))
    ident, comp = "identifier_undefined_for_form", "composition_implies_form"
    assert read("declared", "product_name") == ("PRESENT", "Foo", "DIRECT", None)
    assert read("declared", "substance_or_mixture") == ("PRESENT", "MIXTURE", "DIRECT", None)
    assert got["declared", "substance_or_mixture"]["evidence"]["row_no"] == 1
    assert read("declared", "product_cas_number") == ("NOT_APPLICABLE", None, "DIRECT", None)
    assert read("declared", "chemical_formula") == ("NOT_APPLICABLE", None, "DERIVED", ident)
    assert [p["row_no"] for p in got["declared", "chemical_formula"]["premises"]] == [1]
    assert read("declared", "flash_point") == ("NOT_STATED", None, "DIRECT", None)
    assert read("mixture", "substance_or_mixture") == ("PRESENT", "MIXTURE", "DERIVED", comp)
    assert [p["row_no"] for p in got["mixture", "substance_or_mixture"]["premises"]] == [1, 2, 3]
    assert read("mixture", "molecular_weight") == ("NOT_APPLICABLE", None, "DERIVED", ident)
    assert read("pure", "substance_or_mixture") == ("PRESENT", "SUBSTANCE", "DERIVED", comp)
    assert read("pure", "product_cas_number") == ("PRESENT", "7440-37-2", "DIRECT", None)
    assert got["pure", "product_cas_number"]["rationale"] == "CAS check digit failed"
    assert read("pure", "flash_point") == ("NOT_APPLICABLE", None, "DIRECT", None)
    assert {got["bare", f]["state"] for d, f in got if d == "bare"} == {"NOT_STATED"}


def test_gold_problems(spark):
    gold = spark.createDataFrame(
        [
            ("d", "MIXTURE", "flash_point", "PRESENT", "EXPLICIT", None, "61 C", 1),
            ("d", "MIXTURE", "molecular_weight", "PRESENT", "ONTOLOGY", None, None, 0),
            ("d", "MIXTURE", "substance_or_mixture", "NOT_STATED", "EXPLICIT", "r", "x", 1),
            ("d", "MIXTURE", "chemical_formula", "NOT_APPLICABLE", "ONTOLOGY", D.IDENTIFIER_RULE, None, 1),
            ("d", "MIXTURE", "colour", "PRESENT", "EXPLICIT", None, "red", 1),
        ],
        "document string, product_form string, field string, state string, derivation string, rule string, value string, n_evidence int",
    )
    got = {r["field"]: r["p"] for r in gold.select("field", D.gold_problems().alias("p")).collect()}
    assert got["flash_point"] == got["chemical_formula"] == []
    assert got["molecular_weight"] == ["no_evidence", "ontology_state", "present_but_undefined", "present_without_value", "rule_not_registered"]
    assert got["substance_or_mixture"] == ["evidence_on_not_stated", "form_not_stated", "not_stated_not_absent", "rule_on_underived", "value_without_present"]
    assert got["colour"] == ["unknown_field"]
    assert {r["field"] for r in D.missing_fields(gold).collect()} == {"product_name", "supplier_name", "product_cas_number"}


def test_confidence_and_blocks(spark):
    rows = [("a", 1, 0, "Flash point: 61 C", 80.0), ("a", 1, 1, "SECTION 3: Composition", 90.0), ("a", 1, 2, "Name CAS No. % by Wt", 90.0), ("a", 1, 3, "argon 7440-37-1 100", 90.0), ("b", 1, 0, "Flash point: 61 C", None)]
    table = spark.createDataFrame(rows, "document string, page int, row_no int, text string, confidence double")
    got = {r["document"]: r["confidence"] for r in P.extract_documents(table).where("field = 'flash_point'").collect()}
    assert got == {"a": 0.85, "b": 0.9}
    blocks = {r["document"]: (r["state"], r["evidence"] and r["evidence"]["row_no"]) for r in P.ingredient_blocks(table).collect()}
    assert blocks == {"a": ("PRESENT", 2), "b": ("NOT_STATED", None)}
    words = spark.createDataFrame([("a", 0, 90.0), ("a", 0, 70.0), ("a", 0, -1.0), ("a", 1, -1.0)], "document string, row_no int, confidence double")
    assert {r["row_no"]: r["confidence"] for r in P.row_confidence(words, ["document", "row_no"]).collect()} == {0: 80.0, 1: None}


def test_no_table_of_a_document_goes_through_the_driver(spark):
    rows = spark.createDataFrame([(1, 1, 0, "Product name: Acid"), (1, 1, 1, "3.2 Mixtures"), (2, 1, 0, "Flash point: 20 C")], "document long, page int, row_no int, text string")
    for layout in P.LAYOUTS:
        claims = P.extract_documents(rows, layout)
        assert "Broadcast" not in claims._jdf.queryExecution().executedPlan().toString()
    got = {(r["document"], r["field"]): (r["value"], r["evidence"] and r["evidence"]["text"]) for r in P.extract_documents(rows).where("state = 'PRESENT'").collect()}
    assert got == {(1, "product_name"): ("Acid", "Product name: Acid"), (1, "substance_or_mixture"): ("MIXTURE", "3.2 Mixtures"), (2, "flash_point"): ("20 C", "Flash point: 20 C")}


def test_white_space_class_is_that_of_the_contract(spark):
    wide = {*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    texts = spark.createDataFrame([(i, f"a{chr(i)}b") for i in (*range(1, 0x3100), 0xFEFF)], "id int, t string")
    assert {r["id"] for r in texts.where(F.regexp_replace("t", T.SPACE, " ") == "a b").collect()} == wide
