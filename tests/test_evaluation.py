"""End-to-end scoring on small documents."""

import pytest

from factloom.plans import derivation as D
from factloom.plans import evaluation as E

SPAN = "struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>"
GOLD = f"document string, field string, state string, alternative_state string, derivation string, rule string, value string, accepted array<string>, evidence array<{SPAN}>, premises array<{SPAN}>"
SAID = f"document string, field string, state string, value string, derivation string, rule string, evidence {SPAN}, premises array<{SPAN}>, seq int"
ITEM = "document string, pos int, name string, cas string, cas_state string, concentration string, evidence "
BOX = (0.1, 0.1, 0.5, 0.2)
TEXT = "Product name: Foo\nFlash point: 61 °C\nChemical description: mixture\nFormula: no data available\nIngredient C.A.S. No. % by Wt\nAluminum 7429-90-5 1~10\nCopper 7440-50-8 1~15"


def span(text, page=1, box=BOX):
    return (page, text, box)


def gold(field, state, value=None, evidence=(), premises=(), derivation="EXPLICIT", rule=None, accepted=(), other=None):
    return ("d", field, state, other, derivation, rule, value, list(accepted), list(evidence), list(premises))


def said(field, state, value=None, evidence=None, premises=(), rule=None, seq=1):
    return ("d", field, state, value, "DERIVED" if rule else "DIRECT", rule, evidence, list(premises), seq)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([("d", 1, TEXT, TEXT), ("d", 2, "", None)], "document string, page int, text string, row_text string")


def scored(spark, pages, golds, claims):
    rows = E.evaluate(spark.createDataFrame(golds, GOLD), spark.createDataFrame(claims, SAID), pages)
    rows = rows.cache()
    return {r["field"]: r for r in rows.collect()}, rows


def axes(row):
    return "".join({"satisfied": "+", "violated": "-", "undecidable": "?", "n/a": "."}[row[a]] for a in E.S.AXES)


def test_axes_of_direct_claims(spark, pages):
    golds = [
        gold("product_name", "PRESENT", "Foo", [span("Product name: Foo")]),
        gold("flash_point", "PRESENT", "60 °C", [span("Flash point: 61 °C")], accepted=["142 °F", "61 °C"]),
        gold("chemical_formula", "NO_DATA", None, [span("Formula: no data available")], other="NOT_APPLICABLE"),
        gold("molecular_weight", "NOT_STATED", derivation="ABSENT"),
        gold("supplier_name", "PRESENT", "Acme", [span("Acme", 2)]),
        gold("product_cas_number", "NOT_STATED", derivation="ABSENT"),
        gold("substance_or_mixture", "PRESENT", "MIXTURE", [span("Chemical description: mixture")]),
    ]
    claims = [
        said("product_name", "NO_DATA", None, span("nothing"), seq=0),
        said("product_name", "PRESENT", "foo", span("Product name: Foo")),
        said("flash_point", "PRESENT", "61 C", span("Flash point: 61 °C", box=(0.1, 0.1, 0.9, 0.9))),
        said("chemical_formula", "NOT_APPLICABLE", None, span("Formula: no data available")),
        said("molecular_weight", "NOT_STATED"),
        said("product_cas_number", "PRESENT", "7440-37-1", span("argon 7440-37-1")),
        said("substance_or_mixture", "PRESENT", "MIXTURE", span("Product name: Foo")),
    ]
    got, rows = scored(spark, pages, golds, claims)
    assert {f: axes(r) for f, r in got.items()} == {
        "product_name": "+++++++",
        "flash_point": "++++-++",
        "chemical_formula": "-++++" + "+-",
        "molecular_weight": "++.....",
        "supplier_name": "-------",
        "product_cas_number": "--....-",
        "substance_or_mixture": "+++-++?",
    }
    assert got["chemical_formula"]["state_lenient"] and not got["supplier_name"]["state_lenient"]
    assert got["supplier_name"]["note"] == "no claim" and not got["product_cas_number"]["verbatim"]
    one = E.summary(rows).first()
    assert (one["n"], one["n_evidence"], one["n_cited"], one["n_verbatim"], one["n_undecidable"]) == (7, 5, 5, 4, 1)
    assert one["joint"] == pytest.approx(2 / 7) and one["joint_evidence"] == pytest.approx(1 / 5)
    assert E.summary(rows.limit(0)).first()["joint"] == 0.0
    by_field = {r["field"]: r for r in E.field_rates(rows).collect()}
    assert by_field["molecular_weight"]["page"] is None and by_field[None]["n"] == 7
    family = E.family_rates(rows, spark.createDataFrame([("d", "f"), ("e", "g")], "document string, template_family string")).collect()
    assert [(r["template_family"], r["documents"], r["instances"]) for r in family] == [("f", 1, 7)]


def test_axes_of_derived_claims(spark, pages):
    lines = TEXT.split("\n")
    premises = [span(lines[4]), span(lines[5], box=(0.1, 0.3, 0.5, 0.4)), span(lines[6], box=(0.1, 0.5, 0.5, 0.6))]
    golds = [
        gold("substance_or_mixture", "PRESENT", "MIXTURE", premises=premises, derivation="COMPOSITION_IMPLIED", rule=D.COMPOSITION_RULE),
        gold("chemical_formula", "NOT_APPLICABLE", premises=[span(lines[2])], derivation="ONTOLOGY", rule=D.IDENTIFIER_RULE),
        gold("molecular_weight", "NOT_APPLICABLE", premises=[span(lines[0])], derivation="ONTOLOGY", rule=D.IDENTIFIER_RULE),
    ]
    claims = [
        said("substance_or_mixture", "PRESENT", "MIXTURE", premises=premises[:2], rule=D.COMPOSITION_RULE),
        said("chemical_formula", "NOT_APPLICABLE", premises=[span(lines[2])], rule=D.IDENTIFIER_RULE),
        said("molecular_weight", "NOT_APPLICABLE", None, span(lines[0])),
    ]
    got, _ = scored(spark, pages, golds, claims)
    assert {f: axes(r) for f, r in got.items()} == {"substance_or_mixture": "+++--+?", "chemical_formula": "+++++++", "molecular_weight": "+++++-?"}
    form = got["substance_or_mixture"]
    assert (form["target_groups"], form["groups_located"], form["note"]) == (2, 1, "premise roles found: 1 of 2")
    assert form["premise_roles_described"] and not got["molecular_weight"]["premise_roles_described"]


def test_ingredients(spark, pages):
    lines = TEXT.split("\n")
    a = spark.createDataFrame(
        [("d", 0, "Aluminum", "7429-90-5", "PRESENT", "1 - 10 %", [span("7429-90-5")]), ("d", 1, "Copper", "7440-50-8", "PRESENT", "1 - 15 %", []), ("d", 2, "Water", None, "NOT_STATED", None, [])],
        ITEM + f"array<{SPAN}>",
    )
    b = spark.createDataFrame(
        [("d", 0, "Water", None, "PRESENT", None, None), ("d", 1, "aluminum", "7429-90-5", "PRESENT", "1~10", span(lines[5])), ("d", 2, "Cu", "7440-50-8", "PRESENT", "1~14", span("Cu", 9)), ("x", 0, "Tin", None, "NOT_STATED", None, None)],
        ITEM + SPAN,
    )
    records = E.evaluate_ingredients(a, b, pages)
    got = {r["gold_pos"]: tuple(r[c] for c in ("predicted_pos", "matched_on", "name_ok", "cas_ok", "concentration_ok", "evidence_ok", "verbatim")) for r in records.collect()}
    assert got == {0: (1, "cas", True, True, True, True, True), 1: (2, "cas", False, True, False, False, False), 2: (0, "name", True, True, True, False, False)}
    blocks = spark.createDataFrame([("d", "PRESENT")], "document string, state string")
    s = E.ingredient_summary(records, a, b, blocks, blocks.where("false")).first()
    assert (s["gold_rows"], s["predicted_rows"], s["matched"], s["records_exact"], s["records_with_evidence"], s["blocks"], s["blocks_agreeing"]) == (3, 3, 3, 2, 1, 1, 0)
    assert s["precision"] == pytest.approx(2 / 3)


def test_notes_and_likeness_of_support(spark, pages):
    form = "Chemical description: mixture"
    golds = [gold(f, "PRESENT", "x", [span("Product name: Foo")]) for f in ("product_name", "supplier_name", "flash_point", "substance_or_mixture", "molecular_weight")]
    golds += [gold("product_cas_number", "NOT_APPLICABLE", premises=[span(form)], derivation="ONTOLOGY", rule=D.IDENTIFIER_RULE), gold("chemical_formula", "NOT_STATED")]
    claims = [
        said("product_name", "PRESENT", "Foo", span("Product name: Foo")),
        said("supplier_name", "PRESENT", "Acme", span("Product name: Fob")),
        said("flash_point", "NO_DATA", None, span("Flash point: 61 °C", box=None)),
        said("substance_or_mixture", "PRESENT", "SUBSTANCE", span(form)),
        said("molecular_weight", "PRESENT", "12 g/mol"),
        said("product_cas_number", "NOT_APPLICABLE", premises=[span(form), span("Formula: no data available")], rule=D.IDENTIFIER_RULE),
        said("chemical_formula", "NOT_STATED", None, span("Product name: Foo")),
    ]
    made = spark.createDataFrame(claims, SAID)
    rows = {r["field"]: r for r in E.evaluate(spark.createDataFrame(golds, GOLD), made, pages, fuzzy=True).collect()}
    notes = {f: (r["support"], r["support_note"]) for f, r in rows.items()}
    assert notes == {
        "product_name": ("satisfied", ""),
        "supplier_name": ("violated", "the citation is not verbatim"),
        "flash_point": ("undecidable", "the citation has no cue of a state"),
        "substance_or_mixture": ("violated", "the citation declares MIXTURE"),
        "molecular_weight": ("violated", "no citation"),
        "product_cas_number": ("satisfied", "premises declare MIXTURE"),
        "chemical_formula": ("violated", "a citation for what is not stated"),
    }
    assert {f: round(r["verbatim_fuzzy_score"], 1) for f, r in rows.items() if r["verbatim_fuzzy_score"]} == {"supplier_name": 97.0}
    assert {f for f, r in rows.items() if r["bbox_provenance"] == "none"} == {"flash_point", "molecular_weight"}
    named = E.evaluate(spark.createDataFrame(golds, GOLD), made.withColumn("bbox_provenance", E.F.lit("derived")), pages).select("bbox_provenance").distinct().collect()
    assert [r[0] for r in named] == ["derived"]


def test_notes_of_rules(spark):
    texts = {
        "a": ["argon 7440-37-1 100 %"],
        "b": ["Chemical description: mixture", "3.1. Substances"],
        "c": ["other words"],
        "d": ["Ingredient C.A.S. No. % by Wt", "aluminum 7429-90-5 1~10", "copper 7440-50-8 1~15"],
    }
    table = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "k string, text string")
    audits = D.audit(table, ["k"])
    note = lambda rule, field, state, value: {r["k"]: r["n"] for r in audits.select("k", D.check_note(E.F.lit(rule), E.F.lit(field), E.F.lit(state), E.F.lit(value), E.F.lit(1)).alias("n")).collect()}
    ident = note(D.IDENTIFIER_RULE, "chemical_formula", "NOT_APPLICABLE", None)
    assert ident["c"] == "no form established; SUBSTANCE lacks sole_constituent 0/1, completeness_statement 0/1" and ident["d"] == "composition shows MIXTURE"
    comp = note(D.COMPOSITION_RULE, "substance_or_mixture", "PRESENT", "MIXTURE")
    assert comp["d"] == "composition shows MIXTURE" and comp["a"].startswith("MIXTURE lacks composition_header 0/1") and comp["b"].startswith("premises declare the form themselves")
    assert set(note("rule_x", "flash_point", "PRESENT", "x").values()) == {"unknown rule rule_x"}
    assert set(note(D.COMPOSITION_RULE, "flash_point", "PRESENT", "x").values()) == {"the rule does not give flash_point PRESENT"}


def test_run_scores_and_reports_ingredients(spark, pages, tmp_path):
    from factloom.plans import runs

    golds = spark.createDataFrame([gold("product_name", "PRESENT", "Foo", [span("Product name: Foo")])], GOLD).withColumn("split", E.F.lit("dev"))
    claims = spark.createDataFrame([said("product_name", "PRESENT", "Foo", span("Product name: Foo"))], SAID)
    want = spark.createDataFrame([("d", 0, "Aluminum", "7429-90-5", "PRESENT", "1~10", [span("Aluminum 7429-90-5 1~10")]), ("d", 1, "Copper", "7440-50-8", "PRESENT", "1~15", [])], ITEM + f"array<{SPAN}>")
    got = spark.createDataFrame([("d", 0, "Aluminum", "7429-90-5", None, "1~10", span("Aluminum 7429-90-5 1~10")), ("z", 0, "Zinc", None, None, None, None)], ITEM + SPAN)
    blocks = spark.createDataFrame([("d", "PRESENT")], "document string, state string")
    items = {"gold": want, "predicted": got, "gold_blocks": blocks, "predicted_blocks": blocks}
    out = runs.evaluate_run(golds, claims, pages, str(tmp_path), run={"system": "s"}, items=items)
    lines = [x for f in (tmp_path / "s_ingredients").glob("part-*") for x in f.read_text().splitlines()]
    assert lines[0] == ",".join(runs.reports.INGREDIENT_COLUMNS) and len(lines) == 2 and lines[1].startswith("d,0,0,cas,Aluminum,Aluminum,1~10,1~10,True,True,True,True,True,True,True")
    one = out["ingredient_summary"].first()
    assert (one["matched"], one["gold_rows"], one["predicted_rows"], one["records_exact"], one["blocks_agreeing"]) == (1, 2, 1, 1, 1)
    shown = [x for f in (tmp_path / "s_instances").glob("part-*") for x in f.read_text().splitlines()]
    assert shown[0].split(",").index("support_note") == 38 and len(shown) == 2


def test_claims_and_gold_meet_without_the_driver(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["evaluate_claims"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
