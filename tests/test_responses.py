"""Model responses on one small document."""

import json

from test_evaluation import TEXT

from factloom.plans import derivation as D
from factloom.plans import responses as M


def field(state="NOT_STATED", value=None, derivation="DIRECT", rule=None, evidence=None, premises=()):
    cite = lambda c: c and {"page": c[0], "quote": c[1]}
    return {"state": state, "value": value, "derivation": derivation, "rule": rule, "evidence": cite(evidence), "premises": [cite(p) for p in premises]}


def test_responses(spark):
    answer = {name: field() for name, *_ in M.Q.FIELDS}
    answer["product_name"] = field("PRESENT", "Foo", evidence=(1, "product  NAME: foo"))
    answer["supplier_name"] = field("NO_DATA", "x", evidence=(0, "nowhere"))
    answer["flash_point"] = field("NOT_STATED", evidence=(1, "Flash point: 61 °C"))
    answer["chemical_formula"] = field("NOT_APPLICABLE", None, "DERIVED", D.IDENTIFIER_RULE, None, [(1, "Chemical description: mixture")])
    answer["molecular_weight"] = field("NOT_APPLICABLE", None, "DERIVED", "guess", None, [(1, "Product name: Foo")])
    answer["product_cas_number"] = field("NOT_APPLICABLE", None, "DERIVED", D.IDENTIFIER_RULE, (1, "Foo"), [(1, "Product name: Foo")])
    answer |= {"ingredients_state": "PRESENT", "ingredients": [{"name": "Copper", "cas_number": "7440-50-8", "cas_state": "PRESENT", "concentration": "1~15", "citation": {"page": 1, "quote": "Copper 7440-50-8"}}]}
    fenced = "```json\n" + json.dumps(answer) + "\n```"
    responses = spark.createDataFrame([("d", fenced), ("e", None), ("f", '{"product_name": 3}'), ("g", "no json")], "document string, content string")
    words = [(0, 7, (0.1, 0.1, 0.2, 0.2)), (8, 13, (0.3, 0.1, 0.4, 0.2)), (14, 17, (0.5, 0.1, 0.6, 0.2)), (18, 30, (0.1, 0.3, 0.2, 0.4))]
    pages = spark.createDataFrame([("d", 1, TEXT, TEXT, words)], "document string, page int, text string, row_text string, words array<struct<start: int, end: int, box: struct<x0: double, y0: double, x1: double, y1: double>>>")
    got = {r["field"]: r for r in M.claims(responses, pages).collect()}
    name = got["product_name"]
    assert (name["state"], name["value"], name["evidence"]["text"], tuple(name["evidence"]["box"]), name["codes"]) == ("PRESENT", "Foo", "Product name: Foo", (0.1, 0.1, 0.6, 0.2), [])
    supplier = got["supplier_name"]
    assert (supplier["value"], supplier["evidence"]["page"], supplier["evidence"]["text"], supplier["codes"]) == (None, 1, "nowhere", ["quote_not_verbatim", "state_carries_value"])
    assert (got["flash_point"]["evidence"], got["flash_point"]["codes"]) == (None, ["not_stated_with_citation"])
    assert (got["chemical_formula"]["derivation"], got["chemical_formula"]["codes"], len(got["chemical_formula"]["premises"])) == ("DERIVED", [], 1)
    weight = got["molecular_weight"]
    assert (weight["derivation"], weight["rule"], weight["evidence"]["text"], weight["codes"]) == ("DIRECT", None, "Product name: Foo", ["derived_unknown_rule"])
    assert got["product_cas_number"]["codes"] == ["derived_premise_set_incomplete", "derived_with_direct_evidence"]
    item = M.ingredient_claims(responses, pages).first()
    assert (item["cas"], item["evidence"]["text"], item["codes"]) == ("7440-50-8", "Copper 7440-50-8", [])
    counts = {r["code"]: r["n"] for r in M.breach_counts(M.breaches(responses, pages)).collect()}
    assert len(counts) == 14 and sum(counts.values()) == 9 and counts["schema_invalid"] == 2 and counts["no_structured_output"] == 1
    user = M.messages(pages).first()["user"]
    assert user.startswith("Document: d\n[page 1]\nProduct name: Foo")
