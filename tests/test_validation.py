"""Nested validation of predictions: literal cases by path, unreadable records, strict reading."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import contracts as K
from factloom.operators import validation as V


def span(**more):
    return {"page": 1, "text": "x", "bbox": None, "bbox_provenance": "system"} | more


def claim(**more):
    return {"state": "PRESENT", "value": "v", "evidence": span(), "derivation": "DIRECT", "rule": None, "premises": [], "confidence": 0.5} | more


CASES = {
    "good": (claim(), []),
    "edge": (claim(evidence=span(bbox=[-0.01, 0, 1.01, 0])), []),
    "silent": (claim(state="NOT_STATED", value=None, evidence=None), []),
    "derived": (claim(derivation="DERIVED", rule="r", evidence=None, premises=[span()]), []),
    "value": (claim(state="NO_DATA"), [("", "value_without_present")]),
    "cited": (claim(state="NOT_STATED", value=None), [("", "citation_on_not_stated")]),
    "state": (claim(state="MAYBE", value=None), [(".state", "unknown_value")]),
    "no_state": (claim(state=None, value=None), [(".state", "missing")]),
    "confident": (claim(confidence=1.5), [(".confidence", "out_of_range")]),
    "page": (claim(evidence=span(page=0)), [(".evidence.page", "page_number")]),
    "text": (claim(evidence=span(text=None)), [(".evidence.text", "missing")]),
    "short": (claim(evidence=span(bbox=[0, 0, 1])), [(".evidence.bbox", "box_size")]),
    "wide": (claim(evidence=span(bbox=[0, 0, 1.2, 1])), [(".evidence.bbox", "box_range")]),
    "turned": (claim(evidence=span(bbox=[0.5, 0, 0.4, 1])), [(".evidence.bbox", "box_order")]),
    "source": (claim(evidence=span(bbox_provenance="guess")), [(".evidence.bbox_provenance", "unknown_value")]),
    "ruled": (claim(rule="r", premises=[span()]), [("", "direct_with_rule"), ("", "direct_with_premises")]),
    "bare": (claim(derivation="DERIVED", premises=None), [("", "derived_without_rule"), ("", "derived_without_premise"), ("", "derived_with_evidence")]),
    "second": (claim(derivation="DERIVED", rule="r", evidence=None, premises=[span(), span(page=-1, bbox=[1, 1, 0, 0])]), [(".premises[1].page", "page_number"), (".premises[1].bbox", "box_order")]),
}


def write(path, record):
    path.write_text(json.dumps(record))
    return str(path)


def test_every_rule_by_path(spark, tmp_path):
    fields = {name: c for name, (c, _) in CASES.items()}
    items = {"state": "PRESENT", "evidence": None, "items": [{"cas_state": "PRESENT", "evidence": span()}, {"cas_state": "NEVER", "evidence": span(page=0)}]}
    record = {"system": "s", "configuration": {"split": "dev"}, "documents": [{"document": "a", "fields": fields}, {"document": None, "fields": {}, "ingredients": items}]}
    docs, off = V.read_checked(spark, write(tmp_path / "p.json", record))
    got = sorted((r["document"] or "", r["path"], r["code"]) for r in off.collect())
    want = [("a", f"fields.{name}{path}", code) for name, (_, found) in CASES.items() for path, code in found]
    want += [("", "document", "missing"), ("", "ingredients.items[1].cas_state", "unknown_value"), ("", "ingredients.items[1].evidence.page", "page_number")]
    assert got == sorted(want) and docs.count() == 2
    with pytest.raises(K.PredictionSetError, match=r"fields\.bare: derived_with_evidence"):
        V.assert_valid(off.where("document = 'a'"))


def test_good_and_unreadable_files(spark, tmp_path):
    good = {"system": "s", "configuration": {}, "documents": [{"document": "a", "fields": {"product_name": claim()}}]}
    docs, off = V.read_checked(spark, write(tmp_path / "g.json", good))
    V.assert_valid(off)
    assert docs.select("d.document").first()[0] == "a"
    lines = tmp_path / "l.jsonl"
    lines.write_text("\n".join([json.dumps(good), "{not json", json.dumps(good | {"system": None}), json.dumps(good | {"documents": "none"})]))
    docs, off = V.read_checked(spark, str(lines), multi_line=False)
    codes = sorted((r["code"], r["path"][:9]) for r in off.collect())
    assert docs.count() == 2 and codes == [("missing", "system"), ("unreadable", '{"system"'), ("unreadable", "{not json")]
    empty = spark.createDataFrame([], "b array<double>")
    assert empty.select(F.explode(V.problems({"b": V._BOX}, F.struct("b")))).count() == 0
