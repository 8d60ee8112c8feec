"""Literal expectations of the column functions."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import cues as Q
from factloom.functions import geometry as G
from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import search


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize(
    ("page", "quote", "found"),
    [("Flash Point: 61 ºC", "flash  point: 61 °C", True), ("Flash Point: 61 °C", "Flash Point: 62 °C", False), ("61 °C\nBoiling point", "61 °C Boiling poin", True), ("a", "", False), ("ﬁne™ print", "fine print", True)],
)
def test_verbatim(spark, page, quote, found):
    assert one(spark, search.on_page(lit(page), lit(page), lit(quote))) is found


def test_positions_overlap_and_nth(spark):
    assert one(spark, search.positions(lit("aaaa"), lit("aa"))) == [0, 1, 2]
    assert one(spark, search.nth_position(lit("abab"), lit("ab"), 2)) == 2
    assert one(spark, search.nth_position(lit("abab"), lit("ab"), 3)) is None
    assert one(spark, search.positions(lit("a"), lit(""))) == []


def test_offsets_map_back(spark):
    text = "  A ﬁ™ b  "
    places = one(spark, search.offsets(lit(text)))
    form = one(spark, T.search_form(lit(text)))
    assert form == "a fi b"
    assert len(places) == len(form) and places == [2, 3, 4, 4, 6, 7]


@pytest.mark.parametrize(("said", "gold", "matched", "coverage"), [("Flash Point: 610 °C", "Flash Point: 61 °C", 2, 0.5), ("flash", "Flash Point: 61 °C", 1, 0.25), ("x (Flash Point: 61 °C).", "Flash Point: 61 °C", 4, 1.0), ("", "a", 0, 0.0)])
def test_span_overlap(spark, said, gold, matched, coverage):
    got = one(spark, T.span_overlap(lit(said), lit(gold)))
    assert (got["matched"], got["coverage"]) == (matched, coverage)


def test_values(spark):
    assert one(spark, V.values_equal(lit(">=290 ºF"), lit(">=143.3 C"), "temperature", 0.6)) is True
    assert one(spark, V.values_equal(lit("F3CCH2 F"), lit("F3CCH2F"), "formula")) is True
    assert one(spark, V.parse_temperature(lit("10-20 °C")))["value"] == -20.0
    assert one(spark, V.parse_temperature(lit("61"))) is None
    assert one(spark, V.parse_quantity(lit("below 98,08 g/mol"))).asDict() == {"value": 98.08, "unit": "g/mol", "comparator": "<"}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("20~60", "20 - 60", True), ("1 - <10 %", "1-<10", True), ("NMT 10", "≤ 10", True), ("100", "100 %", True), ("60% ~ 70%", "60 - 70", True), ("< 20", "≤ 20", False), ("1~10", "1~15", False), (None, "", True), ("1", None, False)],
)
def test_concentrations(spark, a, b, same):
    assert one(spark, V.concentrations_equal(lit(a), lit(b))) is same


def test_concentration_none(spark):
    assert one(spark, V.parse_concentration(lit("none"))) is None


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("3.1. Substances", "SUBSTANCE"), ("Substances or 3.2 Mixtures", None), ("Substance name: sodium chloride CAS No.: 7647-14-5", None), ("Mixtures Composition Comments: …", "MIXTURE"),
        ("Substance/mixture : Substance", "SUBSTANCE"), ("Substance or preparation: Preparation", "MIXTURE"), ("3.1. Substances Not applicable", "MIXTURE"), ("Substance: Non-applicable", "MIXTURE"),
        ('this is defined by OSHA as an "article."', "ARTICLE"), ("not a hazardous substance or mixture", None), ("Ingredient C.A.S. No. % by Wt", None), ("", None),
    ],
)
def test_form_cue(spark, text, form):
    assert one(spark, Q.form_cue(lit(text))) == form


@pytest.mark.parametrize(("text", "state"), [("No applicable data available", "NO_DATA"), ("n/a", "NOT_APPLICABLE"), ("naphthalene", None), ("Flash point : –", "NO_DATA"), ("see Section 5", None), ("", None)])
def test_state_cue(spark, text, state):
    assert one(spark, Q.state_cue(lit(text))) == state


def test_names_and_numbers(spark):
    assert one(spark, T.names_equal(lit("M. pseudotuber- culosis Inc."), lit("m. pseudotuberculosis inc"))) is True
    assert one(spark, T.names_equal(lit(None), lit("a"))) is False
    assert one(spark, T.cas_valid(lit("7647–14–5"))) is True
    assert one(spark, T.cas_valid(lit("7647-14-6"))) is False
    assert one(spark, T.cas_valid(lit(None))) is False


def test_boxes(spark):
    box = lambda *v: G.box(*map(F.lit, map(float, v)))
    got = one(spark, G.containment(box(0, 0, 1, 0.1), box(0.2, 0, 0.4, 0.1)))
    assert got["coverage"] == pytest.approx(1.0) and got["dilution"] == pytest.approx(5.0)
    assert one(spark, G.iou(box(0, 0, 1, 1), box(1, 0, 2, 1))) == 0.0
    none = F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>")
    assert one(spark, G.iou(none, box(0, 0, 1, 1))) == 0.0


def test_field_defined(spark):
    assert one(spark, Q.field_defined(lit("chemical_formula"), lit("MIXTURE"))) is False
    assert one(spark, Q.field_defined(lit("flash_point"), lit("MIXTURE"))) is True


def test_sections_of_fields(spark):
    rows = spark.createDataFrame([("flash_point",), ("chemical_formula",), ("colour",), (None,)], "field string")
    got = [r[0] for r in rows.select(Q.typical_sections(F.col("field"))).collect()]
    assert got == [["9.1"], ["1.1", "3.1", "9.1"], [], []]
    assert set(Q.SECTIONS) == {name for name, *_ in Q.FIELDS}
