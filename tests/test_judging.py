"""Evidence sets, judged cases and their statistics."""

from factloom.operators import retrieval as R


def test_evidence_sets(spark):
    span = "array<struct<page: int, text: string>>"
    gold = spark.createDataFrame(
        [("d", "flash_point", "PRESENT", "EXPLICIT", [(1, "a")], None), ("d", "chemical_formula", "NOT_APPLICABLE", "ONTOLOGY", [], [(1, "a"), (2, "b")]), ("d", "molecular_weight", "NOT_STATED", "ABSENT", None, None), ("d", "ingredients", "PRESENT", "EXPLICIT", [(1, "a")], None)],
        f"document string, field string, state string, derivation string, evidence {span}, premises {span}",
    )
    sets = R.evidence_sets(gold)
    got = {r["field"]: ([p["kind"] for p in r["pieces"]], r["n_pages"], r["cross_page"]) for r in sets.collect()}
    assert got == {"flash_point": (["direct"], 1, False), "chemical_formula": (["premise", "premise"], 2, True), "molecular_weight": ([], 0, False)}
    assert {r["field"] for r in R.rankable(sets).collect()} == {"flash_point", "chemical_formula"}


def test_cases_and_stats(spark):
    rows = [("a", "x", "ONTOLOGY", True, [0.1, 0.2]), ("b", "x", "ONTOLOGY", True, [0.2, 0.0]), ("c", "x", "ONTOLOGY", False, [0.9]), ("d", "x", "COMPOSITION_IMPLIED", False, [0.0]), ("e", "x", "EXPLICIT", False, [0.9, 0.8]), ("f", "x", "EXPLICIT", False, [0.8]), ("g", "x", "EXPLICIT", False, [0.99, 0.4])]
    scored = spark.createDataFrame(rows, "document string, field string, derivation string, cross_page boolean, piece_scores array<double>")
    got = {r["stratum"]: (r["n"], r["document"], r["score"]) for r in R.case_picks(scored).collect()}
    assert got == {"ontology_cross_page": (2, "a", 0.2), "composition_implied": (1, "d", 0.0), "contrast": (2, "f", 0.8)}
    pages = spark.createDataFrame(
        [("a", "x", 1, "ONTOLOGY", True, 0.0), ("a", "x", 2, "ONTOLOGY", False, 0.0), ("b", "x", 1, "ONTOLOGY", True, 0.6), ("e", "x", 1, "EXPLICIT", True, 1.0), ("e", "x", 2, "EXPLICIT", True, 0.4), ("e", "x", 3, "EXPLICIT", False, 1.5)],
        "document string, field string, page int, derivation string, is_gold boolean, score double",
    )
    s = R.judge_stats(pages).first()
    assert (s["explicit_pages"], s["explicit_share_low"], s["explicit_median"]) == (2, 0.5, 0.7)
    assert (s["derived_pages"], s["derived_share_low"], s["derived_median"], s["derived_all_zero"]) == (2, 0.5, 0.3, 1)
    assert (s["pages"], s["below_0"], s["above_1"], s["zeros"], s["ones"]) == (6, 0, 1, 2, 1)
