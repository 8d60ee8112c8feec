"""References to spans: occurrences, case, OCR places, problems, gold building and whole runs."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import contracts as K
from factloom.operators import search
from factloom.plans import evaluation as E
from factloom.plans import resolution as N
from factloom.plans import runs

WORDS = "array<struct<start: int, end: int, box: struct<x0: double, y0: double, x1: double, y1: double>>>"


def page_of(spark, texts):
    rows = []
    for document, page, text in texts:
        words, at = [], 0
        for n, line in enumerate(text.split("\n")):
            for i, w in enumerate(line.split(" ")):
                if w:
                    words.append((at, at + len(w), (0.1 + 0.07 * i, 0.1 * n, 0.16 + 0.07 * i, 0.1 * n + 0.01)))
                at += len(w) + 1
        rows.append((document, page, text, text, words))
    return spark.createDataFrame(rows, f"document string, page int, text string, row_text string, words {WORDS}")


@pytest.fixture(scope="module")
def pages(spark):
    return page_of(spark, [("a", 1, "Flash Point: 61 ºC\nflash point: 61 °C again\nFLASH POINT"), ("a", 2, "Chemical description: Mixture of substances"), ("b", 1, "   ")]).persist()


def test_resolve(spark, pages):
    refs = [
        ("a", 1, "flash point", 1, False), ("a", 1, "flash point", 3, False), ("a", 1, "flash point", 1, True), ("a", 1, "flash point", 4, False),
        ("a", 1, "61 °C", 2, False), ("a", 1, "absent", 1, False), ("a", 7, "x", 1, False), ("b", 1, "", 1, False), ("a", 1, "FLASH POINT", 2, True),
    ]
    cited = spark.createDataFrame([(*r, i) for i, r in enumerate(refs)], "document string, page int, text string, occurrence int, case_sensitive boolean, nr int")
    got = {r["nr"]: r for r in N.resolve(cited, pages).collect()}
    spans = {i: (r["span"]["text"], r["span"]["char_start"], r["occurrences"]) for i, r in got.items() if r["span"]}
    assert spans == {0: ("Flash Point", 0, 3), 1: ("FLASH POINT", 44, 3), 2: ("flash point", 19, 1), 4: ("61 °C", 32, 2)}
    assert got[3]["problem"] == "occurrence 4 of 3" and got[5]["problem"] == "not verbatim on page 1" and got[6]["problem"] == "no page 7" and got[7]["problem"] and got[8]["problem"] == "occurrence 2 of 1"
    box = got[0]["span"]["box"]
    assert (round(box["x0"], 2), round(box["x1"], 2), box["y0"]) == (0.1, 0.23, 0.0)
    for i in (0, 1, 2, 4):
        s = got[i]["span"]
        text = pages.where("document = 'a' and page = 1").first()["text"]
        assert text[s["char_start"] : s["char_end"]] == s["text"]


def test_resolve_on_ocr(spark, pages):
    ocr = page_of(spark, [("a", 1, "Flash Po1nt: 61 C\nflash point: 61 °C agaln")])
    cited = spark.createDataFrame([("a", 1, "61 °C again", 1, False, 0), ("a", 1, "flash point", 1, False, 1), ("a", 2, "Mixture", 1, False, 2)], "document string, page int, text string, occurrence int, case_sensitive boolean, nr int")
    got = {r["nr"]: r for r in N.resolve(cited, pages, ocr).collect()}
    assert got[1]["ocr_exact"] and got[1]["ocr_score"] == 100 and got[1]["ocr_char_start"] == 18
    assert not got[0]["ocr_exact"] and 85 <= got[0]["ocr_score"] < 100 and got[0]["ocr_box"]
    assert got[2]["span"] and got[2]["ocr_score"] is None and got[2]["ocr_box"] is None


FIELD = f"document string, split string, product_form string, field string, state string, derivation string, rule string, value string, evidence {N.REFERENCES}"


def fields_of(spark, flash="61 ºC", extra=()):
    ref = lambda page, text, n=1: [(page, text, n, False)]
    rows = [
        ("flash_point", "PRESENT", "EXPLICIT", None, flash, ref(1, "Flash Point: 61 ºC")),
        ("substance_or_mixture", "PRESENT", "EXPLICIT", None, "MIXTURE", ref(2, "Chemical description: Mixture of substances")),
        ("chemical_formula", "NOT_APPLICABLE", "ONTOLOGY", "identifier_undefined_for_form", None, ref(2, "Mixture")),
        ("product_cas_number", "NOT_APPLICABLE", "ONTOLOGY", "identifier_undefined_for_form", None, ref(2, "Chemical description: Mixture of substances")),
        ("molecular_weight", "NOT_APPLICABLE", "ONTOLOGY", "identifier_undefined_for_form", None, ref(2, "Mixture")),
        ("product_name", "NOT_STATED", "ABSENT", None, None, []),
        ("supplier_name", "NOT_STATED", "ABSENT", None, None, None),
        *extra,
    ]
    return spark.createDataFrame([("a", "dev", "MIXTURE", *r) for r in rows], FIELD)


def test_premise_references_inherit_the_form(spark):
    got = {r["field"]: [x["text"] for x in r["refs"]] for r in N.premise_references(fields_of(spark)).collect()}
    whole = "Chemical description: Mixture of substances"
    assert got["chemical_formula"] == ["Mixture", whole] and got["product_cas_number"] == [whole] and got["flash_point"] == ["Flash Point: 61 ºC"] and got["supplier_name"] == []


def test_gold_and_its_report(spark, pages):
    gold, problems = N.build_gold(fields_of(spark), pages)
    assert problems.count() == 0
    rows = {r["field"]: r for r in gold.collect()}
    assert [p["text"] for p in rows["chemical_formula"]["premises"]] == ["Mixture", "Chemical description: Mixture of substances"] and rows["chemical_formula"]["evidence"] == []
    assert rows["flash_point"]["evidence"][0]["char_start"] == 0 and rows["flash_point"]["premises"] == []
    told = {r["field"]: r["verifiable"] for r in N.premise_verifiable(gold).collect()}
    assert told["chemical_formula"] is True and told["flash_point"] is None
    report = {(r["what"], r["name"]): r["n"] for r in N.gold_report(gold).collect()}
    assert report["state", "NOT_APPLICABLE"] == 3 and report["spans", "premise_spans"] == 5 and report["rules", "unverifiable"] == 0 and report["spans", "ambiguous_spans"] == 1
    assert report["rules", "ungrouped"] == 0 and report["role_sets", "1x form_declaration"] == 3
    assert N.span_offsets_off(gold, pages).count() == 0
    assert N.load_gold(fields_of(spark), pages, split="locked").count() == 0


def test_role_cover(spark):
    """Roles that premises fill together, the least number of them that does, and sets that fall short of their rule."""
    header, part, other, whole, done = "Ingredient C.A.S. No. % by Wt", "aluminum 7429-90-5 1~10", "copper 7440-50-8 1~15", "argon 7440-37-1 100 %", "There are no impurities or stabilizers"
    comp, ident = "composition_implies_form", "identifier_undefined_for_form"
    cases = {
        "mix": (comp, "MIXTURE", [header, part, other]),
        "short": (comp, "MIXTURE", [header, part]),
        "pure": (comp, "SUBSTANCE", [whole, done, whole]),
        "told": (ident, None, ["Chemical description: mixture", "nothing here"]),
        "none": (ident, None, []),
        "words": (ident, None, ["only words"]),
    }
    kind = "array<struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>"
    gold = spark.createDataFrame([(d, "f", "ONTOLOGY" if r == ident else "COMPOSITION_IMPLIED", r, v, [(1, t, None) for t in ts]) for d, (r, v, ts) in cases.items()], f"document string, field string, derivation string, rule string, value string, premises {kind}")
    got = {r["document"]: (r["roles"], r["minimal"], r["grouped"], r["needs"]) for r in N.role_cover(gold).collect()}
    assert got == {
        "mix": (["composition_header", "partial_constituent"], 2, True, "1x composition_header + 2x partial_constituent"),
        "short": (["composition_header", "partial_constituent"], 2, False, None),
        "pure": (["sole_constituent", "completeness_statement"], 2, True, "1x sole_constituent + 1x completeness_statement"),
        "told": (["form_declaration"], 1, True, "1x form_declaration"),
        "none": ([], 0, False, None),
        "words": ([], 0, False, None),
    }


def test_gold_problems_raise(spark, pages):
    broken = fields_of(spark).withColumn("evidence", F.when(F.col("field") == "flash_point", F.array(F.struct(F.lit(1), F.lit("62 °C"), F.lit(1), F.lit(False))).cast(N.REFERENCES)).otherwise(F.col("evidence")))
    _, problems = N.build_gold(broken.where("field <> 'product_name'"), pages)
    assert {tuple(r) for r in problems.collect()} == {("a", "flash_point[0]", "not verbatim on page 1"), ("a", "product_name", "missing_field")}
    with pytest.raises(N.GoldError, match="flash_point"):
        N.load_gold(broken, pages, split="dev")


def test_best_place(spark):
    pages = page_of(spark, [("a", 1, "flash polnt 61"), ("a", 2, "the flash point 61 stands here"), ("b", 1, "flash polnt 61 x"), ("b", 2, "flash polnt 61 y")])
    needles = spark.createDataFrame([("a", "Flash point 61"), ("b", "flash point 61"), ("b", "wholly other words")], "document string, needle string")
    got = {(r["document"], r["needle"]): (r["page"], r["start"], r["exact"]) for r in N.best_place(pages, needles).collect()}
    assert got == {("a", "Flash point 61"): (2, 4, True), ("b", "flash point 61"): (1, 0, False)}


def test_near_passages_by_force(spark):
    """Every text whose best window is like enough gets its exact score; others get none."""
    passage = "the quick brown fox jumps over the lazy dog and runs away from all the hounds"
    edits = {1: passage, 2: passage.replace("fox", "cat"), 3: passage.replace("o", "0"), 4: "nothing of the kind here", 5: None, 6: "", 7: "start " * 30 + passage.replace("lazy", "laazy") + " end" * 30}
    docs = spark.createDataFrame(list(edits.items()), "doc_id long, text string")
    table = spark.createDataFrame([(9, passage), (10, None), (11, " ")], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in search.near_passages(docs, table, least=90).collect()}
    whole = docs.where("length(text) >= 70").select("doc_id", search.partial_ratio(T.search_form(F.col("text")), T.search_form(F.lit(passage))).alias("s"))
    brute = {r["doc_id"]: r["s"] for r in whole.collect()}
    assert got[1] == 100 and set(got) >= {1, 2, 7} and got == {i: pytest.approx(s) for i, s in brute.items() if s >= 90}


def test_evaluation_run(spark, pages, tmp_path):
    gold, _ = N.build_gold(fields_of(spark), pages)
    span = E.SPANS[6:-1]
    claims = gold.select("document", "field", "state", "value", F.when(F.col("derivation").isin(*E.GOLD_DERIVED), "DERIVED").otherwise("DIRECT").alias("derivation"), "rule", F.get("evidence", 0).alias("e"), "premises")
    claims = claims.select("document", "field", "state", "value", "derivation", "rule", F.when(F.col("e").isNotNull(), F.struct("e.page", "e.text", "e.box")).cast(span).alias("evidence"), F.transform("premises", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), p["box"].alias("box"))).cast(E.SPANS).alias("premises"))
    short = gold.select("*").withColumns({c: F.transform(c, lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), p["box"].alias("box"))).cast(E.SPANS) for c in ("evidence", "premises")})
    manifest = spark.createDataFrame([("a", "fam")], "document string, template_family string")
    out = runs.evaluate_run(short, claims, pages, str(tmp_path), run={"system": "s"}, manifest=manifest)
    assert out["summary"].first()["joint"] == 1.0 and out["by_family"].first()["joint"] == 1.0
    lines = [x for f in (tmp_path / "s_instances").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 8 and lines[0].startswith("document,field,gold_state")
    with pytest.raises(K.PredictionSetError):
        runs.evaluate_run(short, claims.withColumn("document", F.lit("z")), pages, str(tmp_path))
    with pytest.raises(K.LockedSplitError):
        runs.evaluate_run(short.withColumn("split", F.lit("locked")), claims, pages, str(tmp_path), split="locked")
    runs.evaluate_run(short.withColumn("split", F.lit("locked")), claims, pages, str(tmp_path), split="locked", allow_locked=True, run={"system": "s"})
    assert (tmp_path / "locked_runs").is_dir()


def test_corpus(spark, pages, tmp_path):
    gold, _ = N.build_gold(fields_of(spark), pages)
    units = pages.where("document = 'a'").select("document", F.lit("dev").alias("split"), "page", F.lit("native").alias("layer"), "text", T.token_count(F.col("text")).alias("n_tokens"))
    manifest = spark.createDataFrame([("a", 2)], "document string, pages int")
    stats = {(r["what"], r["name"]): r["n"] for r in runs.write_corpus(gold, pages, units, manifest, str(tmp_path)).collect()}
    assert stats["state", "PRESENT"] == 2 and stats["tokens", "native units"] == 2 and stats["fragments", "premise"] == 5 and stats["size", "2"] == 2
    with pytest.raises(runs.CorpusError):
        runs.write_corpus(gold, pages, units, manifest.withColumn("pages", F.lit(3)), str(tmp_path))
    with pytest.raises(runs.CorpusError):
        runs.write_corpus(gold, pages.withColumn("text", F.upper("text")), units, manifest, str(tmp_path))


def test_extraction_grid(spark):
    rows = spark.createDataFrame([("a", 1, 0, "Product name: Acid"), ("a", 1, 1, "Flash point: 61 C")], "document string, page int, row_no int, text string")
    docs = spark.createDataFrame([("a",), ("z",)], "document string")
    out = runs.extract_grid({("native", "rows"): rows, ("ocr", "rows"): rows.limit(0)}, docs)
    got = {(r["layer"], r["document"]): r["n"] for r in out.groupBy("layer", "document").agg(F.count("error").alias("n")).collect()}
    assert got == {("native", "a"): 0, ("native", "z"): 1, ("ocr", "a"): 1, ("ocr", "z"): 1}
