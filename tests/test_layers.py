"""Spans on the other layer, boxes in probes, labels over line ends."""

import random

import pytest
from pyspark.sql import functions as F
from test_evaluation import SPAN
from test_resolution import page_of

from factloom.operators import alignment as A
from factloom.plans import derivation as D
from factloom.plans import evaluation as E
from factloom.plans import probes as B

NATIVE = [
    ("d", 1, "Safety data sheet\nProduct name: Foo Bar\nSupplier:\nAcme Inc\nFlash point: 61 °C closed cup"),
    ("d", 2, "Substance/mixture : Mixture\n7429-90-5 aluminium 10 %\nother words end the page"),
]
OCR = [
    ("d", 1, "Safety dala sheet\nProduct narne: Foo Bar\nSupplier:\nAcrne lnc\nFlash po1nt: 61 °C closed cup"),
    ("d", 2, "Substance/rnixture : Mixture\n7429-90-5 alurninium 10 %\nother words end the page"),
]


def test_longest_chain():
    rng = random.Random(3)
    for _ in range(300):
        values = [rng.randrange(12) for _ in range(rng.randint(0, 11))]
        kept = A.longest_chain(values)
        picks = ([v for i, v in enumerate(values) if m >> i & 1] for m in range(1 << len(values)))
        best = max(len(c) for c in picks if c == sorted(set(c)))
        assert len(kept) == best and all(values[a] < values[b] for a, b in zip(kept, kept[1:], strict=False))


def span_of(pages, page, text):
    body = next(t for _, p, t in pages if p == page)
    at = body.index(text)
    return (page, text, None, at, at + len(text))


SPANNED = SPAN[:-1] + ", char_start: int, char_end: int>"


@pytest.fixture
def golds(spark):
    fields = [
        ("product_name", "PRESENT", "EXPLICIT", None, "Foo Bar", [span_of(NATIVE, 1, "Product name: Foo Bar")], []),
        ("supplier_name", "PRESENT", "EXPLICIT", None, "Acme Inc", [span_of(NATIVE, 1, "Supplier:\nAcme Inc")], []),
        ("flash_point", "PRESENT", "EXPLICIT", None, "61 °C", [span_of(NATIVE, 1, "Flash point: 61 °C")], []),
        ("product_cas_number", "NOT_APPLICABLE", "ONTOLOGY", D.IDENTIFIER_RULE, None, [], [span_of(NATIVE, 2, "Substance/mixture : Mixture")]),
    ]
    rows = [("d", f, s, k, r, v, [], e, p, "MIXTURE") for f, s, k, r, v, e, p in fields]
    return spark.createDataFrame(rows, f"document string, field string, state string, derivation string, rule string, value string, accepted array<string>, evidence array<{SPANNED}>, premises array<{SPANNED}>, product_form string")


def rows_of(spark, pages):
    made = []
    for document, page, text in pages:
        for n, line in enumerate(text.split("\n")):
            made.append((document, page, n, line, (0.1, 0.1 * n, 0.16 + 0.07 * (len(line.split(" ")) - 1), 0.1 * n + 0.01)))
    return spark.createDataFrame(made, "document string, page int, row_no int, text string, box struct<x0: double, y0: double, x1: double, y1: double>")


def test_spans_found_again(spark, golds):
    native, ocr = page_of(spark, NATIVE), page_of(spark, OCR)
    got = {r["field"]: r for r in B.spans_on_layer(golds, native, ocr).collect()}
    texts = {f: [s["text"] for s in (*r["evidence"], *r["premises"])] for f, r in got.items()}
    assert texts["flash_point"] == ["Flash po1nt: 61 °C"] and "Foo Bar" in texts["product_name"][0] and "Acrne" in texts["supplier_name"][0] and texts["product_cas_number"][0].startswith("Substance/rnixture")
    box = got["flash_point"]["evidence"][0]["box"]
    assert (round(box["x0"], 2), round(box["y0"], 2), round(box["x1"], 2)) == (0.1, 0.4, 0.37)
    plain = {r["field"]: [s["text"] for s in (*r["evidence"], *r["premises"])] for r in B.spans_on_layer(golds, native).collect()}
    assert plain == {"product_name": ["Product name: Foo Bar"], "supplier_name": ["Supplier:\nAcme Inc"], "flash_point": ["Flash point: 61 °C"], "product_cas_number": ["Substance/mixture : Mixture"]}


def test_repeats_and_moved_runs_do_not_mislead(spark):
    native = page_of(spark, [("d", 1, "alpha beta gamma delta 61 C epsilon zeta eta theta 61 C iota kappa lambda mu"), ("d", 2, "only here"), ("d", 3, "61 C")])
    other = page_of(spark, [("d", 1, "lambda mu alpha beta garnma delta 61 C epsilon zeta eta theta 6l C iota kappa"), ("d", 3, "completely different words")])
    body = native.where("page = 1").first()["text"]
    first, second = body.index("61 C"), body.rindex("61 C")
    asked = [("d", 1, second, second + 4, "61 C", 0), ("d", 1, first, first + 4, "61 C", 1), ("d", 2, 0, 4, "only", 2), ("d", 3, 0, 4, "61 C", 3)]
    spans = spark.createDataFrame(asked, "document string, page int, char_start int, char_end int, text string, nr int")
    got = {r["nr"]: r["there"] for r in A.carry(spans, native, other).collect()}
    assert got[0]["text"] == "6l C" and got[1]["text"] == "61 C" and got[0]["char_start"] > got[1]["char_start"]
    assert got[2] is None and got[3] is None and got[0]["box"] and got[1]["score"] == 100.0
    assert A.carry(spans.limit(0), native, other).count() == 0


def test_probes_have_boxes(spark, golds):
    """The value's own line is cited with its box, so localisation on the layer is satisfied."""
    pages, rows = page_of(spark, NATIVE), rows_of(spark, NATIVE)
    boxed = B.spans_on_layer(golds, pages)
    claims = {r["field"]: r for r in B.gold_value_claims(boxed, pages, rows).collect()}
    assert claims["supplier_name"]["evidence"]["text"] == "Supplier:\nAcme Inc" and claims["supplier_name"]["evidence"]["box"]["y1"] == pytest.approx(0.31)
    assert claims["product_cas_number"]["premises"][0]["box"]["y0"] == 0.0
    scored = {(r["probe"], r["field"]): r for r in B.run_probes(boxed, pages, rows).collect()}
    assert all(scored["gold_value", f][axis] == "satisfied" for f in ("product_name", "supplier_name", "product_cas_number") for axis in E.LOCAL)
    assert scored["gold_evidence", "flash_point"]["value"] == "satisfied" and scored["gold_evidence", "product_cas_number"]["state"] == "satisfied"
    rates = {r["probe"]: (r["n"], r["claims"], r["passed"]) for r in B.probe_rates(B.run_probes(boxed, pages, rows)).collect()}
    assert rates["gold_value"] == (4, 4, 4) and rates["gold_evidence"] == (4, 4, 4) and rates["gold_verify"] == (4, 4, 4)


def test_diagnostics_report(spark, golds, tmp_path):
    """One row a field with every probe's axes, written as CSV; the pipeline's claims are read beside them."""
    from factloom.plans import runs

    pages, rows = page_of(spark, NATIVE), rows_of(spark, NATIVE)
    boxed = B.spans_on_layer(golds, pages)
    pipeline = B.gold_claims(boxed).where("field <> 'flash_point'")
    out = runs.diagnose_run(boxed, pages, rows, str(tmp_path), pipeline=pipeline)
    got = {r["field"]: r for r in out["rows"].collect()}
    assert set(got) == {"product_name", "supplier_name", "flash_point", "product_cas_number"} and list(out["rows"].columns) == list(B.PROBE_COLUMNS)
    flash, cas = got["flash_point"], got["product_cas_number"]
    assert (flash["value_cited"], flash["value_localized"], flash["evidence_state"], flash["evidence_value"], flash["verify_support"], flash["pipeline_joint"]) == (True, True, "satisfied", "satisfied", "satisfied", "no")
    assert (cas["value_localized"], cas["evidence_available"], cas["verify_note"], cas["pipeline_joint"]) == (True, True, "premises declare MIXTURE", "yes")
    lines = [x for f in (tmp_path / "diagnostics_native").glob("part-*") for x in f.read_text().splitlines()]
    assert lines[0] == ",".join(B.PROBE_COLUMNS) and len(lines) == 5 and lines[1].startswith("d,flash_point,PRESENT,EXPLICIT,True,satisfied")


def test_value_on_its_own_line_is_cited_with_the_label_line_above(spark):
    pages = page_of(spark, [("d", 1, "· Flash point:\n12 °C (53.6 °F)\nmore")])
    cited = pages.select(B.cited_range(F.col("text"), F.lit(15), F.lit(30)).alias("c"), "text", "words", "page")
    span = cited.select(B.span_between(F.col("page"), F.col("text"), F.col("words"), F.col("c.start"), F.col("c.end")).alias("s")).first()["s"]
    assert span["text"] == "· Flash point:\n12 °C (53.6 °F)" and (span["box"]["y0"], span["box"]["y1"]) == (0.0, pytest.approx(0.11))


def plain_linear(lines, labels):
    """Label, value and line of every label that opens a line, over a page's tokens one by one."""
    import re

    tokens = [(w, n, i == 0) for n, line in enumerate(lines) for i, w in enumerate(line.split())]
    word = lambda w: "".join(c for c in w if c != "™").lower().replace("º", "°")
    mark = re.compile(r"^(\d+(\.\d+)*\.?|[•·*\-–])$")

    def spells(i, label):
        n = len(label.split())
        return n if i + n <= len(tokens) and " ".join(filter(None, (word(t[0]) for t in tokens[i : i + n]))).rstrip(":") == label else 0

    out = []
    for i, (_, line, opens) in enumerate(tokens):
        if not (opens or (i and tokens[i - 1][2] and mark.match(tokens[i - 1][0]))):
            continue
        for label in labels:
            n = spells(i, label)
            end = i + n
            if n and (end >= len(tokens) or tokens[end - 1][0].endswith(":") or tokens[end][0] in (":", "=") or tokens[end][2]):
                at = end
                while at < len(tokens) and tokens[at][0] in (":", "="):
                    at += 1
                value = [t[0] for t in tokens[at : at + 12]]
                for o in range(len(value)):
                    if any(spells(end + o, x) for x in labels):
                        value = value[:o]
                        break
                out.append((line, label, " ".join(value)))
                break
    return out


def test_labels_over_line_ends(spark):
    from factloom.operators import extract as X
    from factloom.plans import extraction as P

    rng = random.Random(7)
    labels = {f: X.LABELS[f] for f in ("product_name", "flash_point", "supplier_name")}
    pool = [w for ls in labels.values() for label in ls[:6] for w in label.split()] + [":", "=", "61", "°C", "-", "3.1", "Foo", "™", "name:", "point:", "identifier:"]
    pages = {0: ["Trade", "name:", "Foo", "Bar", "Flash", "point", "61 °C"], 1: ["- Flash", "point : 12 °C Flash point = 13"], 2: ["Product"], 3: [":", "= ="]}
    for i in range(4, 80):
        words = []
        for _ in range(rng.randint(1, 12)):
            words += rng.choice(rng.choice(list(labels.values()))).split() if rng.random() < 0.4 else [rng.choice(pool)]
        cut = sorted(rng.sample(range(len(words) + 1), min(len(words), rng.randint(0, 4))))
        pages[i] = [" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)], strict=True)]
    rows = [(f"d{i}", 1, n, line) for i, lines in pages.items() for n, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "document string, page int, row_no int, text string")
    got = sorted(tuple(r) for r in P.linear_candidates(lines, fields=tuple(labels)).select("document", "row_no", "field", "label", "value").collect())
    want = sorted((f"d{i}", n, f, label, value) for i, ls in pages.items() for f, ll in labels.items() for n, label, value in plain_linear(ls, ll))
    assert got == want
    assert ("d0", 0, "product_name", "trade name", "Foo Bar Flash point 61 °C") in got and ("d0", 4, "flash_point", "flash point", "61 °C") in got
    assert P.linear_candidates(lines.limit(0)).count() == 0
