"""Tables that are published whole: commits, versions, vectors by digest, gold written and read back."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from test_resolution import fields_of, page_of

from factloom.plans import resolution as N
from factloom.sources import reports, store
from factloom.sources import tables as S


def test_commits_count_whole(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "n long"
    assert store.load(spark, path, kind).count() == 0 and store.committed(spark, path) == []
    first = store.publish(spark.range(3).toDF("n"), path)
    store.publish(spark.range(3, 5).toDF("n"), path)
    spark.range(100, 200).toDF("n").write.parquet(f"{path}/data/half")  # a job that wrote and never published
    assert sorted(r["n"] for r in store.load(spark, path, kind).collect()) == [0, 1, 2, 3, 4] and store.committed(spark, path)[0] == first
    store.compact(spark, path, kind, ["n"])
    assert len(store.committed(spark, path)) == 1 and store.load(spark, path, kind).count() == 5
    store.replace(spark.range(7, 8).toDF("n"), path)
    assert [r["n"] for r in store.load(spark, path, kind).collect()] == [7]
    assert store.vacuum(spark, path) == 0 and store.vacuum(spark, path, -1) == 4 and [r["n"] for r in store.load(spark, path, kind).collect()] == [7]
    with pytest.raises(Exception, match="boom"):
        store.publish(spark.range(2).select(F.raise_error(F.lit("boom")).cast("long").alias("n")), path)
    assert [r["n"] for r in store.load(spark, path, kind).collect()] == [7]


def test_two_runs_logged_at_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [reports.run_row(spark, date=f"2020-01-0{i}", split="locked", prediction_id=str(i)) for i in range(1, 5)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda r: reports.append_run(r, log), rows))
    reports.write_log(spark, log, str(tmp_path / "csv"))
    lines = [x for f in (tmp_path / "csv").glob("part-*") for x in f.read_text().splitlines()]
    assert [x.split(",")[0] for x in lines] == ["date", *[f"2020-01-0{i}" for i in range(1, 5)]]


def test_vectors_are_made_once(spark, tmp_path):
    path, asked = str(tmp_path / "v"), str(tmp_path / "asked")

    def embed(texts):
        import os
        import uuid

        os.makedirs(asked, exist_ok=True)
        with open(f"{asked}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    calls = lambda: sorted(x for f in (tmp_path / "asked").glob("*") for x in f.read_text().split("\n"))
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, "three"), ("b", 1, "one"), ("c", 1, None)], "document string, page int, text string")
    want = {("a", 1): [3.0, 1.0], ("a", 2): [5.0, 1.0], ("b", 1): [3.0, 1.0], ("c", 1): None}
    read = lambda df: {(r["document"], r["page"]): r["vector"] for r in df.collect()}
    assert read(store.embed_missing(pages, path, "m", embed)) == want and calls() == ["one", "three"]
    assert read(store.embed_missing(pages, path, "m", embed)) == want and calls() == ["one", "three"]
    changed = pages.withColumn("text", F.when(F.col("page") == 2, "seven").otherwise(F.col("text")))
    assert read(store.embed_missing(changed, path, "m", embed))["a", 2] == [5.0, 1.0] and calls() == ["one", "seven", "three"]
    store.embed_missing(pages, path, "other model", embed, runs=2)
    assert calls() == ["one", "one", "seven", "three", "three"] and len(store.committed(spark, path)) == 1
    assert read(store.embed_missing(pages, path, "m", embed)) == want and len(calls()) == 5
    with pytest.raises(Exception, match="a vector is missing"):
        store.embed_missing(changed, str(tmp_path / "w"), "m", lambda texts: [])


def test_gold_written_and_read_back(spark, tmp_path):
    pages = page_of(spark, [("a", 1, "Flash Point: 61 ºC\nflash point: 61 °C again\nFLASH POINT"), ("a", 2, "Chemical description: Mixture of substances")])
    fields = fields_of(spark)
    gold, problems = N.build_gold(fields, pages, pages)
    path = str(tmp_path / "gold")
    S.write_gold(gold, fields, path)
    again = S.read_gold(spark, path)
    kept = ["document", "split", "product_form", "field", "state", "derivation", "rule", "value"]
    flat = lambda df: sorted((tuple(r[c] for c in kept) for r in df.collect()), key=repr)
    assert flat(again) == flat(gold) and again.count() == 7
    parts = ("page", "text", "box", "char_start", "char_end", "occurrences", "ocr_box", "ocr_char_start", "ocr_exact", "ocr_score")
    spans = lambda df: {(r["document"], r["field"]): [[s[p] for p in parts] for a in ("evidence", "premises") for s in (r[a] or [])] for r in df.collect()}
    assert spans(again) == spans(gold) and any(spans(gold).values())
    written = {r["field"]: r["references"] for r in again.collect()}
    assert {r["field"]: len(r["evidence"] or []) for r in fields.collect()} == {f: len(r or []) for f, r in written.items()}
    S.write_gold(gold.where("field = 'flash_point'"), fields, path)
    assert [r["field"] for r in S.read_gold(spark, path).collect()] == ["flash_point"] and S.read_gold(spark, path, "locked").count() == 0


def test_answers_survive_a_lost_run(spark, tmp_path):
    """A run whose driver dies after some parts asks none of their prompts again; errors are asked anew."""
    from factloom.operators import contracts as K

    path, log = str(tmp_path / "answers"), tmp_path / "asked"
    log.mkdir()

    def caller(prompt, broken=()):
        import uuid

        (log / uuid.uuid4().hex).write_text(prompt)
        if prompt in broken:
            raise RuntimeError("busy")
        return prompt.upper()

    calls = lambda: sorted(f.read_text() for f in log.glob("*"))
    asked = spark.createDataFrame([(str(i), f"p{i}") for i in range(20)] + [("3", "p3"), (None, "x")], "key string, prompt string")
    some = asked.where(F.pmod(F.xxhash64("key"), F.lit(4)) < 2)  # what a run got done before it was lost
    store.ask_missing(some, path, caller, parts=4)
    before = calls()
    got = {r["key"]: r["response"] for r in store.ask_missing(asked, path, caller, parts=4).collect()}
    assert got == {str(i): f"P{i}" for i in range(20)} and calls() == sorted(f"p{i}" for i in range(20)) and 0 < len(before) < 20
    more = spark.createDataFrame([("a", "new"), ("b", "bad"), ("0", "p0")], "key string, prompt string")
    answers = {r["key"]: (r["response"], r["error"], r["attempts"]) for r in store.ask_missing(more, path, lambda p: caller(p, ("bad",)), tries=2).collect()}
    assert answers == {"a": ("NEW", None, 1), "b": (None, "busy", 2), "0": ("P0", None, 1)}
    assert {r["key"]: r["response"] for r in store.ask_missing(more, path, caller).collect()} == {"a": "NEW", "b": "BAD", "0": "P0"}
    assert K.FINAL


def test_waits_follow_the_error_and_the_rate():
    from factloom.operators import contracts as K

    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    bucket = K.TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(5):
        bucket.take()
    assert slept == [0.5, 0.5]
    now[0] += 10
    for _ in range(3):
        bucket.take()
    assert len(slept) == 2
    tried = []

    def refuse(prompt):
        tried.append(prompt)
        raise ValueError("never")

    assert K._answered(refuse, "p", 5, 0.0, 1.0, None) == (None, "never", 1) and len(tried) == 1


def test_one_poisoned_document_costs_one_row(spark):
    import pandas as pd

    from factloom.operators import quarantine as Q
    from factloom.plans import runs

    rows = [(f"d{i}", 1, n, t) for i in range(60) for n, t in enumerate(["Product name: Foo", "Flash point: 61 °C"])]
    rows += [("p", 1, 0, "Product name: Bar"), ("p", 1, None, None), ("q", 0, 0, "x"), (None, 1, 0, "lost")]
    table = spark.createDataFrame(rows, "document string, page int, row_no int, text string")
    docs = table.select("document").where("document is not null").distinct()
    out = runs.extract_grid({("native", "rows"): table}, docs)
    errors = {r["document"]: r["error"] for r in out.where("error is not null").collect()}
    assert errors == {"p": "no row number; no text", "q": "page number below 1", None: "no document"}
    claims = out.where("error is null").groupBy("document").count().collect()
    assert len(claims) == 60 and {r["count"] for r in claims} == {7}

    def extract(group):
        if group["document"].iloc[0] == "d7":
            raise RuntimeError("bad page")
        return pd.DataFrame({"document": group["document"].iloc[:1], "n": [len(group)]}) if group["document"].iloc[0] != "d8" else pd.DataFrame({"document": ["d8"]})

    got = {r["document"]: (r["n"], r["error"]) for r in Q.per_document(table.where("document like 'd%'"), extract, "document string, n long").collect()}
    assert len(got) == 60 and got["d7"] == (None, "RuntimeError: bad page") and got["d8"][1].startswith("KeyError") and got["d0"] == (2, None)
