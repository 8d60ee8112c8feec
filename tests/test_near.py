"""Near matches and words under ranges against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import near
from factloom.operators import ranges as R
from factloom.plans import probes as B
from factloom.plans import resolution as N


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_score(page, quote, swap=True):
    if not page or not quote:
        return 0.0
    if len(page) < len(quote) and swap:
        return plain_score(quote, page)
    m, n = len(quote), len(page)
    best = max((100.0 * common(page[i : i + m], quote) / m for i in range(n - m + 1)), default=0.0)
    return max([best] + [200.0 * common(cut, quote) / (m + w) for w in range(1, min(m, n + 1)) for cut in (page[:w], page[n - w :])])


def altered(rng, text, letters, times):
    out = list(text)
    for _ in range(times):
        i, what = rng.randrange(len(out) + 1), rng.randrange(3)
        if what == 0 and i < len(out):
            out[i] = rng.choice(letters)
        elif what == 1:
            out.insert(i, rng.choice(letters))
        elif i < len(out):
            del out[i]
    return "".join(out)


def cases(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefgh"[: rng.choice([2, 3, 6])]
        some = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))  # noqa: B023, E731
        quote, page = some(20), some(50)
        if rng.random() < 0.6:
            i = rng.randrange(len(page) + 1)
            page = page[:i] + altered(rng, quote, letters, rng.randint(0, 3)) + page[i:]
        yield page, quote


def test_likest_equals_brute_force():
    for page, quote in cases(500, 2):
        best = plain_score(page, quote)
        score, start, end = near.likest(page, quote)
        assert score == pytest.approx(best)
        if len(page) >= len(quote) and score:
            assert 200.0 * common(page[start:end], quote) / (end - start + len(quote)) == pytest.approx(score)
        for least in (80, 90, 95):
            assert near.likest(page, quote, least)[0] == pytest.approx(best if best >= least else 0)


def test_index_misses_nothing():
    for page, quote in cases(400, 3):
        for least in (70, 85, 95):
            best = plain_score(page, quote, swap=False)
            got = [r[2] for r in near._search(near._Index([quote, "zz", quote[::-1]], least), [(0, page)]) if r[1] == 0]
            assert got == (pytest.approx([best]) if best >= least else [])


def test_pieces_that_occur_before_the_match(spark):
    """The passage's pieces stand out of order first, then the passage with three letters changed."""
    passage = "flammable liquid and vapour keep away from heat and hot surfaces at all times"
    parts = [passage[i : i + 16] for i in range(0, len(passage), 16)]
    page = " ".join(reversed(parts)) * 3 + " filler " * 20 + passage.replace("vapour", "vapuor").replace("hot", "hat") + " end"
    docs = spark.createDataFrame([("a", page), ("b", "nothing"), ("c", None), ("d", "")], "name string, text string")
    asked = spark.createDataFrame([("p", passage), ("q", " "), ("r", None), ("s", passage)], "item string, text string")
    got = {(r["name"], r["item"]): r["score"] for r in near.matches(docs, asked, least=90, key="name", item="item").collect()}
    best = near.likest(page, passage)[0]
    assert best > 94 and got == {("a", "p"): pytest.approx(best), ("a", "s"): pytest.approx(best)}
    assert near.matches(docs.limit(0), asked, key="name", item="item").count() == 0 == near.matches(docs, asked.limit(0), key="name", item="item").count()
    with pytest.raises(ValueError):
        near.matches(docs, asked, least=20)


def test_blocks_miss_nothing(spark):
    rows = [(i, page, quote) for i, (page, quote) in enumerate(cases(300, 4))] + [(900, "abc" * 200 + "abcdefgabc", "abcdxfgabc"), (901, None, "a"), (902, "a", None), (903, "", "")]
    table = spark.createDataFrame(rows, "nr int, form string, quote string")
    for least in (80.0, 90.0):
        got = {r["nr"]: r for r in near.best_of(table, ["nr"], least).collect()}
        want = {i: plain_score(page, quote) for i, page, quote in rows}
        assert {i: r["score"] for i, r in got.items()} == {i: pytest.approx(s) for i, s in want.items() if s >= least}
    assert got[900]["start"] == 600


def test_words_under_ranges(spark):
    rng = random.Random(6)
    words, hits = [], []
    for page in range(6):
        at = 0
        for _ in range(rng.choice([0, 1, 30])):
            at += rng.randint(0, 3)
            wide = rng.randint(1, 6)
            box = None if rng.random() < 0.2 else (rng.random(), rng.random(), rng.random(), rng.random())
            words.append((page, at, at + wide, "w" * wide, box))
            at += wide
        hits += [(page, i, s, s + rng.randint(0, 20)) for i, s in enumerate(rng.randint(0, at + 5) for _ in range(25))]
    w = spark.createDataFrame(words, "page int, start int, end int, text string, box struct<x0: double, y0: double, x1: double, y1: double>")
    h = spark.createDataFrame(hits, "page int, nr int, start int, end int")
    got = {(r["page"], r["nr"]): r["box"] for r in R.boxes_under(h, w, ["page"], ["nr", "start", "end"]).collect()}
    packed = w.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("start", "end", "box"))).alias("words"))
    rows = h.join(packed, "page", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<start: int, end: int, box: struct<x0: double, y0: double, x1: double, y1: double>>>")))
    inside = {(r["page"], r["nr"]): len(r["run"]) for r in rows.select("page", "nr", R.run_under(F.col("words"), F.col("start"), F.col("end")).alias("run")).collect()}
    assert len(got) == len(hits)
    for page, nr, start, end in hits:
        under = [x for x in words if x[0] == page and x[1] < end and x[2] > start]
        boxes = [x[4] for x in under if x[4]]
        around = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None
        if start < end:
            assert (tuple(got[page, nr]) if got[page, nr] else None) == around
            assert inside[page, nr] == len(under)


def test_places_and_forms(spark):
    row = spark.createDataFrame([("aXbXaX", "aX"), ("aaa", "aa"), ("a.b a.b", "a.b"), ("x\\Ey", "\\E"), ("abc", ""), ("abc", "d"), ("", "a")], "page string, quote string")
    assert [r[0] for r in row.select(R.places(F.col("page"), F.col("quote"))).collect()] == [[0, 4], [0], [0, 4], [1], [], [], []]
    words = spark.createDataFrame([(1, 0, 5, "Flash"), (1, 6, 7, "™"), (1, 8, 13, "Poınt"), (1, 14, 17, "ﬁx™")], "page int, start int, end int, text string")
    got = [(r["text"], r["start"], r["end"]) for r in R.form_ranges(words, ["page"]).orderBy("start", "end").collect()]
    assert got == [("Flash", 0, 5), ("™", 6, 6), ("Poınt", 6, 11), ("ﬁx™", 12, 15)]


def test_located_needs_a_box(spark):
    """A value that stands in the text is located only where a word with a box lies under it; the other layer has its own words."""
    text = "Product name: Foo Bar\nFoo Bar again"
    pages = spark.createDataFrame([("d", 1, text, text), ("d", 2, "Foo Bar", "Foo Bar"), ("e", 1, "other", "other")], "document string, page int, text string, row_text string")
    span = "struct<page: int, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>"
    gold = spark.createDataFrame(
        [(d, "product_name", "PRESENT", "EXPLICIT", None, "foo  bar", ["Other"], [(1, "Product name: Foo Bar", None)], []) for d in ("d", "e")],
        f"document string, field string, state string, derivation string, rule string, value string, accepted array<string>, evidence array<{span}>, premises array<{span}>",
    )

    def words_of(keep):
        rows = []
        for document, page, body in [("d", 1, text), ("d", 2, "Foo Bar"), ("e", 1, "other")]:
            at = 0
            for w in body.replace("\n", " ").split(" "):
                rows.append((document, page, at, at + len(w), w, (0.1, 0.1, 0.2, 0.2) if keep(document, page, at) else None))
                at += len(w) + 1
        return spark.createDataFrame(rows, "document string, page int, start int, end int, text string, box struct<x0: double, y0: double, x1: double, y1: double>")

    flags = lambda w: {r["document"]: (r["value_exact"], r["value_pages"], r["value_located"], r["located_pages"], r["value_on_gold_page"]) for r in B.oracle_flags(gold, pages, w).collect()}
    assert flags(words_of(lambda *_: True)) == {"d": (True, [1, 2], True, [1, 2], True), "e": (True, [1], True, [1], True)}
    assert flags(words_of(lambda d, p, at: p == 2)) == {"d": (True, [1, 2], True, [2], False), "e": (True, [1], False, [], False)}
    assert flags(words_of(lambda d, p, at: at >= 22)) == {"d": (True, [1, 2], True, [1], True), "e": (True, [1], False, [], False)}
    assert flags(None) == {"d": (True, [1, 2], True, [1, 2], True), "e": (True, [1], True, [1], True)}
    rows = {r["document"]: r for r in B.oracle_rows(gold, pages, pages, {"native": words_of(lambda *_: True), "ocr": words_of(lambda d, p, at: p == 2)}).collect()}
    one = rows["d"]
    assert (one["value_exact_ocr"], one["value_located_native"], one["value_located_ocr"], one["value_located_pages_ocr"], one["value_on_gold_page_ocr"]) == ("yes", "yes", "yes", "2", "no")
    assert (rows["e"]["value_exact_ocr"], rows["e"]["value_located_ocr"]) == ("yes", "no") and rows["e"]["note"] == "span not found on native; value not found on ocr; span not found on ocr"


def test_best_place_is_the_best_window(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 40 + "flash point of sixty degrees" + "y" * 400), ("a", 2, "flash poimt of sixty degres")], "document string, page int, text string")
    needles = spark.createDataFrame([("a", "flash point of sixtty degrees"), ("a", "not there at all")], "document string, needle string")
    got = [tuple(r) for r in N.best_place(pages, needles).collect()]
    score = plain_score("x" * 40 + "flash point of sixty degrees" + "y" * 400, "flash point of sixtty degrees")
    assert got == [("a", "flash point of sixtty degrees", 1, got[0][3], False, pytest.approx(score))] and 36 <= got[0][3] <= 40 and score >= 90


def test_passages_with_named_ids(spark):
    from factloom.operators import search

    texts = spark.createDataFrame([("a", "One  two three two"), ("b", None), ("c", "two")], "doc_id string, text string")
    asked = spark.createDataFrame([("p", "two"), ("q", "ONE two"), ("r", " ")], "item_id string, text string")
    assert sorted(tuple(r) for r in search.passages_in(texts, asked).collect()) == [("a", "p", 2, 4), ("a", "q", 1, 0), ("c", "p", 1, 0)]
    assert search.passages_in(texts, asked.where("item_id = 'r'")).count() == 0


def test_watched_batches_are_written_once(spark, tmp_path):
    """A batch that is run again replaces its own hits."""
    from factloom.streaming import events

    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    asked = spark.createDataFrame([(1, "two")], "item_id long, text string")
    for i, text in enumerate(["one two", "two two", "none"]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    texts = events.stream(spark, source, "doc_id long, text string", files=1)
    query = events.watch_passages(texts, asked, out, check)
    query.processAllAvailable()
    query.stop()
    read = lambda: sorted((r["doc_id"], r["n_hits"]) for r in spark.read.parquet(out).collect())
    assert read() == [(0, 1), (1, 2)]
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)  # the commit of the last batch was lost, so it runs again
    query = events.watch_passages(events.stream(spark, source, "doc_id long, text string", files=1), asked, out, check)
    query.processAllAvailable()
    query.stop()
    assert read() == [(0, 1), (1, 2)]
