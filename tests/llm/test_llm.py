"""The training-data operators against brute force, on tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import json
import math
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, chat, exactdedup, linededup, lm, minhash, mixing, toxicity, warc
from factloom.llm import common as C

EXTRA = "h long, norm string, slice int, block long, shard int, kind int, size long, `order` string, text_sha256 string, n_tokens long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 60)
    line = "  This line of more than forty characters stands in many texts. "
    out = [None, "", "one", "A b", "a B", "Été one\ttwo  three", "ÉTÉ one", "I'll  pay\n\n 12,000€ ", base, base, base + " tail", base.upper(), words(rng, 40_000), "x" * 30_000]
    out += [words(rng, 30) + "\n" + line + "\n" + words(rng, 5) for _ in range(8)]
    out += [line + "\n" + line.upper(), "\n", " \t"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, *[None] * 10) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + EXTRA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def tokenizers():
    return pytest.importorskip("public_tokenizers")


def test_bpe_round_trip(spark, docs, texts):
    import tiktoken

    P = tokenizers()
    path = P.path("byte_bpe_50k.tiktoken")
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(path)), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(docs, path, P.PATTERN, block_chars=5_000).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        ids = real.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and bytes(got[i]["decoded"]) == (t or "").encode()
    brief = {r["doc_id"]: r for r in bpe.encode(docs.union(docs.limit(1)), path, P.PATTERN, digests=True).collect()}
    assert all(brief[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts)


def test_bpe_empty_and_null_id(spark, empty):
    P = tokenizers()
    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.encode(empty, path, P.PATTERN).count() == 0
    one = bpe.encode(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), path, P.PATTERN).first()
    assert one["doc_id"] is None and one["n_tokens"] == 2


def test_pre_tokens_follow_unicode_white_space():
    P = tokenizers()
    find = bpe.splitter(P.PATTERN).findall
    assert find("a\x1cb c") == ["a", "\x1c", "b", " ", "c"] or "".join(find("a\x1cb c")) == "a\x1cb c"


def test_rank_packing():
    for a in (np.array([], np.uint32), np.array([0, 5, 1, 0, 70_000, 3], np.uint32)):
        assert bpe.unpack_ranks(bpe.pack_ranks(a)).tolist() == a.tolist()
        assert C.unpack_uints(C.pack_uints(a)).tolist() == a.tolist()


def toxic_docs(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = words(rng, 40) + (" Zorgle, zorglewort blick zorgleton" if bad else "") + " " + words(rng, 10)
        rows.append((i, text, "en"))
        if i % 2:
            labels.append((i, 1))
        labels.append((i, int(bad))) if not i % 2 else labels.__setitem__(-1, (i, int(bad)))
    rows += [(n, None, "en"), (n + 1, "", "en"), (None, "zorgle zorglewort blick", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels + [(0, None)], "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert all((got[i]["score"] >= 0.5) == (i % 6 == 0) for i in held)
    assert all(e % 5 for i in held for e in got[i]["evidence"])
    assert got[600]["score"] == got[601]["score"] < 0.5 and got[600]["evidence"] == []
    clean = toxicity.keep_clean(docs.withColumn("size", F.lit(1)), model)
    assert clean.columns == ["doc_id", "text", "lang", "size"] and clean.count() == 502


def test_toxicity_drops_confirmed_copies_only(spark):
    """Texts with a common passage (Jaccard about 0.3) all stay; of near copies with one label the first stays."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, 0, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    base = [f"z{i}" for i in range(100)]
    rows += [(100 + i, i % 2, " ".join([*base[:-1], f"y{i}"])) for i in range(6)]
    rows += [(106, 0, "two words"), (107, 0, "two words"), (108, 0, None)]
    assert toxicity.near_copies(spark.createDataFrame(rows, "doc_id long, toxic int, text string"), 0.8) == [102, 103, 104, 105]
    labels = spark.createDataFrame([r[:2] for r in rows[:40]], "doc_id long, toxic int").withColumn("toxic", (F.col("doc_id") < 8).cast("int"))
    docs = spark.createDataFrame([(i, t + (" vile" if i < 8 else "")) for i, _, t in rows[:40]], "doc_id long, text string")
    model = toxicity.train(docs, labels, F.lit(True))
    assert sum(model.labels) == 8


def test_toxicity_without_labels(spark, empty):
    docs, labels = toxic_docs(spark, 12)
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, none).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)

    def made(n):
        t = np.sort(rng.choice(30, n, replace=False))
        w = rng.random(n) + 0.1
        return t, w / np.linalg.norm(w)

    vectors = [made(4) for _ in range(300)]
    vectors += vectors[:9]
    full = np.zeros((len(vectors), 40))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    index = toxicity.Index(vectors, 16)
    for n, (t, w) in enumerate([*vectors[:40], (np.array([3, 35]), np.array([0.6, 0.8])), (np.array([38]), np.array([1.0]))]):
        q = np.zeros(40)
        q[t] = w
        s = full @ q
        skip = n if n < 20 else -1
        brute = [(s[i], i) for i in np.lexsort((np.arange(len(s)), -np.round(s, 12))) if s[i] > 0 and i != skip][:7]
        got = index.nearest((t, w), 7, skip)
        assert [i for _, i in got] == [i for _, i in brute] and np.allclose([x for x, _ in got], [x for x, _ in brute], atol=1e-12)


def toxic_by_force(texts, labels, learn, k=16, rest=0.002, top=2_000):
    """Score of every text by dense vectors and all cosines."""
    ids = sorted(i for i in labels if learn(i))
    terms = {i: Counter(s for w in toxicity.terms_of(t) for s in toxicity.stems_of(w)) for i, t in texts.items()}
    n, pos = len(ids), sum(labels[i] for i in ids)
    df, a = Counter(t for i in ids for t in terms[i]), Counter(t for i in ids if labels[i] for t in terms[i])
    phi = {}
    for t, x in df.items():
        b, c = x - a[t], pos - a[t]
        d = n - pos - b
        if x * (c + d) * pos * (n - pos):
            phi[t] = float(n) * (a[t] * d - b * c) ** 2 / (x * (c + d) * pos * (n - pos)) / n
    use = sorted((t for t in phi if phi[t] > 0), key=lambda t: (-phi[t], t))[:top]
    at = {t: j for j, t in enumerate(use, 1)}

    def vector(i):
        v = np.zeros(len(use) + 1)
        for t, m in terms[i].items():
            if t in at:
                v[at[t]] = m / len(toxicity.terms_of(texts[i])) * math.log(1 + n / df[t]) * phi[t]
        if not v.any():
            return None
        v[0] = rest
        return v / np.linalg.norm(v)

    rows = [(i, v) for i in ids if (v := vector(i)) is not None]
    matrix, y = np.array([v for _, v in rows]), [labels[i] for i, _ in rows]
    prior = (pos - sum(y)) / (n - len(y)) if n > len(y) else pos / n

    def share(v, without=None):
        s = matrix @ v
        near = [j for j in np.argsort(-s, kind="stable") if s[j] > 0 and rows[j][0] != without][:k]
        w = s[near] ** 8
        return (sum(x * y[j] for x, j in zip(w, near, strict=True)) + 0.02 * prior) / (w.sum() + 0.02)

    x = np.array([toxicity.logit(share(v, i)) for i, v in rows])
    y, ab = np.array(y), np.array([1.0, 0.0])
    for _ in range(40_000):  # the curve's log loss by small steps
        p = 1 / (1 + np.exp(-(ab[0] * x + ab[1])))
        ab = ab - 0.5 / (1 + len(x) + (x * x).sum()) * np.array([((p - y) * x).sum() + ab[0] - 1, (p - y).sum() + ab[1]])
    out = {}
    for i in texts:
        v = vector(i)
        out[i] = prior if v is None else 1 / (1 + math.exp(-np.clip(ab[0] * toxicity.logit(share(v)) + ab[1], -30, 30)))
    return out


def test_toxicity_by_force(spark):
    rng = random.Random(12)
    texts = {i: words(rng, rng.randint(5, 60)) + (" vile brute" if i % 5 == 0 and i % 3 else "") for i in range(150)} | {150: "", 151: None, 152: "qqqq"}
    labels = {i: int(i % 5 == 0) for i in range(0, 150, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.train(docs, table, F.col("doc_id") % 7 != 0)
    want = toxic_by_force(texts, labels, lambda i: i % 7)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(math.isclose(got[i], want[i], abs_tol=1e-3) for i in texts)


def components_by_force(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark, texts):
    rng = random.Random(9)
    more, base = list(texts), words(rng, 80).split()
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "new%d" % rng.randrange(9)
        more.append((100 + i, " ".join(w)))
    table = spark.createDataFrame([(i, t, 1) for i, t in more], "doc_id long, text string, rep int").repartition(4)
    want = components_by_force(more, 5, 85)
    for small in ({"tile": 16}, {"tile": 8, "chunk": 3, "wide_tile": 5}, {"tile": 2, "chunk": 1, "tile_shingles": 200}):
        assert {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(table, percent=85, **small).collect()} == want


def test_near_duplicates_edges(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (2, "z y x w v u"), (5, "z y x w v u"), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(rows).collect()), key=repr)
    assert (None, 2, None, True) in got and (7, 0, 7, True) in got
    assert [r[2] for r in got if r[0] == 5] == [2, 2, 2]


def test_superminhash_estimates():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = pool[:600], pool[150:750]
    sig = minhash.superminhash(np.concatenate([C.mix64(a), C.mix64(b)]), np.array([600, 600]), 120)
    assert abs((sig[0] == sig[1]).mean() - 450 / 750) < 0.15
    few = minhash.superminhash(C.mix64(pool[:1]), np.array([1]), 120)
    assert sorted((few[0] >> np.uint64(56)).tolist()) == list(range(120))


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[5] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] + [0.0] * 14), (1004, [1.0]), (None, [1.0] * 16), (1005, [1e308] * 16)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, codes string")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = [*range(400), 1005]
    unit = ann.unit_rows(np.vstack([x, np.full(16, 1e308)]))
    right = 0
    for q in range(0, 400, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((ids, -s))[:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        right += len({i for _, i, _ in found} & {ids[b] for b in best})
        assert all(abs(s[ids.index(i)] - score) < 1e-12 for _, i, score in found)
    assert right >= 0.9 * 40
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert {r["vec_id"] for r in few} == {1, 2}


def conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, words(rng, 12) + ("?" if role == "user" else ".\n" + words(rng, 30)), 1))
    rows += [(50, 0, None, None, 1), (51, None, "system", "", 1), (51, 0, "user", "hi", 1), (51, 0, "user", "hi", 1), (None, 0, "user", "alone", 1)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")


def test_chat(spark):
    out = {r["conv_id"]: r for r in chat.format_chats(conversations(spark), F.coalesce(F.col("conv_id") % 5 != 0, F.lit(False))).collect()}
    lines = sum(r["n_lines"] for r in out.values())
    assert sum(r["n_right"] for r in out.values()) >= 0.9 * lines
    assert out[51]["roles"] == ["system", "user"]
    assert out[None]["rendered"] == "<|im_start|>user\nalone<|im_end|>\n"
    assert chat.format_chats(conversations(spark).limit(0), F.lit(True)).count() == 0


def test_viterbi_is_best_path():
    rng = np.random.default_rng(3)
    model = chat.Hmm(rng.random(6), rng.random((6, 6)) * 9, rng.random((6, 5)) * 9, rng.random((6, 2)) * 9, rng.random((6, 4)) * 9)
    seen = [(int(rng.integers(5)), int(rng.integers(2)), int(rng.integers(4))) for _ in range(4)]
    import itertools

    def weight(path):
        total = model.start[path[0]]
        for i, s in enumerate(path):
            total += sum(t[s, f] for t, f in zip(model.tables, seen[i], strict=True)) + (model.step[path[i - 1], s] if i else 0)
        return total

    best = max(itertools.product(range(6), repeat=4), key=weight)
    assert math.isclose(weight(tuple(model.viterbi(seen))), weight(best))


def lines_by_force(texts, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for i, t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    out = {}
    for i, t in texts:
        own = (t or "").split("\n")
        stay = [x for x in own if len(held.get(key(x), [])) < min_docs or max(held[key(x)]) == i]
        out[i] = (len(own), len(own) - len(stay), "\n".join(stay))
    return out


def test_line_dedup(spark, docs, texts, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in linededup.drop_repeated_lines(docs).collect()}
    assert got == lines_by_force(texts)
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_line_runs_levels(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    long = "a line that is longer than forty characters %d"
    batch = lambda lo, hi: linededup.keyed(spark.createDataFrame([(i, long % i + "\n" + long % 0) for i in range(lo, hi)], "doc_id long, text string"), 40)
    for lo in (1, 3, 5):
        runs.add(batch(lo, lo + 2))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert [tuple(r)[1:] for r in runs.repeated(6).collect()] == [(6, 6)]
    held = [r["d"] for level in runs.levels for r in runs._read(level).collect()]
    assert len(held) == len(set(held)) == 7
    assert [tuple(r)[1:] for r in runs._read(runs.tallies).collect()] == [(4, 6)]
    assert {r["doc_id"] for r in runs.novel(batch(6, 9)).collect()} == {7, 8}


def test_language_model(spark, docs, texts, empty):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = {r["doc_id"]: r for r in lm.score(docs, held, contexts=50, block_chars=20_000).collect()}
    toks = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts}
    out = {i for i in toks if zlib.crc32(b"%d" % i) % 7 == 2}
    count = Counter(w for i, ws in toks.items() if i not in out for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in out, len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert lm.score(empty, held).count() == 0


def test_language_model_sums_to_one(spark):
    """Over all one-word texts: P(word | start) P(end | word), summed with the unknown and the bare end, is a distribution's part."""
    train = [(i, t) for i, t in enumerate(["a b a c", "a b", "c a b b", "b"] * 5)]
    ask = [(1000 + j, w) for j, w in enumerate(["a", "b", "c", "unseen", ""])]
    table = spark.createDataFrame(train + ask, "doc_id long, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in lm.score(table, F.col("doc_id") >= 1000, contexts=4).collect()}
    assert 0 < sum(got[1000 + j] for j in range(5)) <= 1 + 1e-9


def test_language_model_learns_rare_contexts(spark):
    """Each of 3,000 context words holds less than 1/2000 of the tokens; its one follower is likelier than another's."""
    train = [(i, f"c{i % 3000} f{i % 3000} c{i % 3000} f{i % 3000}") for i in range(6000)]
    ask = [(10_000 + i, f"c{i} f{i + i % 2}") for i in range(40)]
    table = spark.createDataFrame(train + ask, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(table, F.col("doc_id") >= 10_000).collect()}
    right, wrong = [got[10_000 + i] for i in range(0, 40, 2)], [got[10_000 + i] for i in range(1, 40, 2)]
    assert min(right) > max(wrong) + 2


def test_seats_are_bounded():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 500, 100_000])
    t = lm.seat(c, np.full(5, 0.3), 0.6, rng)
    assert t[0] == 0 and t[1] == 1 and (t[2:] >= 1).all() and (t <= c).all()


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, docs, texts, keep):
    low = str.maketrans(C.ASCII_UPPER, C.ASCII_LOWER)
    groups = {}
    for i, t in texts:
        groups.setdefault((t or "").translate(low), []).append(i)
    want = {i: ((max if keep == "max" else min)(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exactdedup.groups(docs, keep=keep).collect()}
    assert got == want
    stays = exactdedup.drop_duplicates(docs, keep=keep)
    assert stays.columns == docs.columns and sorted(r["doc_id"] for r in stays.collect()) == sorted({k for k, _, _ in want.values()})


def test_exact_dedup_hot_group_and_edges(spark, empty):
    assert exactdedup.groups(empty).count() == 0
    rows = [(i, "Same text") for i in range(300)] + [(i, f"t{i}") for i in range(300, 400)] + [(None, "same text"), (7, "SAME TEXT")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exactdedup.groups(table, keep="max").where("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(299, 302)]
    assert exactdedup.drop_duplicates(table.unionByName(table)).where("text ilike 'same%'").count() == 1


def test_warc_round_trip(spark, tmp_path):
    big = "<html>" + "x" * 200
    rows = [(3, "http://a", big, 1), (1, "http://b\r\nX: y", big, 1), (2, None, None, 1), (4, "u", "", 1), (5, "u", "short", 1), (6, "u", "short", 1), (None, "u", big, 1), (7, "é", "é" * 60, 1), (7, "é", "é" * 60, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((tuple(r) for r in warc.page_records(pages, folder=f"file://{tmp_path}/w").collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and by[1] == (1, 206, sha(big), "response", None) and by[3] == (3, 206, sha(big), "revisit", 1)
    assert by[2] == (2, 0, sha(""), "response", None) and by[5][3] == by[6][3] == "response" and by[None][3:] == ("revisit", 1)
    assert by[7][1] == 120
    manifest = warc.write_archives(pages, f"file://{tmp_path}/v", archives=1)
    name = manifest.first()["archive"].removeprefix("file://")
    with zipfile.ZipFile(name) as z:  # another reader agrees
        assert z.testzip() is None and {i.filename for i in z.infolist()} == {warc.DATA, warc.INDEX}
        assert len(z.read(warc.INDEX).decode().splitlines()) == len(rows) and json.loads(z.read(warc.INDEX).decode().splitlines()[0])["offset"] == 0
    blocks = {r["page_id"]: r["block"] for r in warc.read_archives(manifest).where("record_type = 'response'").collect()}
    assert bytes(blocks[1]).decode() == big
    assert warc.page_records(pages.limit(0), folder=f"file://{tmp_path}/e").count() == 0


def test_zip_reader_takes_plain_archives(tmp_path):
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a/b.txt", b"hello")
        z.writestr("packed", b"x" * 999, compress_type=zipfile.ZIP_DEFLATED)
    raw = path.read_bytes()
    found = warc.members_of(lambda n, at: raw[at : at + n], len(raw))
    at, size = found["a/b.txt"]
    assert raw[at : at + size] == b"hello" and list(found) == ["a/b.txt"]
    with pytest.raises(ValueError):
        warc.members_of(lambda n, at: b"", 0)


def test_mixing(spark, docs, texts, empty):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 300)), rng.choice(["a", "b", "b", "c", "c", "c", "", None])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(table).collect()
    by = {}
    for r, src in ((r, {i: s for i, _, s in rows}[r["doc_id"]]) for r in got):
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(src, []).append(r)
    total = sum(r["size"] for r in got)
    order = sorted((s for s in by if s is not None)) + [None]
    size, weight = {s: sum(r["size"] for r in by[s]) for s in order}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = total, list(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * size[s]]
        if not over:
            want |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            want[s], left = 3 * size[s], left - 3 * size[s]
            open_.remove(s)
    for s in order:
        assert math.isclose(by[s][0]["target"], want[s], rel_tol=1e-9)
        assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= 32
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(table.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).count() == len(texts)
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns and applied.where("text = ''").count() == 0


def test_mix_keeps_null_ids(spark):
    rows = [(None if i < 3 else i, "a b c d " * 20, "s") for i in range(12)] + [(None, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs).where("doc_id is null and size > 0").agg(F.sum("taken") / F.sum("size")).first()[0]
    got = mixing.apply_mix(docs).where("doc_id is null").collect()
    assert taken >= 1 and len(got) == 3 * round(taken) and all(r["text"] for r in got)


def test_pipeline_runs_whole(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_docs(spark, 120)
    docs = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    twice = docs.unionByName(docs.where("doc_id between 10 and 20").withColumn("doc_id", F.col("doc_id") + 1000))
    twice.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in out)
    want = {i for i in range(120) if i % 6}
    assert set(ids) == want and max(ids.values()) == 1
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
