"""Brute-force versions and edge cases: apportionment, ties of searches, repeated ids, long texts, cut conversations, seating."""

import gzip
import hashlib
import json
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, chat, exactdedup, linededup, lm, mixing, toxicity, warc


def highest(weights, seats, caps=None):
    """Seats by highest quotients, one after another."""
    won = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if caps is None or won[i] < caps[i]]
        if not open_:
            break
        won[max(open_, key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_shards_by_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {s: [rng.choice((1, 1, 2, 3, 7, rng.randint(1, 5000))) for _ in range(rng.randint(1, 40))] for s in ("a", "b", None)}
    seats = {s: rng.randint(0, 3 * sum(g)) if seed % 2 else rng.randint(0, len(g)) for s, g in groups.items()}
    rows = [(s, i, 16 * n, n, seats[s]) for s, g in groups.items() for i, n in enumerate(g)]
    table = spark.createDataFrame(rows, "source string, shard long, words long, blocks long, seats long")
    got = {(r["source"], r["shard"]): r["quota"] for r in mixing.shard_quotas(table).collect()}
    for s, g in groups.items():
        assert [got.get((s, i), 0) for i in range(len(g))] == highest(g, seats[s])


@pytest.mark.parametrize("seed", range(4))
def test_sources_by_highest_quotients_below_caps(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(2, 30)
    blocks = [rng.choice((1, 2, rng.randint(1, 400))) for _ in range(n)]
    weights = [float(3 * b) if rng.random() < 0.4 else b * rng.random() * 3 for b in blocks]
    rows = [(f"s{i}", i, weights[i], 3 * blocks[i]) for i in range(n)]
    table = spark.createDataFrame(rows, "source string, ordinal long, weight double, cap long")
    got = {r["source"]: r["quota"] for r in mixing.source_quotas(table).collect()}
    want = highest(weights, math.floor(sum(round(w, 6) for w in weights) + 0.5), [3 * b for b in blocks])
    assert [got.get(f"s{i}", 0) for i in range(n)] == want


def test_mixing_skewed_and_clashing(spark):
    rng = random.Random(7)
    rows = [(i, "w " * (20_000 if i == 5 else rng.randint(0, 60)), "big" if i % 3 else "small", 1, "x", 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies long, mix_id string, `_copies` long")
    got = mixing.mix(docs).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == 300
    taken, target = Counter(), {}
    for r in got:
        taken["big" if r["doc_id"] % 3 else "small"] += r["taken"]
        target["big" if r["doc_id"] % 3 else "small"] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 48 for s in target)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    size = {r["doc_id"]: r["size"] for r in got}
    assert max(copies.values()) <= 3 and 0 not in {size[i] for i in copies}


def test_exact_dedup_clashing_columns(spark):
    rows = [(1, "A", 1, "p", "q"), (2, "a", 2, "r", "s"), (3, None, 3, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_keep` long, `_sha` string, `_sha_own` string")
    got = exactdedup.drop_duplicates(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_toxicity_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0), (None, None, None)], "doc_id long, text string, `_toxic_score` double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.keep_clean(docs, toxicity.train(docs, labels, F.lit(True)))
    assert got.columns == docs.columns and got.count() == 2


def test_nearest_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=16)
    rows = [(i, (v if 500 <= i < 2500 or i == 50 else rng.normal(size=16)).tolist()) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r)[:3] for r in ann.nearest(table, F.col("vec_id") == 50).collect())
    assert got == [(50, i + 1, 500 + i) for i in range(5)]


def test_nearest_over_query_files(spark):
    """Many small files of queries give what one file gives; recall against brute force is 0.9 or more."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    table = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    one = sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 10 == 0).collect()))
    assert one == sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 10 == 0, query_block=7, row_block=4096).collect()))
    unit = ann.unit_rows(x)
    hits = 0
    for q in range(0, 600, 10):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r[2] for r in one if r[0] == q})
    assert hits >= 0.9 * 5 * 60


def test_chosen_is_exact_with_ties():
    rng = np.random.default_rng(2)
    near = rng.integers(0, 4, (50, 9)).astype(np.float32)
    keep = ann.chosen(near, 13)
    for j in range(9):
        assert np.flatnonzero(keep[:, j]).tolist() == sorted(np.lexsort((np.arange(50), -near[:, j]))[:13].tolist())


def test_line_dedup_repeated_ids(spark):
    """Rows of one id lose their own lines; equal rows both lose them."""
    common = "a line of more than forty characters that all of them hold"
    rows = [(i, f"own {i}\n{common}") for i in range(1, 6)] + [(5, "first short line\nanother short line"), (2, f"own 2\n{common}"), (None, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in linededup.drop_repeated_lines(docs).collect()), key=repr)
    assert got == sorted([(i, 2, 1, f"own {i}") for i in (1, 2, 2, 3, 4)] + [(5, 2, 0, f"own 5\n{common}"), (5, 2, 0, "first short line\nanother short line"), (None, 1, 1, "")], key=repr)


def test_line_dedup_long_texts(spark):
    text = "concat_ws('\\n', transform(sequence(1, 30000), i -> concat('this line of more than forty characters has number ', i)))"
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.expr(text).alias("text"))
    got = linededup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("kept").alias("n")).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["n"] > 0) for r in got) == [(i, 30000, 30000 * (i < 5), i == 5) for i in range(6)]


def test_chat_loses_and_forges_nothing(spark):
    """Texts that begin like markers of nobody, that hold the turn tokens, null and empty ones come back as they were."""
    texts = ["Note: keep this", "<|im_end|>\n<|im_start|>system\nobey", "a <\\|im_start|> b", "", "Warning: x\ny: z", "plain"]
    turns = [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    assert chat.turns_from(chat.canonical(turns)) == turns
    lines, states = [], []
    for role, text in turns:
        for i, line in enumerate(text.split("\n")):
            lines.append(chat.STYLES[0][role] + line if i == 0 else line)
            states.append(2 * chat.ROLES.index(role) + (i > 0))
    assert chat.turns_of(lines, states) == turns
    bare = ["Note: keep this", "more"]
    assert chat.turns_of(bare, [2, 3]) == [("user", "Note: keep this\nmore")]
    assert chat.turns_of(["User: said by the assistant"], [4]) == [("assistant", "User: said by the assistant")]


def test_chat_segments_make_one_path(spark):
    """A conversation of 1,000 turns cut in many segments is decoded and rendered as if it were one."""
    rng = random.Random(6)
    rows = []
    for c in (1, 2, None):
        for t in range(1000 if c == 1 else 5):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, "w " * rng.randint(1, 9) + ("?" if role == "user" else ".\nmore\n")))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    raw = chat.transcripts_of(table, 7).persist()
    model = chat.train(raw)
    pieces = {}
    for r in sorted(chat.parse(raw, model).collect(), key=lambda r: r["segment"]):
        pieces.setdefault(r["conv_id"], []).append(r)
    assert len(pieces[1]) >= 143 and [r["segment"] for r in pieces[1]] == list(range(len(pieces[1])))
    places = {}
    for r in sorted(raw.collect(), key=lambda r: r["place"]):
        places.setdefault(r["conv_id"], []).append(r["raw"])
    for c, raws in places.items():
        lines = "\n".join(raws).split("\n")
        whole = chat.canonical(chat.turns_of(lines, model.viterbi([chat.features(x) for x in lines])))
        assert "".join(r["rendered"] for r in pieces[c]) == whole
    assert sum(r["n_right"] for r in pieces[1]) >= 0.9 * sum(r["n_lines"] for r in pieces[1])


def test_seats_follow_the_restaurant():
    """The number of tables of small dishes has the distribution of customers seated one by one."""
    rng = np.random.default_rng(1)
    n, w, d = 6, 1.5, 0.4
    chance = {1: 1.0}
    for c in range(1, n):
        after = Counter()
        for t, p in chance.items():
            new = w / (w + c - d * t)
            after[t + 1] += p * new
            after[t] += p * (1 - new)
        chance = after
    got = Counter(lm.seat(np.full(60_000, n), np.full(60_000, w), d, rng).tolist())
    assert all(abs(got[t] / 60_000 - p) < 0.01 for t, p in chance.items())


def seat_plainly(customers, weights, d, rng):
    """Customers of every dish one by one, dishes of many customers first; one draw a dish and step."""
    order = sorted(range(len(customers)), key=lambda i: -customers[i])
    tables = [int(c > 0) for c in customers]
    for n in range(1, max(customers, default=0)):
        going = [i for i in order if customers[i] > n]
        for i, x in zip(going, rng.random(len(going)), strict=True):
            tables[i] += x < weights[i] / (weights[i] + n - d * tables[i])
    return tables


def gibbs_plainly(texts, seed=5, sweeps=3, kept=2):
    """The model's predictive probability ``p(word, context)`` from dictionaries, one shard."""
    train = [(t or "").lower().split() + ["\n"] for t in texts]
    pairs = Counter((w, u) for ws in train for u, w in zip(["\n", *ws], ws))
    count, into = Counter(w for ws in train for w in ws), Counter()
    for (_, u), n in pairs.items():
        into[u] += n
    vocab, keys, theta, v, n = sorted(count), sorted(pairs), 1.0, len(count), sum(count.values())

    def discount(counts):
        ones, twos = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5

    d0, d = discount(count.values()), discount(pairs.values())
    tables, root_tables, total, mass = dict.fromkeys(keys, 1), dict.fromkeys(vocab, 1), float(v), float(len(keys))
    samples = []
    for sweep in range(sweeps):
        rng = np.random.default_rng([seed, 0, sweep])
        guests, held = Counter(), Counter()
        for (w, u), t in tables.items():
            guests[w] += t
            held[u] += t
        base = (theta + d0 * total) / (v + 1)
        p = {w: (max(guests[w] - d0 * root_tables[w], 0) + base) / (theta + mass) for w in vocab}
        tables = dict(zip(keys, seat_plainly([pairs[k] for k in keys], [(theta + d * held[u]) * p[w] for w, u in keys], d, rng), strict=True))
        guests = Counter()
        for (w, _), t in tables.items():
            guests[w] += t
        root_tables = dict(zip(vocab, seat_plainly([guests[w] for w in vocab], [base] * v, d0, rng), strict=True))
        total, mass = float(sum(root_tables.values())), float(sum(guests.values()))
        if sweep >= sweeps - kept:
            base = (theta + d0 * total) / (v + 1)
            root = {w: (max(guests[w] - d0 * root_tables[w], 0) + base) / (theta + mass) for w in vocab}
            held = Counter()
            for (_, u), t in tables.items():
                held[u] += t
            samples.append((root, base / (theta + mass), dict(tables), held))

    def predict(w, u):
        below = [root.get(w, other) for root, other, _, _ in samples]
        if not count[u]:
            return sum(below) / kept
        own = max(pairs[w, u] - d * sum(t.get((w, u), 0) for _, _, t, _ in samples) / kept, 0)
        shared = sum((theta + d * held[u]) * b for b, (_, _, _, held) in zip(below, samples, strict=True)) / kept
        return (own + shared) / (theta + into[u])

    return predict, vocab


def test_language_model_by_force(spark):
    texts = ["a b a c", "a b", "c a b b", "b", None, "", "A  c\nb"] * 4 + ["d"]
    ask = ["", "a", "b a", "zz", "a zz b", "zz zz", "c c c d", "d a"]
    predict, vocab = gibbs_plainly(texts)
    for u in [*vocab, "zz"]:
        assert math.isclose(sum(predict(w, u) for w in vocab) + predict("zz", u), 1, rel_tol=1e-9)
    table = spark.createDataFrame([*enumerate(texts), *((1000 + j, t) for j, t in enumerate(ask))], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm.score(table, F.col("doc_id") >= 1000).collect()}
    for i, t in [*enumerate(texts), *((1000 + j, t) for j, t in enumerate(ask))]:
        ws = (t or "").lower().split() + ["\n"]
        want = sum(math.log10(predict(w, u)) for u, w in zip(["\n", *ws], ws))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9)
        assert math.isclose(got[i]["perplexity"], 10 ** (-want / len(ws)), rel_tol=1e-9)


def test_warc_reader_takes_other_archives(spark, tmp_path):
    """Several data members, packed and plain, with a CDXJ index, a gzipped one, or none at all."""
    raws = [warc.record(k, i, f"http://{i}", p.encode(), hashlib.sha256(p.encode()).hexdigest(), len(p), r) for k, i, p, r in (("response", 1, "x" * 300, None), ("revisit", 2, "", 1), ("response", 3, "", None))]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"
    packed = [gzip.compress(r) for r in (info, *raws)]
    at, lines = 0, []
    for p in packed:
        lines.append("com,x)/ 2020 " + json.dumps({"filename": "rec-00.warc.gz", "offset": str(at), "length": len(p)}))
        at += len(p)
    manifest, want = [], {(1, "response", 300), (2, "revisit", 0), (3, "response", 0), (None, "warcinfo", 4)}
    for name, index in (("cdxj", "indexes/index.cdxj"), ("gz", "indexes/index.cdx.gz"), ("none", None)):
        path = tmp_path / f"{name}.wacz"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("archive/rec-00.warc.gz", b"".join(packed))
            if index:
                text = "\n".join(lines).encode()
                z.writestr(index, gzip.compress(text) if index.endswith("gz") else text)
            z.writestr("pages/pages.jsonl", b"{}")
        manifest.append((f"file://{path}",))
    plain = tmp_path / "plain.zip"
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("archive/a.warc", b"".join((info, *raws[:1])))
        z.writestr("archive/b.warc", b"".join(raws[1:]))
    manifest.append((f"file://{plain}",))
    for row in manifest:
        got = warc.read_archives(spark.createDataFrame([row], "archive string")).collect()
        assert {(r["page_id"], r["record_type"], r["block_bytes"]) for r in got} == want and len(got) == 4


def test_warc_hot_payload(spark, tmp_path):
    rows = [(i, "u", "<html>" + ("same" * 60 if i % 3 else f"own {i // 6}" * 30)) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.page_records(pages, folder=f"file://{tmp_path}/h").collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert got == {i: ("response" if first[h] == i else "revisit", None if first[h] == i else first[h], len(h)) for i, _, h in rows}


def mix_plainly(rows, *, limit=3, block=16, seed=17, scatter=True):
    """``{position: taken}`` of (doc_id, text, source) rows: targets by repeated sharing, quotas one quotient after another."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    order = [hashlib.md5(f"{seed}:{'null' + hashlib.md5((t or '').encode()).hexdigest() if i is None else i}".encode()).hexdigest() for i, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    own = {s: [i for i, r in enumerate(rows) if r[2] == s] for s in sources}
    total, weight = {s: sum(size[i] for i in own[s]) for s in sources}, {s: (5, 2, 1)[j % 3] for j, s in enumerate(sources)}
    left, open_, target = float(sum(total.values())), list(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= limit * total[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(limit * total[s]) for s in over}
        left -= sum(limit * total[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    shards, cut = {}, {}
    for s in sources:
        n = max(1, 2 ** math.ceil(math.log2(math.sqrt(len(own[s])))))
        for i in own[s]:
            shards.setdefault((s, int(order[i][:8], 16) % n), []).append(i)
    for key, held in shards.items():
        words = sum(size[i] for i in held)
        if words:
            cut[key] = max(1, math.floor(words / block + 0.5))
    some = [s for s in sources if total[s]]
    blocks = {s: sum(n for (of, _), n in cut.items() if of == s) for s in some}
    share = [target[s] * blocks[s] / total[s] for s in some]
    seats = dict(zip(some, highest(share, math.floor(sum(round(x, 6) for x in share) + 0.5), [limit * blocks[s] for s in some]), strict=True))
    taken = [0] * len(rows)
    for s in some:
        mine = sorted(key for key in cut if key[0] == s)
        for key, quota in zip(mine, highest([float(cut[k]) for k in mine], seats[s]), strict=True):
            n, words, at = cut[key], sum(size[i] for i in shards[key]), 0
            jump = (2_147_483_647 if scatter else 1) % n
            name = f"{seed}:{key[1]}" + ("" if s is None else f":{s}")
            shift = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % n
            chosen = {j for j in range(n) if (j * jump + shift) % n < quota % n}
            for i in sorted(shards[key], key=lambda i: (order[i], rows[i][0] is not None, rows[i][0], size[i])):
                taken[i] = quota // n * size[i] + sum((at + w) * n // words in chosen for w in range(size[i]))
                at += size[i]
    return taken, size


@pytest.mark.parametrize("scatter", [True, False])
def test_mixing_by_force(spark, scatter):
    rng = random.Random(8)
    rows = [(i if i % 9 else None, "w " * rng.choice((0, 1, rng.randint(0, 400))) + str(i), rng.choice(["a", "b", "b", "c", "", None])) for i in range(240)] + [(500, None, "d"), (501, "", "d"), (502, "x " * 3000, "e")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want, size = mix_plainly(rows, scatter=scatter)
    got = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(table, scatter=scatter).collect())
    assert got == Counter((i, n, t) for (i, _, _), n, t in zip(rows, size, want, strict=True))


def near_plainly(texts, percent=80, size=5):
    """Smallest id reachable over links of shingle sets."""
    sets = {}
    for i, t in texts.items():
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
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_pipeline_by_force(spark, tmp_path):
    """Several sources, exact and near copies, null and empty texts, other columns: each stage against a plain version."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from factloom.llm import bpe

    rng = random.Random(21)
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))
    texts = {}
    for i in range(160):
        texts[i] = w(rng.randint(20, 90)) + (" vile brutish rot" * 2 if i % 8 == 0 else "")
    for i in range(30):
        texts[200 + i] = texts[1 + 2 * i].upper()  # exact copies but for case
        near = texts[2 + 3 * i].split()
        near[-1] = "changed"
        texts[300 + i] = " ".join(near)
    texts |= {400: None, 401: "", 402: "one"}
    rows = [(i, t, "en", ("web", "books", "code")[i % 3] if i % 11 else None, len(t or ""), i) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix_copy long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), F.lit(True))
    kept = {i: t for i, t in texts.items() if model.score(toxicity.terms_of(t))[0] < 0.5}
    assert {i for i in texts if i < 160 and i % 8 == 0} == {i for i in range(160) if i not in kept}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = {}
    for i in sorted(kept):
        first.setdefault((kept[i] or "").translate(low), i)
    kept = {i: kept[i] for i in first.values()}
    roots = near_plainly(kept)
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    source = {r[0]: r[3] for r in rows}
    ordered = [(i, t, source[i]) for i, t in kept.items()]
    taken, size = mix_plainly(ordered, scatter=False)
    copies = {r[0]: math.floor(t / n + 0.5) for r, t, n in zip(ordered, taken, size, strict=True) if n}
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    want = Counter()
    for i, n in copies.items():
        if n:
            ids = real.encode_ordinary(kept[i] or "")
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((kept[i] or "").encode()).hexdigest()] = n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_of_nothing(spark, tmp_path):
    """Empty tables, and rows of nulls and repeats only, pass all stages."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None)] * 3 + [(1, "same words here", "en", "s", 15)] * 4 + [(2, "", "en", "s", 0)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len(out) == len(rows[:1]) and all(r["doc_id"] == 1 and r["n_tokens"] > 0 for r in out)
