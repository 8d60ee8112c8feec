"""Near-duplicate grouping with SuperMinHash.

1. One pass turns every whole text into its set of word shingles (hashed to 64 bits), a digest of the set and a
   SuperMinHash signature: element by element a random permutation deals one rank per slot, so the slots of one
   element differ in rank (``step + fraction``), and an element stops as soon as the next rank exceeds the
   largest value that its document's signature still holds. Texts of many shingles stop after one step.
2. Documents with equal sets collapse to one representative (the smallest id) by an aggregate on the digest.
3. Signatures are cut in bands; representatives that agree in a band are candidates. Buckets with the same
   members count once. A bucket of up to ``tile`` members is compared in one task. The members of a larger one are first
   dealt in chunks, each with the bucket's smallest member as a hub, and the links found give components; most large
   groups are one component by then and done. Of the others, every member outside the bucket's largest component
   meets all members in further tiles of at most ``wide_tile`` members or ``tile_shingles`` shingles: a text goes to as
   many tasks as there are tiles of those outsiders, no task gathers a large bucket and no pair is lost.
4. Links are confirmed on full sets: ``100 * intersection >= percent * union``; only a spanning forest leaves a task.
5. Components by alternating large-star and small-star steps on written tables (logarithmically many).

Recall of the bands at the threshold is ``1 - (1 - j^r)^b``: with r 5, b 24, j 0.85 about 0.9999992 a pair.

Defined results: null or empty texts and texts without words have an empty set, are linked with nothing and
kept; with fewer words than a shingle the whole sequence is the one shingle; a null id takes part in nothing
(component null, kept); rows that repeat an id are one node; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


#: Bytes of a text, or shingles, that are worked on at a time, so that a very long text needs little more than its hashes.
_SLICE = 1 << 19


def word_codes(text: str | None, words_of: C.WordHash) -> list[np.ndarray]:
    """Hashes of a text's words in order, a slice of the text at a time."""
    raw, at, out = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
    while at < len(raw):
        end = at + _SLICE
        if end < len(raw):
            gap = _BLANK.search(raw, end)
            end = gap.start() if gap else len(raw)
        words = raw[at:end].split()
        out.append(np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words)))
        at = end
    return out


def shingle_hashes(texts: list[str | None], size: int, words_of: C.WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts one after another, repeats included, and each text's number of them."""
    codes = [word_codes(t, words_of) for t in texts]
    lengths = np.fromiter((sum(map(len, c)) for c in codes), np.int64, len(texts))
    w = np.concatenate([np.empty(0, np.uint64), *(part for c in codes for part in c)])
    n = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    ends, starts = np.cumsum(n), np.cumsum(lengths) - lengths
    out = np.zeros(int(n.sum()), np.uint64)
    for low in range(0, len(out), _SLICE):
        place = np.arange(low, min(low + _SLICE, len(out)))
        text = np.searchsorted(ends, place, side="right")
        at, held = starts[text] + place - (ends[text] - n[text]), lengths[text]
        value = np.zeros(len(place), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                term = C.mix64(w[np.minimum(at + k, len(w) - 1)] + np.uint64(k + 1))
                value = np.where((held < size) & (held <= k), value, value * _ODD + term)
        out[low : low + len(place)] = C.mix64(value)
    return out, n


def superminhash(h: np.ndarray, n: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (texts x slots): ``step << 56 | fraction``; all ones where a text has no shingle."""
    texts = len(n)
    sig = np.full(texts * slots, _TOP, np.uint64)
    doc = np.repeat(np.arange(texts, dtype=np.int32), n)

    def step(state: np.ndarray, doc: np.ndarray, j: int, perm: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        state = C.mix64(state + _ODD)
        pick = j + (C.mix64(state ^ _ODD) % np.uint64(slots - j)).astype(np.int64)
        slot = pick
        if perm is not None:
            rows = np.arange(len(state))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, doc.astype(np.int64) * slots + slot, np.uint64(j << 56) | (state >> np.uint64(8)))
        return state, slot

    with np.errstate(over="ignore"):
        # Every shingle takes the first step, in slices; few take more.
        for low in range(0, len(h), _SLICE):
            step(h[low : low + _SLICE], doc[low : low + _SLICE], 0, None)
        keep = (sig.reshape(texts, slots).max(axis=1) >= np.uint64(1 << 56))[doc]
        state, doc = h[keep], doc[keep]
        state = C.mix64(state + _ODD)
        first = (C.mix64(state ^ _ODD) % np.uint64(slots)).astype(np.int64)
        perm = np.tile(np.arange(slots, dtype=np.uint8), (len(state), 1))
        rows = np.arange(len(state))
        perm[rows, first] = 0
        perm[:, 0] = first
        for j in range(1, slots):
            if not len(state):
                break
            state, _ = step(state, doc, j, perm)
            keep = (sig.reshape(texts, slots).max(axis=1) >= np.uint64((j + 1) << 56))[doc]
            state, doc, perm = state[keep], doc[keep], perm[keep]
    return sig.reshape(texts, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = C.mix64(key * _ODD + cut[:, :, r])
    return key.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(size: int, bands: int, rows: int, chunk: int = 60_000):
    slots = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = C.WordHash()

        def flush(ids: list, texts: list) -> Iterator[tuple]:
            h, n = shingle_hashes(texts, size, words_of)
            keys = band_keys(superminhash(h, n, slots), bands, rows)
            end = 0
            for i, (doc, long) in enumerate(zip(ids, n.tolist(), strict=True)):
                own = np.unique(h[end : end + long])
                end += long
                if long:
                    yield doc, len(own), xxhash.xxh3_128_digest(own.tobytes()), keys[i].tolist()
                else:
                    yield doc, 0, None, None

        def out() -> Iterator[tuple]:
            ids, texts, chars = [], [], 0
            for doc, text in C.rows_of(batches, ["doc_id", "text"]):
                ids.append(doc)
                texts.append(text)
                chars += len(text or "")
                if chars > 6 * chunk:
                    yield from flush(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield from flush(ids, texts)

        yield from C.emit(_SIGNED, out(), 2048)

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sets reach the threshold; with two sides only pairs across them."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        small, large = n.min(), n.max()
        if 100 * small < percent * large:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inter = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
    else:
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1
        keep = counts[column] > 1
        row = np.repeat(np.arange(len(sets)), n)[keep]
        column = shared[column[keep]]
        total = int((counts > 1).sum())
        inter = np.zeros((len(sets), len(sets)), np.float64)
        step = max(256, 4_000_000 // len(sets))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, total, step):
            i, j = np.searchsorted(column, (low, low + step))
            part = np.zeros((len(sets), min(step, total - low)), np.float32)
            part[row[i:j], column[i:j] - low] = 1
            inter += part @ part.T
        inter = np.rint(inter).astype(np.int64)
    union = n[:, None] + n[None, :] - inter
    hit = np.triu(100 * inter >= percent * union, 1)
    if side.any() and not side.all():
        hit &= side[:, None] != side[None, :]
    return np.nonzero(hit)


def forest(ids: list[int], pairs: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Union-find over the pairs: each joined node with its component's smallest id."""
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(*(p.tolist() for p in pairs), strict=True):
        a, b = root(a), root(b)
        if a != b:
            low, high = (a, b) if ids[a] <= ids[b] else (b, a)
            up[high] = low
    return [(ids[x], ids[r]) for x in range(len(ids)) if (r := root(x)) != x]


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = C.WordHash()

        def out() -> Iterator[tuple]:
            for _, group in C.groups_of(C.rows_of(batches, ["unit", "side", "rep", "text"]), 1):
                ids, sides, sets = [], [], []
                for _, side, rep, text in group:
                    h, _ = shingle_hashes([text], size, words_of)
                    ids.append(rep)
                    sides.append(side)
                    sets.append(np.unique(h))
                if len(ids) > 1:
                    yield from forest(ids, linked_pairs(sets, np.asarray(sides, bool), percent))

        yield from C.emit(_LINKS, out())

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: root is the smallest id reachable.

    Alternating stars: every node sends its larger neighbours to its smallest neighbour, then its smaller ones.
    Each half step is a partial aggregate and a join on written tables, so a hub is split, not gathered."""
    edges = C.table(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    print_of = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = C.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = C.table(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), name)
        least = C.table(large.groupBy("hi").agg(F.min("lo").alias("m")), name)
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        edges = C.table(small.distinct(), name)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first()
        if now == print_of:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        print_of = now


def _checked(units: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` within units (``rep, unit, side``); with both sides in a unit, links across them."""
    units = C.table(units, "minhash-units")
    # A merge join at every size: the candidates grow with the corpus, so their list is never broadcast.
    payload = units.join(texts.hint("merge"), "rep").repartition(C.width(units.sparkSession), "unit").sortWithinPartitions("unit", "side", "rep").select("unit", "side", "rep", "text")
    return C.table(payload.mapInArrow(_verify(size, percent), "a long, b long"), "minhash-links")


def links_of(reps: DataFrame, texts: DataFrame, *, size: int, percent: int, tile: int, chunk: int, wide_tile: int, tile_shingles: int) -> DataFrame:
    """Confirmed links ``a, b`` between representatives; ``reps`` has ``rep, weight, bands``, ``texts`` has ``rep, text``."""
    dealt = reps.select("rep", "weight", F.explode("bands").alias("bucket"))
    buckets = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("n > 1")
    chosen = C.table(buckets.groupBy("n", "low", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "low"), "minhash-buckets")
    members = C.table(dealt.join(chosen, "bucket"), "minhash-members")
    chunks = F.when(F.col("n") > tile, F.ceil(F.col("n") / F.lit(float(chunk)))).otherwise(F.lit(1)).cast("int")
    own = members.where(F.col("rep") != F.col("low")).select("rep", F.xxhash64("bucket", F.pmod(F.xxhash64("rep", F.lit(7)), chunks)).alias("unit"))
    hubs = chosen.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), (chunks - 1).cast("long")))).select(F.col("low").alias("rep"), F.xxhash64("bucket", "at").alias("unit"))
    first = _checked(own.unionByName(hubs).withColumn("side", F.lit(False)), texts, size, percent)
    if chosen.where(F.col("n") > tile).limit(1).isEmpty():
        return first
    roots = components(first)
    placed = members.where(F.col("n") > tile).join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "weight", F.coalesce("root", "rep").alias("root"))
    placed = C.table(placed, "minhash-placed")
    shares = placed.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("weight").alias("w"))
    largest = shares.groupBy("bucket").agg(F.max(F.struct("m", "w", "root")).alias("main"), F.sum("m").alias("m"), F.sum("w").alias("w"))

    def tiles(m: Column, w: Column) -> Column:
        return F.greatest(F.ceil(m / F.lit(float(wide_tile))), F.ceil(w / F.lit(float(tile_shingles)))).cast("long")

    open_ = largest.where(F.col("m") > F.col("main.m")).select(F.col("bucket").alias("of"), F.col("main.root").alias("main"), tiles(F.col("m") - F.col("main.m"), F.col("w") - F.col("main.w")).alias("outer"), tiles(F.col("main.m"), F.col("main.w")).alias("inner"))
    open_ = C.table(open_, "minhash-open")
    if open_.limit(1).isEmpty():
        return first
    met = placed.join(open_, F.col("bucket") == F.col("of"))
    zero = F.lit(0).cast("long")
    deal = lambda n: F.pmod(F.xxhash64("rep", F.lit(9)), n)
    out = met.where(F.col("root") != F.col("main")).withColumn("own", deal(F.col("outer")))
    among = out.withColumn("other", F.explode(F.sequence(zero, F.col("outer") - 1))).select("rep", F.xxhash64("bucket", F.lit(1), F.least("own", "other"), F.greatest("own", "other")).alias("unit"), (F.col("own") > F.col("other")).alias("side"))
    across = out.withColumn("other", F.explode(F.sequence(zero, F.col("inner") - 1))).select("rep", F.xxhash64("bucket", F.lit(2), "own", "other").alias("unit"), F.lit(False).alias("side"))
    inside = met.where(F.col("root") == F.col("main")).withColumn("own", deal(F.col("inner"))).withColumn("other", F.explode(F.sequence(zero, F.col("outer") - 1))).select("rep", F.xxhash64("bucket", F.lit(2), "other", "own").alias("unit"), F.lit(True).alias("side"))
    units = C.table(among.unionByName(across).unionByName(inside), "minhash-outer")
    # Few texts are asked for again: the join that picks them is left to Spark, which broadcasts ids only below its size limit.
    again = texts.join(C.table(units.select("rep").distinct(), "minhash-again"), "rep", "left_semi")
    return first.unionByName(_checked(units, again, size, percent))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 24, rows: int = 5, tile: int = 256, chunk: int = 64, wide_tile: int = 1024, tile_shingles: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``."""
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = C.table(two.mapInArrow(_sign(size, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "minhash-signed")
    some = signed.where("doc_id is not null and set_key is not null")
    classes = C.table(some.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    member = C.table(some.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep"), "minhash-members")
    reps = some.join(classes, (some.set_key == classes.set_key) & (some.doc_id == classes.rep), "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("weight"), "bands")
    texts = two.select(F.col("doc_id").alias("rep"), "text")
    links = links_of(reps, texts, size=size, percent=percent, tile=tile, chunk=chunk, wide_tile=wide_tile, tile_shingles=tile_shingles)
    # Rows that repeat an id with other texts make that id one node.
    again = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    roots = C.table(components(links.unionByName(again), "minhash-links"), "minhash-roots")
    whole = member.join(roots, member.rep == roots.node, "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(C.table(whole, "minhash-component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
