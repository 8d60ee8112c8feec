"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with block-max inverted indexes.

Training (bounded, documented): at most ``max_examples`` labelled rows, the first by a seeded digest of the id; of near
copies among them one stays, so that a group of copies has one voice: in order of ids an example goes if its word triples
have a Jaccard of at least ``copy`` with a kept example of the same label (met by one of eight min-hashes, then counted).
Terms are words (A-Z lower-cased, ASCII punctuation blanked) and their first 5 and 7 bytes. A term weighs
``tf / words * ln(1 + n / df) * phi ** 2`` with ``phi`` the correlation of the term and the label over the examples: terms that
tell nothing fade instead of being cut by a bar, so that the rule is the same at every number of examples. The
``max_terms`` of largest correlation are kept, and one more coordinate of ``rest`` tells cosine how dense they are. Vectors
have unit length.

Index: a term's postings are impacts over examples in blocks of ``block`` neighbours, with the largest impact of every
block. A query adds its terms' block maxima, visits blocks in falling order of that bound and stops when the bound is
below the k-th best cosine; what is near enough is scored again in double precision: the nearest examples are exact.

Votes weigh ``cosine ** 8``; with a weak prior vote they give a raw share, which a logistic curve fitted on
leave-one-out votes of the examples turns into a calibrated score. Evidence: the nearest examples' ids.

The index is bounded by ``max_examples`` rows of ``max_terms`` terms, so it is shipped to the executors; every whole
text is scored in one pass without a shuffle.

Defined results: null and empty texts, and texts without a weighted term, get the share of toxic examples without one (of
all examples if there is none) and no evidence; labels of a repeated doc_id count by majority, a tie as toxic, and of
its rows the smallest text is learnt from; rows with null ids are scored and are held out of learning; labels null are
ignored; with no usable label every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Lower-cases A-Z and blanks ASCII punctuation.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def stems_of(word: bytes) -> list[bytes]:
    """The word and its prefixes that may carry a weight."""
    return [word, *(word[:k] + b"*" for k in (5, 7) if len(word) > k)]


class _Memo(dict):
    """Numbers of a word's weighted terms; remembers up to ``room`` words."""

    room = 300_000

    def __init__(self, weights: dict[bytes, tuple[int, float]]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.room:
            self.clear()
        found = self[word] = tuple(self.weights[t][0] for t in stems_of(word) if t in self.weights)
        return found


class Index:
    """Block-max inverted index over unit vectors (``terms, weights`` arrays); exact top-k by cosine."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = 64):
        self.vectors, self.n, self.block = vectors, len(vectors), block
        self.blocks = (self.n + block - 1) // block
        self.terms = 1 + max((int(t.max()) for t, _ in vectors if len(t)), default=-1)
        self.impacts = np.zeros((self.terms, self.blocks, block), np.float32)
        for i, (t, w) in enumerate(vectors):
            self.impacts[t, i // block, i % block] = w
        self.maxima = self.impacts.max(axis=2, initial=0)

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k largest cosines above 0, largest first, ties to the smaller number."""
        use = query[0] < self.terms
        terms, weights = query[0][use], query[1][use].astype(np.float32)
        if not len(terms) or not self.n:
            return []
        bound = weights @ self.maxima[terms]
        order = np.argsort(-bound, kind="stable")
        seen, found, at, step, least = [], [], 0, 4, 0.0
        while at < len(order) and bound[order[at]] > 0 and bound[order[at]] >= least - 1e-5:
            some = order[at : at + step]
            near = np.einsum("t,tbi->bi", weights, self.impacts[np.ix_(terms, some)]).ravel()
            seen.append((some[:, None] * self.block + np.arange(self.block)).ravel())
            found.append(near)
            at, step = at + step, 2 * step
            whole = np.concatenate(found)
            if len(whole) > k + 1:  # one of them may be ``without``
                least = float(np.partition(whole, len(whole) - k - 1)[len(whole) - k - 1])
        if not seen:
            return []
        whole, ids = np.concatenate(found), np.concatenate(seen)
        close = ids[(whole > 0) & (whole >= least - 1e-5)]
        full = np.zeros(self.terms)
        full[terms] = query[1][use]
        best = [(float(full[t] @ w), i) for i in close.tolist() if i != without and i < self.n for t, w in (self.vectors[i],)]
        return sorted((p for p in best if p[0] > 0), key=lambda p: (-p[0], p[1]))[:k]


class Model:
    """What the executors get; bounded by the documented parameters. Term 0 is the constant coordinate."""

    def __init__(self, weights: dict[bytes, tuple[int, float]], examples: list[tuple[np.ndarray, np.ndarray, int, int]], prior: float, k: int, block: int, rest: float):
        self.weights, self.prior, self.k, self.block, self.rest = weights, prior, k, block, rest
        self.vectors = [(t, w) for t, w, _, _ in examples]
        self.labels = [float(y) for _, _, y, _ in examples]
        self.ids = [i for _, _, _, i in examples]
        self.curve = (1.0, 0.0)
        self._ready()

    def _ready(self) -> None:
        self.index, self.memo = Index(self.vectors, self.block), _Memo(self.weights)
        self.factor = np.array([0.0, *(w for _, w in sorted(self.weights.values()))])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "memo", "factor")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector as terms and weights; empty without a weighted term."""
        memo = self.memo
        hits = [t for w in words for t in memo[w]]
        if not hits:
            return np.empty(0, np.int64), np.empty(0)
        tf = np.bincount(hits, minlength=len(self.factor))
        terms = np.flatnonzero(tf)
        v = np.concatenate([[self.rest], tf[terms] * self.factor[terms] / len(words)])
        return np.concatenate([[0], terms]), v / math.sqrt(float(v @ v))

    def raw(self, query: tuple[np.ndarray, np.ndarray], without: int = -1) -> tuple[float, list[tuple[float, int]]]:
        found = self.index.nearest(query, self.k, without)
        votes, weight = 0.0, 0.0
        for s, i in found:
            votes, weight = votes + s**8 * self.labels[i], weight + s**8
        return (votes + 0.02 * self.prior) / (weight + 0.02), found

    def score(self, words: list[bytes]) -> tuple[float, list[int]]:
        query = self.vector(words)
        if not len(query[0]):
            return self.prior, []
        raw, found = self.raw(query)
        return self.calibrated(raw), [self.ids[i] for _, i in found]

    def calibrated(self, raw: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-min(max(a * logit(raw) + b, -30.0), 30.0)))

    def fit(self) -> None:
        """Logistic curve on leave-one-out votes, by Newton steps, halved while they do not lower the loss, with a weak pull to the identity."""
        x = np.array([logit(self.raw(v, i)[0]) for i, v in enumerate(self.vectors)])
        y = np.array(self.labels)

        def loss(at: np.ndarray) -> float:
            z = at[0] * x + at[1]
            return float((np.logaddexp(0, z) - y * z).sum() + ((at - (1.0, 0.0)) ** 2).sum() / 2)

        at = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -500, 500)))
            w = p * (1 - p)
            g = np.array([((p - y) * x).sum() + at[0] - 1, (p - y).sum() + at[1]])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step, now = np.linalg.solve(h, g), loss(at)
            while loss(at - step) > now and abs(step).max() > 1e-12:
                step = step / 2
            at = at - step
            if abs(step).max() < 1e-9:
                break
        self.curve = (float(at[0]), float(at[1]))


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


_TERMS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("term", pa.binary())])
_MINS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("mins", pa.list_(pa.int64()))])
_TRIPLES = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("triples", pa.binary())])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Distinct hashed word triples of texts with three words or more."""
    known = C.WordHash()
    for doc, toxic, text in C.rows_of(batches, ["doc_id", "toxic", "text"]):
        w = np.array([known[t] for t in terms_of(text)], np.uint64)
        if len(w) > 2:
            with np.errstate(over="ignore"):
                yield doc, toxic, np.unique(C.mix64(C.mix64(C.mix64(w[:-2]) + w[1:-1]) + w[2:]))


def _mins_of(h: np.ndarray) -> list[int]:
    return [int(C.mix64(h ^ C.mix64(np.array([s], np.uint64))).min().astype(np.int64)) for s in range(1, 9)]


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from C.emit(_MINS, ((doc, toxic, _mins_of(h)) for doc, toxic, h in _triples(batches)))


def _triple_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from C.emit(_TRIPLES, ((doc, toxic, h.tobytes()) for doc, toxic, h in _triples(batches)))


def near_copies(labelled: DataFrame, copy: float) -> list[int]:
    """Ids that go: each has a Jaccard of at least ``copy`` with a kept example of its label and a smaller id.

    The driver holds the triples of kept examples that share a min-hash with another."""
    mins = labelled.mapInArrow(_min_hashes, "doc_id long, toxic int, mins array<long>").collect()
    met = Counter((r["toxic"], *x) for r in mins for x in enumerate(r["mins"]))
    ask = sorted({r["doc_id"] for r in mins if any(met[r["toxic"], *x] > 1 for x in enumerate(r["mins"]))})
    if not ask:
        return []
    sets = labelled.where(F.array_contains(F.lit(ask), F.col("doc_id"))).mapInArrow(_triple_sets, "doc_id long, toxic int, triples binary").orderBy("doc_id")
    kept: dict[tuple, list[tuple[int, np.ndarray]]] = {}
    gone: list[int] = []
    for r in sets.toLocalIterator():
        doc, h = r["doc_id"], np.frombuffer(bytes(r["triples"]), np.uint64)
        places = [(r["toxic"], *x) for x in enumerate(_mins_of(h))]
        others = {id(k): k for place in places for i, k in kept.get(place, ()) if i != doc}
        if any(min(len(h), len(k)) >= copy * max(len(h), len(k)) and _jaccard(h, k) >= copy for k in others.values()):
            gone.append(doc)
        else:
            for place in places:
                if met[place] > 1:
                    kept.setdefault(place, []).append((doc, h))
    return sorted(set(gone))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _explode(gone: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = C.rows_of(batches, ["doc_id", "toxic", "text"])
        yield from C.emit(_TERMS, ((d, y, t) for d, y, text in rows if d not in gone for t in {s for w in set(terms_of(text)) for s in stems_of(w)}), 16384)

    return run


def _vectors(model: Model, gone: frozenset):
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = C.rows_of(batches, ["doc_id", "toxic", "text"])
        found = ((d, y, model.vector(terms_of(text))) for d, y, text in rows if d not in gone)
        yield from C.emit(schema, ((d, y, t.tolist(), w.tolist()) for d, y, (t, w) in found))

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, max_examples: int = 8_000, max_terms: int = 2_000, k: int = 16, block: int = 64, rest: float = 0.002, copy: float = 0.8, seed: int = 7) -> Model:
    """Fit on rows of ``labels`` (``doc_id, toxic``) for which ``learn`` (over ``doc_id``) holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(learn)
    known = known.groupBy("doc_id").agg(F.when(F.avg("toxic") >= 0.5, 1).otherwise(0).alias("toxic"))
    sample = known.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id")), "doc_id").limit(max_examples)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample has at most max_examples rows of two numbers: a bounded broadcast. A repeated id is one example.
    met = two.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    labelled = C.table(met, "toxic-examples")
    copies = near_copies(labelled, copy)
    gone = frozenset(copies)
    own = labelled if not copies else labelled.where(~F.array_contains(F.lit(copies), F.col("doc_id")))
    sums = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = int(sums["n"]), int(sums["pos"])
    if not n:
        return Model({}, [], 0.0, k, block, rest)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    # A term of every example, or labels all alike, tell nothing: the quotient is null and drops out.
    chi = F.try_divide(F.lit(float(n)) * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))
    terms = labelled.mapInArrow(_explode(gone), "doc_id long, toxic int, term binary").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    df = F.col("a") + F.col("b")
    top = terms.withColumn("chi", chi).where("chi > 0").orderBy(F.desc("chi"), "term").limit(max_terms).select("term", df.alias("df"), (F.col("chi") / n).alias("phi2")).collect()
    weights = {bytes(r["term"]): (i, math.log(1 + n / r["df"]) * r["phi2"]) for i, r in enumerate(sorted(top, key=lambda r: bytes(r["term"])), 1)}
    bare = Model(weights, [], 0.0, k, block, rest)
    rows = labelled.mapInArrow(_vectors(bare, gone), "doc_id long, toxic int, terms array<int>, weights array<double>").where(F.size("terms") > 0).collect() if weights else []
    # Neighbours of a block share terms: examples in order of their strongest term skip more blocks.
    made = [(np.array(r["terms"], np.int64), np.array(r["weights"]), int(r["toxic"]), r["doc_id"]) for r in rows]
    made.sort(key=lambda x: (int(x[0][1:][np.argmax(x[1][1:])]), -float(x[1][1:].max()), x[3]))
    zero_pos, zero = pos - sum(y for _, _, y, _ in made), n - len(made)
    model = Model(weights, made, zero_pos / zero if zero else pos / n, k, block, rest)
    if made:
        model.fit()
    return model


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from C.emit(_SCORED, ((doc, *model.score(terms_of(text))) for doc, text in C.rows_of(batches, ["doc_id", "text"])))

    return run


def _score_with(model: Model, names: list[str], text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([model.score(terms_of(t))[0] for t in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, evidence`` (ids of the nearest examples, nearest first) for every row."""
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.mapInArrow(_score(model), "doc_id long, score double, evidence array<long>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (all its columns, whatever their names) whose score is below the threshold; null and empty texts
    are scored like any other, and an empty table stays empty."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    name = C.fresh("toxic_score", docs.columns)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    scored = docs.mapInArrow(_score_with(model, [*docs.columns, name], docs.columns.index("text")), schema)
    return scored.where(F.col(name) < threshold).drop(name)
