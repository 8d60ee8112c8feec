"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Codebooks: unit vectors are cut in subspaces of ``sub`` dimensions with 16 centroids each. They are fitted on a bounded
sample (``sample`` vectors, the first by a seeded digest) by alternating steps on the anisotropic loss
``|r|^2 + (eta - 1) * (r . x)^2`` of the residual ``r = x - code(x)``: error parallel to the vector, which changes
large inner products most, counts ``eta`` times. Codes are chosen by coordinate descent on that loss.

Index: every row is encoded in one pass, two four-bit codes a byte, kept with its vector in the files of a written table.
Search: tasks write the queries to the shared folder in files of at most ``query_block``; pairs of a query file and a
group of index files are rows, dealt over tasks that read both. A task builds each query's tables of 16 inner products a
subspace, scans the codes of ``row_block`` rows at a time, keeps the best ``rerank`` of each query (equal estimates:
the smaller ids), scores them exactly in double precision on the original vectors and passes on its ``k`` best; a window
joins the groups' lists. Every row is scanned, so no cell is hot, and a frequent vector is a row like any other.

Defined results: vectors that are null, zero or hold a null, NaN or infinite component, or whose length is not the
commonest one of the table's usable vectors (the longer of equally common ones), and rows with a null id, take no part;
ids that repeat count as rows of their own, a query never meets rows of its own id; ties go to the smaller id; with fewer
candidates than ``k`` all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


class Codebook:
    """Anisotropic product codebook: ``centroids`` of shape (subspaces, 16, sub)."""

    def __init__(self, dims: int, sub: int, eta: float):
        self.dims, self.sub, self.eta = dims, sub, eta
        self.parts = (dims + sub - 1) // sub
        self.centroids = np.zeros((self.parts, 16, sub), np.float32)

    def cut(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * self.sub), np.float32)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), self.parts, self.sub)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows x parts) of unit vectors, by coordinate descent on the anisotropic loss."""
        cut = self.cut(x)
        codes = np.empty((len(x), self.parts), np.uint8)
        own = np.einsum("nps,nps->np", cut, cut)
        parallel = np.zeros(len(x), np.float32)
        errors, alongs = [], []
        for p in range(self.parts):
            error = ((cut[:, p, None, :] - self.centroids[p]) ** 2).sum(-1)
            along = own[:, p, None] - cut[:, p] @ self.centroids[p].T
            errors.append(error)
            alongs.append(along)
            codes[:, p] = error.argmin(1)
            parallel += np.take_along_axis(along, codes[:, p, None].astype(np.int64), 1)[:, 0]
        for _ in range(rounds):
            for p in range(self.parts):
                now = np.take_along_axis(alongs[p], codes[:, p, None].astype(np.int64), 1)[:, 0]
                rest = parallel - now
                loss = errors[p] + (self.eta - 1) * (rest[:, None] + alongs[p]) ** 2
                codes[:, p] = loss.argmin(1)
                parallel = rest + np.take_along_axis(alongs[p], codes[:, p, None].astype(np.int64), 1)[:, 0]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[np.arange(self.parts), codes.astype(np.int64)].reshape(len(codes), -1)[:, : self.dims]

    def fit(self, x: np.ndarray, seed: int, rounds: int = 6) -> Codebook:
        rng = np.random.default_rng(seed)
        cut = self.cut(x)
        for p in range(self.parts):
            self.centroids[p] = cut[rng.choice(len(x), 16, replace=len(x) < 16), p]
        for _ in range(rounds):
            codes = self.encode(x, 1)
            parallel = 1.0 - np.einsum("nd,nd->n", x, self.decode(codes))
            for p in range(self.parts):
                # Stationary point of the loss in one centroid, the other parts' parallel error held fixed.
                part, code = cut[:, p], codes[:, p]
                along = (part * (part - self.centroids[p][code])).sum(1)
                rest = parallel - along
                for c in range(16):
                    mine = code == c
                    if not mine.any():
                        self.centroids[p][c] = part[rng.integers(len(x))]
                        continue
                    v = part[mine]
                    a = np.eye(self.sub) * len(v) + (self.eta - 1) * v.T @ v
                    b = v.sum(0) + (self.eta - 1) * (v * (rest[mine] + (v * v).sum(1))[:, None]).sum(0)
                    self.centroids[p][c] = np.linalg.solve(a, b)
                parallel = rest + (part * (part - self.centroids[p][code])).sum(1)
        return self


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    return codes[:, 0::2] | codes[:, 1::2] << 4


def tables(book: Codebook, queries: np.ndarray) -> np.ndarray:
    """(bytes, 256, queries): the inner products of both codes of a byte, summed."""
    lut = np.einsum("qps,pcs->pcq", book.cut(queries), book.centroids)
    if book.parts % 2:
        lut = np.concatenate([lut, np.zeros_like(lut[:1])])
    return (lut[0::2, None, :, :] + lut[1::2, :, None, :]).reshape(len(lut) // 2, 256, -1).astype(np.float32)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


_CODED = pa.schema([("vec_id", pa.int64()), ("codes", pa.binary()), ("vector", pa.binary())])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dims)


def unit_rows(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _encode(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"), book.dims)
                codes = pack(book.encode(unit_rows(x).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], schema=_CODED)

    return run


_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def chosen(near: np.ndarray, take: int) -> np.ndarray:
    """Mask of the ``take`` largest values of every column, equal ones by smaller row."""
    if take >= len(near):
        return np.ones(near.shape, bool)
    cut = np.partition(near, len(near) - take, axis=0)[len(near) - take]
    above, level = near > cut, near == cut
    return above | (level & (np.cumsum(level, axis=0) <= take - above.sum(axis=0)))


_FILES = pa.schema([("part", pa.int32()), ("queries", pa.string())])


def _store(folder: str, dims: int, query_block: int):
    """Writes a partition's queries as files of at most ``query_block``, under names of this attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = np.dtype([("id", "<i8"), ("vector", "<f8", (dims,))])

        def file(rows: list[tuple]) -> tuple:
            uri, buffer = f"{folder}/{uuid.uuid4().hex}.npy", io.BytesIO()
            np.save(buffer, np.array(rows, kind))
            fs, path = pafs.FileSystem.from_uri(uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(buffer.getvalue())
            return part, uri

        def files() -> Iterator[tuple]:
            held: list[tuple] = []
            for row in C.rows_of(batches, ["vec_id", "embedding"]):
                held.append(row)
                if len(held) == query_block:
                    yield file(held)
                    held = []
            if held:
                yield file(held)

        yield from C.emit(_FILES, files())

    return run


class _Found:
    """The k best rows of each query of a file so far."""

    def __init__(self, book: Codebook, uri: str, k: int, rerank: int):
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path) as f:
            rows = np.load(io.BytesIO(f.read()))
        self.query_ids, self.queries = rows["id"], unit_rows(rows["vector"])
        self.book, self.k, self.rerank = book, k, rerank
        self.ids = [np.empty(0, np.int64)] * len(rows)
        self.scores = [np.empty(0)] * len(rows)

    def scan(self, ids: np.ndarray, codes: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, codes, unit = ids[order], codes[order], unit_rows(x[order])
        for low in range(0, len(self.query_ids), 128):
            some = slice(low, low + 128)
            tab = tables(self.book, self.queries[some].astype(np.float32))
            near = np.zeros((len(ids), tab.shape[2]), np.float32)
            for b in range(tab.shape[0]):
                near += tab[b][codes[:, b]]
            near[ids[:, None] == self.query_ids[None, some]] = -np.inf
            keep = chosen(near, self.rerank)
            for q in range(low, low + tab.shape[2]):
                rows = np.flatnonzero(keep[:, q - low])
                rows = rows[ids[rows] != self.query_ids[q]]
                # Summed along the row, so that equal vectors have equal scores wherever they stand.
                exact = (unit[rows] * self.queries[q]).sum(axis=1)
                all_ids, scores = np.concatenate([self.ids[q], ids[rows]]), np.concatenate([self.scores[q], exact])
                best = best_of(all_ids, scores, self.k)
                self.ids[q], self.scores[q] = all_ids[best], scores[best]

    def rows(self) -> Iterator[tuple]:
        for q, ids, scores in zip(self.query_ids.tolist(), self.ids, self.scores, strict=True):
            for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
                yield q, i, s


def _search(book: Codebook, k: int, rerank: int, row_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for uri, files in C.rows_of(batches, ["queries", "files"]):
                found = _Found(book, uri, k, rerank)
                for name in files:
                    fs, path = pafs.FileSystem.from_uri(name)
                    with fs.open_input_file(path) as f:
                        for part in pq.ParquetFile(f).iter_batches(row_block, columns=["vec_id", "codes", "vector"]):
                            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                            x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(part.num_rows, -1)
                            found.scan(part.column("vec_id").to_numpy(zero_copy_only=False), codes, x)
                yield from found.rows()

        yield from C.emit(_NEAR, rows())

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, sub: int = 2, eta: float = 4.0, sample: int = 8_000, rerank: int = 64, query_block: int = 4_096, row_block: int = 4_096, seed: int = 13) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest cosine to each row where ``is_query`` holds.

    ``sample`` bounds the rows that fit the codebooks; all rows are indexed. ``rerank`` rows of every ``row_block``
    are scored exactly for each query."""
    spark = vectors.sparkSession
    wide = C.width(spark)
    two = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(usable(F.col("embedding")))
    sizes = two.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sizes["dims"]
    good = two.where(F.size("embedding") == dims)
    first = good.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "vec_id")), "vec_id").limit(sample).collect()
    book = Codebook(dims, sub, eta).fit(unit_rows(np.array([r["embedding"] for r in first], np.float64)).astype(np.float32), seed)
    index = C.table(good.mapInArrow(_encode(book), "vec_id long, codes binary, vector binary"), "ann-index")
    asked = good.where(is_query)
    parts = max(1, -(-asked.count() // query_block))
    folder = C.scratch_path(spark, "ann-queries")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    stored = C.table(asked.repartition(parts).mapInArrow(_store(folder, dims, query_block), "part int, queries string"), "ann-query-files")
    # Enough groups of index files that the tasks fill the cluster however few the query files are.
    groups = -(-2 * wide // parts)
    files = index.select(F.input_file_name().alias("file")).distinct().groupBy(F.pmod(F.xxhash64("file"), F.lit(groups)).alias("group")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    pairs = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(stored, "part").select("queries", "files")
    near = pairs.repartition(min(parts * groups, 4 * wide)).mapInArrow(_search(book, k, rerank, row_block), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
