"""Line dedup on levelled sorted runs of line hashes.

``LineRuns`` is a store in the shared folder. A batch's digests, counted and sorted, merge-anti-join the runs: those that
no run holds become the batch's own run, the rest a tally of lines met again, so that a digest is in one run only. When
a level holds ``fanout`` runs they are merged into one run of the next level, so that n batches leave at most
``fanout * log(n)`` runs and a digest is rewritten once per level. ``novel`` gives the lines of a batch that no run
holds and ``repeated`` adds the tallies to the runs for lines found in enough documents.

A key is a line stripped of space, tab, LF, VT, FF and CR at both ends with A-Z lower-cased; its digest is the 128-bit
MD5 of its UTF-8. A line counts once a document, however often it occurs there. Runs hold digests, not lines.
All of it is DataFrame work: partial aggregates before each shuffle take frequent lines, joins meet on digests, and
documents are rebuilt from the list of line numbers that they lose.

Defined results: null and empty texts are one empty line; rows count as documents of their own, also those that repeat
an id or a whole row, and all rows of the keeper's id keep the line; rows with a null id count as id null, the
smallest; a line's every occurrence in its keeper stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_BLANK = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, C.ASCII_UPPER, C.ASCII_LOWER))


def _mark(text: Column) -> Column:
    """Tells rows of one id apart by their text; rows equal in both lose the same lines."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, mark, digests``: digests of the long lines with their numbers, an array a row."""
    long = F.filter(F.transform(lines_of(F.col("text")), lambda line, i: F.struct(i.alias("i"), _key(line).alias("key"))), lambda p: F.char_length(p["key"]) >= min_chars)
    digests = F.transform(long, lambda p: F.struct(p["i"].alias("i"), F.unhex(F.md5(p["key"])).alias("d")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), digests.alias("digests"))


class LineRuns:
    """Levelled sorted runs ``d, n_docs, last_doc`` under ``path``; ``tallies`` count digests of runs in later batches."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path = path or C.scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.tallies: list[str] = []
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        """Write rows that a join or aggregate on ``d`` has already dealt by digest, each shard sorted."""
        self.made += 1
        path = f"{self.path}/run-{self.made:06d}"
        run.sortWithinPartitions("d").write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("d binary, n_docs long, last_doc long").parquet(*paths)

    def _unseen(self, rows: DataFrame, runs: list[str]) -> DataFrame:
        """Rows whose digest no run holds: a chain of merge anti joins, ``rows`` being dealt by digest once."""
        for path in runs:
            rows = rows.join(self._read([path]).select("d").hint("merge"), "d", "left_anti")
        return rows

    def add(self, batch: DataFrame) -> None:
        """Anti-join the lines of a batch (``doc_id, digests``) with the runs, add a run, compact full levels."""
        # Strings, as distinct binary values are found in quadratic time.
        each = batch.select("doc_id", F.explode(F.array_distinct(F.transform("digests", lambda p: F.hex(p["d"])))).alias("d")).withColumn("d", F.unhex("d"))
        counted = self._write(each.groupBy("d").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        held = [p for level in self.levels for p in level]
        if held:
            fresh = self._write(self._unseen(self._read([counted]), held))
            self.tallies.append(self._write(self._unseen(self._read([counted]), [fresh])))
            C.drop_path(self.spark, counted)
            if len(self.tallies) >= self.fanout:
                self.tallies = [self._compact(self.tallies)]
        else:
            fresh = counted
        self._push(0, fresh)

    def _compact(self, paths: list[str]) -> str:
        merged = self._write(self.merged(paths))
        for old in paths:
            C.drop_path(self.spark, old)
        return merged

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._compact(full))

    def merged(self, paths: list[str] | None = None) -> DataFrame:
        paths = [p for level in self.levels for p in level] + self.tallies if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], "d binary, n_docs long, last_doc long")
        return self._read(paths).groupBy("d").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def repeated(self, min_docs: int) -> DataFrame:
        return self.merged().where(F.col("n_docs") >= min_docs)

    def novel(self, batch: DataFrame) -> DataFrame:
        """``doc_id, i, d``: the batch's long lines that no run holds."""
        lines = batch.select("doc_id", F.inline("digests"))
        return self._unseen(lines, [p for level in self.levels for p in level]).select("doc_id", "i", "d")


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (the text that stays) for every row.

    ``batches`` splits the table by a hash of the id; each batch is anti-joined with the
    runs before it and adds its own, as a daily load would."""
    spark = docs.sparkSession
    rows = keyed(docs, min_chars)
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(3)), F.lit(batches))
    lines = C.table(rows.where(F.size("digests") > 0).withColumn("batch", part), "line-keys")
    runs = LineRuns(spark, fanout=fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    hot = C.table(runs.repeated(min_docs), "line-repeated")
    own = F.col("doc_id").eqNullSafe(F.col("last_doc"))
    entries = lines.select("doc_id", "mark", F.inline("digests"))
    # Digests of more than a 1 / (2 * partitions) share of all entries number at most twice the partitions: a bounded
    # broadcast, so that no task of the merge join holds the rows of a very frequent line.
    wide = C.width(spark)
    total = runs.merged().agg(F.sum("n_docs")).first()[0] or 0
    often = F.col("n_docs") > total / (2 * wide)
    very = F.broadcast(hot.where(often).select(F.col("d").alias("of"), "last_doc"))
    rest = entries.join(very.select("of"), F.col("d") == F.col("of"), "left_anti").join(hot.where(~often).select("d", "last_doc").hint("merge"), "d")
    lost = entries.join(very, F.col("d") == F.col("of")).select("doc_id", "mark", "i", "last_doc").unionByName(rest.select("doc_id", "mark", "i", "last_doc")).where(~own)
    lists = C.table(lost.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("i")).alias("gone")), "line-lost")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark(F.col("text")).alias("mark"))
    # Merge joins at every size: short lists compress so well that a file's size says little of its rows.
    met = some.join(lists.hint("merge"), some.doc_id.eqNullSafe(lists.doc_id) & (some.mark == lists.mark), "left").select(some.doc_id, "text", "gone")
    # The lines are bound once; a set difference of line numbers keeps the work in proportion to their number.
    bound = F.transform(
        F.array(lines_of(F.col("text"))),
        lambda own: F.struct(
            F.size(own).alias("n"),
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone")), lambda i: F.get(own, i)), "\n").alias("kept"),
        ),
    )[0]
    n_lines = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1
    done = met.withColumn("done", F.when(F.col("gone").isNotNull(), bound))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.col("done.kept"))
    return done.select("doc_id", F.coalesce(F.col("done.n"), n_lines, F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.i, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.last_doc AS gone FROM k LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
