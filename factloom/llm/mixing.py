"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share all words; a target stops at
``limit`` times its source's words and the excess is shared by weight until none is above. With sources sorted by
``size / weight`` the stopped ones are a prefix, so one running sum finds the level: no iteration.

Blocks: a source's documents are dealt over hash shards, and a shard's documents, in seeded digest order, are a stream
of words cut into equal blocks of about ``block`` words. All blocks of the mix are apportioned over the sources by
highest quotients ``target / (2 k + 1)`` (Sainte-Lague; a source takes at most ``limit`` times its blocks, and what is above
goes to the next quotients), then a source's blocks over its shards by highest quotients ``blocks / (2 k + 1)``.
A shard takes all its blocks as often as its quota holds them, and of the rest a seeded choice: those that a
permutation of block numbers (times a prime plus a seeded shift, modulo their number) puts first.

Quotients: with total weight W, P parties and B seats, the number of seats at level L lies within P / 2 of
``W / (2 L)``. Hence all quotients above ``W / (2 B - P)`` win, none below ``W / (2 B + P)`` does, and at most about 4 P lie
between: only these are listed and ranked, and the outcome is exactly that of highest quotients, ties by order.

A source's shards number the power of two at or above the square root of its documents: both the shard list of a source
and the documents of a shard stay small, and a source that holds a third of all rows is spread like the others.
Order over all sources comes from range partitions and a running sum over their totals, one row a partition.

Defined results: null text has size 0; sizes 0 take nothing; a null identifier orders by its text's digest; rows that
repeat an identifier are rows of their own; source '' and source null differ; an empty table gives no rows; other
columns are ignored by ``mix`` and kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A prime above any shard's number of blocks, so that its multiples permute them.
_PRIME = 2_147_483_647


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("size", F.regexp_count("text", F.lit(C.WORD)).cast("long"))


def _before(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with ``before_<c>``: sums of each column over all rows that come earlier in the order."""
    spark = df.sparkSession
    placed = C.table(df.repartitionByRange(C.width(spark), *order).withColumn("part", F.spark_partition_id()), name)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = placed.groupBy(F.col("part").alias("of")).agg(*[F.sum(c).alias(c) for c in sums]).withColumnRenamed("of", "part")
    starts = starts.select(F.col("part").alias("of"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"start_{c}") for c in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).join(F.broadcast(starts), F.col("part") == F.col("of"))
    return summed.select(*df.columns, *[(F.col(f"before_{c}") + F.col(f"start_{c}")).alias(f"before_{c}") for c in sums])


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """``source, ordinal, source_size, docs, target`` for every source of ``rows`` (``source, size``)."""
    source = F.col("source").asc_nulls_last()
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.lit(1).alias("one"))
    numbered = _before(sums, [source], ["one"], "mix-order")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    weighed = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit))).withColumn("key", F.col("cap") / F.col("weight"))
    placed = C.table(_before(weighed, [F.col("key"), source], ["cap", "weight"], "mix-keys"), "mix-levels")
    whole = placed.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("before_cap")) / (F.lit(whole["weight"]) - F.col("before_weight"))
    stops = F.col("key") <= level
    final = placed.agg(F.min(F.when(~stops, F.struct("key", level.alias("level"))))["level"]).first()[0]
    target = F.when(stops, F.col("cap")).otherwise(F.col("weight") * F.lit(final).cast("double"))
    return placed.select("source", F.col("before_one").alias("ordinal"), "source_size", "docs", target.alias("target"))


def _window(weight: Column, total: Column, parties: Column, seats: Column) -> tuple[Column, Column]:
    """Seats that a party has for certain, and the last quotient that may win one."""
    sure = F.when(2 * seats > parties, F.greatest(F.lit(0.0), F.floor((weight * (2 * seats - parties) / total - 1) / 2))).otherwise(F.lit(0.0))
    return sure.cast("long"), F.floor((weight * (2 * seats + parties) / total + 1) / 2).cast("long")


def source_quotas(sources: DataFrame) -> DataFrame:
    """``source, quota``: blocks of each source (``source, ordinal, weight, cap``) by highest quotients below the caps."""
    open_ = C.table(sources.where("weight > 0"), "mix-parties")
    seats = open_.agg(F.sum(F.col("weight").cast("decimal(38,6)")).alias("all")).select(F.floor(F.col("all") + F.lit("0.5").cast("decimal(2,1)")).cast("long")).first()[0]
    done = None
    while seats:
        whole = open_.agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
        if not whole["n"]:
            break
        sure, last = _window(F.col("weight"), F.lit(whole["weight"]), F.lit(whole["n"]), F.lit(seats))
        started = C.table(open_.withColumn("sure", sure).withColumn("last", last), "mix-started")
        left = seats - started.agg(F.sum("sure")).first()[0]
        tried = started.select("ordinal", "weight", F.explode(F.sequence("sure", "last")).alias("k")).withColumn("quotient", -F.col("weight") / (2 * F.col("k") + 1)).withColumn("one", F.lit(1))
        won = _before(tried, [F.col("quotient"), F.col("ordinal"), F.col("k")], ["one"], "mix-quotients").where(F.col("before_one") < left).groupBy(F.col("ordinal").alias("of")).agg(F.count("*").alias("more"))
        met = C.table(started.join(won, F.col("ordinal") == F.col("of"), "left").select("source", "ordinal", "weight", "cap", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota")), "mix-won")
        above = met.where("quota > cap")
        over = above.agg(F.sum("cap")).first()[0]
        fixed = (met if over is None else above).select("source", F.least("quota", "cap").alias("quota"))
        done = fixed if done is None else done.unionByName(fixed)
        if over is None:
            break
        seats, open_ = seats - over, met.where("quota <= cap").select("source", "ordinal", "weight", "cap")
    return sources.select("source", F.lit(0).cast("long").alias("quota")).limit(0) if done is None else done


def shard_quotas(shards: DataFrame) -> DataFrame:
    """``shards`` (``source, shard, blocks, seats``) with the quota of each among its source's seats by highest quotients."""
    source = Window.partitionBy("source")
    weight = F.col("blocks").cast("double")
    sure, last = _window(weight, F.sum(weight).over(source), F.count("*").over(source), F.col("seats"))
    started = shards.where("seats > 0").withColumn("sure", sure).withColumn("last", last).withColumn("left", F.col("seats") - F.sum("sure").over(source))
    tried = started.withColumn("k", F.explode(F.sequence("sure", "last")))
    ranked = tried.withColumn("rank", F.row_number().over(source.orderBy(F.desc(weight / (2 * F.col("k") + 1)), "shard", "k")))
    return ranked.groupBy("source", "shard").agg(F.first("words").alias("words"), F.first("blocks").alias("blocks"), (F.first("sure") + F.count_if(F.col("rank") <= F.col("left"))).alias("quota"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, block: int = 16, seed: int = 17, scatter: bool = True) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row; ``taken`` counts repeats.

    With ``scatter`` the blocks of a shard's rest lie apart; without, they follow each other from a seeded one on."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5("text")))
    rows = C.table(sized(docs).select("doc_id", "source", "size", F.md5(F.concat_ws(":", F.lit(str(seed)), name)).alias("order")), "mix-sizes")
    shards = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(F.col("docs").cast("double")))))
    goal = C.table(targets(rows, weights, limit).withColumn("shards", F.greatest(F.lit(1.0), shards).cast("long")), "mix-sources")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    # The source table has one row per source; Spark broadcasts it while it is below its size threshold.
    dealt = rows.alias("a").join(goal.alias("b"), same).select("a.doc_id", "a.source", "a.size", "a.order", "b.source_size", "b.target", "b.shards")
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("shards")))
    sums = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).where("words > 0")
    cut = C.table(sums.withColumn("blocks", F.greatest(F.lit(1.0), F.round(F.col("words") / block)).cast("long")), "mix-shards")
    counted = cut.groupBy("source").agg(F.sum("blocks").alias("blocks"))
    parties = goal.alias("a").join(counted.alias("b"), same).select("a.source", "a.ordinal", (F.col("a.target") * F.col("b.blocks") / F.col("a.source_size")).alias("weight"), (F.col("b.blocks") * limit).alias("cap"))
    seats = source_quotas(parties)
    quotas = C.table(shard_quotas(cut.alias("a").join(seats.alias("b"), same).select("a.*", F.col("b.quota").alias("seats"))), "mix-quotas")
    met = dealt.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")), "left").select("d.*", "q.words", "q.blocks", F.coalesce("q.quota", F.lit(0)).alias("quota"))
    stream = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    shift = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("shard").cast("string"), "source")), 1, 8), 16, 10).cast("long")
    placed = met.withColumn("b", F.sum("size").over(stream)).withColumn("a", F.col("b") - F.col("size")).withColumns({"rest": F.col("quota") % F.col("blocks"), "shift": F.pmod(shift, F.col("blocks")), "jump": F.pmod(F.lit(_PRIME if scatter else 1).cast("long"), F.col("blocks"))})
    # Block j holds the words from j * words / blocks on; a document counts its words in the chosen ones.
    part = F.expr(
        "aggregate(sequence(a * blocks div words, (b - 1) * blocks div words), 0L, (t, j) -> t + if((j * jump + shift) % blocks < rest, "
        "least(b, ((j + 1) * words + blocks - 1) div blocks) - greatest(a, (j * words + blocks - 1) div blocks), 0L))"
    )
    taken = F.when((F.col("size") > 0) & (F.col("quota") > 0), F.floor(F.col("quota") / F.col("blocks")) * F.col("size") + F.when(F.col("rest") > 0, part).otherwise(F.lit(0))).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, block: int = 16, seed: int = 17) -> DataFrame:
    """The mixed corpus in whole documents: each row of ``docs`` as often as the mix takes it, to the nearest whole.

    A shard's rest is a run of blocks here, so that it cuts at most two documents, which are rounded. Texts without a word
    are not taken. Rows that repeat an identifier, null too, share its count's mean."""
    of, copies, copy = (C.fresh(n, docs.columns) for n in ("mix_id", "mix_copies", "mix_copy"))
    taken = mix(docs, weights=weights, limit=limit, block=block, seed=seed, scatter=False).where("size > 0").groupBy(F.col("doc_id").alias(of)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(copies)).where(F.col(copies) > 0)
    met = docs.where(F.col("doc_id").isNotNull() | F.col("text").rlike(C.WORD)).join(taken, F.col("doc_id").eqNullSafe(F.col(of))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS ord FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal, list_extract([5.0::DOUBLE, 2.0, 1.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, ordinal, source_size, greatest(1, pow(2, ceil(log2(sqrt(docs)))))::BIGINT AS shards, CASE WHEN cap / weight <= level THEN cap
    ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE NOT cap / weight <= level) END AS target FROM l
), e AS (
  SELECT d.doc_id, d.source, d.size, d.ord, t.source_size, t.target, ('0x' || substr(d.ord, 1, 8))::BIGINT % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), h AS (  -- shards and their blocks
  SELECT source, shard, sum(size)::BIGINT AS words, greatest(1, round(sum(size) / 16.0::DOUBLE))::BIGINT AS n FROM e GROUP BY source, shard HAVING sum(size) > 0
), p AS (  -- every quotient of every source, up to three times its blocks
  SELECT source, ordinal, share, unnest(range(0, 3 * blocks)) AS k FROM (
    SELECT t.source, t.ordinal, t.target * b.blocks / t.source_size AS share, b.blocks
    FROM t JOIN (SELECT source, sum(n)::BIGINT AS blocks FROM h GROUP BY source) b ON t.source IS NOT DISTINCT FROM b.source)
), won AS (
  SELECT source, count(*) AS seats FROM (SELECT source FROM p ORDER BY share / (2 * k + 1) DESC, ordinal, k
    LIMIT (SELECT floor(sum(share::DECIMAL(38, 6)) + 0.5)::BIGINT FROM (SELECT DISTINCT ordinal, share FROM p))) GROUP BY source
), hk AS (  -- every quotient of every shard
  SELECT h.source, h.shard, h.n, won.seats, unnest(range(0, 3 * h.n)) AS k FROM h JOIN won ON h.source IS NOT DISTINCT FROM won.source
), r AS (
  SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY n::DOUBLE / (2 * k + 1) DESC, shard, k) AS rnk FROM hk
), quotas AS (
  SELECT source, shard, count(*) FILTER (WHERE rnk <= seats) AS quota FROM r GROUP BY source, shard
), x AS (
  SELECT e.*, h.words, h.n, coalesce(q.quota, 0) AS quota, coalesce(q.quota, 0) % h.n AS rest, 2147483647 % h.n AS jump,
    ('0x' || substr(md5('17:' || e.shard || coalesce(':' || e.source, '')), 1, 8))::BIGINT % h.n AS shift,
    sum(e.size) OVER (PARTITION BY e.source, e.shard ORDER BY e.ord, e.doc_id, e.size ROWS UNBOUNDED PRECEDING)::BIGINT AS b
  FROM e LEFT JOIN h ON e.source IS NOT DISTINCT FROM h.source AND e.shard = h.shard
    LEFT JOIN quotas q ON e.source IS NOT DISTINCT FROM q.source AND e.shard = q.shard
)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE quota // n * size + coalesce(list_sum(list_transform(range((b - size) * n // words, (b - 1) * n // words + 1),
  lambda j: CASE WHEN (j * jump + shift) % n < rest THEN least(b, ((j + 1) * words + n - 1) // n) - greatest(b - size, (j * words + n - 1) // n) ELSE 0 END)), 0) END::BIGINT AS taken FROM x
"""
