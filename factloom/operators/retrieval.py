"""Retrieval under budgets: BM25 over a document's own units, cosine, ranks, completeness and macro or micro means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

KS = (1, 2, 3, 5, 10)
BUDGETS = (500, 1000, 2000)


def tokens(c: Column) -> Column:
    """Lower-cased white-space tokens, punctuation kept."""
    bare = F.trim(F.regexp_replace(F.lower(c), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.filter(F.split(bare, " "), lambda t: t != "")


def query_of(field: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.replace(field, F.lit("_"), F.lit(" ")), description)


def bm25(units: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, floor: float | None = None) -> DataFrame:
    """``document, unit, query_id, score``: units (``document, unit, text``) scored within their document.

    Query words count as often as they occur. One aggregate per unit and word, one per document and word; queries are few
    and join by word. ``floor`` replaces a negative idf by ``floor`` times the document's mean idf."""
    words = units.select("document", "unit", F.explode(tokens(F.col("text"))).alias("word"))
    tf = words.groupBy("document", "unit", "word").agg(F.count("*").alias("tf"))
    sizes = units.select("document", "unit", F.size(tokens(F.col("text"))).alias("dl"))
    means = sizes.groupBy("document").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("document", "word").agg(F.count("*").alias("df"))
    idf = df.join(means, "document").withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if floor is not None:
        mean = F.avg("idf").over(Window.partitionBy("document"))
        idf = idf.withColumn("mean", mean).withColumn("idf", F.when(F.col("idf") < 0, F.lit(floor) * F.col("mean")).otherwise(F.col("idf")))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("word"))
    met = tf.join(asked, "word").join(idf.select("document", "word", "idf", "avgdl"), ["document", "word"]).join(sizes, ["document", "unit"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("document", "unit", "query_id").agg(F.sum(part).alias("score"))


def all_scores(scores: DataFrame, units: DataFrame, queries: DataFrame, most: int = 10_000) -> DataFrame:
    """Every unit of a document under every query, 0 without a common word.

    The queries are a stated set of at most ``most``, which is checked: each row is repeated for the literal list of their ids, as
    the ranking of all units needs, and nothing is shuffled for it."""
    asked = [r[0] for r in queries.select("query_id").distinct().limit(most + 1).collect()]
    if len(asked) > most:
        raise ValueError(f"more than {most} queries; rank them in parts")
    kind = queries.schema["query_id"].dataType
    listed = F.array(*[F.lit(q) for q in asked]).cast(ArrayType(kind)) if asked else F.array().cast(ArrayType(kind))
    every = units.select("document", "unit", F.explode(listed).alias("query_id"))
    return every.join(scores, ["document", "unit", "query_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranked(scores: DataFrame, keys: list[str], unit: str = "unit") -> DataFrame:
    """Rank by falling score, ties in unit order."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), unit)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, norms at least 1e-9."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    tiny = F.lit(1e-9)
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), tiny) * F.greatest(F.sqrt(dot(b, b)), tiny))


_PACKED = "ids binary, vectors binary, n int, part int"


def _pack(ids: str, vector: str, rows: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, names = TaskContext.get().partitionId(), [], ["ids", "vectors", "n", "part"]

        def packed():
            keys, matrix = np.array([i for i, _ in held], np.int64), np.array([v for _, v in held], np.float64)
            return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([matrix.tobytes()]), pa.array([len(held)], pa.int32()), pa.array([part], pa.int32())], names=names)

        for batch in batches:
            for pair in zip(batch.column(ids).to_pylist(), batch.column(vector).to_pylist(), strict=True):
                held.append(pair)
                if len(held) == rows:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return run


def _nearest(k: int, digits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def unit(raw: bytes, n: int):
            x = np.frombuffer(raw).reshape(n, -1)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

        for batch in batches:
            for row in batch.to_pylist():
                keys, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                near = np.round(unit(row["q_vectors"], row["q_n"]) @ unit(row["vectors"], row["n"]).T, digits)
                out = [[], [], []]
                for i, q in enumerate(asked.tolist()):
                    order = np.lexsort((keys, -near[i]))
                    order = order[keys[order] != q][:k]
                    out[0] += [q] * len(order)
                    out[1] += keys[order].tolist()
                    out[2] += near[i][order].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest_by_cosine(vectors: DataFrame, is_query: Column, *, k: int = 5, digits: int = 6, block: int = 1024) -> DataFrame:
    """``query_id, vec_id, score, rank``: each query row's k rows of largest rounded cosine among all others, ties to the smaller id.

    Rows and queries are packed in blocks; each block of rows meets each block of queries once, as one matrix product, and
    passes on k rows a query. Vectors that are null, empty, zero or of another length than most, and those with a component
    that is null or no finite number, take no part."""
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = some.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    sizes = some.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    some = some.where(F.size("embedding") == F.lit(sizes["size"] if sizes else 0))
    asked = some.where(is_query)
    parts = max(1, -(-asked.count() // block))
    queries = asked.repartition(parts).mapInArrow(_pack("vec_id", "embedding", block), _PACKED).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("n").alias("q_n"), F.col("part").alias("q"))
    rows = some.mapInArrow(_pack("vec_id", "embedding", block), _PACKED).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("part")
    near = rows.join(queries, "q").mapInArrow(_nearest(k, digits), "query_id long, vec_id long, score double")
    return ranked(near, ["query_id"], "vec_id").where(F.col("rank") <= k)


def within_budget(ranks: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The ranked prefix whose running token sum stays within the budget; it ends at the first overflow."""
    run = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranks.withColumn("used", run).where(F.col("used") <= budget)


def completeness(evidence: DataFrame, ranks: DataFrame, keys: list[str], unit: str = "unit", ks: tuple[int, ...] = KS) -> DataFrame:
    """Per instance: share of fragments and whether all their units are within the first k; an unranked unit is not."""
    met = evidence.join(ranks.select(*keys, unit, "rank"), [*keys, unit], "left")
    return met.groupBy(*keys).agg(
        F.count("*").alias("n_pieces"),
        *[F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in ks],
        *[F.sum(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"hits_{k}") for k in ks],
        *[F.bool_and(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"complete_{k}") for k in ks],
    )


def macro_micro(instances: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Mean over instances and over fragments; a group without fragments has null means."""
    return instances.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg(f"recall_{k}").alias("macro_recall"),
        F.avg(F.col(f"complete_{k}").cast("int")).alias("macro_complete"),
        F.try_divide(F.sum(f"hits_{k}"), F.sum("n_pieces")).alias("micro_recall"),
    )


def slices(instances: DataFrame, named: dict[str, Column], k: int) -> DataFrame:
    """``macro_micro`` of overlapping slices in one pass."""
    tags = F.array_compact(F.array(*[F.when(cond, name) for name, cond in named.items()]))
    return macro_micro(instances.withColumn("slice", F.explode(tags)), k, ["slice"])


def percentile_row(values: DataFrame, by: list[str], value: str, share: float = 0.9) -> DataFrame:
    """``by, p90``: the element at floor(share n) of a group's sorted values, clamped.

    Equal values are counted first, so that what is ordered are a group's distinct values."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_times"))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_all", F.sum("_times").over(whole)).withColumn("_upto", F.sum("_times").over(upto))
    at = F.least(F.col("_all") - 1, F.floor(F.col("_all") * share))
    return placed.where(F.col("_upto") > at).groupBy(*by).agg(F.min("_value").alias(f"p{round(100 * share)}"))


def evidence_sets(gold: DataFrame) -> DataFrame:
    """``document, field, state, derivation, pieces, n_pieces, n_pages, cross_page``: direct evidence and premises (arrays of
    page and text), each with its kind, and the pages they lie on. ``ingredients`` is not a field; null arrays are empty."""
    piece = lambda e, kind: F.struct(e["page"].cast("int").alias("page"), e["text"].alias("text"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<page: int, text: string, kind: string>>")
    some = lambda name, kind: F.coalesce(F.transform(name, lambda e: piece(e, kind)), none)
    packed = gold.where("field <> 'ingredients'").withColumn("pieces", F.concat(some("evidence", "direct"), some("premises", "premise")))
    pages = F.size(F.array_distinct(F.transform("pieces", lambda p: p["page"])))
    return packed.select("document", "field", "state", "derivation", "pieces", F.size("pieces").alias("n_pieces"), pages.alias("n_pages"), (pages > 1).alias("cross_page"))


def rankable(sets: DataFrame) -> DataFrame:
    """Evidence sets that a ranking is judged on: those with pieces, of fields that gold states."""
    return sets.where((F.col("n_pieces") > 0) & (F.col("state") != "NOT_STATED"))


#: Below this score a judge is taken to have missed a page.
LOW_SCORE = 0.5


def case_picks(scored: DataFrame) -> DataFrame:
    """``stratum, n, document, field, score`` of judged instances (``document, field, derivation, cross_page, piece_scores``).

    Of derived instances whose best piece scores low, the worst of each stratum; ``contrast`` is the explicit instance whose
    worst piece scores highest among those without a low one. Ties go to the smaller key in the strata, the larger in the
    contrast. One partial aggregate."""
    best, worst = F.array_max("piece_scores"), F.array_min("piece_scores")
    explicit = F.col("derivation") == "EXPLICIT"
    stratum = (
        F.when(explicit, F.when(worst >= LOW_SCORE, "contrast"))
        .when(best >= LOW_SCORE, None)
        .when(F.col("derivation") == "COMPOSITION_IMPLIED", "composition_implied")
        .when(F.col("derivation") == "ONTOLOGY", F.when(F.col("cross_page"), "ontology_cross_page").otherwise("ontology_same_page"))
    )
    rows = scored.select(stratum.alias("stratum"), F.struct(F.when(explicit, worst).otherwise(best).alias("score"), "document", "field").alias("k")).where("stratum is not null")
    picked = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    pick = F.when(F.col("stratum") == "contrast", F.col("high")).otherwise(F.col("low"))
    return picked.withColumn("pick", pick).select("stratum", "n", "pick.document", "pick.field", "pick.score")


def judge_stats(pages: DataFrame) -> DataFrame:
    """One row over judged pages (``document, field, page, derivation, is_gold, score``; one row a page of an instance): counts,
    shares below LOW_SCORE and medians of gold pages by explicit and derived, saturation, derived instances scored 0 throughout."""
    explicit = F.col("derivation") == "EXPLICIT"
    kinds = {"explicit": explicit & F.col("is_gold"), "derived": ~explicit & F.col("is_gold")}
    parts = []
    for name, cond in kinds.items():
        score = F.when(cond, F.col("score"))
        parts += [F.count(score).alias(f"{name}_pages"), F.avg((score < LOW_SCORE).cast("int")).alias(f"{name}_share_low"), F.median(score).alias(f"{name}_median")]
    one = pages.agg(
        *parts,
        F.count("score").alias("pages"),
        F.count_if(F.col("score") < 0).alias("below_0"),
        F.count_if(F.col("score") > 1).alias("above_1"),
        F.count_if(F.col("score") == 0).alias("zeros"),
        F.count_if(F.col("score") == 1).alias("ones"),
    )
    flat = pages.where(~explicit).groupBy("document", "field").agg(F.bool_and(F.col("score") == 0).alias("flat")).agg(F.count_if("flat").alias("derived_all_zero"))
    return one.crossJoin(flat)  # one row each
