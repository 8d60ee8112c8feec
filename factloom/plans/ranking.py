"""Retrieval runs of a text layer: which instances count, rankings by BM25, page order or a judge, their metrics and tables.

``units`` has ``document, unit, text, n_tokens`` (unit: the page); ``sets`` are evidence sets as ``retrieval.evidence_sets``
makes them. Everything is joined by document and field; a document's pages are ranked within it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..operators import contracts as K
from ..operators import retrieval as R
from . import responses as M

KEYS = ["document", "field"]


class SeriesError(ValueError):
    """Result series do not cover the same instances."""


def field_queries(spark: SparkSession) -> DataFrame:
    """``query_id, text`` of every product field: its name in words and what it is."""
    table = spark.createDataFrame(list(Q.DESCRIPTIONS.items()), "query_id string, description string")
    return table.select("query_id", R.query_of(F.col("query_id"), F.col("description")).alias("text"))


def exclusions(gold: DataFrame) -> DataFrame:
    """One row over gold (``field, state, n_pieces``): all, those left out by the first reason that holds, and those ranked."""
    reason = F.when(F.col("field") == "ingredients", "ingredients").when(F.coalesce(F.col("n_pieces"), F.lit(0)) == 0, "empty").when(F.col("state") == "NOT_STATED", "absent").otherwise("included")
    tagged = gold.select(reason.alias("reason"))
    return tagged.agg(F.count("*").alias("n_total"), F.count_if(F.col("reason") != "included").alias("n_excluded"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("ingredients", "empty", "absent", "included")])


def instance_metrics(ranks: DataFrame, sets: DataFrame, units: DataFrame) -> DataFrame:
    """Per instance (document, field): recall and completeness within each k and each token budget.

    ``ranks`` has ``document, field, unit, rank``. A piece on a page that is not ranked is not found."""
    pieces = sets.select(*KEYS, F.inline(F.transform("pieces", lambda p: F.struct(p["page"].alias("unit")))))
    sized = ranks.join(units.select("document", "unit", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), ["document", "unit"])
    run = F.sum("n_tokens").over(Window.partitionBy(*KEYS).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    met = pieces.join(sized.withColumn("used", run).select(*KEYS, "unit", "rank", "used"), [*KEYS, "unit"], "left")
    within = {**{str(k): F.col("rank") <= k for k in R.KS}, **{f"{b}tok": F.col("used") <= b for b in R.BUDGETS}}
    parts = []
    for name, cond in within.items():
        hit = F.coalesce(cond, F.lit(False))
        parts += [F.avg(hit.cast("int")).alias(f"recall_{name}"), F.sum(hit.cast("long")).alias(f"hits_{name}"), F.bool_and(hit).alias(f"complete_{name}")]
    scored = met.groupBy(*KEYS).agg(F.count("*").alias("n_pieces"), *parts)
    return scored.join(sets.select(*KEYS, "derivation", "cross_page"), KEYS)


CUTS = (*map(str, R.KS), *(f"{b}tok" for b in R.BUDGETS))

def slice_conditions() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "single_evidence": F.col("n_pieces") == 1,
        "multi_evidence": F.col("n_pieces") >= 2,
        "cross_page_true": F.col("cross_page"),
        "cross_page_false": ~F.col("cross_page"),
        "explicit": F.col("derivation") == "EXPLICIT",
        "derived": F.col("derivation") != "EXPLICIT",
    }


def aggregates(instances: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``slice, n`` and macro completeness, macro and micro recall within every cut, for all and six overlapping slices."""
    tags = F.array_compact(F.array(*[F.when(cond, name) for name, cond in slice_conditions().items()]))
    parts = []
    for c in CUTS:
        parts += [F.avg(F.col(f"complete_{c}").cast("int")).alias(f"complete_{c}"), F.avg(f"recall_{c}").alias(f"recall_{c}"), F.try_divide(F.sum(f"hits_{c}"), F.sum("n_pieces")).alias(f"micro_recall_{c}")]
    return instances.withColumn("slice", F.explode(tags)).groupBy(*by, "slice").agg(F.count("*").alias("n"), *parts)


def page_order(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Ranks of a document's pages from front to back, for each of its instances."""
    met = sets.select(*KEYS).join(units.select("document", "unit"), "document")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy("unit")))


def bm25_order(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Ranks by BM25 of the field's query over the document's own pages; equal scores in page order."""
    queries = field_queries(units.sparkSession)
    scores = R.bm25(units.select("document", "unit", "text"), queries, floor=0.25).withColumnRenamed("query_id", "field")
    met = sets.select(*KEYS).join(units.select("document", "unit"), "document").join(scores, [*KEYS, "unit"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return R.ranked(met, KEYS)


def run_layer(units: DataFrame, gold: DataFrame, split: str | None = "dev") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of exclusions, per-instance metrics by method (``bm25, naive``) and their aggregates, for one layer and split.

    ``gold`` are all evidence sets with ``split``."""
    some = gold if split is None else gold.where(F.col("split") == split)
    pages = units if split is None or "split" not in units.columns else units.where(F.col("split") == split)
    sets = R.rankable(some.where("field <> 'ingredients'"))
    parts = [instance_metrics(order(pages, sets), sets, pages).withColumn("method", F.lit(name)) for name, order in (("bm25", bm25_order), ("naive", page_order))]
    # Instances of a document without pages have no rank and count as not found.
    instances = parts[0].unionByName(parts[1])
    return exclusions(some), instances, aggregates(instances, ("method",))


def judge_requests(units: DataFrame, sets: DataFrame, limit: int | None = None) -> DataFrame:
    """``document, field, unit, prompt, key``: one question a page of an instance; ``limit`` keeps the first documents by name."""
    some = sets
    if limit is not None:
        first = sets.select("document").distinct().orderBy("document").limit(limit)
        some = sets.join(first, "document", "left_semi")
    described = field_queries(units.sparkSession).select(F.col("query_id").alias("field"), F.col("text").alias("asked"))
    met = some.select(*KEYS).join(described, "field").join(units.select("document", "unit", "text"), "document")
    asked = met.withColumn("prompt", M.judge_prompt(F.col("field"), F.col("asked"), F.col("text")))
    return asked.select(*KEYS, "unit", "prompt", K.cache_key(F.col("document").cast("string"), F.col("field"), F.col("unit").cast("string"), F.col("prompt")).alias("key"))


def judged(requests: DataFrame, cache: DataFrame, caller: Callable[[str], str]) -> DataFrame:
    """``document, field, unit, key, score, cached, error``: scores from the cache (``key, score``; the last of a key by
    ``seq`` if it has one), the others asked of ``caller``, which answers with a number."""
    known = K.latest(cache, "key", "seq") if "seq" in cache.columns else cache.groupBy("key").agg(F.max("score").alias("score"))
    hits = requests.join(known.select("key", F.col("score").cast("double").alias("score")), "key").select(*KEYS, "unit", "key", "score", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
    answers = K.call_model(K.cache_misses(requests, known, "key").dropDuplicates(["key"]), caller)
    misses = K.cache_misses(requests, known, "key").join(answers, "key")
    return hits.unionByName(misses.select(*KEYS, "unit", "key", F.expr("try_cast(response AS double)").alias("score"), F.lit(False).alias("cached"), "error"))


def judge_layer(scores: DataFrame, units: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-instance metrics of a judge's ranking and their aggregates; a page without a score ranks last."""
    ranks = R.ranked(scores.select(*KEYS, "unit", F.coalesce("score", F.lit(-1.0)).alias("score")), KEYS)
    instances = instance_metrics(ranks, sets.join(scores.select(*KEYS).distinct(), KEYS, "left_semi"), units)
    return instances, aggregates(instances)


def judged_instances(scores: DataFrame, sets: DataFrame) -> DataFrame:
    """Judge scores by page joined with gold evidence: ``document, field, state, derivation, cross_page, n_pieces,
    page_scores (map), gold_pages, fragments (page, kind, text, score), piece_scores``. An instance without gold drops out."""
    by_page = scores.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit", "score")))).alias("page_scores"))
    met = by_page.join(sets, KEYS)
    fragments = F.transform("pieces", lambda p: F.struct(p["page"].alias("page"), p["kind"].alias("kind"), p["text"].alias("text"), F.try_element_at("page_scores", p["page"]).alias("score")))
    return met.withColumn("gold_pages", F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["page"])))).withColumn("fragments", fragments).withColumn("piece_scores", F.transform("fragments", lambda f: f["score"])).drop("pieces")


def short_number(c: Column) -> Column:
    """Four significant digits, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.4f", F.round(c, 4)), r"\.?0+$", "")


def case_text(instances: DataFrame) -> DataFrame:
    """``document, field, markdown``: one case as a table of its pages, scores and fragments, and what the scores tell.

    Of pages that hold no evidence the three highest of at least 0.5 are named."""
    entries = F.array_sort(F.map_entries("page_scores"))

    def on(page: Column) -> Column:
        here = F.filter("fragments", lambda f: f["page"] == page)
        return F.array_join(F.transform(here, lambda f: F.concat(F.lit("["), f["kind"], F.lit("] "), F.regexp_replace(F.substring(f["text"], 1, 160), r"[\r\n]+", " "))), " ; ")

    line = lambda e: F.concat(F.lit("| "), e["key"].cast("string"), F.lit(" | "), short_number(e["value"]), F.when(F.array_contains("gold_pages", e["key"]), F.concat(F.lit(" | gold | "), on(e["key"]))).otherwise(" | | "), F.lit(" |"))
    others = F.filter(entries, lambda e: ~F.array_contains("gold_pages", e["key"]) & (e["value"] >= R.LOW_SCORE))
    top = F.slice(F.array_sort(F.transform(others, lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("p")))), 1, 3)
    named = F.array_join(F.transform(top, lambda x: F.concat(F.lit("page "), x["p"].cast("string"), F.lit(" at "), short_number(-x["s"]))), ", ")
    told = F.array_compact(
        F.array(
            F.when((F.col("derivation") != "EXPLICIT") & (F.array_max("piece_scores") < R.LOW_SCORE), "Every page with evidence scores below one half."),
            F.when(F.size(others) > 0, F.concat(F.size(others).cast("string"), F.lit(" pages without evidence score one half or more; highest: "), named, F.lit("."))),
            F.when(F.forall(entries, lambda e: e["value"] == 0), "All pages score 0, so the ranking is the order of pages."),
        )
    )
    head = F.concat(F.lit("### "), F.col("document").cast("string"), F.lit(" / "), F.col("field"), F.lit("\n\n"), F.lit("State "), F.col("state"), F.lit(", derivation "), F.col("derivation"), F.lit(", "), F.col("n_pieces").cast("string"), F.lit(" fragments on pages "), F.array_join(F.transform("gold_pages", lambda p: p.cast("string")), ", "))
    table = F.concat(F.lit("\n\n| page | score | gold | fragments |\n|---|---|---|---|\n"), F.array_join(F.transform(entries, line), "\n"))
    return instances.select(*KEYS, F.concat(head, table, F.lit("\n\n"), F.array_join(told, " ")).alias("markdown"))


def load_series(spark: SparkSession, paths: dict[str, tuple[str, str]], layer: str) -> DataFrame:
    """``name, n, metric, cut, value`` of stored results: name to (JSON file, key of its aggregate); instance counts must agree."""
    cells = "map<string, map<string, double>>"
    out = None
    for name, (path, key) in paths.items():
        schema = f"{layer} struct<n_included: long, {key}: struct<macro: {cells}>>"
        one = spark.read.schema(schema).json(path, multiLine=True).select(F.lit(name).alias("name"), F.col(f"{layer}.n_included").alias("n"), F.explode(f"{layer}.{key}.macro").alias("metric", "cells"))
        one = one.select("name", "n", "metric", F.explode("cells").alias("cut", "value")).withColumn("cut", F.col("cut").cast("int"))
        out = one if out is None else out.unionByName(one)
    counts = [r["n"] for r in out.select("n").distinct().limit(3).collect()]
    if len(counts) > 1:
        raise SeriesError(f"instances differ: {counts}")
    return out


def table_markdown(rows: DataFrame, name: str, columns: list[str], digits: int = 3) -> DataFrame:
    """``line_no, line`` of a Markdown table of ``rows``, sorted by ``name``; numbers with ``digits`` decimals, null blank."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.coalesce(F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name).cast("string"), *[cell(c) for c in columns]), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(name)) + 2).alias("line_no"), line.alias("line"))  # a report's few rows
    head = [(1, "| " + " | ".join([name, *columns]) + " |"), (2, "|" + "---|" * (1 + len(columns)))]
    return rows.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)
