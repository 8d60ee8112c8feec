"""Contracts and guards: claim and gold checks, prediction ids, document-set guards, cache misses, model calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LockedSplitError(RuntimeError):
    """Documents of the locked split were asked for without leave."""


class PredictionSetError(RuntimeError):
    """A prediction set does not fit the evaluated documents."""


def claim_breaches() -> Column:
    """Codes of the contract that a claim (state, value, derivation, rule, n_premises, has_evidence) breaks, sorted."""
    none = F.col("state") == "NOT_STATED"
    derived = F.col("derivation") == "DERIVED"
    has_value = F.coalesce(F.col("value") != "", F.lit(False))
    cited = F.col("has_evidence") | (F.col("n_premises") > 0)
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when((F.col("state") != "PRESENT") & has_value, "value_without_present"),
                F.when((F.col("state") == "PRESENT") & ~has_value, "present_without_value"),
                F.when(none & cited, "citation_on_not_stated"),
                F.when(~none & derived & F.col("rule").isNull(), "derived_without_rule"),
                F.when(~none & derived & (F.col("n_premises") == 0), "derived_without_premise"),
                F.when(~none & derived & F.col("has_evidence"), "derived_with_evidence"),
                F.when(~none & ~derived & F.col("rule").isNotNull(), "direct_with_rule"),
                F.when(~none & ~derived & (F.col("n_premises") > 0), "direct_with_premises"),
                F.when(~none & ~derived & ~F.col("has_evidence"), "direct_without_evidence"),
            )
        )
    )


def repaired(claims: DataFrame) -> DataFrame:
    """Claims made to fit the contract: no value unless PRESENT, no citation on NOT_STATED, DERIVED needs rule and premise."""
    sound = (F.col("derivation") == "DERIVED") & F.col("rule").isNotNull() & (F.col("n_premises") > 0)
    none = F.col("state") == "NOT_STATED"
    cited = F.col("has_evidence") | (F.col("n_premises") > 0)
    return claims.select(
        *[c for c in claims.columns if c not in ("value", "derivation", "rule", "n_premises", "has_evidence")],
        F.when(F.col("state") == "PRESENT", F.col("value")).alias("value"),
        F.when(sound & ~none, "DERIVED").otherwise("DIRECT").alias("derivation"),
        F.when(sound & ~none, F.col("rule")).alias("rule"),
        F.when(sound & ~none, F.col("n_premises")).otherwise(F.lit(0).cast("long")).alias("n_premises"),
        (~none & ~sound & cited).alias("has_evidence"),
    )


def breach_counts(claims: DataFrame, codes: tuple[str, ...], spark=None) -> DataFrame:
    """Counts by code, codes without a breach too."""
    found = claims.select(F.explode(claim_breaches()).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    table = claims.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    return table.join(found, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def prediction_id(system: Column, configuration: Column, documents: Column) -> Column:
    """First 16 hex digits of SHA-256 over system, sorted ``key=value`` pairs and sorted documents, each after a NUL."""
    nul = F.lit("\x00")
    pairs = F.transform(F.array_sort(F.map_entries(configuration)), lambda e: F.concat(nul, e["key"], F.lit("="), e["value"]))
    names = F.transform(F.array_sort(documents), lambda d: F.concat(nul, d))
    return F.substring(F.sha2(F.concat(system, F.array_join(pairs, ""), F.array_join(names, "")), 256), 1, 16)


def document_names(predictions: DataFrame) -> DataFrame:
    """``system, documents``: the sorted names that a prediction set covers."""
    return predictions.groupBy("system").agg(F.array_sort(F.collect_set("document")).alias("documents"))


def declared_split(configuration: Column) -> Column:
    """The split that a configuration declares, or null."""
    return F.try_element_at(configuration, F.lit("split"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def guard_split(documents: DataFrame, allow_locked: bool = False) -> DataFrame:
    """``documents`` unless one is of the locked split and that is not allowed."""
    if not allow_locked and not documents.where("split = 'locked'").limit(1).isEmpty():
        raise LockedSplitError("documents of the locked split need leave")
    return documents


def guard_predictions(documents: DataFrame, predictions: DataFrame, split: str, found_id: str | None = None, expect_id: str | None = None) -> None:
    """Raise unless the ids agree and the sets of documents are equal; split ``all`` checks the id only."""
    if expect_id and found_id != expect_id:
        raise PredictionSetError("the prediction id differs")
    if split != "all":
        off = set_difference(documents, predictions, "document").limit(20).collect()
        if off:
            raise PredictionSetError("; ".join(f"{r['side']}: {r['document']}" for r in off))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def latest(cache: DataFrame, key: str, order: str) -> DataFrame:
    """Of records with one key the last; a partial aggregate."""
    rest = [c for c in cache.columns if c != key]
    best = cache.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(key, "b.*")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return requests.join(cache.select(key).distinct(), key, "left_anti")


#: Errors that another attempt does not mend.
FINAL = (ValueError, TypeError, KeyError, PermissionError)


class TokenBucket:
    """At most ``rate`` calls a second on average and ``burst`` at once; ``take`` waits for its turn."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.held, self.at = min(self.burst, self.held + (now - self.at) * self.rate), now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.at = self.clock()
            self.held = 1.0
        self.held -= 1


def _answered(caller: Callable[[str], str], prompt: str, tries: int, wait: float, most: float, bucket: TokenBucket | None) -> tuple[str | None, str | None, int]:
    """Response, error and attempts of one prompt: an error that may pass is tried again after a time that doubles, or after
    the error's own ``retry_after``; one that will not pass is not."""
    for attempt in range(1, tries + 1):
        if bucket:
            bucket.take()
        try:
            return caller(prompt), None, attempt
        except Exception as e:
            if attempt == tries or isinstance(e, FINAL):
                return None, str(e)[:500], attempt
            asked = getattr(e, "retry_after", None)
            pause = min(most, wait * 2 ** (attempt - 1) if asked is None else float(asked))
            if pause > 0:
                time.sleep(pause)
    return None, "not asked", 0


def call_model(requests: DataFrame, caller: Callable[[str], str], key: str = "key", prompt: str = "prompt", tries: int = 1, *, wait: float = 0.0, most_wait: float = 60.0, rate: float | None = None) -> DataFrame:
    """``key, response, error, attempts``: an injected caller over requests, asked up to ``tries`` times; an error becomes a row, not
    a failed task. A task makes at most ``rate`` calls a second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(rate) if rate else None
        for batch in batches:
            rows = [(k, *_answered(caller, p, tries, wait, most_wait, bucket)) for k, p in zip(batch[key], batch[prompt], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "response", "error", "attempts"])

    return requests.select(key, prompt).mapInPandas(run, "key string, response string, error string, attempts int")


def judge_score(p_yes: Column, p_no: Column) -> Column:
    return F.when(p_yes + p_no > 0, p_yes / (p_yes + p_no)).otherwise(F.lit(0.5))


def parse_json_response(content: Column, schema: str) -> Column:
    """A model's JSON without its code fence; null where it is no object of the schema."""
    bare = F.trim(F.regexp_replace(content, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(bare.startswith("{"), F.from_json(bare, schema, {"mode": "PERMISSIVE"}))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, cached: Column) -> Column:
    """Dollars of a call from prices per million tokens; 0 for a cached or unpriced one."""
    return F.when(cached, F.lit(0.0)).otherwise(F.coalesce((tokens_in * price_in + tokens_out * price_out) / 1e6, F.lit(0.0)))


def call_records(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (``document, model, cached, input_tokens, output_tokens, latency_seconds, error``) with ``cost_usd``; ``prices`` has
    ``model, price_in, price_out`` per million tokens, one row a model, and a model without one costs nothing."""
    met = calls.join(prices.select("model", "price_in", "price_out"), "model", "left")
    return met.withColumn("cost_usd", cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"), F.col("cached"))).drop("price_in", "price_out")


def run_record(calls: DataFrame, breaches: DataFrame) -> DataFrame:
    """One row a model run: calls, cached and failed ones, tokens, seconds, cost, breaches and the documents that have any."""
    sums = calls.agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cached"), F.count("error").alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("latency_seconds").alias("latency_seconds"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )
    return sums.crossJoin(breaches.agg(F.count("*").alias("breaches"), F.count_distinct("document").alias("documents_with_breaches")))  # one row each
