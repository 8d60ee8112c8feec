"""Scoring: localisation, seven axes and their conjunction, record matching, rates and confusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues as Q
from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V

AXES = ("state", "value", "page", "span", "bbox", "derivation", "support")
#: Order of the cumulative stages.
STAGES = AXES[:-1] + ("support",)
#: Kinds of values that a span supports by its text.
KINDS = ("name", "identifier", "formula", "quantity", "temperature")
THRESHOLDS = {"span_coverage": 0.8, "span_iou": 0.5, "box_coverage": 0.8, "box_iou": 0.5, "row_coverage": 0.8, "row_height": 2.5}


def passes(axis: Column) -> Column:
    return axis.isin("satisfied", "n/a")


def joint(axes: tuple[str, ...] = AXES) -> Column:
    return reduce(lambda a, b: a & b, (passes(F.col(a)) for a in axes))


def undecidable(axes: tuple[str, ...] = AXES) -> Column:
    return reduce(lambda a, b: a | b, (F.col(a) == "undecidable" for a in axes))


MEASURES = ("page_match", "span_coverage", "span_iou", "box_coverage", "box_iou", "span_dilution", "box_dilution")


def measured(cited: Column, gold: Column) -> Column:
    """Struct of MEASURES of a citation against a target, both structs of page, text and box; on other pages all are 0."""
    met = F.struct(T.span_overlap(cited["text"], gold["text"]).alias("span"), G.containment(cited["box"], gold["box"]).alias("box"))
    zero = F.lit(0.0)
    shaped = lambda *values: F.struct(*[F.coalesce(v, zero if i else F.lit(0)).alias(name) for i, (name, v) in enumerate(zip(MEASURES, values, strict=True))])
    held = T.let(met, lambda m: shaped(F.lit(1), m["span"]["coverage"], m["span"]["iou"], m["box"]["coverage"], G.iou(cited["box"], gold["box"]), m["span"]["dilution"], m["box"]["dilution"]))
    return F.when(cited["page"] == gold["page"], held).otherwise(shaped(F.lit(0), *[zero] * 6))


def located(best: Column, axis: str) -> Column:
    """Whether a target's best citation locates it on the axis page, span or bbox."""
    t = THRESHOLDS
    if axis == "page":
        return best["page_match"] == 1
    part = "span" if axis == "span" else "box"
    return (best[f"{part}_coverage"] >= t[f"{part}_coverage"]) & (best[f"{part}_iou"] >= t[f"{part}_iou"])


def localisation(pairs: DataFrame) -> DataFrame:
    """Measures of (citation, target) pairs as columns."""
    side = lambda name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in ("page", "text", "box")])
    return pairs.withColumn("_m", measured(side("cited"), side("gold"))).select(*pairs.columns, "_m.*")


def best_citations(measured: DataFrame, target: list[str]) -> DataFrame:
    """Per target the citation that is best by page, span coverage, span IoU and so on in this order."""
    best = measured.groupBy(*target).agg(F.max(F.struct(*MEASURES)).alias("best"))
    return best.select(*target, "best.*")


def group_axes(best: DataFrame, claim: list[str], group: str = "role", needed: str = "needed") -> DataFrame:
    """Axes page, span and bbox of a claim: each target group needs its number of hits on an axis."""
    row = {m: F.col(m) for m in MEASURES}
    hits = best.groupBy(*claim, group, needed).agg(*[F.count_if(located(row, a)).alias(a) for a in ("page", "span", "bbox")])
    verdict = lambda a: F.when(F.bool_and(F.col(a) >= F.col(needed)), "satisfied").otherwise("violated").alias(a)
    return hits.groupBy(*claim).agg(verdict("page"), verdict("span"), verdict("bbox"))


def support(state: Column, value: Column, span: Column, kind: str | Column, verbatim: Column) -> Column:
    """Gold-free verdict of a direct claim from its first cited span (null or blank: not cited). ``kind`` may vary by row."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    cited = F.coalesce(T.collapse(span) != "", F.lit(False))
    held = reduce(lambda out, k: out.when(kind == k, V.value_supported_by(value, span, k)), KINDS[1:], F.when(kind == KINDS[0], V.value_supported_by(value, span, KINDS[0])))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "satisfied").otherwise("violated")
    declared = T.let(Q.form_cue(span), lambda f: F.when(f.isNull(), "undecidable").otherwise(yes(f == V.canonical_value(value, "categorical"))))
    cue = F.coalesce(Q.state_cue(Q.value_part(span)), Q.state_cue(span))
    return (
        F.when(state == "NOT_STATED", F.when(span.isNotNull(), "violated").otherwise("n/a"))
        .when(~cited | ~verbatim, "violated")
        .when(state == "PRESENT", F.when(F.coalesce(value, F.lit("")) == "", "violated").when(kind == "categorical", declared).otherwise(yes(held)))
        .otherwise(T.let(cue, lambda c: F.when(c.isNull(), "undecidable").otherwise(yes(c == state))))
    )


def axis_rates(instances: DataFrame, axes: tuple[str, ...] = AXES, by: list[str] | None = None) -> DataFrame:
    """Per axis: satisfied, applicable (without n/a), undecidable and rate (null when nothing applies), one scan."""
    stacked = instances.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("status")) for a in axes])).alias("x"))
    flat = stacked.select(*(by or []), "x.*")
    return flat.groupBy(*(by or []), "axis").agg(
        F.count_if(F.col("status") == "satisfied").alias("satisfied"),
        F.count_if(F.col("status") != "n/a").alias("applicable"),
        F.count_if(F.col("status") == "undecidable").alias("undecidable"),
        F.try_divide(F.count_if(F.col("status") == "satisfied"), F.count_if(F.col("status") != "n/a")).alias("rate"),
    )


def stage_rates(instances: DataFrame, axes: tuple[str, ...] = STAGES) -> DataFrame:
    """Share of claims that pass the first 1, 2, ... axes; 0 on no claims."""
    parts = [F.coalesce(F.avg(joint(axes[: i + 1]).cast("int")), F.lit(0.0)).alias(f"stage_{i + 1}_{a}") for i, a in enumerate(axes)]
    return instances.agg(F.count("*").alias("n"), *parts)


def rates_by(instances: DataFrame, group: str, ok: Column) -> DataFrame:
    """Overall and per-group counts and rates by grouping sets in one aggregate; ``whole`` marks the overall row."""
    return instances.withColumn("_ok", ok.cast("int")).rollup(group).agg(F.grouping(group).alias("whole"), F.count("*").alias("n"), F.sum("_ok").alias("ok"), F.avg("_ok").alias("rate"))


def confusion(pairs: DataFrame, gold: str, predicted: str, values: list) -> DataFrame:
    """Counts of gold by predicted, ``none`` for a missing prediction."""
    return pairs.withColumn("_p", F.coalesce(F.col(predicted).cast("string"), F.lit("none"))).groupBy(gold).pivot("_p", [*map(str, values), "none"]).count().na.fill(0)


def numbered(rows: DataFrame, document: str, key: str, order: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(document, key).orderBy(order)))


def match_records(gold: DataFrame, predicted: DataFrame, keys: list[str], *, document: str = "document", order: str = "pos") -> DataFrame:
    """One-to-one matches ``document, gold_pos, predicted_pos, matched_on``, by each key in turn.

    A key is an equality, so the greedy match in gold order is a join on the key and the row's number under it."""
    out = None
    left, right = gold, predicted
    for key in keys:
        a = numbered(left, document, key, order).select(document, key, "_n", F.col(order).alias("gold_pos"))
        b = numbered(right, document, key, order).select(document, key, "_n", F.col(order).alias("predicted_pos"))
        found = a.join(b, [document, key, "_n"]).select(document, "gold_pos", "predicted_pos", F.lit(key).alias("matched_on"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(document, F.col("gold_pos").alias(order)), [document, order], "left_anti")
        right = right.join(found.select(document, F.col("predicted_pos").alias(order)), [document, order], "left_anti")
    return out


def effective_cas_state(cas: Column, state: Column) -> Column:
    return F.when(cas.isNotNull() & (cas != ""), "PRESENT").when(state == "PRESENT", "NOT_STATED").otherwise(state)


def record_rates(matches: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold, predicted and matched counts with precision and recall."""
    counts = gold.agg(F.count("*").alias("gold")).crossJoin(predicted.agg(F.count("*").alias("predicted"))).crossJoin(matches.agg(F.count("*").alias("matched")))
    return counts.withColumn("precision", F.try_divide(F.col("matched"), F.col("predicted"))).withColumn("recall", F.try_divide(F.col("matched"), F.col("gold")))


def row_evidence_ok(cited_page: Column, gold_page: Column, cited: Column, gold: Column, verbatim: Column) -> Column:
    t = THRESHOLDS
    return verbatim & (cited_page == gold_page) & (G.containment(cited, gold)["coverage"] >= t["row_coverage"]) & (G.height_ratio(cited, gold) <= t["row_height"])
