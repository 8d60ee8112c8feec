"""Whole runs: extraction over a grid of layers and layouts, evaluation from gold and predictions to reports, the corpus writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import contracts as K
from ..operators import quarantine
from ..operators import retrieval as R
from ..sources import reports
from . import evaluation as E
from . import extraction as P
from . import probes as B
from . import resolution as N


class CorpusError(ValueError):
    """A corpus check failed."""


def extract_grid(rows: dict[tuple[str, str], DataFrame], documents: DataFrame) -> DataFrame:
    """Claims of every (layer, layout) table of rows, with ``layer, layout, error``: a document without rows, or with rows that
    cannot be read, has one row that says so instead of claims, and the others go on."""
    out = None
    for (layer, layout), table in rows.items():
        tag = lambda df, layer=layer, layout=layout: df.withColumns({"layer": F.lit(layer), "layout": F.lit(layout)})
        good, off = quarantine.split(table, quarantine.row_checks(table))
        claims = tag(P.extract_documents(good, layout)).withColumn("error", F.lit(None).cast("string"))
        lost = documents.select("document").distinct().join(table.select("document").distinct(), "document", "left_anti")
        failed = lost.withColumn("error", F.lit("no text on this layer")).unionByName(off.select("document", "error"))
        both = claims.unionByName(tag(failed), allowMissingColumns=True)
        out = both if out is None else out.unionByName(both, allowMissingColumns=True)
    return out


def evaluate_run(gold: DataFrame, claims: DataFrame, pages: DataFrame, folder: str, *, split: str = "dev", allow_locked: bool = False, expect_id: str | None = None, found_id: str | None = None, run: dict | None = None, manifest: DataFrame | None = None, items: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Guard, score and report one prediction set; returns ``instances, summary, by_field`` and, with a manifest, ``by_family``.

    ``items`` has the ingredients (``gold, predicted``: items, ``gold_blocks, predicted_blocks``: their states); then records are
    scored and reported too, and ``ingredients, ingredient_summary`` returned. Of predictions only documents of the split count.

    ``gold`` has ``split``; reports go below ``folder``, a locked run also to the log there. A guard that fails raises before
    anything is scored."""
    some = gold if split == "all" else gold.where(F.col("split") == split)
    K.guard_split(some.select("document", "split").distinct(), allow_locked)
    K.guard_predictions(some, claims, split, found_id, expect_id)
    instances = E.evaluate(some, claims.where(F.col("field").isNotNull()), pages, fuzzy=True)
    name = (run or {}).get("system", "system")
    reports.write_csv(reports.instance_report(instances), f"{folder}/{name}_instances", ("document", "field"))
    if split == "locked":
        reports.append_run(reports.run_row(gold.sparkSession, split=split, prediction_id=found_id or "", documents=some.select("document").distinct().count(), **(run or {})), f"{folder}/locked_runs")
    out = {"instances": instances, "summary": E.summary(instances), "by_field": E.field_rates(instances)}
    if manifest is not None:
        out["by_family"] = E.family_rates(instances, manifest)
    if items is not None:
        asked = some.select("document").distinct()
        held = {part: rows.join(asked, "document", "left_semi") for part, rows in items.items()}
        records = E.evaluate_ingredients(held["gold"], held["predicted"], pages)
        shown = reports.ingredient_report(records, held["gold"], held["predicted"])
        reports.write_csv(shown, f"{folder}/{name}_ingredients", ("document", "gold_index"))
        out |= {"ingredients": records, "ingredient_summary": E.ingredient_summary(records, held["gold"], held["predicted"], held["gold_blocks"], held["predicted_blocks"])}
    return out


def diagnose_run(gold: DataFrame, pages: DataFrame, rows: DataFrame, folder: str, *, pipeline: DataFrame | None = None, native: DataFrame | None = None, layer: str = "native") -> dict[str, DataFrame]:
    """Run the probes of one layer and write their report below ``folder``; ``rows, rates``. ``pipeline`` are the claims of a
    prediction set, as ``tables.predictions`` reads it and plans take it; ``native`` as in ``run_probes``."""
    scored = B.run_probes(gold, pages, rows, pipeline, native)
    spans = gold if native is None else B.spans_on_layer(gold, native, pages)
    told = B.diagnostics_rows(scored, spans)
    reports.write_csv(reports.probe_report(told), f"{folder}/diagnostics_{layer}", ("document", "field"))
    return {"rows": told, "rates": B.probe_rates(scored)}


def write_corpus(gold: DataFrame, pages: DataFrame, units: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Write ``units`` and evidence sets as JSON lines below ``folder`` after checks of span offsets and page counts, read
    them back, and return the corpus statistics (``what, name, n``). A check that fails raises."""
    spark = gold.sparkSession
    off = N.span_offsets_off(gold, pages).limit(20).collect()
    if off:
        raise CorpusError("; ".join(f"{r['document']}/{r['field']} page {r['page']}: {r['text']!r} is {r['found']!r}" for r in off))
    counts = N.page_counts_off(manifest, pages).limit(20).collect()
    if counts:
        raise CorpusError("; ".join(f"{r['document']}: {r['found']} pages, not {r['pages']}" for r in counts))
    sets = R.evidence_sets(gold)
    for name, df in (("units", units), ("gold_evidence", sets)):
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{folder}/{name}")
        again = spark.read.schema(df.schema).json(f"{folder}/{name}").count()
        if again != seen.get["n"]:
            raise CorpusError(f"{name}: {again} rows read back of {seen.get['n']}")
    return corpus_stats(spark.read.schema(sets.schema).json(f"{folder}/gold_evidence"), spark.read.schema(units.schema).json(f"{folder}/units"))


def corpus_stats(sets: DataFrame, units: DataFrame) -> DataFrame:
    """``what, name, n``: fields by state, derivation and size of evidence set (1, 2, 3+), fragments by kind, instances over
    several pages, and the least, median, 90 % and largest tokens of a unit by layer."""
    size = F.when(F.col("n_pieces") >= 3, "3+").otherwise(F.col("n_pieces").cast("string"))
    wide = sets.withColumn("size", size).withColumn("crosses", F.when(F.col("cross_page"), "yes").otherwise("no"))
    out = None
    for what in ("state", "derivation", "size", "crosses"):
        one = wide.groupBy(F.col(what).alias("name")).agg(F.count("*").cast("double").alias("n")).select(F.lit(what).alias("what"), "name", "n")
        out = one if out is None else out.unionByName(one)
    kinds = sets.select(F.explode("pieces").alias("p")).groupBy(F.col("p.kind").alias("name")).agg(F.count("*").cast("double").alias("n"))
    out = out.unionByName(kinds.select(F.lit("fragments").alias("what"), "name", "n"))
    layered = units if "layer" in units.columns else units.withColumn("layer", F.lit("native"))
    sums = layered.groupBy("layer").agg(F.min("n_tokens").alias("min"), F.median("n_tokens").alias("median"), F.max("n_tokens").alias("max"), F.count("*").alias("units"))
    met = sums.join(R.percentile_row(layered, ["layer"], "n_tokens"), "layer")
    cells = F.array(*[F.struct(F.concat(F.col("layer"), F.lit(f" {c}")).alias("name"), F.col(c).cast("double").alias("n")) for c in ("units", "min", "median", "p90", "max")])
    return out.unionByName(met.select(F.inline(cells)).select(F.lit("tokens").alias("what"), "name", "n"))
