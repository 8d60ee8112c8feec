"""Reports of an evaluation: fixed columns, decimals and a single log, written as CSV, Markdown or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as S
from . import store

# Columns of the instance report, of the ingredient report and of the log of locked runs.
INSTANCE_COLUMNS = (
    "document", "field", "gold_state", "predicted_state", "gold_value", "predicted_value", "gold_derivation", "predicted_derivation",
    "gold_rule", "predicted_rule", "evidence_role", "gold_pages", "predicted_page", "gold_evidence", "predicted_evidence",
    "state", "value", "page", "span", "bbox", "derivation", "support",
    "span_coverage", "span_iou", "span_dilution", "bbox_coverage", "bbox_iou", "bbox_dilution", "verbatim", "verbatim_fuzzy_score",
    "joint_correct", "confidence", "gold_requires_evidence", "gold_ambiguous", "bbox_provenance", "target_groups", "groups_located",
    "premise_roles_described", "support_note", "note",
)
INGREDIENT_COLUMNS = (
    "document", "gold_index", "predicted_index", "key", "gold_name", "predicted_name", "gold_concentration", "predicted_concentration",
    "name_ok", "cas_ok", "concentration_ok", "evidence_ok", "verbatim", "record_ok", "record_with_evidence_ok",
)
RUN_COLUMNS = ("date", "split", "system", "extractor", "commit", "prediction_id", "documents", "prediction_file")
DECIMALS = {"span_coverage": 4, "span_iou": 4, "span_dilution": 2, "bbox_coverage": 4, "bbox_iou": 4, "bbox_dilution": 2, "verbatim_fuzzy_score": 1}


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|[\r\n]", " ")


def _shown(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("").alias(name)
    kind = dict(df.dtypes)[name]
    if name in DECIMALS:
        shown = F.format_string(f"%.{DECIMALS[name]}f", F.col(name).cast("double"))
    elif kind.startswith("array"):
        shown = F.array_join(F.transform(name, lambda x: x.cast("string")), ",")
    elif kind == "boolean":
        shown = F.initcap(F.col(name).cast("string"))
    else:
        shown = one_line(F.col(name).cast("string"))
    return F.coalesce(F.when(F.col(name).isNotNull(), shown), F.lit("")).alias(name)


def instance_report(instances: DataFrame) -> DataFrame:
    """The 40 columns of scored fields as text: 4, 2 or 1 decimals, line breaks as spaces, blank for what is missing."""
    some = instances.withColumn("joint_correct", F.col("joint")) if "joint" in instances.columns else instances
    return some.select(*[_shown(some, c) for c in INSTANCE_COLUMNS])


def ingredient_report(records: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The 15 columns of matched records; names and shares come from the items (``document, pos, name, concentration``)."""
    side = lambda items, name: items.select("document", F.col("pos").alias(f"{name}_pos"), F.col("name").alias(f"{name}_name"), F.col("concentration").alias(f"{name}_concentration"))
    met = records.join(side(gold, "gold"), ["document", "gold_pos"], "left").join(side(predicted, "predicted"), ["document", "predicted_pos"], "left")
    met = met.withColumnsRenamed({"gold_pos": "gold_index", "predicted_pos": "predicted_index", "matched_on": "key"})
    return met.select(*[_shown(met, c) for c in INGREDIENT_COLUMNS])


def contract_report(breaches: DataFrame) -> DataFrame:
    """``document, field, code`` of every breach, sorted."""
    return breaches.select("document", F.coalesce("field", F.lit("")).alias("field"), "code").orderBy("document", "field", "code")


def probe_report(rows: DataFrame) -> DataFrame:
    """Rows of ``diagnostics_rows`` (or of an oracle table) as text, columns in their order."""
    return rows.select(*[_shown(rows, c) for c in rows.columns])


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """One CSV with one header, sorted by ``order``; a report is read by people, so it is one file (its rows are fields of
    documents, not tokens). What comes before runs at its own width; only the finished rows move to one task."""
    one = df.repartition(1)
    one = one.sortWithinPartitions(*order) if order else one
    one.write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def run_row(spark: SparkSession, **values) -> DataFrame:
    """A row of the log of locked runs; what is not given is blank."""
    return spark.createDataFrame([tuple(str(values.get(c, "")) for c in RUN_COLUMNS)], ", ".join(f"`{c}` string" for c in RUN_COLUMNS))


LOG = ", ".join(f"`{c}` string" for c in RUN_COLUMNS)


def append_run(row: DataFrame, path: str) -> None:
    """Append a run to the log in one commit; runs that are logged at one time all stay."""
    store.publish(row.select(*[F.col(c).cast("string") for c in RUN_COLUMNS]), path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a log in no order."""
    return store.load(spark, path, LOG)


def write_log(spark: SparkSession, path: str, target: str) -> None:
    """The log as one CSV with one header, by date."""
    write_csv(read_log(spark, path), target, ("date", "prediction_id"))


def axis_table(instances: DataFrame) -> DataFrame:
    """``axis, satisfied, applicable, rate`` with four decimals, as a summary prints them."""
    return S.axis_rates(instances).select("axis", "satisfied", "applicable", F.format_string("%.4f", F.col("rate")).alias("rate"))
