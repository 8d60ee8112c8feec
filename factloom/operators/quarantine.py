"""Failures by document: what cannot be read is split off with its reason, and everything else goes on.

``split`` tests rows with expressions and holds back whole documents, so that no plan sees half of one; ``per_document`` runs
an extractor in Python over one document at a time and turns what it raises into a row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(rows: DataFrame) -> dict[str, Column]:
    """What makes a visual row or line (``document, page, row_no, text`` and maybe ``words``) unreadable."""
    bad = {
        "no page number": F.col("page").isNull(),
        "page number below 1": F.col("page") < 1,
        "no row number": F.col("row_no").isNull(),
        "no text": F.col("text").isNull(),
    }
    if "words" in rows.columns:
        bad["no words"] = F.col("words").isNull() | F.exists("words", lambda w: w.isNull() | w["text"].isNull())
        names = rows.schema["words"].dataType.elementType.names
        if {"x0", "x1"} <= set(names):
            bad["words without order"] = F.exists("words", lambda w: w["x0"].isNull() | w["x1"].isNull() | F.isnan(w["x0"]) | F.isnan(w["x1"]) | (w["x1"] < w["x0"]))
    return bad


def split(rows: DataFrame, checks: Mapping[str, Column], key: str = "document") -> tuple[DataFrame, DataFrame]:
    """Rows of documents without a failing row, and ``document, error, rows``: the reasons of the others, in the order of the
    checks, and how many rows fail. Rows without a document are one failing document."""
    bad = {f"no {key}": F.col(key).isNull()} | dict(checks)
    why = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in bad.items()]))
    marked = rows.withColumn("_why", why)
    failing = marked.where(F.size("_why") > 0)
    order = F.array(*[F.lit(name) for name in bad])
    off = failing.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("_why"))).alias("_all"), F.count("*").alias("rows"))
    errors = off.select(key, F.array_join(F.filter(order, lambda x: F.array_contains("_all", x)), "; ").alias("error"), "rows")
    good = rows.where(F.col(key).isNotNull()).join(errors.select(key), key, "left_anti")
    return good, errors


def per_document(rows: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str] = ("page", "row_no")) -> DataFrame:
    """Claims (``schema``, with ``document`` first) of an extractor over each document's rows in order, and ``error``.

    An extractor that raises, or gives columns that are not the schema's, costs its document one row with the error."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        document = group["document"].iloc[0]
        try:
            made = extract(group.sort_values(list(order)))
            made = made[names].assign(error=None)
        except Exception as e:
            made = pd.DataFrame([[document, *[None] * (len(names) - 1), f"{type(e).__name__}: {e}"[:500]]], columns=[*names, "error"])
        return made

    return rows.groupBy("document").applyInPandas(run, f"{schema}, error string")
