"""Nested validation: rules along a record's schema as one expression that gives every problem with its path.

A shape is a dictionary of fields. A field is a list of checks (code, condition that must hold, over the field's value), an
``Each`` for the items of an array or the values of a map, or a shape of its own; ``""`` has the checks of the record itself.
``problems`` walks the shape once, on the driver, and compiles it to one array of (path, code): nothing is looked up at run
time and all rules of a record are found in its row. Conditions that are null count as held: a missing value has rules of its
own (``required``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contracts as K

Check = tuple[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class Each:
    """The shape of every item of an array, or of every value of a map."""

    shape: dict | list
    of_map: bool = False


def required(code: str = "missing") -> Check:
    return code, lambda c: c.isNotNull()


def one_of(*values: str) -> Check:
    return "unknown_value", lambda c: c.isin(*values)


def between(low: float, high: float) -> Check:
    return "out_of_range", lambda c: (c >= low) & (c <= high)


_NONE = "array<struct<path: string, code: string>>"


def _off(checks: list[Check], value: Column, path: Column) -> Column:
    """One problem a check that does not hold."""
    found = [F.when(~F.coalesce(holds(value), F.lit(True)), F.struct(path.alias("path"), F.lit(code).alias("code"))) for code, holds in checks]
    return F.array_compact(F.array(*found)).cast(_NONE)


def _walk(shape: dict | list, value: Column, path: Column) -> Column:
    if isinstance(shape, list):
        return _off(shape, value, path)
    parts = []
    for name, rule in shape.items():
        inner = value if name == "" else value[name]
        at = path if name == "" else F.concat(path, F.when(path != "", ".").otherwise(""), F.lit(name))
        if isinstance(rule, Each):
            parts.append(F.coalesce(F.flatten(_items(rule, inner, at)), F.array().cast(_NONE)))
        elif isinstance(rule, dict):
            # What is not there has no fields to check.
            parts.append(F.when(inner.isNotNull(), _walk(rule, inner, at)).otherwise(F.array().cast(_NONE)))
        else:
            parts.append(_off(rule, inner, at))
    return F.concat(*parts) if parts else F.array().cast(_NONE)


def _items(rule: Each, value: Column, path: Column) -> Column:
    """Problems of each item, whose path is its index or its key."""
    if rule.of_map:
        return F.transform(F.map_entries(value), lambda e: _walk(rule.shape, e["value"], F.concat(path, F.lit("."), e["key"])))
    return F.transform(value, lambda x, i: _walk(rule.shape, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))


def problems(shape: dict, value: Column) -> Column:
    """All problems of a record, as (path, code) in the order of the shape."""
    return _walk(shape, value, F.lit(""))


def found(records: DataFrame, shape: dict, value: str, *keys: str) -> DataFrame:
    """``keys, path, code`` of all problems of a struct column: the array is made in a step of its own, then spread."""
    return records.select(*keys, problems(shape, F.col(value)).alias("_off")).where(F.size("_off") > 0).select(*keys, F.inline("_off"))


# States, derivations, provenances, and how far outside the page a box may reach.
STATES = ("PRESENT", "NO_DATA", "NOT_APPLICABLE", "NOT_STATED")
DERIVATIONS = ("DIRECT", "DERIVED")
PROVENANCES = ("system", "derived", "none")
BOX_ROOM = 0.01

_BOX: list[Check] = [
    ("box_size", lambda b: F.size(b) == 4),
    ("box_range", lambda b: (F.size(b) != 4) | F.forall(b, lambda x: (x >= -BOX_ROOM) & (x <= 1 + BOX_ROOM))),
    ("box_order", lambda b: (F.size(b) != 4) | ((F.get(b, 0) <= F.get(b, 2)) & (F.get(b, 1) <= F.get(b, 3)))),
]
_SPAN = {"page": [required(), ("page_number", lambda p: p >= 1)], "text": [required()], "bbox": _BOX, "bbox_provenance": [one_of(*PROVENANCES)]}


def _claim_rules() -> list[Check]:
    """The rules between a claim's fields, each of its own code (``contracts.claim_breaches`` over one claim)."""
    held = lambda c: F.coalesce(F.array_size(c["premises"]), F.lit(0)) > 0
    derived, silent = lambda c: c["derivation"] == "DERIVED", lambda c: c["state"] == "NOT_STATED"
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    return [
        ("value_without_present", lambda c: (c["state"] == "PRESENT") | ~filled(c["value"])),
        ("citation_on_not_stated", lambda c: ~silent(c) | (c["evidence"].isNull() & ~held(c))),
        ("derived_without_rule", lambda c: ~derived(c) | filled(c["rule"])),
        ("derived_without_premise", lambda c: ~derived(c) | held(c)),
        ("derived_with_evidence", lambda c: ~derived(c) | c["evidence"].isNull()),
        ("direct_with_rule", lambda c: derived(c) | ~filled(c["rule"])),
        ("direct_with_premises", lambda c: derived(c) | ~held(c)),
    ]


CLAIM = {
    "": _claim_rules(),
    "state": [required(), one_of(*STATES)],
    "derivation": [one_of(*DERIVATIONS)],
    "confidence": [between(0.0, 1.0)],
    "evidence": _SPAN,
    "premises": Each(_SPAN),
}
INGREDIENTS = {
    "state": [required(), one_of(*STATES)],
    "evidence": _SPAN,
    "items": Each({"cas_state": [one_of(*STATES)], "evidence": _SPAN}),
}
DOCUMENT = {"document": [required()], "fields": Each(CLAIM, of_map=True), "ingredients": INGREDIENTS}


def _schema() -> str:
    span = "struct<page: int, text: string, bbox: array<double>, bbox_provenance: string>"
    claim = f"struct<state: string, value: string, evidence: {span}, derivation: string, rule: string, premises: array<{span}>, confidence: double, rationale: string>"
    item = f"struct<name: string, cas_number: string, cas_state: string, concentration: string, evidence: {span}>"
    block = f"struct<state: string, items: array<{item}>, evidence: {span}>"
    return f"system string, configuration map<string, string>, documents array<struct<document: string, error: string, fields: map<string, {claim}>, ingredients: {block}>>, _bad string"


def read_checked(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """A prediction file's documents (``system, configuration, d``) and its problems (``system, document, path, code``).

    A record that is no JSON of this schema is kept as a problem with the code ``unreadable`` and its text as path; a field of
    another type makes its record one. Documents with problems are in the first table too: the caller decides."""
    raw = spark.read.schema(_schema()).json(path, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    some = raw.where("_bad is null and (configuration is null or size(configuration) >= 0)").select("system", "configuration", F.explode("documents").alias("d"))
    off = found(some.withColumn("document", F.col("d.document")), DOCUMENT, "d", "system", "document")
    none = F.lit(None).cast("string")
    # Fields that a query does not name are not parsed, and so not found wrong: all are named.
    whole = "(documents is null or size(documents) >= 0) and (configuration is null or size(configuration) >= 0)"
    bad = raw.where(f"_bad is not null and {whole}").select("system", none.alias("document"), F.col("_bad").alias("path"), F.lit("unreadable").alias("code"))
    lost = raw.where("_bad is null and (system is null or documents is null)").select("system", none.alias("document"), F.when(F.col("system").isNull(), "system").otherwise("documents").alias("path"), F.lit("missing").alias("code"))
    return some, off.unionByName(bad).unionByName(lost)


def assert_valid(off: DataFrame, most: int = 20) -> None:
    """Raise with the first problems in order, if there are any."""
    first = off.orderBy("document", "path", "code").limit(most).collect()
    if first:
        raise K.PredictionSetError("; ".join(f"{r['document'] or '?'} {r['path']}: {r['code']}" for r in first))
