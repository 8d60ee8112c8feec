"""Tables that are published whole: data is written to a folder of its own and counts once its manifest is there.

A commit writes its files under ``data/<name>`` and then renames one small manifest into ``manifests``; readers take the folders
that manifests name and nothing else. A job that fails leaves files that nobody reads, commits at one time do not meet, and
a reader sees a commit whole or not at all. A manifest may name earlier commits that it replaces: ``replace`` keeps the
newest version of a table only, ``compact`` turns many small commits into one.

``embed_missing`` keeps vectors by the digest of model and text, in runs sorted by digest: texts that some run holds are not
embedded again, whatever page they stand on.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts as K

VECTORS = "digest string, vector array<double>"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    fs, folder = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [str(s.getPath()) for s in fs.listStatus(folder)]
    rows = spark.read.text(names, wholetext=True).collect() if names else []  # a line a commit; compaction keeps them few
    return sorted((json.loads(r[0]) for r in rows), key=lambda m: (m["at"], m["name"]))


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the commits that count, oldest first."""
    found = _manifests(spark, path)
    gone = {name for m in found for name in m["replaces"]}
    return [m["name"] for m in found if m["name"] not in gone]


def publish(df: DataFrame, path: str, replaces: Sequence[str] = ()) -> str:
    """Add ``df`` to the table at ``path`` in one commit, in place of those it ``replaces``; the commit's name."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    fs, staged = _fs(spark, f"{path}/staged/{name}.json")
    out = fs.create(staged)
    out.write(bytearray(json.dumps({"name": name, "at": time.time_ns(), "replaces": list(replaces)}).encode()))
    out.close()
    _, folder = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    _, target = _fs(spark, f"{path}/manifests/{name}.json")
    if not fs.rename(staged, target):
        raise OSError(f"commit {name} of {path} could not be published")
    return name


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all commits that count; none for a table without one."""
    names = committed(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> str:
    """Publish ``df`` as the table's only version; the earlier ones stay readable until the manifest is there."""
    return publish(df, path, committed(df.sparkSession, path))


def compact(spark: SparkSession, path: str, schema: str, order: Sequence[str], keys: Sequence[str] = ()) -> None:
    """All commits as one, sorted by ``order``; of rows with equal ``keys`` one stays."""
    names = committed(spark, path)
    if len(names) > 1:
        rows = spark.read.schema(schema).parquet(*[f"{path}/data/{n}" for n in names])
        rows = rows.dropDuplicates(list(keys)) if keys else rows
        publish(rows.repartitionByRange(*order).sortWithinPartitions(*order), path, names)


def vacuum(spark: SparkSession, path: str, older_than_s: float = 86_400) -> int:
    """Delete folders that no manifest counts and that are older than a day, so that no running commit or reader loses its files."""
    held = set(committed(spark, path))
    fs, folder = _fs(spark, f"{path}/data")
    if not fs.exists(folder):
        return 0
    old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in held and s.getModificationTime() < (time.time() - older_than_s) * 1000]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def digest(model: str, text: str = "text"):
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.col(text)), 256)


def embed_missing(pages: DataFrame, path: str, model: str, embed: Callable[[list[str]], list[list[float]]], *, text: str = "text", runs: int = 8) -> DataFrame:
    """``pages`` with ``vector``; only texts that the store at ``path`` lacks for this model are embedded, each once.

    ``embed`` gets a batch of texts in a task and gives a vector for each; a null text has none. From ``runs`` commits on
    the store is compacted."""
    spark = pages.sparkSession
    named = pages.withColumn("_digest", F.when(F.col(text).isNotNull(), digest(model, text)))
    asked = named.where("_digest is not null").groupBy(F.col("_digest").alias("digest")).agg(F.first(text).alias("text"))
    unseen = asked.join(load(spark, path, VECTORS).select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = [[float(x) for x in v] for v in embed(batch["text"].tolist())]
                if len(made) != len(batch):
                    raise ValueError("a vector is missing")
                yield pd.DataFrame({"digest": batch["digest"], "vector": made})

    if not unseen.limit(1).isEmpty():
        publish(unseen.mapInPandas(run, VECTORS).sortWithinPartitions("digest"), path)
        if len(committed(spark, path)) >= runs:
            compact(spark, path, VECTORS, ["digest"], ["digest"])
    held = load(spark, path, VECTORS).dropDuplicates(["digest"]).withColumnRenamed("digest", "_digest")
    return named.join(held, "_digest", "left").drop("_digest")


ANSWERS = "key string, response string, error string, attempts int"


def ask_missing(requests: DataFrame, path: str, caller: Callable[[str], str], *, parts: int = 16, **how) -> DataFrame:
    """Answers (``key, response, error, attempts``) to ``requests`` (``key, prompt``), kept at ``path``: only prompts without an answer are asked.

    Keys are dealt in ``parts`` by hash and each part is published when it is answered, so a run that dies asks no more than one
    part again. Errors are not kept: a later run asks those prompts anew. ``how`` goes to ``contracts.call_model``."""
    spark = requests.sparkSession
    asked = requests.select(F.col("key").cast("string").alias("key"), "prompt").where("key is not null").dropDuplicates(["key"])
    known = load(spark, path, ANSWERS).where("response is not null")
    lost = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).join(known.select("key"), "key", "left_anti")
        if not some.limit(1).isEmpty():
            name = publish(K.call_model(some, caller, **how), path)
            errors = spark.read.schema(ANSWERS).parquet(f"{path}/data/{name}").where("error is not null")
            lost = errors if lost is None else lost.unionByName(errors)
    held = load(spark, path, ANSWERS).where("response is not null").dropDuplicates(["key"])
    answers = asked.select("key").join(held, "key")
    return answers if lost is None else answers.unionByName(lost)
