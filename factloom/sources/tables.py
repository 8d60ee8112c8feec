"""Sources with explicit schemas, and sinks. No inference: a schema is part of a source's contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contracts as K
from . import store

_REF = "struct<page: int, text: string, occurrence: int, case_sensitive: boolean>"
_FIELD = f"struct<state: string, derivation: string, rule: string, value: string, accepted_values: array<string>, ambiguous: boolean, alternative_state: string, note: string, evidence: array<{_REF}>>"
_ITEM = f"struct<name: string, cas_number: string, cas_state: string, concentration: string, note: string, evidence: array<{_REF}>>"
ANNOTATION = f"document string, split string, product_form string, note string, fields map<string, {_FIELD}>, ingredients struct<state: string, note: string, evidence: array<{_REF}>, items: array<{_ITEM}>>"
MANIFEST = "document string, split string, supplier string, template_family string, regime string, language string, scan string, pages string, product_form string, note string"
OCR = "document string, pages array<struct<page_number: int, image_width: double, image_height: double, words: array<struct<text: string, confidence: double, bbox: array<double>>>>>"
_SPAN = "struct<page: int, text: string, bbox: array<double>, bbox_provenance: string>"
_CLAIM = f"struct<state: string, value: string, evidence: {_SPAN}, derivation: string, rule: string, premises: array<{_SPAN}>, confidence: double, rationale: string>"
PREDICTIONS = f"system string, configuration map<string,string>, documents array<struct<document: string, error: string, fields: map<string, {_CLAIM}>>>"
UNITS = "document string, split string, page int, layer string, text string, n_tokens int"
INSTANCES = "document string, field string, state string, value string, page string, span string, bbox string, derivation string, support string"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Gold fields, one row per document and field, with the loader's defaults."""
    raw = spark.read.schema(ANNOTATION).json(path, multiLine=True)
    rows = raw.select("document", F.coalesce("split", F.lit("dev")).alias("split"), "product_form", F.explode("fields").alias("field", "f"))
    kind = F.coalesce("f.derivation", F.lit("EXPLICIT"))
    rule = F.coalesce("f.rule", F.when(kind == "ONTOLOGY", "identifier_undefined_for_form").when(kind == "COMPOSITION_IMPLIED", "composition_implies_form"))
    return rows.select("document", "split", "product_form", "field", F.col("f.state").alias("state"), kind.alias("derivation"), rule.alias("rule"), F.col("f.value").alias("value"), F.col("f.accepted_values").alias("accepted_values"), F.col("f.alternative_state").alias("alternative_state"), F.col("f.evidence").alias("evidence"))


def ingredients(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ANNOTATION).json(path, multiLine=True)
    items = raw.select("document", F.posexplode("ingredients.items").alias("pos", "i"))
    return items.select("document", "pos", "i.name", "i.cas_number", F.coalesce("i.cas_state", F.lit("PRESENT")).alias("cas_state"), "i.concentration", "i.evidence")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(MANIFEST).csv(path, header=True)
    return raw.withColumn("scan", F.coalesce(F.lower(F.trim("scan")).isin("yes", "true", "1"), F.lit(False))).withColumn("pages", F.coalesce(F.expr("try_cast(trim(pages) AS int)"), F.lit(0)))


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words with boxes in page fractions; blank words are dropped, input order is ``word_no``."""
    raw = spark.read.schema(OCR).json(path, multiLine=True)
    words = raw.select("document", F.inline("pages")).select("document", "page_number", "image_width", "image_height", F.posexplode("words").alias("word_no", "w"))
    part = lambda i, of: F.element_at("w.bbox", i) / F.col(of)
    return words.where(F.trim("w.text") != "").select("document", F.col("page_number").alias("page"), "word_no", F.col("w.text").alias("text"), F.col("w.confidence").alias("confidence"), part(1, "image_width").alias("x0"), part(2, "image_height").alias("y0"), part(3, "image_width").alias("x1"), part(4, "image_height").alias("y1"))


def predictions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Claims, one row per document and field; a repeated document's last entry wins."""
    raw = spark.read.schema(PREDICTIONS).json(path, multiLine=multi_line)
    docs = raw.select("system", "configuration", F.posexplode("documents").alias("pos", "d"))
    last = docs.groupBy("system", F.col("d.document").alias("document")).agg(F.max_by("d", "pos").alias("d"), F.max_by("configuration", "pos").alias("configuration"))
    return last.select("system", "configuration", "document", F.col("d.error").alias("error"), F.explode_outer("d.fields").alias("field", "claim"))


def units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNITS).json(path)


def page_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Names of the document files below a folder, sorted; contents are read only when asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("document"), "length").orderBy("document")


def write_json(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition or [])).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; line breaks in texts become spaces."""
    flat = df.select(*[F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
    flat.write.mode("overwrite").csv(path, header=True)


def pdf_words(words: DataFrame) -> DataFrame:
    """Words of a PDF reader (``document, page, block, line, word_no, text, x0, y0, x1, y1, width, height``) in reading order:
    ``line_no`` and ``word_no`` count from 0, blank words are dropped, boxes are fractions of the page."""
    some = words.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    page = Window.partitionBy("document", "page")
    lined = some.withColumn("line_no", F.dense_rank().over(page.orderBy("block", "line")) - 1)
    placed = lined.withColumn("word_no", F.row_number().over(Window.partitionBy("document", "page", "line_no").orderBy("word_no")) - 1)
    part = lambda c, of: (F.col(c) / F.col(of)).alias(c)
    return placed.select("document", "page", "line_no", "word_no", "text", part("x0", "width"), part("y0", "height"), part("x1", "width"), part("y1", "height"))


def checked_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``predictions`` of which every claim fits the contract; the first that do not are named in the error."""
    rows = predictions(spark, path)
    c = F.col("claim")
    shaped = rows.where(c.isNotNull()).select("document", "field", c["state"].alias("state"), c["value"].alias("value"), c["derivation"].alias("derivation"), c["rule"].alias("rule"), F.coalesce(F.array_size(c["premises"]), F.lit(0)).alias("n_premises"), c["evidence"].isNotNull().alias("has_evidence"))
    off = shaped.withColumn("codes", K.claim_breaches()).where(F.size("codes") > 0).orderBy("document", "field").limit(20).collect()
    if off:
        raise K.PredictionSetError("; ".join(f"{r['document']}/{r['field']}: {', '.join(r['codes'])}" for r in off))
    return rows


def write_predictions(claims: DataFrame, path: str, system: str, configuration: dict[str, str]) -> None:
    """Claims (``document, field`` and a claim's columns) as JSON lines that ``predictions`` reads back, a line a document."""
    claim = F.struct(*[c for c in claims.columns if c not in ("document", "field", "error")])
    fields = claims.groupBy("document").agg(F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", claim)))).alias("fields"))
    conf = F.create_map(*[F.lit(x) for kv in sorted(configuration.items()) for x in kv])
    record = fields.select(F.lit(system).alias("system"), conf.alias("configuration"), F.array(F.struct("document", "fields")).alias("documents"))
    record.write.mode("overwrite").json(path)


_RESOLVED = (
    "struct<page: int, text: string, bbox: array<double>, char_start: int, char_end: int, occurrences: int, "
    "ocr_bbox: array<double>, ocr_char_start: int, ocr_char_end: int, ocr_exact: boolean, ocr_score: double>"
)
_GOLD_FIELD = (
    "struct<state: string, derivation: string, rule: string, value: string, accepted_values: array<string>, alternative_state: string, "
    f"evidence: array<{_REF}>, resolved_evidence: array<{_RESOLVED}>, resolved_premises: array<{_RESOLVED}>>"
)
#: Gold as it is kept: a record a document, its fields by name with references as written and spans as resolved.
GOLD = f"document string, split string, product_form string, fields map<string, {_GOLD_FIELD}>"
_BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def _kept_spans(spans: Column, names: list[str]) -> Column:
    corners = lambda b: F.when(b.isNotNull(), F.array(b["x0"], b["y0"], b["x1"], b["y1"]))
    has = lambda s, n: s[n] if n in names else F.lit(None)

    def kept(s: Column) -> Column:
        ocr = corners(s["ocr_box"]) if "ocr_box" in names else F.lit(None)
        rest = [has(s, n).alias(n) for n in ("char_start", "char_end", "occurrences")]
        return F.struct(s["page"].alias("page"), s["text"].alias("text"), corners(s["box"]).alias("bbox"), *rest, ocr.alias("ocr_bbox"), *[has(s, f"ocr_{n}").alias(f"ocr_{n}") for n in ("char_start", "char_end", "exact", "score")])

    return F.transform(spans, kept).cast(f"array<{_RESOLVED}>")


def write_gold(gold: DataFrame, fields: DataFrame, path: str) -> None:
    """Resolved gold (``document, split, product_form, field``, a field's columns, span arrays ``evidence, premises``) in the nested
    shape, as the one version at ``path``; ``fields`` has the references as written (``document, field, evidence``)."""
    names = gold.schema["evidence"].dataType.elementType.names
    none = {"accepted_values": "array<string>", "alternative_state": "string", "rule": "string"}
    some = gold.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items() if c not in gold.columns])
    refs = fields.select("document", "field", F.col("evidence").cast(f"array<{_REF}>").alias("_refs"))
    met = some.join(refs, ["document", "field"], "left")
    record = F.struct(
        "state", "derivation", "rule", "value", "accepted_values", "alternative_state", F.col("_refs").alias("evidence"),
        _kept_spans(F.col("evidence"), names).alias("resolved_evidence"), _kept_spans(F.col("premises"), names).alias("resolved_premises"),
    )
    packed = met.groupBy("document").agg(F.first("split").alias("split"), F.first("product_form").alias("product_form"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", record.alias("f"))))).alias("fields"))
    store.replace(packed, path)


def read_gold(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    """The last gold that was written whole: a row a field, spans with ``box`` structs as plans take them."""
    rows = store.load(spark, path, GOLD)
    rows = rows if split == "all" else rows.where(F.col("split") == split)
    one = rows.select("document", "split", "product_form", F.explode("fields").alias("field", "f"))
    box = lambda b: F.when(b.isNotNull(), F.struct(*[F.get(b, i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).cast(_BOX))

    def span(s: Column) -> Column:
        rest = ("char_start", "char_end", "occurrences", "ocr_char_start", "ocr_char_end", "ocr_exact", "ocr_score")
        return F.struct(s["page"].alias("page"), s["text"].alias("text"), box(s["bbox"]).alias("box"), *[s[n].alias(n) for n in rest], box(s["ocr_bbox"]).alias("ocr_box"))

    flat = ("state", "derivation", "rule", "value", "accepted_values", "alternative_state")
    return one.select("document", "split", "product_form", "field", *[F.col(f"f.{c}").alias(c) for c in flat], F.col("f.evidence").alias("references"), *[F.transform(f"f.resolved_{p}", span).alias(p) for p in ("evidence", "premises")])


def exploration(fields: DataFrame) -> DataFrame:
    """``what, name, n`` over gold fields: documents by product form, fields by derivation, references by field, and fields
    with more than one reference."""
    n = F.coalesce(F.array_size("evidence"), F.lit(0))
    forms = fields.select("document", F.coalesce("product_form", F.lit("UNKNOWN")).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n"))
    out = forms.select(F.lit("product_form").alias("what"), "name", "n")
    for what, name, value in (("derivation", "derivation", F.count("*")), ("evidence", "field", F.sum(n)), ("multi_evidence", "field", F.count_if(n > 1))):
        out = out.unionByName(fields.groupBy(F.col(name).alias("name")).agg(value.cast("long").alias("n")).select(F.lit(what).alias("what"), "name", "n"))
    return out
