"""Verbatim search: which texts hold which passages, where, and how often.

Passages are normalised once and shipped as one Aho-Corasick automaton, so that a text is read once whatever the number
of passages. The automaton is built from at most ``chunk_chars`` characters of passages; more passages mean more
passes over the texts, not a larger broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T
from . import near
from .near import likest_window, partial_ratio  # noqa: F401


def contains(page: Column, quote: Column) -> Column:
    """Verbatim test of one page and one quote, both in search form; an empty quote is in nothing."""
    return (quote != "") & F.contains(page, quote)


def on_page(text: Column, row_text: Column, quote: Column) -> Column:
    """The quote stands in reading order or in visual rows."""
    n = T.search_form(quote)
    return contains(T.search_form(text), n) | contains(T.search_form(row_text), n)


def positions(page: Column, quote: Column) -> Column:
    """All 0-based starts of the quote in the page, overlapping ones too; for short pages."""
    last = F.length(page) - F.length(quote) + 1

    def behind(first: Column) -> Column:
        # A plain search finds the first place; only what lies behind it is tried one by one.
        starts = F.filter(F.sequence(first, F.greatest(last, first)), lambda i: F.substring(page, i, F.length(quote)) == quote)
        return F.when((quote == "") | (first == 0), F.array().cast("array<int>")).otherwise(F.transform(starts, lambda i: i - 1))

    return T.let(F.coalesce(F.position(quote, page), F.lit(0)), behind)


def nth_position(page: Column, quote: Column, n: Column) -> Column:
    return F.try_element_at(positions(page, quote), n) if not isinstance(n, int) else F.try_element_at(positions(page, quote), F.lit(n))


def _scan(needles: list[tuple[str, object]], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        owners: dict[str, list[object]] = {}
        for text, item in needles:
            owners.setdefault(text, []).append(item)
        for text, items in owners.items():
            machine.add_word(text, (len(text), items))
        machine.make_automaton()
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: dict[object, list[int]] = {}
                for end, (size, items) in machine.iter(text or ""):
                    for item in items:
                        hit = found.setdefault(item, [0, end - size + 1])
                        hit[0] += 1
                        hit[1] = min(hit[1], end - size + 1)
                for item, (n, first) in found.items():
                    for column, v in zip(out, (doc, item, n, first), strict=True):
                        column.append(v)
            if out[0]:
                kinds = [batch.schema.field(0).type, pa.string() if isinstance(out[1][0], str) else pa.int64(), pa.int64(), pa.int64()]
                cells = [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cells, names=[key, "item_id", "n_hits", "first_offset"])

    return run


def passages_in(texts: DataFrame, passages: DataFrame, *, key: str = "doc_id", text: str = "text", chunk_chars: int = 8_000_000, form: bool = True) -> DataFrame:
    """``key, item_id, n_hits, first_offset`` (0-based, in search form) for every text and passage that it holds; with
    ``form`` false the passages are in search form already (pieces keep the spaces at their ends). Ids are numbers or strings."""
    normal = passages.select("item_id", (T.search_form(F.col("text")) if form else F.col("text")).alias("n")).where("n <> ''")
    parts = normal.agg(F.coalesce(F.sum(F.length("n")), F.lit(0))).first()[0] // chunk_chars + 1
    kind = lambda df, c: "string" if dict(df.dtypes)[c] == "string" else "long"
    pages = texts.select(F.col(key).cast(kind(texts, key)).alias(key), T.search_form(F.col(text)).alias("n"))
    schema = f"{key} {kind(texts, key)}, item_id {kind(passages, 'item_id')}, n_hits long, first_offset long"
    out = None
    for part in range(parts):
        needles = [(r["n"], r["item_id"]) for r in normal.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()]
        if needles:
            hits = pages.mapInArrow(_scan(needles, key), schema)
            out = hits if out is None else out.unionByName(hits)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


#: Characters of a text that are placed at once.
_CHUNK = 1_000_000


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: how many characters its search form has (dropped marks 0), and whether it is white space."""
    wide, space = np.ones(0x110000, np.int8), np.zeros(0x110000, bool)
    for c in T.DROPPED:
        wide[ord(c)] = 0
    for c, form in T.LIGATURES.items():
        wide[ord(c)] = len(form)
    space[[i for i in range(0x3001) if chr(i).isspace()]] = True
    return wide, space


def _placed(texts: list[str], low: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the texts' search forms its place in its text, and how many each text has."""
    wide, space = _kinds()
    size = np.array([len(v) for v in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row, first = np.repeat(np.arange(len(texts)), size), np.cumsum(size) - size
    # Dropped marks first: white space on both sides of one is one run.
    kept = np.flatnonzero(wide[codes])
    blank, of = space[codes[kept]], row[kept]
    solid = np.flatnonzero(~blank)
    # A space stays where a character stands before it and another one after it in the same text.
    stays = ~blank
    gaps = np.flatnonzero(blank[1:] & ~blank[:-1] & (of[1:] == of[:-1])) + 1
    after = np.searchsorted(solid, gaps)
    gaps, after = gaps[after < len(solid)], after[after < len(solid)]
    stays[gaps[of[solid[after]] == of[gaps]]] = True
    kept = kept[stays]
    times = wide[codes[kept]].astype(np.int64)
    if low:
        times[codes[kept] == 0x130] = 2  # the one letter whose small form has two characters
    return np.repeat(kept - first[row[kept]], times), np.bincount(row[kept], times, len(texts)).astype(np.int64)


def chunks(texts: list[str | None], low: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows in runs of about ``_CHUNK`` characters with what ``_placed`` finds of them; nulls as empty texts."""
    start, size = 0, 0
    for i, v in enumerate(texts):
        size += len(v or "")
        if size >= _CHUNK or i + 1 == len(texts):
            yield slice(start, i + 1), *_placed([v or "" for v in texts[start : i + 1]], low)
            start, size = i + 1, 0


def _listed(text: pa.Array, low: bool) -> pa.Array:
    texts = text.to_pylist()
    parts = [(places, n) for _, places, n in chunks(texts, low)]
    ends = np.cumsum(np.concatenate([[0], *[n for _, n in parts]]))
    values = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in parts]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()), mask=pa.array([v is None for v in texts], pa.bool_()))


@F.arrow_udf(ArrayType(IntegerType()))
def offsets(text: pa.Array) -> pa.Array:
    """For each character of the search form, the place in the original text that it stems from."""
    return _listed(text, True)


@F.arrow_udf(ArrayType(IntegerType()))
def exact_offsets(text: pa.Array) -> pa.Array:
    """The same for the search form that keeps case."""
    return _listed(text, False)


@F.arrow_udf(ArrayType(IntegerType()))
def offsets_at(text: pa.Array, at: pa.Array) -> pa.Array:
    """``offsets`` of the characters ``at`` alone (from 0); null outside the search form."""
    texts, asked, out = text.to_pylist(), at.to_pylist(), []
    for rows, places, n in chunks(texts, True):
        for begin, count, wanted in zip(np.cumsum(n) - n, n, asked[rows], strict=True):
            out.append([int(places[begin + i]) if i is not None and 0 <= i < count else None for i in wanted or []])
    return pa.array(out, pa.list_(pa.int32()))


def with_places(pages: DataFrame, text: str, asked: str) -> DataFrame:
    """``pages`` with ``places``: ``offsets_at`` of the characters that the column ``asked`` names, or null. Pages stream through
    Python, where those that wait for an answer beside it would fill memory and then the disk."""
    schema = StructType([*pages.schema.fields, StructField("places", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = (batch.column(batch.schema.names.index(c)) for c in (text, asked))
            for begin in range(0, len(texts), 256):
                some = [w or [] for w in wanted[begin : begin + 256].to_pylist()]
                out = []
                for rows, places, n in chunks([t if w else None for t, w in zip(texts[begin : begin + 256].to_pylist(), some, strict=True)], True):
                    out += [[int(places[b + i]) if i is not None and 0 <= i < count else None for i in w] for b, count, w in zip(np.cumsum(n) - n, n, some[rows], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, 256).columns, pa.array(out, pa.list_(pa.int32()))], names=schema.names)
            del batch, texts, wanted  # before the next pages come

    return pages.mapInArrow(run, schema)


def lines_with_offsets(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines of a page with their first character's place and the line before."""
    lines = pages.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    place = Window.partitionBy(*keys).orderBy("line_no")
    start = F.coalesce(F.sum(F.length("line") + 1).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("start", start).withColumn("before", F.lag("line").over(place))


def cited_line(line: Column, before: Column) -> Column:
    """The line, with the one before when that ends in a colon and this has none."""
    return F.when(F.rtrim(before).endswith(":") & ~F.contains(line, F.lit(":")), F.concat_ws("\n", before, line)).otherwise(line)


def near_passages(texts: DataFrame, passages: DataFrame, *, least: float = 90.0, key: str = "doc_id") -> DataFrame:
    """``key, item_id, score`` of every text and passage whose likeness is at least ``least``; none is missed."""
    return near.matches(texts, passages, least=least, key=key).select(key, "item_id", "score")
