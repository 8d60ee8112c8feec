"""Alignment of two text layers of a page, to find a span of one again on the other.

Runs of ``n`` words whose search forms stand once on each layer's page pair up as anchors. Of a page's pairs, in order on one
layer, the longest chain that is in order on the other too is kept, so that a run that was moved does not mislead. A span lies
between two anchors; on the other layer it lies between their partners, and there the words in the window likest its text are taken (of equal windows, that at its place).
A page's words stay in its row: the two layers of a page meet once, as packed arrays, and no word is a row of its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions import text as T
from . import near, ranges, search

PAGE = ["document", "page"]
#: Likeness under which nothing between two anchors counts as the span.
LEAST = 60.0


def longest_chain(values: list[int]) -> list[int]:
    """Places of the longest increasing subsequence (of equally long ones, that with the smallest values)."""
    tails: list[int] = []
    held: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        back.append(held[at - 1] if at else -1)
        if at == len(tails):
            tails.append(v)
            held.append(i)
        else:
            tails[at], held[at] = v, i
    out, i = [], held[-1] if held else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


#: What anchors need of a page's words.
_WORDS = ranges.PACKED[:3]
_ANCHOR = ("start", "end", "other_start", "other_end")


def _packed(pages: DataFrame) -> list[Column]:
    own = "text" in pages.schema["words"].dataType.elementType.names
    return ranges.packed(text=None if own else "text")


def _in_order(lines: str | None, start: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A page's words that have a form, by place, with their starts and ends."""
    words = ranges.forms_of(lines)
    order = range(len(words))
    if (np.diff(start) <= 0).any():
        order = sorted(order, key=lambda i: (start[i], end[i], words[i]))
    elif all(words):
        return words, start, end
    held = [i for i in order if words[i]]
    return [words[i] for i in held], start[held], end[held]


def _once(words: list[str], n: int) -> dict[str, int]:
    """Runs of ``n`` words that stand once among these, with the number of their first word, in order."""
    runs = list(map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    last = dict(zip(runs, range(len(runs)), strict=True))
    if len(last) < len(runs):
        for run in {run for i, run in enumerate(runs) if last[run] != i}:
            del last[run]
    return last


def _paired(here: tuple, there: tuple, n: int) -> np.ndarray:
    """The anchors of a page, a column each of ``_ANCHOR``; a layer is its words' forms, starts and ends."""
    if any(cell is None or not len(cell) for cell in (here[1], there[1])):
        return np.zeros((0, 4), np.int64)
    (words, start, end), (other, other_start, other_end) = _in_order(*here), _in_order(*there)
    own, found = _once(words, n), _once(other, n)
    at = np.fromiter(own.values(), np.int64, len(own))
    to = np.fromiter(map(found.get, own, repeat(-1)), np.int64, len(own))
    at, to = at[to >= 0], to[to >= 0]
    pairs = np.stack([start[at], end[at + n - 1], other_start[to], other_end[to + n - 1]], axis=1).astype(np.int64)
    if (np.diff(pairs[:, 0]) <= 0).any():
        pairs = pairs[np.lexsort(pairs.T[::-1])]
    return pairs if (np.diff(pairs[:, 2]) > 0).all() else pairs[longest_chain(pairs[:, 2].tolist())]


def _cells(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The arrays of a column of integer lists."""
    whole, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i, held in enumerate(column.is_valid().to_pylist()):
        yield whole[ends[i] : ends[i + 1]] if held else None


def _each(column: pa.Array) -> Iterator:
    """The values of a column one at a time, so that they are not all held."""
    return (cell.as_py() for cell in column)


def _layers(lines: pa.Array, start: pa.Array, end: pa.Array, other: pa.Array, other_start: pa.Array, other_end: pa.Array) -> Iterator[tuple[tuple, tuple]]:
    here, there = zip(_each(lines), _cells(start), _cells(end), strict=True), zip(_each(other), _cells(other_start), _cells(other_end), strict=True)
    return zip(here, there, strict=True)


def _anchors(n: int):
    schema = StructType()
    for name in _ANCHOR:
        schema.add(name, ArrayType(IntegerType()))

    @F.arrow_udf(schema)
    def paired(lines: pa.Array, start: pa.Array, end: pa.Array, other: pa.Array, other_start: pa.Array, other_end: pa.Array) -> pa.Array:
        pages = [_paired(here, there, n) for here, there in _layers(lines, start, end, other, other_start, other_end)]
        ends = pa.array(np.cumsum([0, *map(len, pages)]), pa.int32())
        whole = np.concatenate([np.zeros((0, 4), np.int64), *pages])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(whole[:, i], pa.int32())) for i in range(4)], names=list(_ANCHOR))

    return paired


_STRETCH = ("low", "high", "hint")


def _stretch(held: np.ndarray, size: int | None, start: int | None, end: int | None) -> tuple[int, int | None, int | None]:
    """Where the characters ``start`` to ``end`` lie on the other layer: from the last anchor that begins by then to the first
    that ends no earlier; and the place there that is as far from the first as the span is here."""
    last = -1 if start is None else int(np.searchsorted(held[:, 0], start, "right")) - 1
    after = 0 if end is None else int((held[:, 1] < end).sum())
    low, begin = (int(held[last, 2]), int(held[last, 0])) if last >= 0 else (0, 0)
    return low, int(held[after, 3]) if after < len(held) else size, None if start is None else start - begin


def _stretches(met: DataFrame, n: int) -> DataFrame:
    """``_p, _span``, the stretch of the other layer's text that may hold the span (``_part, low, high, hint``) and its words
    (``ranges.PACKED`` but the forms). Pages stream through Python, and only this leaves it."""
    kept = ranges.PACKED[1:]
    fields = {f.name: f.dataType for f in met.schema.fields}
    out = StructType().add("_p", fields["_p"]).add("_span", fields["_spans"].elementType).add("_part", StringType())
    for name in _STRETCH:
        out.add(name, IntegerType())
    for name in kept:
        out.add(name, fields[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            layers = _layers(*[col[f"_h{w}"] for w in _WORDS], *[col[w] for w in _WORDS])
            first = col["_start"].offsets.to_numpy()
            owner, parts, cells, picks, sizes = [], [], [], [np.zeros(0, np.int64)], [0]
            for row, ((here, there), body, starts, stops) in enumerate(zip(layers, _each(col["_body"]), _each(col["_first"]), _each(col["_stop"]), strict=True)):
                held = _paired(here, there, n) if starts else None
                for s, e in zip(starts or [], stops or [], strict=True):
                    low, high, hint = _stretch(held, None if body is None else len(body), s, e)
                    a, b = (0, 0) if there[1] is None or high is None else (int(np.searchsorted(there[2], low, "right")), int(np.searchsorted(there[1], high, "left")))
                    owner.append(row)
                    parts.append(None if body is None or high is None else body[low : max(low, high)])
                    cells.append((low, high, hint))
                    picks.append(first[row] + np.arange(a, max(a, b)))
                    sizes.append(max(a, b) - a)
            pick, ends = pa.array(np.concatenate(picks)), pa.array(np.cumsum(sizes), pa.int32())
            around = [pa.ListArray.from_arrays(ends, col[name].values.take(pick)) for name in kept]
            stretch = [pa.array([c[i] for c in cells], pa.int32()) for i in range(3)]
            found = [col["_p"].take(pa.array(owner, pa.int64())), pa.concat_arrays([col["_spans"].flatten()]), pa.array(parts, pa.string()), *stretch, *around]
            del batch, col, layers, parts  # before the next pages come
            yield pa.RecordBatch.from_arrays(found, names=out.names)

    return met.mapInArrow(run, out)


@F.arrow_udf(StructType().add("score", DoubleType()).add("low", IntegerType()).add("high", IntegerType()))
def _likest(part: pa.Array, form: pa.Array, quote: pa.Array, hint: pa.Array) -> pa.Array:
    """The window of a part's search form that is likest a quote, by the part's own characters."""
    found = [near.likest_at(p, q, h or 0) for p, q, h in zip(form.to_pylist(), quote.to_pylist(), hint.to_pylist(), strict=True)]
    cells = []
    for rows, places, n in search.chunks(part.to_pylist(), True):
        for begin, count, (score, start, end) in zip(np.cumsum(n) - n, n, found[rows], strict=True):
            low = int(places[begin + start]) if start < count else None
            cells.append({"score": score, "low": low, "high": int(places[begin + end - 1]) + 1 if 0 < end <= count else None})
    return pa.array(cells, pa.struct([("score", pa.float64()), ("low", pa.int32()), ("high", pa.int32())]))


def anchors(layer: DataFrame, other: DataFrame, n: int = 2) -> DataFrame:
    """``document, page, anchors``: arrays of characters (``start, end`` here, ``other_start, other_end`` there), in order on both.

    Both layers have ``document, page, text, words``. A page without anchors is not there."""
    side = lambda pages, name: pages.select("document", F.col("page").cast("int").alias("page"), *[c.alias(f"{name}{w}") for w, c in zip(_WORDS, _packed(pages), strict=False)])
    met = side(layer, "a").join(side(other, "b"), PAGE)
    found = met.select(*PAGE, _anchors(n)(*[F.col(f"{name}{w}") for name in "ab" for w in _WORDS]).alias("anchors"))
    return found.where(F.size("anchors.start") > 0)


def carry(spans: DataFrame, layer: DataFrame, other: DataFrame, least: float = LEAST, n: int = 2) -> DataFrame:
    """``spans`` (``document, page, char_start, char_end, text`` and others) with ``there``: the span on the other layer as a struct of
    ``page, text, char_start, char_end, box, score``, or null where nothing there is like enough."""
    # A page's spans meet its two layers in one row, once; only pages with spans do.
    asked = spans.groupBy(*PAGE).agg(F.collect_list(F.struct(*spans.columns)).alias("_spans"))
    held = [F.col("document").alias("_d"), F.col("page").cast("int").alias("_p"), F.col("text").alias("_body")]
    there = other.select(*held, *_packed(other))
    here = layer.select(F.col("document").alias("_hd"), F.col("page").cast("int").alias("_hp"), *_here(_packed(layer)))
    met = asked.join(there, (F.col("document") == F.col("_d")) & (F.col("page") == F.col("_p")), "left")
    met = met.join(here, (F.col("document") == F.col("_hd")) & (F.col("page") == F.col("_hp")), "left")
    return _carried(met, least, n).select(*spans.columns, "there")


def carry_rows(rows: DataFrame, least: float = LEAST, n: int = 2) -> DataFrame:
    """As ``carry`` where a row holds a page on both layers, so that nothing moves: ``document, page, spans`` (an array of
    ``char_start, char_end, text`` and others), ``words`` here and ``other_text, other_words`` there, words with their ``text`` or ``ranges.FLAT``.
    ``document, page``, the fields of a span and ``there``."""
    flat = lambda c: isinstance(rows.schema[c].dataType, StructType)
    named = F.transform("spans", lambda s: F.struct(F.col("document"), F.col("page"), s.alias("_s")))
    met = rows.select(F.col("page").cast("int").alias("_p"), F.col("other_text").alias("_body"), *ranges.packed("other_words", flat=flat("other_words")), *_here(ranges.packed("words", flat=flat("words"))), named.alias("_spans"))
    fields = rows.schema["spans"].dataType.elementType.names
    return _carried(met, least, n, fields).select(*PAGE, *fields, "there")


def _here(words: list[Column]) -> list[Column]:
    return [c.alias(f"_h{name}") for name, c in zip(_WORDS, words, strict=False)]


def _carried(met: DataFrame, least: float, n: int, fields: list[str] | None = None) -> DataFrame:
    """The spans of each row (``_spans``), found between the anchors of its two layers."""
    at = lambda name: F.transform("_spans", lambda s: (s["_s"] if fields else s)[name].cast("int"))
    asked = met.select("_p", "_body", *ranges.PACKED, *[f"_h{name}" for name in _WORDS], "_spans", at("char_start").alias("_first"), at("char_end").alias("_stop"))
    met = _stretches(asked, n)
    met = met.select("*", *[F.col("_span._s")[f].alias(f) for f in fields], "_span.document", "_span.page") if fields else met.select("*", "_span.*")
    met = met.withColumn("_near", _likest(F.col("_part"), T.search_form(F.col("_part")), T.search_form(F.col("text")), F.col("hint")))
    met = met.withColumns({"_low": F.col("_near.low") + F.col("low"), "_high": F.col("_near.high") + F.col("low")})
    # The window is as long as the quote; the span is the words that lie in it by half or more.
    inside = F.filter(
        ranges.packed_under(F.col("_low"), F.col("_high")),
        lambda w: 2 * (F.least(w["end"], F.col("_high")) - F.greatest(w["start"], F.col("_low"))) >= w["end"] - w["start"],
    )
    met = met.withColumn("_run", inside).withColumns({"_low": F.get("_run", 0)["start"], "_high": F.get("_run", F.size("_run") - 1)["end"]})
    text = F.substring(F.col("_part"), F.col("_low") - F.col("low") + 1, F.col("_high") - F.col("_low"))
    box = ranges.packed_box(F.col("_low"), F.col("_high"))
    found = F.struct(F.col("_p").alias("page"), text.alias("text"), F.col("_low").alias("char_start"), F.col("_high").alias("char_end"), box.alias("box"), F.col("_near.score").alias("score"))
    return met.withColumn("there", F.when((F.col("_near.score") >= least) & F.col("_low").isNotNull(), found))
