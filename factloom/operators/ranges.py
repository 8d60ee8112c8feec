"""Character ranges and the words under them: a sorted merge of hits with words, and a search in a row's own words.

Words of a page follow each other and do not overlap, so the words under a range are a run: from the number of words that
end by its start to the number of words that start before its end. ``words_under`` finds both numbers for all ranges of a
page in one pass over starts and ends in order; ``run_under`` finds them in a row's sorted array by bisection. A range that
only touches a word does not hold it; an empty range, or one between words, holds none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StructField, StructType

from ..functions import geometry as G
from ..functions import text as T

_WORD_ENDS, _RANGE_STARTS, _RANGE_ENDS, _WORD_STARTS = range(4)  # the order of what lies at one place


def numbered(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``words`` with ``no``, their place on the page from 0."""
    return words.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1)


def words_under(ranges: DataFrame, words: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """``keys, ids, first, stop``: the numbers of the words under each range of ``ranges`` (``keys, ids, start, end``).

    Ranges and words meet by ``keys`` alone and are merged in order of place: the work grows with both and not with their
    product, and Spark sorts a page's places with spill."""
    name = F.struct(*ids)
    nobody = F.lit(None).cast(ranges.select(name).schema[0].dataType)
    place = lambda rows, at, kind, who: rows.select(*keys, F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"), who.alias("who"))
    places = place(ranges, "start", _RANGE_STARTS, name).unionByName(place(ranges, "end", _RANGE_ENDS, name))
    places = places.unionByName(place(words, "start", _WORD_STARTS, nobody)).unionByName(place(words, "end", _WORD_ENDS, nobody))
    before = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = places.withColumns({"ended": F.count_if(F.col("kind") == _WORD_ENDS).over(before), "started": F.count_if(F.col("kind") == _WORD_STARTS).over(before)})
    runs = merged.where("who is not null").groupBy(*keys, "who").agg(F.max(F.when(F.col("kind") == _RANGE_STARTS, F.col("ended"))).alias("first"), F.max(F.when(F.col("kind") == _RANGE_ENDS, F.col("started"))).alias("stop"))
    return runs.select(*keys, "who.*", F.col("first").cast("int").alias("first"), F.greatest("first", "stop").cast("int").alias("stop"))


def boxes_under(ranges: DataFrame, words: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """``keys, ids, box``: the box around the words under each range (``words`` have ``start, end, box``); null where there are none."""
    runs = words_under(ranges, words, keys, ids)
    some = runs.where("first < stop").withColumn("no", F.explode(F.sequence("first", F.col("stop") - 1)))
    held = numbered(words, keys).where("box is not null").select(*keys, "no", "box")
    met = some.join(held, [*keys, "no"])
    edge = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    around = met.groupBy(*keys, *ids).agg(F.struct(*[f(f"box.{c}").alias(c) for c, f in edge.items()]).alias("box"))
    return ranges.select(*keys, *ids).join(around, [*keys, *ids], "left")


def form_ranges(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``words`` (``start, end, text, box``) with their places in the page's search form instead of in its text.

    The search form is the words' own forms with single spaces between; a word without one (a dropped mark) has no width and
    stands where the next one begins."""
    form = T.search_form(F.col("text"))
    sized = words.withColumn("size", F.length(form)).withColumn("wide", F.when(F.col("size") > 0, F.col("size") + 1).otherwise(F.lit(0)))
    place = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("wide").over(place), F.lit(0))
    moved = sized.withColumn("at", at)
    return moved.select(*[c for c in words.columns if c not in ("start", "end")], F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))


def page_words(pages: DataFrame) -> DataFrame:
    """``document, page, start, end, text, box`` of pages that carry their ``words``; words without a ``text`` are cut from the page's."""
    if "text" in pages.schema["words"].dataType.elementType.names:
        return pages.select("document", F.col("page").cast("int").alias("page"), F.inline("words")).select("document", "page", "start", "end", "text", "box")
    each = pages.select("document", F.col("page").cast("int").alias("page"), F.col("text").alias("_text"), F.inline("words"))
    return each.select("document", "page", "start", "end", F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "box")


def places(page: Column, quote: Column) -> Column:
    """Starts, from 0, of the quote's occurrences in the page from left to right, none overlapping the one before."""
    plain = F.concat(F.lit(r"\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.split(page, plain, -1)
    ends = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        F.array().cast("array<int>"),
        lambda out, p: F.array_append(out, F.coalesce(F.get(out, F.size(out) - 1) + F.length(quote), F.lit(0)) + F.length(p)),
    )
    return F.when((quote == "") | ~F.contains(page, quote), F.array().cast("array<int>")).otherwise(ends)


def _bisect(words: Column, before) -> Column:
    """How many of the first words of a sorted array are ``before``: each step halves what is left, 31 steps hold any array."""
    start = F.struct(F.lit(0).alias("lo"), F.size(words).alias("hi"))

    def step(x: Column, _: Column) -> Column:
        middle = F.floor((x["lo"] + x["hi"]) / 2).cast("int")
        return F.when(x["lo"] >= x["hi"], x).otherwise(
            F.when(before(F.get(words, middle)), F.struct((middle + 1).alias("lo"), x["hi"].alias("hi"))).otherwise(F.struct(x["lo"].alias("lo"), middle.alias("hi")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(words) + 1.0)).cast("int") + 1), start, step)["lo"]


def run_under(words: Column, start: Column, end: Column) -> Column:
    """The words of a sorted array (``start, end, box``) that lie under the characters ``start`` to ``end``."""
    first = _bisect(words, lambda w: w["end"] <= start)
    stop = _bisect(words, lambda w: w["start"] < end)
    return F.slice(words, first + 1, F.greatest(stop - first, F.lit(0)))


@F.arrow_udf(ArrayType(IntegerType()))
def word_starts(sizes: pa.Array) -> pa.Array:
    """Where words of these sizes start, from 0, when one character stands between two."""
    n = np.diff(sizes.offsets.to_numpy())
    wide = sizes.values.slice(sizes.offsets[0].as_py(), int(n.sum())).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    before = np.cumsum(wide) - wide
    first = np.concatenate([[0], np.cumsum(n)])
    page = np.append(before, 0)[np.minimum(first[:-1], len(before))] if len(n) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(before - np.repeat(page, n), pa.int32()))


#: Names of a page's words as arrays of plain values, which move and sort at a fraction of an array of structs.
PACKED = ("_forms", "_start", "_end", "_x0", "_y0", "_x1", "_y1")


def packed(words: str = "words", text: str | None = None, flat: bool = False) -> list[Column]:
    """The words of a page's row as ``PACKED`` arrays, ``_forms`` as one text with a line a word; ``text`` names the page's
    text where its words have none of their own. Words are an array of structs, or
    with ``flat`` one struct of arrays."""
    w = F.col(words)
    own = lambda: w["text"] if text is None else F.transform(w, lambda x: F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"]))
    cells = {"_forms": line_forms(w["lines"]) if flat else word_forms(own()), "_start": w["start"], "_end": w["end"], **{f"_{c}": w["box"][c] for c in ("x0", "y0", "x1", "y1")}}
    return [cells[c].alias(c) for c in PACKED]


#: A page's words as one struct of arrays, where a word is no struct of its own; ``lines`` are the words' texts, a line a word.
FLAT = "struct<lines: string, start: array<int>, end: array<int>, box: struct<x0: array<double>, y0: array<double>, x1: array<double>, y1: array<double>>>"
#: Characters of texts whose words are laid out at once.
_CHUNK = 250_000


def _laid(texts: list[str | None], spaces: str, box) -> pa.Array:
    cut = [re.sub(f"[{spaces}]", "\n", t.replace("\n", "\n" if "\n" in spaces else " ")) if t is not None else None for t in texts]
    sizes = [np.fromiter(map(len, t.split("\n")), np.int64) if t is not None else np.zeros(0, np.int64) for t in cut]
    n = np.array([len(x) for x in sizes], np.int64)
    size, first = np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([[0], np.cumsum(n)])
    before = np.cumsum(size + 1) - size - 1
    start = before - np.repeat(np.append(before, 0)[np.minimum(first[:-1], len(before))], n)
    end = start + size
    listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
    boxes = pa.StructArray.from_arrays([listed(v, pa.float64()) for v in box(start, end)], names=["x0", "y0", "x1", "y1"])
    return pa.StructArray.from_arrays([pa.array(cut, pa.string()), listed(start, pa.int32()), listed(end, pa.int32()), boxes], names=["lines", "start", "end", "box"])


def runs_of(sizes: list[int], least: int = _CHUNK) -> Iterator[slice]:
    """Rows in runs of about ``least`` characters."""
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= least or i + 1 == len(sizes):
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def flat_words(pages: DataFrame, names: dict[str, str], spaces: str, box) -> DataFrame:
    """``pages`` with the words of each text (``{text: name}``), cut at each one of ``spaces``, as ``FLAT``; ``box`` makes the four arrays
    of boxes from those of starts and ends. Pages stream through Python and wait nowhere."""
    schema = pages.schema
    for name in names.values():
        schema = StructType([*schema.fields, StructField(name, DataType.fromDDL(FLAT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in runs_of(pc.utf8_length(batch.column(batch.schema.names.index(next(iter(names))))).fill_null(0).to_pylist()):
                some = batch.slice(rows.start, rows.stop - rows.start)
                cells = [_laid(some.column(some.schema.names.index(text)).to_pylist(), spaces, box) for text in names]
                yield pa.RecordBatch.from_arrays([*some.columns, *cells], names=schema.names)

    return pages.mapInArrow(run, schema)


def word_forms(texts: Column) -> Column:
    """Words folded at once, a line a word; ``forms_of`` closes their white space."""
    apart = F.array_join(F.transform(texts, lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(" "))), "\n", "")
    return line_forms(F.when(F.contains(F.array_join(texts, "", ""), F.lit("\n")), apart).otherwise(F.array_join(texts, "\n", "")))


def line_forms(lines: Column) -> Column:
    return T.let(lines, lambda lines: F.lower(T.fold(lines)))


def forms_of(lines: str | None) -> list[str]:
    """The words' search forms from ``word_forms`` (Python's white space is that of the search form)."""
    words = (lines or "").split("\n")
    return words if words == (lines or "").split() else [" ".join(w.split()) for w in words]


def packed_words(words: str = "words", text: str | None = None) -> list[Column]:
    """What ``boxed_hits`` takes of a page's words; ``text`` as in ``packed``."""
    lines, start, end = packed(words, text)[:3]
    return [lines, start, end, F.transform(F.col(words)["box"], lambda b: b.isNotNull())]


def _places_in(page: str, quote: str) -> list[int]:
    """``places`` of a quote that is not empty."""
    out, at = [], page.find(quote)
    while at >= 0:
        out.append(at)
        at = page.find(quote, at + len(quote))
    return out


def _boxed_groups(page: str, asked: list, words: list[str], at: np.ndarray, to: np.ndarray, held: np.ndarray) -> list[bool]:
    """Whether a place of one of each group's quotes has a word that is ``held`` under it; ``words`` are search forms."""
    size = np.fromiter(map(len, words), np.int64, len(held))
    if (np.diff(at) < 0).any() or (np.diff(to) < 0).any():
        order = np.lexsort((to, at))
        size, held = size[order], held[order]
    wide = np.where(size > 0, size + 1, 0)
    start = np.cumsum(wide) - wide
    end, seen = start + size, np.concatenate([[0], np.cumsum(held)])

    def some(quote: str) -> bool:
        hit = np.array(_places_in(page, quote), np.int64)
        first, stop = np.searchsorted(end, hit, "right"), np.searchsorted(start, hit + len(quote), "left")
        return bool((seen[np.maximum(first, stop)] > seen[first]).any())

    return [any(map(some, group or [])) for group in asked]


@F.arrow_udf(ArrayType(BooleanType()))
def boxed_hits(form: pa.Array, quotes: pa.Array, lines: pa.Array, starts: pa.Array, ends: pa.Array, boxed: pa.Array) -> pa.Array:
    """For each list of ``quotes`` of a page whether a place of one of them in the page's search ``form`` has a word with a box
    under it. Words come as ``word_forms`` (``lines``), their places in the text and whether they are ``boxed``."""
    out = []
    for row, (page, asked, text, held) in enumerate(zip(form.to_pylist(), quotes.to_pylist(), lines.to_pylist(), boxed, strict=True)):
        held = np.zeros(0, bool) if held.values is None else held.values.to_numpy(zero_copy_only=False).astype(bool)
        if page is None or asked is None or not held.any() or not any(asked):
            out.append(None if asked is None else [False] * len(asked))
            continue
        at, to = (c[row].values.to_numpy(zero_copy_only=False) for c in (starts, ends))
        out.append(_boxed_groups(page, asked, forms_of(text), at, to, held))
    return pa.array(out, pa.list_(pa.bool_()))


def flat_hits(pages: DataFrame, ids: Sequence[str], form: str = "form", quotes: str = "quotes", words: str = "words") -> DataFrame:
    """``ids, quotes, boxed``: ``boxed_hits`` of pages with ``FLAT`` words, where only these columns leave Python, so that no page
    waits for its answer. A word has a box where its ``x0`` is not null."""
    w = F.col(words)
    asked = pages.select(*ids, quotes, F.col(form).alias("_form"), line_forms(w["lines"]).alias("_lines"), w["start"].alias("_at"), w["end"].alias("_to"), w["box"]["x0"].alias("_x0"))
    kept = [*ids, quotes]
    schema = StructType([*asked.select(*kept).schema.fields, StructField("boxed", ArrayType(BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, forms, lines, at, to, x0 = (batch.column(batch.schema.names.index(c)) for c in (quotes, "_form", "_lines", "_at", "_to", "_x0"))
            out = []
            for row, cell in enumerate(batch.column(len(ids))):
                groups, page, held = cell.as_py(), forms[row].as_py(), x0[row].values
                if groups is None or page is None or not any(groups) or held is None or held.null_count == len(held):
                    out.append(None if groups is None else [False] * len(groups))
                    continue
                places = (c[row].values.to_numpy(zero_copy_only=False) for c in (at, to))
                out.append(_boxed_groups(page, groups, forms_of(lines[row].as_py()), *places, held.is_valid().to_numpy(zero_copy_only=False)))
            cells = [*batch.columns[: len(kept)], pa.array(out, pa.list_(pa.bool_()))]
            del batch, forms, lines, at, to, x0  # before the next pages come
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return asked.mapInArrow(run, schema)


def flat_box(words: Column, start: Column, end: Column) -> Column:
    """The box around the ``FLAT`` words under the characters ``start`` to ``end``, or null."""

    def around(x: Column) -> Column:
        cut = lambda c: F.slice(words["box"][c], x["first"] + 1, F.greatest(x["stop"] - x["first"], F.lit(0)))
        return F.when(x["stop"] > x["first"], G.box(F.array_min(cut("x0")), F.array_min(cut("y0")), F.array_max(cut("x1")), F.array_max(cut("y1"))))

    return T.let(F.struct(_bisect(words["end"], lambda e: e <= start).alias("first"), _bisect(words["start"], lambda s: s < end).alias("stop")), around)


def packed_under(start: Column, end: Column) -> Column:
    """The words (``start, end, box``) of a ``packed`` page that lie under the characters ``start`` to ``end``."""
    first = _bisect(F.col("_end"), lambda e: e <= start)
    stop = _bisect(F.col("_start"), lambda s: s < end)

    def cut(x: Column) -> Column:
        at = lambda c, i: F.get(F.col(c), x["first"] + i)
        some = F.slice("_start", x["first"] + 1, F.greatest(x["stop"] - x["first"], F.lit(0)))
        return F.transform(some, lambda s, i: F.struct(s.alias("start"), at("_end", i).alias("end"), G.box(*[at(c, i) for c in PACKED[3:]]).alias("box")))

    return T.let(F.struct(first.alias("first"), stop.alias("stop")), cut)


def packed_box(start: Column, end: Column) -> Column:
    """The box around the words of a ``packed`` page under the characters ``start`` to ``end``, or null."""
    return T.let(packed_under(start, end), lambda run: G.union(F.transform(run, lambda w: w["box"])))


def box_under(words: Column, start: Column, end: Column) -> Column:
    """The box around the words under the characters ``start`` to ``end``, or null."""
    return T.let(run_under(words, start, end), lambda run: G.union(F.transform(run, lambda w: w["box"])))
