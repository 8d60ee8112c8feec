"""Near matches: the best window of a text for a quote, complete at a threshold.

The likeness of two texts is 200 times their longest common subsequence over the sum of their lengths. A quote's score on a
page is that of the best stretch of the page as long as the quote, or of a shorter stretch at the page's start or end; a page
shorter than the quote changes places with it. The subsequence is found by bit vectors, and since shifting a window by
one character changes it by one at most, windows that cannot beat the best are skipped: the score is exact.

A score of ``least`` allows ``edits = 2 m (1 - least / 100)`` characters of a quote of m to be missing or added. Cut in more
pieces than that, at least ``pieces - edits`` of them stand unchanged in the window, at places that the edits shift by no
more than their number. ``flagged`` tests a page's own quotes with string containment on overlapping blocks, and only blocks
that hold enough pieces are compared. ``matches`` serves quotes against all texts: pieces are an index by hash, every
place of a text that holds a piece votes for a band of starts, each as often as it occurs, and bands with enough votes are
compared. Neither can miss a score of ``least``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..functions import text as T


class _Quote:
    """A text whose common subsequences with others are asked for: its bits by character."""

    def __init__(self, text: str):
        self.size, self.full = len(text), (1 << len(text)) - 1
        self.bits: dict[str, int] = defaultdict(int)
        for i, ch in enumerate(text):
            self.bits[ch] |= 1 << i

    def common(self, other: str) -> int:
        """Length of the longest common subsequence, a bit vector step for each character."""
        free, bits = self.full, self.bits
        for ch in other:
            hit = free & bits.get(ch, 0)
            free = ((free + hit) | (free - hit)) & self.full
        return self.size - free.bit_count()


def likest(page: str | None, quote: str | None, least: float = 0.0, head: bool = True, tail: bool = True, swap: bool = True) -> tuple[float, int, int]:
    """Score of the best window of a page, and the window; ``head`` and ``tail`` tell whether the page's own ends are there.

    With ``least`` only scores from there on are sure to be exact; a lower one comes out as 0. A page shorter than the quote
    changes places with it unless ``swap`` is false; then its stretches at either end, itself included, are the windows."""
    if not page or not quote:
        return 0.0, 0, 0
    at = page.find(quote)
    if at >= 0:
        return 100.0, at, at + len(quote)
    if len(page) < len(quote) and swap:
        score, _, _ = likest(quote, page, least)
        return (score, 0, len(page)) if score else (0.0, 0, 0)
    own, m, n = _Quote(quote), len(quote), len(page)
    best, window = least - 1e-9, (0, 0)

    def needed(wide: int) -> int:
        """The least common length with which a window of that width beats the best."""
        return int(best * (m + wide) / 200) + 1

    i = 0
    while i + m <= n:
        held = own.common(page[i : i + m])
        score = 100.0 * held / m
        if score > best:
            best, window = score, (i, i + m)
        i += max(1, needed(m) - held)
    for ends in (True, False):  # shorter stretches at the ends
        wide = min(m - 1, n) if (head if ends else tail) else 0
        while wide > 0 and 200.0 * wide / (m + wide) > best:
            cut = (0, wide) if ends else (n - wide, n)
            held = own.common(page[cut[0] : cut[1]])
            score = 200.0 * held / (m + wide)
            if score > best:
                best, window = score, cut
            wide -= max(1, needed(wide) - held) if needed(wide) > held else 1
    return (best, *window) if window[1] else (0.0, 0, 0)


def likest_at(page: str | None, quote: str | None, hint: int) -> tuple[float, int, int]:
    """As ``likest``, and of windows as long as the quote that score the same the one whose start is nearest to ``hint``."""
    score, start, end = likest(page, quote)
    if not score or end - start != len(quote) or start == hint:
        return score, start, end
    own, m = _Quote(quote), len(quote)
    held = round(score * m / 100)
    reach = abs(start - hint)
    for way in (-1, 1):
        i = min(max(hint, 0), len(page) - m)
        while 0 <= i <= len(page) - m and abs(i - hint) < reach:
            lack = held - own.common(page[i : i + m])
            if not lack:
                start, reach = i, abs(i - hint)
                break
            i += way * lack
    return score, start, start + m


@F.pandas_udf(DoubleType())
def partial_ratio(page: pd.Series, quote: pd.Series) -> pd.Series:
    """Diagnostic likeness 0 to 100 of a quote with its best window of a page; never decides a score."""
    return pd.Series([likest(p, q)[0] for p, q in zip(page, quote, strict=True)], dtype="float64")


@F.pandas_udf(StructType().add("score", DoubleType()).add("start", IntegerType()).add("end", IntegerType()))
def likest_window(page: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """The window of a page that is likest a quote; score 0 for a missing or empty text."""
    return pd.DataFrame([likest(p, q) for p, q in zip(page, quote, strict=True)], columns=["score", "start", "end"])


def edits(size: int, least: float) -> int:
    """Characters that may be missing or added in a window of score ``least``."""
    return int(2 * size * (100 - least) / 100 + 1e-9)


def _sure(size: Column, least: float) -> tuple[Column, Column]:
    """Width of a quote's pieces and how many of them a window of score ``least`` holds unchanged."""
    lost = F.floor(2 * size * (100 - least) / 100 + 1e-9).cast("int")
    wide = F.floor(size / (lost + 1)).cast("int")
    return wide, F.floor(size / wide).cast("int") - lost


# -- a page's own quotes -------------------------------------------------------------------------


def blocks(form: Column, wide: Column) -> Column:
    """Overlapping blocks (``at, text``) of a text such that a window of ``wide`` characters lies whole in one of them.

    The text is cut once from left to right, and each block is two neighbouring cuts: the work grows with the text."""
    cuts = F.regexp_extract_all(form, F.concat(F.lit("(?s).{1,"), wide.cast("string"), F.lit("}")), F.lit(0))

    def paired(c: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0)))
        return F.transform(steps, lambda i: F.struct((i * wide).cast("int").alias("at"), F.concat(F.coalesce(F.get(c, i), F.lit("")), F.coalesce(F.get(c, i + 1), F.lit(""))).alias("text")))

    return T.let(cuts, paired)


def held_pieces(block: Column, quote: Column, wide: Column) -> Column:
    """How many of the quote's pieces stand in the block."""
    starts = F.sequence(F.lit(0), F.floor(F.length(quote) / wide).cast("int") - 1)
    return F.size(F.filter(F.transform(starts, lambda i: F.substring(quote, (i * wide + 1).cast("int"), wide)), lambda p: F.contains(block, p)))


def best_of(pairs: DataFrame, ids: list[str], least: float) -> DataFrame:
    """``ids, score, start, end`` of pairs (``ids, form, quote``) that reach ``least``; a quote that stands verbatim has 100.

    Blocks that hold too few pieces of the quote are left out on the JVM; the others go to Python as they are, never a
    whole page that is longer than twice the quote."""
    size = F.length("quote")
    wide, sure = _sure(size, least)
    asked = pairs.where("quote <> '' and form <> ''").withColumns({"wide": wide, "sure": sure})
    exact = F.contains("form", F.col("quote"))
    at = (F.position(F.col("quote"), F.col("form")) - 1).cast("int")
    verbatim = asked.where(exact).select(*ids, F.lit(100.0).alias("score"), at.alias("start"), (at + size).cast("int").alias("end"))
    cut = asked.where(~exact).select(*ids, "quote", "wide", "sure", F.length("form").alias("n"), F.inline(blocks(F.col("form"), F.greatest(size, F.lit(16)))))
    short = F.col("n") < size
    enough = cut.where(short | (held_pieces(F.col("text"), F.col("quote"), F.col("wide")) >= F.col("sure")))
    last = F.col("at") + F.length("text") >= F.col("n")
    found = enough.withColumn("b", _best_in(F.col("text"), F.col("quote"), F.col("at") == 0, last, F.lit(float(least)))).where(F.col("b.score") >= least - 1e-9)
    near = found.select(*ids, F.col("b.score").alias("score"), (F.col("b.start") + F.col("at")).alias("start"), (F.col("b.end") + F.col("at")).alias("end"))
    top = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"))).alias("b")
    return verbatim.unionByName(near.groupBy(*ids).agg(top).select(*ids, "b.*"))


@F.pandas_udf(StructType().add("score", DoubleType()).add("start", IntegerType()).add("end", IntegerType()))
def _best_in(block: pd.Series, quote: pd.Series, head: pd.Series, tail: pd.Series, least: pd.Series) -> pd.DataFrame:
    rows = [likest(b, q, x, h, t) for b, q, h, t, x in zip(block, quote, head, tail, least, strict=True)]
    return pd.DataFrame(rows, columns=["score", "start", "end"])


# -- quotes against all texts ----------------------------------------------------------------------


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, wide: int) -> np.ndarray:
    """A hash of each stretch of ``wide`` characters."""
    out = np.zeros(max(len(codes) - wide + 1, 0), np.uint64)
    if not len(out):
        return out
    with np.errstate(over="ignore"):
        for i in range(wide):
            out = out * _PRIME + codes[i : len(codes) - wide + 1 + i]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class _Index:
    """Pieces of all quotes by width and hash."""

    def __init__(self, quotes: list[str], least: float):
        self.quotes, self.least = quotes, least
        self.sizes = np.array([len(q) for q in quotes], np.int64)
        self.edits = np.array([edits(len(q), least) for q in quotes], np.int64)
        wide = self.sizes // (self.edits + 1)
        self.sure = self.sizes // wide - self.edits
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, q in enumerate(quotes):
            w, codes = int(wide[i]), _codes(q)
            for shift, h in zip(range(0, len(q) - w + 1, w), _hashes(codes, w)[::w].tolist(), strict=False):
                pieces[w].append((h, i, shift))
        self.parts = {}
        for w, rows in pieces.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            distinct, starts = np.unique(keys, return_index=True)
            seen = np.zeros(1 << 20, bool)  # most places of a text end here
            seen[distinct >> np.uint64(44)] = True
            self.parts[w] = (seen, distinct, np.append(starts, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def candidates(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``quote, low, high``: bands of starts where enough pieces may stand."""
        codes = _codes(text)
        whose, where = [], []
        for w, (seen, distinct, starts, owner, shift) in self.parts.items():
            h = _hashes(codes, w)
            at = np.flatnonzero(seen[h >> np.uint64(44)])
            slot = np.minimum(np.searchsorted(distinct, h[at]), len(distinct) - 1)
            same = distinct[slot] == h[at]
            at, slot = at[same], slot[same]
            if not len(at):
                continue
            n = starts[slot + 1] - starts[slot]
            pick = np.repeat(starts[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            whose.append(owner[pick])
            where.append(np.repeat(at, n) - shift[pick])
        if not whose:
            return
        who, start = np.concatenate(whose), np.concatenate(where)
        # Bands of twice the width overlap by half, so starts that lie ``edits`` apart share one.
        stride = self.edits[who] + 1
        band = start // stride
        key = np.concatenate([who, who]) * (1 << 40) + np.concatenate([band, band - 1]) + (1 << 39)
        keys, votes = np.unique(key, return_counts=True)
        owner = keys >> 40
        for k in np.flatnonzero(votes >= self.sure[owner]).tolist():
            i = int(owner[k])
            low = int((keys[k] & ((1 << 40) - 1)) - (1 << 39)) * int(self.edits[i] + 1)
            yield i, low, low + 2 * int(self.edits[i] + 1)


def _search(index: _Index, texts: Iterator[tuple[object, str]]) -> Iterator[tuple]:
    for key, text in texts:
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, low, high in index.candidates(text):
            slack, m = int(index.edits[i]), int(index.sizes[i])
            begin, end = max(0, min(low - slack, len(text) - m)), min(len(text), max(high + slack, 0) + m)
            held = spans[i]
            if held and begin <= held[-1][1] - m:
                held[-1] = (held[-1][0], max(held[-1][1], end))
            elif begin < end:
                held.append((begin, end))
        for i, held in spans.items():
            found = max((likest(text[b:e], index.quotes[i], index.least, b == 0, e == len(text), swap=False) + (b,) for b, e in held), key=lambda x: (x[0], -x[1] - x[3]))
            if found[0] >= index.least - 1e-9:
                yield key, i, found[0], found[1] + found[3], found[2] + found[3]


def matches(texts: DataFrame, quotes: DataFrame, *, least: float = 90.0, key: str = "doc_id", item: str = "item_id", part_chars: int = 2_000_000) -> DataFrame:
    """``key, item, score, start, end`` of every text and quote whose score is at least ``least`` (places in the search form).

    The quotes' index is built in the tasks from parts of at most ``part_chars`` characters, each of which reads the texts
    once more. A quote longer than a text is compared with the text and its ends, and not the text with the quote's windows. The lower
    ``least``, the shorter the pieces and the more places are compared."""
    if not 50 <= least <= 100:
        raise ValueError("a likeness between 50 and 100 can be searched for")
    asked = quotes.select(F.col(item).alias("item"), T.search_form(F.col("text")).alias("quote")).where("quote <> ''")
    kinds = dict(texts.dtypes)[key], dict(asked.dtypes)["item"]
    forms = texts.select(F.col(key).alias("key"), T.search_form(F.col("text")).alias("form")).where("form <> ''")
    schema = f"key {kinds[0]}, item {kinds[1]}, score double, start int, end int"
    parts = asked.agg(F.coalesce(F.sum(F.length("quote")), F.lit(0))).first()[0] // part_chars + 1
    out = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("quote"), F.lit(parts)) == part).groupBy("quote").agg(F.collect_list("item").alias("items"))
        rows = [(r["quote"], r["items"]) for r in some.collect()]
        if rows:
            hits = forms.mapInArrow(_task([q for q, _ in rows], [i for _, i in rows], least), schema)
            out = hits if out is None else out.unionByName(hits)
    found = texts.sparkSession.createDataFrame([], schema) if out is None else out
    return found.withColumnsRenamed({"key": key, "item": item})


def _task(quotes: list[str], items: list[list], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or _Index(quotes, least)
            keys, forms = batch.column(0), batch.column(1).to_pylist()
            found = list(_search(index, enumerate(forms)))
            rows = [(n, item, s, b, e) for n, i, s, b, e in found for item in items[i]]
            if rows:
                at, item, score, start, end = zip(*rows, strict=True)
                cells = [keys.take(pa.array(at)), pa.array(item), pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                yield pa.RecordBatch.from_arrays(cells, names=["key", "item", "score", "start", "end"])

    return run
