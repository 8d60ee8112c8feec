"""Periodic runs of words: Main-Lorentz divide and conquer over interned word ids.

A run is a stretch of consecutive words with smallest period q and at least ``max(least, times * q)`` words (``times`` is 4
or more) that no neighbouring word extends with period q. The words of a block of texts are numbered and stand in one
array, each text followed by a number of its own, so that no repetition passes from one text to the next. The array is
halved again and again; all segments of one level are one matrix, and its columns meet the two words at the middle of
their row. A run that crosses a middle holds 2q words on one side of it, so the two words beside the middle recur q words
away on that side: only such distances are followed. Where there are any, Z-functions give how far words and their
copies agree from the middle forwards and backwards: the stretch is ``q`` plus both. The Z-functions visit only places
that hold the first word (all others are 0), and skip over what they know: their work grows with the segment, not with
its repetitions. A stretch that could go on beyond its segment belongs to a segment above, where its whole length is seen;
of equal intervals the smallest period stays.

Each task takes its rows in blocks of at most ``block_words`` words, or one longer text; nothing is shuffled.

Defined results: a null or empty text has no words and no runs; repeated rows and null ids are rows of their own; an empty
table gives no rows; other columns are ignored, whatever their names. Words are split at ASCII white space only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_FEW = 16  # distances of a segment up to which words are compared directly


def z_function(s: np.ndarray) -> np.ndarray:
    """Of each place, how many words from there on agree with the start; work in proportion to places with the first word."""
    n = len(s)
    z = np.zeros(n, np.int64)
    if not n:
        return z
    z[0] = n
    left = right = 0
    for i in np.flatnonzero(s[1:] == s[0]) + 1:
        i = int(i)
        known = min(int(z[i - left]), right - i) if i < right else 0
        if known == right - i or i >= right:
            known = max(known, 0)
            known += agree(s, known, s, i + known)
            left, right = i, i + known
        z[i] = known
    return z


def agree(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many words agree from ``a[i]`` and ``b[j]`` on, compared in pieces of growing length."""
    most, at, piece = min(len(a) - i, len(b) - j), 0, 8
    while at < most:
        piece = min(piece, most - at)
        same = a[i + at : i + at + piece] == b[j + at : j + at + piece]
        if not same.all():
            return at + int(same.argmin())
        at += piece
        piece *= 4
    return at


def _candidates(s: np.ndarray, size: int, times: int) -> Iterator[tuple[int, bool, int]]:
    """``(segment, before, q)``: the two words at the middle recur q words before it or behind it, and q is small enough."""
    rows, half, most = len(s) // size, size // 2, size // times
    if not rows or not most:
        return
    table = s[: rows * size].reshape(rows, size)
    middle, last = table[:, half : half + 1], table[:, half - 1 : half]
    for before in (True, False):
        at = half - most if before else half + 1
        found = (table[:, at : at + most] == middle) & (table[:, at - 1 : at - 1 + most] == last)
        for row, column in zip(*(x.tolist() for x in np.nonzero(found)), strict=True):
            yield row, before, most - column if before else column + 1


def runs_of(s: np.ndarray, longest: int, least: int = 6, times: int = 4) -> np.ndarray:
    """``start, end, period`` of every run of ``s``, in order of start and period; no run is longer than ``longest``."""
    if times < 4:
        raise ValueError("runs repeat their period four times or more")
    n = len(s)
    found: dict[tuple[int, int], int] = {}
    size = 4
    while True:
        size *= 2
        padded = s
        if n % size:  # the last segment is filled with numbers that occur nowhere else
            padded = np.concatenate([s, -np.arange(1, size - n % size + 1, dtype=s.dtype) - n - 1])
        by_segment: dict[int, list[tuple[bool, int]]] = {}
        for row, before, q in _candidates(padded, size, times):
            by_segment.setdefault(row, []).append((before, q))
        for row, tried in by_segment.items():
            begin, end = row * size, min((row + 1) * size, n)
            middle = begin + size // 2
            if middle >= n:
                continue
            for start, stop, q in _stretches(s[begin:end], middle - begin, tried):
                start, stop = start + begin, stop + begin
                if stop - start < max(least, times * q) or (start > 0 and s[start - 1] == s[start - 1 + q]) or (stop < n and s[stop] == s[stop - q]):
                    continue
                found[start, stop] = min(q, found.get((start, stop), q))
        if size >= 2 * longest and size >= n or size >= 2 * n:
            break
    out = sorted((start, q, stop) for (start, stop), q in found.items())
    return np.array(out, np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _depths(x: np.ndarray, y: np.ndarray, places: list[int]) -> list[int]:
    """How many words of ``y`` from each place on agree with the start of ``x``: the Z-function there, directly where places are few."""
    if len(places) <= _FEW:
        return [agree(x, 0, y, i) for i in places]
    mark = np.array([min(x.min(), y.min()) - 1], x.dtype)
    z = z_function(np.concatenate([x, mark, y]))
    return z[np.array(places) + len(x) + 1].tolist()


def _stretches(s: np.ndarray, m: int, tried: list[tuple[bool, int]]) -> Iterator[tuple[int, int, int]]:
    """The stretches of period q across the middle ``m`` that hold q words before it (or behind it)."""
    ahead, behind, turned, n = s[m:], s[:m][::-1], s[::-1], len(s)

    def across(before: bool, qs: list[int]) -> list[tuple[int, int, int]]:
        places = [m - q if before else m + q for q in qs]
        on, back = _depths(ahead, s, places), _depths(behind, turned, [n - i for i in places])
        return [(min(m, i) - b, max(m, i) + a, q) for i, q, a, b in zip(places, qs, on, back, strict=True)]

    for before in (True, False):
        left = sorted(q for side, q in tried if side == before)
        if len(left) > _FEW:  # if the smallest repeats, its multiples within that stretch give the same one
            start, stop, q = across(before, left[:1])[0]
            yield start, stop, q
            again = stop - start >= 2 * q
            left = [x for x in left[1:] if not (again and x % q == 0 and (m - x > start if before else m + x < stop))]
        yield from across(before, left)


def _found(batches: Iterator[pa.RecordBatch], block_words: int, least: int, times: int, edit) -> Iterator[tuple]:
    held: list[tuple] = []
    size = 0
    for key, text in C.rows_of(batches, ["key", "text"]):
        words = (text or "").encode().split()
        held.append((key, words))
        size += len(words) + 1
        if size >= block_words:
            yield from _block(held, least, times, edit)
            held, size = [], 0
    if held:
        yield from _block(held, least, times, edit)


def _block(held: list[tuple], least: int, times: int, edit) -> Iterator[tuple]:
    """Runs of each text of a block, and its words that stay."""
    numbers, parts, named = C.numbering(), [], []
    for i, (key, words) in enumerate(held):
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        parts += [edit(key, ids) if edit else ids, np.array([-1 - i], np.int64)]
        named.append(len(ids))
    s = np.concatenate(parts)
    runs = runs_of(s, max(named), least, times)
    names = list(numbers)
    ends = np.cumsum([n + 1 for n in named])
    cuts = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
    for i, (key, _) in enumerate(held):
        at = int(ends[i]) - named[i] - 1
        mine = runs[cuts[i] : cuts[i + 1]]
        depth = np.zeros(named[i] + 1, np.int64)
        np.add.at(depth, mine[:, 0] + mine[:, 2] - at, 1)
        np.add.at(depth, mine[:, 1] - at, -1)
        kept = s[at : at + named[i]][np.cumsum(depth)[:-1] == 0]
        listed = [{"start": a - at, "length": b - a, "period": q} for a, b, q in mine.tolist()]
        yield key, named[i], listed, b" ".join([names[w] for w in kept.tolist()]).decode()


def find_runs(
    texts: DataFrame, text: Column, key: Column, *, least: int = 6, times: int = 4, block_words: int = 500_000, edit: Callable[[object, np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """``key, n_words, runs, collapsed`` for every row: ``runs`` are ``start, length, period`` in order of start and period, and
    ``collapsed`` has the words that no run holds after its first period, joined by a space.

    ``edit`` may change a text's word numbers (given its key) before the search, to words of the same text."""
    name = texts.select(key.alias("key")).dtypes[0][1]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("key", first.schema.field("key").type), ("n_words", pa.int64()), ("runs", pa.list_(kind)), ("collapsed", pa.string())])
        yield from C.emit(schema, _found(itertools.chain([first], batches), block_words, least, times, edit), batch=1024)

    rows = texts.select(key.alias("key"), text.cast("string").alias("text"))
    return C.map_arrow(rows, task, f"key {name}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeat_tail(key: object, ids: np.ndarray) -> np.ndarray:
    """The contract's fault: where h = crc32(key) is divisible by 10, words from h // 10 % n on repeat the first p of them."""
    import zlib

    n = len(ids)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = ids.copy()
    out[a:] = ids[a + np.arange(n - a) % p]
    return out


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``find_runs``: the longest run (ties: smallest start, then period) and two digests."""
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    rows = found.withColumn("top", F.array_min(ranked))
    most = {"start": F.col("top.start"), "length": F.col("top.length"), "period": F.col("top.period")}
    share = F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("long")
    return rows.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[c.alias(name) for name, c in most.items()],
        share.alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) g(i)
), split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, xor(list_reduce(
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]),
    4294967295::BIGINT), 4294967295::BIGINT) AS h FROM documents, crc
), tails AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) ELSE len(words) END AS a FROM split
), edited AS (
  SELECT row, doc_id, n, CASE WHEN a = n THEN words ELSE list_transform(range(0, n),
    lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS words FROM tails
), w AS (
  SELECT row, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM edited
), same AS (  -- every place whose word stands q words before it too
  SELECT b.row, b.i, b.i - a.i AS q FROM w a JOIN w b ON a.row = b.row AND a.word = b.word AND a.i < b.i AND (b.i - a.i) * 4 <= b.n
), stretch AS (
  SELECT row, q, min(i) - q AS start, max(i) + 1 AS stop
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS part FROM same) GROUP BY row, q, part
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT row, start, stop - start AS length, min(q) AS period FROM stretch GROUP BY row, start, stop
), top AS (
  SELECT row, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, {'a': -length, 'b': start, 'c': period}) AS r,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY row
), gone AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT row, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM w ANTI JOIN gone USING (row, i) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.l AS length, r.p AS period, (1000 * r.l // r.p)::BIGINT AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM edited LEFT JOIN top USING (row) LEFT JOIN kept USING (row)
"""
