"""Secret scans: formats of credentials learnt as probabilistic automata, and every candidate scored by them.

Rules (``RULES``) find credentials that a keyword, a prefix or an alphabet gives away; these base spans always stay. The
values they find, or a table of labelled credentials, are examples of formats: their prefix tree counts where each example
goes on or ends, and states whose frequencies do not differ by a chi-square test, nor those of their followers, are merged
from the start on (the followers of a settled state among themselves, then with settled states; a merge is folded until the
automaton is deterministic). The outcome is a probabilistic automaton for each kind. Everything else that looks like a token (a
candidate: ``CANDIDATE``) is background; the character pairs of all background tokens of the corpus, counted once for each
different token, give the probability that an ordinary token reads so.

Every candidate outside a base span is scored by each automaton: its mean log-likelihood a character must reach that which
``1 - miss`` of the held-out examples reach, and its likelihood must be ``odds`` times the background's. It then is a span of
kind ``like_<kind>``, of the likeliest automaton. Candidates are scored whole, whatever their length, and once for each
different token of a block; automata and tables are bounded by ``examples``.

At most ``examples`` different examples of a kind, those of smallest hash and of at most ``longest`` characters, are learnt
from (a fifth of them held out); everything else covers all rows.

Defined results: a null text is empty and has no spans; a kind without ``fewest`` examples has no automaton, and without any
only base spans are found; repeated rows and null ids are rows of their own; an empty table gives no rows; other columns are
ignored, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Kinds in order, their patterns, the group that counts and its least length; fixed values.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
_ASSIGN = re.compile(RULES[0][1], re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(RULES[1][1])
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as the rule finds them
#: What may be a credential: a run of these characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_N = len(ALPHABET)
_CODE = np.full(128, _N, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(_N)
_BACKGROUND = "~"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``start, kind number, end, value`` of every rule's matches that are long enough, by start and kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= RULES[0][3]]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= RULES[1][3]]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """``start, end, token`` of every candidate that no base span holds."""
    at = reach = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        if end > reach:
            yield start, end, m[0]


# -- automata ----------------------------------------------------------------------------------


class Automaton(NamedTuple):
    """State 0 is the start. ``step[state, symbol]`` is the next state; the last state reads what no example has."""

    step: np.ndarray  # states x (symbols + 1)
    score: np.ndarray  # log-probability of a symbol in a state
    end: np.ndarray  # log-probability of ending in a state
    bar: float  # mean log-likelihood a character that a candidate must reach


class _Tree:
    """Prefix tree of examples with counts; ``find`` follows merged states."""

    def __init__(self, examples: list[np.ndarray]):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for word in examples:
            state = 0
            self.visits[0] += 1
            for symbol in word.tolist():
                to = self.next[state].get(symbol)
                if to is None:
                    to = self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.count[state][symbol] = self.count[state].get(symbol, 0) + 1
                state = to
                self.visits[state] += 1
            self.ends[state] += 1

    def alike(self, a: int, b: int, bar: float) -> bool:
        """Whether endings and symbols of two states, and of what follows them, may have the same probabilities.

        Each pair of states is a two-sample chi-square over symbols and the end, as a normal deviate (Wilson and Hilferty)."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            m, n = self.visits[p], self.visits[q]
            if min(m, n) < 4:  # too few to tell; what follows has fewer still
                continue
            counts = [(self.ends[p], self.ends[q])] if self.ends[p] or self.ends[q] else []
            counts += [(self.count[p].get(x, 0), self.count[q].get(x, 0)) for x in self.count[p].keys() | self.count[q].keys()]
            free = len(counts) - 1
            if free:
                square = sum((x * n - y * m) ** 2 / (x + y) for x, y in counts) / (m * n)
                if ((square / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)) > bar:
                    return False
            stack += [(self.next[p][x], self.next[q][x]) for x in self.next[p].keys() & self.next[q].keys()]
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the subtree of ``tree`` to the state ``into`` and to what follows it."""
        stack = [(into, tree)]
        while stack:
            p, q = stack.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for symbol, to in self.next[q].items():
                self.count[p][symbol] = self.count[p].get(symbol, 0) + self.count[q][symbol]
                if symbol in self.next[p]:
                    stack.append((self.next[p][symbol], to))
                else:
                    self.next[p][symbol] = to


def infer(examples: list[np.ndarray], bar: float = 3.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``step, score, end`` of the automaton of the examples (arrays of symbols): compatible states of their prefix tree merged.

    What follows a settled state is merged among itself first, the most visited first: single branches are too thin to tell
    formats apart. The outcome joins a settled state or is settled itself. ``bar`` is the deviate above which states differ.
    A symbol that a state has not seen costs its surprise and leads where the commonest one does; from a state without any it
    leads to a last state with even chances."""
    tree = _Tree(examples)
    red, held = [0], {0}
    at = 0
    while at < len(red):
        state = red[at]
        fresh = sorted((s for s, to in tree.next[state].items() if to not in held), key=lambda s: (-tree.visits[tree.next[state][s]], s))
        if not fresh:
            at += 1
            continue
        groups: list[int] = []
        for symbol in fresh:
            tried = tree.next[state][symbol]
            known = next((g for g in groups if tree.alike(g, tried, bar)), None)
            if known is None:
                groups.append(tried)
            else:
                tree.next[state][symbol] = known
                tree.fold(known, tried)
        for tried in groups:
            known = next((r for r in red if tree.alike(r, tried, bar)), None)
            if known is None:
                red.append(tried)
                held.add(tried)
                continue
            for symbol, to in tree.next[state].items():
                if to == tried:
                    tree.next[state][symbol] = known
            tree.fold(known, tried)
        at = 0  # a fold may have given settled states new followers
    place = {state: i for i, state in enumerate(red)}
    lost = len(red)
    step = np.full((lost + 1, _N + 1), lost, np.int64)
    score = np.full((lost + 1, _N + 1), -math.log(_N + 1))
    end = np.full(lost + 1, -math.log(_N + 1))
    for state, i in place.items():
        whole = tree.visits[state] + 1.0  # one visit more is shared by all that has not been seen
        score[i] = math.log(1 / whole / (_N + 2))
        if tree.count[state]:
            usual = max(tree.count[state], key=lambda x: (tree.count[state][x], -x))
            step[i] = place[tree.next[state][usual]]
        end[i] = math.log((tree.ends[state] + 1 / (_N + 2)) / whole)
        for symbol, n in tree.count[state].items():
            step[i, symbol] = place[tree.next[state][symbol]]
            score[i, symbol] = math.log((n + 1 / (_N + 2)) / whole)
    return step, score, end


def codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8) & 127]


def likelihoods(tokens: list[np.ndarray], step: np.ndarray, score: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log-likelihood of every token; all tokens move one symbol at a time."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order] if len(tokens) else sizes
    flat = np.concatenate(tokens) if len(tokens) else sizes
    alive = len(tokens) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), side="right")
    state, total = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
    for i, n in enumerate(alive.tolist()):
        symbols = flat[starts[:n] + i]
        total[:n] += score[state[:n], symbols]
        state[:n] = step[state[:n], symbols]
    out = np.empty(len(tokens))
    out[order] = total + end[state]
    return out


# -- Spark -------------------------------------------------------------------------------------


def _survey(batches: Iterator[pa.RecordBatch], room: int = 200_000) -> Iterator[tuple]:
    """Values of base spans by kind, and background tokens (each named once while the list of a task has room)."""
    seen: set[str] = set()
    for (text,) in C.rows_of(batches, ["text"]):
        base = base_spans(text or "")
        for _, kind, _, value in base:
            yield RULES[kind][0], value
        for _, _, token in candidates(text or "", base):
            if token not in seen:
                if len(seen) >= room:
                    seen.clear()
                seen.add(token)
                yield _BACKGROUND, token


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Character pairs of tokens, their start and end included, counted over a whole task."""
    counts = np.zeros((_N + 2, _N + 2), np.int64)
    for batch in batches:
        tokens = batch.column("value").to_pylist()
        edge = np.array([_N + 1])
        flat = np.concatenate([edge, *chain.from_iterable((codes(t), edge) for t in tokens)])
        np.add.at(counts, (flat[:-1], flat[1:]), 1)
    for a, b in zip(*(x.tolist() for x in np.nonzero(counts)), strict=True):
        yield a, b, int(counts[a, b])


def learn(texts: DataFrame, text: Column, *, labelled: DataFrame | None = None, examples: int = 2_000, longest: int = 512, fewest: int = 20, miss: float = 0.01, bar: float = 3.1) -> dict:
    """Automata of every kind and the background table, from the base spans of all texts.

    ``labelled`` (``kind, value``) adds credentials known from elsewhere, whose kinds may be new."""
    out = pa.schema([("kind", pa.string()), ("value", pa.string())])
    found = C.map_arrow(texts.select(text.cast("string").alias("text")), lambda b: C.emit(out, _survey(b)), "kind string, value string")
    if labelled is not None:
        found = found.unionByName(labelled.select(F.col("kind").cast("string"), F.col("value").cast("string")).where("kind is not null and value is not null"))
    seen = C.table(found.distinct(), "secrets-seen")
    sums = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    parts = C.map_arrow(seen.where(F.col("kind") == _BACKGROUND).select("value"), lambda b: C.emit(sums, _pairs(b)), "a long, b long, n long")
    pairs = np.zeros((_N + 2, _N + 2))
    for a, b, n in parts.groupBy("a", "b").agg(F.sum("n")).collect():  # at most the square of the alphabet
        pairs[a, b] = n
    pairs = pairs[:, [*range(_N + 1), _N + 1]] + 1.0
    background = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    order = F.xxhash64("value")
    kinds = sorted(r[0] for r in seen.where(F.col("kind") != _BACKGROUND).select("kind").distinct().collect())
    picked = [seen.where((F.col("kind") == k) & (F.length("value") <= longest)).orderBy(order, "value").limit(examples) for k in kinds]
    automata = {}
    if picked:
        sample = picked[0]
        for other in picked[1:]:
            sample = sample.unionByName(other)

        def fit(key: tuple, rows: pa.Table) -> pa.Table:
            words = [codes(v) for v in rows.column("value").to_pylist()]
            held = [zlib.crc32(w.tobytes()) % 5 == 0 for w in words]
            kept = [w for w, h in zip(words, held, strict=True) if not h]
            if len(words) < fewest or not kept or all(not h for h in held):
                return made.empty_table()
            step, score, end = infer(kept, bar)
            tried = [w for w, h in zip(words, held, strict=True) if h]
            rate = likelihoods(tried, step, score, end) / (np.fromiter(map(len, tried), np.int64, len(tried)) + 1)
            lowest = float(np.quantile(rate, miss))
            return pa.table([[key[0].as_py()], [len(end)], [step.tobytes()], [score.tobytes()], [end.tobytes()], [lowest]], schema=made)

        made = pa.schema([("kind", pa.string()), ("states", pa.int64()), ("step", pa.binary()), ("score", pa.binary()), ("stop", pa.binary()), ("bar", pa.float64())])
        fitted = sample.groupBy("kind").applyInArrow(fit, "kind string, states long, step binary, score binary, stop binary, bar double")
        for kind, n, step, score, stop, bar in fitted.collect():  # an automaton a kind, bounded by its examples
            shape = (n, _N + 1)
            automata[kind] = Automaton(np.frombuffer(step, np.int64).reshape(shape), np.frombuffer(score).reshape(shape), np.frombuffer(stop), bar)
    C.drop(seen)
    return {"automata": dict(sorted(automata.items())), "background": background}


def judge(tokens: list[str], model: dict, odds: float) -> list[tuple[str, float] | None]:
    """The kind whose format each token has, with its log-odds against the background, or None."""
    words = [codes(t) for t in tokens]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    edge, table = np.array([_N + 1]), model["background"]
    flat = np.concatenate([edge, *chain.from_iterable((w, edge) for w in words)])
    ordinary = np.add.reduceat(table[flat[:-1], flat[1:]], np.concatenate([[0], np.cumsum(sizes)[:-1]])) if words else np.zeros(0)
    best, kind = np.full(len(words), -np.inf), np.full(len(words), -1)
    names = list(model["automata"])
    for i, name in enumerate(names):
        a = model["automata"][name]
        like = likelihoods(words, a.step, a.score, a.end)
        better = (like / sizes >= a.bar) & (like - ordinary >= math.log(odds)) & (like > best)
        best[better], kind[better] = like[better], i
    return [None if k < 0 else (names[k], float(b - o)) for k, b, o in zip(kind.tolist(), best.tolist(), ordinary.tolist(), strict=True)]


def _spans(batches: Iterator[pa.RecordBatch], model: dict, odds: float) -> Iterator[tuple]:
    for batch in batches:
        keys, texts = batch.column("key").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        tried = [list(candidates(t, b)) for t, b in zip(texts, base, strict=True)]
        tokens = sorted({c[2] for row in tried for c in row})
        verdict = dict(zip(tokens, judge(tokens, model, odds), strict=True)) if model["automata"] else {}
        for key, known, row in zip(keys, base, tried, strict=True):
            out = [(start, kind, RULES[kind][0], end, None) for start, kind, end, _ in known]
            for start, end, token in row:
                if hit := verdict.get(token):
                    out.append((start, len(RULES), f"like_{hit[0]}", end, hit[1]))
            yield key, [{"kind": k, "start": s, "end": e, "odds": o} for s, _, k, e, o in sorted(out, key=lambda x: x[:4])]


def scan(texts: DataFrame, text: Column, key: Column, model: dict, *, odds: float = 100.0) -> DataFrame:
    """``key, spans`` for every row; a span has ``kind, start, end`` and, if learnt, its log-odds."""
    name = texts.select(key.alias("key")).dtypes[0][1]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("odds", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([("key", first.schema.field("key").type), ("spans", pa.list_(span))])
            yield from C.emit(schema, _spans(chain([first], batches), model, odds), batch=1024)

    rows = texts.select(key.alias("key"), text.cast("string").alias("text"))
    return C.map_arrow(rows, task, f"key {name}, spans array<struct<kind: string, start: long, end: long, odds: double>>")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``scan``."""
    named = [name for name, *_ in RULES]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*named))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{n}'))").cast("long").alias(f"n_{n}") for n in named]
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
