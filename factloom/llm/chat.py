"""Transcript parsing: a hidden Markov model over lines recovers roles, then turns are rendered canonically.

States: each role as a turn's first line or a later one. A line's features are the class of its speaker marker
(``marker_of``), whether it ends in a question mark, its length class and whether it is blank; given the state they count
as independent. Start, transition and feature tables are counted from transcripts whose roles are known (a partial
aggregate; the tables' size is fixed), with one added to each count. Viterbi finds the likeliest states of a
conversation; a first-line state opens a turn. Canonical form: ``<|im_start|>role``, the turn's lines, ``<|im_end|>``.
A marker goes only from a first line whose state has the role that the marker names; any other stays text. The two
tokens inside a text get a backslash (``escaped``; ``turns_from`` reads turns back), so no text forges a turn.

``transcripts_of`` writes conversations (``conv_id, turn, role, text``) as raw transcripts in one of four marker styles,
some markers left out, the roles kept beside the lines to learn from or to compare with. Rows are range-partitioned and
sorted, and runs of a conversation are cut in segments of at most ``segment`` turns, so no conversation is gathered,
however long. Segments of one conversation are decoded together: each gives its best scores from any first to any last
state (36 numbers), a pass over these finds the states at the cuts, and each segment is decoded between
them: the path is that of the whole conversation. Rendered pieces in order of ``segment`` make up the conversation.

Defined results: null texts are empty lines; null roles, and roles that are none of the three, are written as user;
a null turn sorts first, a null conv_id is a conversation; an empty transcript is one empty line, a null one has no turns;
ties in turn go by role, the text's first 32 characters and its hash; repeated rows count once; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ROLES = ("system", "user", "assistant")
#: Speaker names by class; fixed values.
NAMES = {"system": ("system", "instructions", "sys"), "user": ("user", "human", "q", "customer", "client", "me"), "assistant": ("assistant", "ai", "a", "bot", "agent", "model", "gpt")}
_CLASS = {name: i + 1 for i, role in enumerate(ROLES) for name in NAMES[role]}
_MARKER = regex.compile(r"^(?:#{1,4}\s*(?P<n>[\p{L}][\p{L} ]{0,19}?)\s*:|\[(?P<n>[\p{L}][\p{L} ]{0,19})\]|<\|(?P<n>\p{L}{1,19})\|>|(?P<n>[\p{L}][\p{L} ]{0,19}?)\s*:(?=\s|$))\s*")
#: How four styles write a role.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions: ", "user": "### Human: ", "assistant": "### AI: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "<|system|> ", "user": "Q: ", "assistant": "A: "},
)
MARKERS, ENDS, LENGTHS = 5, 2, 4


def marker_of(line: str) -> tuple[int, str]:
    """Class (0 none, 1 to 3 a role's name, 4 another speaker) and the line without its marker."""
    m = _MARKER.match(line)
    if not m:
        return 0, line
    return _CLASS.get(m["n"].strip().lower(), 4), line[m.end() :]


def features(line: str) -> tuple[int, int, int]:
    kind, rest = marker_of(line)
    bare = rest.strip()
    return kind, int(bare.endswith("?")), 0 if not bare else 1 if len(bare) < 60 else 2 if len(bare) < 200 else 3


class Hmm:
    """Six states: role times (first line, later line)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, marker: np.ndarray, end: np.ndarray, length: np.ndarray):
        def logs(counts: np.ndarray) -> np.ndarray:
            smooth = counts + 1.0
            return np.log(smooth / smooth.sum(axis=-1, keepdims=True))

        # A transcript opens with a first line, and a later line keeps its turn's role.
        self.start = logs(start)
        self.start[1::2] = -np.inf
        self.step = logs(step)
        for a in range(6):
            for r in range(3):
                if a // 2 != r:
                    self.step[a, 2 * r + 1] = -np.inf
        self.tables = (logs(marker), logs(end), logs(length))

    def scores(self, seen: list[tuple[int, int, int]]) -> np.ndarray:
        """Log probability of each line's features in each state."""
        obs = np.array(seen)
        return sum(t[:, obs[:, i]] for i, t in enumerate(self.tables)).T

    def viterbi(self, seen: list[tuple[int, int, int]], first: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states; with ``first`` and ``last``, among those that begin and end so."""
        if not seen:
            return []
        score = self.scores(seen)
        back = np.empty((len(seen), 6), np.int64)
        now = self.start + score[0]
        if first is not None:
            now = np.where(np.arange(6) == first, score[0], -np.inf)
        for i in range(1, len(seen)):
            paths = now[:, None] + self.step
            back[i] = paths.argmax(axis=0)
            now = paths[back[i], np.arange(6)] + score[i]
        states = [int(now.argmax()) if last is None else last]
        for i in range(len(seen) - 1, 0, -1):
            states.append(int(back[i][states[-1]]))
        return states[::-1]

    def transfer(self, seen: list[tuple[int, int, int]]) -> np.ndarray:
        """Best score of a path from each first state to each last state."""
        score = self.scores(seen)
        now = np.where(np.eye(6, dtype=bool), score[0], -np.inf)
        for row in score[1:]:
            now = (now[:, :, None] + self.step).max(axis=1) + row
        return now

    def cuts(self, transfers: list[np.ndarray]) -> list[tuple[int, int]]:
        """First and last state of each segment on the best path through all of them."""
        now, steps = self.start[:, None] + transfers[0], []
        ends = now.max(axis=0)
        steps.append((None, now.argmax(axis=0)))
        for t in transfers[1:]:
            into = ends[:, None] + self.step
            whole = into.max(axis=0)[:, None] + t
            steps.append((into.argmax(axis=0), whole.argmax(axis=0)))
            ends = whole.max(axis=0)
        last, out = int(ends.argmax()), []
        for into, first_of in reversed(steps):
            first = int(first_of[last])
            out.append((first, last))
            last = int(into[first]) if into is not None else last
        return out[::-1]


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """Turns of a transcript or a piece of one; a piece may begin with the rest of a turn."""
    turns: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states, strict=True):
        if s % 2 == 0:
            kind, rest = marker_of(line)
            turns.append((ROLES[s // 2], [rest if kind == s // 2 + 1 else line]))
        elif turns:
            turns[-1][1].append(line)
        else:
            turns.append((ROLES[s // 2], [line]))
    return [(role, "\n".join(own)) for role, own in turns]


_TOKEN = regex.compile(r"<(\\*)\|im_(start|end)\|>")
_ESCAPED = regex.compile(r"<\\(\\*)\|im_(start|end)\|>")
_TURN = regex.compile(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", regex.DOTALL)


def escaped(text: str) -> str:
    return _TOKEN.sub(r"<\1\\|im_\2|>", text)


def canonical(turns: list[tuple[str, str]], *, goes_on: bool = False, ends: bool = True) -> str:
    """Canonical form; a piece may go on with the turn before it or leave its last turn open."""
    out = []
    for i, (role, text) in enumerate(turns):
        out.append(("\n" if goes_on and i == 0 else f"<|im_start|>{role}\n") + escaped(text) + ("<|im_end|>\n" if ends or i < len(turns) - 1 else ""))
    return "".join(out)


def turns_from(rendered: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a canonical form."""
    return [(role, _ESCAPED.sub(r"<\1|im_\2|>", text)) for role, text in _TURN.findall(rendered)]


def _crc(*parts) -> int:
    return zlib.crc32(":".join(map(str, parts)).encode())


def _raw(conv, turns: list[tuple]) -> tuple[str, list[int]]:
    style = STYLES[_crc(conv) % len(STYLES)]
    lines, states = [], []
    for turn, role, text in turns:
        marked = not turn or _crc(conv, turn, role, text) % 6 != 0
        role = role if role in ROLES else "user"
        for i, line in enumerate((text or "").split("\n")):
            lines.append((style[role] if marked and i == 0 else "") + line)
            states.append(2 * ROLES.index(role) + (i > 0))
    return "\n".join(lines), states


_RAW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("name", pa.int64()), ("raw", pa.string()), ("states", pa.list_(pa.int32()))])
_PLACED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int64()), ("nr", pa.int64()), ("chars", pa.int64())])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place in their conversation and the characters before them, both from the task's start on."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        for (conv,), group in C.groups_of(C.rows_of(batches, ["conv_id", "turn", "role", "text"]), 1):
            chars = 0
            for nr, (_, turn, role, text) in enumerate(group):
                yield conv, turn, role, text, part, nr, chars
                chars += len(text or "")

    yield from C.emit(_PLACED, rows(), 1024)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32

    def rows() -> Iterator[tuple]:
        groups = C.groups_of(C.rows_of(batches, ["conv_id", "place", "turn", "role", "text"]), 2)
        for number, ((conv, cut), group) in enumerate(groups):
            yield conv, cut, first + number, *_raw(conv, [row[2:] for row in group])

    yield from C.emit(_RAW, rows(), 256)


def transcripts_of(conversations: DataFrame, segment: int = 128, segment_chars: int = 4_000_000) -> DataFrame:
    """``conv_id, place, name, raw, states``: raw transcripts in segments, which ``place`` orders in a conversation and ``name`` tells apart, with each line's
    true state. A segment ends where the count of turns passes a multiple of ``segment``, or that of characters one of
    ``segment_chars``, so cuts are the same however rows are dealt."""
    some = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    keyed = lambda df: df.withColumn("head", F.substring("text", 1, 32)).withColumn("tail", F.xxhash64("text"))
    width = C.width(conversations.sparkSession)
    order = ["conv_id", "turn", "role", "head", "tail"]
    spread = keyed(some).repartitionByRange(width, *order).sortWithinPartitions(*order)
    placed = C.table(spread.mapInArrow(_place, "conv_id long, turn long, role string, text string, part long, nr long, chars long"), "chat-placed")
    # A conversation goes on in later partitions only where it ends one and begins the next: at most two rows a partition.
    sums = placed.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("at")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("long"))
    wide = sums.withColumn("parts", F.count("*").over(Window.partitionBy("of"))).where("parts > 1")
    earlier = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = wide.select("of", "at", F.sum("n").over(earlier).alias("n_before"), F.sum("long").over(earlier).alias("long_before"))
    met = placed.join(F.broadcast(before), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")), "left")
    nr, chars = (F.col(c) + F.coalesce(F.col(b), F.lit(0)) for c, b in (("nr", "n_before"), ("chars", "long_before")))
    cut = F.shiftleft(F.floor(nr / segment).cast("long"), 31) + F.floor(chars / segment_chars).cast("long")
    dealt = keyed(met.select("conv_id", "turn", "role", "text", cut.alias("place"))).repartition(width, "conv_id", "place").sortWithinPartitions("conv_id", "place", *order[1:])
    return dealt.mapInArrow(_write, "conv_id long, place long, name long, raw string, states array<int>")


_COUNTS = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by table and cell: fewer than 200 rows."""
    tables = [np.zeros(6, np.int64), np.zeros(36, np.int64), np.zeros(6 * MARKERS, np.int64), np.zeros(6 * ENDS, np.int64), np.zeros(6 * LENGTHS, np.int64)]
    for raw, states in C.rows_of(batches, ["raw", "states"]):
        if not states:
            continue
        tables[0][states[0]] += 1
        for a, b in zip(states, states[1:]):
            tables[1][6 * a + b] += 1
        for line, s in zip(raw.split("\n"), states, strict=True):
            for t, f, wide in zip(tables[2:], features(line), (MARKERS, ENDS, LENGTHS), strict=True):
                t[wide * s + f] += 1
    yield from C.emit(_COUNTS, ((k, i, int(n)) for k, t in enumerate(tables) for i, n in enumerate(t) if n))


def train(transcripts: DataFrame) -> Hmm:
    """Count the tables over all given transcripts; 132 numbers reach the driver."""
    shapes = ((6,), (6, 6), (6, MARKERS), (6, ENDS), (6, LENGTHS))
    tables = [np.zeros(int(np.prod(s))) for s in shapes]
    for r in transcripts.mapInArrow(_tally, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        tables[r["kind"]][r["at"]] = r["n"]
    return Hmm(*(t.reshape(s) for t, s in zip(tables, shapes, strict=True)))


_TRANSFERS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("name", pa.int64()), ("scores", pa.binary())])
_CUTS = pa.schema([("at", pa.int64()), ("segment", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("ends", pa.bool_())])


def _transfer(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = C.rows_of(batches, ["conv_id", "place", "name", "raw"])
        yield from C.emit(_TRANSFERS, ((conv, place, name, model.transfer([features(x) for x in raw.split("\n")]).tobytes()) for conv, place, name, raw in rows))

    return run


def _cut(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in C.groups_of(C.rows_of(batches, ["conv_id", "place", "name", "scores"]), 1):
                places, transfers = [], []
                for _, _, place, scores in group:
                    places.append(place)
                    transfers.append(np.frombuffer(scores).reshape(6, 6))
                found = model.cuts(transfers)
                for i, (place, (first, last)) in enumerate(zip(places, found, strict=True)):
                    yield place, i, first, last, i + 1 == len(found) or found[i + 1][0] % 2 == 0

        yield from C.emit(_CUTS, rows())

    return run


def cut_states(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """``at, segment, first, last, ends`` for each segment of a conversation of several: its number, the states of its first and
    last line, and whether its last turn ends there. A task holds 288 bytes a segment of its conversations."""
    many = transcripts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"))
    split = transcripts.where("raw is not null").join(many, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    scored = split.mapInArrow(_transfer(model), "conv_id long, place long, name long, scores binary")
    dealt = scored.repartition(C.width(transcripts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(_cut(model), "at long, segment long, first int, last int, ends boolean")


def _parse(model: Hmm):
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_lines", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("rendered", pa.string()), ("n_right", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv, segment, first, last, ends, raw, truth in C.rows_of(batches, ["conv_id", "segment", "first", "last", "ends", "raw", "states"]):
                lines = [] if raw is None else raw.split("\n")
                states = model.viterbi([features(x) for x in lines], first, last)
                turns = turns_of(lines, states)
                goes_on = bool(states) and states[0] % 2 == 1
                right = sum(a // 2 == b // 2 for a, b in zip(states, truth or [], strict=False))
                yield conv, segment or 0, len(lines), [r for r, _ in turns], [t for _, t in turns], canonical(turns, goes_on=goes_on, ends=ends is not False), right

        yield from C.emit(schema, rows(), 256)

    return run


def parse(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """``conv_id, segment, n_lines, roles, texts, rendered, n_right`` (lines whose role is the known one) for each segment."""
    cuts = C.table(cut_states(transcripts, model), "chat-cuts")
    met = transcripts.join(cuts, F.col("name") == F.col("at"), "left").select("conv_id", "segment", "first", "last", "ends", "raw", "states")
    return met.mapInArrow(_parse(model), "conv_id long, segment long, n_lines long, roles array<string>, texts array<string>, rendered string, n_right long")


def format_chats(conversations: DataFrame, learn: Column, *, segment: int = 128) -> DataFrame:
    """Write raw transcripts of ``conversations``, learn from those where ``learn`` (over ``conv_id``) holds, parse all;
    ``held_out`` tells the others."""
    raw = C.table(transcripts_of(conversations, segment), "chat-raw")
    return parse(raw, train(raw.where(learn))).withColumn("held_out", ~F.coalesce(learn, F.lit(False)))


def whole_chats(pieces: DataFrame) -> DataFrame:
    """A row a conversation from its pieces: ``conv_id, n_segments, n_lines, n_turns, roles, rendered_sha256, held_out, n_right``.

    ``rendered_sha256`` chains the digests of the pieces in their order, so no conversation's text is gathered; a turn that
    goes on over a cut counts in its first piece."""
    goes_on = F.col("rendered").startswith("\n")
    roles = F.when(goes_on, F.slice("roles", 2, F.size("roles"))).otherwise(F.col("roles"))
    piece = pieces.select("conv_id", "segment", "n_lines", roles.alias("roles"), F.sha2("rendered", 256).alias("digest"), "held_out", "n_right")
    whole = piece.groupBy("conv_id").agg(
        F.count("*").alias("n_segments"), F.sum("n_lines").alias("n_lines"), F.sum("n_right").alias("n_right"), F.first("held_out").alias("held_out"),
        F.sort_array(F.collect_list(F.struct("segment", "roles", "digest"))).alias("p"),
    )
    all_roles = F.flatten(F.transform("p", lambda x: x["roles"]))
    chained = F.sha2(F.array_join(F.transform("p", lambda x: x["digest"]), ""), 256)
    return whole.select("conv_id", "n_segments", "n_lines", F.size(all_roles).alias("n_turns"), F.array_join(all_roles, ",").alias("roles"), chained.alias("rendered_sha256"), "held_out", "n_right")
