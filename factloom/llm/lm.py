"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Restaurants: the root (over all words, above a uniform base on the V known words and one unknown) and one for each
context word seen in training; tokens after a word that training lacks share the root. The symbol for a text's end also
stands before its first word.
In each restaurant customers sit at tables by the Chinese-restaurant process; a table is a customer of the root.

Data flow (texts never cross the network; blocks of documents exchange sorted lists with word shards):
1. Blocks of texts keep distinct words and tokens as positions; word lists with training counts go to the words' shards.
2. Shards sum the counts (N, V, each word's number) and answer each block.
3. Blocks send their (context, word) pairs with training counts to the words' shards. All pairs of a word, and so all
   its tables, meet in one shard; lists are summed per block first, so a frequent pair is one entry a block.
4. Gibbs sweeps: every shard re-seats each dish's customers given all else; between sweeps the tables of each restaurant
   are summed in its context word's shard, which answers each shard with the sums it uses. A restaurant's customers are
   its word's training count. Seatings and sums are written tables; the driver holds a few totals.
5. Shards answer blocks with the root's probability and the restaurant's tables of each word in every kept sample, and
   each pair's count and tables; blocks average the samples' predictive probabilities and sum logarithms per document.

Discounts come from the counts of counts of each level (``n1 / (n1 + 2 n2)``). From 64 customers of a dish on,
seating goes in steps of an eighth with a binomial number of new tables. Results depend on seed and shard number only.
Seatings that no kept sample needs are deleted as soon as the next one is written.

Defined results: null and empty texts are one end token; repeated rows are texts of their own; a null id learns (its
fold is null, hence not held out); other columns are ignored; with no training token every probability is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .bpe import by_count, pack_ranks, unpack_ranks

END = b"\n"
_KINDS = "block long, shard int, kind int, a binary, b binary, c binary, d binary"
_ROWS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in "abcd")])
#: kinds: 0 a block's documents, 1 words of a block, 2 a shard's dictionary, 3 a shard's pairs, 4 a block's pairs, 5 a
#: seating, 6 its sums, 7 its tables by context, 8 the answers to those, 9 all tables of a shard's contexts


def _words(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def _blocks(shards: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def close(number: int, words: dict, docs: list, places: list) -> Iterator[tuple]:
            block = part << 32 | number
            coded = list(words)
            places_all = np.concatenate(places)
            lengths = np.fromiter(map(len, places), np.int64, len(places))
            train = np.fromiter((not held for _, held in docs), bool, len(docs))
            counts = np.bincount(places_all[np.repeat(train, lengths)], minlength=len(coded))
            shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in coded), np.int64, len(coded))
            order = C.by_shard(coded, shard)
            to = np.empty(len(coded), np.uint32)
            to[order] = np.arange(len(coded), dtype=np.uint32)
            seen = np.bincount(to[places_all], minlength=len(coded))
            missing = np.fromiter((d is None for d, _ in docs), np.int64, len(docs))
            ids = np.fromiter((0 if d is None else d for d, _ in docs), np.int64, len(docs))
            end = np.array([to[words[END]]], np.int64)
            yield block, -1, 0, C.pack_array(np.stack([ids, missing, train.astype(np.int64), lengths])), pack_ranks(by_count(seen)[1][to[places_all]]), C.pack_uints(seen), end.tobytes()
            at = 0
            for s, n in enumerate(np.bincount(shard, minlength=shards).tolist()):
                if n:
                    own = order[at : at + n]
                    yield block, s, 1, C.pack_words([coded[i] for i in own]), C.pack_uints(counts[own]), None, None
                    at += n

        def rows() -> Iterator[tuple]:
            number, chars, words, docs, places = 0, 0, C.numbering(), [], []
            for doc, held, text in C.rows_of(batches, ["doc_id", "held_out", "text"]):
                if docs and chars + len(text or "") > block_chars:
                    yield from close(number, words, docs, places)
                    number, chars, words, docs, places = number + 1, 0, C.numbering(), [], []
                found = _words(text)
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                docs.append((doc, held))
                chars += len(text or "")
            if docs:
                yield from close(number, words, docs, places)

        yield from C.emit(_ROWS, rows(), 64)

    return run


class Keys:
    """Numbers of words over all shards, and of (word, context) pairs within the word's shard."""

    def __init__(self, shards: int, width: int):
        if shards * width * width >= 1 << 63:
            raise ValueError("dictionaries are too wide for pair numbers: more shuffle partitions make them smaller")
        self.width, self.words = width, shards * width

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(keys, self.words)


def _count():
    """A shard's rows: sums its words' counts over blocks, answers each block with counts and word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            asked, counts = [], {}
            shard = None
            for block, shard, a, b in C.rows_of(batches, ["block", "shard", "a", "b"]):
                asked.append((block, a))
                for w, n in zip(C.unpack_words(a), C.unpack_uints(b).tolist(), strict=True):
                    counts[w] = counts.get(w, 0) + n
            if shard is None:
                return
            ordered = sorted(counts)
            number = {w: i for i, w in enumerate(ordered)}
            total = np.fromiter((counts[w] for w in ordered), np.int64, len(ordered))
            for block, a in asked:
                own = np.fromiter((number[w] for w in C.unpack_words(a)), np.int64)
                yield block, shard, 1, C.pack_uints(total[own]), C.pack_uints(np.diff(own, prepend=0)), None, None
            mass, ones, twos = int(total.sum()), int((total == 1).sum()), int((total == 2).sum())
            yield -1, shard, 2, C.pack_uints(total), np.array([mass, int((total > 0).sum()), ones, twos, len(total)], np.int64).tobytes(), None, None

        yield from C.emit(_ROWS, rows(), 256)

    return run


class _Block:
    """A block's tokens with what its shards answered; the same steps give the same pair order each time."""

    def __init__(self, head: tuple, answers: list[tuple], keys: Keys, least: float):
        _, _, _, a, b, c, d = head
        self.ids, self.missing, self.train, self.lengths = C.unpack_array(a, np.int64).reshape(4, -1)
        self.tokens = by_count(C.unpack_uints(c))[0][unpack_ranks(b)]
        end = int(np.frombuffer(d, np.int64)[0])
        self.asked = [s for s, _, _ in answers]
        counts = [C.unpack_uints(x) for _, x, _ in answers]
        own = [np.cumsum(C.unpack_uints(x)) for _, _, x in answers]
        self.sizes = [len(x) for x in own]
        self.count, self.number = np.concatenate(counts), np.concatenate(own)
        self.shard = np.repeat(np.array(self.asked, np.int64), self.sizes)
        firsts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[firsts] = end
        self.in_train = np.repeat(self.train.astype(bool), self.lengths)
        self.some = np.flatnonzero(self.count[before] >= least)
        self.before = before[self.some]
        # Words are in order of shard and number, and so are pairs.
        pairs, self.pair = np.unique(self.tokens[self.some].astype(np.int64) << 32 | self.before, return_inverse=True)
        w, u = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_shard = self.shard[w]
        self.pairs = self.number[w] * keys.words + self.shard[u] * keys.width + self.number[u]

    def messages(self, block: int) -> Iterator[tuple]:
        """Per shard: pair keys as differences, their training counts, and the block's word numbers."""
        seen = np.bincount(self.pair[self.in_train[self.some]], minlength=len(self.pairs))
        cuts = np.searchsorted(self.pair_shard, np.array(self.asked, np.int64))
        ends = [*cuts[1:].tolist(), len(self.pairs)]
        at = 0
        for s, i, j, n in zip(self.asked, cuts.tolist(), ends, self.sizes, strict=True):
            yield block, s, 4, C.pack_uints(np.diff(self.pairs[i:j], prepend=0)), C.pack_uints(seen[i:j]), C.pack_uints(np.diff(self.number[at : at + n], prepend=0)), None
            at += n


def _gathered(batches: Iterator[pa.RecordBatch], keys: Keys, least: float) -> Iterator[tuple[int, _Block, list]]:
    """Blocks with their rows sorted by kind and shard: documents, count answers, then pair answers."""
    for (block,), group in C.groups_of(C.rows_of(batches, _ROWS.names), 1):
        head = next(group)
        answers, rest = [], []
        for r in group:
            if r[2] == 1:
                answers.append((r[1], r[3], r[4]))
            else:
                rest.append(r)
        yield block, _Block(head, answers, keys, least), rest


def _pairs(keys: Keys, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from C.emit(_ROWS, (m for block, b, _ in _gathered(batches, keys, least) for m in b.messages(block)), 64)

    return run


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers; ``weight`` is a new table's mass, ``(theta + d T) P``.

    The first 64 customers are seated one by one, then an eighth of those seated at a time, by one binomial draw at the
    chance of the step's middle: mean table counts stay within 1 % of seating all one by one (tested up to 100,000)."""
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    c, w, t = customers[order], weight[order], tables[order]
    top = int(c[0]) if len(c) else 0
    more = lambda n: len(c) - int(np.searchsorted(c[::-1], n, side="right"))  # dishes of more than n customers
    for n in range(1, min(top, 64)):
        m = more(n)
        new = w[:m] / (w[:m] + n - discount * t[:m])
        t[:m] += rng.random(m) < new
    low = 64
    while low < top:
        m = more(low)
        span = np.minimum(low + low // 8, c[:m]) - low
        # The chance at the step's middle, with the tables that the first half is expected to add.
        held = t[:m] + span / 2 * w[:m] / (w[:m] + low - discount * t[:m])
        new = w[:m] / (w[:m] + low + span / 2 - discount * held)
        t[:m] += rng.binomial(span, np.clip(new, 0, 1))
        low += low // 8
    tables[order] = t
    return tables


class State:
    """What all shards share: sizes, discounts and the root's totals."""

    def __init__(self, n: int, v: int, root_discount: float, discount: float = 0.5):
        self.n, self.v, self.d0, self.d, self.theta = n, v, root_discount, discount, 1.0
        self.root_customers, self.root_tables = float(n), 0.0

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        base = (self.theta + self.d0 * self.root_tables) / (self.v + 1)
        return (np.maximum(customers - self.d0 * tables, 0) + base) / (self.theta + self.root_customers)

    def unknown(self) -> float:
        return float(self.root(np.zeros(1), np.zeros(1))[0])


def _discount(ones: float, twos: float) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def _by_context(shard: int, context: np.ndarray, tables: np.ndarray, keys: Keys) -> Iterator[tuple]:
    """A shard's tables of each context, to the contexts' shards: kind 7 rows ``numbers, tables`` that name the sender."""
    used, place = np.unique(context, return_inverse=True)
    own = np.bincount(place, tables, len(used)).astype(np.int64)
    at = used // keys.width
    for to in np.unique(at).tolist():
        i, j = np.searchsorted(at, [to, to + 1]).tolist()
        yield to, 7, C.pack_uints(np.diff(used[i:j] - to * keys.width, prepend=0)), C.pack_uints(own[i:j]), None, None, None, shard


def _sum_contexts():
    """Kind 7 rows summed per context: answers to each sender in its order (kind 8), and all sums of the shard (kind 9)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            asked, sums, shard = [], np.zeros(0, np.int64), None
            for shard, a, b, sender in C.rows_of(batches, ["shard", "a", "b", "sender"]):
                at = np.cumsum(C.unpack_uints(a))
                asked.append((sender, at))
                if at[-1] >= len(sums):
                    sums = np.pad(sums, (0, int(at[-1]) + 1 - len(sums)))
                sums[at] += C.unpack_uints(b)
            if shard is None:
                return
            for sender, at in asked:
                yield sender, 8, C.pack_uints(sums[at]), None, None, None, None, shard
            yield shard, 9, C.pack_uints(sums), None, None, None, None, shard

        yield from C.emit(_SEATED, rows(), 64)

    return run


def _merge(pair_keys: Keys):
    """A shard's pair lists from all blocks summed: kind 3 row ``keys, counts, dictionary``; every pair starts with one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            keys, counts, total, shard = [np.empty(0, np.int64)], [np.empty(0, np.int64)], None, None
            for shard, kind, a, b in C.rows_of(batches, ["shard", "kind", "a", "b"]):
                if kind == 2:
                    total = a
                else:
                    k, n = np.cumsum(C.unpack_uints(a)), C.unpack_uints(b)
                    keys.append(k[n > 0])
                    counts.append(n[n > 0])
            if shard is None:
                return
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)
            one = np.ones(len(n), np.int64)
            yield shard, 3, C.pack_uints(np.diff(found, prepend=0)), C.pack_uints(n), None, total, None, shard
            yield shard, 6, None, None, np.array([n.sum(), len(n), (n == 1).sum(), (n == 2).sum()], np.int64).tobytes(), None, None, shard
            yield from _by_context(shard, pair_keys.split(found)[1], one, pair_keys)

        yield from C.emit(_SEATED, rows(), 64)

    return run


_SEAT_COLUMNS = "shard int, kind int, a binary, b binary, c binary, d binary, e binary, sender int"
_SEATED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in "abcde"), ("sender", pa.int32())])


def _sweep(state: State, seed: int, sweep: int, pair_keys: Keys):
    """One Gibbs sweep of a shard: contexts' dishes given the root, then the root's dishes given the base.

    Rows come by shard and kind: the pairs (3), the seating before if any (5), the contexts' sums by sender (8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (shard,), group in C.groups_of(C.rows_of(batches, ["shard", "kind", "a", "b", "c", "d", "e"]), 1):
                _, _, a, b, _, d, _ = next(group)
                counts, total = C.unpack_uints(b), C.unpack_uints(d)
                tables, e, sums = np.ones(len(counts), np.int64), None, [np.empty(0, np.int64)]
                for _, kind, answer, _, c, _, last in group:
                    if kind == 5:
                        tables, e = C.unpack_uints(c), last
                    else:
                        sums.append(C.unpack_uints(answer))
                rng = np.random.default_rng([seed, shard, sweep])
                word, context = pair_keys.split(np.cumsum(C.unpack_uints(a)))
                held = np.concatenate(sums)[np.unique(context, return_inverse=True)[1]]
                direct = total - np.bincount(word, counts, len(total)).astype(np.int64)
                root_customers = direct + np.bincount(word, tables, len(total)).astype(np.int64)
                root_tables = C.unpack_uints(e) if e else np.minimum(root_customers, 1)
                p = state.root(root_customers, root_tables)
                tables = seat(counts, (state.theta + state.d * held) * p[word], state.d, rng)
                root_customers = direct + np.bincount(word, tables, len(total)).astype(np.int64)
                base = (state.theta + state.d0 * state.root_tables) / (state.v + 1)
                root_tables = seat(root_customers, np.full(len(total), base), state.d0, rng)
                yield shard, 5, None, None, C.pack_uints(tables), None, C.pack_uints(root_tables), shard
                yield shard, 6, None, None, np.array([root_customers.sum(), root_tables.sum()], np.int64).tobytes(), None, None, shard
                yield from _by_context(shard, context, tables, pair_keys)

        yield from C.emit(_SEATED, rows(), 64)

    return run


def _answer(pair_keys: Keys):
    """A shard's pairs, its kept seatings and contexts' tables (kinds 3, then 5 and 9 in sample order) answer the blocks' messages (kind 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            keys, counts, tables, root, held = None, None, [], [], []
            for block, shard, kind, a, b, c, d, e in C.rows_of(batches, ["block", "shard", "kind", "a", "b", "c", "d", "e"]):
                if kind == 3:
                    keys, counts, total = np.cumsum(C.unpack_uints(a)), C.unpack_uints(b), C.unpack_uints(d)
                    word = pair_keys.split(keys)[0]
                    direct = total - np.bincount(word, counts, len(total)).astype(np.int64)
                    sums = np.zeros(len(keys), np.int64)
                elif kind == 5:
                    t = C.unpack_uints(c)
                    sums += t
                    root.append((direct + np.bincount(word, t, len(total)).astype(np.int64), C.unpack_uints(e)))
                    held.append(np.zeros(len(total), np.int64))
                elif kind == 9:
                    own = C.unpack_uints(a)
                    held[-1][: len(own)] = own
                else:
                    asked, words = np.cumsum(C.unpack_uints(a)), np.cumsum(C.unpack_uints(c))
                    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                    hit = (keys[at] == asked) if len(keys) else np.zeros(len(asked), bool)
                    n = np.where(hit, counts[at], 0) if len(keys) else np.zeros(len(asked), np.int64)
                    t = np.where(hit, sums[at], 0) if len(keys) else np.zeros(len(asked), np.int64)
                    yield block, shard, 4, C.pack_uints(n), C.pack_uints(t), C.pack_uints(np.concatenate([x[words] for pair in root for x in pair])), C.pack_uints(np.concatenate([x[words] for x in held]))

        yield from C.emit(_ROWS, rows(), 256)

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(states: list[State], keys: Keys, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = states[0]

        def rows() -> Iterator[tuple]:
            for _, b, rest in _gathered(batches, keys, least):
                n = np.concatenate([C.unpack_uints(r[3]) for r in rest])
                t = np.concatenate([C.unpack_uints(r[4]) for r in rest])
                root = np.concatenate([C.unpack_uints(r[5]).reshape(2 * len(states), -1) for r in rest], axis=1)
                probs = np.stack([s.root(root[2 * i], root[2 * i + 1]) for i, s in enumerate(states)])
                held = np.concatenate([C.unpack_uints(r[6]).reshape(len(states), -1) for r in rest], axis=1)
                known = b.count > 0
                for i, s in enumerate(states):
                    probs[i][~known] = s.unknown()
                base = np.log10((b.count + 1.0) / (first.n + (first.v + 1.0)))[b.tokens]
                p = probs.mean(axis=0)[b.tokens]
                u = b.before
                room = first.theta + b.count[u]
                shared = np.zeros(len(u))
                for i, s in enumerate(states):
                    shared += (s.theta + s.d * held[i][u]) * probs[i][b.tokens[b.some]]
                p[b.some] = (np.maximum(n[b.pair] - first.d * t[b.pair] / len(states), 0) + shared / len(states)) / room
                log = np.log10(p)
                firsts = np.cumsum(b.lengths) - b.lengths
                sums = zip(b.ids.tolist(), b.missing.tolist(), b.train.tolist(), b.lengths.tolist(), np.add.reduceat(known[b.tokens].astype(np.int64), firsts).tolist(), np.add.reduceat(base, firsts).tolist(), np.add.reduceat(log, firsts).tolist(), strict=True)
                for doc, gone, train, long, hits, base_sum, log_sum in sums:
                    yield None if gone else doc, not train, long, hits, first.n, base_sum, log_sum

        yield from C.emit(_SCORES, rows())

    return run


def score(docs: DataFrame, held_out: Column, *, contexts: int | None = None, sweeps: int = 3, kept: int = 2, block_chars: int = 12_000_000, shard_bytes: int = 16 << 20, seed: int = 5) -> DataFrame:
    """Score every whole text; learns from rows where ``held_out`` (over ``doc_id``) is not true.

    With ``contexts``, only words of at least ``1 / contexts`` of the training tokens get a restaurant. Words are dealt
    over a shard for each ``shard_bytes`` of text, at most the session's shuffle partitions.
    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    if not 0 < kept <= sweeps:
        raise ValueError("kept samples are at most the sweeps")
    spark = docs.sparkSession
    wide = C.width(spark)
    three = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    shards = min(wide, 1 + (three.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes)
    blocks = C.table(three.mapInArrow(_blocks(shards, block_chars), _KINDS), "lm-blocks")
    counted = C.table(blocks.where("kind = 1").repartitionById(shards, F.col("shard")).mapInArrow(_count(), _KINDS), "lm-counts")
    sums, width = np.zeros(4, np.int64), 1
    for r in counted.where("kind = 2").select("b").collect():  # five numbers a shard
        *four, words = np.frombuffer(bytes(r["b"]), np.int64).tolist()
        sums, width = sums + four, max(width, words)
    n, v, ones, twos = sums.tolist()
    least = max(1.0, n / contexts) if contexts else 1.0
    keys = Keys(shards, width)
    answers = counted.where("kind = 1")
    heads = blocks.where("kind = 0")
    meet = heads.unionByName(answers).repartitionById(wide, C.block_place(wide)).sortWithinPartitions("block", "kind", "shard")
    messages = C.table(meet.mapInArrow(_pairs(keys, least), _KINDS), "lm-pairs")
    inputs = messages.select("shard", "kind", "a", "b").unionByName(counted.where("kind = 2").select("shard", "kind", "a", "b"))
    start = C.table(inputs.repartitionById(shards, F.col("shard")).mapInArrow(_merge(keys), _SEAT_COLUMNS), "lm-start")
    pairs_of = start.where("kind = 3")

    def summed(seats: DataFrame) -> DataFrame:
        return C.table(seats.where("kind = 7").repartitionById(shards, F.col("shard")).mapInArrow(_sum_contexts(), _SEAT_COLUMNS), "lm-sums")

    tables = summed(start)
    counts = np.zeros(4, np.int64)
    for r in start.where("kind = 6").select("c").collect():  # four numbers a shard
        counts += np.frombuffer(bytes(r["c"]), np.int64)
    customers, pairs, ones_of_pairs, twos_of_pairs = counts.tolist()
    state = State(n, v, _discount(ones, twos), _discount(ones_of_pairs, twos_of_pairs))
    state.root_customers, state.root_tables = float(n - customers + pairs), float(v)
    states, samples, seating = [], [pairs_of.select(F.lit(-sweeps - 1).cast("long").alias("block"), "shard", "kind", "a", "b", "c", "d", "e")], None
    for sweep in range(sweeps):
        both = pairs_of.unionByName(tables.where("kind = 8"))
        if seating is not None:
            both = both.unionByName(seating.where("kind = 5"))
        seats = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "sender")
        last, seating = (seating, tables), C.table(seats.mapInArrow(_sweep(state, seed, sweep, keys), _SEAT_COLUMNS), "lm-seating")
        tables = summed(seating)
        if sweep <= sweeps - kept:  # no kept sample reads what came before this sweep
            for old in last:
                if old is not None:
                    C.drop(old)
        now = State(n, v, state.d0, state.d)
        root = np.zeros(2, np.int64)
        for r in seating.where("kind = 6").select("c").collect():
            root += np.frombuffer(bytes(r["c"]), np.int64)
        now.root_customers, now.root_tables = map(float, root)
        state = now
        if sweep >= sweeps - kept:
            states.append(state)
            own = seating.where("kind = 5").unionByName(tables.where("kind = 9"))
            samples.append(own.select(F.lit(sweep - sweeps).cast("long").alias("block"), "shard", "kind", "a", "b", "c", "d", "e"))
    asked = messages.withColumn("e", F.lit(None).cast("binary"))
    for s in samples:
        asked = asked.unionByName(s)
    # Negative block numbers put a shard's pairs and seatings, in sample order, before the blocks that ask.
    replies = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block", "kind").mapInArrow(_answer(keys), _KINDS)
    final = heads.unionByName(answers).unionByName(replies).repartitionById(wide, C.block_place(wide)).sortWithinPartitions("block", "kind", "shard")
    out = final.mapInArrow(_finish(states, keys, least), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
