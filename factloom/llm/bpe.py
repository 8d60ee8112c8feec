"""Byte-level BPE over a corpus: a global distinct-word shuffle.

1. Each input partition splits its texts into pre-tokens (pattern of the vocabulary) and keeps, per block
   of documents, the distinct words and every document's pre-tokens as positions into them.
2. The blocks' distinct words are dealt by word hash over ``shards``; there each distinct word is merged
   by ranks once, whatever number of blocks asks for it, and its ids go back to the asking blocks.
3. Blocks and answers meet by block number; ids are gathered by position, and decoding joins the ids with the
   token-byte table, an Arrow gather over the fixed vocabulary (about 50 thousand rows, shipped to the executors).

A word crosses the network once per block that holds it, however often it occurs; a frequent word has as many
requests as there are blocks, so no key is hot. Blocks are bounded by ``block_chars`` (one longer text is a
block of its own). What is shipped in closures is the rank file, of fixed size.

Defined results: null and empty texts have no tokens (digests of the empty string); repeated rows and repeated
ids give one output row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Unicode white space under the pattern's \s and \S.
_SPACES = ((r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]"), (r"\s", r"\p{White_Space}"), (r"\S", r"\P{White_Space}"))


def splitter(pattern: str):
    for a, b in _SPACES:
        pattern = pattern.replace(a, b)
    return regex.compile(pattern)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merger(ranks: dict[bytes, int], pattern: str):
    """Function from a non-empty word to its ids, by lowest-rank merges."""
    import tiktoken

    core = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece


def token_bytes(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table in id order; ids without a token are null."""
    by_id: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return pa.array(by_id, pa.binary())


def decode_ids(ids: np.ndarray, table: pa.Array) -> bytes:
    """Join of ids with the token-byte table, kept in position order."""
    out = table.take(pa.array(ids, pa.int32()))
    if out.null_count:
        raise ValueError("an id has no token")
    data = out.buffers()[2]
    ends = np.frombuffer(out.buffers()[1], np.int32, len(out) + 1)
    return data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""


BLOCKS = "block long, shard int, kind int, a binary, b binary, c binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _split_blocks(pattern: str, shards: int, block_chars: int, id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).findall
        part = TaskContext.get().partitionId()

        def rows():
            number, held = 0, _Block(find, shards)
            for doc, text in C.rows_of(batches, [id_column, text_column]):
                text = text or ""
                if held.docs and held.chars + len(text) > block_chars:
                    yield from held.rows(part << 32 | number)
                    number, held = number + 1, _Block(find, shards)
                held.add(doc, text)
            if held.docs:
                yield from held.rows(part << 32 | number)

        yield from C.emit(_BLOCKS, rows(), 64)

    return run


def by_count(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by falling count, ties in order, and each word's rank there."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.uint32)
    rank[order] = np.arange(len(counts), dtype=np.uint32)
    return order, rank


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Frequency ranks in about their entropy: a deflated plane of bit lengths, then each length's remainders as bits."""
    up = ranks.astype(np.int64) + 1
    bits = (np.frexp(up.astype(np.float64))[1] - 1).astype(np.uint8)
    plane = zlib.compress(bits.tobytes(), 6)
    parts = [np.array([len(up), len(plane)], np.uint32).tobytes(), plane]
    for b in range(1, int(bits.max(initial=0)) + 1):
        rest = (up[bits == b] - (1 << b)).astype("<u4")
        parts.append(np.packbits(np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :b]).tobytes())
    return b"".join(parts)


def unpack_ranks(blob: bytes) -> np.ndarray:
    n, size = np.frombuffer(blob, np.uint32, 2).tolist()
    bits = np.frombuffer(zlib.decompress(blob[8 : 8 + size]), np.uint8)
    out, at = np.zeros(n, np.int64), 8 + size
    for b in range(1, int(bits.max(initial=0)) + 1):
        where = np.flatnonzero(bits == b)
        long = (len(where) * b + 7) // 8
        rest = np.unpackbits(np.frombuffer(blob, np.uint8, long, at), count=len(where) * b).reshape(-1, b)
        at += long
        out[where] = (1 << b) - 1 + rest @ (np.int64(1) << np.arange(b))
    return out


class _Block:
    def __init__(self, find, shards: int):
        self.find, self.shards, self.chars = find, shards, 0
        self.words: dict[str, int] = C.numbering()
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.places: list[np.ndarray] = []

    def add(self, doc, text: str) -> None:
        found = self.find(text)
        self.places.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
        self.docs.append(doc)
        self.lengths.append(len(found))
        self.chars += len(text)

    def rows(self, block: int):
        """One row with the documents (kind 0), and one per shard with its words (kind 1), in shard and word order.

        Positions refer to words by falling count, which codes well; ``c`` has the counts in that order, from which
        the reader finds the ranks again, so an answer needs no keys."""
        coded = [w.encode("utf-8", "surrogatepass") for w in self.words]
        shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % self.shards for w in coded), np.int64, len(coded))
        order = C.by_shard(coded, shard)
        to = np.empty(len(coded), np.uint32)
        to[order] = np.arange(len(coded), dtype=np.uint32)
        places = np.concatenate(self.places) if self.places else np.empty(0, np.uint32)
        missing = np.fromiter((d is None for d in self.docs), bool, len(self.docs))
        docs = np.fromiter((0 if d is None else d for d in self.docs), np.int64, len(self.docs))
        head = np.stack([docs, missing.astype(np.int64), np.asarray(self.lengths, np.int64)])
        counts = np.bincount(to[places], minlength=len(coded))
        yield block, -1, 0, C.pack_array(head), pack_ranks(by_count(counts)[1][to[places]]), C.pack_uints(counts)
        at = 0
        ranked = [coded[i] for i in order.tolist()]
        counts = np.bincount(shard, minlength=self.shards) if len(coded) else np.zeros(self.shards, np.int64)
        for s in np.flatnonzero(counts).tolist():
            n = int(counts[s])
            yield block, s, 1, C.pack_words(ranked[at : at + n]), None, None
            at += n


def _encode_words(raw: bytes, pattern: str, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(parse_ranks(raw), pattern)

        def rows():
            known: dict[bytes, list[int]] = {}
            for block, shard, blob in C.rows_of(batches, ["block", "shard", "a"]):
                if len(known) > room:
                    known.clear()
                ids, sizes = [], []
                for w in C.unpack_words(blob):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = merge(w)
                    ids += got
                    sizes.append(len(got))
                yield block, shard, 1, C.pack_uints(np.asarray(ids, np.uint32)), C.pack_uints(np.asarray(sizes, np.uint32)), None

        yield from C.emit(_BLOCKS, rows(), 256)

    return run


def _gather(raw: bytes, digests: bool):
    """Rows come sorted by block and shard: the documents of the block first (shard -1), then the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(parse_ranks(raw))

        def rows():
            for _, group in C.groups_of(C.rows_of(batches, ["block", "a", "b", "c"]), 1):
                _, head, ranks, order = next(group)
                docs, missing, lengths = C.unpack_array(head, np.int64).reshape(3, -1)
                ranks = unpack_ranks(ranks)
                ids, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                order = by_count(C.unpack_uints(order))[0]
                for _, a, b, _ in group:
                    ids.append(C.unpack_uints(a))
                    sizes.append(C.unpack_uints(b))
                ids, sizes = np.concatenate(ids).astype(np.uint32), np.concatenate(sizes)
                starts = np.cumsum(sizes) - sizes
                at = 0
                for doc, gone, n in zip(docs.tolist(), missing.tolist(), lengths.tolist(), strict=True):
                    words = order[ranks[at : at + n]]
                    at += n
                    long = sizes[words]
                    ends = np.cumsum(long)
                    own = ids[np.repeat(starts[words] - (ends - long), long) + np.arange(int(ends[-1]) if n else 0)]
                    text = decode_ids(own, table)
                    own = own.astype("<u4")
                    if digests:
                        yield None if gone else doc, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()
                    else:
                        yield None if gone else doc, len(own), own.tolist(), text

        schema = DIGESTS if digests else IDS
        yield from C.emit(schema, rows(), 256 if not digests else 4096)

    return run


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.binary())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, digests: bool = False, block_chars: int = 32_000_000, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens`` and ``ids, decoded`` (or their digests).

    ``block_chars`` bounds a block's characters and so a Python worker's memory; ``shards`` is the number of
    word shards (the session's shuffle partitions by default)."""
    spark = docs.sparkSession
    shards = shards or C.width(spark)
    raw = read_ranks(ranks_path)
    two = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).cast("string").alias(text_column))
    blocks = C.table(two.mapInArrow(_split_blocks(pattern, shards, block_chars, id_column, text_column), BLOCKS), "bpe-blocks")
    asked = blocks.where("kind = 1").repartitionById(shards, F.col("shard"))
    answers = asked.mapInArrow(_encode_words(raw, pattern, 500_000), BLOCKS)
    wide = C.width(spark)
    meet = blocks.where("kind = 0").unionByName(answers).repartitionById(wide, C.block_place(wide)).sortWithinPartitions("block", "shard")
    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded binary")
    return meet.mapInArrow(_gather(raw, digests), out)
