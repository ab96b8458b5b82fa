"""Documents as blocks of word numbers: each distinct word of a block meets the corpus once, and its value returns to all its places.

A corpus has far fewer distinct words in a block of documents than places where they stand. So instead of a row for each
place, a block keeps one compressed row (the numbers of its words in order, document by document), and each of its distinct
words is one row. What a word is given (ids, counts) is joined back by block and number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 12_000_000


def pack_numbers(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of the same rank, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Block:
    """Words of some documents, numbered by first occurrence."""

    def __init__(self) -> None:
        self.numbers: dict = {}
        self.places: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.chars = 0
        self.check = 0

    def add(self, doc_id: int | None, words: list, text: str) -> None:
        import xxhash

        numbers, chars = self.numbers, len(text)
        self.check = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), self.check ^ ((doc_id or 0) & (2**64 - 1)))
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        self.places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.chars += chars


def blocks(batches: Iterator[pa.RecordBatch], words_of: Callable[[str | None], list], block_chars: int) -> Iterator[Block]:
    """The blocks of a task's (doc_id, text) rows. A task that is run again makes the same ones."""
    block = Block()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = text.as_py() or ""
            if block.ids and block.chars + len(t) > block_chars:
                yield block
                block = Block()
            block.add(doc_id, words_of(t), t)
    if block.ids:
        yield block


def block_key(number: int) -> int:
    """A block's key: the task's partition and the block's number in it."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) | number


def shard_of(words: list, shards: int) -> np.ndarray:
    """Where each word's value is computed, by its hash."""
    import xxhash

    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % np.uint32(shards)


def pack_parts(parts: list[bytes]) -> bytes:
    """Byte strings: their lengths, then their bytes, compressed."""
    import zstandard

    lengths = pack_numbers(np.fromiter(map(len, parts), np.uint32, len(parts)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack_parts(b: bytes) -> list[bytes]:
    import zstandard

    n = int.from_bytes(b[:4], "little")
    ends = np.cumsum(unpack_numbers(b[4 : 4 + n]), dtype=np.int64).tolist()
    whole = zstandard.ZstdDecompressor().decompress(b[4 + n :])
    return [whole[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


PLACES = "block long, doc_ids array<long>, lengths array<int>, numbers binary, shards binary"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def places(docs: DataFrame, words_of: Callable[[str | None], list], block_chars: int = BLOCK_CHARS, shards: int = 1) -> DataFrame:
    """A row for each block: its documents, how many words each has, the words' numbers in order, the shard of each number's word, and check, a hash of its rows in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, block in enumerate(blocks(batches, words_of, block_chars)):
            numbers = np.concatenate(block.places) if block.places else np.empty(0, np.uint32)
            own = pack_numbers(shard_of(list(block.numbers), shards)) if shards > 1 else b""
            yield pa.RecordBatch.from_arrays([pa.array([block_key(i)]), pa.array([block.ids], pa.list_(pa.int64())), pa.array([[len(p) for p in block.places]], pa.list_(pa.int32())), pa.array([pack_numbers(numbers)], pa.binary()), pa.array([own], pa.binary()), pa.array([signed(block.check)])], ["block", "doc_ids", "lengths", "numbers", "shards", "check"])

    return docs.mapInArrow(run, PLACES + ", check long")


def word_shards(docs: DataFrame, words_of: Callable[[str | None], list], shards: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(shard, block, check, words): a block's distinct words of one shard, by number, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, block in enumerate(blocks(batches, words_of, block_chars)):
            words, key = list(block.numbers), block_key(i)
            own = shard_of(words, shards)
            order = np.argsort(own, kind="stable")
            found, starts = np.unique(own[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            rows = [pack_parts([w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in map(words.__getitem__, order[x:y].tolist())]) for x, y in zip(starts.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), key)), pa.array(np.full(len(found), signed(block.check))), pa.array(rows, pa.binary())], ["shard", "block", "check", "words"])

    return docs.mapInArrow(run, "shard int, block long, check long, words binary")


def whole_blocks(docs: DataFrame, words_of: Callable[[str | None], list], shards: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each block, from one scan: its documents, the numbers of their words in order, the shard of each number's word, and the words of each shard by number, packed. To be staged, so that places and words stay together whatever order rows come in when read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, block in enumerate(blocks(batches, words_of, block_chars)):
            words = list(block.numbers)
            own = shard_of(words, shards)
            order = np.argsort(own, kind="stable")
            found, starts = np.unique(own[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            parts = [{"shard": int(k), "words": pack_parts(list(map(words.__getitem__, order[x:y].tolist())))} for k, x, y in zip(found, starts.tolist(), ends, strict=True)]
            cols = [pa.array([block_key(i)]), pa.array([block.ids], pa.list_(pa.int64())), pa.array([[len(p) for p in block.places]], pa.list_(pa.int32())), pa.array([pack_numbers(np.concatenate(block.places))], pa.binary()), pa.array([pack_numbers(own)], pa.binary()), pa.array([parts], pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary())])))]
            yield pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "lengths", "numbers", "shards", "parts"])

    return docs.mapInArrow(run, PLACES + ", parts array<struct<shard: int, words: binary>>")


def reassembled(values: DataFrame, blocks_of: DataFrame, finish: Callable[[list, np.ndarray, list, np.ndarray], pa.Table], ddl: str) -> DataFrame:
    """finish(values by number, word numbers, doc_ids, lengths) for each block, as rows of ddl. A group is one block, so it is bounded.

    Rows (block, shard, check, parts) of packed values are put in the order of numbers. Words and places come from two
    scans: where the rows of a block came in another order in one of them, check differs and the task fails; no value can get to another word's place.
    """

    def run(v: pa.Table, p: pa.Table) -> pa.Table:
        if len(p) != 1 or set(v["check"].to_pylist()) - set(p["check"].to_pylist()):
            raise RuntimeError("a block's rows came in another order when they were read again: stage the input first")
        order = np.argsort(unpack_numbers(p["shards"][0].as_py()), kind="stable").tolist()
        v = v.sort_by("shard")
        listed: list[bytes] = [b""] * len(order)
        for at, part in zip(order, (x for packed in v["parts"] for x in unpack_parts(packed.as_py())), strict=True):
            listed[at] = part
        return finish(listed, unpack_numbers(p["numbers"][0].as_py()), p["doc_ids"][0].as_py(), p["lengths"][0].values.to_numpy())

    return values.groupBy("block").cogroup(blocks_of.groupBy("block")).applyInArrow(run, ddl)
