"""Byte-level BPE encoding and decoding of a corpus: each distinct word is encoded once, globally."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallysheet.llm import bpe
from tallysheet.llm.blocks import BLOCK_CHARS, pack_parts, places, reassembled, unpack_parts, word_shards
from tallysheet.llm.common import columns


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the neighbouring parts of least rank until none is left that the vocabulary knows."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2]) for i in range(len(word) - 1)]
    if len(parts) > 200:
        return _encode_long(word, ranks)
    while True:
        best = min((p for p in pairs if p is not None), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and linked parts, so that a word of a million bytes takes n log n steps."""
    import heapq

    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is word[i:end[i]]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, outputs: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with outputs, ids and decoded.

    Texts are split by the vocabulary's pattern. The distinct words of each block of documents are shuffled by shards of
    their hash, so that equal words of all blocks meet: each is encoded once there, and its ids go back to each block
    that has it. Blocks put ids at the places of their words, and decode them by the table of token bytes.
    Words are combined within a block before the shuffle, so a word that stands everywhere is one row a block.

    A null text counts as empty (no ids). Repeated rows give repeated rows; a null id stays null; an empty table gives
    none. Other columns are left out. Every byte is a token, so all texts can be encoded. The token-byte table is as
    large as the vocabulary, and each worker reads it from path.
    """
    path, pat = path or bpe.default_path("byte_bpe_50k.tiktoken"), pattern or bpe.pattern()
    docs = columns(docs, *dict.fromkeys([id_col, text_col])).selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    words_of = lambda t: bpe.pretokens(t, pat)

    # Shards grow with the input (partitions are of bounded size), so a shard has a bounded number of words.
    shards = max(64, 4 * docs.rdd.getNumPartitions())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, last, known = bpe.ranks_of(path), None, {}
        for b in batches:
            for shard, block, check, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if shard != last:
                    last, known = shard, {}
                words = unpack_parts(packed.as_py())
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode_word(w, ranks), "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard], pa.int32()), pa.array([check.as_py()], pa.int64()), pa.array([pack_parts([known[w] for w in words])], pa.binary())], ["block", "shard", "check", "parts"])

    encoded = word_shards(docs, words_of, shards, block_chars).repartition("shard").sortWithinPartitions("shard").mapInArrow(encode, "block long, shard int, check long, parts binary")

    def finish(ids_of: list[bytes], numbers: np.ndarray, doc_ids: list, lengths: np.ndarray) -> pa.Table:
        table = token_bytes(path)
        at, rows = 0, []
        for n in lengths.tolist():
            ids = b"".join(map(ids_of.__getitem__, numbers[at : at + n].tolist()))
            at += n
            tokens = np.frombuffer(ids, "<u4")
            decoded = b"".join(map(table.__getitem__, tokens.tolist()))
            rows.append((len(tokens), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), tokens if outputs else None, decoded if outputs else None))
        n, a, b, ids, decoded = zip(*rows, strict=True)
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary())})

    return reassembled(encoded, places(docs, words_of, block_chars, shards), finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary")


_TABLES: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    if path not in _TABLES:
        ranks = bpe.ranks_of(path)
        table = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            table[i] = b
        _TABLES[path] = table
    return _TABLES[path]
