"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.bpe import default_path, pattern, word_ids
from tallysheet.llm.common import columns

LENGTH, END = 2048, (1).to_bytes(4, "little")


class Tournament:
    """Free space of sequences in a complete binary tree; each inner node has the larger of its two. Finds the first with room in log n steps."""

    def __init__(self, bins: int, size: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [size] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, space it had) of the first sequence with room; the space is taken."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < length:
                i += 1
        had = tree[i]
        at, tree[i] = i - self.leaves, had - length
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return at, had


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(sequence, offset) for each piece; longer pieces are placed first, equal ones in the order given."""
    tree, out = Tournament(len(lengths), size), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at, had = tree.place(lengths[i])
        out[i] = at, size - had
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def cut(docs: DataFrame, id_col: str, text_col: str, path: str, length: int, special_strings: bool) -> DataFrame:
    """The pieces of each document: full ones, then what is left."""
    pat = pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, wide = word_ids(path), 4 * length
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = ids_of.of_text(text.as_py() or "", pat, special_strings) + END
                for at in range(0, len(ids), wide):
                    piece = ids[at : at + wide]
                    for column, v in zip(out, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return columns(docs, *dict.fromkeys([id_col, text_col])).selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_pieces: int = 4096, seed: int = 29, path: str | None = None, special_strings: bool = True) -> DataFrame:
    """One row for each piece of a document: where it starts there, its ids' checksum, and its place in a sequence.

    Ids are those of the byte-level vocabulary in path, as the tokenizers library gives them without special tokens of its own, then id
    1. The strings of the file's added tokens in a text are those tokens; with special_strings=False they are ordinary text.
    Pieces are dealt by a hash of their document, place and content into groups of about group_pieces, so that neither a book nor copies of one fill a
    group, and another split of the files gives the same packing; each group is packed on its own by first-fit
    decreasing, so that no task needs another's free space. Full pieces fill a sequence alone. sequence_id is
    the group's number in the upper 32 bits and the sequence's within it in the lower. Sequences are padded to
    length, except at a power of two; sequence_tokens says how much of one is used.

    A null or empty text is id 1 alone. Repeated rows are packed once each. A null id stays null; an
    empty table gives no rows. Other columns are left out. Only pieces are shuffled (five numbers), never ids. Counts rows and
    characters while the DataFrame is being built, for the number of groups.
    """
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length(F.col(f"`{text_col}`").cast("string")))).first()
    groups = max(1, -(-(n + (chars or 0) // (3 * length)) // group_pieces))
    pieces = cut(docs, id_col, text_col, path or default_path("byte_bpe_50k.json"), length, special_strings)
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = first_fit_decreasing(t["length"].to_pylist(), length)
        used: dict[int, int] = {}
        for (at, offset), n in zip(placed, t["length"].to_pylist(), strict=True):
            used[at] = max(used.get(at, 0), offset + n)
        base = t["grp"][0].as_py() << 32
        new = {"sequence_id": [base | at for at, _ in placed], "offset": [x for _, x in placed], "sequence_tokens": [used[at] for at, _ in placed]}
        return pa.table({c: t[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {k: pa.array(v, pa.int64()) for k, v in new.items()})

    return pieces.groupBy("grp").applyInArrow(run, PACKED)
