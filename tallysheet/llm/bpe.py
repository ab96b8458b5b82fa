"""Byte-level BPE over words: pre-tokenisation, and the encoding of single words by a public vocabulary."""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

from tallysheet.llm.common import kept_by_worker

#: Texts of these characters only take the faster of two patterns; on them, `re` and `regex` know the same letters, digits and spaces.
UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e¡-±´-¸»¿-ɏͰ-ͷͻ-ͽΑ-ΡΣ-ҁҊ-ӿ‐-‧€]")
USUAL = re.compile(r" ?[^\W\d_]++| ?\d++|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+")


@lru_cache
def _exact(pattern: str):
    import regex

    return regex.compile(pattern)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pretokens(text: str, pat: str) -> list[str]:
    """All matches of the vocabulary's pattern, in order; together they are the text."""
    return (USUAL if UNUSUAL.search(text) is None else _exact(pat)).findall(text)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, others are numbered from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit integers, by the model of a tokenizers file. At most `most` words are remembered.

    special: the file's added tokens (such as <|endoftext|>), whose strings are one id each wherever they stand in a text,
    as the tokenizers library has it unless encode_special_tokens is set.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.most = tokenizer.model, byte_letters(), most
        self.special = {t.content: struct.pack("<I", i) for i, t in tokenizer.get_added_tokens_decoder().items()}
        plain = all(not (t.single_word or t.lstrip or t.rstrip or t.normalized) for t in tokenizer.get_added_tokens_decoder().values())
        if not plain:
            raise ValueError("added tokens that strip or match whole words only aren't supported")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def of_text(self, text: str, pat: str, special_strings: bool = True) -> bytes:
        """The ids of a text; with special_strings, the strings of added tokens are their ids."""
        if special_strings and any(x in text for x in self.special):
            return b"".join(self.special[x] if x in self.special else self.of_text(x, pat, False) for x in self.cut.split(text) if x)
        return b"".join(map(self.__getitem__, pretokens(text, pat)))

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[word] = packed
        return packed


def word_ids(path: str) -> WordIds:
    """One table for each Python worker, whichever of this operator's tasks it runs."""
    return kept_by_worker(f"words {path}", lambda: WordIds(path))
