"""BPE encoding by per-prefix dynamic programming, and decoding.

A byte-pair encoding of a string has a useful property: the encoding of each of its
prefixes ends in one certain token, and any two neighbours in an encoding are what
their concatenation would be encoded as. So for each prefix, shortest first, the tokens
that are suffixes of it (found by an Aho-Corasick automaton of the whole vocabulary) are
tried; the one that is compatible with the last token of the prefix it leaves is stored.
Following the stored tokens back from the end gives exactly the ids that merging gives, in
time linear in the length, so that a text without any space is no special case.

A Python worker keeps the ids of frequent chunks in a bounded number of bytes (see ``Kept``);
very long words are not kept, and one of a million bytes takes 8 for each of its prefixes
while it is encoded.

Defined results: null and empty texts have no ids (and decode as the empty text); special
tokens' strings in a text become their ids; very long texts and words are encoded whole; rows with
equal or null ids are kept as they are, one result for each; an empty table gives no rows;
columns other than the id and the text are not read, and ``decode`` keeps them, but for one
named as its result, which is replaced.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, Kept, enter, extended, pieces

NEVER = 1 << 60
#: Bytes in which each Python worker keeps chunks with their ids, pairs with their compatibility, and the ends of tokens.
CHUNKS, PAIRS, SPINES = 128 << 20, 24 << 20, 4 << 20
#: Bytes of a word from which its table of prefixes is packed.
PACKED = 4_096
#: White space as Unicode defines it (the property White_Space).
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: How byte-level tokenizers split a text before merging.
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def resolve(tokenizer: str) -> str:
    """A path as it stands, or the place of a file of the installed package public_tokenizers."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Chunker:
    """Texts in pieces that a byte-level tokenizer encodes one by one: some words, or a special token."""

    def __init__(self, special: list[str]) -> None:
        self.special = special
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.split = regex.compile(_SPLIT).findall
        self.doubled = re.compile(f"[{_SPACE}][{_SPACE}]|\0").search

    def plain(self, text: str) -> list[str]:
        """Where no white space follows white space, words end before each blank and on both sides of each line end; else the pattern says where."""
        if self.doubled(text):
            return self.split(text)
        chunks = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return chunks[not chunks[0] : len(chunks) - (not chunks[-1])]

    def __call__(self, text: str) -> list[str]:
        """A piece that is a special token's text stands for that token."""
        if not any(t in text for t in self.special):
            return self.plain(text)
        return [c for k, part in enumerate(self.around(text)) for c in ([part] if k % 2 else self.plain(part) if part else [])]


class PrefixBpe:
    """A byte-level BPE tokenizer file, read once by each process."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {ord(c): b for b, c in letters.items()}
        self.bytes_of = {i: bytes(t.translate(byte_of).encode("latin-1")) if all(ord(c) in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.chunker = Chunker(list(self.special))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}  # rank of the merge that makes a token; bytes are there from the start
        for k, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank.setdefault(pair, k)
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = pair, k
        # an entry is a token and, in its low 16 bits, the token's length; a pair is an entry above another
        self.pairs = Kept(lambda pair: self._meets(pair >> 64, pair >> 16 & 0xFFFFFFFF, NEVER), PAIRS, lambda pair, meets: 130)
        self.spines = tuple(Kept(lambda token, side=side: self._spine(token, side), SPINES, lambda token, spine: 200 + 4 * len(spine)) for side in (0, 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, i in vocab.items():
            if len(token) == 1 and ord(token) in byte_of or i in self.parts and self._meets(*self.parts[i], self.born[i]):
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i << 16 | len(self.bytes_of[i]))
        self.automaton.make_automaton()
        self.chunks = Kept(self._chunk, CHUNKS, lambda chunk, found: 270 + 2 * len(chunk) + len(found[0]))

    def _spine(self, token: int, side: int) -> array:
        """The tokens that stood at this end while ``token`` was merged, first to last: each was merged away when the next was born."""
        chain = [token]
        while chain[-1] in self.parts:
            chain.append(self.parts[chain[-1]][side])
        return array("i", chain[::-1])

    def _meets(self, left: int, right: int, until: int) -> bool:
        """Do both tokens come about untouched, with no merge across their border before rank ``until``?"""
        a, b, born, i, j = self.spines[1][left], self.spines[0][right], self.born, 0, 0
        x_gone, y_gone = (born[s[1]] if len(s) > 1 else NEVER for s in (a, b))
        while True:
            across = self.rank.get((a[i], b[j]), NEVER)
            # of equal merges the leftmost goes first: the left token's own wins over one across, that one over the right token's
            if across < until and across < x_gone and across <= y_gone:
                return False
            if x_gone == y_gone == NEVER:
                return True
            if x_gone <= y_gone:
                i += 1
                x_gone = born[a[i + 1]] if i + 1 < len(a) else NEVER
            else:
                j += 1
                y_gone = born[b[j + 1]] if j + 1 < len(b) else NEVER

    def word(self, word: bytes) -> list[int]:
        """Ids of a string that isn't split further."""
        last, pairs = [-1] * (len(word) + 1) if len(word) < PACKED else array("q", [-1]) * (len(word) + 1), self.pairs
        for end, entry in self.automaton.iter(word.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - (entry & 0xFFFF)
                if start == 0 or pairs[last[start] << 48 | entry]:
                    last[end + 1] = entry
        ids, at = [], len(word)
        while at:
            entry = last[at]
            ids.append(entry >> 16)
            at -= entry & 0xFFFF
        ids.reverse()
        return ids

    def join(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids joined by commas, and what they decode to (the chunk itself, if the text is valid)."""
        words = self.chunker.split(chunk)
        if len(words) > 1:
            parts = [self.chunks[w] for w in words]
            return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])
        ids = self.word(chunk.encode())
        decoded = self.join(ids).decode("utf-8", "replace")
        return ",".join(map(str, ids)), chunk if decoded == chunk else decoded

    def records(self, text: str) -> list[tuple[str, str]]:
        """What ``_chunk`` gives, for each chunk and special token of the text."""
        kept, special = self.chunks, self.special
        if not any(t in text for t in special):
            return [kept[c] for c in self.chunker.plain(text)]
        return [(str(special[c]), c) if c in special else kept[c] for c in self.chunker(text)]

    def encode(self, text: str | None) -> list[int]:
        joined = ",".join([r[0] for r in self.records(text or "")])
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        return self.join(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> PrefixBpe:
    HELD["bpe"] = _release
    return PrefixBpe(path)


def _release() -> None:
    """Let go of the tables; a no-op where there are none."""
    if codec.cache_info().currsize:
        codec.cache_clear()
        gc.unfreeze()


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ids: bool = True, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS, stay: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, if asked for), ids_sha256, decoded_sha256 of each row. No shuffle: each row for itself.

    chunks: bytes of kept chunks; stay: the tables stay for a worker's next task. Spark hands tasks to idle workers in turn, so after
    operators with several workers a task, all of these would hold tables.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        model = codec(resolve(tokenizer))
        gc.freeze()  # the tables stay; collecting over them again and again takes a fifth of the time
        gc.set_threshold(200_000, 20, 100)
        model.chunks.half = chunks // 2
        for batch in pieces(batches, most=2 << 20, operator="bpe"):
            counts, lists, coded, decoded = [], [], [], []
            for text in batch.column(1).to_pylist():
                parts, raw = zip(*found) if (found := model.records(text or "")) else ((), ())
                joined = ",".join(parts)
                counts.append(joined.count(",") + 1 if joined else 0)
                coded.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256("".join(raw).encode()).hexdigest())
                if ids:
                    lists.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), *([pa.array(lists, pa.list_(pa.int32()))] if ids else []), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names])
        if not stay:
            del model
            enter("")

    kinds = {"n_tokens": "long", "ids": "array<int>"}
    return rows.mapInArrow(run, extended(rows.select("doc_id"), *((n, kinds.get(n, "string")) for n in names)))


def decode(rows: DataFrame, tokenizer: str = "byte_bpe_50k.json", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with a column ``out_col``: the text of the ids, wrong UTF-8 as U+FFFD; null ids give null."""
    kept = [c for c in rows.columns if c.lower() != out_col.lower() or c == ids_col]
    rest = rows.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        model = codec(resolve(tokenizer))
        for batch in batches:
            found = [None if x is None else model.decode(x) for x in batch.column(kept.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out_col])

    return rest.mapInArrow(run, extended(rest, (out_col, "string")))
