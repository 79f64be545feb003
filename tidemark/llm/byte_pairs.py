"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A sequence of tokens is what merging by rank gives exactly when every two neighbours are compatible: merging alone
would leave the border between them.  So an encoder may take the longest token at each place and step back to a shorter
one where two neighbours are not compatible; a place from which all tokens failed is never entered again, which keeps
the whole linear in the text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = "byte_bpe_50k.json"
#: Matches of the pattern whose ids a task keeps, the characters of one, pairs in its table, and the ids decoded at a time.
KEPT, SHORT, PAIRS, BLOCK = 400_000, 48, 400_000, 1 << 16


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: printable ones for themselves, the
    others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Table:
    """The bytes of every id of a byte-level vocabulary, one after the other, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, self.ids, self.merges = byte_letters(), spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*self.ids.values(), *self.added.values()]) + 1)
        latin = {ord(c): b for c, b in letters.items()}
        for token, i in self.ids.items():
            self.bytes[i] = token.translate(latin).encode("latin-1")
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids: each one's place in the table of bytes, gathered at once."""
        made = []
        for i in range(0, len(ids), BLOCK):
            part = ids[i:i + BLOCK]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            places = np.repeat(self.starts[part] - (ends - sizes), sizes)
            places += np.arange(len(places))
            made.append(self.blob[places].tobytes())
        return b"".join(made)


class Vocabulary(Table):
    """Merges and automaton of a byte-level vocabulary whose ids follow the order of its merges."""

    def __init__(self, path: str):
        import ahocorasick
        super().__init__(path)
        ids = self.ids
        #: Tokens from here on come from a merge, each from the two parts.
        self.base = len(ids) - len(self.merges)
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(self.base)]
        self.merged: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(self.merges):
            if ids.get(a + b) != self.base + n:
                raise ValueError(f"{path}: ids do not follow the merges at {a + b!r}")
            self.parts.append((ids[a], ids[b]))
            self.merged[ids[a], ids[b]] = self.base + n
        self.longest = max(len(self.bytes[i]) for i in ids.values())
        self.automaton = ahocorasick.Automaton()
        for i in ids.values():
            self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.begins: dict[int, int] = {}

    def shorter(self, token: int) -> int:
        """The longest other token that a token begins with, or -1."""
        known = self.begins.get(token)
        if known is None:
            data = self.bytes[token].decode("latin-1")
            known = self.begins[token] = next((i for k in range(len(data) - 1, 0, -1) if (i := self.automaton.get(data[:k], -1)) >= 0), -1)
        return known

    def compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging leaves the border between two tokens; the table of pairs fills as they are met."""
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._stay_apart(*pair)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges next to the border, the latest first.  Before each, the two pieces at the border existed
        together; had they a merge that comes earlier than the one undone last, it would have joined them."""
        before = len(self.bytes)
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            of_left = left if left >= self.base else -1
            of_right = right if right >= self.base else -1
            if of_left == of_right == -1:
                return True
            if of_left > of_right:
                before, left = left, self.parts[left][1]
            else:  # one rule merges from left to right, so a merge of the same rank across the border comes first
                before, right = right + 1, self.parts[right][0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids that merging by rank gives for ``data`` as one stretch."""
        text = data.decode("latin-1")
        ids = [i for _, i in self.automaton.iter_long(text)]
        compatible = self.compatible
        for n, pair in enumerate(zip(ids, ids[1:]), 1):
            if not compatible(pair):
                return self._backtrack(text, ids[:n], ids[n])
        return ids

    def _backtrack(self, text: str, ids: list[int], token: int) -> list[int]:
        """Go on after compatible ``ids`` where ``token``, the longest there, does not fit."""
        compatible, data, shorter, size = self.compatible, self.bytes, self.shorter, len(text)
        reach, iter_long = self.longest, self.automaton.iter_long
        open_, at = bytearray(b"\1") * (size + 1), sum([len(data[i]) for i in ids])
        while at < size:
            while token >= 0:
                stop = at + len(data[token])
                if open_[stop] and (not ids or compatible((ids[-1], token))):
                    break
                token = shorter(token)
            if token >= 0:
                ids.append(token)
                at = stop
                if at < size:
                    token = next(iter_long(text[at:at + reach]))[1]
            else:  # no token leads on from here: never come back, and try a shorter one before
                open_[at] = 0
                token = ids.pop()
                at -= len(data[token])
                token = shorter(token)
        return ids


class Kept(dict):
    """Ids, as bytes of 32 bits each, of the pattern's matches."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> bytes:
        found = array("i", self.vocabulary.encode_bytes(match.encode())).tobytes()
        if len(match) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[match] = found
        return found


class Encoder:
    """Ids of whole texts by one vocabulary file."""

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import regex
        self.vocabulary = Vocabulary(f"{folder}/{FILE}" if folder else public_tokenizers.path(FILE))
        self.kept, self.matches = Kept(self.vocabulary), regex.compile(public_tokenizers.PATTERN).findall
        self.added = re.compile("|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True))) or r"(?!)")

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, self.matches(text)))

    def ids(self, text: str) -> bytes:
        """Ids as native 32-bit integers; strings of added tokens become these tokens."""
        made, at = [], 0
        for m in self.added.finditer(text):
            made += [self._plain(text[at:m.start()]), array("i", [self.vocabulary.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*made, self._plain(text[at:] if at else text)])


def encode(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``: the ids of the whole text, as the tokenizer library gives them.

    Text by text, without a shuffle; a task holds the vocabulary and the ids of its recent words, so its memory does not
    grow with the input.  NULL and empty texts have no ids; NULL ids and repeated rows are kept; a stretch without
    spaces of any length is encoded in linear time; further columns are not read; an empty table gives an empty result.
    """
    def run(batches):
        encoder = Encoder(folder)
        for batch in batches:
            found = [encoder.ids(t.as_py() or "") for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` for rows of ``encode``; bytes that are no UTF-8 become U+FFFD, NULL ids an empty text."""
    def run(batches):
        import public_tokenizers
        table = Table(f"{folder}/{FILE}" if folder else public_tokenizers.path(FILE))
        for batch in batches:
            texts = [table.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def digests(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Number of ids and the SHA-256 of the ids in decimal and of the decoded text of every document."""
    return decode(encode(docs, folder), folder).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
