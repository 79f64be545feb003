"""Language-model scores: word counts over the corpus, and online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Documents whose CRC-32 of the id, modulo FOLDS, is HELD are never learned from; those of TUNE fit the mixing weights
#: before the predictors learn from them too.
FOLDS, HELD, TUNE = 7, 2, 3
#: Predictors (bytes of context, over word borders; -1 is the whole word so far) and the least bits of their slots; all
#: double until the words so far have a slot for each type.
ORDERS, BITS = (1, 2, 3, 5, -1), (20, 20, 22, 22, 22)
#: Words whose base counts a task keeps, words counted at a time, tokens in a training task, symbols in a training step and
#: in a block that is coded.
HEAD, KEPT, TOKENS, STEP, BLOCK = 1 << 17, 400_000, 8_000_000, 1 << 20, 1 << 15
STARTS = tuple(sum(1 << b for b in BITS[:i]) for i in range(len(BITS) + 1))
#: Shares that the words so far in a document may have in the prediction; their odds adapt to the document.
CACHE = (0.0, 0.02, 0.1, 0.3, 0.6, 0.9)
PLACES = 4  # gates: place in the word (to PLACES - 1) by how many predictors have seen the context of the block
GATES = PLACES * (len(ORDERS) + 1)
#: Bytes (words and spelled bytes: ``Spelling.chunk``) after which a document's weights move, documents coded side by side, the rate of the moves, and those of the tuning passes.
CHUNK, ABREAST, RATE, PASSES = 64, 256, 0.002, (0.01, 0.002)
PIECE = 1 << 16
GRAIN = 0.1  # of the log-odds in the tables that documents are coded with

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64
_CELLS = np.r_[np.arange(0, 32, 2), np.arange(1, 33, 2)]  # by lane: twice the slot, and one more for a one
_SIGNS = np.array([0] + [1] * 15 + [0] + [-1] * 15, np.float32)  # by lane: of the log-odds that the bit is wrong


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; the end of the document is the empty string."""
    return [*(text or "").encode("utf-8", "replace").translate(_UPPER).split(), b""]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of all texts one after another, and how many each has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # A blank after the last word leaves an empty string there, as an empty text does.
    ended = pc.binary_join_element_wise(trimmed, pc.if_else(pc.equal(pc.binary_length(trimmed), 0), "", " "), "")
    found = pc.ascii_split_whitespace(ended)
    return found.flatten().cast(pa.binary()), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)


def fold(doc_id: Column) -> Column:
    """NULL ids are in fold 0, which is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)).cast("int")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, c, tune``: counts over the training documents and over those of the tuning fold among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(counted).group_by("word").aggregate([("c", "sum"), ("tune", "sum")]).rename_columns(["word", "c", "tune"])

        for batch in batches:
            for part in _parts(batch, 0):
                tunes = pc.fill_null(pc.equal(part.column(1), TUNE), False)
                for tune, texts in enumerate((part.column(0).filter(pc.invert(tunes)), part.column(0).filter(tunes))):
                    found = pc.value_counts(split(texts)[0])
                    n = found.field(1)
                    counted.append(pa.table([found.field(0), n, n if tune else pa.array(np.zeros(len(n), np.int64))], names=["word", "c", "tune"]))
                if sum(t.num_rows for t in counted) > KEPT:
                    counted = [merged()]
                    if counted[0].num_rows > KEPT // 2:
                        yield from counted.pop().to_batches()
        if counted:
            yield from merged().to_batches()

    train = docs.select("text", fold(F.col("doc_id")).alias("fold")).filter(F.col("fold") != HELD)
    return train.mapInArrow(run, "word binary, c long, tune long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("tune").alias("tune"))


def _paths(counts: np.ndarray, rare: int) -> tuple[np.ndarray, ...]:
    """Of a Huffman code the length of each symbol's path, of all paths one after another the bits, their slots in blocks of four
    levels, and the blocks by number.  No symbol counts as rarer than 2^-rare of all, which bounds the paths."""
    n, least = len(counts), max(1, int(counts.sum()) >> rare)
    rising = np.argsort(np.maximum(counts, least), kind="stable")
    # The two rarest join each time.  Joined ones rise too, so they are a queue beside that of the symbols; the last is the root.
    single, joined = [*np.maximum(counts, least)[rising].tolist(), math.inf], []
    parent, high, a, b = [0] * (2 * n - 1), [0] * (2 * n - 1), 0, n
    for made in range(n, 2 * n - 1):
        both = 0
        for bit in range(2):
            if b == made or single[a] <= joined[b - n]:
                node, value, a = a, single[a], a + 1
            else:
                node, value, b = b, joined[b - n], b + 1
            parent[node], high[node], both = made, bit, both + value
        joined.append(both)
    paths, lengths = [0] * (2 * n - 1), [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        paths[node], lengths[node] = 2 * paths[parent[node]] + high[node], lengths[parent[node]] + 1
    back = np.argsort(rising)
    paths, sizes = np.array(paths[:n], np.int32)[back], np.array(lengths[:n], np.int32)[back]
    del single, joined, parent, high, lengths
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    level = np.arange(len(owner), dtype=np.int32) - (np.cumsum(sizes, dtype=np.int32) - sizes)[owner]
    path, left, inside = paths[owner], sizes[owner] - level, level % 4
    top = inside == 0
    blocks = np.unique((path >> left | 1 << level)[top], return_inverse=True)[1]
    return sizes.astype(np.int64), (path >> (left - 1) & 1).astype(np.int8), (1 << inside | path >> left & (1 << inside) - 1).astype(np.uint8), blocks


class Paths(NamedTuple):
    """The blocks of symbols: the symbol of each, its offset, and its four lanes, a bit each: the slot, 16 more for a one, or 0 where
    there are fewer bits."""

    home: np.ndarray
    offsets: np.ndarray
    lanes: np.ndarray

    def blocks(self, base: np.ndarray, i: int, grown: int) -> tuple[np.ndarray, np.ndarray]:
        """By block the number of its 16 slots in the table of predictor ``i``, doubled ``grown`` times, and their order, for
        symbols in the contexts ``base``."""
        found = base.take(self.home)
        found += self.offsets
        found >>= np.uint32(32 - BITS[i] - grown)
        return found >> np.uint32(4), (found & np.uint32(15)).astype(np.intp)

    def cells(self, base: np.ndarray, i: int, grown: int) -> np.ndarray:
        """By lane twice the number of its slot in the tables of all predictors, and one more for a one."""
        number, order = self.blocks(base, i, grown)
        order += number.astype(np.intp) << 4
        order += STARTS[i] << grown
        order <<= 1
        return order[:, None] ^ _CELLS.take(self.lanes)


class Tree:
    """A binary code of the 256 bytes by their frequencies: each byte is the path of its bits from the root.

    The bits of four levels are a block of 16 neighbouring slots, in an order that the context decides.
    """

    chunk = CHUNK

    def __init__(self, counts: np.ndarray):
        self._set(*_paths(counts, 14))  # paths stay below 24 bits

    def _set(self, sizes: np.ndarray, ones: np.ndarray, slots: np.ndarray, blocks: np.ndarray) -> None:
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.several = (sizes + 3) // 4
        self.first_block = np.cumsum(self.several) - self.several
        lanes = np.zeros(4 * int(self.several.sum()), np.uint8)
        lanes[np.repeat(4 * self.first_block - self.first, sizes) + np.arange(len(slots))] = slots | ones.astype(np.uint8) << 4
        self.lanes = lanes.view(np.uint32)
        self.offsets = ((blocks.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32)

    @property
    def ones(self) -> np.ndarray:
        lanes = self.lanes.view(np.uint8)
        return (lanes[lanes > 0] >> 4).astype(np.int8)

    def coded(self, words: list[bytes], first: list[int] | None = None) -> Coded:
        return Coded(words, first)

    def texts(self, texts: pa.Array) -> Coded:
        return self.coded([w for t in texts for w in tokens(t.as_py())])

    def paths(self, symbols: np.ndarray) -> Paths:
        several = self.several.take(symbols)
        home = np.repeat(np.arange(len(symbols)), several)
        place = np.repeat(self.first_block.take(symbols) - np.cumsum(several) + several, several)
        place += np.arange(len(home))
        return Paths(home, self.offsets.take(place), self.lanes.take(place).view(np.uint8).reshape(-1, 4))


EVEN = Tree(np.ones(256, np.int64))


class Spelling(Tree):
    """A code of words: a tree of the words of ``head`` (with their counts) and an escape; after the escape come the bytes of any other word.

    Each of these is coded by the tree of the byte before it in the word, a space at its start; ``follows`` are their counts.
    """

    chunk = 32

    def __init__(self, head: dict[bytes, int], others: int, follows: np.ndarray):
        head = {b"": 1} | head
        ordered = sorted(head, key=lambda w: (-head[w], w))
        self.words = pa.array(ordered, pa.binary())
        self.escape = len(ordered)
        # Where few were counted, bytes follow as they do anywhere.
        every = follows.sum(0) + 1
        parts = [_paths(np.array([*map(head.get, ordered), others]), 18)]
        parts += [_paths(every + row * (64 * int(every.sum()) // max(64, int(row.sum()))), 14) for row in follows]
        done = np.cumsum([0, *(blocks.max() + 1 for *_, blocks in parts)])
        sizes, ones, slots, blocks = zip(*parts)
        self._set(np.concatenate(sizes), np.concatenate(ones), np.concatenate(slots), np.concatenate([b + at for b, at in zip(blocks, done)]))

    @property
    def number(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def coded(self, words: list[bytes], first: list[int] | None = None) -> Coded:
        if first is None:
            first = [i for i, w in enumerate([b"", *words[:-1]]) if not w]
        return Spelled(pa.array(words, pa.binary()), np.array(first, np.int64), self)

    def texts(self, texts: pa.Array) -> Spelled:
        words, counts = split(texts)
        return Spelled(words, np.cumsum(counts) - counts, self)


def followers(words: DataFrame) -> np.ndarray:
    """How often each byte follows each other in the words whose ``word, c`` these are; a space stands before and after a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            found = batch.column(0).to_pylist()
            data = np.frombuffer(b" ".join([b"", *found, b""]), np.uint8).astype(np.int64)
            times = np.repeat(batch.column(1).to_numpy(), [len(w) + 1 for w in found])
            np.add.at(total, data[:-1] << 8 | data[1:], times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(total[at])})

    found = np.zeros(1 << 16, np.int64)
    for pair, n in words.select("word", "c").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        found[pair] = n
    return found.reshape(256, 256)


class Coded:
    """Documents as bytes with their contexts; a word ends with a space, the end of a document is one line end.

    ``first`` numbers the words that start a document; without it each word after an end does.  Before a document
    stands one line end.
    """

    def __init__(self, words: list[bytes], first: list[int] | None = None):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.data = np.frombuffer(bytearray(b" ".join([*words, b""])), np.uint8)
        starts = np.cumsum(sizes) - sizes
        self.data[starts[sizes == 1]] = 10
        if first is None:
            first = np.flatnonzero(np.r_[True, sizes[:-1] == 1][:len(words)])
        self.symbols = self.data
        self.starts = starts[np.array(first, np.int64)]
        self.sizes = np.diff(np.r_[self.starts, len(self.data)])
        every = np.arange(len(self.data), dtype=np.int32)
        self.inside = every - np.repeat(self.starts.astype(np.int32), self.sizes)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.place = every - np.repeat(starts.astype(np.int32), sizes)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(sizes.max(initial=1)), 0x5851F42D4C957F2D, np.uint64))
            before = np.r_[_U(0), np.cumsum((self.data.astype(np.uint64) + _U(1)) * power[self.place])]
            self.prefix = before[:-1] - before[starts][self.word]

    def hashes(self, at: slice, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
        """For each of ``orders``, ascending but for -1, a hash of the last bytes of the document before each byte."""
        inside, found, done = self.inside[at], np.zeros(at.stop - at.start, np.uint64), 0
        back = self._back(at, max(orders))
        for order in orders:
            if order < 0:
                mixed = self.prefix[at] + self.place[at].astype(np.uint64)
            else:
                for k in range(done + 1, order + 1):
                    byte = back(k) * (inside >= k)
                    byte[inside == k - 1] = 10
                    found = found * _U(257) + byte + _U(1)
                mixed, done = found, order
            mixed = (mixed ^ (mixed >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> _U(32)
            mixed *= _U(0x94D049BB133111EB)
            mixed ^= mixed >> _U(31)
            yield mixed

    def _back(self, at: slice, reach: int) -> Callable[[int], np.ndarray]:
        data = np.r_[np.zeros(max(0, reach - at.start), np.uint8), self.data[max(0, at.start - reach):at.stop]]
        return lambda k: data[reach - k:len(data) - k]

    def contexts(self, order: int, at: slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return next(self.hashes(at, (order,)))

    def bases(self, at: slice) -> list[np.ndarray]:
        """For each predictor 32 bits of the hash of the context of each byte."""
        with np.errstate(over="ignore"):
            return [(mixed >> _U(32)).astype(np.uint32) for mixed in self.hashes(at, ORDERS)]

    def cells(self, index: np.ndarray, grown: int, tree: Tree = EVEN) -> Iterator[np.ndarray]:
        """For each predictor the slots of the bits of these bytes, in tables doubled ``grown`` times."""
        paths = tree.paths(self.symbols[index])
        return (paths.cells(base[index], i, grown)[paths.lanes > 0] >> 1 for i, base in enumerate(self.bases(slice(0, len(self.symbols)))))


class Spelled(Coded):
    """Documents as the symbols of a ``Spelling``: a word of its head is one, with the contexts of its first byte; another word is
    the escape, with the same contexts, and its bytes."""

    def __init__(self, words: pa.Array, first: np.ndarray, tree: Spelling):
        n = len(words)
        different = words.dictionary_encode()
        self.own, self.distinct = different.indices.to_numpy(), different.dictionary
        self.ids = pc.fill_null(pc.index_in(self.distinct, value_set=tree.words), tree.escape).to_numpy()
        ids = self.ids.take(self.own)
        sizes = pc.binary_length(words).to_numpy().astype(np.int32) + np.int32(1)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words), b" ")[0].as_py()
        self.data = np.frombuffer(bytearray(joined + b" "), np.uint8)
        starts = np.cumsum(sizes) - sizes
        self.data[starts[sizes == 1]] = 10
        units = np.where(ids == tree.escape, sizes + 1, 1)
        begins = np.cumsum(units) - units
        self.starts, self.sizes = begins[first], np.diff(np.r_[begins[first], units.sum()])
        self.word = np.repeat(np.arange(n, dtype=np.int32), units)
        self.symbols = ids.take(self.word)
        shift = np.arange(len(self.word), dtype=np.int32) - begins.astype(np.int32).take(self.word)
        self.place = np.maximum(shift - 1, 0)
        self.at = starts.astype(np.int32).take(self.word) + self.place
        start = starts[first]
        self.inside = self.at - np.repeat(start.astype(np.int32), self.sizes)
        # The bytes of other words: their symbols, and hashes of what of the word stands before them.
        spelled = np.flatnonzero(shift)
        data, place = self.data[self.at[spelled]], self.place[spelled]
        self.symbols[spelled] = tree.escape + 1 + (np.where(place == 0, 32, self.data[self.at[spelled] - 1]).astype(np.int32) << 8 | data)
        self.prefix = np.zeros(len(self.word), np.uint64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x5851F42D4C957F2D, np.uint64))
            before = np.r_[_U(0), np.cumsum((data.astype(np.uint64) + _U(1)) * power[place])]
            self.prefix[spelled] = before[:-1] - before[np.arange(len(spelled)) - place]

    def _back(self, at: slice, reach: int) -> Callable[[int], np.ndarray]:
        return lambda k: self.data.take(self.at[at] - np.int32(k), mode="clip")


def doublings(types: int) -> int:
    """How often the tables double until the words so far have a slot for each type."""
    return max(0, min(32, max(1, types - 1).bit_length()) - BITS[-1])


def trained(docs: DataFrame, tokens_all: int, types: int, tree: Tree = EVEN) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions of all predictors from the running text of the training documents, without and with the tuning fold.

    ``docs`` is ``text, fold``.  Each task counts bits as whole numbers over about TOKENS tokens; the pieces of the
    tables are added up by their number, turned into log-odds there, and only those come to the driver.
    """
    grown = doublings(types)
    slots_all = STARTS[-1] << grown

    def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept, counted = np.zeros(2 * slots_all, np.uint32), [], 0

        def flush():
            for i in range(len(total) // PIECE):
                part = total[i * PIECE:(i + 1) * PIECE]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "cells": pa.array([zlib.compress(part, 1)], pa.binary())})

        def count():
            nonlocal counted
            coded = tree.texts(pa.concat_arrays(kept))
            kept.clear()
            if counted + len(coded.symbols) > 1 << 31:  # a cell of 32 bits holds the symbols of one round
                yield from flush()
                total[:], counted = 0, 0
            counted += len(coded.symbols)
            for at in range(0, len(coded.symbols), STEP):
                step = slice(at, min(at + STEP, len(coded.symbols)))
                data = coded.symbols[step].astype(np.uint64)
                for i, base in enumerate(coded.bases(step)):
                    # Symbols of the same context once, with their number.
                    pairs = np.sort(base.astype(np.uint64) << _U(32) | data)
                    starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
                    times = np.diff(np.r_[starts, len(pairs)]).astype(np.uint32)
                    pairs = pairs[starts]
                    for some in (slice(a, a + BLOCK // 2) for a in range(0, len(pairs), BLOCK // 2)):
                        paths = tree.paths((pairs[some] & _U(0xFFFFFFFF)).astype(np.intp))
                        cells = paths.cells((pairs[some] >> _U(32)).astype(np.uint32), i, grown)
                        counts = times[some].take(paths.home)[:, None] * (paths.lanes != 0)
                        np.add.at(total, cells.ravel(), counts.ravel())

        for batch in batches:
            for part in _parts(batch, 0, 1 << 20):
                kept.append(part.column(0))
                if sum(x.nbytes for x in kept) > 3 << 20:  # the more at once, the more are the same
                    yield from count()
        if kept:
            yield from count()
        yield from flush()

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, tune, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                sums.setdefault(i, [np.zeros(PIECE, np.int64), np.zeros(PIECE, np.int64)])[tune] += np.frombuffer(zlib.decompress(data), np.uint32)
        for i, (x, more) in sums.items():
            made = [np.clip(np.log((n[1::2] + 0.4) / (n[0::2] + 0.4)), -12, 12).astype(np.float16).tobytes() for n in (x, x + more)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "cells": pa.array(made[:1], pa.binary()), "whole": pa.array(made[1:], pa.binary())})

    # A task counts one kind of documents, so it holds one table.
    parts = []
    for tune, share in ((False, FOLDS - 2), (True, 1)):
        own = docs.filter((F.col("fold") == TUNE) == tune).select("text")
        counted = own.coalesce(max(1, -(-tokens_all * share // (TOKENS * (FOLDS - 1))))).mapInArrow(count_bits, "piece int, cells binary")
        parts.append(counted.select("piece", F.lit(tune).alias("tune"), "cells"))
    rows = parts[0].union(parts[1]).repartition(16 << grown, "piece").mapInArrow(stretch, "piece int, cells binary, whole binary").toLocalIterator()
    out = np.zeros(slots_all, np.float16), np.zeros(slots_all, np.float16)
    for i, *data in rows:
        for made, part in zip(out, data):
            made[i * PIECE // 2:(i + 1) * PIECE // 2] = np.frombuffer(part, np.float16)
    return out


def grains(table: np.ndarray) -> np.ndarray:
    """The table in steps of GRAIN, a byte a slot; what is not 0 stays so."""
    out = np.empty(len(table), np.int8)
    for at in range(0, len(table), PIECE):
        x = table[at:at + PIECE].astype(np.float32)
        near = np.rint(x / np.float32(GRAIN))
        out[at:at + PIECE] = np.where(near == 0, np.sign(x), near)
    return out


def code(coded: Coded, table: np.ndarray, weights: np.ndarray, rate: float, tree: Tree = EVEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cost of each byte in nats; the weights that the documents end with, summed by gate with their visits, and the visits.

    Each document starts from ``weights``; every tree.chunk bytes they move against the coding error of those bytes by
    ``rate``, so no byte is predicted by weights that have seen it.  Documents do not see each other.
    """
    grown = (len(table) // STARTS[-1]).bit_length() - 1
    inputs = len(ORDERS) + 1
    cost = np.zeros(len(coded.symbols))
    blocks = [coded.bases(slice(at, min(at + BLOCK, len(cost)))) for at in range(0, len(cost), BLOCK)]
    bases = [np.concatenate(found) for found in zip(*blocks)]
    del blocks
    tables = [table[a << grown:b << grown].reshape(-1, 16) for a, b in zip(STARTS, STARTS[1:])]
    ended, visits = np.zeros((GATES, inputs)), np.zeros(GATES)
    order = np.argsort(-coded.sizes, kind="stable")
    for group in range(0, len(order), ABREAST):
        own = order[group:group + ABREAST]
        starts, sizes = coded.starts[own], coded.sizes[own]
        now = np.tile(weights.ravel().astype(np.float32), len(own))
        visited = np.zeros(len(own) * GATES)
        at, longest = 0, int(sizes.max(initial=0))
        while at < longest:
            live = int(np.searchsorted(-sizes, -at, "left"))
            # Contexts of as many chunks at once as BLOCK bytes hold, so few long documents cost no more calls than many.
            chunks = max(1, min(BLOCK // (live * tree.chunk), -(-(longest - at) // tree.chunk)))
            used = (np.arange(at, at + chunks * tree.chunk) < sizes[:live, None]).reshape(live, chunks, tree.chunk)
            # Neighbours are of different documents, so that sums by document and gate do not wait for each other.
            chunk, shift, doc = np.nonzero(used.transpose(1, 2, 0))
            index = starts[doc] + at + chunk * tree.chunk + shift
            paths = tree.paths(coded.symbols[index])
            lanes = np.ascontiguousarray(paths.lanes.T)
            slots, scale = (lanes & np.uint8(15)).astype(np.intp), _SIGNS.take(lanes)
            x = np.empty((inputs, *lanes.shape), np.float32)
            np.multiply(scale, np.float32(0.3), out=x[-1])
            if table.dtype == np.int8:
                scale *= np.float32(GRAIN)
            keys = (doc * GATES + np.minimum(coded.place[index], PLACES - 1) * inputs).take(paths.home)
            firsts = np.arange(len(keys)) << 4
            for i, base in enumerate(bases):
                number, spread = paths.blocks(base[index], i, grown)
                spread += firsts
                found = tables[i].take(number.astype(np.intp), axis=0).ravel().take(slots ^ spread, mode="clip")
                np.multiply(found, scale, out=x[i])
                keys += found[0] != 0
            # The weights of a document's gate lie side by side.
            every = keys * inputs + np.arange(inputs)[:, None]
            factors = np.empty(len(keys))
            stops = np.searchsorted(paths.home, np.searchsorted(chunk, np.arange(chunks + 1)))
            for here in map(slice, stops[:-1], stops[1:]):
                key, part = every[:, here], x[:, :, here]
                odds = np.einsum("iln,in->ln", part, now.take(key, mode="clip"))
                np.clip(odds, -20, 20, out=odds)
                wrong = np.exp(odds, out=odds)
                factors[here] = np.multiply.reduce(wrong + np.float64(1), axis=0)
                wrong /= wrong + np.float32(1)
                moves = np.bincount(key.ravel(), np.einsum("ln,iln->in", wrong, part).ravel())
                now[:len(moves)] -= rate * moves
                visited += np.bincount(keys[here], minlength=len(visited))
            # A lane without a bit is an even one.
            factors /= 1 << (lanes == 0).sum(0)
            cost[index] = np.bincount(paths.home, np.log(factors), len(index))
            at += chunks * tree.chunk
        visited = visited.reshape(-1, GATES)
        ended += np.einsum("dgi,dg->gi", now.reshape(-1, GATES, inputs), visited)
        visits += visited.sum(0)
    return cost, ended, visits


def tuned(docs: DataFrame, table: np.ndarray, tree: Tree = EVEN) -> np.ndarray:
    """Weights by gate from all documents of the tuning fold (``text``): after each pass, the mean of what the documents ended
    with, by their visits of the gate."""
    weights = np.full((GATES, len(ORDERS) + 1), 1.0 / len(ORDERS))
    for rate in PASSES:
        def run(batches: Iterator[pa.RecordBatch], weights=weights, rate=rate) -> Iterator[pa.RecordBatch]:
            ended, visits = np.zeros(weights.shape), np.zeros(GATES)
            for batch in batches:
                for part in _parts(batch, 0):
                    _, a, b = code(tree.texts(part.column(0)), table, weights, rate, tree)
                    ended += a
                    visits += b
            yield pa.RecordBatch.from_pydict({"sums": pa.array([np.c_[ended, visits].tobytes()], pa.binary())})

        rows = sorted(bytes(r[0]) for r in docs.mapInArrow(run, "sums binary").collect())  # 1.3 kB a task
        sums = sum((np.frombuffer(r).reshape(GATES, -1) for r in rows), np.zeros((GATES, len(ORDERS) + 2)))
        found = sums[:, -1] > 0
        weights[found] = sums[found, :-1] / sums[found, -1:]
        weights = weights.round(6)
    return weights


def token_scores(words: list[bytes], table: np.ndarray, weights: np.ndarray, first: list[int] | None = None, tree: Tree = EVEN) -> np.ndarray:
    """Log10 probability of each token's bytes, given those before it in its document."""
    coded = tree.coded(words, first)
    return -np.bincount(coded.word, code(coded, table, weights, RATE, tree)[0], len(words)) / math.log(10)


def word_scores(words: list[bytes], table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log10 probability of each word at a document's start, its end included; over all words they sum to 1 at most."""
    return token_scores(words, table, weights, list(range(len(words))))


def document_scores(ids: np.ndarray, counts: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Log10 probabilities of documents of ``counts`` tokens, which have the numbers ``ids``; ``coded`` is each token's log10 probability.

    For each share in CACHE a predictor gives that share to the words of the document so far, each by its count, and
    the rest to the bit predictors.  Their odds, even at first, follow how well each has coded the document: the sum of
    what they give to the whole document, over all of them.
    """
    begins = np.cumsum(counts) - counts
    t = np.arange(len(ids)) - np.repeat(begins, counts)
    key = np.repeat(np.arange(len(counts)) << 32, counts) + ids
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    runs = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times = np.empty(len(ids))
    times[order] = np.arange(len(ids)) - np.repeat(runs, np.diff(np.r_[runs, len(ids)]))
    # What the words so far give, over what the predictors give; e^700 is near the end of a float's range.
    seen = times > 0
    more = np.log(times[seen] / t[seen]) - coded[seen] * math.log(10)
    over = np.maximum(more - 700, 0)
    more, over = np.exp(more - over), over / math.log(10)
    sums = [np.add.reduceat(coded, begins)]
    for share in CACHE[1:]:
        part = np.where(t > 0, math.log10(1 - share), 0.0)
        part[seen] = np.log10(1 - share + share * more) + over
        sums.append(np.add.reduceat(coded + part, begins))
    top = np.max(sums, axis=0)
    return top + np.log10(np.mean(10.0 ** (np.array(sums) - top), axis=0))


def document_score(ids: np.ndarray, coded: np.ndarray) -> float:
    return float(document_scores(ids, np.array([len(ids)]), coded)[0])


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every document.

    The base is add-one smoothed word counts over the training documents, all of them.  The most frequent words that were met
    more than once, at most ``HEAD``, are counted inside the tasks; the other words of each document go as (word, document)
    rows to their counts, so no word there is hot.  The model codes every token by bit predictors in hashed contexts that
    reach over word borders, mixed by weights of gates that move while a document is coded.  The bits of a frequent word are
    its path in a tree of them, those of another an escape and the paths of all its bytes.  The counts of all words, frequent
    or not, are in the mix as the predictor of the word so far; a cache of its words adapts it further to the document.  The
    predictors learn from the running text of all training documents; the starting weights are fitted by all documents
    of the tuning fold, with predictors that have not seen them.

    NULL and empty texts are one end; NULL ids are learned from and not held out; repeated rows count and are scored
    each; an empty table gives an empty result; where no document is learned from, every word is unknown.
    """
    words = written(vocabulary(docs), "lm-words")
    total, distinct = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    # The frequent words: those of a count from which on there are at most HEAD, on a grid of eight counts an octave.
    octave = F.floor(8 * F.log2("c")).cast("int")
    least, found = None, 0
    for at, n in sorted(words.groupBy(octave.alias("at")).count().collect(), reverse=True):
        found += n
        if found > HEAD:
            break
        least = at
    frequent = F.lit(False) if least is None else octave >= least
    # A word that was met once stands for those that were not: it is spelled.
    often = words.filter(frequent & (F.col("c") > 1)).select("word", "c").toArrow()
    head = dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist()))
    del often
    tree = Spelling(head, total - sum(head.values()), followers(words.filter(~frequent | (F.col("c") == 1))))
    logs = np.array([math.log10(head[w] + 1) if w in head else 0.0 for w in tree.words.to_pylist()] + [0.0])  # 0 also for the escape
    learned = docs.select("text", fold(F.col("doc_id")).alias("fold")).filter(F.col("fold") != HELD)
    apart, table = map(grains, trained(learned, total, distinct, tree))
    weights = tuned(learned.filter(F.col("fold") == TUNE).select("text"), apart, tree)
    del apart, head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _parts(batch):
                texts, n = part.column(1), part.num_rows
                found, counts = split(texts)
                coded = Spelled(found, np.cumsum(counts) - counts, tree)
                scores = -np.bincount(coded.word, code(coded, table, weights, RATE, tree)[0], len(found)) / math.log(10)
                # Each word of each document once, with its number there.
                pairs, times = np.unique(np.repeat(np.arange(n) << 32, counts) + coded.own, return_counts=True)
                row, own = pairs >> 32, pairs & 0xFFFFFFFF
                log = logs[coded.ids.take(own)]
                links = log == 0
                rows = pa.array(np.arange(number, number + n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), rows, pa.array(counts), pa.array(np.bincount(row, np.where(links, 0, times), n).astype(np.int64)),
                     pa.array(np.bincount(row, times * log, n)), pa.array(document_scores(coded.own, counts, scores)),
                     pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=_NAMES)
                yield _links(number + row[links], coded.distinct.take(pa.array(own[links])), times[links], part)
                number += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fold int, row long, n_tokens long, known long, base double, score double, bytes long, word binary, times long"
    made = docs.select("doc_id", "text", fold(F.col("doc_id")).alias("fold")).mapInArrow(run, schema)
    made = written(made, "lm-rows")
    tail = made.filter("word IS NOT NULL").select("row", "word", "times").join(words.select("word", "c"), "word")
    tail = tail.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_base"))
    rows = made.filter("word IS NULL").drop("word", "times").join(tail, "row", "left")
    lost = math.log10(total + distinct + 1)
    tokens_of = F.col("n_tokens")
    return rows.select(
        "doc_id", (F.col("fold") == HELD).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - tokens_of * F.lit(lost)).alias("base_score"), "score",
        F.when(F.col("bytes") > 0, -F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"))


def _parts(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes of the text in ``column``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


_NAMES = ["doc_id", "fold", "row", "n_tokens", "known", "base", "score", "bytes", "word", "times"]


def _links(rows: np.ndarray, words: pa.Array, times: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    n = len(rows)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, part.column(0).type), pa.nulls(n, part.column(2).type), pa.array(rows), *none, words, pa.array(times)], names=_NAMES)
