"""Alignment of two tokenizers: where tokens of both end together, and how many documents link each pair of ids.

Pair-document records are radix-partitioned by the first tokenizer's id into compressed runs, a run for each slice of
documents and radix.  Runs of one radix meet in a k-way heap merge in the order of the first id, so each pair is counted
and each id's highest count is known when the merge leaves that id; what a slice is due flows back to it at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Parts by the first id's low bits; runs that one merge takes; links and documents of one slice.
RADIX, FAN, LINKS, ROWS = 256, 32, 1 << 21, 60_000
#: Bits of the second id, and of a document's place in its slice.
SECOND, PLACE = 15, 16
#: Links of a group that are listed one by one; of larger groups its different pairs are.
LISTED = 4096


class Pair:
    """Groups and links of texts by a byte-level and a sentence-piece vocabulary."""

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        with open(path(BYTE_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.first_bytes[i] = token
        model = sentencepiece.SentencePieceProcessor(model_file=path(PIECE_FILE))
        self.second = model.encode
        self.second_bytes = [
            bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]
        if len(self.first_bytes) > 1 << 16 or len(self.second_bytes) > 1 << SECOND:
            raise ValueError("the vocabularies have more ids than a pair's key has room for")
        self.sizes = [np.array(list(map(len, tokens)), np.int64) for tokens in (self.first_bytes, self.second_bytes)]
        self.keys = np.array([key(i) for i in range(len(self.first_bytes))], np.uint64)
        #: Every id with what follows it: inside the first's ids of a group, after them, inside the second's, after them.
        self.written = [f"{i}{end}" for n, ends in ((len(self.first_bytes), ",|"), (len(self.second_bytes), ",;")) for i in range(n) for end in ends]

    def aligned(self, text: str):
        """Ids of both, and how many of each every group has; None where either's bytes are not space + text."""
        if not text:
            return None
        whole = " " + text
        a, b, data = self.first(whole), self.second(text), whole.encode()
        if b"".join([self.second_bytes[i] for i in b]) != data or b"".join([self.first_bytes[i] for i in a]) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        marks = np.zeros(len(data) + 1, np.int8)
        marks[ends_a] = 1
        marks[ends_b] += 1
        in_a, in_b = (np.diff(np.flatnonzero(marks[ends] == 2), prepend=-1) for ends in (ends_a, ends_b))
        return a, b, in_a, in_b

    def text_of(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        codes = np.empty(len(a) + len(b), np.int64)
        stops_a, stops_b = np.cumsum(in_a), np.cumsum(in_b)
        codes[np.arange(len(a)) + np.repeat(stops_b - in_b, in_a)] = 2 * a
        codes[np.arange(len(b)) + np.repeat(stops_a, in_b)] = 2 * (b + len(self.first_bytes))
        codes[stops_a + stops_b - in_b - 1] += 1
        codes[stops_a + stops_b - 1] += 1
        return "".join(map(self.written.__getitem__, codes.tolist()))[:-1]

    def links(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Keys of the linked occurrences; of groups with more than ``LISTED`` links, different keys and their numbers."""
        starts_b = np.cumsum(in_b) - in_b
        large = np.flatnonzero(in_a * in_b > LISTED)
        times = in_b.copy()
        times[large] = 0
        times = np.repeat(times, in_a)
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys = np.repeat(self.keys[a], times) | b[np.repeat(np.repeat(starts_b, in_a), times) + within].astype(np.uint64)
        more, starts_a = [], np.cumsum(in_a) - in_a
        for g in large:
            of_a = Counter(a[starts_a[g]:starts_a[g] + in_a[g]].tolist())
            of_b = Counter(b[starts_b[g]:starts_b[g] + in_b[g]].tolist())
            more += [(key(x) | y, n * m) for x, n in of_a.items() for y, m in of_b.items()]
        return keys, more


def key(first: int) -> int:
    """A pair's key but for the second id: the radix, then the rest of the first id."""
    return ((first % RADIX) << 16 - (RADIX - 1).bit_length() | first // RADIX) << SECOND


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def opened(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def run_of(keys: np.ndarray) -> bytes:
    """Ascending keys as a compressed run of differences."""
    return squeezed(np.diff(keys, prepend=np.uint32(0)))


def keys_of(run: bytes) -> np.ndarray:
    return np.cumsum(opened(run, np.uint32), dtype=np.uint32)


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Slice:
    """Documents of one task until their links fill a run of each radix."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows, self.links, self.more, self.size = kind, [], [], [], 0

    def add(self, doc_id, pair: Pair, text: str | None) -> None:
        place, found = len(self.rows), pair.aligned(text or "")
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            return
        keys, more = pair.links(*found)
        digest = hashlib.sha256(pair.text_of(*found).encode()).hexdigest()
        self.rows.append((doc_id, len(found[0]), len(found[1]), len(found[2]), len(keys) + sum(n for _, n in more), digest))
        self.links.append(keys << np.uint64(PLACE) | np.uint64(place))
        self.more += [(k << PLACE | place, n) for k, n in more]
        self.size += len(keys) + len(more)

    @property
    def full(self) -> bool:
        return self.size >= LINKS or len(self.rows) >= ROWS

    def records(self, number: int) -> pa.RecordBatch:
        """A row with the documents, and one for each radix: the run of pairs, the documents of each, and for every
        pair-document record the place of the document and how often it has the link."""
        found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.links]), return_counts=True)
        if self.more:
            found = np.concatenate([found, np.array([k for k, _ in self.more], np.uint64)])
            times = np.concatenate([times, np.array([n for _, n in self.more], np.int64)])
            order = np.argsort(found, kind="stable")
            found, times = found[order], times[order]
            heads = np.flatnonzero(np.diff(found, prepend=found[0] + np.uint64(1)))
            found, times = found[heads], np.add.reduceat(times, heads)
        pairs = (found >> np.uint64(PLACE)).astype(np.uint32)
        radix = (pairs >> np.uint32(31 - (RADIX - 1).bit_length())).astype(np.int64)
        borders = np.searchsorted(radix, np.arange(RADIX + 1))
        made = [(-1, None, None, None)]
        for r in range(RADIX):
            here = slice(borders[r], borders[r + 1])
            if here.start < here.stop:
                keys, documents = np.unique(pairs[here], return_counts=True)
                places = squeezed((found[here] & np.uint64((1 << PLACE) - 1)).astype(np.uint16))
                made.append((r, run_of(keys), squeezed(documents.astype(np.int64)), (places, squeezed(times[here].astype(np.int64)))))
        docs = pa.StructArray.from_arrays(
            [pa.array([x[0] for x in self.rows], self.kind), *(pa.array([x[i] for x in self.rows], pa.int64()) for i in range(1, 5)), pa.array([x[5] for x in self.rows], pa.string())],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(made), pa.int64()), pa.array([m[0] for m in made], pa.int32()), *(pa.array([m[i] for m in made], pa.binary()) for i in (1, 2)),
             *(pa.array([m[3] and m[3][i] for m in made], pa.binary()) for i in (0, 1)),
             pa.ListArray.from_arrays(pa.array([0] + [len(self.rows)] * len(made), pa.int32()), docs)],
            names=["slice", "radix", "run", "documents", "places", "times", "docs"])


def spilled(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Every slice's documents and runs: a row with radix -1 for the documents, and one for each radix that has pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, number, open_ = Pair(folder), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            open_ = open_ or Slice(batch.schema.types[0])
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                open_.add(doc_id.as_py(), pair, text.as_py())
                if open_.full:
                    yield open_.records(part << 32 | number)
                    number, open_ = number + 1, Slice(batch.schema.types[0])
        if open_ and open_.rows:
            yield open_.records(part << 32 | number)

    kind = docs.schema["doc_id"].dataType.simpleString()
    inner = FIELDS.replace(" long", ":bigint").replace(" string", ":string").replace(", ", ",")
    return docs.select("doc_id", "text").mapInArrow(
        run, f"slice long, radix int, run binary, documents binary, places binary, times binary, docs array<struct<doc_id:{kind},{inner}>>")


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]]:
    """K-way heap merge, a first id at a time: its pairs' keys, their counts, and where each run has that id."""
    heads = [np.flatnonzero(np.diff(keys >> np.uint32(SECOND), prepend=np.uint32(0xFFFFFFFF))).tolist() + [len(keys)] for keys, _ in runs]
    heap = [(int(keys[0]) >> SECOND, n, 0) for n, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    counts = np.zeros(1 << SECOND, np.int64)
    low = np.uint32((1 << SECOND) - 1)
    while heap:
        first, parts = heap[0][0], []
        while heap and heap[0][0] == first:
            _, n, at = heap[0]
            here = slice(heads[n][at], heads[n][at + 1])
            keys, documents = runs[n]
            counts[keys[here] & low] += documents[here]
            parts.append((n, here))
            if here.stop < len(keys):
                heapq.heapreplace(heap, (int(keys[here.stop]) >> SECOND, n, at + 1))
            else:
                heapq.heappop(heap)
        seconds = np.flatnonzero(counts)
        yield np.uint32(first << SECOND) | seconds.astype(np.uint32), counts[seconds], parts
        counts[seconds] = 0


def _runs(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(keys_of(r.as_py()), opened(d.as_py(), np.int64)) for r, d in zip(table["run"], table["documents"])]


#: Of one radix, a node's run of pairs and each pair's documents; and what comes back: twice the count, and 1 more where no
#: other pair of the first id has a higher one.
RUNS, DUE = "radix int, child long, run binary, documents binary", "radix int, child long, run binary, due binary"


def _summed(group: pa.Table) -> pa.Table:
    """The runs of a node as one run."""
    parts = list(merged(_runs(group)))
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return pa.table({"radix": group["radix"][:1], "child": group["node"][:1], "run": [run_of(keys)], "documents": [squeezed(counts)]})


def _settled(group: pa.Table) -> pa.Table:
    """All runs of a radix: what each of them is due."""
    runs = _runs(group)
    due = [np.zeros(len(keys), np.int64) for keys, _ in runs]
    for keys, counts, parts in merged(runs):
        worth = counts * 2 + (counts == counts.max())
        for n, here in parts:
            due[n][here] = worth[np.searchsorted(keys, runs[n][0][here])]
    return pa.table({"radix": group["radix"], "child": group["child"], "run": group["run"], "due": pa.array(list(map(squeezed, due)), pa.binary())})


def _handed_down(parent: pa.Table, children: pa.Table) -> pa.Table:
    """What a node is due, dealt to the runs that it was merged from."""
    keys, worth = keys_of(parent["run"][0].as_py()), opened(parent["due"][0].as_py(), np.int64)
    due = [squeezed(worth[np.searchsorted(keys, keys_of(r.as_py()))]) for r in children["run"]]
    return pa.table({"radix": children["radix"], "child": children["child"], "run": children["run"], "due": pa.array(due, pa.binary())})


def counted(runs: DataFrame) -> DataFrame:
    """``radix, child, run, due`` for every run of ``radix, child, run, documents``.

    A merge takes about ``FAN`` runs; where there are more, nodes of ``FAN`` runs are merged first, level by level, and
    what a node is due is dealt to its runs on the way back.  So a pair that all documents share costs a merge one record
    a run, and no task holds more than the pairs of one radix of ``FAN`` nodes.
    """
    width = -(-runs.select("child").distinct().count() // FAN)
    level = runs.withColumn("node", F.pmod(F.xxhash64("child"), F.lit(max(1, width))))
    levels = []
    while width > 1:
        levels.append(level)
        up = written(level.groupBy("radix", "node").applyInArrow(_summed, RUNS), "align-level")
        width = -(-width // FAN)
        level = up.withColumn("node", F.floor(F.col("child") / FAN))
    due = level.groupBy("radix").applyInArrow(_settled, DUE)
    for level in reversed(levels):
        above = due.withColumnRenamed("child", "node")
        due = above.groupBy("radix", "node").cogroup(level.groupBy("radix", "node")).applyInArrow(_handed_down, DUE)
    return due


def align(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    Texts are encoded by both vocabularies of ``folder``; tokens of both between two places where both end are linked.
    A pair's count is the number of rows that have it linked; ``n_best`` counts the links whose pair is its first id's
    most frequent, ties included; ``count_sum`` adds the counts of all links.

    Runs and documents are written once; merges read the runs only, and each slice meets what it is due in one group of
    its own, whose size ``LINKS`` and ``ROWS`` bound (a single longer document is a slice of its own).

    NULL and empty texts, and texts that either vocabulary cannot give back byte by byte, have zeros and an empty digest;
    repeated rows count each; NULL ids are kept; groups of any length are linked whole; further columns are not read; an
    empty table gives an empty result.
    """
    slices = written(spilled(docs, folder), "align-runs")
    due = counted(slices.filter("radix >= 0").select("radix", F.col("slice").alias("child"), "run", "documents"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def contribute(own: pa.Table, back: pa.Table) -> pa.Table:
        rows = next(x for r, x in zip(own["radix"].to_pylist(), own["docs"]) if r < 0).values
        best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        worth_of = dict(zip(back["radix"].to_pylist(), back["due"]))
        for i, r in enumerate(own["radix"].to_pylist()):
            if r < 0:
                continue
            worth = np.repeat(opened(worth_of[r].as_py(), np.int64), opened(own["documents"][i].as_py(), np.int64))
            places, times = opened(own["places"][i].as_py(), np.uint16), opened(own["times"][i].as_py(), np.int64)
            np.add.at(best, places, (worth & 1) * times)
            np.add.at(total, places, (worth >> 1) * times)
        fields = {name: rows.field(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(fields | {"n_best": best, "count_sum": total, "groups_sha256": rows.field("groups_sha256")})

    own = slices.select("slice", "radix", "documents", "places", "times", "docs")
    back = due.select(F.col("child").alias("slice"), "radix", "due")
    return own.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(
        contribute, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, groups``: the groups of every row of ``docs`` as text (``a1,a2|b1;a3|b2,b3``), empty without tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(folder)
        for batch in batches:
            made = [pair.text_of(*found) if (found := pair.aligned(t.as_py() or "")) else "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups string")


def pair_counts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``a_id, b_id, documents, best`` for every pair of ids that some row of ``docs`` has linked."""
    slices = written(spilled(docs, folder), "align-runs")
    due = counted(slices.filter("radix >= 0").select("radix", F.col("slice").alias("child"), "run", "documents"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, d in zip(batch.column(0), batch.column(1)):
                keys, worth = keys_of(r.as_py()), opened(d.as_py(), np.int64)
                first = keys >> np.uint32(SECOND)
                rest = 16 - (RADIX - 1).bit_length()
                a = (first & np.uint32((1 << rest) - 1)) * np.uint32(RADIX) + (first >> np.uint32(rest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.astype(np.int32)), pa.array((keys & np.uint32((1 << SECOND) - 1)).astype(np.int32)), pa.array(worth >> 1), pa.array((worth & 1).astype(bool))],
                    names=["a_id", "b_id", "documents", "best"])

    return due.select("run", "due").mapInArrow(listed, "a_id int, b_id int, documents long, best boolean").distinct()
