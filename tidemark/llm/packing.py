"""Packing documents into sequences of a fixed length by bin completion branch-and-bound over the histogram of lengths."""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, written

CAPACITY, END_ID, SPECIAL = 2048, 0, "<|endoftext|>"
CACHED, NODES, BUCKETS = 250_000, 20_000, 1024
#: Steps of each of the two branch-and-bound searches, and of the fillings listed at one node of them.
SEARCH, LISTED = 300_000, 20_000

#: White space around a space: there words cannot be encoded one by one.
_LOOSE = re.compile(r"\s (?:\s|\Z)")


class Words(dict):
    """Bytes of the ids (unsigned 32 bits, little endian) of a piece of text, kept by piece."""

    def __init__(self, encode, before=""):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word):
        if len(self) >= CACHED:
            self.clear()
        found = self[word] = _bytes(self.encode(self.before + word))
        return found


def _bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Encoder:
    """Ids of ``byte_bpe_50k.json``: the same vocabulary in the faster of the two installed libraries, word by word.

    The vocabulary's pattern starts a new match at every space that no other white space touches on both sides, so
    such texts are the sum of their words.  Texts that spell a special token go through the JSON file itself.
    """

    def __init__(self, folder=None):
        import public_tokenizers
        import tiktoken
        self.path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        with open(self.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later, self.whole = Words(self.encode), Words(self.encode, " "), None

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.path("byte_bpe_50k.json"))
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        if _LOOSE.search(text):
            return _bytes(self.encode(text))
        words = text.split(" ")
        later = self.later
        return self.first[words[0]] + b"".join([later[w] for w in words[1:]])


def pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document longer than ``capacity`` is cut so that only its first
    piece may be shorter."""
    def run(batches):
        encoder = Encoder(folder)
        end = _bytes([END_ID])
        for batch in batches:
            rows, ids = [], batch.column(0)
            for at, text in enumerate(batch.column(1)):
                data = encoder.ids(text.as_py() or "") + end
                n = len(data) // 4
                first = n if n <= capacity else (n - 1) % capacity + 1
                stops = [first, *range(first + capacity, n + 1, capacity)]
                rows += [(at, i, a, b - a, zlib.crc32(data[4 * a:4 * b])) for i, (a, b) in enumerate(zip([0, *stops], stops))]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids.take(made[0]), *made[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def completion(space: int, lengths: list[int], counts: dict[int, int], nodes: int = NODES) -> list[int]:
    """The filling of ``space`` with least waste from ``counts`` pieces of each of the ascending ``lengths``.

    Depth-first over fillings in descending order, so the best fit comes first and is the incumbent.  A branch ends
    where even all that is left below the last length could not waste less than the incumbent, and at once where a
    single length closes the gap.  A filling in which a piece could be swapped for a longer one within the waste is
    dominated; it wastes more than the swap, which the same search meets, so it never stays the incumbent.  After
    ``nodes`` steps the incumbent stands; that bound touches the number of sequences only, never the pieces.
    """
    best: list[int] = []
    best_waste = space
    steps = 0
    used: dict[int, int] = {}
    chosen: list[int] = []

    def free(x):
        return counts.get(x, 0) - used.get(x, 0)

    def search(left: int, top: int) -> bool:
        nonlocal best, best_waste, steps
        if left < best_waste:
            best, best_waste = chosen.copy(), left
            if left == 0:
                return True
        at = bisect_right(lengths, min(left, top)) - 1
        while at >= 0:
            x = lengths[at]
            at -= 1
            if free(x) <= 0:
                continue
            steps += 1
            if steps > nodes:
                return True
            # Below x only shorter pieces come; x alone repeated cannot fill more than its multiples and x - 1 each.
            if x == 1 and left - min(left, free(1)) >= best_waste:
                return False
            used[x] = used.get(x, 0) + 1
            chosen.append(x)
            rest = left - x
            if rest and rest <= x and free(rest) > 0:
                best, best_waste = [*chosen, rest], 0
                return True
            if search(rest, x):
                return True
            chosen.pop()
            used[x] -= 1
        return False

    sys.setrecursionlimit(max(sys.getrecursionlimit(), space + 2000))  # one level a piece
    search(space, space)
    return best


def greedy(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, list[int]]]:
    """Fillings with how often each is used, without branching: the first incumbent of ``plan``.

    The longest length left starts a bin, its completion is searched, and the filling is used as often as all its
    lengths allow.  Each use leaves one of its lengths with fewer pieces than a bin of it takes, so the number of
    fillings is bounded by the capacity, not by the rows.
    """
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts)
    out = []
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        filling = [top, *completion(capacity - top, lengths, counts, nodes)]
        counts[top] += 1
        need: dict[int, int] = {}
        for x in filling:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        out.append((times, filling))
        for x, n in need.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
                lengths.remove(x)
    return out


def least(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the sequences: for each length k up to half the capacity, pieces longer than the half take one
    each, and those from k on fill at most what the ones up to the capacity less k leave."""
    lengths = np.array(sorted(counts), np.int64)
    total = [0]
    for x in lengths.tolist():
        total.append(total[-1] + x * counts[x])
    number = [0]
    for x in lengths.tolist():
        number.append(number[-1] + counts[x])
    half = int(np.searchsorted(lengths, capacity // 2, "right"))
    bound = max(-(-total[-1] // capacity), number[-1] - number[half])
    for i in range(half):
        big = int(np.searchsorted(lengths, capacity - int(lengths[i]), "right"))  # from here on no piece of k fits beside
        room = (number[big] - number[half]) * capacity - (total[big] - total[half])
        bound = max(bound, number[-1] - number[half] + max(0, -(-(total[half] - total[i] - room) // capacity)))
    return bound


def fillings(counts: dict[int, int], capacity: int, slack: int, steps: int) -> tuple[list[list[int]], int]:
    """The undominated fillings that hold the longest length and waste ``slack`` at most, by waste, and the steps left.

    A filling is dominated if a piece left over fits into its waste, or fits when it takes the place of a shorter one:
    the piece can change places with what is there in any solution.  A branch ends where all shorter pieces together
    leave more waste than ``slack``.
    """
    lengths = sorted(counts)
    below = [0]
    for x in lengths:
        below.append(min(below[-1] + x * counts[x], capacity))
    top = lengths[-1]
    found: list[tuple[int, list[int]]] = []
    used = {top: 1}

    def undominated(waste: int) -> bool:
        for x in (0, *used):
            at = bisect_right(lengths, x + waste) - 1
            while at >= 0 and lengths[at] > x:
                if counts[lengths[at]] > used.get(lengths[at], 0):
                    return False
                at -= 1
        return True

    def search(left: int, at: int) -> None:
        nonlocal steps
        steps -= 1
        if left <= slack and undominated(left):
            found.append((left, [x for x, n in used.items() for _ in range(n)]))
        at = min(at, bisect_right(lengths, left) - 1)
        while at >= 0 and steps > 0 and left - below[at + 1] <= slack:
            x = lengths[at]
            had = used.get(x, 0)
            for n in range(min(left // x, counts[x] - had), 0, -1):
                if steps <= 0:
                    break
                used[x] = had + n
                search(left - n * x, at - 1)
            if had:
                used[x] = had
            else:
                used.pop(x, None)
            at -= 1

    search(capacity - top, len(lengths) - 1)
    return [f for _, f in sorted(found, key=lambda x: (x[0], [-y for y in x[1]]))], steps


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, steps: int = SEARCH) -> list[tuple[int, list[int]]]:
    """Fillings with how often each is used: bin completion branch-and-bound over the histogram.

    The greedy plan is the incumbent; where it meets the lower bound it is the optimum.  Else the undominated
    fillings of the longest length are branched over, each used as often as its lengths allow and then, in a second
    search, any fewer times too, so that fillings are searched again before one is reused.  A branch ends where its
    sequences and the lower bound of what is left reach the incumbent, or its waste what a better plan may waste.
    The second search ends with the optimum unless it takes more than ``steps`` steps or a node more than LISTED;
    then the incumbent stands, and its gap is at most its distance to ``least``.
    """
    best = greedy(histogram, capacity, nodes)
    counts = {k: v for k, v in histogram.items() if v > 0}
    size = sum(times for times, _ in best)
    bound = least(counts, capacity)
    path: list[tuple[int, list[int]]] = []
    left, seen, fewer = steps, {}, False

    def search(taken: int) -> bool:
        """Whether the search is over."""
        nonlocal best, size, left
        if not counts:
            if taken < size:
                best, size = path.copy(), taken
            return size == bound
        if taken + least(counts, capacity) >= size:
            return False
        state = hash(tuple(sorted(counts.items())))
        if seen.get(state, size) <= taken:
            return False
        seen[state] = taken
        slack = (size - 1 - taken) * capacity - sum(k * v for k, v in counts.items())
        given = min(left, LISTED)
        listed, rest = fillings(counts, capacity, slack, given)
        left -= given - rest + len(counts)  # the bound takes a step a length
        for filling in listed:
            need: dict[int, int] = {}
            for x in filling:
                need[x] = need.get(x, 0) + 1
            most = min(counts[x] // n for x, n in need.items())
            for times in range(most, 0 if fewer else most - 1, -1):
                if left <= 0:
                    return True
                left -= 1
                for x, n in need.items():
                    counts[x] -= times * n
                    if not counts[x]:
                        del counts[x]
                path.append((times, filling))
                over = search(taken + times)
                path.pop()
                for x, n in need.items():
                    counts[x] = counts.get(x, 0) + times * n
                if over:
                    return True
        return False

    for fewer in (False, True):
        if size > bound:
            left, seen = steps, {}
            sys.setrecursionlimit(max(sys.getrecursionlimit(), steps + capacity + 2000))  # a level a filling
            search(0)
    return best


def runs(planned: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, offset`` by length and rank: pieces of a length are dealt to the
    fillings in order of their rank."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for times, filling in planned:
        offset = 0
        for x in filling:
            out.append((x, ranks.get(x, 0), sequence, offset))
            ranks[x] = ranks.get(x, 0) + times
            offset += x
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, where the fillings are searched; pieces
    of one length are interchangeable, so each gets a rank within its length from counts per (length, hash range) and
    takes its place from the table of fillings, whose size is bounded by the capacity.  A length that a third of all
    pieces share is ranked in ``BUCKETS`` ranges, each by its own task.

    NULL and empty texts are the end id alone; NULL ids are kept; repeated rows are packed each; texts of any length
    are cut; an empty table gives an empty result.
    """
    cut = written(pieces(docs, capacity, folder).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")), "pack-pieces")
    sizes = written(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    table = runs(plan(histogram, capacity, nodes))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("length").alias("of_length"), F.col("bucket").alias("of_bucket"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", rank).join(starts, (F.col("length") == F.col("of_length")) & (F.col("bucket") == F.col("of_bucket"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))
    shift = 1 << 48
    keys = table[:, 0] * shift + table[:, 1]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(keys, length * shift + rank, "right") - 1
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
            names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
