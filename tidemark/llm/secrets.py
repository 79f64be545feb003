"""Secrets in texts: fixed patterns, and formats learned by grammar inference from what the patterns find."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_sample, map_batches, written

#: The patterns by kind and the least length of what must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
LEARNED = "format"

#: Candidates for the learned formats: whole runs of the characters that credentials have, as long as the shortest of
#: them, without dots at their ends.  A task keeps the verdict on so many.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
KEPT = 200_000
#: What a text must hold before the patterns above are tried on it.
HINTS = (r"(?i)(password|passwd|secret|token|api_?key)", r"AKIA", r"[0-9a-f]{16}")

SAMPLE, ALPHA, QUANTILE, SPREAD, UNSEEN = 1000, 0.05, 0.01, 0.75, 1e-3
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
#: How ordinary tokens spend their characters on the classes: words, words in capitals, numbers; and the bits a character by
#: which a format must do better than all three.
ORDINARY, MARGIN = ((0.08, 0.20, 0.64, 0.015, 0.035, 0.03), (0.08, 0.015, 0.035, 0.20, 0.64, 0.03), (0.90, 0.01, 0.02, 0.01, 0.02, 0.04)), 0.3
CLASS_OF = {c: i for i, group in enumerate(CLASSES) for c in group}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, credential`` of the fixed patterns, by start, then kind."""
    found = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found, key=lambda x: (x[0], x[2]))]


class Automaton:
    """A probabilistic automaton: per state its count, its ends and for each class the count and next state."""

    def __init__(self, counts, ends, steps, length, floor=None):
        self.counts, self.ends, self.steps, self.length, self.floor = counts, ends, steps, length, floor

    def score(self, value: str) -> float:
        """Mean log2 likelihood of a character, the end included; unseen steps cost UNSEEN and stay in their state.

        The end has the share that it has in the median of the automaton's own values, so values of all lengths compare.
        """
        at, total = 0, 0.0
        for ch in value:
            c = CLASS_OF[ch]
            n, nxt = self.steps[at].get(c, (0, at))
            total += math.log2((n / self.counts[at] if n else UNSEEN) / len(CLASSES[c]))
            at = nxt
        end = math.log2(max(self.ends[at] / self.counts[at], UNSEEN))
        return (total / len(value) * self.length + end) / (self.length + 1)

    def accepts(self, value: str) -> bool:
        score = self.score(value)
        return score >= self.floor and score - ordinary(value) >= MARGIN


def ordinary(value: str) -> float:
    """Mean log2 likelihood of a character of the ordinary token that fits best."""
    counts = Counter(map(CLASS_OF.__getitem__, value))
    return max(sum(n * math.log2(shares[c] / len(CLASSES[c])) for c, n in counts.items()) for shares in ORDINARY) / len(value)


def infer(values: list[str], alpha: float = ALPHA, quantile: float = QUANTILE) -> Automaton:
    """Merge compatible states of the prefix tree of ``values``, in order of length.

    Two states are compatible if the shares of their ends and of each step differ by less than the Hoeffding bound at
    ``alpha``, and so do the states they step to.  Merging folds the later state's subtree into the earlier one.  The
    automaton's floor is the ``quantile`` of the scores of its own values, but not more than SPREAD below their median,
    as some of what the patterns find is no credential.
    """
    counts, ends = [0], [0]
    kids: list[dict[int, list[int]]] = [{}]  # class -> [count, state]
    for value in values:
        at = 0
        counts[0] += 1
        for ch in value:
            step = kids[at].get(CLASS_OF[ch])
            if step is None:
                counts.append(0)
                ends.append(0)
                kids.append({})
                step = kids[at][CLASS_OF[ch]] = [0, len(counts) - 1]
            step[0] += 1
            at = step[1]
            counts[at] += 1
        ends[at] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x, n, y, m):
        return abs(x / n - y / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = counts[a], counts[b]
            if differ(ends[a], n, ends[b], m):
                return False
            for c in kids[a].keys() | kids[b].keys():
                x, y = kids[a].get(c), kids[b].get(c)
                if differ(x[0] if x else 0, n, y[0] if y else 0, m):
                    return False
                if x and y and x[1] != y[1]:
                    todo.append((x[1], y[1]))
        return True

    def fold(a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            counts[a] += counts[b]
            ends[a] += ends[b]
            for c, (n, y) in kids[b].items():
                x = kids[a].get(c)
                if x is None:
                    kids[a][c] = [n, y]
                else:
                    x[0] += n
                    todo.append((x[1], y))

    kept, queue = [0], deque((0, c) for c in sorted(kids[0]))
    known = {0}
    while queue:
        parent, c = queue.popleft()
        blue = kids[parent][c][1]
        if blue in known:
            continue
        red = next((r for r in kept if compatible(r, blue)), None)
        if red is None:
            kept.append(blue)
            known.add(blue)
            queue.extend((blue, k) for k in sorted(kids[blue]))
        else:
            kids[parent][c][1] = red
            before = {r: set(kids[r]) for r in kept}
            fold(red, blue)
            queue.extend((r, k) for r in kept for k in sorted(set(kids[r]) - before[r]))
    place = {s: i for i, s in enumerate(kept)}
    made = Automaton([counts[s] for s in kept], [ends[s] for s in kept],
                     [{c: (n, place[y]) for c, (n, y) in kids[s].items() if y in place} for s in kept], sorted(map(len, values))[len(values) // 2])
    scores = sorted(made.score(v) for v in values)
    made.floor = max(scores[int(quantile * (len(scores) - 1))], scores[len(scores) // 2] - SPREAD)
    return made


def _hinted(texts: pa.Array, patterns) -> pa.Array:
    hit = None
    for p in patterns:
        found = pc.match_substring_regex(texts, p)
        hit = found if hit is None else pc.or_(hit, found)
    return pc.fill_null(hit, False)


def labelled(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """At most ``sample`` different credentials of each kind, those with the least hashes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).filter(_hinted(batch.column(0), HINTS))
        found = {(k, v) for t in texts for _, _, k, v in base_spans(t.as_py())}
        return pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in found], pa.string()), "value": pa.array([v for _, v in found], pa.string())})

    values = written(map_batches(docs.select("text"), run, "kind string, value string").distinct(), "secret-labels")
    return {k: [r[0] for r in hashed_sample(values.filter(F.col("kind") == k).select("value"), "value", sample).collect()] for k in KINDS}


def learn(docs: DataFrame, sample: int = SAMPLE) -> list[Automaton]:
    return [infer(values) for values in labelled(docs, sample).values() if values]


class Verdicts(dict):
    """Whether some automaton accepts a candidate: as likely there as its own values are, and clearly likelier than as an
    ordinary token."""

    def __init__(self, automata: list[Automaton]):
        super().__init__()
        self.automata = automata

    def __missing__(self, value: str) -> bool:
        if len(self) >= KEPT:
            self.clear()
        found = self[value] = any(g.accepts(value) for g in self.automata)
        return found


def learned_spans(text: str, base: list, verdicts: Verdicts) -> list[tuple[int, int, str, str]]:
    """Accepted candidates, but for those inside a base span; one that reaches beyond a base span stands beside it."""
    out, i, covered = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        value = m[0].lstrip(".")
        a = b - len(value)
        value = value.rstrip(".")
        b = a + len(value)
        while i < len(base) and base[i][0] <= a:
            covered = max(covered, base[i][1])
            i += 1
        if len(value) >= LEAST["assign"] and b > covered and verdicts[value]:
            out.append((a, b, LEARNED, value))
    return out


def spans_of(texts: pa.Array, verdicts: Verdicts) -> Iterator[tuple[list, list]]:
    """Base spans and learned spans of each text; NULL has none."""
    for text, hinted in zip(texts, _hinted(texts, HINTS)):
        text = text.as_py() or ""
        base = base_spans(text) if hinted.as_py() else []
        yield base, learned_spans(text, base, verdicts) if verdicts.automata else []


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def _ordered(base, more):
    place = {k: i for i, k in enumerate((*KINDS, LEARNED))}
    return sorted(base + more, key=lambda x: (x[0], place[x[2]]))


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: ``doc_id``, counts of each kind, the digest of the base spans, and all spans.

    The automata are learned first, from at most ``sample`` different credentials of each kind over all documents
    (hash order, so the same in every run); then every text is scanned whole, in one pass without a shuffle.

    NULL or empty texts have no spans and the digest of the empty string; repeated rows are scanned each; without
    any credential in the table there is no automaton and nothing is added; an empty table gives an empty result.
    """
    verdicts = Verdicts(learn(docs, sample))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, more in spans_of(batch.column(1), verdicts):
            kinds = [k for _, _, k, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(_ordered(base, more)), len(more)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redact(docs: DataFrame, mark: str = "[SECRET]", sample: int = SAMPLE) -> DataFrame:
    """The documents with every span replaced by ``mark`` and ``n_chars``, where there is one, counted anew; all columns and rows stay."""
    verdicts = Verdicts(learn(docs, sample))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at)
        made = texts.to_pylist()
        for i, (base, more) in enumerate(spans_of(texts, verdicts)):
            if base or more:
                made[i] = _replaced(made[i], base + more, mark)
        columns = list(batch.columns)
        columns[at] = pa.array(made, texts.type)
        if size is not None:
            counted = [n if t is None else len(t) for n, t in zip(columns[size].to_pylist(), made)]
            columns[size] = pa.array(counted, columns[size].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, run, docs.schema)


def _replaced(text: str, spans, mark: str) -> str:
    out, last = [], 0
    for a, b, _, _ in sorted(spans):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join(out) + text[last:]
