"""Fill-in-middle: a text's prefix, middle and suffix change places by block rotations in one bytearray."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

#: Before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = tuple(m.decode() for m in (PREFIX, SUFFIX, MIDDLE))


def exchange(buffer: bytearray, start: int, border: int, stop: int) -> None:
    """Swap the neighbouring blocks [start, border) and [border, stop) in place: reverse each, then both together."""
    for a, b in ((start, border), (border, stop), (start, stop)):
        buffer[a:b] = buffer[a:b][::-1]


def draws(doc_id, seed: str) -> list[int]:
    """Four unsigned 32-bit numbers from a document's id; NULL counts as the empty string."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * i:8 * i + 8], 16) for i in range(4)]


def plan(text: str, doc_id, plain_from: int, spm_below: int, seed: str) -> tuple[str, int, int]:
    """Form, and the code points before the middle and before the suffix."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= plain_from or any(m in text for m in MARKS):
        return "plain", 0, 0
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return "spm" if h4 % 100 < spm_below else "psm", first, second


def rotate(text: str, form: str, first: int, second: int) -> bytes:
    """The output's UTF-8: marks go in at the cuts, then the blocks are rotated to the order of ``form``."""
    buffer = bytearray(text, "utf-8")
    if form == "plain":
        return buffer
    if len(buffer) == len(text):
        middle, suffix = first, second
    else:
        middle = len(text[:first].encode())
        suffix = middle + len(text[first:second].encode())
    buffer[suffix:suffix] = SUFFIX
    buffer[middle:middle] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = middle + len(PREFIX), suffix + len(PREFIX) + len(MIDDLE)
    if form == "psm":
        exchange(buffer, middle, suffix, len(buffer))
    else:
        exchange(buffer, 0, suffix, len(buffer))
    return buffer


def unrotate(output: str, form: str) -> bytes:
    """The text's UTF-8 from the output and its form.

    Texts that hold a mark stay plain, and no mark can begin inside another one, so the only marks of an output are
    those that ``rotate`` put in.
    """
    buffer = bytearray(output, "utf-8")
    if form == "plain":
        return buffer
    size = len(buffer)
    if form == "psm":  # <P>prefix <S>suffix <M>middle
        tail, last = buffer.index(SUFFIX), buffer.index(MIDDLE)
        exchange(buffer, tail, last, size)
        middle, suffix = tail, tail + size - last
    else:  # <S>suffix <P>prefix <M>middle
        head, last = buffer.index(PREFIX), buffer.index(MIDDLE)
        exchange(buffer, 0, head, size)
        middle, suffix = last - head, size - head
    for at, mark in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at:at + len(mark)]
    return buffer


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def transform(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: str = "1") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    Cuts and form come from a hash of ``seed`` and the id, so a rerun agrees: of 100 documents ``plain_from`` are
    transformed, of 100 of those ``spm_below`` to suffix, prefix, middle (spm), the others to prefix, suffix, middle
    (psm).  Text by text, without a shuffle.

    NULL and empty texts and texts that hold a mark stay plain; rows with one id, repeated or not, are cut by the same
    draws, NULL ids by those of the empty string; a long text needs a small multiple of its own size; further columns
    are not read; an empty table gives an empty result.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, forms, outputs = batch.column(0), [], [], []
        cuts: list[tuple] = []
        for doc_id, cell in zip(ids, batch.column(1)):
            text = cell.as_py() or ""
            form, first, second = plan(text, doc_id.as_py(), plain_from, spm_below, seed)
            sizes.append(len(text))
            forms.append(form)
            cuts.append((None, None) if form == "plain" else (first, second - first))
            outputs.append(bytes(rotate(text, form, first, second)))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), *(pa.array([c[i] for c in cuts], pa.int64()) for i in (0, 1)), _text(outputs)],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame) -> DataFrame:
    """The columns of ``transformed`` and ``restored``, the exact text rebuilt from ``output`` and ``form`` alone.

    A NULL output or form gives NULL; all other cases are those of ``transform``.
    """
    output, form = transformed.columns.index("output"), transformed.columns.index("form")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [None if o is None or f is None else bytes(unrotate(o, f)) for o, f in ((o.as_py(), f.as_py()) for o, f in zip(batch.column(output), batch.column(form)))]
        return pa.RecordBatch.from_arrays([*batch.columns, _text(made)], names=[*batch.schema.names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return map_batches(transformed, run, f"{fields}, restored string")


def digests(docs: DataFrame) -> DataFrame:
    """Cuts, form and the SHA-256 of output and restored text of every document."""
    return restore(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS d3,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d4
  FROM hashed
), formed AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 90 THEN 'plain'
              WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM formed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
