import base64
import hashlib
import random

import pytest

from pyspark.sql import functions as F

from tidemark.llm import mixing, warc


def expected(rows):
    payload = [(p, (h or "").encode()) for p, h in rows]
    keep = {}
    for p, b in payload:
        if p is not None:
            keep[b] = max(keep.get(b, p), p)
    out = []
    for p, b in payload:
        last = keep.get(b)
        revisit = last is not None and p != last
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0])
def test_archive_round_trip(spark, least):
    long = "".join(random.Random(5).choices("abc é\r\n\U0001F600", k=60_000))
    rows = [(1, "x"), (2, "x"), (3, "y\r\n\r\nWARC/1.1\r\n"), (4, None), (5, ""), (6, long), (6, long), (7, long), (None, "x"), (None, "only"), (2**60 + 1, "z")]
    pages = spark.createDataFrame([(p, "http://a/\r\nb" if p else None, h, "c") for p, h in rows], "page_id long, url string, html string, hex string")
    got = warc.archive(pages, least)
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()], key=str) == expected(rows)
    assert warc.archive(pages.limit(0)).count() == 0


def test_small_payloads_are_all_response(spark):
    pages = spark.createDataFrame([(1, "u", "xx"), (2, "u", "xx"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    assert {r.page_id: r.record_type for r in warc.archive(pages, 5).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_segments_may_be_anywhere(spark, tmp_path):
    payload = bytes(random.Random(1).randbytes(50_000))
    made = list(warc.records(9, "u", payload, "response", None, 4096))
    assert len(made) > 5
    random.Random(2).shuffle(made)
    for i in range(3):
        (tmp_path / f"{i}.warc").write_bytes(b"".join(r + warc.END for r in made[i::3]))
    row = warc.read(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.payload_bytes) for r in row] == [(9, len(payload))]


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        warc.reassembled([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError):
        warc.reassembled([(1, None, b"a"), (2, 9, b"b")])
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    data = bytes(range(256)) * 50
    assert warc.unchunked(warc.chunked(data)) == data and warc.unchunked(warc.chunked(b"")) == b""


def fill(sizes):
    """Targets by sharing the excess again and again."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-6 and open_:
        total, more = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                more += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = more
    return target


def test_mix_meets_targets(make_docs, prose):
    rows = [(i, prose(3 + i % 11, i), "en", ("b", "a", None, "Z", "é", "a", "a")[i % 7]) for i in range(210)]
    rows += [(500, None, "en", "a"), (501, "", "en", "empty"), (502, " \t\n", None, "b"), (None, "x y z", "en", "b"), (3, rows[3][1], "en", "Z"), (600, prose(3000, 9), "en", "b")]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = fill(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        of = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in of)
        assert sum(r.taken for r in of) == int(of[0].target + 1e-9) and all(0 <= r.taken <= 2 * r["size"] for r in of)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select("source", F.size(F.split(F.trim("text"), r"\s+")).alias("w")).groupBy("source").sum("w").collect()
    assert {r[0]: r[1] for r in words} == {s: int(want[s] + 1e-9) for s in sizes if int(want[s] + 1e-9)}


def test_rows_without_ids_spread_over_the_ranges(make_docs, prose):
    docs = make_docs([(None, prose(3, i)) for i in range(300)] + [(5, prose(4, i)) for i in range(20)])
    assert mixing._sized(docs, 3).select("_range").distinct().count() > 200
    first, again = ([tuple(r) for r in mixing.mixed_documents(d).select("doc_id", "text").collect()] for d in (docs, docs.repartition(5)))
    assert sorted(first, key=str) == sorted(again, key=str)


def test_empty_mix(make_docs):
    assert mixing.mix(make_docs([(1, "a")]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
