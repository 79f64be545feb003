import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing


def grams(text, words):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(ws)} - {()} if len(ws) < words else {tuple(ws[i:i + words]) for i in range(len(ws) - words + 1)}


def brute(rows, words, percent):
    sets = [grams(r[1], words) for r in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), None if r[0] is None else (min(ids) if sets[i] else r[0])))
    return sorted(out, key=str)


def near_copies(prose):
    """Groups of copies that differ in a word or two, chains of them, shared passages and unrelated prose."""
    rng, rows = random.Random(4), []
    for g in range(12):
        base = prose(30 + 40 * (g % 4), g).split()
        for _ in range(g + 1):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(["CHANGED", "other", "zz"])
            base = copy if g % 3 == 0 else base
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    passage = prose(60, 99)
    rows += [(2000 + i, prose(10 + i, 50 + i) + "\n" + passage) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "one two"), (3007, "Ône"), (None, "one"), (3008, prose(5000, 1)), (3009, prose(5000, 1) + " x"), (5, rows[0][1]), (5, rows[0][1])]
    return rows


@pytest.mark.parametrize("words, percent, block", [(3, 90, None), (5, 80, None), (3, 90, 150)])
def test_components_equal_brute_force(make_docs, prose, monkeypatch, words, percent, block):
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "PAIRED", 3)
    rows = near_copies(prose)
    got = ngram_join.jaccard_components(make_docs(rows), words, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, words, percent)


def test_one_of_each_group_stays(make_docs, prose):
    rows = [r for r in near_copies(prose) if r[0] != 5]
    docs = make_docs(rows)
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute(rows, 5, 80) if c is not None}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and kept.count() == len(want)
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0 and ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_frequent_ngrams_lose_no_link(make_docs):
    """Sets of frequent words only: in every task a word is shared by more sets than are paired, and few of those link.

    What holds such sets together must not be ruled out by the signatures of two of them."""
    rng = random.Random(5)
    sets = [rng.sample(range(10), 3) + rng.sample(range(10, 55), 17) for _ in range(2000)]  # the rarer 10 are the prefixes
    for i in range(20):  # near copies far apart: other tasks, other batches
        sets[1999 - i] = sets[i][:19] + [next(w for w in range(10, 55) if w not in sets[i])]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(make_docs([(i, " ".join(f"w{w}" for w in s)) for i, s in enumerate(sets)]), 1, 90).collect()}
    has = np.zeros((2000, 55), np.int64)
    for i, s in enumerate(sets):
        has[i, s] = 1
    shared = has @ has.T
    linked = {(i, j) for i, j in zip(*np.nonzero(100 * shared >= 90 * (40 - shared))) if i < j}
    assert linked == {(i, 1999 - i) for i in range(20)}
    caught = sum(got[1999 - i] == i for i in range(20))
    assert caught == 20, caught
    assert sum(k != v for k, v in got.items()) == 20


def test_one_of_repeated_rows_stays(make_docs, prose):
    text = prose(40, 3)
    rows = [(4, text), (4, text), (4, text), (9, text), (None, prose(30, 5)), (None, prose(30, 5)), (6, ""), (6, ""), (7, None), (7, prose(20, 8)), (4, prose(25, 9))]
    docs = make_docs(rows)
    marked = docs.withColumn("label", F.spark_partition_id())  # other columns of repeated rows may differ
    for d in (docs, marked):
        kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(d, 5, 80).collect()]
        assert sorted(kept, key=str) == sorted([(4, text), (None, rows[4][1]), (6, ""), (6, ""), (7, None), (7, rows[9][1]), (4, rows[10][1])], key=str)


def test_only_rows_that_may_go_are_compared_by_id(spark, make_docs):
    """Rows that the bitmap rules out need no shuffle; no key, NULL ids and texts included, is ruled out."""
    docs = make_docs([(i, f"text {i}") for i in range(500)] + [(None, "a"), (7, None)])
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    keys = rows.filter("_doc IS NULL OR _doc % 10 = 7").select(F.col("_doc").alias("_id"), F.col("_text").alias("_print"))
    others, asked = ngram_join._parted(rows, keys)
    assert (others.count(), asked.count()) == (450, 52) and asked.filter("_doc IS NULL OR _doc % 10 = 7").count() == 52
    assert ngram_join._parted(rows, keys.limit(0))[0].count() == 502


def test_copies_add_little_to_what_the_join_moves(spark, make_docs, prose, monkeypatch):
    """Equal sets of several tasks are routed once; pairs of near copies and their whole sets travel in few bytes."""
    held = {}
    write = ngram_join.written

    def noted(df, label):
        out = write(df, label)
        if label in ("ngram-routes", "ngram-pairs"):
            held[label] = out.select(F.explode("names")).count() if label == "ngram-routes" else out.count()
        return out
    monkeypatch.setattr(ngram_join, "written", noted)
    base = [prose(60, i) for i in range(20)]
    docs = make_docs([(100 * k + i, t) for k in range(6) for i, t in enumerate(base)]).repartition(6)
    got = ngram_join.jaccard_components(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(100 * k + i, i) for k in range(6) for i in range(20)}
    assert held == {"ngram-routes": 20, "ngram-pairs": 0}

    rows = [(i, " ".join(prose(400, 7).split() + [f"w{i}"])) for i in range(8)]
    whole = ngram_join.whole_sets(make_docs(rows), 3, np.full(ngram_join.BITS // 8, 255, np.uint8)).collect()
    assert len(whole) == 8 and sum(len(r.packed) for r in whole) < 0.6 * sum(8 * r.n for r in whole)
    numbers = np.array([(k << 20) + 40 * i + 7 * k for i in range(300) for k in range(12)]).reshape(300, 12)
    pairs = np.array([(x, y, 200 + j % 3, 201 + i % 2, 1) for c in numbers for i, x in enumerate(c) for j, y in enumerate(c) if x < y])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    packed = ngram_join._packed_pairs(pairs)
    assert (ngram_join._unpacked_pairs(packed) == pairs).all() and len(packed) < 5 * len(pairs)
    frequent = pairs.copy()
    frequent[:, 2:4] = -1
    assert (ngram_join._unpacked_pairs(ngram_join._packed_pairs(frequent)) == frequent).all()
    twice = ngram_join._summed_pairs(np.concatenate([frequent, pairs, pairs]))
    assert len(twice) == 2 * len(pairs) and (twice[twice[:, 2] > 0, 4] == 2).all() and (twice[twice[:, 2] < 0, 4] == 1).all()


def test_prefixes_share_as_many_ngrams_as_links_need():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 10, 19, 64, 130, 400):
        for percent in (50, 80, 90):
            for cut in range(0, n // 4 + 1):
                a = np.sort(rng.choice(2000, n, replace=False))
                b = np.sort(np.r_[a[rng.permutation(n)[cut:]], rng.choice(np.arange(2000, 4000), rng.integers(0, cut + 1), replace=False), rng.choice(np.arange(-500, 0), rng.integers(0, cut + 1), replace=False)])
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (n + len(b) - both):
                    shared = np.intersect1d(*(x[:ngram_join.prefix_length(len(x), percent)] for x in (a, b)))
                    assert len(shared) >= ngram_join.least_shared(np.array([n]), np.array([len(b)]), percent)[0]


def test_prefix_tree_finds_all_links():
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(40), rng.randint(5, 30))) for _ in range(120)]
    sets += [sorted(set(s) - {rng.choice(s)}) for s in sets[:60]]
    sizes = [len(s) for s in sets]
    for percent in (60, 80, 90):
        tree, found = ngram_join.PrefixTree(sizes, percent, {}), set()
        for i, s in enumerate(sets):
            found |= {(j, i) for j in tree.probe(i, s)}
            tree.parent = {}
            tree.insert(i, s)
            tree.root.mixed = True
            for node in _nodes(tree.root):
                node.mixed = True
        want = {(j, i) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))}
        assert found == want


def _nodes(node):
    for kid in node.kids.values():
        yield kid
        yield from _nodes(kid)


def test_signature_never_rules_out_a_link():
    rng = np.random.default_rng(0)
    for n in (100, 2040, 2100, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: int(0.96 * n)], rng.integers(0, 1 << 63, n // 40).astype(np.uint64)])
        assert ngram_join.may_link(ngram_join.signature(a), len(a), ngram_join.signature(b), len(b), 90)
        c = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert not ngram_join.may_link(ngram_join.signature(a), len(a), ngram_join.signature(c), len(c), 90)


def check_packing(rows, got, encode, capacity):
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in rows:
        ids = [*encode(text or ""), 0]
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:]) and len(own) == -(-len(ids) // capacity)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_pack_every_piece(make_docs, prose):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    texts = [prose(n, n) for n in (3, 40, 41, 300, 301, 900, 4000, 20_000)] + [prose(40, 40)] * 9 + [
        None, "", " ", "a  b", "x \n y", "tab\t z ", "it's  'quoted' don't", "naïve — 日本語 　 x", "<|endoftext|> in text", "\n \n x", "end \n", "a\x85 b\x1c c"]
    rows = list(enumerate(texts))
    got = packing.pack(make_docs(rows)).collect()
    n = check_packing(rows, got, encode, 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(make_docs(rows).limit(0)).count() == 0
    twice = packing.pack(make_docs([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_places_all_and_nears_the_optimum(lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    planned = packing.plan(histogram, 20)
    placed = {}
    for times, filling in planned:
        assert sum(filling) <= 20
        for x in filling:
            placed[x] = placed.get(x, 0) + times
    assert placed == histogram
    assert sum(t for t, _ in planned) <= least_bins(tuple(sorted(lengths, reverse=True)), 20) + 1


def least_bins(lengths, capacity):
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:k]:
                go(i + 1, rooms[:k] + (room - lengths[i],) + rooms[k + 1:])
        go(i + 1, rooms + (capacity - lengths[i],))
    go(0, ())
    return best[0]


def test_many_equal_and_tiny_pieces():
    planned = packing.plan({1: 10**12, 700: 10**11, 2048: 5, 1348: 10})
    assert sum(t * len(f) for t, f in planned) == 10**12 + 10**11 + 15
    used = sum(t for t, _ in planned)
    assert used >= -(-(10**12 + 700 * 10**11 + 2048 * 5 + 13480) // 2048)


def test_plan_branches_over_alternative_fillings():
    lengths = (503, 623, 655, 737, 763, 770, 803, 828)
    for copies, want in ((1, 3), (3000, 9000)):
        planned = packing.plan({x: copies for x in lengths})
        assert sum(t for t, _ in planned) == want and all(sum(f) <= 2048 for _, f in planned)
        assert all(sum(t * f.count(x) for t, f in planned) == copies for x in lengths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_is_the_optimum(lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    want = least_bins(tuple(sorted(lengths, reverse=True)), 20)
    assert packing.least(histogram, 20) <= want == sum(t for t, _ in packing.plan(histogram, 20))
