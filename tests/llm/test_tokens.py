import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import alignment, byte_pairs, fill_in_middle

PIECES = ["a", "ab", "b", "  ", " ", "\n", "\t", "é", "ß", "1", "23", ".", "'s", "'", "the", " the", "ing", "<|endoftext|>", "<|endof",
          "<s>", "<P>", "<S>", "<M>", "<P", "aaaa", "　", "\x1c", "\x85", "😀", "中文", "zz", "▁", "\x00", "́", "​"]
texts = st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=12).map("".join)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(6)
    found = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    found += [(200 + i, prose(20 + 15 * i, i)) for i in range(12)]
    found += [(None, None), (None, "no id"), (300, None), (301, ""), (302, " "), (303, "one"), (303, "one"), (304, "ONE"), (305, prose(9000, 3)), (306, "x" * 30_000)]
    return found


# byte pairs

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.Encoder()


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_and_decoded_text_are_the_librarys(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(encoder.ids(text), np.int32)
    assert got.tolist() == want
    assert encoder.vocabulary.decode(got).decode() == library.decode(want, skip_special_tokens=False) == text


def merged_by_rank(vocabulary, data):
    """Merge the earliest pair, the leftmost of several, until there is none."""
    found = {b: i for i, b in enumerate(vocabulary.bytes) if len(b) == 1}
    ids = [found[bytes([b])] for b in data]
    while True:
        best = min(((vocabulary.merged[p], n) for n, p in enumerate(zip(ids, ids[1:])) if p in vocabulary.merged), default=None)
        if best is None:
            return ids
        ids[best[1]:best[1] + 2] = [best[0]]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeghinorst' ", max_size=24) | st.binary(max_size=12).map(lambda b: b.decode("latin-1")))
def test_backtracking_gives_the_merges(encoder, text):
    data = text.encode()
    assert encoder.vocabulary.encode_bytes(data) == merged_by_rank(encoder.vocabulary, data)


def test_pair_table_says_whether_merging_keeps_the_border(encoder):
    rng, v = random.Random(2), encoder.vocabulary
    for _ in range(2000):
        a, b = rng.randrange(3000), rng.randrange(3000)
        assert v.compatible((a, b)) == (merged_by_rank(v, v.bytes[a] + v.bytes[b]) == [a, b])


def test_long_stretches_and_broken_bytes(library, encoder):
    rng = random.Random(3)
    for text in ("ab" * 40_000, " " * 30_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(40_000))):
        assert np.frombuffer(encoder.ids(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    cut = np.array(library.encode("中文😀x", add_special_tokens=False).ids[1:], np.int32)
    assert encoder.vocabulary.decode(cut).decode("utf-8", "replace") == library.decode(cut.tolist(), skip_special_tokens=False)


def test_vocabulary_out_of_merge_order_is_refused(tmp_path):
    import json
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ba": 2, "ab": 3}, "merges": [["a", "b"], ["b", "a"]]}}))
    with pytest.raises(ValueError, match="merges"):
        byte_pairs.Vocabulary(str(path))


def test_byte_pair_query(make_docs, rows, library):
    docs = make_docs(rows)
    got = sorted(map(tuple, byte_pairs.digests(docs).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert got == sorted(want, key=str)
    assert byte_pairs.digests(docs.limit(0)).count() == 0


# fill in middle

def plain_version(doc_id, text):
    text = text or ""
    h = [int(x, 16) for x in (lambda s: [s[i:i + 8] for i in range(0, 32, 8)])(sha(f"1:{'' if doc_id is None else doc_id}"))]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle_query(make_docs, rows):
    docs = make_docs(rows)
    got = sorted(map(tuple, fill_in_middle.digests(docs).collect()), key=str)
    assert got == sorted((plain_version(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(texts, st.sampled_from(["psm", "spm"]), st.data())
def test_rotations_are_undone(text, form, data):
    if any(m in text for m in fill_in_middle.MARKS):
        return
    a, b = sorted((data.draw(st.integers(0, len(text))), data.draw(st.integers(0, len(text)))))
    out = bytes(fill_in_middle.rotate(text, form, a, b)).decode()
    p, m, s = text[:a], text[a:b], text[b:]
    assert out == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert bytes(fill_in_middle.unrotate(out, form)).decode() == text


def test_restore_keeps_other_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "psm"), (2, "<P>a<S>c<M>b", "psm"), (3, "x", None)], "k int, output string, form string")
    assert [tuple(r) for r in fill_in_middle.restore(df).orderBy("k").collect()] == [(1, None, "psm", None), (2, "<P>a<S>c<M>b", "psm", "abc"), (3, "x", None, None)]


# alignment

class Plain:
    """Groups by both libraries themselves, and counts in one dictionary."""

    def __init__(self):
        self.first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.letters = byte_pairs.byte_letters()

    def groups(self, text):
        if not text:
            return []
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        of_a = [bytes(self.letters[c] for c in self.first.id_to_token(i)) for i in a]
        pieces = [self.second.id_to_piece(i) for i in b]
        of_b = [bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum(list(map(len, of_a))), np.cumsum(list(map(len, of_b)))
        out, last = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            out.append(([x for x, e in zip(a, ends_a) if last < e <= end], [y for y, e in zip(b, ends_b) if last < e <= end]))
            last = end
        return out

    def rows(self, rows):
        groups, count, top = [self.groups(t) for _, t in rows], Counter(), defaultdict(int)
        for g in groups:
            count.update({(x, y) for a, b in g for x in a for y in b})
        for (x, _), n in count.items():
            top[x] = max(top[x], n)
        out = []
        for (doc_id, _), g in zip(rows, groups):
            links = [(x, y) for a, b in g for x in a for y in b]
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links),
                        sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha(text) if g else ""))
        return out, {(x, y, n, n == top[x]) for (x, y), n in count.items()}


@pytest.mark.parametrize("links, fan, listed", [(1 << 21, 32, 4096), (400, 2, 3)])
def test_alignment_equals_brute_force(make_docs, rows, prose, monkeypatch, links, fan, listed):
    """Also over many slices, several levels of merges, and groups whose different pairs are listed."""
    monkeypatch.setattr(alignment, "LINKS", links)
    monkeypatch.setattr(alignment, "FAN", fan)
    monkeypatch.setattr(alignment, "LISTED", listed)
    rows = [r for r in rows if len(r[1] or "") < 5000] + [(400 + i, prose(40, 77)) for i in range(30)]
    want, pairs = Plain().rows(rows)
    docs = make_docs(rows)
    assert sorted(map(tuple, alignment.align(docs).collect()), key=str) == sorted(want, key=str)
    if fan == 2:
        assert set(map(tuple, alignment.pair_counts(docs).collect())) == pairs
        text = {tuple(r) for r in alignment.groups(docs).collect()}
        assert {(d, sha(t) if t else "") for d, t in text} == {(w[0], w[-1]) for w in want}
    assert alignment.align(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(texts)
def test_groups_of_any_text(aligner, text):
    pair, plain = aligner
    found, want = pair.aligned(text), plain.groups(text)
    assert (pair.text_of(*found) if found else "") == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Pair(), Plain()


def test_heap_merge_counts_and_orders():
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(7):
        keys = np.unique(rng.integers(0, 6 << alignment.SECOND, 300).astype(np.uint32))
        runs.append((keys, rng.integers(1, 9, len(keys))))
    want = Counter()
    for keys, n in runs:
        want.update(dict(zip(keys.tolist(), n.tolist())))
    got = [(k, n) for keys, counts, _ in alignment.merged(runs) for k, n in zip(keys.tolist(), counts.tolist())]
    assert got == sorted(want.items())
    for keys, _ in runs:
        assert (alignment.keys_of(alignment.run_of(keys)) == keys).all()
