import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import anchors, common, graph, partenum, shingles, suffixes
from tests.llm.helpers import corpus, frame


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, linked):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if linked(x, y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d, _ in rows}


def jaccard(x, y):
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def test_shingle_sets_equal_python():
    texts = [t for _, t, _, _ in corpus()]
    for block in [list(shingles.blocks(texts))[0]]:
        hashes, n = shingles.sets(block)
        assert n.tolist() == [len(shingle_set(t)) for t in texts]
        parts = np.split(hashes, np.cumsum(n)[:-1])
        for i in range(0, len(texts), 3):
            for j in range(1, len(texts), 5):
                a, b = shingle_set(texts[i]), shingle_set(texts[j])
                assert len(np.intersect1d(parts[i], parts[j])) == len(a & b)


def thue_morse(n):
    """Two words of 2**n letters that every polynomial in an odd base takes for one, modulo 2**64, from n = 11 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_word_hashes_tell_words_apart():
    words = [w for n in range(1, 13) for w in thue_morse(n)] + [c * n for c in "ab0" for n in (1, 7, 8, 9, 16, 63, 64, 65, 200)] + ["a\0", "\0a", "\0", "\0\0", "é", "É", "e", "x" * 8 + "y", "y" + "x" * 8]
    words = list(dict.fromkeys(words))
    hashes, n = shingles.word_hashes([w.encode() for w in words])
    assert n.tolist() == [1] * len(words) and len(set(hashes.tolist())) == len(words)
    again, n = shingles.word_hashes([(" \t\x0b".join(words)).upper().replace("É", "É").encode(), b"", b" \n"])
    lower = [w.encode().lower() for w in words]
    known = dict(zip(lower, hashes.tolist(), strict=True))
    assert n.tolist() == [len(words), 0, 0]
    assert all(h == known[w.upper().encode().lower()] for w, h in zip(words, again.tolist(), strict=True) if w != "é")


def test_join_does_not_take_such_words_for_one(spark):
    a, b = thue_morse(11)
    rows = [(1, f"{a} p q r s", None, None), (2, f"{b} p q r s", None, None)]
    assert {(r.doc_id, r.n_links, r.component_id) for r in partenum.joined(frame(spark, rows)).collect()} == {(1, 0, 1), (2, 0, 2)}


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 300), st.floats(0, 1), st.integers(0, 2**32))
def test_linked_sets_share_a_signature(n, share, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 1 << 63, n, dtype=np.uint64)
    differ = rng.integers(0, n // 3 + 1)
    gone = int(round(differ * share))
    y = np.concatenate([x[gone:], rng.integers(1, 1 << 63, differ - gone, dtype=np.uint64)])
    same = n - gone
    if 100 * same >= 75 * (n + len(y) - same) and differ:
        x, y = np.sort(x), np.sort(y)
        sig, whose = partenum.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert np.intersect1d(sig[whose == 0], sig[whose == 1]).size
        a, b = (partenum.sketches(z, np.array([len(z)]))[0] for z in (x, y))
        assert partenum.may_link(a, b, 75) and partenum.do_link(x.tobytes(), y.tobytes(), 75)
        assert len(partenum.close([a], [b], np.ones((1, 1), bool), 75)[0]) == 1


@pytest.mark.parametrize("few,together", [(8, 2000), (1, 3)])
def test_join_equals_brute_force(spark, monkeypatch, few, together):
    monkeypatch.setattr(partenum, "FEW", few)
    monkeypatch.setattr(partenum, "TOGETHER", together)
    rows = corpus(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.joined(frame(spark, rows)).collect()}
    sets = sorted((d, shingle_set(t)) for d, t, _, _ in rows)
    want = components(sets, jaccard)
    assert got == {d: (len(s), want[d]) for d, s in sets}


@pytest.mark.parametrize("few,together", [(3, 2000), (1, 7)])
def test_link_counts_equal_brute_force(spark, monkeypatch, few, together):
    """Near copies of one text, whose signatures make stars: leaves link with leaves."""
    monkeypatch.setattr(partenum, "FEW", few)
    monkeypatch.setattr(partenum, "TOGETHER", together)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = corpus(1)
    for d in range(5000, 5040):
        mine = list(words)
        for k in range(rng.randrange(5)):
            mine[rng.randrange(120)] = f"x{d}y{k}"
        rows.append((d, " ".join(mine), None, None))
    rows += [(d + 1000, t, None, None) for d, t, *_ in rows[-4:]]
    sets = [(d, shingle_set(t)) for d, t, *_ in rows]
    want = {d: sum(jaccard(s, z) for e, z in sets if e != d) for d, s in sets}
    got = {r.doc_id: r.n_links for r in partenum.joined(frame(spark, rows)).collect()}
    assert got == want


def test_sets_that_signatures_cannot_tell_apart_are_pairs(spark):
    """Sets with one short fingerprint, beside a proposed pair of it and sizes that rule a link out."""
    classes = spark.createDataFrame([(5, 1, 100), (5, 2, 100), (6, 3, 90), (7, 4, 10), (7, 5, 90)], "short long, rep long, n long")
    asked = partenum.sized(classes, spark.createDataFrame([(5, 6), (6, 7)], "a long, b long"), 75)
    assert sorted((min(r), max(r)) for r in map(tuple, asked.collect())) == [(1, 2), (1, 3), (2, 3), (3, 5)]


def test_packed_signatures_take_as_many_bytes_in_any_number_of_ranges():
    rng = np.random.default_rng(1)
    sig, prints = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2), rng.integers(1, 1 << 62, 200)
    for buckets in (1, 7, 500, 70_000):
        packer = partenum._Packer(buckets)
        packer.add(prints, sig, np.arange(1000) % 200)
        packer.add(prints, sig, np.arange(1000) % 200)  # sets that it knows
        rows = list(packer.rows())
        assert sum(len(x) for _, x in rows) == 12_000 and all(0 <= b < buckets for b, _ in rows)
        low, mine = (np.concatenate(x) for x in zip(*(partenum.unpack(x) for _, x in rows), strict=True))
        want = sorted(zip((sig & np.uint64((1 << 48) - 1)).tolist(), partenum.short(prints)[np.arange(1000) % 200].tolist(), strict=True))
        assert sorted(zip(low.tolist(), mine.tolist(), strict=True)) == want


def test_blocks_follow_the_bytes(spark):
    docs = frame(spark, [(i, "ab" * 500, None, None) for i in range(100)] + [(None, None, None, None)])
    assert common.pieces(docs, "text", 1000, 3) == 100 and common.pieces(docs, "text", 10**6, 3) == 3 and common.pieces(docs.limit(0), "text", 10, 2) == 2


def test_columns_with_the_names_used_inside_pass_through(spark):
    inside = ("block", "Block_", "n_bytes", "KEPT_", "n_removed", "print", "gone", "rep", "n", "component")
    docs = frame(spark, corpus(3)).withColumns({c: F.lit(c) for c in inside})
    for stage in (suffixes.without_repeats, partenum.representatives):
        out = stage(docs)
        assert out.columns == docs.columns
        assert out.filter(" OR ".join(f"`{c}` != '{c}'" for c in inside)).count() == 0 and out.filter("kept AND size = 7").count() == out.count() > 0


def test_join_of_chains_near_the_threshold(spark):
    """Neighbours of a chain link, its ends do not: components have to follow links."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(words), None, None))
        at = rng.randrange(10, 180)
        words = words[:at] + [f"new{i}x{k}" for k in range(8)] + words[at + 8 :]
    got = {r.doc_id: r.component_id for r in partenum.joined(frame(spark, rows)).collect()}
    sets = sorted((d, shingle_set(t)) for d, t, _, _ in rows)
    assert got == components(sets, jaccard)
    assert len(set(got.values())) < len(rows)


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    got = [(r.doc_id, r.component_id) for r in partenum.joined(frame(spark, [(None, text, None, None), (4, text, None, None), (4, text, None, None), (2, text, None, None)])).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (4, 2), (4, 2), (2, 2)], key=str)


def test_representatives_keep_one_of_each_group(spark):
    rows = corpus(2)
    kept = {r.doc_id for r in partenum.representatives(frame(spark, rows)).collect()}
    want = components(sorted((d, shingle_set(t)) for d, t, _, _ in rows), jaccard)
    assert kept == {d for d, c in want.items() if d == c}


def test_empty(spark):
    none = frame(spark, [])
    assert partenum.joined(none).count() == 0
    assert suffixes.repeated_removed(none).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 230)] + [(230, 229), (7, 7), (300, 301), (301, 300)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in [5, *range(200, 231)]) and got[301] == got[300] == 300 and 7 not in got


# -- suffixes


def brute(rows):
    first, out = {}, []
    for d, t in sorted(((d, t) for d, t, _, _ in rows), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed(spark, rows):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.repeated_removed(frame(spark, rows)).collect())


@pytest.mark.parametrize("pairwise", [6, 1])
def test_removal_equals_brute_force(spark, monkeypatch, pairwise):
    monkeypatch.setattr(suffixes, "PAIRWISE", pairwise)
    rows = corpus(3)
    assert removed(spark, rows) == sorted(brute(rows))


def test_matches_at_every_offset_and_at_the_limit(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(0, line, None, None)]
    for i in range(1, 40):
        lo, n = rng.randrange(240), rng.choice([48, 49, 50, 51, 60, 120])
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + line[lo : lo + n] + "".join(rng.choice("uvw") for _ in range(rng.randrange(60))), None, None))
    rows += [(50, "ab" * 400, None, None), (51, "ba" * 400, None, None), (52, "a" * 700, None, None), (53, "b" + "a" * 60, None, None)]
    assert removed(spark, rows) == sorted(brute(rows))


def test_null_ids_neither_lose_nor_take(spark):
    text = "p" * 30 + "q" * 40
    got = {(r.doc_id, r.n_removed) for r in suffixes.repeated_removed(frame(spark, [(None, text, None, None), (1, text, None, None), (1, text, None, None), (2, text, None, None)])).collect()}
    assert got == {(None, 0), (1, 0), (2, 70)}


def test_cut_characters_go_whole(spark):
    rows = [(1, "é" * 40, None, None), (4, "é" * 40 + "ü", None, None), (2, "z" + "é" * 40 + "ж", None, None), (3, "�" * 30, None, None)]
    out = {r.doc_id: r.text for r in suffixes.without_repeats(frame(spark, rows)).collect()}
    assert out == {1: "é" * 40, 2: "zж", 3: "�" * 30, 4: ""}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=50, max_size=90), st.binary(max_size=40), st.binary(max_size=40))
def test_equal_windows_choose_equal_anchors(shared, before, after):
    def chosen(raw):
        at, _ = anchors.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
        return at

    alone = {int(a) for a in chosen(shared)}
    there = {int(a) - len(before) for a in chosen(before + shared + after)}
    assert alone and alone <= there


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), min_size=1, max_size=5))
def test_loser_tree_merges_in_order_with_shared_prefixes(runs):
    def run(k, items):
        last = b""
        for i, s in enumerate(sorted(items)):
            yield (suffixes.common(last, s) if i else 0, s, b"", 0, k, i)
            last = s

    got = list(suffixes.merged([run(k, r) for k, r in enumerate(runs)]))
    words = [e[1] for _, e in got]
    assert words == sorted(s for r in runs for s in r)
    assert all(k == suffixes.common(a, b) for (k, _), a, b in zip(got[1:], words, words[1:], strict=False))
