"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from seriesforge.llm import jaccard_join, substring_dedup
from seriesforge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NULL = -(1 << 63)


def words(text):
    return WORD.findall(text or "")


def removed(rows):
    """(id, text) -> [(id, n_words, n_removed, sha)] by the definition."""
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 19):
            place = (NULL if i is None else i, s)
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (NULL if i is None else i, s):
                gone.update(range(s, s + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    some = lambda n, v=400: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, long = some(25), some(300)
    rows = {i: some(rng.randrange(5, 120)) for i in range(40)}
    for i in range(0, 40, 3):
        at = rng.randrange(len(rows[i]))
        rows[i][at:at] = passage
    rows[40], rows[41], rows[42] = long, list(long), long[100:] + some(20)
    edited = list(long)
    edited[50], edited[200] = "x", "y"
    rows[43] = edited
    rows[44] = ["again"] * 70
    rows[45] = some(5) + ["again"] * 25 + some(5)
    rows[46] = passage[:20]
    rows[47] = passage[:19]
    rows[48] = (passage + ["z"]) * 3
    rows[49] = ["é", "日本", "\x1c", " x"] * 12
    for i in range(50, 200):  # a passage in more documents than an anchor may have before it is split
        rows[i] = some(rng.randrange(3, 9)) + passage + some(rng.randrange(3, 9))
    out = [(i, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in rows.items()]
    return [*out, (300, None), (301, ""), (302, " \n "), (None, " ".join(passage)), (None, " ".join(passage)), (5, out[5][1])]


def test_removals(spark, make_docs):
    rows = corpus()
    got = substring_dedup.removals(make_docs(rows, extra=True).repartition(7)).collect()
    assert sorted([tuple(r) for r in got], key=str) == removed(rows)


def test_removals_with_a_full_filter(make_docs):
    """False hits of the filters change nothing."""
    rows = corpus(2)
    got = substring_dedup.removals(make_docs(rows), most_blocks=1).collect()
    assert sorted([tuple(r) for r in got], key=str) == removed(rows)


def shared_ids(seed=7):
    """Rows without an id or with the same id, with different texts and lengths."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, rows = some(30), []
    for i in (None, 7):
        rows += [(i, some(500) + passage), (i, some(40)), (i, some(10)), (i, passage + some(60)), (i, some(3)), (i, some(25))]
        rows += [rows[-6]] * 3
    rows += [(k, some(rng.randrange(5, 30)) + (passage if k % 4 == 0 else [])) for k in range(100, 130)]
    return [(i, " ".join(w)) for i, w in rows]


def test_rows_that_share_an_id_keep_their_own_words(make_docs):
    rows = shared_ids()
    got = substring_dedup.removals(make_docs(rows).repartition(3)).collect()
    assert sorted([tuple(r) for r in got], key=str) == removed(rows)
    short = [(None, " ".join(map(str, range(500))) + " " + rows[3][1]), (None, "a short row"), (5, rows[3][1])]
    got = substring_dedup.removals(make_docs(short).coalesce(1)).collect()
    assert sorted([tuple(r) for r in got], key=str) == removed(short)


def test_cuts_end_with_their_row():
    """A start past a row's end removes nothing of the next row."""
    ints = lambda *x: np.array(x, dtype=np.int64)
    gone = substring_dedup.removed_words(ints(0, 10, 40), ints(5, 500, 3), ints(1, 1, 1), ints(0, 4, 0), ints(0, 0, 1))
    assert np.flatnonzero(gone).tolist() == [*range(5, 10), *range(13, 33)]


def test_dedup_texts_keeps_columns(make_docs):
    rows = [(1, " ".join(map(str, range(30)))), (2, "a  b " + " ".join(map(str, range(30)))), (3, None), (4, "x \n y")]
    got = {r["doc_id"]: r.asDict() for r in substring_dedup.dedup_texts(make_docs(rows)).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == [rows[0][1], "a b", None, "x \n y"]
    assert got[2]["n_removed"] == 30 and got[2]["source"] == "src"
    clash = make_docs(rows).selectExpr("*", "1 AS __starts", "2 AS _masks", "3 AS n_removed", "4 AS text_hash", "5 AS place")
    got = {r["doc_id"]: r.asDict() for r in substring_dedup.dedup_texts(clash).collect()}
    assert got[2]["n_removed"] == 30 and (got[2]["__starts"], got[2]["_masks"], got[2]["text_hash"], got[2]["place"]) == (1, 2, 4, 5)


def test_result_needs_the_automaton(make_docs, monkeypatch):
    """Without the automaton's hits the first occurrences keep what starts earlier elsewhere."""
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = some(40)
    rows = [(i, " ".join(some(30) + passage[i % 7 : 33 + i % 8] + some(30))) for i in range(30)]
    got = substring_dedup.removals(make_docs(rows).coalesce(1)).collect()
    assert sorted([tuple(r) for r in got], key=str) == removed(rows)
    shard = substring_dedup.Shard(3)
    for words, place in (([b"a", b"b", b"c", b"d"], (2, 0)), ([b"x", b"b", b"c", b"d"], (1, 5))):
        shard.add(words, place)
    assert shard.masks() == [2, 0]
    without = substring_dedup.Shard(3)
    without.texts = shard.texts
    without.automaton.add_word("none", (0, 0))
    assert without.masks() == [0, 0]


def test_empty(make_docs):
    empty = make_docs([])
    assert substring_dedup.removals(empty).count() == 0
    assert jaccard_join.linked_components(empty).count() == 0


# -- Jaccard join


def shingle_set(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def linked(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None], 2):
        both = len(a & b)
        if a and b and 100 * both >= 75 * len(a | b):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=str)


def families(seed=3):
    rng = random.Random(seed)
    some = lambda n, v=3000: [f"w{rng.randrange(v)}" for _ in range(n)]
    rows = []
    common = some(30)
    for size in (6, 9, 17, 40, 90, 200, 700):
        base = some(size)
        rows.append(base)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                at = rng.randrange(len(copy))
                kind = rng.randrange(3)
                if kind == 0:
                    copy[at] = some(1)[0]
                elif kind == 1 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, some(1)[0])
            rows.append(copy if rng.random() < 0.8 else copy[: rng.randrange(len(copy) // 2, len(copy)) + 1])
    rows += [common + some(rng.randrange(4, 15)) for _ in range(40)]
    rows += [["solo"] * n for n in (1, 2, 4, 5, 6, 30)] + [["a", "b"], ["A", "B"], ["a", "b", "c"]]
    rng.shuffle(rows)
    return [*((i, " ".join(w)) for i, w in enumerate(rows)), (900, None), (901, ""), (902, "  "), (None, "a b"), (None, "a b"), (3, " ".join(rows[3]))]


def test_components(make_docs, seed=3):
    rows = families(seed)
    got = jaccard_join.linked_components(make_docs(rows, extra=True).repartition(5)).collect()
    assert sorted([tuple(r) for r in got], key=str) == linked(rows)


def test_components_with_a_full_filter(make_docs):
    """Without pruning, every set takes part and the result is the same."""
    rows = families(5)
    got = jaccard_join.linked_components(make_docs(rows), most_blocks=1).collect()
    assert sorted([tuple(r) for r in got], key=str) == linked(rows)


def test_a_filter_of_two_bits_a_shingle_still_drops_most_others():
    h, others = np.random.default_rng(5).integers(0, 1 << 64, (2, 20_000), dtype=np.uint64)
    dealt = [jaccard_join._dealt(np.concatenate([h, h]), 1)]
    slices = [tuple(r.values()) for b in jaccard_join._shared(len(h) * 2 // 512)(dealt) for r in b.to_pylist()]
    shared = jaccard_join.Shared(1, slices)
    assert shared.test(h).all()
    assert shared.test(others).mean() < 0.5


def test_signatures_meet():
    """Every pair of sets that link has an equal signature, however they differ."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = int(rng.integers(1, 300))
        s = rng.integers(0, 1 << 63, a, dtype=np.uint64)
        lost = int(rng.integers(0, a + 1))
        added = int(rng.integers(0, a + 1))
        t = np.concatenate([s[lost:], rng.integers(0, 1 << 63, added, dtype=np.uint64)])
        both = a - lost
        if not len(t) or 100 * both < 75 * (a + added):
            continue
        n = np.array([len(s), len(t)])
        sign, row, sparse = jaccard_join.signatures(np.concatenate([s, t]), np.array([0, len(s), len(s) + len(t)]), n, np.zeros(2, np.int64))
        assert sparse.all() or set(sign[row == 0]) & set(sign[row == 1])


def test_every_choice_of_two_cells_is_a_signature():
    """A part whose cells all have shingles gives three signatures, and a change in one cell leaves one of them."""
    e = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    n, none = np.array([400]), np.zeros(1, np.int64)
    sign, _, sparse = jaccard_join.signatures(e, np.array([0, 400]), n, none)
    assert not sparse[0] and len(set(sign)) == len(sign) > 2 * jaccard_join.parts_of_band(np.searchsorted(jaccard_join.TOPS, n))[0]
    other, _, _ = jaccard_join.signatures(e[1:], np.array([0, 399]), n - 1, none)
    # the shingle lies in one part of each of the two instances, and each keeps the choice that leaves its cell out
    assert len(set(sign) - set(other)) == 4


def test_left_over_sets_in_blocks(make_docs, monkeypatch):
    """Many sets that share a passage but don't link: groups of one prefix shingle in several blocks."""
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, others = some(60), [some(18) for _ in range(12)]
    rows = [(i, " ".join(passage + others[i % 12][: rng.randrange(12, 19)] + some(rng.randrange(0, 6)))) for i in range(90)]
    got = jaccard_join.linked_components(make_docs(rows).repartition(3), block=7).collect()
    assert sorted([tuple(r) for r in got], key=str) == linked(rows)


@pytest.mark.parametrize("order", ["rising", "falling", "random"])
def test_components_of_a_long_chain(spark, order):
    """10,000 documents in a chain: the rounds grow with the logarithm."""
    ids = list(range(10_000))
    ids = ids[::-1] if order == "falling" else random.Random(3).sample(ids, len(ids)) if order == "random" else ids
    got = components(spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)), "a long, b long"))
    assert got.agg({"node": "count", "component": "max"}).first().asDict() == {"count(node)": 10_000, "max(component)": 0}


def test_graph_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in up}
