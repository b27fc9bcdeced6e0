import random
from itertools import combinations

import numpy as np
import pytest
from helpers import awkward, empty

from halyard.llm import jaccard_join as j
from halyard.llm.components import connected_components
from halyard.llm.words import shingle_sets


def brute(rows):
    """doc index -> (links, smallest linked identifier) by comparing all pairs."""
    sets = [set(s.tolist()) for s in shingle_sets([t for _, t in rows])]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[top(b)] = top(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), (True, 0)), (d is None, d or 0))
    return [(d, links[i], least[top(i)][1] if not least[top(i)][0] else None) for i, (d, _) in enumerate(rows)]


def near_copies(n, words, seed=3):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        t[rng.randrange(words)] = f"new{rng.randrange(9)}"
        out.append(" ".join(t))
    return out


def test_links_and_classes_against_all_pairs(spark):
    texts = near_copies(40, 120) + near_copies(25, 60, 4) + [" ".join(f"w{i}{k}" for k in range(40)) for i in range(30)] + ["one two", "one two", "One, two!"]
    docs = awkward(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = j.jaccard_classes(docs).collect()
    assert sorted(repr((r.doc_id, r.n_links, r.class_id)) for r in got) == sorted(map(repr, brute(rows)))
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {(r.class_key if r.class_key is not None else (r.doc_id, r.text_hash)) for r in got}
    assert kept.count() == len(classes)
    assert j.jaccard_classes(empty(spark)).count() == 0 and j.one_of_each(empty(spark)).count() == 0


def test_large_buckets_are_split_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "LIMIT", 8)
    monkeypatch.setattr(j, "BLOCK", 10)
    docs = spark.createDataFrame(list(enumerate(near_copies(70, 90) + near_copies(30, 200, 5))), "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = j.jaccard_classes(docs).collect()
    want = brute(rows)
    met = sum(r.n_links for r in got)
    assert met <= sum(w[1] for w in want) and met >= 0.99 * sum(w[1] for w in want)
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((d, c) for d, _, c in want)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_recall_just_above_the_threshold(spark, monkeypatch, threshold):
    monkeypatch.setattr(j, "LIMIT", 16)  # all pairs share a passage, so buckets are large and are split
    rng = random.Random(int(threshold * 10))
    rows = []
    for i in range(150):
        one = [f"p{n}" for n in range(8)] + [f"{i}w{n}" for n in range(200)]
        cut = int(200 * (1 - threshold) / (1 + threshold)) - rng.randrange(4, 10)
        at = rng.randrange(20, 200 - cut)
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join([*one[:at], *(f"{i}x{n}" for n in range(cut)), *one[at + cut :]]))]
    sets = [set(s.tolist()) for s in shingle_sets([t for _, t in rows])]
    pairs = sum(len(a & b) >= threshold * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    assert pairs > 140 and sum(len(a & b) > (threshold + 0.1) * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)) == 0
    got = j.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()
    met = sum(r.n_links for r in got) / 2
    assert 0.99 * pairs <= met <= pairs


def test_large_buckets_are_split_where_sets_are_unlike(spark, monkeypatch):
    monkeypatch.setattr(j, "DEPTH", 1)
    sig = lambda i, d: np.array([d] + [i * 64 + p for p in range(1, 64)], "<u4").tolist()
    rows = [(f"u{i}".encode(), 10, np.array(sig(i + 1, 7), "<u4").tobytes()) for i in range(600)] + [(f"a{i}".encode(), 10, np.array(sig(0, 9), "<u4").tobytes()) for i in range(400)]
    found = j._leaves(spark.createDataFrame(rows, "node binary, size int, sig binary"), 0.8, 0.999).select("path", "n", "shingles").distinct().collect()
    assert {r.n for r in found} == {400} and {r.shingles for r in found} == {4000} and len(found) == j.runs_needed()


def test_intersections_by_ranges(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, np.uint64) << np.uint64(1)) for _ in range(5)]
    sets = [np.unique(np.concatenate([s, sets[0][: 40 * i]])) for i, s in enumerate(sets)] + [np.array([0, (1 << 64) - 1], np.uint64)]
    whole = j.intersections(sets)
    apart = ~np.eye(len(sets), dtype=bool)  # a set with itself is of no interest
    assert (whole == [[len(np.intersect1d(a, b)) for b in sets] for a in sets])[apart].all()
    monkeypatch.setattr(j, "SLICE", 100)
    assert (j.intersections(sets) == whole)[apart].all()


def test_runs_reach_the_recall():
    for t in (0.3, 0.5, 0.6, 0.8, 0.95, 1.0):
        assert 1 - (1 - j.met(j.DEEPEST, t)) ** j.runs_needed(threshold=t) >= j.RECALL - 1e-9
    assert round(j.sketch_share(0.8), 3) == 0.55


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame([*chain, (None, 3)], "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
