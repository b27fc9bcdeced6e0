import hashlib
import re
from collections import defaultdict

import pytest
from helpers import awkward, empty

from places import DATA
from halyard.llm import exact_dedup, line_dedup
from halyard.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, same_rows, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, ORACLES[name])


def test_exact_dedup_edge_cases(spark):
    docs = awkward(spark, ["a b", "ab", " a  b ", "other", "a\u00a0b"])
    rows = docs.select("doc_id", "text").collect()
    norm = lambda t: re.sub("[ \t-\r]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = sorted(
        repr((r.doc_id, min(g)[2], len(g), (-len(r.text or ""), r.doc_id) == (min(g)[0], min(g)[2]), hashlib.sha256(norm(r.text).encode()).hexdigest())) for r in rows for g in [groups[norm(r.text)]]
    )
    got = exact_dedup.exact_duplicates(docs)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got.collect()) == want
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_trie_is_a_map():
    trie, plain = exact_dedup.PatriciaTrie(), {}
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ab", b"abc\x00", b"xyz" * 50, b"xyz" * 49]
    for i, k in enumerate(keys):
        trie.insert(k, (-len(k), i, b""), 1)
        plain.setdefault(k, []).append(i)
    assert {k: (best[1], n) for k, best, n in trie.take()} == {k: (min(v), len(v)) for k, v in plain.items()}
    largest = [k for k, _, _ in trie.spill(trie.bytes - 1)]
    assert set(largest) == {k for k in keys if k[:1] == b"a"}  # one subtree goes, the others stay
    before = trie.bytes
    left = {k: n for k, _, n in trie.spill(0)}
    assert before > 0 and left == {k: len(v) for k, v in plain.items() if k and k[:1] != b"a"} and trie.bytes == 0
    assert [k for k, _, _ in trie.take()] == [b""]


def test_owners_go_by_subtree_once_complete(monkeypatch):
    rows = sorted((3, hashlib.sha256(b"%c%02d" % (97 + i % 3, i % 40)).digest(), b"%c%02d" % (97 + i % 3, i % 40), i % 5, i, 1) for i in range(400))
    batches = [exact_dedup._batch(rows[a : a + 7]) for a in range(0, len(rows), 7)]
    whole = [r for b in exact_dedup._merge_all(iter(batches)) for r in exact_dedup._rows(b)]
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 5_000)
    parts = list(exact_dedup._merge_all(iter(batches)))
    assert len(parts) > 3 and sorted(r for b in parts for r in exact_dedup._rows(b)) == sorted(whole) and sum(r[5] for r in whole) == 400
    clash = [exact_dedup._batch([(3, b"s" * 32, b"abc", 3, 1, 1), (3, b"s" * 32, b"abd", 3, 2, 1)])]
    with pytest.raises(ValueError, match="same length and SHA-256"):
        list(exact_dedup._merge_all(iter(clash)))


def test_spilled_tries_give_the_same(spark, monkeypatch):
    docs = awkward(spark, [f"text {i % 7} " + "x" * (i % 3) for i in range(60)])
    whole = sorted(map(repr, exact_dedup.exact_duplicates(docs).collect()))
    batches = [exact_dedup._batch([(3, bytes([i % 5]) * 32, b"abc" if i % 5 else b"abd", 3, i, 1)]) for i in range(20)]
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 1)
    rows = [r for b in exact_dedup._merge_own(iter(batches)) for r in exact_dedup._rows(b)]
    assert len(rows) >= 2 and sum(r[5] for r in rows) == 20
    assert sorted(map(repr, exact_dedup.exact_duplicates(docs).collect())) == whole


def brute_lines(rows):
    """(doc_id, text) -> text without covered lines, by a plain loop in order of (doc_id, hash of text)."""
    seen, out = set(), {}
    for doc_id, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a in range(len(solid) - 2):
            w = tuple(lines[i].strip(" ") for i in solid[a : a + 3])
            if w in seen:
                gone |= set(solid[a : a + 3])
            seen.add(w)
        out[(doc_id, t)] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_edge_cases(spark):
    texts = ["a\nb\nc\nd", "x\na\n\n b \nc\nd\ny", "a\na\na\na\na", "p\nq", "d\na\nb\nc\nd", "one\ntwo\nthree"]
    docs = awkward(spark, texts)
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) | {"n_removed", "removed_spans"} == set(got.columns)
    found = [(r.doc_id, r.text) for r in got.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_lines(list(dict.fromkeys(rows)))
    assert sorted(map(repr, found)) == sorted(repr((d, want[(d, t)])) for d, t in rows)
    one = {r.doc_id: (r.n_lines, r.n_removed, r.removed_spans) for r in got.collect()}
    assert one[1] == (6, 4, "1-4") and one[0] == (4, 0, "") and one[100] == (0, 0, "")
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
