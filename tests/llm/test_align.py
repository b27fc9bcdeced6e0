import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import awkward, empty

from places import DATA
from halyard.llm import align
from halyard.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(texts):
    """Each text's row without its identifier, straight from the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}

    def a_bytes(i):
        return bytes(byte_of[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, holders = [], defaultdict(set)
    for at, t in enumerate(texts):
        groups = []
        if t:
            x = [(i, a_bytes(i)) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [(i, b_bytes(i)) for i in b.encode(t)]
            if all(b"".join(d for _, d in z) == (" " + t).encode() for z in (x, y)):
                ends = [dict(zip(np.cumsum([len(d) for _, d in z]).tolist(), range(1, len(z) + 1))) for z in (x, y)]
                done = [0, 0]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(([i for i, _ in x[done[0] : ends[0][e]]], [i for i, _ in y[done[1] : ends[1][e]]]))
                    done = [ends[0][e], ends[1][e]]
        docs.append(groups)
        for g in groups:
            for p in g[0]:
                for q in g[1]:
                    holders[p, q].add(at)
    top = defaultdict(int)
    for (p, _), held in holders.items():
        top[p] = max(top[p], len(held))
    out = []
    for groups in docs:
        links = [len(holders[p, q]) for g in groups for p in g[0] for q in g[1]]
        best = sum(len(holders[p, q]) == top[p] for g in groups for p in g[0] for q in g[1])
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), best, sum(links), digest))
    return out


ODD = [
    "hello world", "hello  world", " leading", "trailing ", "tab\tand\nline", "</s><s>[INST] <|endoftext|> <0x41> <unk>", "▁marker", "naïve übergrößen", "日本語のテキスト", "приве́т мир", "😀😀😀 x", "é", "ﬁ ½ ²",
    "=" * 300, "a" * 5000, "é" * 900, "0123456789" * 40, "x", " ", "\x00", "the cat sat on the mat. " * 20, "hello world", "日" * 700 + "本" * 700,
]


def test_rows_are_those_of_the_libraries(spark):
    texts = [t for t in ODD for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in align.align_documents(docs, A, B).collect()}
    want = by_hand(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == want[i], t[:40]
    assert sum(w[0] > 0 for w in want) > 24 and sum(w[0] == 0 for w in want) == 2  # the marker becomes a blank


def test_many_runs_are_merged_in_rounds_and_long_links_in_slices(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_CHARS", 2000)
    monkeypatch.setattr(align, "SLICE_LINKS", 300)
    texts = [" ".join(f"w{(i * j) % 37} ünï {ODD[(i + j) % 5]}" for j in range(i % 30 + 1)) for i in range(60)] + ODD
    rows = list(enumerate(texts))
    own = align.Aligner(A, B)
    runs = [r for k in range(0, len(texts), 7) for r in own.groups(texts[k : k + 7]).runs()]
    assert len(runs) > 40  # the bounds bite
    counts = defaultdict(int)
    for pairs, n, _, _ in runs:
        for p, c in zip(pairs.tolist(), n.tolist()):
            counts[p] += c
    parts = [(i, 0, align.packed_rising(pairs), align.packed(n)) for i, (pairs, n, _, _) in enumerate(runs)]
    table = spark.createDataFrame(parts, align._PART)
    top = defaultdict(int)
    for p, c in counts.items():
        top[p >> own.b_bits] = max(top[p >> own.b_bits], c)
    for fan in (4, 1000):
        got = {r.run: r for r in align.count_pairs(table, own.b_bits, len(runs), fan).collect()}
        assert len(got) == len(runs)
        for i, (pairs, _, _, _) in enumerate(runs):
            assert align.unpacked(got[i].totals).tolist() == [counts[p] for p in pairs.tolist()]
            assert align.unpacked(got[i].best).tolist() == [int(counts[p] == top[p >> own.b_bits]) for p in pairs.tolist()]
    got = {r[0]: tuple(r)[1:] for r in align.align_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), A, B, fan=3).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_a_run_of_records_is_bounded(monkeypatch):
    monkeypatch.setattr(align, "SLICE_LINKS", 1000)
    own = align.Aligner(A, B)
    text = " ".join(f"w{i % 611} naïve" for i in range(4000))
    runs = list(own.groups([text, "x"]).runs())
    sizes = sorted(int(links.sum()) for *_, links in runs)
    assert len(runs) > 20 and sizes[-2] < 6000 < sizes[-1]  # only the run of the id that stands 4,000 times is longer
    whole = np.concatenate([pairs for pairs, *_ in runs])
    assert len(np.unique(whole)) == len(whole)  # no pair is in two runs of one chunk, so none is counted twice


def test_wide_groups_are_made_distinct_first():
    own = align.Aligner(A, B)
    g = own.groups(["日" * 300 + "a" * 3000])
    assert int(g.n_links[0]) == sum(int(links.sum()) for *_, links in g.runs())


def test_awkward_rows(spark):
    docs = awkward(spark, ["plain text", "plain text"])
    out = align.align_documents(docs, A, B)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [f.split()[0] for f in align.SCHEMA.split(", ")]
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(tuple(r)[1:])
    assert by_id[100] == by_id[101] == [(0, 0, 0, 0, 0, 0, "")]
    assert len(by_id[103]) == 2 and len(set(by_id[103])) == 1 and by_id[0] == by_id[1]
    assert align.align_documents(empty(spark), A, B).count() == 0


def test_query_against_the_libraries(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_cross_tokenizer_alignment"](spark, f"{DATA}/sf0.001").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = by_hand([d.text for d in docs])
    assert {d.doc_id: w for d, w in zip(docs, want)} == got
