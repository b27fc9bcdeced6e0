import math
import random
import re

import numpy as np
import pytest
from helpers import awkward, empty

from places import DATA
from halyard.llm import ann, langid, license_texts, licenses
from halyard.llm.queries import QUERIES


# --- license scans --------------------------------------------------------------------------------


def test_license_edge_cases(spark):
    mit = licenses.TEMPLATES[12].text
    words = mit.split()
    changed = " ".join([*words[:8], "really", *words[8:20], *words[21:]])
    texts = ["Released under the MIT License. mit\tlicense; MIT-LICENSE", "under the GNU general, public LICENSE version 3", "cc by CC BY", "mit licenses", changed, "permission is hereby granted to all", "ccé by", "mit"]
    got = {r.doc_id: r for r in licenses.license_scan(awkward(spark, texts)).collect() if r.doc_id is not None}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 3, 7, "mit")
    assert (got[1].base_labels, got[1].labels, got[1].n_base) == ("gpl", "gpl,gpl-3.0", 1)
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 2)
    assert got[3].labels == "" and got[3].score == 0 and got[3].first_word is None
    assert got[4].labels == "mit" and got[4].n_base == 0 and 0.6 <= got[4].score < 1
    assert got[5].labels == "" and got[6].labels == "" and got[7].n_words == 1
    assert got[100].n_words == 0 and got[104].n_words == 60_000
    assert licenses.license_scan(awkward(spark)).count() == 8
    assert licenses.license_scan(empty(spark)).count() == 0


def test_altered_copies_of_whole_licenses(spark):
    rng = random.Random(5)
    whole = [x for x in licenses.TEMPLATES if len(x.words) > 35]
    assert {x.label for x in whole} >= {"mit", "bsd", "isc", "zlib", "unlicense", "bsl-1.0", "apache-2.0", "gpl"}
    texts = []
    for x in whole:
        words = x.words
        body = words[len(words) // 6 :]  # its best known sentence is cut
        for _ in range(max(1, len(body) // 30)):
            body[rng.randrange(len(body))] = "other"
        cut, at = len(body) // 2, len(body) // 3
        body = body[:at] + ["held", "by"] + body[at:cut] + body[cut + 1 :]
        texts.append("Some words before. " + ", ".join(w.upper() for w in body) + ". And after")
        texts.append(" ".join(rng.sample(words, len(words))))  # its words in no order
        texts.append(" ".join(words[: len(words) // 3]))  # too little of it
    found = licenses.license_spans(awkward(spark, texts), templates=tuple(whole)).filter("t >= 0").collect()
    got = {(r.doc_id, r.t): r for r in found}
    for i, _ in enumerate(whole):
        assert got[3 * i, i].places == 1 and 0.6 <= got[3 * i, i].coverage < 1, whole[i].label
        assert (3 * i + 1, i) not in got and (3 * i + 2, i) not in got
    twice = " filler ".join([license_texts.BSD, license_texts.BSD])
    (r,) = licenses.license_spans(spark.createDataFrame([(1, twice)], "doc_id long, text string"), templates=tuple(x for x in whole if x.label == "bsd")).filter("t >= 0").collect()
    assert (r.places, r.coverage, r.last - r.first) == (2, 1.0, len(whole[[x.label for x in whole].index("bsd")].words) + 1)


def test_base_places_against_a_plain_scan(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: r for r in QUERIES["op8_license_scan"](spark, f"{DATA}/sf0.001").collect()}
    for d, t in rows:
        words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [i for x in licenses.TEMPLATES if x.base for i in range(len(words)) if words[i : i + len(x.words)] == x.words]
        assert (got[d].n_words, got[d].n_base, got[d].first_word, got[d].last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))


# --- nearest neighbours ---------------------------------------------------------------------------


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        s = sorted((-(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [i for _, i in s[:k]]
    return out


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 24))
    x = np.concatenate([centres[rng.integers(0, 20, 1500)] + 0.3 * rng.standard_normal((1500, 24)), rng.standard_normal((1500, 24)), np.repeat(centres[:1], 400, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), shard_rows=200).collect()
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(found[q]) & set(w)) for q, w in want.items())
    assert len(got) == 5 * len(want) and hits >= 0.95 * 5 * len(want)
    assert found[3000] == [i for i in range(3001, 3006)]  # identical vectors: smaller identifiers


def test_jittered_copies_are_told_apart_by_exact_score(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(16) + 1e-5 * rng.standard_normal((600, 16))
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), shard_rows=4000).collect()
    for at in np.flatnonzero(ids % 50 == 0):
        s = ann.cosines(x, x[at])
        want = [j for j in np.lexsort((ids, -s)) if j != at][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[at])
        assert s.min() > 1 - 1e-9 and mine == [(i + 1, ids[j], s[j]) for i, j in enumerate(want)]


def test_more_boxes_than_are_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3 + i % 7).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = df.filter("vec_id % 30 < 7")
    want = sorted(map(tuple, ann.nearest_neighbours(df, ask, shard_rows=50).collect()))
    monkeypatch.setattr(ann, "BOXES", 6)
    assert sorted(map(tuple, ann.nearest_neighbours(df, ask, shard_rows=50).collect())) == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, df.filter("vec_id IN (0, 2, 3, 7)"))
    assert [(r.query_id, r.rank, r.vec_id) for r in got.orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 9)]
    assert got.filter("rank = 2").first().score == -1.0
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_huge_and_tiny_vectors(spark):
    rows = [(0, [1e300, 0.0]), (1, [1e-300, 0.0]), (2, [3e200, 4e200]), (3, [0.0, -1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(1, 1.0), (2, 0.6), (3, 0.0)]


def test_fixed_quantiles():
    """The stated quantiles against the regularised gamma function by its series."""
    for n, q in ann.CHI_SQUARE_99.items():
        a, x = n / 2, q / 2
        term = total = 1 / a
        for i in range(1, 400):
            term *= x / (a + i)
            total += term
        assert abs(total * math.exp(-x + a * math.log(x) - math.lgamma(a)) - 0.99) < 1e-4


# --- language ID ----------------------------------------------------------------------------------


def test_automaton_knows_all_substrings():
    text = np.array([2, 3, 2, 2, 3, 3, 2, 3, 2])
    t = langid.suffix_automaton(text.tolist())

    def accepts(s):
        state = 0
        for c in s:
            state = t[state].get(c, -1)
            if state < 0:
                return False
        return True

    whole = text.tolist()
    subs = {tuple(whole[a:b]) for a in range(len(whole)) for b in range(a, len(whole) + 1)}
    import itertools

    for n in range(6):
        for s in itertools.product([2, 3, 4], repeat=n):
            assert accepts(s) == (s in subs)


def test_phrases_against_a_plain_parse(monkeypatch):
    parser = langid.CrossParser.fit({"a": ["abracadabra abra"], "b": ["hocus pocus fidibus"]}, 1000)
    training = {g: "".join(chr(c) if c else " " for c in np.concatenate([[0], langid._points(t), [0]])) for g, t in (("a", "abracadabra abra"), ("b", "hocus pocus fidibus"))}

    def plain(text, g):
        count, at = 1, 0
        text = "".join(chr(c) if c else " " for c in langid._points(text))
        while at < len(text):
            n = 0
            while at + n < len(text) and text[at : at + n + 1] in training[g]:
                n += 1
            at += n
            if at < len(text):
                count += 1
                at += text[at] not in training[g]
        return count

    rng = random.Random(4)
    long = ["".join(rng.choice(["abra", "cad", "hocus", " ", "fidi", "bus", "z", "abracadabra abra "]) for _ in range(n)) for n in (300, 900, 2000)]
    for dense in (62, 3, 0):  # letters without a column are looked up otherwise, and give the same
        monkeypatch.setattr(langid, "DENSE", dense)
        own = langid.CrossParser.fit({"a": ["abracadabra abra"], "b": ["hocus pocus fidibus"]}, 1000)
        texts = ["abra", "abra pocus", "zzz", "hocus cadabra, fidibus!", *long]
        costs, _ = own.costs(texts)
        assert (costs / own.bits).round().astype(int).tolist() == [[plain(t, "a"), plain(t, "b")] for t in texts]
    assert [p[0] for p in parser.predict(["abra cadabra", "pocus hocus", None, "", "123 !?"])] == ["a", "b", "und", "und", "und"]


def test_long_texts_and_many_languages_in_slices(monkeypatch):
    """However texts and languages are sliced, the phrases are the same."""
    import random

    rng = random.Random(5)
    words = ["the", "quick", "ΟΔΟΣ", "über", "日本", "brown", "fox", "été", "12", "--", "\n"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    own = langid.CrossParser.fit({f"g{i:02d}": [say(60)] for i in range(23)}, 400)
    texts = [say(3000), "", say(5), "日" * 3000, " " * 2500, say(700), "x", "a-b" * 900]
    whole, sizes = own.costs(texts)
    for piece, columns, together in ((64, 1 << 14, 2), (700, 7, 3), (1500, 30, 1024), (1 << 20, 1, 1)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "COLUMNS", columns)
        monkeypatch.setattr(langid, "TOGETHER", together)
        got, n = own.costs(texts)
        assert (got == whole).all() and (n == sizes).all()


def test_memory_does_not_grow_with_texts_or_languages():
    import tracemalloc

    text = "wort und wort in einem sehr langen text " * 1_250_000  # 50 million characters
    two = langid.CrossParser.fit({"a": ["ein langer text in worten"], "b": ["some long text in words"]}, 100)
    many = langid.CrossParser.fit({f"g{i}": [f"sample {i} of some words and more words"] for i in range(1000)}, 40)
    for own, given in ((two, [text]), (many, [text[:2_000_000]] + [text[:1000]] * 2000)):
        tracemalloc.start()
        assert len(own.predict(given)) == len(given)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400e6, peak


def test_held_out_accuracy(spark, duck):
    rows = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, f"{DATA}/sf0.01").collect()}
    import zlib

    truth = dict(duck.sql(f"SELECT doc_id, lang FROM '{DATA}/sf0.01/documents.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items()) and set(rows) == set(truth)
    held = [d for d, r in rows.items() if r.held_out]
    assert len(held) > 200 and sum(rows[d].lang_pred == truth[d] for d in held) >= 0.98 * len(held)


def test_language_edge_cases(spark):
    docs = awkward(spark, ["the cat sat on the mat and the dog ate it", "le chat est sur la table avec le chien"] * 4)
    parser = langid.fit(docs)
    got = langid.predict(docs, parser, keep=("source", "n_lines"))
    assert got.count() == docs.count() and {"source", "n_lines"} <= set(got.columns)
    clash = langid.predict(docs, parser, keep=("score", "source"))
    assert clash.columns == [*(x.split()[0] for x in langid.SCHEMA.split(", ")), "source"] and clash.filter("score > 1").count() == 0
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert by[100] == by[101] == by[102] == "und" and by[103] != "und"
    nothing = langid.predict(docs, langid.fit(empty(spark)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and langid.predict(empty(spark), parser).count() == 0


def labelled(spark, texts):
    return spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)


def test_languages_with_thousands_of_letters(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(2000)]  # both languages use all of them
    words = {g: ["".join(rng.choice(letters) for _ in range(2)) for _ in range(3000)] for g in ("xa", "xb")}
    texts = [(g, " ".join(rng.choice(words[g]) for _ in range(300))) for g in ("xa", "xb") for _ in range(60)]
    parser = langid.fit(labelled(spark, texts))
    assert len(parser.letters) > 1900
    asked = [(g, " ".join(rng.choice(words[g]) for _ in range(12))) for _ in range(100) for g in ("xa", "xb")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(labelled(spark, asked), parser).collect()}
    assert [got[i] for i in range(200)] == [g for g, _ in asked]


def test_every_label_is_learned(spark):
    texts = [(f"l{i:04}", f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} word") for i in range(1200) for _ in range(3)]
    parser = langid.fit(labelled(spark, texts))
    assert len(parser.langs) > 1150  # nearly all have a row that is not held out
    one_id = spark.createDataFrame([(3, "la même chose " * 3, "fr")] * 300 + [(8, "the same thing", "zz")], "doc_id long, text string, lang string")
    samples, _ = langid.labelled_sample(one_id, "doc_id", "text", "lang", 48, 2000, 32_000, 320_000)
    assert {g: len(t) for g, t in samples.items()} == {"fr": 1, "zz": 1}


def test_sample_holds_whole_rows_up_to_its_bound(spark):
    texts = [("en", f"{i} " + "word " * (5000 if i < 40 else 30)) for i in range(80)]
    samples, bound = langid.labelled_sample(labelled(spark, texts), "doc_id", "text", "lang", 48, 2000, 6000, 320_000)
    whole = {t for _, t in texts}
    assert bound == 6000 and sum(t not in whole for t in samples["en"]) <= 1 and sum(map(len, samples["en"])) <= 6000
    assert sum(len(t) < 2000 for t in samples["en"]) > 15


@pytest.mark.parametrize("column", ["lang", "source", "doc_id"])
def test_prediction_reads_text_only(spark, column):
    docs = awkward(spark, ["the cat sat on the mat and the dog ate it", "le chat est sur la table avec le chien"] * 4)
    parser = langid.fit(docs)
    from pyspark.sql import functions as F

    a = langid.predict(docs, parser).select("lang_pred", "score").collect()
    b = langid.predict(docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType)), parser).select("lang_pred", "score").collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
