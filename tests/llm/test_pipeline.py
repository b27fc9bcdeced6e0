import zlib

import corpus_pipeline as p
from helpers import awkward, empty
from test_dedup import brute_lines
from test_jaccard import brute
from test_tokens import check_pieces

from places import DATA
from halyard.llm import langid


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    start = [tuple(r) for r in docs.collect()]
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "packing"]
    stage = dict(p.STAGES)
    kept = stage["language_id"](spark, docs, "")
    assert kept.columns == list(p.COLUMNS)
    rows = [tuple(r) for r in kept.collect()]
    assert {r[0] for r in start if any(c.isalpha() for c in r[1] or "")} >= {r[0] for r in rows} and len(rows) >= 0.98 * len(start)
    lines = stage["line_dedup"](spark, kept, "")
    want = brute_lines([(r[0], r[1]) for r in rows])
    left = {(d, t) for (d, old), t in want.items() if t == old or any(x.strip(" ") for x in t.split("\n"))}
    got = [tuple(r) for r in lines.collect()]
    assert {(r[0], r[1]) for r in got} == left and all(r[4] == len(r[1]) for r in got)
    once = stage["ngram_jaccard_join"](spark, lines, "")
    classes = {c for d, _, c in brute([(r[0], r[1]) for r in got])}
    assert {r.doc_id for r in once.collect()} == classes
    check_pieces(stage["packing"](spark, once, "").collect(), [(r.doc_id, r.text) for r in once.collect()])


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark, ["le chat est sur la table avec le chien"] * 4), empty(spark)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()


def test_texts_on_which_languages_tie_stay(spark):
    shared = "la casa es de madera y el sol brilla en la plaza"
    learned = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2][:16]
    rows = [(i, shared, ("en", "es")[n % 2], "s", len(shared)) for n, i in enumerate(learned)]
    rows += [(100, "casa", None, "s", 4), (101, "123 !?", None, "s", 6), (102, None, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = langid.predict(docs, langid.fit(docs)).filter("lang_pred <> 'und'").collect()
    assert {(r.lang_pred, r.score) for r in found} == {("en", 0.0)}
    assert sorted(r.doc_id for r in p.language_id(spark, docs, "").collect()) == [*learned, 100]


def test_run(spark):
    assert p.run(spark, f"{DATA}/sf0.001").count() > 0 and p.ORACLE_SQL is None
