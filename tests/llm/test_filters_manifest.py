import hashlib
import random
import zlib

import pytest
from helpers import awkward, empty

from places import DATA
from halyard.llm import manifest, url_filters
from halyard.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_url_filters", "op13_merkle_manifest"])
def test_query(spark, duck, same_rows, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, ORACLES[name])


# --- URL filters ---


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://a.NET", "http://a.net/?q", "http://a.net/x#f", "http://anet/", "http://example.net/en", "http://example.net/en/", "https://x.example.net/en/1?a=://b.net/",
    "http://example.com/de/x", "http://example.com/den", "http://org/fr/", "http://a.b.c.org/fr/x/y", "http://a.net:80/", "http://u@a.net/", "mailto://x.net/", "http://ÀÉ.net/", "http://.net/", "http://net./", "http://a..net/", "http://a.net//", "x" * 50 + "://deep.net/" + "a/" * 20_000,
    "http://" + "l." * 5_000 + "net/", "http://a.net/\n/x", "a://b://c.net/", "http://p.io/path/to", "http://p.io/path/together/x", "http://p.io/pa", "http://q.p.io/path/to/x",
]
MORE_RULES = (*url_filters.RULES, ("p.io", "/path/to", "block"), ("p.io", "/pa", "allow"), ("p.io", "", "block"), ("q.p.io", "/path/", "allow"), ("c.net", "/", "allow"))


@pytest.mark.parametrize("rules", [url_filters.RULES, MORE_RULES])
@pytest.mark.parametrize("digits, most", [(8, 100), (1, 100), (8, 0), (1, 0)])
def test_rules_are_found_as_one_by_one(spark, rules, digits, most):
    pages = spark.createDataFrame([(i, u, "b", "h") for i, u in enumerate(URLS)], "page_id long, url string, verdict string, host string").repartition(3)
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.judge(pages, table, prefix_digits=digits, most_broadcast=most).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(URLS)}


def test_odd_rules_and_tables(spark):
    rules = spark.createDataFrame([("A.net", "/x/", "block"), ("a.net", "/x/", "allow"), ("b.net", None, "block"), (None, "/", "block"), ("c.net", "/", "other"), ("d.net", "/", None)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/x/"), (1, "http://a.net/x/"), (None, "http://b.net"), (2, "http://c.net/"), (3, "http://d.net/")], "page_id long, url string")
    got = sorted((tuple(r) for r in url_filters.judge(pages, rules, "block").collect()), key=repr)
    assert got == sorted([(1, "a.net", "/x/", "a.net/x/", "block")] * 2 + [(None, "b.net", "", "b.net", "block"), (2, "c.net", "/", None, "block"), (3, "d.net", "/", None, "block")], key=repr)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filters.judge(pages, none).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op11_url_filters"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


# --- the manifest ---


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """All levels of the tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i, cur, sibs):
    for level in levels[:-1]:
        other = level[i ^ 1] if i ^ 1 < len(level) else ""
        sibs += other
        cur = sha(other + cur if i % 2 else cur + other)
        i //= 2
    return cur, sibs


def by_hand(docs):
    def leaf(d, plus=0):
        fields = [d["doc_id"], d["source"], d["lang"], None if d["n_chars"] is None else d["n_chars"] + plus, d["text"]]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]])
    crown = tree([trees[g][-1][0] for g in order])
    root = crown[-1][0]
    out = []
    for k, g in enumerate(order):
        for i, (_, _, own, d) in enumerate(groups[g]):
            marked = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            cur, sibs = climb(trees[g], i, leaf(d, 1) if marked else own, "")
            cur, sibs = climb(crown, k, cur, sibs)
            out.append((d["doc_id"], own, trees[g][-1][0], root, sha(sibs), cur, cur == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("block_bits", [1, 2, 10])
def test_manifest_against_a_plain_one(spark, block_bits):
    """Groups of one row and of many, several tiers, sparse, negative, tied and missing identifiers, rows that repeat."""
    rng = random.Random(block_bits)
    ids = [*range(40), *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(40)), 63, 64, -1, -64, -65, (1 << 63) - 1, -(1 << 63), None, None, None, 7, 7, 7, 7]
    docs = [{"doc_id": i, "source": rng.choice(["s", None, "ü"]), "lang": rng.choice(["en", "en", "fr", None]), "n_chars": rng.choice([None, 3, -4]), "text": rng.choice(["a", "日本", "", None])} for i in ids]
    docs += [{"doc_id": 5, "source": "z", "lang": g, "n_chars": 1, "text": "x"} for g in ("ï", "zz", "")] + docs[-6:]
    rng.shuffle(docs)
    df = spark.createDataFrame([tuple(d.values()) for d in docs], SHAPE).repartition(5)
    assert rows_of(manifest.manifest(df, block_bits=block_bits)) == by_hand(docs)


def test_the_root_depends_on_rows_alone(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    a, b = (manifest.manifest(d).select("root").distinct().collect() for d in (docs, docs.repartition(7, "text").sortWithinPartitions(docs.n_chars.desc())))
    assert len(a) == 1 and a == b


def test_awkward_rows(spark):
    docs = awkward(spark, ["one", "two"]).cache()
    want = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    out = manifest.manifest(docs)
    assert rows_of(out) == by_hand(want)
    none = manifest.manifest(empty(spark))
    assert none.count() == 0 and none.schema == out.schema


def test_one_identifier_of_most_rows(spark):
    docs = [{"doc_id": 1, "source": "s", "lang": "en", "n_chars": 1, "text": f"t{i % 150}"} for i in range(3000)] + [{"doc_id": i, "source": "s", "lang": "en", "n_chars": 1, "text": "u"} for i in range(200)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], SHAPE).repartition(6)
    assert rows_of(manifest.manifest(df)) == by_hand(docs)


def test_proofs_tell_changed_leaves():
    levels = manifest.block_levels([sha(str(i)) for i in range(11)], 11)
    for i in range(11):
        path = manifest.siblings(levels, i)
        assert manifest.fold(sha(str(i)), path) == levels[-1][0] != manifest.fold(sha("x"), path)
