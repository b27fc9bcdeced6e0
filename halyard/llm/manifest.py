"""A Merkle manifest of a dataset: a root digest over all rows, and for each row the proof that it is in it.

A row's leaf is the SHA-256 of its fields. Within a group the leaves stand in order of their identifiers,
but nothing is sorted for it: each group has a bitmap of its identifiers, kept as 64-bit words without the
empty ones and merged by `bit_or`; popcount directories over ever longer prefixes of the word numbers give
the number of rows before each word; a rank query (an equi-join and a popcount) gives a leaf's coordinate.

Coordinates deal the leaves into slot arrays of 2^BLOCK_BITS leaves, keyed by (group, block). A block is reduced
to one node; the nodes of blocks are the leaves of the next tier, until each group has one, its subroot.
The subroots are the leaves of one more such tree. On the way down each block hands its path of siblings
to its slots. No task holds more of a tree than a block, or of a directory than RADIX_BITS allow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.scratch import written
from halyard.llm.workers import tidy

WORD_BITS = 6
RADIX_BITS = (10, 16, 16)  # cut off a word number (64 - WORD_BITS bits) from one directory to the next
BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TIE_DIGITS = 4  # hex digits by which rows that share group and identifier are dealt out

SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_NODE = "grp string, i long, total long, digest string"
_PATH = "grp string, i long, name string, path string, subroot string"


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields one after another, each as its length in UTF-8 bytes, `:` and itself, or as `-` where it is null."""
    text = lambda c: c.cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in fields]), 256)


def _joined(a: DataFrame, b: DataFrame, on: dict[str, str]) -> DataFrame:
    """a with the columns of b, by a left equi-join on these pairs of columns in which null equals null."""
    b = b.select(*[F.col(y).alias(f"__{y}") for y in on.values()], *[c for c in b.columns if c not in on.values()])
    test = F.lit(True)
    for x, y in on.items():
        test = test & F.col(x).eqNullSafe(F.col(f"__{y}"))
    return a.join(b, test, "left").drop(*[f"__{y}" for y in on.values()])


def _running(n: str, by: list[str], order: list[Column]) -> Column:
    """The sum of n over the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0))


def bitmap_words(rows: DataFrame) -> DataFrame:
    """The bitmaps of rows (grp, id): grp, word, bits, n, before.

    A word covers 64 identifiers: bits tells which of them occur, n counts their rows, before the rows of
    the group in earlier words. Null identifiers are a word of their own, null, before all others.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))
    words = written(rows.groupBy("grp", F.shiftright("id", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")), "words")
    levels = [words.select("grp", F.col("word").alias("k0"), "n")]
    for i, bits in enumerate(RADIX_BITS):
        levels[i] = levels[i].withColumn(f"k{i + 1}", F.shiftright(f"k{i}", bits))
        levels.append(levels[i].groupBy("grp", f"k{i + 1}").agg(F.sum("n").alias("n")))
    top = len(RADIX_BITS)
    before = levels[top].select("grp", f"k{top}", _running("n", ["grp"], [F.col(f"k{top}").asc_nulls_first()]).alias("before"))
    for i in reversed(range(top)):
        own = levels[i].withColumn("within", _running("n", ["grp", f"k{i + 1}"], [F.col(f"k{i}").asc_nulls_first()]))
        before = _joined(own, before, {"grp": "grp", f"k{i + 1}": f"k{i + 1}"}).select("grp", f"k{i}", (F.col("before") + F.col("within")).alias("before"))
    return _joined(words, before.withColumnRenamed("k0", "word"), {"grp": "grp", "word": "word"})


def coordinates(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf, pos, ...) with i: how many rows of the group come before. pos must tell rows apart.

    Order: by id, null first; rows that share it by leaf. Equal leaves are one another's equals, so any
    order of them will do: theirs is that of pos. Ties are counted before they are numbered (by the
    first digits of their leaves, then by leaf and part of the input), so a hot identifier is no hot key.
    """
    words = written(bitmap_words(leaves), "directory")
    popcount = F.coalesce(F.bit_count("bits"), F.lit(0))
    at = F.col("id").bitwiseAND(63).cast("int")
    below = F.when(at > 0, F.bit_count(F.call_function("shiftleft", F.col("bits"), 64 - at))).otherwise(0)
    rows = _joined(leaves.withColumn("word", F.shiftright("id", WORD_BITS)), words.withColumn("tied", F.col("n") > popcount), {"grp": "grp", "word": "word"})
    alone = rows.filter(~F.col("tied")).withColumn("i", F.col("before") + below)
    if not words.filter(F.col("n") > popcount).limit(1).count():
        return alone.select(*leaves.columns, "i")
    tied = rows.filter("tied").withColumns({"digits": F.left("leaf", F.lit(TIE_DIGITS)), "part": F.shiftright("pos", 33)})
    for by, key in ((["grp", "word"], ["id"]), (["grp", "id"], ["digits"]), (["grp", "id", "digits"], ["leaf", "part"])):
        counts = tied.groupBy(*by, *key).agg(F.count("*").alias("rows"))
        counts = counts.select(*by, *key, _running("rows", by, [F.col(k) for k in key]).alias(f"before_{key[0]}"))
        tied = _joined(tied, counts, {c: c for c in (*by, *key)})
    own = F.row_number().over(Window.partitionBy("grp", "id", "leaf", "part").orderBy("pos")) - 1
    tied = tied.withColumn("i", F.col("before") + F.col("before_id") + F.col("before_digits") + F.col("before_leaf") + own)
    return alone.select(*leaves.columns, "i").union(tied.select(*leaves.columns, "i"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_levels(nodes: list[str], total: int, bits: int = BLOCK_BITS) -> list[list[str]]:
    """The nodes of a block, then those of each level above, up to its one node; total is the number of nodes in the block's whole tier."""
    out = [nodes]
    while len(out) <= bits if total > 1 << bits else len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][j : j + 2])) for j in range(0, len(out[-1]), 2)])
    return out


def siblings(levels: list[list[str]], slot: int) -> str:
    """The way from a slot to the node of its block: for each level L or R and the sibling on that side, or - without one."""
    steps = []
    for level in levels[:-1]:
        other = slot ^ 1
        steps.append("-" if other >= len(level) else ("L" if other < slot else "R") + level[other])
        slot >>= 1
    return "".join(steps)


def _steps(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        size = 0 if path[at] == "-" else 64
        yield path[at], path[at + 1 : at + 1 + size]
        at += 1 + size


def proof(path: str) -> str:
    """Digest of the siblings on a path."""
    return _sha("".join(s for _, s in _steps(path)))


def fold(leaf: str, path: str) -> str:
    """The root that follows from a leaf and the siblings on its path."""
    for side, sibling in _steps(path):
        leaf = _sha(sibling + leaf if side == "L" else leaf + sibling)
    return leaf


def _slotted(block: dict, bits: int) -> tuple[list[dict], list[list[str]]]:
    """The entries of a block by slot, and the levels above them."""
    slots: list = [None] * len(block["slots"])
    for x in block["slots"]:
        slots[x["slot"]] = x
    return slots, block_levels([x["digest"] for x in slots], block["total"], bits)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches; only one block at a time is held as Python objects."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _climber(bits: int):
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _one_by_one(batches):
            yield _batch([(b["grp"], b["block"], -(-b["total"] >> bits), _slotted(b, bits)[1][-1][0])], _NODE)

    return climb


def _descender(bits: int, crown: bool):
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _one_by_one(batches):
            slots, levels = _slotted(b, bits)
            yield _batch([(b["grp"], (b["block"] << bits) + i, x["name"], siblings(levels, i) + b["path"], x["digest"] if crown else b["subroot"]) for i, x in enumerate(slots)], _PATH)

    return descend


def _prover(root: str, bits: int):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _one_by_one(batches):
            slots, levels = _slotted(b, bits)
            rows = []
            for i, x in enumerate(slots):
                path = siblings(levels, i) + b["path"]
                folded = fold(x["tampered"] or x["digest"], path)
                rows.append((x["id"], x["digest"], b["subroot"], root, proof(path), folded, folded == root))
            yield _batch(rows, SCHEMA)

    return prove


def _blocks(nodes: DataFrame, bits: int, *more: str) -> DataFrame:
    """Slot arrays of nodes (grp, i, digest, ...) by group and block."""
    slot = F.struct(F.col("i").bitwiseAND((1 << bits) - 1).cast("int").alias("slot"), "digest", *more)
    return nodes.groupBy("grp", F.shiftright("i", bits).alias("block")).agg(F.collect_list(slot).alias("slots"))


def _tree(blocks: DataFrame, largest: int, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers above these blocks (with total), themselves first, and the root of each group; largest is the most nodes that a group has.

    Blocks are written, since they are read going up and going down.
    """
    tiers = []
    while True:
        tiers.append(written(blocks, "blocks"))
        nodes = tiers[-1].mapInArrow(tidy(_climber(bits)), _NODE)
        largest = -(-largest >> bits)
        if largest <= 1:
            return tiers, nodes
        nodes = written(nodes, "nodes").withColumn("name", F.lit(None).cast("string"))
        blocks = _joined(_blocks(nodes, bits, "name"), nodes.groupBy("grp").agg(F.max("total").alias("total")), {"grp": "grp"})


def _paths(tiers: list[DataFrame], above: DataFrame, bits: int, crown: bool = False) -> DataFrame:
    """From the paths above the roots (grp, i, path, subroot) down through the tiers to the paths of all nodes; those of the crown are subroots themselves."""
    for blocks in reversed(tiers):
        above = _joined(blocks, above.select("grp", "i", "path", "subroot"), {"grp": "grp", "block": "i"}).mapInArrow(tidy(_descender(bits, crown)), _PATH)
    return above


def _ranked(groups: DataFrame) -> DataFrame:
    """groups (grp, ...) with i, their place in bytewise order, null first: from the sizes of the parts of a range-partitioned sort."""
    parted = groups.orderBy(F.col("grp").asc_nulls_first()).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    parted = written(parted, "groups")
    sizes = parted.groupBy("part").agg(F.count("*").alias("rows"))  # one row a task
    begins = sizes.select("part", _running("rows", [], [F.col("part")]).alias("begin"))
    return parted.join(begins, "part").withColumn("i", F.col("begin") + F.col("at")).drop("part", "at", "begin")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, tampered_field: str = "n_chars", every: int = 7, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    leaf is leaf_digest of the fields. The leaves of a group (the values of group_col, null is one) ascend
    by identifier, null first; rows that share it by leaf, so that the root depends on the rows alone.
    Every two consecutive nodes (the last may be one) become the digest of both, until one is left: the
    subroot; subroots by group, null first, bytewise, likewise give the root. proof_sha256 is the digest
    of the siblings from the leaf up. folded_root is worked out from leaf and siblings; for rows whose
    CRC-32 of the identifier `every` divides, from a leaf in which tampered_field is greater by one (null
    stays null). verified tells whether it is the root. Other columns are ignored; an empty table gives
    no rows; rows that repeat are leaves each.
    """
    leaf = leaf_digest(*[F.col(f) for f in fields])
    more = F.try_add(F.col(tampered_field), F.lit(1).cast("long"))
    other = leaf_digest(*[more if f == tampered_field else F.col(f) for f in fields])
    marked = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    leaves = docs.select(
        F.col(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), F.when(marked & F.col(tampered_field).isNotNull(), other).alias("tampered"), F.monotonically_increasing_id().alias("pos")
    )
    leaves = written(leaves, "leaves")
    groups = written(leaves.groupBy("grp").agg(F.count("*").alias("total")), "totals")
    top = groups.agg(F.max("total").alias("largest"), F.count("*").alias("groups")).first()
    if not top["groups"]:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    nodes = coordinates(leaves).withColumnRenamed("leaf", "digest")
    tiers, subroots = _tree(_joined(_blocks(nodes, block_bits, "id", "tampered"), groups, {"grp": "grp"}), top["largest"], block_bits)
    ranked = _ranked(subroots.select("grp", "digest"))
    crown = _blocks(ranked.select(F.lit(None).cast("string").alias("grp"), "i", "digest", F.col("grp").alias("name")), block_bits, "name")
    crown_tiers, roots = _tree(crown.withColumn("total", F.lit(top["groups"]).cast("long")), top["groups"], block_bits)
    root = roots.first()["digest"]
    start = roots.select("grp", "i", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
    above = _paths(crown_tiers, start, block_bits, crown=True).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("i"), "path", "subroot")
    above = _paths(tiers[1:], written(above, "paths"), block_bits)
    with_path = _joined(tiers[0], above.select("grp", "i", "path", "subroot"), {"grp": "grp", "block": "i"})
    return with_path.mapInArrow(tidy(_prover(root, block_bits)), SCHEMA)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents, grouped by language."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _field_sql(f: str) -> str:
    return f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')"


_LEAF_SQL = "sha256(" + " || ".join(map(_field_sql, FIELDS)) + ")"
_TAMPERED_SQL = "sha256(" + " || ".join(_field_sql("n_chars + 1" if f == "n_chars" else f) for f in FIELDS) + ")"
# CRC-32 bit by bit over the digits, for doc_ids of up to 20 characters
_CRC_SQL = """list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
  lambda crc, c: list_reduce([xor(crc, c)] || [0::BIGINT FOR k IN range(8)], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF_SQL} AS leaf, CASE WHEN xor({_CRC_SQL}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {_TAMPERED_SQL} END AS tampered,
  FROM documents
), l AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (
  SELECT lang, 0 AS lev, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL SELECT lang, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lev, i // 2, n
), s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lev, i, h, count(*) OVER () AS n FROM s
  UNION ALL SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, i // 2, n
), p AS (
  SELECT r, lang, 0 AS lev, i, coalesce(tampered, leaf) AS cur, '' AS sibs FROM l
  UNION ALL
  SELECT p.r, p.lang, p.lev + 1, p.i // 2, sha256(CASE WHEN p.i % 2 = 1 THEN o.h || p.cur ELSE p.cur || coalesce(o.h, '') END), p.sibs || coalesce(o.h, '')
  FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lev = p.lev AND t.i = p.i AND t.n > 1 LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lev = p.lev AND o.i = xor(p.i, 1)
), g AS (
  SELECT p.r, 0 AS lev, s.i, p.cur, p.sibs FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.lev = (SELECT max(t.lev) FROM t WHERE t.lang IS NOT DISTINCT FROM p.lang)
  UNION ALL
  SELECT g.r, g.lev + 1, g.i // 2, sha256(CASE WHEN g.i % 2 = 1 THEN o.h || g.cur ELSE g.cur || coalesce(o.h, '') END), g.sibs || coalesce(o.h, '')
  FROM g JOIN u ON u.lev = g.lev AND u.i = g.i AND u.n > 1 LEFT JOIN u o ON o.lev = g.lev AND o.i = xor(g.i, 1)
)
SELECT l.doc_id, l.leaf, s.h AS subroot, u.h AS root, sha256(g.sibs) AS proof_sha256, g.cur AS folded_root, g.cur = u.h AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.n = 1 JOIN g ON g.r = l.r AND g.lev = u.lev
"""
