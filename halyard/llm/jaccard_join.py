"""N-gram Jaccard join by chosen paths.

A text is its set of word shingles, and texts with the same set are one node. Each node has a minhash
signature: for each position the shingle of the set that a random order puts first, a token sampled
from the set. A run starts from one bucket with all nodes. Each bucket samples a position and sends its
nodes on to the child that their token at that position names, so similar sets, which share most
tokens, keep to one path. Buckets of at most LIMIT nodes are compared by brute force; larger ones are
split again. From DEPTH on a bucket samples several positions at once, so that next to no similar pair
is parted, and is split only where that at least halves the pairs: what is left are large groups of
sets that are alike. Runs are repeated until a pair at the threshold is met with the target recall.

Work in a bucket is cut into pairs of blocks of nodes, bounded in rows and in shingles, so a task never
holds more than two blocks, and pairs are never written: a pair counts in the first of the buckets that
its ends share, and each node carries the list of its buckets to tell. The output is linear in the nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.components import connected_components
from halyard.llm.scratch import written
from halyard.llm.words import chunks, mix, shingle_sets
from halyard.llm.workers import tidy

POSITIONS = 64
LIMIT = 256
DEPTH = 3
DEEPEST = 5
BLOCK = 512
BLOCK_SHINGLES = 1 << 21
SLICE = 1 << 20
RECALL = 0.999

_A = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(101, POSITIONS + 101, dtype=np.uint64))


def sketch_share(threshold: float) -> float:
    """The share of positions at which sketches must agree: five standard deviations below what a pair at the threshold has on average."""
    return max(0.0, threshold - 5 * math.sqrt(threshold * (1 - threshold) / POSITIONS))


def spread(threshold: float) -> int:
    """How many positions a bucket samples from DEPTH on, so that a pair at the threshold is parted by all of them once in 200 times at most."""
    return math.ceil(math.log(0.005) / math.log(max(1e-9, 1 - threshold)))


def met(depth: int, threshold: float = 0.8) -> float:
    """Probability that one run takes a pair at the threshold to a common bucket at this depth."""
    return threshold ** min(depth, DEPTH) * (1 - (1 - threshold) ** spread(threshold)) ** max(0, depth - DEPTH)


def runs_needed(recall: float = RECALL, depth: int = DEEPEST, threshold: float = 0.8) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-300, 1 - met(depth, threshold)))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash values (sets, POSITIONS) as 32-bit integers; each set must have an element."""
    begins = np.cumsum([0, *(len(s) for s in sets[:-1])])
    values = np.concatenate(sets)
    out = np.empty((len(sets), POSITIONS), np.uint32)
    for i in range(POSITIONS):
        out[:, i] = np.minimum.reduceat((values * _A[i] + _B[i]) >> np.uint64(32), begins)
    return out


def node_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return np.array([mix(shingles).sum(), mix(shingles ^ _A[0]).sum() + np.uint64(len(shingles))], np.uint64).tobytes()


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys, sigs, sizes = [], [], []
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], k)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                for s in sets:
                    keys.append(node_key(s) if len(s) else None)
                    sigs.append(next(rows).tobytes() if len(s) else None)
                    sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())], ["doc_id", "text_hash", "node", "sig", "size"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                sets = [s for s in shingle_sets(texts[a:b], k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return run


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _sampled(path: Column, draw: int = 0) -> Column:
    """The position that bucket `path` samples."""
    return F.pmod(F.xxhash64(path, F.lit(POSITIONS + draw)), F.lit(POSITIONS)).cast("int")


def _child(path: Column, sig: Column, position: Column, draw: int = 0) -> Column:
    """Where bucket `path` sends a node with this signature."""
    token = F.substring(sig, position * 4 + 1, F.lit(4))
    return F.xxhash64(path, token, F.lit(draw)) if draw else F.xxhash64(path, token)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, bi, bj), one batch for each key."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in range(3))

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(3)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and key(held[0], 0) != key(part, 0):
                yield whole(held)
                held = []
            held.append(part)
    if held:
        yield whole(held)


def _own_pairs(group: pa.RecordBatch) -> np.ndarray:
    """Which pairs (i, j), i before j, count here: those of the two blocks that share no earlier bucket."""
    n = group.num_rows
    path, bi, bj = (group.column(c)[0].as_py() for c in range(3))
    mine = group.column("mine").to_numpy()
    allowed = np.triu(np.ones((n, n), bool), 1) if bi == bj else (mine == bi)[:, None] & (mine == bj)[None, :]
    leaves = group.column("leaves")
    flat = leaves.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), np.diff(leaves.offsets.to_numpy()))
    earlier = flat < path
    _, at, count = np.unique(flat[earlier], return_inverse=True, return_counts=True)
    again = count[at] > 1
    if again.any():
        has = np.zeros((n, int((count > 1).sum())), np.float32)
        has[owner[earlier][again], (np.cumsum(count > 1) - 1)[at[again]]] = 1
        allowed &= (has @ has.T) < 0.5
    return allowed


def _sketch(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block pair the rows that have, by their sketches, a partner they may be similar to."""
    need = sketch_share(threshold) * POSITIONS
    rows: list[list] = [[] for _ in range(5)]
    for group in _groups(batches):
        n = group.num_rows
        if n < 2:
            continue
        sketch = _matrix(group.column("sketch"), np.uint8, POSITIONS)
        close = np.empty((n, n), bool)
        for a in range(0, n, 128):
            close[a : a + 128] = (sketch[a : a + 128, None, :] == sketch[None, :, :]).sum(2) >= need
        if not close.sum() > n:
            continue
        close &= _own_pairs(group)
        for i in np.flatnonzero(close.any(0) | close.any(1)).tolist():
            for c, out in enumerate(rows):
                out.append(group.column(c)[i].as_py())
        if len(rows[0]) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, _MEMBER, strict=True)], ["path", "bi", "bj", "mine", "node"])
            rows = [[] for _ in range(5)]
    yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, _MEMBER, strict=True)], ["path", "bi", "bj", "mine", "node"])


_MEMBER = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
MEMBER_SCHEMA = "path long, bi int, bj int, mine int, node binary"


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets of distinct elements, by ranges of about SLICE elements."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    parts = -(-sum(map(len, sets)) // SLICE)
    bounds = [np.uint64(i * ((1 << 64) // max(1, parts))) for i in range(1, parts)]
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for i in range(parts):
        within = [s[c[i] : c[i + 1]] for s, c in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(n), [len(s) for s in within])
        _, at, count = np.unique(np.concatenate(within), return_inverse=True, return_counts=True)
        keep = count[at] > 1
        at, owner = (np.cumsum(count > 1) - 1)[at[keep]], owner[keep]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            out += m @ m.T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[bytes] = []
        links: list[int] = []
        roots: list[bytes] = []
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            both = intersections(sets)
            linked = (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6) & _own_pairs(group)
            if not linked.any():
                continue
            linked |= linked.T
            weight = group.column("weight").to_numpy()
            label = np.arange(len(sets))
            while True:
                near = np.minimum(label, np.where(linked, label[None, :], len(sets)).min(1))
                near = near[near]
                if (near == label).all():
                    break
                label = near
            names = group.column("node").to_pylist()
            for i in np.flatnonzero(linked.any(1)).tolist():
                nodes.append(names[i])
                links.append(int(weight[linked[i]].sum()))
                roots.append(names[label[i]])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["node", "links", "root"])

    return run


def _sized(members: DataFrame) -> DataFrame:
    """members (path, node, size, ...) with the number n and the shingles of each bucket, for those of n > 1. Buckets are counted before they are shuffled, and the join can be split."""
    sizes = written(members.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("n > 1"), "sizes")
    return written(members.join(sizes, "path"), "level")


def _leaves(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(path, node, n, shingles): all buckets to compare, of all runs."""
    # the runs' first positions are all different, as far as there are enough
    starts = [_child(F.lit(r), F.col("sig"), F.lit(r * 7 % POSITIONS)) for r in range(runs_needed(recall, DEEPEST, threshold))]
    cols = ["path", "node", "n", "shingles"]
    level = _sized(nodes.select("node", "size", F.explode(F.array(*starts)).alias("path")))
    out = level.filter(F.col("n") <= LIMIT).select(*cols)
    for depth in range(2, DEEPEST + 1):
        large = level.filter(F.col("n") > LIMIT)
        if not large.limit(1).count():
            return out
        path, sig, draws = F.col("path"), F.col("sig"), 1 if depth <= DEPTH else spread(threshold)
        children = F.array(*[_child(path, sig, _sampled(path, i), i) for i in range(draws)])
        below = large.select("path", "node", "n", "size").join(nodes.select("node", "sig"), "node")
        below = _sized(below.select("node", "size", F.col("path").alias("parent"), F.col("n").alias("parent_n"), F.explode(children).alias("path")))
        if depth > DEPTH:
            # each bucket's pairs are the sum of n - 1 over its rows; buckets all of whose children are single have no row here and are done
            helped = below.groupBy(F.col("parent").alias("path")).agg(F.sum("n").alias("pairs"), F.first("parent_n").alias("parent_n"))
            stay = written(helped.filter(F.col("pairs") > F.col("parent_n") * F.col("parent_n") / 2).select("path"), "stay")
            out = out.union(large.join(stay, "path", "left_semi").select(*cols))
            below = below.join(stay.withColumnRenamed("path", "parent"), "parent", "left_anti")
        level = below
        out = out.union((level if depth == DEEPEST else level.filter(F.col("n") <= LIMIT)).select(*cols))
    return out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, rep_id, n_copies, n_links, class_id, class_size.

    Shingles are of k words; a text of fewer words has one shingle of all its words. rep_id and
    n_copies tell of the texts with the same set of shingles; n_links counts all other rows whose set
    has a Jaccard similarity of at least the threshold (those copies too); class_id is the smallest
    identifier that links lead to, class_size the number of its rows. A text without words, or null,
    links with nothing and is a class of its own. A null identifier never names a class unless it is
    alone there. text_hash is xxhash64 of the text, null as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    features = written(rows.mapInArrow(tidy(_features(k)), "doc_id long, text_hash long, node binary, sig binary, size int"), "features")
    nodes = written(
        features.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("rep"), F.first("sig").alias("sig"), F.first("size").alias("size")),
        "nodes",
    )
    leaves = _leaves(nodes, threshold, recall)
    own = leaves.groupBy("node").agg(F.sort_array(F.collect_list("path")).alias("leaves"))
    own = written(own.join(nodes, "node").select("node", "weight", "rep", "leaves", _low_bytes("sig")), "members")
    block = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("mine", j).alias("bi"), F.greatest("mine", j).alias("bj")))
    blocks = leaves.withColumn("nb", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")).withColumn("mine", block).select("path", "node", "mine", F.explode(pairs).alias("b")).select("path", "b.bi", "b.bj", "mine", "node")
    by = ["path", "bi", "bj"]
    near = blocks.join(own.select("node", "leaves", "sketch"), "node").select(*by, "mine", "node", "leaves", "sketch").repartition(*by).sortWithinPartitions(*by)
    near = written(near.mapInArrow(tidy(partial(_sketch, threshold)), MEMBER_SCHEMA), "near")
    reps = near.select("node").distinct().join(own.select("node", "rep"), "node").select(F.col("rep.doc_id").alias("rid"), F.col("rep.text_hash").alias("rhash"))
    # without the hint a small table of representatives would be broadcast, and a larger one not
    sets = rows.join(reps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("text_hash") == F.col("rhash")), "left_semi").select("text")
    sets = sets.mapInArrow(tidy(_sets(k)), "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    full = near.join(sets, "node").join(own.select("node", "weight", "leaves"), "node").select(*by, "mine", "node", "weight", "leaves", "shingles")
    found = written(full.repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(_verify(threshold)), "node binary, links long, root binary"), "links")
    labels = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "weight", F.col("rep.doc_id").alias("rep_id")).join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("rep_id").alias("class_id"), F.sum("weight").alias("class_size"))
    named = named.join(classes, "label").select("node", "label", "rep_id", F.col("weight").alias("n_copies"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id", "class_size")
    one = F.lit(1).cast("long")
    return features.select("doc_id", "text_hash", "node").join(named, "node", "left").select(
        "doc_id",
        "text_hash",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"),
        F.coalesce("n_copies", one).alias("n_copies"),
        F.coalesce("n_links", one - 1).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", one).alias("class_size"),
        F.col("label").alias("class_key"),
    )


def _low_bytes(sig: str):
    """The lowest byte of each 32-bit value of a signature."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.substring(F.hex(sig), i * 8 + 1, F.lit(2))), "")).alias("sketch")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the one with the smallest identifier, then text hash. Texts without words all stay."""
    marked = jaccard_classes(docs, id_col, text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    stay = marked.filter("class_key IS NOT NULL").groupBy("class_key").agg(first.alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.text_hash").alias("__hash"), F.lit(True).alias("__once"))
    stay = stay.union(marked.filter("class_key IS NULL").select("doc_id", "text_hash", F.lit(False)).distinct())
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = hashed.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")))
    # rows that repeat both identifier and text are copies too
    again = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__id"))
    return kept.withColumn("__again", again).filter(~F.col("__once") | (F.col("__again") == 1)).select(*docs.columns)


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "class_key")
