"""Approximate nearest neighbours through low-dimensional stable projections.

Vectors are scaled to length one, so the largest cosine is the smallest Euclidean distance, and
projected to a few dimensions by a Gaussian (2-stable) matrix: a projected squared distance, divided by
the true one, follows a chi-square law. Projected vectors are indexed by kd-trees. A query takes points
by growing projected distance, verifies each on the original vectors, and stops once the next projected
distance is so large that a point nearer than its k-th best would, with the given confidence, have come
before.

The top of the kd-tree is cut on a bounded sample and splits the table into cells; crowded cells are
dealt to several shards. A query first searches one shard of its own cell. What it finds there bounds
its search: only shards whose box the chi-square test does not rule out are visited then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.scratch import written

DIMENSIONS = 10
CONFIDENCE = 0.99
# The 0.99 quantile of the chi-square law with 4 to 16 degrees of freedom.
CHI_SQUARE_99 = {4: 13.277, 5: 15.086, 6: 16.812, 7: 18.475, 8: 20.090, 9: 21.666, 10: 23.209, 11: 24.725, 12: 26.217, 13: 27.688, 14: 29.141, 15: 30.578, 16: 32.000}
SAMPLE = 4096
SHARD_ROWS = 8192
LEAF = 64
QUERY_BLOCK = 4096
EXACT_BLOCK = 1024
BOXES = 100_000  # that may be broadcast; 1024 a width at most
TIE = 1e-9


def projection(width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The Gaussian matrix for vectors of this width; its rows are the same on every machine."""
    return np.random.default_rng(width).standard_normal((width, dimensions))


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of x with y (one row, or as many), summed component by component as SQL engines do."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[..., d]
    return out


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q; vectors whose squares leave the range of doubles are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        square = in_order(x, x) * in_order(q[None, :], q)[0]
        plain = in_order(x, q) / np.sqrt(square)
    odd = ~((square > 1e-290) & (square < 1e290))
    if odd.any():
        plain[odd] = in_order(unit(list(x[odd])), unit([q])[0])
    return np.clip(plain, -1, 1)


class KdTree:
    """Leaves of at most LEAF points with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order, self.cuts = np.arange(len(points)), [0]
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= LEAF:
                self.cuts.append(b)
                continue
            part = self.order[a:b]
            axis = int(np.argmax(np.ptp(points[part], axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = part[np.argpartition(points[part, axis], mid)]
            stack += [(a + mid, b), (a, a + mid)]
        self.low = np.minimum.reduceat(points[self.order], self.cuts[:-1])
        self.high = np.maximum.reduceat(points[self.order], self.cuts[:-1])

    def lower_bounds(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances (queries, leaves) from each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.low)))
        for d in range(queries.shape[1]):
            x = queries[:, d, None]
            gap = np.maximum(self.low[None, :, d] - x, x - self.high[None, :, d])
            np.maximum(gap, 0, out=gap)
            out += gap * gap
        return out


def exact_best(raw: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The k of rows with the largest exact cosines, smaller identifiers first among equals; in blocks, so that memory stays bounded."""
    top, scores = np.empty(0, np.int64), np.empty(0)
    for a in range(0, len(rows), EXACT_BLOCK):
        block = rows[a : a + EXACT_BLOCK]
        top, scores = np.concatenate([top, block]), np.concatenate([scores, cosines(raw[block], q)])
        order = np.lexsort((ids[top], -scores))[:k]
        top, scores = top[order], scores[order]
    return top


def search(points: np.ndarray, raw: np.ndarray, ids: np.ndarray, tree: KdTree, q: np.ndarray, own: int, bounds: np.ndarray, k: int, worst: float, quantile: float) -> np.ndarray:
    """Rows of the k nearest points and those level with the last: leaves are verified by growing bound, in doubling steps, until the test holds.

    raw and q are the vectors as given, points those of length one. worst is a cosine that k candidates
    elsewhere reach; the test may use it from the start.
    """
    query = unit([q])[0]
    nearest = np.argsort(bounds, kind="stable")
    sorted_bounds = bounds[nearest]
    rows, best = np.empty(0, np.int64), np.empty(0)
    at, step = 0, 2
    while at < len(nearest):
        bar = max(worst, best[k - 1]) if len(best) >= k else worst
        if sorted_bounds[at] > quantile * max(0.0, 2 - 2 * bar) + TIE:
            break
        leaves = nearest[at : at + step].tolist()
        new = np.concatenate([tree.order[tree.cuts[x] : tree.cuts[x + 1]] for x in leaves])
        new = new[ids[new] != own]
        rows, best = np.concatenate([rows, new]), np.concatenate([best, points[new] @ query])
        if len(best) > k:  # what is level by rounding is told apart later, on the original vectors
            keep = best >= np.partition(best, len(best) - k)[len(best) - k] - TIE
            rows, best = rows[keep], best[keep]
        if len(best) > 8 * k:  # many are level: what is not among the k best by exact score can't come back
            rows = exact_best(raw, ids, rows, q, k)
            best = points[rows] @ query
        top = np.lexsort((ids[rows], -best))
        rows, best = rows[top], best[top]
        at, step = at + len(leaves), step * 2
    return rows


def split_planes(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """The top of the kd-tree as a heap of (axis, value) with `cells` leaves, a power of two."""
    planes: list[tuple[int, float]] = []
    level = [sample]
    while len(planes) < cells - 1:
        below = []
        for part in level:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            planes.append((axis, value))
            below += [part[part[:, axis] < value], part[part[:, axis] >= value]] if len(part) else [part, part]
        level = below
    return planes


def cell_of(points: np.ndarray, planes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axes, values = (np.array([p[i] for p in planes]) for i in (0, 1)) if planes else (None, None)
    while planes and (at < len(planes)).all():
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at].astype(int)] >= values[at])
    return at - len(planes)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vec")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & fine)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k nearest rows of vectors by cosine, but those of its own identifier.

    Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows
    without an identifier; vectors of different widths never meet. Fewer than k candidates are all
    returned. Ties go to the smaller identifier; repeated (identifier, vector) rows count once; further
    columns are ignored.
    """
    quantile = CHI_SQUARE_99[dimensions]
    rows = _usable(vectors, id_col, vector_col).withColumn("width", F.size("vec")).dropDuplicates(["id", "vec"])
    asked = _usable(queries, id_col, vector_col).withColumn("width", F.size("vec")).dropDuplicates(["id", "vec"])
    # index: the top of the tree from a bounded sample, then boxes and counts of its cells
    total = rows.count()
    # which rows the sample takes depends on the rows alone; about SAMPLE of them
    keep = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) // max(1, total)))
    sample = [np.asarray(r["vec"]) for r in rows.filter(keep).select("vec").limit(2 * SAMPLE).collect()]
    planes: dict[int, list[tuple[int, float]]] = {}
    cells = 1
    while cells * shard_rows < total and cells < 1024:
        cells *= 2
    for width in sorted({len(v) for v in sample}):
        planes[width] = split_planes(unit([v for v in sample if len(v) == width]) @ projection(width, dimensions), cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, part in pdf.groupby("width"):
                low = unit(part["vec"].tolist()) @ projection(int(width), dimensions)
                yield pd.DataFrame({"id": part["id"], "vec": part["vec"], "width": part["width"], "cell": cell_of(low, planes.get(int(width), [])), "low": list(low)})

    placed = "id long, vec array<double>, width int, cell long, low array<double>"
    points = written(rows.mapInPandas(place, placed), "points")
    hunts = written(asked.mapInPandas(place, placed), "queries")
    ends = [f(F.get("low", i)).alias(f"{n}{i}") for i in range(dimensions) for n, f in (("a", F.min), ("b", F.max))]
    boxes = points.groupBy("width", "cell").agg(F.count("*").alias("n"), *ends).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    boxes = written(boxes, "boxes")
    gap = [F.greatest(F.col(f"a{i}") - F.get("low", i), F.get("low", i) - F.col(f"b{i}"), F.lit(0.0)) for i in range(dimensions)]
    bound = sum((g * g for g in gap[1:]), gap[0] * gap[0])

    def by_shard(asks: DataFrame) -> DataFrame:
        """Searches (width, cell, shard, ...) against the rows of that shard, QUERY_BLOCK of them at a time."""
        where = ["width", "cell", "shard"]
        blocks = asks.groupBy(*where).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        asks = asks.join(blocks, where).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
        dealt = points.join(boxes.select("width", "cell", "shards"), ["width", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
        dealt = dealt.join(blocks, where).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cols = [*where, "block", "worst", "id", "vec", "low"]
        both = dealt.withColumn("worst", F.lit(None).cast("double")).select(*cols).union(asks.select(*cols))
        return both.groupBy(*where, "block").applyInPandas(_searcher(k, quantile), "qid long, vec_id long, score double")

    # first one shard of its own cell
    own = hunts.join(boxes.select("width", "cell", "shards"), ["width", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("worst", F.lit(-2.0))
    first = written(by_shard(own), "first")
    known = first.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list("score"), False), k, 1).alias("kth")).select(F.col("qid").alias("id"), F.get("kth", 0).alias("worst"))
    rest = hunts.withColumnRenamed("cell", "home").join(known, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    # a query against the boxes of all cells, of which there are 1024 at most, as a stated query set
    few = boxes.count() <= BOXES
    rest = rest.join(F.broadcast(boxes) if few else boxes.hint("merge"), "width").filter(bound <= quantile * (2 - 2 * F.col("worst")) + TIE)
    rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    home = (F.col("home") == F.col("cell")) & (F.col("shard") == F.pmod(F.xxhash64("id"), F.col("shards")))
    found = first.union(by_shard(rest.filter(~home))).distinct()
    # exact scores on the original vectors come with the verification; rank them
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searcher(k: int, quantile: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["worst"].notna()
        data, asks = pdf[~is_query], pdf[is_query]
        if data.empty or asks.empty:
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        raw = np.array(data["vec"].tolist(), np.float64)
        points, ids, low = unit(list(raw)), data["id"].to_numpy(), np.array(data["low"].tolist())
        tree = KdTree(low)
        out: list[tuple[int, int, float]] = []
        vectors, spots = np.array(asks["vec"].tolist(), np.float64), np.array(asks["low"].tolist())
        for a in range(0, len(asks), 256):
            bounds = tree.lower_bounds(spots[a : a + 256])
            for own, q, b, worst in zip(asks["id"].tolist()[a : a + 256], vectors[a : a + 256], bounds, asks["worst"].tolist()[a : a + 256], strict=True):
                rows = search(points, raw, ids, tree, q, own, b, k, worst, quantile)
                scores = cosines(raw[rows], q)
                top = np.lexsort((ids[rows], -scores))[:k]
                out += [(own, int(ids[rows[i]]), float(scores[i])) for i in top.tolist()]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"])

    return run


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest neighbours of every fiftieth vector among all others; empty and unusable vectors take no part."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
