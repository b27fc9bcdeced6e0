"""Exact dedup with Patricia-trie owners.

Equal texts are found by their full bytes, not by a hash alone. Rows are partitioned by (length,
content hash) of the normalised text; each task inserts the byte strings into a compressed radix trie
whose terminal nodes hold the owner (the row that stays) and the number of rows. Before the shuffle
every task merges its own rows in such a trie too, so a text that a third of all rows share crosses
the network once a task. A trie beyond its memory bound hands out its largest subtrees and goes on:
before the shuffle at any time, after it between two keys, when all other strings are complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"
TRIE_BYTES = 48 << 20
_ROW_BYTES = 300  # of a node beside its label
_LAST = (1 << 63) - 1  # stands for a null identifier, which any other precedes

_SCHEMA = "nbytes long, sha binary, body binary, points long, owner long, n long"


class _Node:
    __slots__ = ("best", "kids", "label", "n")

    def __init__(self, label: bytes):
        self.label, self.kids, self.n, self.best = label, {}, 0, None


def _common(a: bytes, b: memoryview) -> int:
    """Length of the common prefix, by halving."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Byte strings with, at each terminal node, rows counted and the best (-points, identifier, payload)."""

    def __init__(self):
        self.root, self.bytes = _Node(b""), 0

    def insert(self, key: bytes, best: tuple, n: int) -> None:
        node, rest = self.root, memoryview(key)
        while len(rest):
            kid = node.kids.get(rest[0])
            if kid is None:
                kid = node.kids[rest[0]] = _Node(bytes(rest))
                self.bytes += len(rest) + _ROW_BYTES
                node, rest = kid, rest[len(rest) :]
                break
            same = _common(kid.label, rest)
            if same < len(kid.label):
                upper = _Node(kid.label[:same])
                kid.label = kid.label[same:]
                upper.kids[kid.label[0]] = kid
                node.kids[rest[0]] = kid = upper
                self.bytes += _ROW_BYTES
            node, rest = kid, rest[same:]
        node.n += n
        node.best = best if node.best is None else min(node.best, best)

    def take(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple, int]]:
        """Every string below node with its best and count."""
        stack = [(node or self.root, prefix)]
        while stack:
            x, before = stack.pop()
            key = before + x.label
            if x.n:
                yield key, x.best, x.n
            stack.extend((kid, key) for kid in x.kids.values())

    def spill(self, room: int) -> Iterator[tuple[bytes, tuple, int]]:
        """Hand out and forget subtrees below the root, the largest first, until at most `room` bytes are in use."""
        sizes = {byte: self._size(kid) for byte, kid in self.root.kids.items()}
        for byte in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.bytes <= room:
                return
            yield from self.take(self.root.kids.pop(byte))
            self.bytes -= sizes[byte]

    @staticmethod
    def _size(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + _ROW_BYTES
            stack.extend(x.kids.values())
        return total


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["nbytes", "sha", "body", "points", "owner", "n"])


def _emit(found: Iterator[tuple[bytes, tuple, int]], with_body: bool) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for key, (points, owner, sha), n in found:
        rows.append((len(key), sha, key if with_body else None, -points, owner, n))
        size += len(key) + 100
        if size > 4 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _merge_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: one row for each text of this task, or of as many rows as the bound admits."""
    trie = PatriciaTrie()
    for batch in batches:
        for _, sha, body, points, owner, n in _rows(batch):
            trie.insert(body, (-points, owner, sha), n)
            if trie.bytes > TRIE_BYTES:
                yield from _emit(trie.spill(TRIE_BYTES // 2), True)
    yield from _emit(trie.take(), True)


def _merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (length, hash): where a new key begins all strings in the trie are complete, and subtrees may go."""
    trie, at, last = PatriciaTrie(), (-1, b""), b""
    for batch in batches:
        for nbytes, sha, body, points, owner, n in _rows(batch):
            if (nbytes, sha) != at:
                at, last = (nbytes, sha), body
                if trie.bytes > TRIE_BYTES:
                    yield from _emit(trie.spill(TRIE_BYTES // 2), False)
            elif body != last:  # two owners for one key: better no result than a wrong one
                raise ValueError("two different texts have the same length and SHA-256")
            trie.insert(body, (-points, owner, sha), n)
    yield from _emit(trie.take(), False)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when identical without ASCII white space. Of equal texts the one with the most
    code points stays, then the one with the smallest identifier. Null text counts as empty, and all
    empty texts are equal. A null identifier comes after all others; keep_id is null where a group has
    no other. Rows that repeat both identifier and text are the same document and are marked alike, as
    are rows of one identifier whose texts are equal and have equally many code points.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        norm.alias("body"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
    ).withColumns({"nbytes": F.octet_length("body").cast("long"), "sha": F.unhex(F.sha2(F.col("body").cast("binary"), 256))})
    owners = (
        rows.select("nbytes", "sha", F.col("body").cast("binary").alias("body"), "points", F.coalesce("doc_id", F.lit(_LAST)).alias("owner"), F.lit(1).cast("long").alias("n"))
        .mapInArrow(_merge_own, _SCHEMA)
        .repartition("nbytes", "sha")
        .sortWithinPartitions("nbytes", "sha")
        .mapInArrow(_merge_all, _SCHEMA)
        .select("nbytes", "sha", F.col("points").alias("most"), F.nullif("owner", F.lit(_LAST)).alias("keep_id"), F.col("n").alias("group_size"))
    )
    return rows.select("doc_id", "points", "nbytes", "sha").join(owners, ["nbytes", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("points").alias("n_points"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, (array_agg(doc_id ORDER BY n_points DESC, doc_id ASC))[1] AS keep_id FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256, CAST(t.n_points AS BIGINT) AS n_points
FROM t JOIN g ON t.norm = g.norm
"""
