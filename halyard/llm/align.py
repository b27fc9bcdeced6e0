"""Alignment of two tokenizers over a corpus: which tokens stand for the same bytes, and how often.

Each text is encoded twice. Where tokens of both end at the same byte they are cut into groups; every
A token of a group is linked to every B token of it. A pair of ids counts the documents that link it.

Counting is external. A task turns its texts into records (pair, document, links), sorted by radix of the
A id, A id, B id and document, and packs them into zstd runs of bounded size: one of the records, which
is not moved until the end, and for each radix one of the pairs with their numbers of documents. Runs of
pairs are merged, FAN at a time, by a k-way heap until a radix has one. Runs are side-major (all pairs of
an A id follow one another), so the merge also yields each A id's highest count; each merge hands counts and
maxima back to the runs it was made of, and at last they meet the records, run by run. Records are
never shuffled by pair: a pair that most documents hold is one entry a run.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.scratch import written
from halyard.llm.spm import MARK, Codec, Model
from halyard.llm.tokens import UnitEncoder, byte_letters
from halyard.llm.words import chunks
from halyard.llm.workers import kept, tidy

RADIX = 64
FAN = 64  # runs merged at once, about
CHUNK_CHARS = 1 << 21  # texts of one run of records, more only where one text is longer
SLICE_LINKS = 1 << 21  # links expanded at once; more are cut by A id into several runs (an id's own links of a chunk are not cut)
JOINED = 256  # new words encoded in one call
WIDE = 64  # links of a group from which its tokens are made distinct first
HASHED = 1 << 20  # tokens written out at once for hashing

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
DOC, RECORDS, PAIRS = 0, 1, 2
# rows of three kinds: a document (chunk, at, ...), the records of a run (chunk, run, ...), the pairs of a run and radix (run, radix, ...)
_SPILL = "kind int, chunk long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, run long, radix int, pairs binary, counts binary, docs binary, links binary"
_PART = "run long, radix int, pairs binary, counts binary"
_ANSWER = "run long, radix int, totals binary, best binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers as zstd of their narrowest type."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
    return str(kind.itemsize).encode() + zstandard.compress(np.ascontiguousarray(x, kind.newbyteorder("<")).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.int64)


def packed_rising(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=0))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


class _Pieces(Codec):
    """The codec without its checks; new words are encoded many at a time where no piece crosses the front of a word."""

    def __init__(self, path: str, cached: int):
        super().__init__(path, verify=False, cached=cached)
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])

    def _ids(self, marked: list[str], given: list[str]) -> tuple[list[bytes], np.ndarray]:
        found = self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found], np.zeros(len(found), np.uint8)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = [MARK + MARK.join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), "<u4", sum(map(len, found)))
        return ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids)), np.zeros(len(words), np.uint8)


class _Spelled:
    """The bytes that ids stand for."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def give(self, ids: list[np.ndarray], wanted: list[bytes]) -> np.ndarray:
        """For each text whether its ids stand for just these bytes."""
        good = np.array([int(self.size[x].sum()) == len(w) for x, w in zip(ids, wanted, strict=True)], bool)
        at = np.flatnonzero(good).tolist()
        if not at:
            return good
        flat = np.concatenate([ids[i] for i in at])
        size = self.size[flat]
        ends = np.cumsum(size)
        own = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(self.begin[flat] - (ends - size).astype(np.int32), size)
        same = self.bytes[own] == np.frombuffer(b"".join(wanted[i] for i in at), np.uint8)
        good[at] = np.logical_and.reduceat(same, np.cumsum([0, *(len(wanted[i]) for i in at[:-1])]))
        return good


class Aligner:
    """Both encoders, and what the bytes and the written forms of their ids are."""

    def __init__(self, a_path: str, b_path: str, cached: int = 500_000):
        self.a, self.b = UnitEncoder(a_path, special_as_text=True, cached=cached), _Pieces(b_path, cached)
        if not self.b.model.splits_at_words:
            raise ValueError("pieces cross the fronts of words")
        byte_of = {chr(c): b for b, c in byte_letters().items()}
        vocab = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t if c in byte_of)
        self.b_bytes = self.b.bytes
        self.a_spelled, self.b_spelled = _Spelled(self.a_bytes), _Spelled(self.b_bytes)
        self.a_size, self.b_size = self.a_spelled.size, self.b_spelled.size
        n = max(len(self.a_bytes), len(self.b_bytes))
        width = len(str(n)) + 1
        self.written = np.zeros((3 * n, width), np.uint8)  # each id with a comma, a bar or a semicolon behind it
        for k, mark in enumerate(",|;"):
            for i in range(n):
                s = f"{i}{mark}".encode()
                self.written[k * n + i, : len(s)] = np.frombuffer(s, np.uint8)
        self.n_ids, self.b_bits = n, int(len(self.b_bytes) - 1).bit_length()
        self.per_radix = -(-len(self.a_bytes) // RADIX)

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none unless both stand for the bytes of a blank and the text."""
        a = [np.frombuffer(x, "<u4") for x in self.a.encode([" " + t for t in texts])]
        b = [np.frombuffer(x, "<u4") for x in self.b.encode(texts)[0]]
        wanted, none = [b" " + t.encode() for t in texts], np.empty(0, np.uint32)
        for i in np.flatnonzero(~(self.a_spelled.give(a, wanted) & self.b_spelled.give(b, wanted))).tolist() + [i for i, t in enumerate(texts) if not t]:
            a[i] = b[i] = none
        return a, b

    def groups(self, texts: list[str]) -> Groups:
        a, b = self._ids(texts)
        return Groups(self, a, b)


class Groups:
    """The groups of several texts one after another: ids a and b, the group of each token, the text of each group."""

    def __init__(self, aligner: Aligner, a: list[np.ndarray], b: list[np.ndarray]):
        self.aligner, self.n_a, self.n_b = aligner, np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        none = [np.empty(0, np.uint32)]
        self.a, self.b = (np.concatenate([*x, *none]).astype(np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(aligner.a_size[self.a]), np.cumsum(aligner.b_size[self.b])
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        self.last_a, self.last_b = last_a, last_b
        self.of_a, self.of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = int(last_a.sum())
        self.size_a, self.size_b = np.bincount(self.of_a, minlength=n), np.bincount(self.of_b, minlength=n)
        self.text = np.repeat(np.arange(len(a)), self.n_a)[last_a]
        self.n_groups = np.bincount(self.text, minlength=len(a))
        self.n_links = np.zeros(len(a), np.int64)
        np.add.at(self.n_links, self.text, self.size_a * self.size_b)

    def digests(self) -> list[str]:
        """For each text the SHA-256 of its groups as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        n, table = self.aligner.n_ids, self.aligner.written
        before_b, with_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + before_b[self.of_a]] = self.a + n * self.last_a
        code[np.arange(len(self.b)) + with_a[self.of_b]] = self.b + 2 * n * self.last_b
        out, at = [], 0
        for size in (self.n_a + self.n_b).tolist():
            sha, end = hashlib.sha256(), at + size
            for k in range(at, end, HASHED):
                chars = table[code[k : min(k + HASHED, end)]]
                chars = chars[chars != 0]
                sha.update(chars[: len(chars) - (k + HASHED >= end)].tobytes())  # the last semicolon goes
            out.append(sha.hexdigest() if size else "")
            at = end
        return out

    def _side(self, ids: np.ndarray, of: np.ndarray, wide: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, id and number of tokens, by group; the tokens of wide groups made distinct."""
        many = wide[of]
        if not many.any():
            return of, ids, np.ones(len(ids), np.int64)
        key, n = np.unique(of[many] * n_ids + ids[many], return_counts=True)
        group, own, n = (np.concatenate(x) for x in ((of[~many], key // n_ids), (ids[~many], key % n_ids), (np.ones(int((~many).sum()), np.int64), n)))
        order = np.argsort(group, kind="stable")
        return group[order], own[order], n[order]

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of records: pairs in side-major order, how many texts each has, and of each of these the text and its links."""
        own = self.aligner
        wide = self.size_a * self.size_b > WIDE
        group, a, w_a = self._side(self.a, self.of_a, wide, len(own.a_bytes))
        group_b, b, w_b = self._side(self.b, self.of_b, wide, len(own.b_bytes))
        n_b = np.bincount(group_b, minlength=len(self.text))
        first_b = np.cumsum(n_b) - n_b
        a = a % RADIX * own.per_radix + a // RADIX  # radix first; undone by nobody, since only equal ids matter
        bits = max(1, int(len(self.n_a)).bit_length())
        slices = -(-int(n_b[group].sum()) // SLICE_LINKS)
        for s in range(slices):
            at = np.flatnonzero(a % slices == s) if slices > 1 else np.arange(len(a))
            times = n_b[group[at]]
            if not len(at):
                continue
            left = np.repeat(at, times)
            right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[group[at]], times)
            key = (((a[left] << own.b_bits) | b[right]) << bits) | self.text[group[left]]
            links = w_a[left] * w_b[right]
            if links.max() == 1:
                key.sort()
                links = None
            else:
                order = np.argsort(key, kind="stable")
                key, links = key[order], links[order]
            begin = _starts(key)
            links = np.diff(begin, append=len(key)) if links is None else np.add.reduceat(links, begin)
            key = key[begin]
            first = _starts(key >> bits)
            yield (key >> bits)[first], np.diff(first, append=len(key)), key & ((1 << bits) - 1), links


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker and pair of files."""
    return kept(("align", a_path, b_path), lambda: Aligner(a_path, b_path))


def _spiller(a_path: str, b_path: str):
    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = aligner(a_path, b_path)
        chunk = run = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, CHUNK_CHARS):
                g = own.groups(texts[lo:hi])
                facts = zip(ids[lo:hi], g.n_a.tolist(), g.n_b.tolist(), g.n_groups.tolist(), g.n_links.tolist(), g.digests(), strict=True)
                yield _batch([(DOC, chunk, at, *x, None, None, None, None, None, None) for at, x in enumerate(facts)], _SPILL)
                for pairs, n, docs, links in g.runs():
                    rows = [(RECORDS, chunk, *[None] * 7, run, None, None, packed(n), packed(docs), packed(links))]
                    cuts = np.searchsorted(pairs >> own.b_bits, np.arange(RADIX + 1) * own.per_radix).tolist()
                    for radix, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if x < y:
                            rows.append((PAIRS, *[None] * 8, run, radix, packed_rising(pairs[x:y]), packed(n[x:y]), None, None))
                    yield _batch(rows, _SPILL)
                    run += 1
                chunk += 1

    return spill


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Runs (rising pairs, counts) merged by a heap: pairs, total counts, and for each entry of each run in turn which of the pairs it is."""
    tagged = [((pairs << 16) | k).tolist() for k, (pairs, _) in enumerate(runs)]
    x = np.fromiter(heapq.merge(*tagged), np.int64, sum(map(len, tagged)))
    order = np.argsort(x & 0xFFFF, kind="stable")  # entries run by run, as they came
    pairs = x >> 16
    n = np.empty(len(x), np.int64)
    n[order] = np.concatenate([c for _, c in runs])
    begin = _starts(pairs)
    which = (np.cumsum(np.concatenate([[False], pairs[1:] != pairs[:-1]])) if len(x) else x)[order]
    return pairs[begin], np.add.reduceat(n, begin), np.split(which, np.cumsum([len(c) for _, c in runs])[:-1])


def highest(pairs: np.ndarray, totals: np.ndarray, b_bits: int) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; pairs are side-major."""
    begin = _starts(pairs >> b_bits)
    return totals == np.repeat(np.maximum.reduceat(totals, begin), np.diff(begin, append=len(pairs)))


def _teams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[np.ndarray, np.ndarray]]]]:
    """Each row (radix, team, runs, ...), one at a time, and its runs unpacked."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, [(unpacked_rising(r["pairs"]), unpacked(r["counts"])) for r in row["runs"]]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, runs in _teams(batches):
        pairs, totals, _ = merged(runs)
        yield _batch([(row["team"], row["radix"], packed_rising(pairs), packed(totals))], _PART)


def _answers(row: dict, which: list[np.ndarray], totals: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    return _batch([(r["run"], row["radix"], packed(totals[w]), packed(best[w])) for r, w in zip(row["runs"], which, strict=True)], _ANSWER)


def _settler(b_bits: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, runs in _teams(batches):
            pairs, totals, which = merged(runs)
            yield _answers(row, which, totals, highest(pairs, totals, b_bits))

    return settle


def _hand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, runs in _teams(batches):
        yield _answers(row, merged(runs)[2], unpacked(row["totals"]), unpacked(row["best"]))


def count_pairs(parts: DataFrame, b_bits: int, n_runs: int, fan: int = FAN) -> DataFrame:
    """(run, radix, totals, best) for each row (run, radix, pairs, counts): the pairs' counts over all runs, and which are the highest of their A id."""
    n = 1 if n_runs <= fan else -(-2 * n_runs // fan)  # teams are drawn by hash, so they have half of fan runs on average
    runs = F.collect_list(F.struct("run", "pairs", "counts")).alias("runs")
    teams = parts.withColumn("team", F.pmod(F.xxhash64("run"), F.lit(n))).groupBy("radix", "team").agg(runs)
    if n == 1:
        return teams.mapInArrow(tidy(_settler(b_bits)), _ANSWER)
    above = count_pairs(written(teams.mapInArrow(tidy(_merge), _PART), "pairs"), b_bits, n, fan)
    return teams.join(above.withColumnRenamed("run", "team"), ["radix", "team"]).mapInArrow(tidy(_hand_back), _ANSWER)


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, counts, docs, links, answers) to what each document of the chunk gains."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            answers = sorted(row["answers"], key=lambda a: a["radix"])
            times = unpacked(row["counts"])
            totals, best = (np.repeat(np.concatenate([unpacked(a[c]) for a in answers]), times) for c in ("totals", "best"))
            docs, links = unpacked(row["docs"]), unpacked(row["links"])
            found, at = np.unique(docs, return_inverse=True)
            sums = np.zeros((2, len(found)), np.int64)
            np.add.at(sums[0], at, links * best)
            np.add.at(sums[1], at, links * totals)
            yield _batch(list(zip([row["chunk"]] * len(found), found.tolist(), sums[0].tolist(), sums[1].tolist(), strict=True)), "chunk long, at int, n_best long, count_sum long")


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (byte-level BPE) encodes a blank and the text, B (SentencePiece, which adds the blank itself) the
    text; strings of special tokens are ordinary text. A text that is null or empty, or that either does
    not give back byte for byte, has no tokens: zeros, and an empty string. Every row is a document of
    its own in the counts, also where identifiers or whole rows repeat or are null. Ties for an A id's
    highest count are all best. Other columns are ignored; an empty table gives no rows. A text is encoded
    whole by one task; its links are expanded in slices.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spilled = written(rows.mapInArrow(tidy(_spiller(a_path, b_path), keeps=True), _SPILL), "runs")
    records = spilled.filter(F.col("kind") == RECORDS).select("run", "chunk", "counts", "docs", "links")
    parts = spilled.filter(F.col("kind") == PAIRS).select("run", "radix", "pairs", "counts")
    with open(b_path, "rb") as f:
        b_bits = int(len(Model.parse(f.read()).pieces) - 1).bit_length()
    answers = count_pairs(parts, b_bits, records.count(), fan).groupBy("run").agg(F.collect_list(F.struct("radix", "totals", "best")).alias("answers"))
    gains = records.join(answers, "run").select("chunk", "counts", "docs", "links", "answers").mapInArrow(tidy(_contribute), "chunk long, at int, n_best long, count_sum long")
    gains = gains.groupBy("chunk", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = spilled.filter(F.col("kind") == DOC).join(gains, ["chunk", "at"], "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents, by the public byte-level BPE and the public SentencePiece model."""
    import public_tokenizers

    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
