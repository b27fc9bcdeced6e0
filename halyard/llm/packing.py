"""Hierarchical multi-length packing of tokenised documents.

Whole windows are cut off long documents. What is left of each is routed to the smallest context-size
tier that holds it. The longest tier is packed first: each window takes its best-fitting pieces from
its own tier, then its gap is filled from ever shorter tiers, at last by cutting one piece. Shorter
tiers then make windows of their own size from what remains. Windows are dealt to step groups so that
each step has about as many tokens and the same mix of tiers.

A task packs its own documents in groups of a bounded number of tokens. So nothing is shuffled, memory
has a bound, and all that is ever padded is the last window of a group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.words import chunks
from halyard.llm.workers import tidy

TIERS = (1024, 512, 256, 128)
GROUP_TOKENS = 1 << 21
CHUNK_CHARS = 1 << 22  # encoded in one call
STEP = 8
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
_KINDS = (*(pa.int64(),) * 7, pa.int32(), pa.int64(), pa.binary())


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(document, start, length), ...]) that hold every token of documents of these lengths once."""
    top, windows = tiers[0], []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), by length

    def route(length: int, doc: int, start: int) -> None:
        insort(pools[min(t for t in tiers if t >= length)], (length, doc, start))

    for doc, n in enumerate(lengths):
        whole = n - n % top
        windows += [(top, [(doc, s, top)]) for s in range(0, whole, top)]
        if n > whole:
            pools[min(t for t in tiers if t >= n - whole)].append((n - whole, doc, whole))
    for pool in pools.values():
        pool.sort()
    for level, tier in enumerate(tiers):
        lower = tiers[level:]
        while pools[tier] or level == len(tiers) - 1 and any(pools.values()):
            gap, pieces = tier, []
            while gap:
                # the largest piece that fits, from the longest tier that has one
                for t in lower:
                    i = bisect_right(pools[t], (gap, 1 << 62, 0)) - 1
                    if i >= 0:
                        length, doc, start = pools[t].pop(i)
                        break
                else:  # none fits: cut the smallest one there is
                    t = next((t for t in lower[::-1] if pools[t]), None)
                    if t is None:
                        break
                    length, doc, start = pools[t].pop(0)
                    route(length - gap, doc, start + gap)
                    length = gap
                pieces.append((doc, start, length))
                gap -= length
            windows.append((tier, pieces))
    return windows


def step_groups(windows: list[tuple[int, list]], step: int = STEP) -> list[int]:
    """For each window its step group: windows are dealt out, longest tier first, to and fro over the groups."""
    n = -(-len(windows) // step) or 1
    out = [0] * len(windows)
    order = sorted(range(len(windows)), key=lambda i: (-windows[i][0], -sum(p[2] for p in windows[i][1])))
    for rank, i in enumerate(order):
        lap, at = divmod(rank, n)
        out[i] = at if lap % 2 == 0 else n - 1 - at
    return out


def _packer(path: str, tiers: tuple[int, ...], with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from halyard.llm.tokens import encoder

        encode = encoder(path).encode
        base = TaskContext.get().partitionId() << 36
        seq = steps = 0
        end = END_ID.to_bytes(4, "little")

        def group(docs: list, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal seq, steps
            windows = pack_lengths([len(x) // 4 for x in ids], tiers)
            of_step = step_groups(windows)
            cols: list[list] = [[] for _ in _KINDS]
            for (tier, pieces), step in zip(windows, of_step, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    piece = ids[doc][4 * start : 4 * (start + length)]
                    row = (docs[doc], start, length, zlib.crc32(piece), len(ids[doc]) // 4, base + seq, offset, tier, base + steps + step, piece if with_ids else None)
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
                    offset += length
                seq += 1
            steps += max(of_step, default=-1) + 1
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        docs, ids, held = [], [], 0
        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                for doc, x in zip(own[a:b], encode(texts[a:b]), strict=True):
                    docs.append(doc)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= GROUP_TOKENS:
                        yield from group(docs, ids)
                        docs, ids, held = [], [], 0
        yield from group(docs, ids)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids.

    Every id of a document (its tokens, then END_ID) is in exactly one piece; a null or empty text is
    its END_ID alone. Windows have at most their tier's tokens, and all but the last of a group are
    full. ids are little-endian unsigned 32-bit integers (null unless with_ids). Rows that repeat an
    identifier, or have none, are packed like any other. An empty table gives an empty result. The
    string of an added token (such as <|endoftext|>) in a text is that token, as the tokenizers library
    has it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(_packer(tokenizer_path, tuple(sorted(tiers, reverse=True)), with_ids), keeps=True), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), with_ids=False).drop("ids")
