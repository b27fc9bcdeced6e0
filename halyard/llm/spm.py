"""SentencePiece encoding and decoding on the tokenizers library.

The model's protocol buffer is parsed here; from it the normaliser, the meta-space marker, the unigram
scores or BPE merges and the byte fallback are rebuilt for tokenizers. Batches are encoded with several
threads, and ids are verified against the sentencepiece library.

Where no piece has the marker behind another character, no piece crosses the front of a word, so a
text's ids are those of its words in order: each distinct word is encoded, and its ids verified, once a
worker. Texts with markers beside markers are encoded, and verified, whole. The normal form of every
text as given is verified too, so that an error of the normaliser shows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.units import UnitTable
from halyard.llm.words import chunks
from halyard.llm.workers import kept

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
PARITY, ROUND = 1, 2  # flags of encoded texts
CHUNK_CHARS = 1 << 21  # encoded in one call


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message: integers, or the bytes of all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            byte = data[at]
            at += 1
            x |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    """What encoding needs of a SentencePiece model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, type
    kind: int = UNIGRAM
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # remove extra white space
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                out.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                out.kind, out.unk_id = spec.get(3, UNIGRAM), spec.get(40, 0)
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.squeeze, out.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        return out

    @property
    def byte_fallback(self) -> bool:
        return any(kind == BYTE for _, _, kind in self.pieces)

    @property
    def splits_at_words(self) -> bool:
        return self.escape and self.dummy_prefix and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """All ways to make a piece of two, best score first; level scores let a longer left part grow first, as the original does from the left."""
        known = {p: score for p, score, kind in self.pieces if kind in (NORMAL, USER)}
        found = [(-score, -i, p[:i], p[i:]) for p, score in known.items() for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
        return [(a, b) for _, _, a, b in sorted(found)]


class Codec:
    """encode(texts) to ids as little-endian unsigned 32-bit integers, with flags of what is verified; decode(ids)."""

    def __init__(self, path: str, threads: int = 1, verify: bool = True, cached: int = 400_000):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import AddedToken, Tokenizer, models, normalizers

        with open(path, "rb") as f:
            self.model = m = Model.parse(f.read())
        if m.kind == UNIGRAM:
            inner = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
        elif m.kind == BPE:
            inner = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, m.merges(), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"neither a unigram nor a BPE model: type {m.kind}")
        self.tokenizer = Tokenizer(inner)
        self.tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER])
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.bytes = [self._bytes(p, kind) for p, _, kind in m.pieces]
        self.table, self.original = UnitTable(self._learn, cached), None
        if verify:
            import sentencepiece

            self.original = sentencepiece.SentencePieceProcessor(model_file=path)

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def marked(self, text: str) -> str:
        """The text as the model sees it: normalised, markers for blanks, and one in front if the model wants it."""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.model.escape:
            text = text.replace(" ", MARK)
        blank = MARK if self.model.escape else " "
        text = blank + text if text and self.model.dummy_prefix else text
        return text.rstrip(blank) if self.model.squeeze else text  # markers of the text itself go at its end too

    def normalised(self, text: str) -> str:
        """What the ids of a text should decode to."""
        out = self.marked(text)
        return (out[1:] if out and self.model.dummy_prefix else out).replace(MARK, " ")

    def _ids(self, marked: list[str], given: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of marked texts, and PARITY for those whose ids the original library gives to `given`, ROUND for those that decode again."""
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        same = [a.tolist() == b for a, b in zip(ids, self.original.encode(given), strict=True)] if self.original else [True] * len(ids)
        out = [x.tobytes() for x in ids]
        back = [self.decode(x) == (t[1:] if t and self.model.dummy_prefix else t).replace(MARK, " ") for x, t in zip(out, marked, strict=True)]
        return out, np.array(same, np.uint8) * PARITY | np.array(back, np.uint8) * ROUND

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, flags = self._ids([MARK + w for w in words], words)
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64), flags

    def encode(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of each text, and flags: PARITY where the original library gives the same ids, ROUND where they decode to the normalised text."""
        marked = [self.marked(t) for t in texts]
        by_word = self.model.splits_at_words
        plain = [i for i, t in enumerate(marked) if by_word and t and t[-1] != MARK and t[1:2] != MARK and MARK + MARK not in t]
        lists = pc.split_pattern(pa.array([marked[i][1:] for i in plain], pa.string()), MARK)
        out, flags = [b""] * len(texts), np.zeros(len(texts), np.uint8)
        found, flags[plain] = self.table.encode(lists.flatten(), lists.offsets.to_numpy())
        for i, x in zip(plain, found, strict=True):
            out[i] = x
        odd = sorted(set(range(len(texts))) - set(plain))
        found, flags[odd] = self._ids([marked[i] for i in odd], [texts[i] for i in odd])
        for i, x in zip(odd, found, strict=True):
            out[i] = x
        if self.original:
            for i in plain:
                if self.original.normalize(texts[i]) != marked[i]:
                    flags[i] &= ~np.uint8(PARITY)
        return out, flags

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def codec(path: str, threads: int = 1, verify: bool = True) -> Codec:
    """One per Python worker, model and setting."""
    return kept(("pieces", path, threads, verify), lambda: Codec(path, threads, verify))


SCHEMA = "doc_id long, ids binary, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"
_KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_tokens, ids_crc32, round_trip, parity.

    ids are little-endian unsigned 32-bit integers (null unless with_ids); round_trip tells whether
    they decode to the normalised text, parity whether the sentencepiece library gives the same ids (the
    same normal form to the text as given, and the same ids to its words).
    Null text counts as empty and has no ids. A text is always encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, threads)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in _KINDS[1:]]
            for a, b in chunks(texts, CHUNK_CHARS):
                ids, flags = own.encode(texts[a:b])
                for col, new in zip(cols, (ids if with_ids else [None] * len(ids), [len(x) // 4 for x in ids], map(zlib.crc32, ids), (flags & ROUND > 0).tolist(), (flags & PARITY > 0).tolist()), strict=True):
                    col.extend(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, _KINDS[1:], strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text that each row's ids (as encode_documents gives them) stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, verify=False)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), with_ids=False).drop("ids")
