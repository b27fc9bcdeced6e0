import random
import struct
import zlib
from collections import defaultdict

import numpy as np
from helpers import awkward, empty

from places import DATA
from halyard.llm import packing, spm
from halyard.llm.queries import QUERIES
from halyard.llm.tokens import UnitEncoder


def whole_ids(texts, special_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = special_as_text
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_units_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    odd = ["", " ", "  ", " a", "a ", "a\n b", "a \n b", "a\n \nb", "a  b", "a   b", "\u00a0 x", "x\u3000 y", "it's we'll", "<|endoftext|> x", "a\t b", "a \tb"]
    odd += ["".join(rng.choice(["a", "the", " ", " ", "\n", "\t", ".", "'s", "é", "😀", "1", "\u00a0"]) for _ in range(40)) for _ in range(800)]
    odd += [" ".join(rng.choice(["the", "naïve,", "übergrößen\n\nX", "日本語", "приве́т", "x²", "½", "a\x1fb", "\x00", "don't", "12.5%", "", "\u0378"]) for _ in range(30)) for _ in range(200)]
    for as_text in (False, True):
        own = UnitEncoder(packing.default_tokenizer(), as_text, cached=50)
        for a in range(0, len(odd), 100):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(odd[a : a + 100])] == whole_ids(odd[a : a + 100], as_text)


def test_strings_of_added_tokens_are_those_tokens():
    special = "<|endoftext|>"
    texts = [special, f"{special} at the front", f"in the {special} middle", f"at the end {special}", f"a{special}{special}b", "<|endoftext", f"hello {special} world"]
    own = UnitEncoder(packing.default_tokenizer())
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == whole_ids(texts) and [x.count(50256) for x in got] == [1, 1, 1, 1, 2, 0, 1]
    assert got[-1] == [31373, 220, 50256, 995]
    as_text = UnitEncoder(packing.default_tokenizer(), special_as_text=True).encode(texts)
    assert all(50256 not in np.frombuffer(x, "<u4") for x in as_text)


def test_pack_lengths_holds_all_and_pads_next_to_nothing():
    rng = random.Random(5)
    for n in (0, 1, 5, 400):
        lengths = [rng.choice([1, 2, 100, 129, 500, 512, 513, 900, 1023, 1024, 1025, 5000]) for _ in range(n)]
        windows = packing.pack_lengths(lengths)
        seen = defaultdict(list)
        for tier, pieces in windows:
            assert 0 < sum(p[2] for p in pieces) <= tier
            for doc, start, length in pieces:
                seen[doc].append((start, length))
        for doc, length in enumerate(lengths):
            at = 0
            for start, m in sorted(seen[doc]):
                assert start == at
                at += m
            assert at == length
        assert sum(sum(p[2] for p in pieces) != tier for tier, pieces in windows) <= 1
        steps = packing.step_groups(windows)
        assert len(steps) == len(windows) and all(steps.count(s) <= packing.STEP for s in set(steps))


def check_pieces(rows, texts):
    """rows of packed pieces hold every id of (doc_id, text) once, in gapless sequences."""
    ids = {d: [*x, 0] for (d, _), x in zip(texts, whole_ids([t or "" for _, t in texts]), strict=True)}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return docs, seqs, ids


def test_packing_query(spark, duck):
    rows = QUERIES["op7_packing"](spark, f"{DATA}/sf0.001").collect()
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    docs, seqs, ids = check_pieces(rows, texts)
    for d, parts in docs.items():
        assert sum(r.length for r in parts) == len(ids[d])
    assert set(docs) == {d for d, _ in texts}
    sizes = [sum(r.length for r in s) for s in seqs.values()]
    assert sum(1024 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)


def test_packing_edge_cases(spark):
    docs = awkward(spark).filter("doc_id IS NOT NULL AND doc_id <> 103").select("doc_id", "text")
    check_pieces(packing.pack_documents(docs, packing.default_tokenizer()).collect(), [tuple(r) for r in docs.collect()])
    rows = packing.pack_documents(awkward(spark), packing.default_tokenizer()).collect()
    assert sum(r.length for r in rows if r.doc_id == 103) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 103)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows) and any(r.doc_id is None for r in rows)
    assert packing.pack_documents(empty(spark), packing.default_tokenizer()).count() == 0


# --- SentencePiece --------------------------------------------------------------------------------


def awkward_texts(n):
    rng = random.Random(1)
    fixed = ["", " ", "a", "  a b", " a\nb", "a  b   c", "</s> x <s>", "é😀 \t x", "▁a", "a▁b", " " * 37 + "x", "x" + " " * 50, "日本語 テスト", "a \nb\n \nc", "<0x41> <unk>"]
    return fixed + ["".join(rng.choice("ab .  \n\tthe éñ▁<s>0") for _ in range(60)) for _ in range(n)]


def test_bpe_model_has_the_ids_and_texts_of_the_original():
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    own = spm.Codec(spm.default_model(), cached=20)
    texts = awkward_texts(600)
    for a in range(0, len(texts), 50):
        part = texts[a : a + 50]
        ids, flags = own.encode(part)
        want = original.encode(part)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want and (flags & spm.PARITY > 0).all()
        assert [own.decode(x) for x in ids] == original.decode(want)


def character_map(mapping):
    """A precompiled map: a double array over the UTF-8 bytes of the keys, then the values, each ended by a zero byte."""
    values, at = b"", {}
    for key, to in mapping.items():
        at[key.encode()] = len(values)
        values += to.encode() + b"\0"
    tree = {}
    for key in at:
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[-1] = at[key]
    units, used = [0] * 2048, {0}

    def place(node, pos):
        base = next(b for b in range(256, 2048 - 256, 256) if all(b ^ c not in used for c in [0, *(c for c in node if c >= 0)]))
        offset = pos ^ base
        units[pos] |= offset << 10 | (1 << 8 if -1 in node else 0)
        used.update(base ^ c for c in node if c >= 0)
        used.add(base)
        if -1 in node:
            units[base] = node[-1] | 1 << 31
        for c, kid in node.items():
            if c >= 0:
                units[base ^ c] = c
                place(kid, base ^ c)

    place(tree, 0)
    array = struct.pack("<2048I", *units)
    return struct.pack("<I", len(array)) + array + values


def unigram_model(path, mapping=None):
    """A small unigram model with byte fallback, written as a protocol buffer by hand."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def piece(text, score, kind):
        body = b"\x0a" + varint(len(text.encode())) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)
        return b"\x0a" + varint(len(body)) + body

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    pieces += [(p, -1.5 - 0.37 * i, 1) for i, p in enumerate(["▁the", "▁", "the", "▁a", "a", "b", "ab", "▁ab", "t", "h", "e", "he", "▁b", "ba", "bab", "."])]
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # model_type unigram, byte_fallback
    charsmap = character_map(mapping) if mapping else b""
    normaliser = b"\x0a\x08identity" + (b"\x12" + varint(len(charsmap)) + charsmap if charsmap else b"") + b"\x18\x01\x20\x01\x28\x01"  # dummy prefix, squeezed blanks, escaped
    data = b"".join(piece(*p) for p in pieces) + b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normaliser)) + normaliser
    path.write_bytes(data)
    return str(path)


def test_unigram_model(tmp_path):
    import sentencepiece

    path = unigram_model(tmp_path / "u.model")
    own, original = spm.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert own.model.kind == spm.UNIGRAM and own.model.squeeze and own.model.byte_fallback
    texts = ["the ab", "  the   bab ", "abab the.", "", "   ", "thé 😀", "a b a b", "a▁▁b", "a ▁ b", "▁a", "a▁ b", "▁", " ▁ a", "a\u00a0 b", "b\n the"]
    ids, flags = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == original.encode(texts) and (flags == spm.PARITY | spm.ROUND).all()
    assert [own.decode(x) for x in ids] == [own.normalised(t) for t in texts]


def test_model_with_a_character_map(tmp_path):
    """The map turns fullwidth a to c into a to c, and a tab into a blank."""
    import sentencepiece

    path = unigram_model(tmp_path / "c.model", {"ａ": "a", "ｂ": "b", "\t": " "})
    own, original = spm.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert own.model.charsmap and own.marked("ａ\tｂ") == original.normalize("ａ\tｂ") == "▁a▁b"
    texts = ["ａｂ the", "a\t\tb", "\tthe ａ", "ａ▁ｂ", "\t", "bab\tａb ."]
    ids, flags = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == original.encode(texts) and (flags == spm.PARITY | spm.ROUND).all()


def test_parity_sees_errors_of_the_normaliser(tmp_path):
    own = spm.Codec(unigram_model(tmp_path / "u.model"))
    own.model.squeeze = False  # so that blanks are left where the original takes them away
    assert [bool(f & spm.PARITY) for f in own.encode(["the ab", "the  ab", " the", "a▁b"])[1]] == [True, False, False, True]


def test_encode_and_decode_tables(spark):
    docs = awkward(spark, awkward_texts(20))
    encoded = spm.encode_documents(docs, spm.default_model())
    rows = encoded.collect()
    assert len(rows) == docs.count() and all(r.parity and r.round_trip for r in rows)
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    back = spm.decode_documents(encoded, spm.default_model()).collect()
    assert {(r.doc_id, r.text) for r in back} == {(d, t.replace("▁", " ")) for d, t in texts}
    assert spm.encode_documents(empty(spark), spm.default_model()).count() == 0
