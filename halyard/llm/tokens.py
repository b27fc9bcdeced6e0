"""Token ids of many texts with the tokenizers library, by byte-level BPE.

A byte-level BPE of this kind first cuts a text before each blank that is not within a run of white
space, and merges never cross a cut. So the ids of a text are the ids of its blank-separated units in
order, and a unit seen before costs one look-up. Texts in which white space touches a blank in another
way, or which hold the string of an added token, are encoded whole.

New units in Latin letters are cut into the pieces of the public pattern here, and the library's BPE
merges each new piece; other units go through the library's own pattern.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from halyard.llm.units import UnitTable
from halyard.llm.workers import kept

BLANK = "Ġ"  # how a byte-level vocabulary writes a blank
# Fixed value: the pattern by which this kind of vocabulary cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")
_ODD_BLANK = re.compile(r"\s (?:\s|\Z)")
_LATIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")  # all versions of Unicode agree on these


def byte_letters() -> dict[int, int]:
    """For each byte the character that a byte-level vocabulary writes for it: itself where it is visible, else one beyond."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {**dict(zip(visible, visible, strict=True)), **{b: 256 + i for i, b in enumerate(hidden)}}


class UnitEncoder:
    """encode(texts) gives, for each text, its ids as little-endian unsigned 32-bit integers.

    The strings of added tokens in a text become those tokens' ids, as the library does; with
    special_as_text they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, cached: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        steps = json.loads(self.tokenizer.to_str())
        cut = steps["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not steps["normalizer"]
        self.cut = regex.compile(PATTERN).findall if plain else None
        self.letters = {**byte_letters(), 0: 0}  # 0 separates pieces
        self.cached, self.pieces = cached, {}
        self.table = UnitTable(self._learn, cached)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a blank
        self.opens[[i for t, i in vocab.items() if t[0] == BLANK]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> bytes:
        """Ids of these pieces of the pattern one after another."""
        new = [p for p in set(pieces) if p not in self.pieces]
        if new:
            merge = self.tokenizer.model.tokenize
            written = "\0".join(new).encode().decode("latin-1").translate(self.letters).split("\0")
            self.pieces.update(zip(new, [array("I", [t.id for t in merge(w)]).tobytes() for w in written], strict=True))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _unit_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + unit for each unit one after another, and how many each has; none is empty or begins with white space."""
        text = " " + " ".join(units)
        if self.cut and _LATIN.fullmatch(text):
            ids = np.frombuffer(self._merged(self.cut(text)), "<u4")
        elif len(units) > 128:  # few units are not Latin
            parts = [self._unit_ids(units[a : a + 128]) for a in range(0, len(units), 128)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))

    def _learn(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.pieces) > self.cached:
            self.pieces = {}
        odd = [i for i, u in enumerate(names) if not u or u[0].isspace()]
        each = self._ids([" " + names[i] for i in odd])
        parts, sizes, at = [np.empty(0, "<u4")], [np.empty(0, np.int64)], 0
        for i, x in zip([*odd, len(names)], [*each, b""], strict=True):
            for a in range(at, i, 4096):
                ids, n = self._unit_ids(names[a : min(a + 4096, i)])
                parts.append(ids)
                sizes.append(n)
            parts.append(np.frombuffer(x, "<u4"))
            sizes.append(np.array([len(x) // 4] if i < len(names) else [], np.int64))
            at = i + 1
        return np.concatenate(parts), np.concatenate(sizes), np.ones(len(names), np.uint8)

    def _tails(self, texts: list[str]) -> list[bytes]:
        """Ids of each text from its first blank on."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        begins = lists.offsets.to_numpy()
        tail = np.ones(begins[-1], bool)
        tail[begins[:-1]] = False
        return self.table.encode(lists.flatten().filter(pa.array(tail)), begins - np.arange(len(begins)))[0]

    def _whole(self, text: str) -> bool:
        return bool(_BLANK_BEFORE_SPACE.search(text) and _ODD_BLANK.search(text)) or bool(self.added and self.added.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if not self._whole(t)]
        heads = list(texts)
        for i in plain:
            heads[i] = texts[i].split(" ", 1)[0]
        out = self._ids(heads)
        for i, tail in zip(plain, self._tails([texts[i] for i in plain]), strict=True):
            out[i] += tail
        return out


def encoder(path: str, special_as_text: bool = False) -> UnitEncoder:
    """One per Python worker, vocabulary and setting: its units stay known from task to task."""
    return kept(("tokens", path, special_as_text), lambda: UnitEncoder(path, special_as_text))
