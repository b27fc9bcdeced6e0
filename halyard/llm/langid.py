"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the
longest matches with that automaton (its cross-parsing); the language that needs the fewest phrases,
each weighed by the bits that point into that language's text, wins.

Automata are built on the driver from a bounded sample of the labelled rows: up to docs_per_lang whole
rows a language, shorter ones than doc_chars before longer ones, until symbols_per_lang code points
(all_symbols over all languages) are reached; only the row that reaches them is cut there. All letters
of the sample are symbols: the frequent ones have a column in a dense table, the others are looked up
by state and symbol.

Whole texts are parsed. So that numpy can follow thousands of places through the automata at once, texts
are cut into blocks; each begins in the state that its predecessor ends in, and blocks are parsed again
until that holds for all, so the phrases are those of one parse from front to end. Blocks and languages are
taken in slices: memory does not grow with the length of a text or the number of languages, but for the automata.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.workers import tidy

UNDETERMINED = "und"
BLOCK = 512
WARM = 32  # symbols that give a first guess of the state at a block's front
PIECE = 1 << 20  # characters followed at once
COLUMNS = 1 << 14  # blocks, times languages, followed at once
TOGETHER = 1024  # texts followed at once
DENSE = 62  # letters with a column of their own
_LETTERS: list[np.ndarray] = []

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_symbol double"


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with 0 for each run of anything but letters."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letters()[x], x, np.uint32(0))
    return x[(x != 0) | np.concatenate([[True], x[:-1] != 0])] if len(x) else x


def _pieces(text: str) -> Iterator[np.ndarray]:
    """_points of a long text in pieces of about PIECE characters, cut behind white space where there is any."""
    at, gap = 0, False
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
        x = _points(text[at:end])
        x = x[1:] if gap and len(x) and x[0] == 0 else x
        gap = bool(x[-1] == 0) if len(x) else gap
        at = end
        yield x


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The minimal automaton of all substrings: for each state its transitions; state 0 is the root."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


@dataclass
class CrossParser:
    """Automata of several languages in one table.

    Symbol 0 separates words, 1 is any letter not seen in training, then come the DENSE most frequent
    letters, the padding, and all other letters. States are numbered by where their row begins.
    """

    langs: list[str]
    letters: np.ndarray  # sorted code points
    codes: np.ndarray  # their symbols
    width: int
    table: np.ndarray  # flat; a missing transition holds ~(the state that the symbol leads to from the root)
    rare: np.ndarray  # sorted keys (state, symbol) of the transitions by letters without a column
    rare_to: np.ndarray
    roots: np.ndarray
    bits: np.ndarray  # of a phrase

    @classmethod
    def fit(cls, samples: dict[str, list[str]], symbols_per_lang: int) -> CrossParser:
        langs = sorted(samples)
        points = {g: np.concatenate([np.zeros(1, np.uint32), *(p for t in samples[g] for p in (_points(t), np.zeros(1, np.uint32)))])[:symbols_per_lang] for g in langs}
        letters, counts = np.unique(np.concatenate([*points.values(), np.zeros(1, np.uint32)]), return_counts=True)
        letters, counts = letters[letters != 0], counts[letters != 0]
        dense = min(DENSE, len(letters))
        codes = np.empty(len(letters), np.int32)
        rank = np.arange(len(letters))
        codes[np.argsort(-counts, kind="stable")] = np.where(rank < dense, rank + 2, rank + 3)
        none = np.empty(0, np.int32)
        out = cls(langs, letters, codes, dense + 3, none, np.empty(0, np.int64), none, none, np.array([math.log2(max(2, len(points[g]))) for g in langs]))
        tables, roots, keys, ends, at = [], [], [], [], 0
        for g in langs:
            moves = suffix_automaton(out.symbols(points[g]).tolist())
            state, c, to = np.array([(s, c, t) for s, m in enumerate(moves) for c, t in m.items()], np.int64).reshape(-1, 3).T
            root, few = at * out.width, c >= out.width
            t = np.full((len(moves), out.width), -1, np.int64)
            t[state[~few], c[~few]] = (to[~few] + at) * out.width
            t = np.where(t >= 0, t, ~np.where(t[:1] >= 0, t[:1], root))
            t[:, out.width - 1] = root  # padding: no phrase
            tables.append(t.astype(np.int32))
            keys.append(out._key((state[few] + at) * out.width, c[few]))
            ends.append((to[few] + at) * out.width)
            roots.append(root)
            at += len(moves)
        if langs:
            order = np.argsort(np.concatenate(keys))
            out.table, out.roots = np.concatenate([x.ravel() for x in tables]), np.array(roots, np.int32)
            out.rare, out.rare_to = np.concatenate(keys)[order], np.concatenate(ends)[order].astype(np.int32)
        return out

    def symbols(self, points: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return (points != 0).astype(np.int32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(points == 0, 0, np.where(self.letters[at] == points, self.codes[at], 1)).astype(np.int32)

    def _key(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return state.astype(np.int64) * (len(self.letters) + 3) + symbol

    def _by_rare(self, state: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Where letters without a column lead, as the table would tell."""
        out = ~root
        for own, front in ((False, root), (True, state)):
            key = self._key(front, symbol)
            at = np.minimum(np.searchsorted(self.rare, key), max(0, len(self.rare) - 1))
            hit = self.rare[at] == key if len(self.rare) else np.zeros(len(key), bool)
            out[hit] = self.rare_to[at[hit]] if own else ~self.rare_to[at[hit]]
        return out

    def walk(self, symbols: np.ndarray, state: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow each column of symbols (steps, places) from its state: the state at its end, and the phrases that began on the way."""
        begun = np.zeros(len(state), np.int32)
        few = symbols >= self.width
        columns = np.where(few, 1, symbols) if few.any() else symbols
        for column, whole, odd in zip(columns, symbols, few.any(1).tolist(), strict=True):
            to = self.table.take(state + column)
            if odd:
                at = np.flatnonzero(whole >= self.width)
                to[at] = self._by_rare(state[at], whole[at], root[at])
            begun += to < 0
            state = to ^ (to >> 31)
        return state, begun

    def _follow(self, points: list[np.ndarray], fronts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each text by language, and the state in which each language's automaton ends the last block.

        fronts are the states in which the first text begins, the roots where not given. Languages are
        taken in slices, so that no more than COLUMNS blocks are walked at once.
        """
        blocks = np.array([-(-len(p) // BLOCK) for p in points], np.int64)
        n, langs = int(blocks.sum()), len(self.langs)
        total, ends = np.zeros((len(points), langs)), np.zeros(langs, np.int32)
        if not n:
            return total, ends
        rows = np.full((n, BLOCK), self.width - 1, np.int32)
        at = 0
        for p, m in zip(points, blocks.tolist(), strict=True):
            rows[at : at + m].reshape(-1)[: len(p)] = self.symbols(p)
            at += m
        symbols = np.ascontiguousarray(rows.T)
        owner = np.repeat(np.arange(len(points)), blocks)
        follows = np.concatenate([[False], owner[1:] == owner[:-1]])  # blocks with one before them
        step = max(1, COLUMNS // n)
        for a in range(0, langs, step):
            own = self.roots[a : a + step]
            k = len(own)
            block, root = np.tile(np.arange(n), k), np.repeat(own, n)
            later = np.flatnonzero(follows[block])
            front = root.copy()
            if fronts is not None and blocks[0]:
                front[::n] = fronts[a : a + step]
            front[later] = self.walk(symbols[-WARM:, block[later] - 1], root[later], root[later])[0]
            end, begun = self.walk(np.tile(symbols, k), front, root)
            while True:
                again = later[front[later] != end[later - 1]]
                if not len(again):
                    break
                front[again] = end[again - 1]
                end[again], begun[again] = self.walk(symbols[:, block[again]], front[again], root[again])
            total[:, a : a + k] = np.stack([np.bincount(owner, weights=x, minlength=len(points)) for x in begun.reshape(k, n)], 1)
            ends[a : a + k] = end[n - 1 :: n]
        return total, ends

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text's phrases by language (texts, languages), and its number of letters and separators.

        Short texts are followed together. A text of more than PIECE characters is followed piece by
        piece, each from the state in which its predecessor ends, so memory does not grow with it.
        """
        total, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not self.langs:
            return total, sizes
        group: list[int] = []

        def flush() -> None:
            points = [_points(texts[i]) for i in group]
            if group:
                total[group], sizes[group] = self._follow(points)[0], [len(p) for p in points]
            group.clear()

        held = 0
        for i, t in enumerate(texts):
            if len(t) > PIECE:
                fronts, rest = None, np.empty(0, np.uint32)
                for x in _pieces(t):
                    sizes[i] += len(x)
                    rest = np.concatenate([rest, x])
                    whole = len(rest) // BLOCK * BLOCK
                    if whole:
                        begun, fronts = self._follow([rest[:whole]], fronts)
                        total[i] += begun[0]
                        rest = rest[whole:]
                total[i] += self._follow([rest], fronts)[0][0]
                continue
            if held + len(t) > PIECE or len(group) >= TOGETHER:
                flush()
                held = 0
            group.append(i)
            held += len(t)
        flush()
        return (1 + total) * self.bits, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits per symbol); the score is how far the second language falls behind, 0 to 1."""
        given = [t or "" for t in texts]
        costs, sizes = self.costs(given)
        has_letter = [any(map(str.isalpha, t)) for t in given]
        out = []
        for c, n, good in zip(costs, sizes.tolist(), has_letter, strict=True):
            if not good or not len(c):
                out.append((UNDETERMINED, 0.0, 0.0))
                continue
            best = int(np.argmin(c))
            second = np.partition(c, 1)[1] if len(c) > 1 else 2 * c[best]
            out.append((self.langs[best], float(min(1.0, max(0.0, 1 - c[best] / second))), float(c[best] / n)))
        return out


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the identifier as text leaves 2 when divided by 4; false for a null identifier."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int, doc_chars: int, symbols_per_lang: int, all_symbols: int) -> tuple[dict[str, list[str]], int]:
    """The texts to learn from by language, and the bound on their code points a language that follows from the bounds and the number of languages."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    n_langs = rows.select("lang").distinct().count()
    bound = max(1, min(symbols_per_lang, all_symbols // max(1, n_langs)))
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    size, name = F.char_length("text"), F.xxhash64("text")
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "name")
    top = rows.select("doc_id", "lang", name.alias("name"), F.least(size, F.lit(bound)).alias("size"), (size > doc_chars).alias("long"))
    top = top.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= docs_per_lang)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    top = top.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < bound)
    top = top.groupBy("doc_id", "lang", "name").agg(F.min("r").alias("r"), F.min("before").alias("before"))
    if n_langs * docs_per_lang <= 1_000_000:  # a table of this size may be broadcast
        top = F.broadcast(top)
    found = rows.withColumn("name", name).join(top, ["doc_id", "lang", "name"]).select("lang", "r", "doc_id", "name", F.substring("text", F.lit(1), F.lit(bound) - F.col("before").cast("int")).alias("text"))
    out: dict[str, list[str]] = {}
    for r in found.dropDuplicates(["lang", "doc_id", "name"]).orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out, bound


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 48, doc_chars: int = 2000, symbols_per_lang: int = 32_000, all_symbols: int = 320_000) -> CrossParser:
    """A parser from a bounded sample of the labelled rows that are not held out; every label with such a row is learned."""
    return CrossParser.fit(*labelled_sample(docs, id_col, text_col, lang_col, docs_per_lang, doc_chars, symbols_per_lang, all_symbols))


def predict(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, bits_per_symbol, and the columns of keep.

    Only the text is an input. A text that is null or has no letter is `und` with score 0, as is every
    text if nothing was learned. Ties go to the language that sorts first. Repeated rows come out alike.
    Of a kept column with the name of an output only the output is returned.
    """
    keep = tuple(c for c in keep if c not in [x.split()[0] for x in SCHEMA.split(", ")])
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [x for i in range(0, len(texts), TOGETHER) for x in own.predict(texts[i : i + TOGETHER])]
            lang, score, bits = zip(*found, strict=True) if found else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
            kept = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new, *kept], [*(x.split()[0] for x in SCHEMA.split(", ")), *keep])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), held_out(F.col(id_col)).alias("__held"), F.col(text_col).alias("__text"), *keep)
    schema = ", ".join([SCHEMA, *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)])
    return rows.mapInArrow(tidy(run), schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
