"""Language identification by unigram piece models that are summed over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability under a language is the
sum over all ways to cut it into pieces, found by a forward algorithm; a text's is the product over its words. The piece
probabilities are fitted by expectation-maximisation on the same lattices.

Words of any length are summed whole. All words of a slice share one lattice: nodes stand between characters, edges are pieces.
A node that no piece spans is on every segmentation, so the sums of the stretches between such nodes are independent, and all
stretches are summed side by side.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import discard, keeps, map_texts, quoted, release_memory, stored, take_worker, text_buffers, text_slices

MARK = "▁"
#: The probability of a character that is no piece.
UNKNOWN = 1e-7
#: Characters of a lattice that are held at a time.
WINDOW = 1 << 15
#: Expected counts are whole multiples of one part in so many, so that their sums do not depend on the order of adding.
PARTS = 1 << 20
LOWEST = -(1 << 63)
#: Numbers that a worker keeps of words it has met.
KNOWN_NUMBERS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII beside letters separates words; A-Z become a-z.
_LETTERS = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def public_pieces(model_path: str) -> list[str]:
    """The lower-case pieces of letters, with or without the word marker, of a SentencePiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and (p.removeprefix(MARK).isalpha() or p == MARK)})


class PieceTable:
    """A trie of the pieces, walked from many places of a text at once: a step (node, character) is one whole number, found in
    two hash tables."""

    SLOTS = 20

    def __init__(self, pieces: tuple[str, ...]):
        steps: dict[int, int] = {}
        piece_of = [0]
        for i, p in enumerate(pieces, 1):
            node = 0
            for c in p:
                step = node << 21 | ord(c)
                if step not in steps:
                    steps[step] = len(piece_of)
                    piece_of.append(0)
                node = steps[step]
            piece_of[node] = i
        self.longest = max(map(len, pieces), default=1)
        self.piece_of = np.array(piece_of)
        self.keys = np.array([-1, *steps]).astype(np.uint64)  # node n is reached by keys[n]
        self.first, self.second = (np.zeros(1 << self.SLOTS, np.uint32) for _ in range(2))
        slots = self._slots(self.keys[1:], _MIX)
        self.first[slots] = np.arange(1, len(self.keys))
        rest = np.setdiff1d(np.arange(1, len(self.keys)), self.first[slots])
        self.mix = _MIX
        while True:
            with np.errstate(over="ignore"):
                self.mix = self.mix * _MIX | np.uint64(1)
            slots = self._slots(self.keys[rest], self.mix)
            if len(np.unique(slots)) == len(rest):
                break
        self.second[slots] = rest

    def _slots(self, keys: np.ndarray, mix: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * mix) >> np.uint64(64 - self.SLOTS)

    def _step(self, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node that each node and character lead to; 0 for none."""
        keys = (node << 21 | codes).astype(np.uint64)
        a, b = self.first[self._slots(keys, _MIX)], self.second[self._slots(keys, self.mix)]
        return np.where(self.keys[a] == keys, a, np.where(self.keys[b] == keys, b, 0)).astype(np.int64)

    def edges(self, codes: np.ndarray, limit: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece number) of every piece that begins at a place in lo..hi and ends by the limit of that place, and of
        every single character there (number 0 if it is no piece)."""
        begin, node, length, out = np.arange(lo, hi), np.zeros(hi - lo, np.int64), 0, []
        while len(begin):
            length += 1
            fits = begin + length <= limit[begin]
            begin, node = begin[fits], node[fits]
            node = self._step(node, codes[begin + length - 1])
            piece = self.piece_of[node]
            there = slice(None) if length == 1 else piece > 0
            out.append((begin[there], begin[there] + length, piece[there]))
            begin, node = begin[node > 0], node[node > 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


@lru_cache(maxsize=2)
def piece_table(pieces: tuple[str, ...]) -> PieceTable:
    """One table for all tasks of a Python worker."""
    return PieceTable(pieces)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, and where each begins (with the end)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return codes, np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))


class Window:
    """The edges that end in (s, e] of a lattice, and which nodes of lo..e are on every segmentation (cut)."""

    def __init__(self, table: PieceTable, codes: np.ndarray, limit: np.ndarray, s: int, e: int):
        self.lo = lo = max(0, s - table.longest)
        begin, end, piece = table.edges(codes, limit, lo, e)
        spanned = np.zeros(e + table.longest + 2 - lo, np.int64)
        long = end - begin > 1
        np.add.at(spanned, begin[long] + 1 - lo, 1)
        np.add.at(spanned, end[long] - lo, -1)
        self.cut = np.cumsum(spanned)[: e + 1 - lo] == 0
        inside = (end > s) & (end <= e)
        self.begin, self.end, self.piece = begin[inside], end[inside], piece[inside]
        self.s, self.e = s, e

    def shrunk(self) -> Window | None:
        """The window up to its last cut node behind s; None without any."""
        at = np.flatnonzero(self.cut[self.s + 1 - self.lo :])
        if not len(at):
            return None
        self.e = self.s + 1 + int(at[-1])
        self.cut = self.cut[: self.e + 1 - self.lo]
        inside = self.end <= self.e
        self.begin, self.end, self.piece = self.begin[inside], self.end[inside], self.piece[inside]
        return self

    def sweep(self, logp: np.ndarray, known: np.ndarray, backward: bool = False) -> np.ndarray:
        """For each node of lo..e the logarithm of the sum over all ways from the cut node before it (backward: to the cut node
        behind it). logp has a row for each edge, known a row for each node of lo..s: what these nodes give to their edges."""
        nodes = np.arange(self.lo, self.e + 1)
        if backward:
            source, target = self.end, self.begin
            after = np.minimum.accumulate(np.where(self.cut | (nodes == self.e), nodes, self.e)[::-1])[::-1]
            level = np.append(after[1:], self.e) - nodes
        else:
            source, target = self.begin, self.end
            before = np.maximum.accumulate(np.where(self.cut | (nodes <= self.s), nodes, self.lo))
            level = nodes - np.append(self.lo, before[:-1])
        order = np.lexsort((target, level[target - self.lo]))
        source, target, logp = source[order] - self.lo, target[order] - self.lo, logp[order]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))  # the first edge of each target
        sizes = np.diff(np.append(first, len(target)))
        goal = target[first]
        turns = np.flatnonzero(np.concatenate(([True], level[goal[1:]] != level[goal[:-1]], [True])))
        out = np.zeros((len(nodes), *logp.shape[1:]))
        gives = out.copy()  # a cut node begins anew: it gives 0
        gives[: len(known)] = known
        for a, b in zip(turns.tolist(), turns[1:].tolist(), strict=False):
            x, z = int(first[a]), int(first[b]) if b < len(first) else len(target)
            values = gives[source[x:z]] + logp[x:z]
            at = first[a:b] - x
            top = np.maximum.reduceat(values, at)
            total = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, sizes[a:b], 0)), at))
            out[goal[a:b]] = total
            gives[goal[a:b]] = np.where(self.cut[goal[a:b]].reshape(-1, *(1,) * (total.ndim - 1)), 0, total)
        self.gives = gives
        return out


@dataclass
class LanguageModel:
    """probs: a row for each piece (row 0: none) and a column for each language."""

    languages: list[str]
    pieces: list[str]
    probs: np.ndarray

    def scorer(self) -> WordScorer:
        """The scorer of this model; one for all tasks of a Python worker, so that the words it knows are known to the next task."""
        sign = hashlib.sha256(repr((self.languages, self.pieces)).encode() + self.probs.tobytes()).digest()
        if sign not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[sign] = WordScorer(self)
            keeps(__name__, _drop)
        return _SCORERS[sign]


_SCORERS: dict[bytes, WordScorer] = {}


def _drop() -> None:
    _SCORERS.clear()
    piece_table.cache_clear()


def _logs(probs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        out = np.log(probs)
    out[0] = np.log(UNKNOWN)
    return out


class WordScorer:
    def __init__(self, model: LanguageModel):
        self.model, self.table, self.logp = model, piece_table(tuple(model.pieces)), _logs(model.probs)
        # words met before and their results, bounded; frequent words come early
        self.known: dict[str, int] = {}
        self.results = np.zeros((KNOWN_NUMBERS // (len(model.languages) + 16), len(model.languages)))

    def of_words(self, words: list[str]) -> np.ndarray:
        """`log_probs` of lower-case words without marker; no word has probability 1."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        out = self.results[at]
        if len(new):
            found = self.log_probs([MARK + words[i] for i in new.tolist()])
            found[[k for k, i in enumerate(new.tolist()) if not words[i]]] = 0
            out[new] = found
            fresh = {words[i]: k for k, i in enumerate(new.tolist()) if len(words[i]) <= 20}  # words that differed in case once
            first = len(self.known)
            fresh = dict(list(fresh.items())[: len(self.results) - first])
            self.results[first : first + len(fresh)] = found[list(fresh.values())]
            self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return out

    def log_probs(self, words: list[str], window: int = WINDOW) -> np.ndarray:
        """The logarithm of each word's probability (words begin with the marker) under each language. Memory follows the window,
        not the longest word: the nodes before a window hand over what later pieces can reach."""
        codes, bounds = coded(words)
        limit = np.repeat(bounds[1:], np.diff(bounds))
        out = np.zeros((len(words), len(self.model.languages)))
        handed, s = np.zeros((1, out.shape[1])), 0
        while s < len(codes):
            w = Window(self.table, codes, limit, s, min(len(codes), s + window))
            sums = w.sweep(self.logp[w.piece], handed[len(handed) - 1 - (s - w.lo) :])
            at = np.flatnonzero(w.cut & (np.arange(w.lo, w.e + 1) > s))
            if len(at):
                word = np.searchsorted(bounds, at + w.lo, side="left") - 1
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                out[word[first]] += np.add.reduceat(sums[at], first)
            handed, s = w.gives, w.e
        return out

    def __call__(self, texts: pa.StringArray) -> tuple[list[str], list[float]]:
        """The language and its share of all languages' probabilities for each text; und and 0 without a letter."""
        n, languages = len(texts), self.model.languages
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if not languages or not n:
            return ["und"] * n, [0.0] * n
        index, rows, table = words_of(texts)
        logs = self.of_words(list(map(str.lower, table)))
        sums = np.zeros((n, len(languages)))
        filled = np.flatnonzero(np.diff(rows) > 0)
        if len(filled):
            for g in range(len(languages)):
                sums[filled, g] = np.add.reduceat(logs[index, g], rows[filled])
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        told = [languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return told, np.where(lettered, share, 0.0).tolist()


def words_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Numbers of the words of all texts, where each text's words begin (with the end), and the distinct words."""
    data, rows = text_buffers(texts)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(rows.astype(np.int32)), pa.py_buffer(_LETTERS[data]))
    split = pc.ascii_split_whitespace(plain)
    table = split.flatten().dictionary_encode()
    return table.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy(zero_copy_only=False).astype(np.int64), table.dictionary.to_pylist()


def hash_bound(wanted: int, count: int) -> int:
    """The signed 64-bit number up to which a uniform hash picks about wanted of count rows, however many they are."""
    return LOWEST + min((1 << 64) - 1, (wanted << 64) // max(1, count))


def fit(df: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1500, rounds: int = 3) -> LanguageModel:
    """Fits a model on a bounded sample of the labelled rows of df: about per_language distinct (id, text) of each language, chosen
    by a hash of both; all words of these rows teach. Repeated rows teach once, and an id that many texts share gives a sample of
    them like any others. Rows without a language or a text teach nothing. A language whose sample has no word is not learned, with a
    warning; without any labelled text the model knows no language.

    The words are counted and each round of expectation-maximisation runs distributed; a row for each language, and for each
    piece of the vocabulary and language, reaches the driver."""
    named = df.select(quoted(id_col).cast("string").alias("id"), quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"))
    rows = named.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("id", "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # a row for each language
    if not counts:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    languages = sorted(counts)
    bound = F.create_map(*[F.lit(x) for k in languages for x in (k, hash_bound(per_language, counts[k]))])[F.col("lang")]
    sample = rows.filter(F.col("h") <= bound).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(__name__)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                index, bounds, table = words_of(texts)
                lang = np.array(batch.column(0).slice(at, len(texts)).to_pylist(), object)
                of_word = np.repeat(np.searchsorted(languages, lang.astype(str)), np.diff(bounds))
                keys, n = np.unique(of_word * len(table) + index, return_counts=True) if len(index) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                words = [table[k % len(table)].lower() for k in keys.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([k // len(table) for k in keys.tolist()], pa.int32()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    words = stored(sample.mapInArrow(count, "lang int, word string, n long").filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    learned = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # a row for each language
    if len(learned) < len(languages):
        warnings.warn(f"no words to learn from: {', '.join(sorted(set(languages) - {languages[k] for k in learned}))}", stacklevel=2)
    probs = None
    for _ in range(rounds + 1):
        counts = np.full((len(pieces) + 1, len(languages)), 0.01)
        for r in _expected(words, tuple(pieces), probs).toLocalIterator():  # a row for each piece and language
            counts[r["piece"], r["lang"]] += r["n"] / PARTS
        counts[0] = 0
        probs = counts / counts.sum(0)
    discard(words)
    return LanguageModel([languages[k] for k in learned], pieces, probs[:, learned])


def _expected(words: DataFrame, pieces: tuple[str, ...], probs: np.ndarray | None) -> DataFrame:
    """piece, lang, n: how often each piece is expected in words (lang, word, n) under probs, in PARTS; without probs, how often
    it stands anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(__name__)
        keeps(__name__, _drop)
        table = piece_table(pieces)
        sums: dict[int, np.ndarray] = {}
        logp = None if probs is None else _logs(probs)
        for batch in batches:
            lang, told, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for g in np.unique(lang).tolist():
                mine = lang == g
                into = sums.setdefault(g, np.zeros(len(pieces) + 1))
                into += expected_counts(table, [MARK + w for w in told[mine].tolist()], n[mine], None if logp is None else logp[:, g])
        for g, counts in sums.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), g), pa.int32()), pa.array(counts[there].astype(np.int64))], names=["piece", "lang", "n"])
        release_memory()

    return words.mapInArrow(run, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n"))


def expected_counts(table: PieceTable, words: list[str], n: np.ndarray, logp: np.ndarray | None, window: int = WINDOW) -> np.ndarray:
    """How often each piece is expected in the words, each counting n times, in PARTS. A window ends at a cut node; only a
    stretch that pieces span without a gap is held whole."""
    codes, bounds = coded(words)
    limit = np.repeat(bounds[1:], np.diff(bounds))
    out, s, size = np.zeros(len(table.piece_of) + 1), 0, window
    while s < len(codes):
        w = Window(table, codes, limit, s, min(len(codes), s + size)).shrunk()
        if w is None:
            size *= 2
            continue
        weight = n[np.searchsorted(bounds, w.begin, side="right") - 1]
        if logp is not None:
            p = logp[w.piece]
            start = np.zeros(s - w.lo + 1)
            whole = w.sweep(p, start)
            forth = w.gives
            back = w.sweep(p, np.zeros(0), backward=True)
            back[w.cut] = 0
            nodes = np.arange(w.lo, w.e + 1)
            ends = np.minimum.accumulate(np.where(w.cut, nodes, w.e)[::-1])[::-1]  # the cut node at or behind each node
            weight = weight * np.exp(forth[w.begin - w.lo] + p + back[w.end - w.lo] - whole[ends[w.end - w.lo] - w.lo])
        out += np.bincount(w.piece, np.rint(weight * PARTS), len(out))
        s, size = w.e, window
    return out[: int(table.piece_of.max(initial=0)) + 1]


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `lang_pred`, a language of the model or `und`, and `lang_score` (0 to 1: its share of the languages' probabilities)
    to df. Null texts and texts without a letter are und with score 0, as is every text under a model without languages; ties
    go to the first language by code point. Whole texts are scored; columns of these names are replaced."""
    made = "lang_pred string, lang_score double"

    def work():
        scorer = model.scorer()

        def each(texts: pa.StringArray) -> list[pa.Array]:
            told, score = scorer(texts)
            return [pa.array(told, pa.string()), pa.array(score, pa.float64())]

        return each

    return map_texts(df, text_col, made, work, keep)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the documents that never teaches: crc32 of the id as text leaves 1 when divided by 3; a null id is not in it."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 3 == 1, F.lit(False))
