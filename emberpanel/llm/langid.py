"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, learned by expectation maximisation over all
segmentations of its words. A text's likelihood is the product over its words of the forward sum over every way to cut the word
into pieces. Words repeat, so a worker computes each word's scores once, many new words at a time.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberpanel.llm.common import arrow_map, hold, strings

_WORDS = re.compile(r"[^\W\d_]+")
_START = "▁"
_BASE = np.uint64(0x100000001B3)
_UNKNOWN, _SMALL = 1e-7, 1e-100


def vocabulary(model_file: str) -> list[str]:
    """Lower-case pieces of letters (a leading mark for a word's start allowed) of a sentencepiece file; words are lower-cased, so no others can occur."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == p.lower() and (p == _START or p.removeprefix(_START).isalpha()))


class Pieces:
    """Piece lookup of every substring of many words at once, by 64-bit polynomial hashes in a table of 2^18 slots."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.tables = []
        left, odd = np.arange(self.n), 0x9E3779B97F4A7C15
        while len(left):  # a piece whose slot is taken goes to the next table
            slots = self._slots(keys[left], np.uint64(odd))
            _, first = np.unique(slots, return_index=True)
            held, ids = np.zeros(1 << 18, np.uint64), np.full(1 << 18, self.n, np.int32)
            held[slots[first]], ids[slots[first]] = keys[left[first]], left[first]
            self.tables.append((np.uint64(odd), held, ids))
            left, odd = np.delete(left, first), (odd * 5 + 2) % 2**64 | 1

    @staticmethod
    def _key(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(_BASE) + ord(c)) % 2**64
        return out

    @staticmethod
    def _slots(keys: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(32))) * odd) >> np.uint64(46)

    def ending(self, codes: np.ndarray) -> np.ndarray:
        """ids (words, ends, lengths) of the substring of each length that ends at each place; ``n`` where there is no such piece."""
        words, size = codes.shape
        out = np.full((words, size + 1, min(self.longest, size)), self.n, np.int32)
        keys = np.zeros(codes.shape, np.uint64)
        for length in range(1, out.shape[2] + 1):
            keys = keys[:, : size - length + 1] * _BASE + codes[:, length - 1 :]
            found = out[:, length:, length - 1]
            for odd, held, ids in self.tables:
                slots = self._slots(keys, odd)
                np.minimum(found, np.where(held[slots] == keys, ids[slots], self.n), out=found)
        return out


def by_length(words: list[str], most: int = 1 << 15) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, character codes) of words of one length, about ``most`` characters at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = []
    for n in np.unique(lengths).tolist():
        every, step = np.flatnonzero(lengths == n), max(1, most // n)
        for at in range(0, len(every), step):
            rows = every[at : at + step]
            out.append((rows, np.frombuffer("".join([words[r] for r in rows]).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)))
    return out


def _forward(ending: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, ends, languages): summed probability of all segmentations of each prefix, and the logarithm to add to its logarithm.

    Sums that get small are scaled up, each language's by itself, so words may be of any length.
    """
    words, ends, lengths = ending.shape
    languages = probability.shape[1]
    alpha, shift = np.zeros((words, ends, languages)), np.zeros((words, ends, languages))
    alpha[:, 0] = 1
    last = np.zeros((words, lengths, languages))
    last[:, 0] = 1
    now = np.zeros((words, languages))
    for end in range(1, ends):
        p = probability[ending[:, end]]
        np.maximum(p[:, 0], _UNKNOWN, out=p[:, 0])
        own = (p * last).sum(1)
        if end % 8 == 0 and (small := own < _SMALL).any():
            up = np.where(small, 1 / _SMALL, 1.0)
            own *= up
            last *= up[:, None]
            now -= np.log(up)
        alpha[:, end], shift[:, end] = own, now
        last[:, 1:] = last[:, :-1].copy()
        last[:, 0] = own
    return alpha, shift


def _log_forward(ending: np.ndarray, probability: np.ndarray) -> np.ndarray:
    alpha, shift = _forward(ending, probability)
    with np.errstate(divide="ignore"):
        return np.log(alpha) + shift


class Model:
    """``probability`` is (pieces + 1, languages), 0 in the last row."""

    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray):
        self.languages, self.pieces, self.probability = languages, pieces, probability
        self.key = uuid.uuid4().hex

    def word_scores(self, words: list[str], lookup: Pieces) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for rows, codes in by_length(words):
            alpha, shift = _forward(lookup.ending(codes), self.probability)
            out[rows] = np.log(alpha[:, -1]) + shift[:, -1]
        return out


def mark(word: str) -> str:
    """A word's letters behind the mark for its start."""
    return _START + (word if word.isalpha() else "".join(filter(str.isalpha, word)))


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> Model:
    """Piece probabilities of each language from counts of its (marked) words."""
    languages = sorted(counts)
    lookup, n = Pieces(pieces), len(pieces)
    probability = np.zeros((n + 1, len(languages)))
    for at, language in enumerate(languages):
        words = sorted(counts[language])
        weight = np.array([counts[language][w] for w in words], float)
        groups = [(rows, lookup.ending(codes)) for rows, codes in by_length(words)]
        p = np.full((n + 1, 1), 1.0 / max(n, 1))
        p[n] = 0
        for _ in range(rounds):
            expected = np.zeros(n + 1)
            for rows, ending in groups:
                size, lengths = ending.shape[1] - 1, ending.shape[2]
                # Backward sums are forward sums over the reversed word.
                turned = np.full_like(ending, n)
                for length in range(1, lengths + 1):
                    turned[:, length:, length - 1] = ending[:, length:, length - 1][:, ::-1]
                alpha, beta = _log_forward(ending, p)[:, :, 0], _log_forward(turned, p)[:, ::-1, 0]
                with np.errstate(divide="ignore"):
                    log_p = np.log(p[:, 0])
                for length in range(1, lengths + 1):
                    own = ending[:, length:, length - 1]
                    share = np.exp(alpha[:, : size - length + 1] + log_p[own] + beta[:, length:] - alpha[:, size:]) * weight[rows, None]
                    expected += np.bincount(own.ravel(), share.ravel(), n + 1)
            p[:n, 0] = (expected[:n] + smooth) / (expected[:n].sum() + smooth * n)
        probability[:, at] = p[:, 0]
    return Model(languages, pieces, probability)


class Scorer:
    """Scores of a worker's words, kept across tasks; at most ``LIMIT`` words at a time."""

    LIMIT = 300_000

    def __init__(self, model: Model):
        self.model, self.lookup = model, Pieces(model.pieces)
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        marked = [mark(w) for w in words]
        scores = np.zeros((len(words), self.table.shape[1]))
        scores[:, :-1] = self.model.word_scores(marked, self.lookup)
        letters = np.array([len(m) > 1 for m in marked])
        scores[~letters] = 0
        scores[:, -1] = letters
        first = len(self.rows)
        while len(self.table) < first + len(words):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[first : first + len(words)] = scores
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior (equal priors) of each text."""
        lines = [_WORDS.findall(t.lower()) for t in texts]
        if len(self.rows) > self.LIMIT:
            self._reset()
        if new := list(set().union(*lines).difference(self.rows)):
            self._learn(new)
        ends = np.cumsum([0, *map(len, lines)])
        get = self.rows.__getitem__
        flat = np.fromiter((r for line in lines for r in map(get, line)), np.int64, int(ends[-1]))
        sums = np.concatenate((np.zeros((1, self.table.shape[1])), np.cumsum(self.table[flat], 0, dtype=np.float64)))
        total = sums[ends[1:]] - sums[ends[:-1]]
        log = total[:, :-1] - total[:, :-1].max(1, keepdims=True)
        posterior = np.exp(log)
        posterior /= posterior.sum(1, keepdims=True)
        best = posterior.argmax(1)
        known = total[:, -1] > 0
        return [self.model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, posterior[np.arange(len(best)), best], 0.0)


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    hold("langid", _SCORERS.clear)
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def train(docs: DataFrame, pieces: list[str], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column, per_language: int = 300) -> Model | None:
    """Fit on about ``per_language`` labelled documents of each language, chosen by a hash of their id; None if there are none.

    ``learn`` selects the rows that may be learned from. Rows of null text or language teach nothing; repeated rows count each
    time. Whole texts of the sample come to the driver.
    """
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) / 1_000_000.0
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(sizes.items()) for x in (k, min(1.0, per_language / v))]), F.col(lang_col))
    sample = labelled.where(spread < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts: dict[str, dict[str, int]] = {}
    for row in sample.collect():
        own = counts.setdefault(row.lang, {})
        for word in _WORDS.findall(row.text.lower()):
            marked = mark(word)
            own[marked] = own.get(marked, 0) + 1
    counts = {k: v for k, v in counts.items() if v}
    return fit(counts, pieces) if counts else None


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicted language of each whole text: the columns in ``keep``, ``id_col``, lang_pred, score.

    ``score`` is the language's posterior under equal priors. A null text, or one without a letter, is ``und`` with score 0;
    so is every text where nothing was learned. Ties go to the language first in order. Whole texts and whole words count, however
    long. Repeated rows and null ids pass through row by row. An empty table gives no rows. Other columns are ignored.
    """
    if model is None:
        return docs.select(F.col(id_col), *keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    source = docs.select(F.struct(F.col(id_col).alias("_id"), *[F.col(c).alias(f"k_{c}") for c in keep]).alias("_kept"), F.col(text_col).alias("_text"))
    kept_type = source.schema["_kept"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = scorer(model).score(strings(batch, "_text"))
        return pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(names), pa.array(scores)], names=["_kept", "lang_pred", "score"])

    out = arrow_map(source, f"_kept {kept_type}, lang_pred string, score double", work)
    return out.select(F.col("_kept._id").alias(id_col), *[F.col(f"_kept.k_{c}").alias(c) for c in keep], "lang_pred", "score")
