"""Toxicity score of a text: logistic regression on its words, regularised by counterfactual identity swaps.

Each labelled text that names an identity group has a twin in which the terms are swapped for the next group of their kind; further
twins put identity terms into neutral texts. The loss adds the squared difference between the scores of twins, so naming a
group moves no score by itself.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberpanel.llm.common import arrow_map, settle, strings

_WORDS = re.compile(r"[^\W\d_]+")
#: Identity terms by kind; the terms at one place of a kind's lists name one group each.
IDENTITY_TERMS = [
    ["woman", "man"], ["women", "men"], ["girl", "boy"], ["girls", "boys"], ["female", "male"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual"], ["transgender", "cisgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "indigenous"], ["african", "european", "american", "arab", "mexican"],
    ["deaf", "blind", "disabled"], ["old", "young"], ["immigrant", "refugee", "native"], ["immigrants", "refugees", "natives"],
    ["frau", "mann"], ["frauen", "männer"], ["schwul", "lesbisch", "hetero"], ["muslimisch", "christlich", "jüdisch"],
    ["femme", "homme"], ["femmes", "hommes"], ["musulman", "chrétien", "juif"], ["noir", "blanc"],
    ["mujer", "hombre"], ["mujeres", "hombres"], ["musulmán", "cristiano", "judío"], ["negro", "blanco"],
]
_SWAP = {term: kind[(k + 1) % len(kind)] for kind in IDENTITY_TERMS for k, term in enumerate(kind)}


def words_of(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.key = weights, bias, uuid.uuid4().hex

    def score(self, text: str) -> float:
        get = self.weights.get
        known = words_of(text).intersection(self.weights)
        return float(1 / (1 + np.exp(-(self.bias + sum(sorted(map(get, known)))))))


def _rows(texts: list[set[str]], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of each known word."""
    pairs = [(r, ids[w]) for r, own in enumerate(texts) for w in own if w in ids]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def departs(n, t, mean, *, least: int = 4, surprise: float = 16.0):
    """Whether a word in ``n`` texts, ``t`` of them toxic, is in ``least`` and departs from the ``mean`` share by a chi-square of ``surprise``."""
    return (n >= least) & ((t - n * mean) * (t - n * mean) >= surprise * n * (mean * (1 - mean)))


def telling_words(texts: list[set[str]], labels: list[int]) -> set[str]:
    counts: dict[str, list[int]] = {}
    for own, label in zip(texts, labels, strict=True):
        for w in own:
            n = counts.setdefault(w, [0, 0])
            n[0] += 1
            n[1] += label
    mean = sum(labels) / len(labels) if labels else 0.0
    return {w for w, (n, t) in counts.items() if departs(n, t, mean)}


def fit(texts: list[set[str]], labels: list[int], words: set[str] | None = None, *, rounds: int = 300, rate: float = 0.05, decay: float = 1e-5, twins: float = 10.0) -> Model:
    """Adam on the mean loss: cross entropy (both classes of equal weight), ``decay`` on squared weights and ``twins`` on twins' scores.

    Only ``words`` (by default the telling ones of these texts) and identity terms have weights. Every text that names a group
    has its swapped twin, and every neutral text two: one that names a group against none, one that names a group against another.
    """
    y = np.array(labels, float)
    known = sorted((telling_words(texts, labels) if words is None else words) | set(_SWAP))
    ids = {w: k for k, w in enumerate(known)}
    mean = y.mean() if len(y) else 0.0
    if not 0 < mean < 1:
        return Model({}, 4.0 if mean else -4.0)
    pairs = [(own, {_SWAP.get(w, w) for w in own}) for own in texts if not own.isdisjoint(_SWAP)]
    neutral = [own for own, label in zip(texts, labels, strict=True) if not label]
    kinds = sorted(_SWAP)
    pairs += [(own | {kinds[k % len(kinds)]}, own) for k, own in enumerate(neutral)]
    pairs += [(own | {t}, own | {_SWAP[t]}) for k, own in enumerate(neutral) for t in (kinds[(k + len(kinds) // 2) % len(kinds)],)]
    row, col = _rows(texts, ids)
    left, right = _rows([a for a, _ in pairs], ids), _rows([b for _, b in pairs], ids)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(len(ids)), 0.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, rounds + 1):
        error = (sigmoid(b + np.bincount(row, w[col], len(y))) - y) * share
        slope = np.bincount(col, error[row], len(ids)) + 2 * decay * w
        grad_b = error.sum()
        if pairs:
            p = sigmoid(b + np.bincount(left[0], w[left[1]], len(pairs)))
            q = sigmoid(b + np.bincount(right[0], w[right[1]], len(pairs)))
            pull = 2 * twins * (p - q) / len(pairs)
            slope += np.bincount(left[1], (pull * p * (1 - p))[left[0]], len(ids)) - np.bincount(right[1], (pull * q * (1 - q))[right[0]], len(ids))
            grad_b += (pull * (p * (1 - p) - q * (1 - q))).sum()
        g = np.append(slope, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({known[k]: float(w[k]) for k in np.flatnonzero(w)}, float(b))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column, sample: int = 8_000) -> Model:
    """Fit on at most about ``sample`` labelled documents, chosen by a hash of their id. ``learn`` selects the rows to learn from.

    Labels of null id or value and those of no document teach nothing; of a document's repeated labels the highest counts; a
    document whose row is repeated counts each time. Without labels of both kinds every text has the same score.
    """
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    size = known.count()
    spread = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) / 1_000_000.0
    chosen = known.where(spread < min(1.0, sample / size)) if size > sample else known
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array([sorted(words_of(t)) for t in strings(batch, "_text")], pa.list_(pa.string()))], names=["_id", "_y", "words"])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _y int, words array<string>"
    sampled = settle(arrow_map(rows.withColumn("_y", (F.col("_y") > 0).cast("int")), schema, split))
    mean = sampled.agg(F.avg("_y")).first()[0] or 0.0
    counts = sampled.select("_y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("_y").alias("t"))
    telling = {r.w for r in counts.where(departs(F.col("n"), F.col("t"), F.lit(mean))).select("w").collect()}
    wanted = telling | set(_SWAP)

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[w for w in own if w in wanted] for own in batch.column("words").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(found, pa.list_(pa.string()))], names=["_id", "_y", "words"])

    got = [(str(r._id), r._y, set(r.words)) for r in arrow_map(sampled, schema, pick).collect()]
    got.sort(key=lambda r: r[0])
    return fit([r[2] for r in got], [r[1] for r in got], telling)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, score (0 to 1, higher: likelier toxic) and predicted (1 from ``threshold`` on) of each whole text.

    Null and empty texts have the score of no words. Whole texts count, however long. Repeated rows and null ids pass through row by
    row. An empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([model.score(t) for t in strings(batch, "_text")], pa.float64())], names=["_id", "score"])

    out = arrow_map(source, f"_id {id_type}, score double", work)
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
