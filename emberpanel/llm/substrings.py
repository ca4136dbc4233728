"""Exact substring removal: every word of a window of words that occurs more than once in the corpus goes.

Each window has a minimiser, the least hash among its word grams. Consecutive windows that share one form a super-k-mer. Only
super-k-mers whose minimiser occurs again anywhere travel, each packed as one string to the bucket of its minimiser, where
the windows are sorted and counted. A bucket of more than ``bucket_rows`` super-k-mers is split by document; windows
that a part sees once are counted again over all parts, so no bucket grows with a passage's copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.llm.common import arrow_map, hold, ship, strings

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hash of a word; at most ``LIMIT`` words are kept."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = out
        return out


_HASHES = WordHashes()


def split_words(text: str) -> list[bytes]:
    """Words are what white space of ASCII (20, 09 to 0D) separates, unchanged."""
    return text.encode().split()


def hash_lines(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and the offsets of the lines."""
    hold("substrings", _HASHES.clear)
    if len(_HASHES) > WordHashes.LIMIT:
        _HASHES.clear()
    get = _HASHES.__getitem__
    ends = np.cumsum([0, *map(len, lines)])
    hashes = np.fromiter((h for line in lines for h in map(get, line)), np.uint64, int(ends[-1]))
    return hashes, ends


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` consecutive values, in log2(width) steps."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[: len(out) - (width - have)], out[width - have :])
    return out


def super_kmers(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(line, start in line, windows, minimiser, weight) of each super-k-mer; weight is 2 where a minimiser repeats within it."""
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty, empty, empty
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = (grams ^ hashes[k : k + len(grams)]) * _MIX
        grams ^= grams >> np.uint64(31)
    span = window - gram + 1
    least = _slide(grams, span, np.minimum)
    line = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + window <= ends[line + 1])
    if not len(starts):
        return empty, empty, empty, empty, empty
    own, lines = least[starts], line[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (own[1:] != own[:-1]) | (lines[1:] != lines[:-1])
    heads = np.flatnonzero(first)
    counts = np.diff(np.append(heads, len(starts)))
    begin = starts[heads]
    # Where a chosen gram is followed by an equal chosen gram, a super-k-mer may hold one window twice.
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    chosen = np.flatnonzero(grams == _slide(padded, span, np.maximum)[: len(grams)])
    again = chosen[:-1][grams[chosen[:-1]] == grams[chosen[1:]]]
    weight = 1 + (np.searchsorted(again, begin + counts + span - 1) > np.searchsorted(again, begin))
    return lines[heads], begin - ends[lines[heads]], counts, own[heads].view(np.int64), weight


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the window that starts at each word."""
    out = []
    for base, mixed in ((0x2545F4914F6CDD1D, hashes), (0x5851F42D4C957F2D, (hashes ^ (hashes >> np.uint64(32))) * _SECOND)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(len(mixed), base), dtype=np.uint64)))
        back = _powers(max(0, len(mixed) - window + 1), pow(base, -1, 2**64))
        value = (sums[window:] - sums[:-window]) * back if len(mixed) >= window else sums[:0]
        out.append((value ^ (value >> np.uint64(29))) * _MIX)
    return out[0], out[1]


_RUNS = "_h long, _h2 long, mh long, start int, n int, weight int"
_PACKED = "_h long, _h2 long, mh long, salt int, split boolean, start int, n int, packed binary"
_HITS = "w1 long, w2 long, _h long, _h2 long, start int, n int, sure boolean"


def _count_chunk(rows: dict[str, list], window: int) -> pa.RecordBatch:
    """Repeated windows among whole buckets. ``sure`` rows are repeated; others are a split bucket's windows seen once, or a witness (no document) of those repeated."""
    lines = [p.split() for p in rows["packed"]]
    hashes, ends = hash_lines(lines)
    w1, w2 = window_hashes(hashes, window)
    n = np.array(rows["n"], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = ends[row] + place
    w1, w2 = w1[at], w2[at]
    split = np.array(rows["split"], bool)[row]
    part = np.where(split, np.array(rows["salt"], np.int64)[row], 0)
    order = np.lexsort((w2, w1, part))
    same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1]) & (part[order][1:] == part[order][:-1])
    double = np.zeros(len(row), bool)
    double[order[1:][same]] = True
    leader = np.ones(len(row), bool)
    leader[order[1:][same]] = False
    double[order[:-1][same]] = True
    h, h2, start = np.array(rows["_h"], np.int64), np.array(rows["_h2"], np.int64), np.array(rows["start"], np.int64)
    hit = np.flatnonzero(double)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(hit)))
    sure = hit[heads]
    open_ = np.flatnonzero(split & leader)
    lone = ~double[open_]
    pick = lambda a: np.concatenate((a[row[sure]], a[row[open_]]))
    none = np.concatenate((np.zeros(len(sure), bool), ~lone))
    columns = [
        pa.array(np.concatenate((w1[sure] ^ h[row[sure]].view(np.uint64), w1[open_])).view(np.int64)),
        pa.array(np.concatenate((w2[sure] + place[sure].astype(np.uint64), w2[open_])).view(np.int64)),
        pa.array(pick(h), mask=none),
        pa.array(pick(h2), mask=none),
        pa.array(np.concatenate((start[row[sure]] + place[sure], start[row[open_]] + place[open_])).astype(np.int32)),
        pa.array(np.concatenate((runs, np.ones(len(open_), np.int64))).astype(np.int32)),
        pa.array(np.concatenate((np.ones(len(sure), bool), np.zeros(len(open_), bool)))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "_h", "_h2", "start", "n", "sure"])


def _count_buckets(packed: DataFrame, window: int, chunk_rows: int) -> DataFrame:
    """Rows come sorted by bucket; whole buckets are counted some ``chunk_rows`` super-k-mers at a time."""
    names = ["_h", "_h2", "mh", "salt", "split", "start", "n", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        for batch in batches:
            for c in names:
                held[c] += batch.column(c).to_pylist()
            if len(held["mh"]) > chunk_rows:
                last = (held["mh"][-1], held["salt"][-1])
                cut = len(held["mh"])
                while cut and (held["mh"][cut - 1], held["salt"][cut - 1]) == last:
                    cut -= 1
                if cut:
                    yield _count_chunk({c: v[:cut] for c, v in held.items()}, window)
                    held = {c: v[cut:] for c, v in held.items()}
        if held["mh"]:
            yield _count_chunk(held, window)

    ship(packed.sparkSession)
    return packed.mapInArrow(run, _HITS)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 6, bucket_rows: int = 200, chunk_rows: int = 4_000) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words whose word sequence also starts elsewhere, in any document.

    Returns a row a document: ``id_col``, n_words, n_removed, kept_text (kept words joined by one space). Windows are judged
    on the input. Word sequences are compared by 128 bits of hash. Null text has no words; documents shorter than a window
    keep all. Whole texts count, however long. Repeated rows are occurrences like any other, so their windows go in each of them.
    Null ids are allowed. An empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"), F.xxhash64(F.col(text_col), F.col(id_col)).alias("_h2"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, ends = hash_lines([split_words(t) for t in strings(batch, "_text")])
        line, start, n, mh, weight = super_kmers(hashes, ends, window, gram)
        take = pa.array(line)
        return pa.RecordBatch.from_arrays([batch.column("_h").take(take), batch.column("_h2").take(take), pa.array(mh), *(pa.array(x.astype(np.int32)) for x in (start, n, weight))], names=["_h", "_h2", "mh", "start", "n", "weight"])

    runs = arrow_map(source.select("_h", "_h2", "_text"), _RUNS, cut)
    shared = runs.groupBy("mh").agg(F.sum("weight").alias("c")).where("c >= 2")
    parts = F.ceil(F.col("c") / bucket_rows).cast("int")
    needed = runs.join(shared, "mh").groupBy("_h", "_h2").agg(F.collect_set(F.struct("mh", "start", "n", parts.alias("parts"))).alias("runs"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("_h", "_h2", "mh", "salt", "split", "start", "n", "packed")}
        for h, h2, text, own in zip(*(batch.column(c).to_pylist() for c in ("_h", "_h2", "_text", "runs")), strict=True):
            words = split_words(text)
            for r in own:
                at, n = r["start"], r["n"]
                row = (h, h2, r["mh"], h % r["parts"], r["parts"] > 1, at, n, b" ".join(words[at : at + n + window - 1]))
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    # The id goes along unread: with the columns of the last join, both joins read one shuffle of the texts.
    packed = arrow_map(source.join(needed.hint("shuffle_hash"), ["_h", "_h2"]).select("_id", "_h", "_h2", "_text", "runs"), _PACKED, pack)
    found = _count_buckets(packed.repartition("mh", "salt").sortWithinPartitions("mh", "salt"), window, chunk_rows)
    seen = F.count("*").over(Window.partitionBy("w1", "w2"))
    hits = found.withColumn("seen", seen).where("_h is not null and (sure or seen >= 2)").groupBy("_h", "_h2").agg(F.collect_set(F.struct("start", "n")).alias("hits"))

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, gone, kept = [], [], []
        for text, own in zip(strings(batch, "_text"), batch.column("hits").to_pylist(), strict=True):
            words = split_words(text)
            counts.append(len(words))
            if own:
                edge = np.zeros(len(words) + 1, np.int64)
                for r in own:
                    edge[r["start"]] += 1
                    edge[r["start"] + r["n"] + window - 1] -= 1
                free = np.cumsum(edge[:-1]) == 0
                words = [words[k] for k in np.flatnonzero(free)]
            gone.append(counts[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])

    joined = source.join(hits.hint("shuffle_hash"), ["_h", "_h2"], "left").select("_id", "_text", "hits")
    return arrow_map(joined, f"_id {id_type}, n_words long, n_removed long, kept_text string", strip).withColumnRenamed("_id", id_col)
