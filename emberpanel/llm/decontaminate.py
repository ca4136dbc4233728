"""Benchmark decontamination: a broadcast set of normalised benchmark windows scanned over every document.

The benchmark is dealt to blocks of a bounded number of characters in Spark; one block at a time is gathered into a set and scanned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberpanel.llm.common import arrow_map, let, settle, strings

#: A-Z to a-z; digits, letters and all bytes of non-ASCII characters stay; every other byte separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The same words, in either case, as an expression for cutting long items.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class WindowSet:
    """The windows of some benchmark items: word ids, and for each width the windows' hashes in order, their places and owners.

    A bitmap skips most misses; a hash that is found is compared word by word. A window takes 16 bytes.
    """

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.ids: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        lines = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in normal_words(text)], np.uint32) for _, text in items]
        starts = np.cumsum([0, *map(len, lines)])
        self.line = np.concatenate([*lines, np.zeros(0, np.uint32)])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(width, len(own)) for own in lines if len(own)}):
            at = np.concatenate([starts[k] + np.arange(len(own) - n + 1) for k, own in enumerate(lines) if len(own) and min(width, len(own)) == n])
            keys = self._hash(self.line, n)[at]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order].astype(np.int32)
            bits = min(22, max(10, (16 * len(keys)).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.windows[n] = keys, at, (np.searchsorted(starts, at, "right") - 1).astype(np.int32), seen

    @staticmethod
    def _hash(line: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(max(0, len(line) - n + 1), np.uint64)
        wide = line.astype(np.uint64)
        for k in range(n):
            total = (total ^ wide[k : k + len(total)]) * _MIX
            total ^= total >> np.uint64(29)
        return total * _MIX

    def hits(self, line: np.ndarray) -> tuple[list[tuple[int, int]], set[str | None]]:
        """[start, end) of each window that occurs, and the items it belongs to; 0 marks words of no item."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        known = np.concatenate(([0], np.cumsum(line != 0)))
        for n, (keys, at, owner, seen) in self.windows.items():
            if len(line) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            if len(starts) * 4 < len(line):
                hashes = np.concatenate([self._hash(line[s : s + n], n) for s in starts])
            else:
                hashes = self._hash(line, n)[starts]
            likely = np.flatnonzero(seen[hashes >> np.uint64(64 - len(seen).bit_length() + 1)])
            starts, hashes = starts[likely], hashes[likely]
            low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
            for s, a, b in zip(starts.tolist(), low.tolist(), high.tolist(), strict=True):
                own = [k for k in range(a, b) if (self.line[at[k] : at[k] + n] == line[s : s + n]).all()]
                if own:
                    spans.append((s, s + n))
                    items.update(self.items[owner[k]] for k in own)
        return spans, items


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_chars: int) -> tuple[DataFrame, int]:
    """(item, item_text, block) of the items with a text, and the number of blocks; a block has about ``block_chars`` characters.

    An item longer than an eighth of a block is cut into parts that share ``width`` - 1 words, so they have the item's windows.
    """
    long_words, spec = max(2 * width, block_chars // 16), benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("item_text")).where("item_text is not null")
    n = max(1, -(-(spec.agg(F.sum(F.length("item_text") + 1)).first()[0] or 0) // block_chars))

    def parts(words: Column) -> Column:
        # A last part of fewer words than a window has only windows that the part before it has.
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(long_words)), lambda at: (at == 1) | (F.size(words) - at + 1 >= width))
        return F.transform(starts, lambda at: F.array_join(F.slice(words, at, F.lit(long_words + width - 1)), " "))

    cut = F.when(F.length("item_text") > block_chars // 8, let(F.regexp_extract_all("item_text", F.lit(_WORD), F.lit(0)), parts)).otherwise(F.array("item_text"))
    rows = spec.select("item", F.explode(cut).alias("item_text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "item_text"), F.lit(n))), n


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, share: int = 20, block_chars: int = 4_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Returns ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word ranges, merged), plus the
    columns in ``keep``. A window is ``width`` consecutive words of an item, or all words of a shorter item. The benchmark
    travels in blocks of about ``block_chars`` characters: the driver holds one block and a pass broadcasts one, however large
    the benchmark grows. One block is one pass without a shuffle; of more, each pass keeps the documents it hits, and those
    findings are joined to the documents.

    Null and empty texts have no words and are clean; whole texts are scanned, however long. Null ids pass through. Repeated
    documents are judged row by row; repeated items or windows count each item id once. Windows of items without an id hit like
    others; such items count as one and have no place in the list. An empty benchmark marks nothing. Other columns are ignored.
    """
    blocks, n = blocks_of(benchmark, item_col, item_text_col, width, block_chars)
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_pad")).alias("_kept"))
    if n == 1:
        out = _judge(out, share, _gather(blocks, 0, width))
    else:
        blocks = settle(blocks.repartition(n, "block"))
        keyed = out.withColumns({"_h": F.xxhash64("_id", "_text"), "_h2": F.xxhash64("_text", "_id")})
        found = None
        for block in range(n):
            own = settle(_scan(keyed, _gather(blocks, block, width)).dropDuplicates(["_h", "_h2"]))
            found = own if found is None else found.unionByName(own)
        found = found.groupBy("_h", "_h2").agg(F.flatten(F.collect_list("_found")).alias("_found"))
        out = _judge(keyed.join(found, ["_h", "_h2"], "left"), share)
    return out.select(F.col("_id").alias(id_col), *[F.col("_kept")[c].alias(c) for c in keep], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def _gather(blocks: DataFrame, block: int, width: int) -> WindowSet:
    return WindowSet([(r.item, r.item_text) for r in blocks.where(F.col("block") == block).collect()], width)


_FOUND = "array<struct<start:bigint,end:bigint,items:array<string>>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("items", pa.list_(pa.string()))]))
_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(windows: WindowSet, words: list[bytes]) -> list[dict]:
    """What ``windows`` hit among the words, the items with the first hit."""
    spans, items = windows.hits(np.fromiter((windows.ids.get(w, 0) for w in words), np.uint32, len(words)))
    own = [{"start": s, "end": e, "items": []} for s, e in spans]
    if own:
        own[0]["items"] = sorted(items, key=lambda i: (i is not None, i))
    return own


def _scan(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """Keys of the documents that ``windows`` hit, and what was hit."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_found(windows, normal_words(text)) for text in strings(batch, "_text")]
        take = pa.array([k for k, own in enumerate(found) if own], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("_h").take(take), batch.column("_h2").take(take), pa.array(found, _FOUND_TYPE).take(take)], names=["_h", "_h2", "_found"])

    return arrow_map(docs.select("_h", "_h2", "_text"), f"_h long, _h2 long, _found {_FOUND}", work)


def _judge(docs: DataFrame, share: int, windows: WindowSet | None = None) -> DataFrame:
    """The result's columns, from what ``windows`` hit or, without them, from the findings in ``_found``."""
    id_type, kept_type = docs.schema["_id"].dataType.simpleString(), docs.schema["_kept"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hit, n_items, digests, merged = [], [], [], [], []
        before = [None] * batch.num_rows if windows else batch.column("_found").to_pylist()
        for text, spans in zip(strings(batch, "_text"), before, strict=True):
            words = normal_words(text)
            spans = _found(windows, words) if windows else spans
            joined: list[dict] = []
            for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                if joined and s <= joined[-1]["end"]:
                    joined[-1]["end"] = max(e, joined[-1]["end"])
                else:
                    joined.append({"start": s, "end": e})
            items = {i for x in spans or [] for i in x["items"]}
            counts.append(len(words))
            hit.append(sum(x["end"] - x["start"] for x in joined))
            n_items.append(len(items))
            digests.append(hashlib.sha256(",".join(sorted(items - {None})).encode()).hexdigest())
            merged.append(joined)
        bad = [h > 0 and share * h >= n for h, n in zip(hit, counts, strict=True)]
        arrays = [batch.column("_id"), batch.column("_kept"), *(pa.array(x, pa.int64()) for x in (counts, hit, n_items)), pa.array(digests), pa.array(bad), pa.array(merged, _SPANS_TYPE)]
        return pa.RecordBatch.from_arrays(arrays, names=["_id", "_kept", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    schema = f"_id {id_type}, _kept {kept_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<struct<start:bigint,end:bigint>>"
    return arrow_map(docs, schema, work)
