"""Near-duplicate documents: consistent sampling of shingles by TF-IDF weights and by counts, banded, verified by weighted Jaccard.

A shingle is five words; its weight is its count times the mean inverse document frequency of its words, so a passage copied
often is not discounted for being copied. Document frequencies are counted over all documents; only those of frequent words differ from
the ceiling, and how many such words there can be has a bound that does not grow with the corpus.

Texts of equal words are one class from the start and go on as one text. Bands of samples make buckets. A bucket proposes a
spanning forest of the pairs whose samples agree enough, not all pairs: what the forest links needs no other check. Where such
pairs still join different classes after the forest is verified, their rows meet once in blocks, whatever the number of buckets
they share, and blocks compare all of them by matrix products. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberpanel.llm.common import arrow_map, hot_join, hot_keys, settle, ship, strings
from emberpanel.llm.shingles import Sampler, Shingles, Weights, distinct_counts, mixed, shingles_of, weighted_jaccard, weighted_shingles, word_lines

def word_weights(source: DataFrame, ceiling_share: int) -> Weights:
    """Count each word's documents over the whole table.

    Words in less than one in ``ceiling_share`` documents have the ceiling. There are at most ``ceiling_share`` times a document's
    mean number of distinct words above it, however many documents there are, and only those come to the driver.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, times = distinct_counts(strings(batch, "_text"))
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], names=["word", "n"])

    n = source.count()
    counts = arrow_map(source.select("_text"), "word long, n long", work, rows=8192).groupBy("word").agg(F.sum("n").alias("df"))
    frequent = counts.where(F.col("df") * ceiling_share > n).collect()
    return Weights({r.word % 2**64: 1 + math.log(n / r.df) for r in frequent}, 1 + math.log(ceiling_share))


def components(links: DataFrame) -> DataFrame:
    """(id, root) of linked ids: the least id reachable over links (a, b).

    Rounds of least neighbours and pointer jumps, each two joins and a partly aggregated group over linked ids alone.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("root"))
    for turn in count(1):
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = roots.join(near, "id").select("id", "root", F.least("root", "near").alias("new"))
        far = roots.select(F.col("id").alias("new"), F.col("root").alias("far"))
        moved = settle(step.join(far, "new").select("id", "root", F.least("new", "far").alias("new")), as_table=turn % 3 == 0)
        roots = moved.select("id", F.col("new").alias("root"))
        if moved.where("new != root").isEmpty():
            return roots


def estimates(sketches: np.ndarray, sizes: np.ndarray, at: int, threshold: float, start: int) -> np.ndarray:
    """Shares of equal samples by weights or by counts (the sketch's halves), whichever is higher, between row ``at`` and the rows from ``start``; 0 where ``sizes`` (rows of words and TF-IDF weight) rule out ``threshold`` both ways."""
    same, half = sketches[start:] == sketches[at], sketches.shape[1] // 2
    out = np.maximum(same[:, :half].mean(1), same[:, half:].mean(1))
    small, large = np.minimum(sizes[start:], sizes[at]), np.maximum(sizes[start:], sizes[at])
    fits = (small[:, 0] + 8 >= threshold * large[:, 0]) | (small[:, 1] >= (threshold - 1e-6) * large[:, 1])
    return np.where(fits, out, 0.0)


def alike(sketches: np.ndarray, sizes: np.ndarray, threshold: float, least: float, cut: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, later rows, estimates) of a bucket's pairs whose estimate is at least ``least``; with ``cut``, of rows before it with rows from it on."""
    for k in range(cut or len(sketches) - 1):
        start = cut or k + 1
        est = estimates(sketches, sizes, k, threshold, start)
        near = np.flatnonzero(est >= least)
        if len(near):
            yield k, near + start, est[near]


def forest(est: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: rows well above the threshold go with the hub, the row that is like most others; others with their likest row."""
    weight = np.bincount(left, est, n) + np.bincount(right, est, n)
    hub, sure = int(weight.argmax()), threshold + 0.08
    order = np.lexsort((right, left, -est, (left != hub) & (right != hub), -np.minimum(est, sure)))
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(left[order].tolist(), right[order].tolist(), strict=True):
        if (fx := find(x)) != (fy := find(y)):
            parent[fx] = fy
            out.append((y, x) if y == hub else (x, y))
            if len(out) == n - 1:
                break
    return out


def crossings(rows: DataFrame, largest: int) -> DataFrame:
    """Rows of buckets with part and side: those of a bucket of ``k`` over ``largest`` go to every two of its parts that they are in."""
    n = F.when(F.col("k") > largest, F.ceil(F.col("k") / max(1, largest // 2))).otherwise(F.lit(1)).cast("long")
    dealt = rows.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64("content", "bucket"), F.col("_n")))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    part = F.least("_own", "_other") * F.col("_n") + F.greatest("_own", "_other")
    return met.withColumn("part", part).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("k", "_n", "_own", "_other")


def _proposals(rows: list[tuple], threshold: float, least: float) -> list[tuple]:
    """(hub, member) of a spanning forest of the pairs that are alike enough; rows are (bucket, part, content, sketch, words, mass)."""
    own = sorted({r[2]: r for r in rows}.values(), key=lambda r: r[2])
    sketches = np.frombuffer(b"".join(r[3] for r in own), np.uint16).reshape(len(own), -1)
    found = list(alike(sketches, np.array([r[4:6] for r in own], float), threshold, least))
    if not found:
        return []
    left = np.repeat([k for k, _, _ in found], [len(near) for _, near, _ in found]).astype(np.int32)
    right, est = (np.concatenate([f[k] for f in found]) for k in (1, 2))
    return [(own[x][2], own[y][2]) for x, y in forest(est, left, right, len(own), threshold)]


def _still_apart(rows: list[tuple], threshold: float, least: float) -> list[tuple]:
    """(component, block, content, root, partners) of the rows of pairs that are alike enough and of different classes (root).

    Rows are (bucket, part, content, sketch, words, mass, root, side, component, block). ``partners`` are the blocks of the other rows
    of a row's pairs; blocks are the same in every bucket. So a bucket gives out each row once, however many pairs it is in.
    """
    own = sorted({r[2]: r for r in rows}.values(), key=lambda r: (r[7], r[2]))
    if len({r[6] for r in own}) < 2:
        return []
    names = {r: k for k, r in enumerate(sorted({r[6] for r in own}))}
    classes = np.array([names[r[6]] for r in own])
    places = sorted({r[8:10] for r in own})
    index = {p: k for k, p in enumerate(places)}
    block = np.array([index[r[8:10]] for r in own])
    met = np.zeros((len(own), len(places)), bool)
    sketches = np.frombuffer(b"".join(r[3] for r in own), np.uint16).reshape(len(own), -1)
    for k, near, _ in alike(sketches, np.array([r[4:6] for r in own], float), threshold, least, sum(r[7] == 0 for r in own) % len(own)):
        near = near[classes[near] != classes[k]]
        met[k, block[near]] = True
        met[near, block[k]] = True
    return [(own[k][8], own[k][9], own[k][2], own[k][6], [places[x][1] for x in np.flatnonzero(met[k])]) for k in np.flatnonzero(met.any(1)).tolist()]


def _candidates(members: DataFrame, second: bool, threshold: float, least: float) -> DataFrame:
    """What each bucket has to verify; rows come sorted by bucket and part, and a part is held in memory.

    First a spanning forest, as pairs (hub, member). Second, the rows of pairs that join different classes, dealt to pairs of blocks:
    (component, low, high, content, root). A bucket never gives out its pairs, only its rows, and what several buckets find of a row
    is put together before it goes to its pairs of blocks. A part with rows of both sides compares one side with the other.
    """
    names = ["bucket", "part", "content", "sketch", "words", "mass", *(["root", "side", "component", "block"] if second else [])]
    schema = "component binary, block long, content binary, root binary, partners array<long>" if second else "hub binary, member binary"
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())] if second else [pa.binary(), pa.binary()]
    fields = [c.split()[0] for c in schema.split(", ")]

    def found(rows: list[tuple]) -> list[tuple]:
        return [] if len(rows) < 2 else (_still_apart if second else _proposals)(rows, threshold, least)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:2] != key:
                    out += found(rows)
                    key, rows = row[:2], []
                rows.append(row)
            if out:
                yield batch_of(out)
                out = []
        out = found(rows)
        if out:
            yield batch_of(out)

    ship(members.sparkSession)
    dealt = members.select(*names).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    made = dealt.mapInArrow(run, schema)
    if not second:
        return settle(made.distinct())
    partners = F.array_distinct(F.flatten(F.collect_list("partners")))
    rows = settle(made.groupBy("component", "block", "content", "root").agg(partners.alias("partners")))
    met = rows.withColumn("other", F.explode("partners"))
    return met.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "content", "root")


def in_blocks(proposals: DataFrame, size: int) -> DataFrame:
    """(content, component, block): components of the proposed pairs, each text in one of as many blocks as hold about ``size`` of them."""
    found = components(proposals.select(F.col("hub").alias("a"), F.col("member").alias("b")))
    sizes = settle(found.groupBy(F.col("root").alias("component")).agg(F.count("*").alias("n")))
    large = hot_keys(sizes, "component", "n", found.count())
    named = hot_join(found.select(F.col("id").alias("content"), F.col("root").alias("component")), sizes, "component", large, F.xxhash64("content"))
    return named.select("content", "component", F.pmod(F.xxhash64("content"), F.ceil(F.col("n") / size)).alias("block"))


def similarities(sets: list[Shingles], width: int = 4096) -> np.ndarray:
    """(n, n) similarities as of ``weighted_jaccard``: shared weights are matrix products over ``width`` shingles at a time."""
    n = len(sets)
    key = np.concatenate([s[0] for s in sets])
    row = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    weight, count = (np.concatenate([s[k] for s in sets]) for k in (1, 2))
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    column = (np.cumsum(times > 1) - 1)[at][shared]
    row_, idf, count_ = row[shared], (weight / count)[shared], count[shared]
    order = np.argsort(column, kind="stable")
    column, row_, idf, count_ = column[order], row_[order], idf[order], count_[order]
    both = np.zeros((2, n, n))
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        c, r, w, k = column[begin:end] % width, row_[begin:end], idf[begin:end], count_[begin:end]
        level = 1
        while len(c):  # a shingle that both have t times counts t times
            has, weighted = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32)
            has[r, c], weighted[r, c] = 1, w
            both[0] += weighted @ has.T
            both[1] += has @ has.T
            level += 1
            more = k >= level
            c, r, w, k = c[more], r[more], w[more], k[more]
    out = np.zeros((n, n))
    for shared_weight, own in zip(both, (weight, count), strict=True):
        total = np.bincount(row, own, n)
        out = np.maximum(out, shared_weight / (total[:, None] + total[None, :] - shared_weight))
    np.fill_diagonal(out, 1.0)
    return out


def _verify_blocks(rows: DataFrame, texts: DataFrame, weights: Weights, width: int, threshold: float) -> DataFrame:
    """Links between classes (a, b are their roots) that some pair within a pair of blocks makes."""
    keys = ["component", "low", "high"]
    dealt = rows.join(texts, "content").repartition(*keys).sortWithinPartitions(*keys)

    def links(roots: list[bytes], sets: list[Shingles]) -> list[tuple[bytes, bytes]]:
        x, y = np.nonzero(np.triu(similarities(sets) >= threshold - 1e-6, 1))
        return sorted({(min(roots[i], roots[j]), max(roots[i], roots[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True) if roots[i] != roots[j]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, roots, sets = None, [], []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            own = shingles_of(strings(batch, "_text"), weights, width)
            for component, low, high, root, found in zip(*(batch.column(c).to_pylist() for c in (*keys, "root")), own, strict=True):
                if (component, low, high) != key:
                    out += links(roots, sets) if sets else []
                    key, roots, sets = (component, low, high), [], []
                roots.append(root)
                sets.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])
        out = links(roots, sets) if sets else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"])

    ship(rows.sparkSession)
    return settle(dealt.select(*keys, "root", "_text").mapInArrow(run, "a binary, b binary").distinct())


def _verify(pairs: DataFrame, texts: DataFrame, weights: Weights, width: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) among candidate pairs (hub, member): a hub's members come in blocks of about ``block``, each with the hub's text."""
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    dealt = pairs.join(sizes, "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / block)).alias("part"))
    asked = dealt.select(F.col("member").alias("content"), "hub", "part").unionByName(dealt.select(F.col("hub").alias("content"), "hub", "part").distinct())
    rows = asked.join(texts, "content").repartition("hub", "part").sortWithinPartitions("hub", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}

        def links() -> pa.RecordBatch:
            hub = sets.get(key[0])
            good = [m for m, own in sorted(sets.items()) if m != key[0] and weighted_jaccard(hub, own) >= threshold]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(good), pa.binary()), pa.array(good, pa.binary())], names=["a", "b"])

        for batch in batches:
            own = shingles_of(strings(batch, "_text"), weights, width)
            for hub, part, content, found in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "content")), own, strict=True):
                if (hub, part) != key:
                    if key:
                        yield links()
                    key, sets = (hub, part), {}
                sets[content] = found
        if key:
            yield links()

    ship(pairs.sparkSession)
    return settle(rows.select("hub", "part", "content", "_text").mapInArrow(run, "a binary, b binary"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 14, per_band: int = 3, ceiling_share: int = 256, largest: int = 4096, hubs: int = 64, block: int = 64, size: int = 256) -> DataFrame:
    """``id_col``, class_id, class_size, keep and text_hash of each document: its near-duplicate class, and whether it is the one to keep.

    ``class_id`` is the least id of the class (null if it has none); the class's first row of that id is kept. Words are lower-cased
    and split at white space. Documents of equal words are one class, those without words too. There are ``bands`` bands of samples
    by TF-IDF weights and as many by counts. A pair of similarity s by either meets in a band of that kind with probability
    1 - (1 - s^per_band)^bands, 0.99996 at 0.8 with these parameters; pairs whose samples of both kinds agree in a share 3.6
    standard deviations below the threshold or less are not verified.

    A bucket of more than ``largest`` different texts is split by hash. First into parts that all have the same texts, of every
    ``hubs``-th by hash the one that meets most others, so what is like one of them is one class early. Then into parts of half
    that size that meet two by two, each two in a task: every pair of the bucket is looked at whose classes still differ.

    Null text has no words; whole texts count, however long. Ids are whole numbers. Repeated rows are copies. ``text_hash`` is the
    text's xxhash64, so that a row is known by id and hash where ids repeat. An empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    weights = word_weights(source, ceiling_share)
    sampler = Sampler(bands * per_band)
    least = threshold - 3.6 * math.sqrt(threshold * (1 - threshold) / (bands * per_band))
    salts = np.arange(1, 2 * bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        contents, mass, sketches, found = [], [], [], []
        hashes, ends = word_lines(strings(batch, "_text"))
        sets = weighted_shingles(hashes, ends, weights, width)
        for own, by_count, a, b in zip(sets, sampler.sample_counts(sets), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            contents.append(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest())
            mass.append(float(own[1].sum()))
            if a == b:
                sketches.append(b"")
                found.append([])
                continue
            chosen = np.concatenate((sampler.sample(*own[:2]), by_count))
            sketches.append(mixed(chosen).astype(np.uint16).tobytes())
            key, chosen = salts, chosen.reshape(2 * bands, per_band)
            for k in range(per_band):
                key = mixed(key ^ chosen[:, k])
            found.append(key.view(np.int64))
        kinds = (pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.int64()))
        columns = (contents, np.diff(ends), mass, sketches, found)
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["_id", "_h", "content", "words", "mass", "sketch", "bands"])

    signed = settle(arrow_map(source, "_id long, _h long, content binary, words int, mass double, sketch binary, bands array<long>", sign).withColumn("_row", F.monotonically_increasing_id()), as_table=True)
    head = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row", "_h")).alias("head")
    exact = settle(signed.groupBy("content").agg(head, F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("words", "mass", "sketch", "bands")]), as_table=True)
    keys = exact.select("content", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    met = settle(keys.join(shared, "bucket").select("content", "bucket", "k"))
    sketched = exact.select("content", "sketch", "words", "mass")
    parts = F.ceil(F.col("k") / largest)
    members = met.join(sketched, "content").withColumn("part", F.when(F.col("k") > largest, F.pmod(F.xxhash64("content", "bucket"), parts)).otherwise(F.lit(0).cast("long")))
    members = members.select("bucket", "part", "content", "sketch", "words", "mass")
    split = met.where(F.col("k") > largest)
    if not split.isEmpty():
        popular = split.join(met.groupBy("content").agg(F.sum("k").alias("met")), "content").groupBy("bucket", "k", F.pmod(F.xxhash64("content"), F.lit(hubs))).agg(F.max(F.struct("met", "content")).alias("top"))
        everywhere = popular.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "top.content")
        members = members.unionByName(everywhere.join(sketched, "content").select(*members.columns))
    one = met.select("content").distinct().join(exact.select("content", "head._id", "head._h"), "content")
    texts = settle(source.join(one, source["_id"].eqNullSafe(one["_id"]) & (source["_h"] == one["_h"])).groupBy("content").agg(F.first("_text").alias("_text")), as_table=True)
    proposals = _candidates(members, False, threshold, least)
    roots = components(_verify(proposals, texts, weights, width, threshold, block))
    rooted = F.coalesce("root", "content").alias("root")
    classed = settle(met.join(roots.select(F.col("id").alias("content"), "root"), "content", "left").select("content", "bucket", "k", rooted))
    several = classed.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a != _b").select("bucket")
    known = classed.join(several, "bucket", "left_semi").join(in_blocks(proposals, size), "content").join(sketched, "content")
    more = _verify_blocks(_candidates(crossings(known, largest), True, threshold, least), texts, weights, width, threshold)
    if not more.isEmpty():
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    every = exact.agg(F.sum("n")).first()[0] or 0
    of_text = settle(exact.select("content", "head", "n").join(roots.select(F.col("id").alias("content"), "root"), "content", "left").select("content", "head", "n", rooted))
    classes = settle(of_text.groupBy("root").agg(F.min("head").alias("first"), F.sum("n").alias("class_size"), F.count("*").alias("texts")))
    large = hot_keys(classes, "root", "texts", every)
    of_text = hot_join(of_text.drop("head"), classes.drop("texts"), "root", large, F.xxhash64("content")).select("content", "n", F.col("first._id").alias("class_id"), "class_size", F.col("first._row").alias("_first"))
    often = hot_keys(exact, "content", "n", every)
    out = hot_join(signed.select("_id", "_h", "content", "_row"), of_text.drop("n"), "content", often, F.xxhash64("_row"))
    return out.select(F.col("_id").alias(id_col), "class_id", "class_size", (F.col("_row") == F.col("_first")).alias("keep"), F.col("_h").alias("text_hash"))
