"""Best-fit packing of tokenised documents into sequences, as bulk-synchronous rounds of successor sweeps.

In a round the waiting documents and the gaps of open sequences are range-sorted together, largest first. Each task sweeps its range
down and gives each document its successor: the smallest free gap that holds it, so equal claims go by rank. Documents that
found no gap in their range take, by rank, the gaps that ranges before it have left. Then gaps are updated and the rest
goes to the next round. New sequences are opened for documents that no gap holds, as many as they need at least.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.llm.common import arrow_map, settle, strings
from emberpanel.llm.tokens import word_ids

#: Kinds of row between rounds: a document without a place, an open sequence, a placed document.
WAITING, GAP, PLACED = 0, 1, 2
_SWEPT = "id long, size int, part long, rank long, sequence_id long, gap int"


def tokenise(docs: DataFrame, tokenizer_json: str, *, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces (doc, piece, start, length, ids_crc32) of each document's ids and its end id."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, pieces, starts, lengths, sums = [], [], [], [], []
        end = np.array([end_id], "<u4").tobytes()
        for row, ids in enumerate(word_ids(tokenizer_json).encode(strings(batch, "_text"))):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                rows.append(row)
                pieces.append(piece)
                starts.append(at // 4)
                lengths.append(len(own) // 4)
                sums.append(zlib.crc32(own))
        arrays = [batch.column("_id").take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
        return pa.RecordBatch.from_arrays(arrays, names=["_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return arrow_map(source, f"_id {id_type}, piece int, start long, length long, ids_crc32 long", work, rows=1024)


def sequences_needed(waiting: dict[int, int], largest_gap: int, capacity: int) -> int:
    """The least number of new sequences that documents (how many by size) over the largest gap need, by their sum and by how few of a size share one."""
    big = {size: n for size, n in waiting.items() if size > largest_gap}
    by_sum = ceil(sum(size * n for size, n in big.items()) / capacity)
    return max([by_sum, *(ceil(sum(n for size, n in big.items() if size * (k + 1) > capacity) / k) for k in range(1, 9))])


def sweep(is_slot: list[bool]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs (document, slot) of rows from the largest down, then the documents and the slots without a partner.

    A document takes the smallest slot before it that is free: the last one. So larger documents choose first and equal claims go by
    rank, as in best fit.
    """
    pairs, waiting, free = [], [], []
    for row, slot in enumerate(is_slot):
        if slot:
            free.append(row)
        elif free:
            pairs.append((row, free.pop()))
        else:
            waiting.append(row)
    return pairs, waiting, free


def carried(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which documents without a partner in their range get which slots of ranges before it, from counts (range, documents, slots) in order.

    (range, first, number, slots' range, last slot): documents by rank from ``first`` take slots by rank from ``last`` down.
    """
    out, free = [], []
    for part, waiting, slots in counts:
        first = 0
        while first < waiting and free:
            other, left = free[-1]
            n = min(waiting - first, left)
            out.append((part, first, n, other, left - 1))
            first += n
            free.pop()
            if left > n:
                free.append((other, left - n))
        if slots:
            free.append((part, slots))
    return out


def _sweeps(rows: DataFrame) -> DataFrame:
    """One row a document, (id, size, part, rank, sequence_id, gap), and one a free slot, without an id; rows come in order, a range a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        own = pa.Table.from_batches(parts).select(["id", "size", "part", "sequence_id", "gap"]).combine_chunks().to_batches()[0]
        pairs, waiting, free = sweep(own.column("id").is_null().to_pylist())
        docs, slots = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        alone = pa.array([*waiting, *free], pa.int64())
        none = pa.nulls(len(pairs), pa.int64())
        rank = pa.array([*range(len(waiting)), *range(len(free))], pa.int64())
        for chosen, source, number in ((docs, slots, none), (alone, alone, rank)):
            if len(chosen):
                yield pa.RecordBatch.from_arrays([own.column("id").take(chosen), own.column("size").take(chosen), own.column("part").take(chosen), number, own.column("sequence_id").take(source), own.column("gap").take(source)], names=["id", "size", "part", "rank", "sequence_id", "gap"])

    return settle(rows.mapInArrow(run, _SWEPT))


def _round(state: DataFrame, opened: DataFrame, capacity: int, largest: int, least: int, tasks: int) -> DataFrame:
    """One round: range-sort documents and slots of gaps, sweep every range, carry what is left over the ranges' bounds, update the gaps.

    A gap of several times the ``largest`` waiting document is as many slots, each large enough for any; others are one slot.
    """
    docs = state.where(F.col("kind") == WAITING)
    gaps = state.where((F.col("kind") == GAP) & (F.col("size") >= least)).select("sequence_id", F.col("size").alias("gap")).unionByName(opened)
    several = F.greatest(F.lit(1), F.floor(F.col("gap") / largest).cast("int"))
    slots = gaps.withColumn("_n", several).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    slots = slots.withColumn("size", F.when(F.col("_k") == 1, F.col("gap") - (F.col("_n") - 1) * largest).otherwise(F.lit(largest)).cast("int"))
    rows = docs.select("id", "size", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("gap"), F.xxhash64("id").alias("_tie"))
    rows = rows.unionByName(slots.select(F.lit(None).cast("long").alias("id"), "size", "sequence_id", "gap", F.xxhash64("sequence_id", "_k").alias("_tie")))
    order = [F.col("size").desc(), F.col("id").isNotNull(), F.col("_tie"), F.coalesce("id", "sequence_id")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    swept = _sweeps(dealt.select("id", "size", "part", "sequence_id", "gap"))
    # Only how many of each range are left comes to the driver, and what goes to whom is a few rows a range.
    left = swept.where("rank is not null")
    counts = left.groupBy("part").agg(F.count("id").alias("d"), F.count("sequence_id").alias("s")).collect()
    moves = carried(sorted((r.part, r.d, r.s) for r in counts))
    spark = state.sparkSession
    plan = F.broadcast(spark.createDataFrame(moves, "part long, first long, n long, other long, last long"))
    alone = left.where("id is not null").select("id", "size", "part", "rank")
    met = (alone["part"] == plan["part"]) & (alone["rank"] >= plan["first"]) & (alone["rank"] < plan["first"] + plan["n"])
    asked = alone.join(plan, met, "left").select("id", "size", "other", (F.col("last") - (alone["rank"] - F.col("first"))).alias("_rank"))
    free = left.where("id is null").select(F.col("part").alias("other"), F.col("rank").alias("_rank"), "sequence_id", "gap")
    pairs = asked.where("other is not null").join(free, ["other", "_rank"]).select("id", "size", "sequence_id", "gap")
    pairs = pairs.unionByName(swept.where("rank is null").select("id", "size", "sequence_id", "gap"))
    every = pairs.unionByName(gaps.select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("size"), "sequence_id", "gap"))
    own = Window.partitionBy("sequence_id")
    before = F.sum("size").over(own.orderBy(F.col("size").desc(), F.col("id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    found = every.withColumns({"_before": F.coalesce(before, F.lit(0)), "_rest": F.col("gap") - F.sum("size").over(own)})
    is_gap = F.col("id").isNull()
    kept = found.select(
        F.when(is_gap, GAP).otherwise(PLACED).alias("kind"),
        "id",
        F.when(is_gap, F.col("_rest")).otherwise(F.col("size")).cast("int").alias("size"),
        "sequence_id",
        F.when(~is_gap, capacity - F.col("gap") + F.col("_before")).cast("int").alias("offset"),
    ).where((F.col("kind") == PLACED) | (F.col("size") > 0))
    again = asked.where("other is null").select(F.lit(WAITING).alias("kind"), "id", "size", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("offset"))
    return settle(kept.unionByName(again), as_table=True)


def remaining_rounds(docs: list[tuple[int, int]], gaps: dict[int, int], opened: int, capacity: int) -> list[tuple[int, int, int]]:
    """(id, sequence_id, offset) of the documents (id, size): the same rounds over what one task holds; new sequences are numbered from ``opened``."""
    out, docs, gaps = [], sorted(docs, key=lambda d: (-d[1], d[0])), dict(gaps)
    while docs:
        for _ in range(sequences_needed(Counter(size for _, size in docs), max(gaps.values(), default=0), capacity)):
            gaps[opened] = capacity
            opened += 1
        largest, least = docs[0][1], docs[-1][1]
        rows = [(-size, 1, k) for k, (_, size) in enumerate(docs)]
        for sequence, gap in gaps.items():
            if gap >= least:
                several = max(1, gap // largest)
                rows += [(-(gap - (several - 1) * largest), 0, sequence), *[(-largest, 0, sequence)] * (several - 1)]
        rows.sort()
        pairs, waiting, _ = sweep([row[1] == 0 for row in rows])
        for doc, slot in pairs:
            number, size = docs[rows[doc][2]]
            sequence = rows[slot][2]
            out.append((number, sequence, capacity - gaps[sequence]))
            gaps[sequence] -= size
        docs = [docs[rows[k][2]] for k in waiting]
    return out


def _finish(state: DataFrame, opened: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "size", "sequence_id")), strict=True)]
        found = remaining_rounds([r[1:3] for r in rows if r[0] == WAITING], {r[3]: r[2] for r in rows if r[0] == GAP}, opened, capacity)
        if found:
            kinds = (pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["id", "sequence_id", "offset"])

    return settle(state.where(F.col("kind") != PLACED).repartition(1).mapInArrow(run, "id long, sequence_id long, offset int"))


def place(pieces: DataFrame, *, capacity: int, task_rows: int = 50_000) -> DataFrame:
    """(id, sequence_id, offset) for each (id, size), 0 < size <= capacity; ``id`` must be unique and not null.

    Rounds go on until every document has a place: each opens what documents over the largest gap need at least, and places
    a document in every gap that one fits. A task holds about ``task_rows`` documents and gaps, in every round; once all that is
    left is no more than that, one task does the rounds that remain. Sequences hold at most ``capacity``, without gaps between
    documents. No documents give no rows.
    """
    spark = pieces.sparkSession
    state = pieces.select(F.lit(WAITING).alias("kind"), F.col("id").cast("long").alias("id"), F.col("size").cast("int").alias("size"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("offset"))
    placed, opened = state.where("false").select("id", "sequence_id", "offset"), 0
    while True:
        # By size: at most ``capacity`` numbers of each kind, however many documents there are.
        sizes: dict[int, dict[int, int]] = {WAITING: {}, GAP: {}}
        for r in state.where(F.col("kind") != PLACED).groupBy("kind", "size").count().collect():
            sizes[r["kind"]][r["size"]] = r["count"]
        waiting, gaps = sizes[WAITING], sizes[GAP]
        if not waiting:
            return placed
        more = sequences_needed(waiting, max(gaps, default=0), capacity)
        largest, least = max(waiting), min(waiting)
        rows = sum(waiting.values()) + sum(n * max(1, g // largest) for g, n in gaps.items() if g >= least) + more * max(1, capacity // largest)
        if rows <= task_rows:
            return placed.unionByName(_finish(state, opened, capacity))
        new = spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("gap"))
        opened += more
        state = _round(state, new, capacity, largest, least, ceil(rows / task_rows))
        placed = placed.unionByName(state.where(F.col("kind") == PLACED).select("id", "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, task_rows: int = 50_000) -> DataFrame:
    """Pack every document's tokens into as few sequences of ``capacity`` as the sweeps find.

    Returns a row a piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset. A document is its token ids and
    ``end_id``; only one longer than ``capacity`` is cut. Null or empty text is the end id alone. Null ids and repeated
    documents are packed row by row. Ties go by a row number, so any order of equal documents fits alike. Whole texts count, however
    long. An empty table gives no rows. Other columns are ignored.
    """
    pieces = tokenise(docs, tokenizer_json, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    pieces = settle(pieces.withColumn("id", F.monotonically_increasing_id()), as_table=True)
    placed = place(pieces.select("id", F.col("length").cast("int").alias("size")), capacity=capacity, task_rows=task_rows)
    return pieces.join(placed, "id").select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
