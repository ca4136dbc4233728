"""Raw documents to packed training sequences, in five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last returns the pieces of
the packed sequences.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberpanel.llm import langid, neardup, secrets
from emberpanel.llm.common import settle, table
from emberpanel.llm.decontaminate import find_contamination
from emberpanel.llm.packing import pack
from emberpanel.llm.queries import PIECES, TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned go on; a missing ``lang`` is filled in. Without letters or sure of no language, a document goes.

    So null and empty texts go. Repeated rows are judged each by itself; an empty table stays empty.
    """
    model = langid.train(docs, langid.vocabulary(PIECES), learn=F.lit(True))
    found = langid.identify(docs, model, keep=REST)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class goes on: the first row of the least id, with or without an id.

    A row is known by its id and its text's hash, so different texts of one id are kept or dropped each by its own class. Null and
    empty texts are one class. Of rows alike in id and text one goes on.
    """
    kept = neardup.near_duplicates(docs).where("keep").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    one = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["_id"]) & (hashed["text_hash"] == kept["_h"]), "left_semi")
    return one.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go. Null and empty texts stay; repeated rows are judged each by itself."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=REST)
    return found.where("not contaminated").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document goes on, repeated rows too; its secrets are replaced by ``[SECRET]``. A null text goes on as an empty one."""
    found = secrets.find_secrets(docs, secrets.train(), keep=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence. An empty text is its end mark alone; an empty table gives no rows."""
    return pack(docs, Path(TOKENIZER).read_text(encoding="utf-8"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack_sequences", pack_sequences),
]

#: Language models, random fields and packing have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), as_table=True)
    return STAGES[-1][1](spark, docs, sf_dir)
