"""From documents to packed training sequences: language, near-duplicates, benchmarks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
run() writes each result to the shared folder and reads it again. All stages but the
last return the columns of documents, whatever they are besides doc_id and text.

Defined cases, besides those of the operators. Stages decide on rows, not on doc_ids,
by a key that they write beside each row: of a group of near copies the row with the
smallest doc_id stays (null ids come last; of one id the row with the smallest
hash), and a contaminated row goes alone, whatever other rows share its doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm import language, secret_scan
from tuneprep.llm.decontamination import contaminated
from tuneprep.llm.jaccard import similar
from tuneprep.llm.packing import pack, pieces
from tuneprep.llm.registry import small_batches
from tuneprep.llm.sampling import remainder
from tuneprep.operators.joins import fits_broadcast
from tuneprep.session import materialise

# A document goes whose most likely language is less than so many times as likely as by chance, and one without letters.
ABOVE_CHANCE = 1.1
# Near copies: sets of so many words in a row, and the least similarity in percent.
SHINGLE, SIMILAR = 5, 80

# Language and tokenisation have no SQL form.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the name of its column. The keys are written, so that all jobs see the same."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows without some of their keys (column gone, each once), and without the key. The keys are broadcast only if they are few."""
    if fits_broadcast(gone):
        gone = F.broadcast(gone)
    return rows.join(gone, F.col(key) == F.col("gone"), "left_anti").drop(key)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network recognises; it learns from those that carry a language."""
    small_batches(spark)
    known = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    net = language.fit(known.where(remainder("id", 4) != 2))
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = language.identify(docs.withColumnsRenamed(plain), net)
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") * len(net.languages) >= (ABOVE_CHANCE if len(net.languages) > 1 else 0)))
    return kept.select(*(F.col(plain.get(c, c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    small_batches(spark)
    rows, key = _keyed(docs)
    # The smallest of these in a group is the row that stays.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.col(key).alias("key"))
    found = similar(rows.select(order.alias("id"), "text"), n=SHINGLE, percent=SIMILAR)
    gone = found.where(F.col("id")["key"] != F.col("component_id")["key"]).select(F.col("id")["key"].alias("gone"))
    return _without(rows, key, materialise(gone, "copies"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    rows, key = _keyed(docs)
    found = contaminated(rows.select(F.col(key).alias("id"), "text"), items)
    return _without(rows, key, materialise(found.where("n_hit > 0").select(F.col("id").alias("gone")), "contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and its place there."""
    small_batches(spark)
    cut = pieces(docs.select(F.col("doc_id").alias("id"), "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(cut).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
