"""The training-data pipeline: documents through five stages of ``ledgerloom.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.llm import contamination, jaccard, mixing, quality, substrings
from ledgerloom.llm.common import read, row_key
from ledgerloom.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None
NEAR = 5, (80, 100)  # words of a shingle and similarity from which documents are linked


def _texts(changed, spark_text):
    """Columns of documents with a new text where there is one."""
    text = F.coalesce(spark_text, F.col("text"))
    return changed.withColumn("_new", text).select("doc_id", F.col("_new").alias("text"), "lang", "source", F.coalesce(
        F.when(spark_text.isNotNull(), F.length(spark_text).cast("long")), F.col("n_chars")).alias("n_chars"))


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    network = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), network).filter("_score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark, docs, sf_dir):
    """The document with the smallest id stays of every group of linked ones; of equal rows one. Texts without words all stay."""
    gone = jaccard.join(docs, *NEAR).filter("NOT kept").select("key")
    rows = docs.select(*COLUMNS).withColumn("key", row_key())
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = rows.filter(words).join(gone.distinct(), "key", "left_anti").dropDuplicates(["key"])
    return once.unionByName(rows.filter(~words)).select(*COLUMNS)


def substring_stage(spark, docs, sf_dir):
    """Repeated windows are cut out of the texts; a text of nothing else goes."""
    cut = substrings.without_repeats(docs.select(*COLUMNS), with_text=True).filter("_n_removed = 0 OR _n_removed < _n_words")
    return _texts(cut, F.col("_rest"))


def decontamination_stage(spark, docs, sf_dir):
    """Passages of the benchmark are cut out of the texts."""
    return _texts(contamination.find(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")), F.col("_rest"))


def mixing_stage(spark, docs, sf_dir):
    """Every document as often as the mix takes it."""
    return mixing.copies(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark, sf_dir):
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
