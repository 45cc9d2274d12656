"""A corpus pipeline: five stages, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents,
other columns are dropped; NULLs, repeated rows and empty tables are as the operators say.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparklode.llm.bpe_transducer import encode_documents
from sparklode.llm.common import store, table
from sparklode.llm.decontaminate import scan_leaks
from sparklode.llm.parity_join import one_of_each_group
from sparklode.llm.quality_net import fit, score_quality
from sparklode.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return one_of_each_group(docs.select(*COLUMNS), words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier go; what is left empty goes too.

    Characters are kept whole. A NULL text becomes an empty one and stays.
    """
    cut = remove_repeats(docs, keep=[c for c in COLUMNS if c != "text"], cut_text=True)
    return cut.where("n_bytes = 0 OR cut_text != ''").select(
        "doc_id", F.col("cut_text").alias("text"), "lang", "source",
        F.when(F.col("n_removed") > 0, F.char_length("cut_text").cast("long"))
        .otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away a test item go."""
    found = scan_leaks(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            keep=("doc_id", "lang", "source"), ids=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies),
          ("suffix-array dedup", repeats), ("benchmark decontamination", benchmark_leaks),
          ("byte-level BPE", encoding)]

# SQL can express neither the trained network nor the merges of the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
