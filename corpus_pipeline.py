"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and BPE coding of documents.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go; labels of every fifth id aren't learnt."""
    from tessera.llm._fit import remainder
    from tessera.llm.toxicity import drop_toxic, fit_lexicon

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_lexicon(docs, labels, usable=remainder(F.col("doc_id"), 5) != 0))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them; n_chars follows the text."""
    from tessera.llm.line_dedup import dedup_lines

    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    from tessera.llm.minhash import keep_representatives

    return keep_representatives(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    from tessera.llm.mixing import emit_mix

    return emit_mix(docs)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    import public_tokenizers

    from tessera.llm.bpe import encode_documents

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe_coding", bpe_coding),
]

#: The toxicity model is learnt and BPE merges iterate; SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again by the next; then what the stage wrote besides goes, and its input, too."""
    from tessera.llm._store import Scratch, released

    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        if number == len(STAGES):
            return stage(spark, docs, sf_dir)
        with released():
            made = scratch.cut(stage(spark, docs, sf_dir))
        if number > 1:
            scratch.drop(docs)
        docs = made
    return docs
