"""The corpus pipeline: quality, near-duplicates, repeats, leaks, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and hands the reread table to the next stage,
whose table takes its place there.

What holds for all stages: nulls may stand in any column; very long texts are read
whole; an empty table gives an empty one; columns beside those of ``documents`` pass
through, whatever they are called; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, quality_classifier, simhash_dedup, source_mixing, substring_dedup
from tidemark.llm.common import discarded, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like any other; repeated rows stay or go together;
    rows without an id can stay but teach nothing.  Without any label all stay.
    """
    stats = quality_classifier.document_statistics(docs)
    fitted = quality_classifier.fit(quality_classifier.with_labels(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality_classifier.accepted(docs, fitted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id.

    Null and empty texts are one group.  Of rows that repeat an id one stays, the same in
    every run; rows without an id stay only where their whole group has none.
    """
    return simhash_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document has; texts that lose none stay
    as they are (null and empty ones too), texts that lose all go.

    ``n_chars`` follows the text.  Rows with one id do not shorten each other; rows
    without an id are left alone.
    """
    # every column of the operator's input is read from its output, so one shuffle serves its joins
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest")
    d = substring_dedup.substring_dedup(docs.select("doc_id", "text", rest))
    cut = F.col("dedup.n_removed") > 0
    text = F.when(cut, F.col("dedup.kept")).otherwise(F.col("text"))
    d = d.where(~cut | (F.col("dedup.kept") != ""))
    own = {c: F.col(f"_rest.`{c}`") for c in docs.columns if c not in ("doc_id", "text")} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in own:
        own["n_chars"] = F.when(cut, F.length("dedup.kept").cast("long")).otherwise(own["n_chars"])
    return d.select(*[own[c].alias(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, repeated rows stay
    or go together, and without any item all stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies (and size, source_size,
    target and taken, which replace columns of these names).

    Null and empty texts have no words: they come as often as their source's certain
    copies say.  Null is a source of its own; repeated rows are decided together.
    """
    return source_mixing.mixed(docs).where("copies > 0")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", leaks),
    ("source mixing", mixing),
]

#: The classifier and the fingerprints are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave, each stage written and reread."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        if old is not None:
            discarded(old)
        old = docs
    return docs
