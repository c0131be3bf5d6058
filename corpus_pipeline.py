"""From raw documents to packed sequences: rules, near-duplicates, repeated passages, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.mixing import mixture
from gleaner.llm.packing import packed
from gleaner.llm.quality_rules import passed
from gleaner.llm.simhash import first_of_each_group
from gleaner.llm.substring import without_repeats
from gleaner.session import prepare, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees learn from the labels of the documents given.

    Null and empty texts have no words and go; repeated rows are judged alike and all stay
    or go; a null id is judged but never learnt from. No documents give none.
    """
    prepare(spark)
    return passed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are joined by steps of two bits or fewer: that with the smallest id.

    Fingerprints, shingle length and distance are those of the query ``op4``. Null and
    empty texts are one group; a null id comes after all others; of repeated rows one stays.
    """
    prepare(spark)
    return first_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller ids hold too.

    A text that loses nothing stays as it is; of another the words left are joined by
    one space. A document that loses all its words goes. ``n_chars`` follows the text.
    Null and empty texts lose nothing and stay; a null id comes after all others; rows of
    equal ids take nothing from each other, so repeated rows stay alike.
    """
    prepare(spark)
    rows = without_repeats(docs).where("n_removed = 0 OR kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target weight takes them.

    Null sources are one source, null and empty texts have size 0, null ids and repeated
    rows are documents of their own.
    """
    prepare(spark)
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences of at most 1024 tokens.

    Null and empty texts are their closing id alone; repeated rows and null ids are
    documents of their own; a text of any length is cut into pieces.
    """
    prepare(spark)
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Neither the trees, nor XXH64 fingerprints, nor the cube method nor byte-level BPE can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
