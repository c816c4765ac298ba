"""A corpus pipeline of five operators: host rules, near-duplicates, repeated passages, personal data, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a frame; it is written and the next stage reads it. All but the
last return the columns of their input. A stage numbers its rows and joins verdicts back by that number, so null ids, repeated ids and
repeated rows lose nothing but their own copies, and no two rows are ever taken for one. Columns beyond those of documents are handed on
whatever their names. Null ids, texts and sources pass through; an empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.llm import near_dup, packing, personal_data, quality_rules, word_repeats
from eventlink.llm.common import table, written
from eventlink.operators.joins import attach


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, written so that it stays; and the number's name, which no column of theirs has."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def _as_id(numbered: DataFrame, row: str) -> DataFrame:
    """What the operators read, with the number in the place of the id."""
    return numbered.select(F.col(row).alias("doc_id"), "text", *[c for c in ("source",) if c in numbered.columns])


def _only(numbered: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose numbers are kept. Those are written first: Spark then knows their size, and moves no text where they are few."""
    given = written(kept.select(F.col("\nkept").alias("kept"))).withColumnRenamed("kept", "\nkept")
    return numbered.join(given, F.col(row) == F.col("`\nkept`"))


def _with_text(docs: DataFrame, text: F.Column) -> DataFrame:
    """``docs`` with another text, its length put right, and the columns in their order."""
    said = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        said = said.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return said


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host is not rejected."""
    numbered, row = _numbered(docs)
    kept = quality_rules.judge(_as_id(numbered, row)).where("kept").select(F.col("doc_id").alias("\nkept"))
    return _only(numbered, row, kept).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; null ids come last, equal ids go by text, then the other columns.

    Of rows with equal id and text one stays. A text without words is in no group, but for such rows.
    """
    numbered, row = _numbered(docs)
    groups = near_dup.group_near_duplicates(_as_id(numbered, row)).select(F.col("doc_id").alias("_member"), "component_id")
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]), {"ignoreNullFields": "false"})
    said = F.sha2(F.coalesce("text", F.lit("")), 256)
    # What a group is chosen by is small: the text goes in as its digest.
    members = numbered.select(F.col(row).alias("_row"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", said.alias("said"), F.sha2(others, 256).alias("others"))
    members = attach(members, groups, [(F.col("_row"), "_member")], "inner")
    member = F.struct("unnamed", "doc_id", "said", "others", "_row").alias("one")
    one = members.groupBy("component_id").agg(F.min(member).alias("one")).select("one.*")
    one = one.groupBy("unnamed", "doc_id", "said").agg(F.min("_row").alias("\nkept")).select("\nkept")
    return _only(numbered, row, one).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those with repeated passages keep their other words, joined by spaces."""
    numbered, row = _numbered(docs)
    changed = word_repeats.kept_texts(_as_id(numbered, row)).select(F.col("doc_id").alias("\nrow"), F.col("kept_text").alias("\ntext"))
    joined = numbered.join(changed, F.col(row) == F.col("`\nrow`"), "left")
    return _with_text(joined, F.coalesce("`\ntext`", "text")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind."""
    return _with_text(personal_data.redact(docs), F.col("text")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_by_rules),
    ("near duplicates", keep_one_of_each_group),
    ("repeated passages", drop_repeated_passages),
    ("personal data", redact_personal_data),
    ("packing", pack),
]

#: Tokenising is beyond SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
