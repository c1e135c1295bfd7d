"""Corpus pipeline: from raw documents to a mixed, tokenised corpus.

Five stages, each over all that the one before kept: language ID drops what has no language; the n-gram Jaccard join
keeps one document of each class of near copies; decontamination drops documents that hold a test item; mixing puts
the documents in the order that meets the sources' target weights; the token store writes their ids in that order.
Every stage is written as Parquet and reread, so a lost executor costs the running stage only.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import fresh, new_path, placed, stored
from tidelog.llm.decontaminate import without_contaminated
from tidelog.llm.jaccard_join import one_of_each
from tidelog.llm.language_id import with_determined_language
from tidelog.llm.mixing import mixed_order
from tidelog.llm.queries import tokenizer_path
from tidelog.llm.token_store import read_store, write_store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined: null text or no letters. All learned languages stay."""
    return with_determined_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each class of linked documents."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or an edited copy of one."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the mixed order, which is the order of the files and of the rows in them."""
    at = fresh(docs, "_at")
    rows = placed(docs, at)
    order = stored(mixed_order(rows.select(at, "doc_id", "source"), row=at).select(at, "position"), "mixed-order")
    return rows.join(order.withColumnRenamed("position", "_position"), at).orderBy("_position").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store in the order of the files (by part number, then name) and of their rows, and read it back.

    Documents that aren't read from Parquet files are written to some first.
    """
    file = F.col("_metadata.file_name")
    order = {"part": F.regexp_extract(file, r"part-(\d+)", 1).try_cast("bigint"), "file": file, "index": F.col("_metadata.row_index")}
    columns = ["doc_id", "text", *[v.alias(k) for k, v in order.items()]]
    try:
        rows = docs.select(*columns)
    except AnalysisException:
        rows = stored(docs, "documents").select(*columns)
    path = new_path(spark, "token-store")
    write_store(rows, path, tokenizer_path(), tuple(order))
    return read_store(spark, path)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]
#: The language model, the tokenizer and the alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
