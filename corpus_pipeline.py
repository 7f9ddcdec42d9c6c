"""From raw documents to packed training bins, stage by stage.

Each stage gets the documents that the one before it kept, written as Parquet and read again. All but the last return
the columns of documents, extra ones too, whatever their names; the last returns the places of the documents' pieces in
bins. All stages work on whole texts, however long, and take NULL in any column and repeated rows; what becomes of them
is said at each. Of an empty table each stage makes an empty one. The folders that ``run`` writes are in the shared
folder; that of a stage goes once the next one is written, the last stays for the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, neardup, packing, privacy, quality
from weftgraph.session import shared_folder, table


def high_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted to those of docs that have a label.

    NULL, empty and wordless texts go. Repeated rows stay or go together, as equal texts tie; a NULL doc_id has no label.
    """
    return quality.drop_low(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    It is that with the smallest doc_id (NULL last; ties by the text's hash); of repeated rows one stays. Texts that are
    NULL, empty or without words are alike to none and stay.
    """
    return neardup.drop_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    NULL and empty texts leak nothing, items without words can't leak; repeated rows stay or go together.
    """
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that disclose them go from the texts.

    All rows stay. NULL and empty texts stay as they are; repeated rows are changed alike; n_chars follows the text.
    """
    return privacy.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in bins.

    NULL and empty texts have no piece; repeated rows have a place each; ties in size go by doc_id and piece.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", high_quality),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("privacy", private),
    ("packing", packed),
]
#: Four of the five stages are beyond SQL; tests/llm holds each operator, and the stages together, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what is between them is in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
