"""From raw documents to packed training sequences: the stages of the corpus pipeline in order.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import settled, table
from palisade.llm.ngram_join import keep_one
from palisade.llm.packing import pack
from palisade.llm.pii import find_pii
from palisade.llm.quality_cnn import fit, score_quality
from palisade.llm.queries import documents
from palisade.llm.repeats import cut_repeats

#: Documents scored below it are rejected.
LEAST_QUALITY = 0.3


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order, n_chars brought up to date where there is one."""
    sized = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else docs
    return sized.select(*columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ...: their own names may be those of an operator's results."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte network scores at least LEAST_QUALITY; it learns from labelled rows that are not held out."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    plain = _numbered(docs)
    names, text = plain.columns, f"c{docs.columns.index('text')}"
    scored = score_quality(plain.withColumn("scored_text", plain[text]), net, "scored_text", tuple(names))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents whose five-word shingle sets link at a Jaccard similarity of 0.8."""
    return keep_one(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they first occur and are cut elsewhere; every row stays."""
    return _sized(cut_repeats(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; every row stays."""
    plain = _numbered(docs)
    text = f"c{docs.columns.index('text')}"
    masked = find_pii(plain, text, tuple(c for c in plain.columns if c != text), mask=True).withColumnRenamed("masked", text)
    return _sized(masked.select(*plain.columns).toDF(*docs.columns), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their place in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_text),
    ("PII", personal_data),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is written once to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network, the span classifier and the genetic search have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
