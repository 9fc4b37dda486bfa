"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import oracles
from palisade.llm.byte_bpe import encode_texts
from palisade.llm.common import table
from palisade.llm.conversations import damaged, repair
from palisade.llm.media import media_columns
from palisade.llm.neighbours import search
from palisade.llm.ngram_join import similar_documents
from palisade.llm.packing import pack
from palisade.llm.pii import KINDS, find_pii
from palisade.llm.quality_cnn import fit, held_out, score_quality
from palisade.llm.repeats import repeated_passages
from palisade.llm.resampling import resample
from palisade.llm.sharding import ring_shards
from palisade.llm.toxicity import fit as fit_toxicity
from palisade.llm.toxicity import score_toxicity
from palisade.llm.url_filter import judge_pages
from palisade.sources.events import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def op5_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    dealt = ring_shards(table(spark, sf_dir, "documents"), "doc_id", keep, shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    counts = [_count_of("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("h")


def op7_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media_columns(documents(spark, sf_dir))
    clips = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string"))), ",")
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("shots="), F.size("clips").cast("string"), F.lit(";ms="), clips).alias("feature"),
    )


def op10_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


def op11_block_max_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op12_chunked_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_kmeans_tree": op1_kmeans_tree,
    "op2_byte_cnn": op2_byte_cnn,
    "op3_link_graph": op3_link_graph,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_ring": op5_ring,
    "op6_sparse_suffix": op6_sparse_suffix,
    "op7_grouping_genetic": op7_grouping_genetic,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_motion_jpeg": op9_motion_jpeg,
    "op10_prefix_tree": op10_prefix_tree,
    "op11_block_max_neighbours": op11_block_max_neighbours,
    "op12_chunked_resampling": op12_chunked_resampling,
    "op13_turn_repair": op13_turn_repair,
}
#: The others search approximately, learn, or hash in ways that SQL has not; tests hold them against plain versions.
ORACLES: dict[str, str] = {"op6_sparse_suffix": oracles.REPEATS, "op10_prefix_tree": oracles.NGRAM_JOIN, "op12_chunked_resampling": oracles.RESAMPLING, "op13_turn_repair": oracles.REPAIR}
