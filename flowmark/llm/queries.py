"""Queries of the operators in this folder over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.llm import chosen_path, decontamination, exact_dedup, kd_shards, packing, phrases, prefix_trie, quality
from flowmark.llm import secrets, toxicity, turns, weighted_sampling, word_bpe
from flowmark.llm.common import documents
from flowmark.llm.labelled import remainder

#: Shards of the sharding query, and the metadata its tree cuts along.
SHARDS = 24
DIMENSIONS = ("n_chars", "source", "lang", "doc_id")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=1)
    return packed.drop("row")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(documents(spark, sf_dir), DIMENSIONS, n_shards=SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def quality_held_out(doc_id):
    return remainder(doc_id, 4) == 2


def toxic_held_out(doc_id):
    return remainder(doc_id, 5) == 0


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _judged(scores: DataFrame, held_out, cut: float) -> DataFrame:
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(
        documents(spark, sf_dir), labels(spark, sf_dir), quality_held_out
    )
    return _judged(scores, quality_held_out, quality.CUT)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two halves in turn: the second is scanned against the ledger of the first
    docs = documents(spark, sf_dir)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return secrets.scan_in_turn([docs.filter(half == i) for i in (0, 1)]).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("spans", 256).alias("base_sha256"),
        "spans",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = chosen_path.near_duplicates(documents(spark, sf_dir), shingle_words=4, similarity=0.8)
    return near.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer_file("word_bpe_49k.json")
    decoded = word_bpe.encode_and_decode(documents(spark, sf_dir), file)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edit, following = map(F.col, ("signature", "edited_signature", "next_signature"))
    return weighted_sampling.neighbour_fingerprints(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        weighted_sampling.as_text(own).alias("fingerprint"),
        weighted_sampling.as_text(edit).alias("edited_fingerprint"),
        weighted_sampling.likeness(own, edit).alias("near_edited"),
        weighted_sampling.likeness(own, following).alias("near_next"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.without_repeats(documents(spark, sf_dir), window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(
        documents(spark, sf_dir), labels(spark, sf_dir), toxic_held_out
    )
    return _judged(scores, toxic_held_out, 0.5)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = durable(prefix_trie.numbered(conversations(spark, sf_dir)))
    convs = numbered.select("conv").distinct()
    nodes, ends = prefix_trie.prefix_trie(prefix_trie.rebuilt(numbered, family=5, most=9), convs)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(prefix_trie.member_digests(ends), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(conversations(spark, sf_dir), missing=" ")
    return turns.repair_report(rows, gone=F.col("gone"), missing=" ")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return decontamination.contamination(documents(spark, sf_dir), benchmark, words=10).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_secret_scans": op4_secret_scans,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_word_bpe": op7_word_bpe,
    "op8_fingerprints": op8_fingerprints,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_decontamination": op13_decontamination,
}
