"""The registered queries of the operators: thin wrappers that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import additive_ann, alignment, centroid_lid, cotrain, hash_tree, jaccard_tree, license_scan, line_dedup, oracle, packing, pair_naming, preference, spaced_seed, squares_packing
from lodeworks.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_centroid_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = centroid_lid.fit(docs.where(~centroid_lid.held_out(F.col("doc_id"))))
    return centroid_lid.predict(docs.select("doc_id", "text"), model).select("doc_id", centroid_lid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def with_path(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/part/name, every 50th of them a licence file."""
    part = F.concat(F.lit("p"), F.pmod(F.floor(F.col("doc_id") / 50), F.lit(40)))
    name = F.when(F.pmod("doc_id", F.lit(50)) == 7, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), part, name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(with_path(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.format_pairs(preference.borrowed(preference.turns_of(table(spark, sf_dir, "conversations"))))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"], s["end"])), ",").alias(c)
    return pairs.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"))


def op8_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


def op2_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    lines = F.aggregate("removed_runs", F.lit(0), lambda n, r: n + r["last_line"] - r["first_line"] + 1)
    return out.select("doc_id", lines.alias("removed_lines"), "removed_runs", "text")


def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard(table(spark, sf_dir, "documents"), hash_tree.layout(40), hash_tree.layout(41), hash_tree.layout(80))


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_naming.collocations(table(spark, sf_dir, "documents")).drop("cut")


def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares_packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op13_event_sweep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op3_additive_quantisation": op3_additive_quantisation,
        "op7_preference_pairs": op7_preference_pairs,
        "op8_cotraining_quality": op8_cotraining_quality,
        "op2_suffix_line_dedup": op2_suffix_line_dedup,
        "op4_mixture_packing": op4_mixture_packing,
        "op6_hash_tree_sharding": op6_hash_tree_sharding,
        "op10_spaced_seed_decontamination": op10_spaced_seed_decontamination,
        "op9_centroid_language_id": op9_centroid_language_id,
        "op5_signature_tree_join": op5_signature_tree_join,
        "op11_pair_naming": op11_pair_naming,
        "op12_sum_of_squares_packing": op12_sum_of_squares_packing,
        "op13_event_sweep_alignment": op13_event_sweep_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": oracle.OP1, "op5_signature_tree_join": oracle.OP5, "op7_preference_pairs": oracle.OP7, "op11_pair_naming": oracle.OP11}
