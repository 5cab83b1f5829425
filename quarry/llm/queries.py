"""The registered queries of this subpackage, one thin ``opN_<name>`` for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokenizer file of the token queries; any file of the ``tokenizers`` library will do.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import scan_documents

    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), texts=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_induced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("source", "host_rate")


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_two_fit

    return best_two_fit(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, listing, secret_scan

    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in BASE]))
    return found.select("doc_id", *[count(r.name).alias(f"n_{r.name}") for r in BASE], F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_ensemble import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op12_bucket_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    own = (op1_weak_toxicity, op2_vector_shards, op3_ngram_join, op4_decontaminate, op5_induced_dedup, op6_host_quality, op7_best_two_fit, op8_secret_index, op9_token_files, op10_line_dedup, op11_rule_ensemble, op12_bucket_resampling)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup, quality, resampling, secrets

    return {"op6_host_quality": quality.SQL, "op8_secret_index": secrets.SQL, "op10_line_dedup": line_dedup.SQL, "op12_bucket_resampling": resampling.SQL}
