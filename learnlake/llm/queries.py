"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlake.llm import ann, decontaminate, lm_scoring, merkle, mixing, ngram_join, oracles, packing, quality, sharding, spelling, toxicity, url_graph, warc
from learnlake.llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


#: (verdict, host, path), longest first to win.
URL_RULES = [
    url_graph.Rule("allow", "com", "/"),
    url_graph.Rule("block", "example.com", "/en/"),
    url_graph.Rule("allow", "www.example.com", "/en/"),
    url_graph.Rule("block", "net", "/es/"),
    url_graph.Rule("block", "net", "/fr/"),
]


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_graph.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=16, seed=4)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.page_derivatives(read(spark, sf_dir, "pages"))
    return records.select(*[c for c in warc.COLUMNS if c != "record"], F.crc32("record").alias("record_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), literal=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no address: source stands for the host and language for the path below it."""
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, read(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), size=4, percent=85)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(
        "doc_id", "source", merkle.record_digest(*head, F.col("text")).alias("leaf"), F.when(tampers, merkle.record_digest(*head, lowered)).alias("tampered")
    )
    rows = merkle.manifest(leaves, group="source", order=["doc_id"], digest="leaf")
    folded = rows.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_nearest_vectors": op1_nearest_vectors,
    "op2_url_trust": op2_url_trust,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_sharding": op4_sharding,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_entropy_mix": op12_entropy_mix,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The others are permutations by hash, trained models, packings and digests in base 32, which are tested otherwise.
ORACLE_SQL: dict[str, str] = {
    "op2_url_trust": oracles.url_trust(URL_RULES, url_graph.DAMPING, math.ceil(math.log(url_graph.TOLERANCE, url_graph.DAMPING)), url_graph.EXCESS),
    "op3_lm_scoring": oracles.lm_scoring(lm_scoring.BACKOFF, lm_scoring.UNSEEN),
    "op8_decontamination": oracles.decontamination(decontaminate.WINDOW),
    "op10_ngram_jaccard": oracles.ngram_jaccard(4, 85),
    "op11_merkle_manifest": oracles.merkle_manifest(5, 4),
    "op13_spelling_variants": oracles.spelling_variants(spelling.LOSS, spelling.MIN_LENGTH, spelling.MIN_COUNT, spelling.MIN_RATIO),
}
