"""One query for each operator of the training-data pipeline, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import codebooks, langid, licenses, merkle, minhash, mixing, pieces, pii, secret_scan, sharding, sql, topk, wavelet, whitening

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; only queries name one, operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8, dims=("bytes", "chars", "lang"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=(85, 100))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.edit_study(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = [r.kind for r in secret_scan.BASE_RULES]

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*wanted):
        return F.filter("secrets", lambda s: s["kind"].isin(*wanted))

    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(told(of(*kinds)), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).taken()


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()), langid.public_pieces(vocabulary("piece_bpe_32k.model")))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wavelet.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents")).spans()
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "found"))).alias("spans"))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_fingerprints": op4_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_top_k": op8_top_k,
    "op9_language": op9_language,
    "op10_token_files": op10_token_files,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_personal_data": op13_personal_data,
}
ORACLE_SQL: dict[str, str] = {
    "op6_mixing": sql.OP6_MIXING,
    "op8_top_k": sql.OP8_TOP_K,
    "op11_vector_codes": sql.OP11_VECTOR_CODES,
}
