"""A training corpus out of documents: language, near duplicates, secrets, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again as the next one's
docs, so a lost executor costs no earlier stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import ship
from lexweave.llm import langid, minhash, mixing, pieces, secret_scan
from lexweave.llm._common import new_folder, quoted, stored
from lexweave.llm.queries import vocabulary

#: A text whose best language has less than this share of all languages' probabilities is rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which a language can be told: those with a letter and a clear best language. The model learns
    from the labelled documents that are not held out; without any, every document with a letter stays."""
    ship(spark)
    model = langid.fit(docs.filter(~langid.held_out()), langid.public_pieces(vocabulary("piece_bpe_32k.model")))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of similarity 0.8 connect, the one of the smallest id, once if its row is
    repeated. Documents without an id are in no group and stay.

    Texts move once, against the ids that go; rows without an id take no part in that. Of an id with several rows the first by
    the hash of the text is found by an aggregate, which keeps one row of each id before it moves any."""
    ship(spark)
    told = minhash.near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).filter("NOT kept OR rows > 1")
    told = stored(told, "pipeline-duplicates")
    with_id = docs.filter("doc_id IS NOT NULL")
    several = with_id.join(told.filter("kept").select("doc_id"), "doc_id", "left_semi")
    firsts = several.groupBy("doc_id").agg(F.min_by(F.struct(*[quoted(c) for c in docs.columns]), F.xxhash64("text")).alias("__row")).select("__row.*")
    return docs.filter("doc_id IS NULL").unionByName(with_id.join(told.select("doc_id"), "doc_id", "left_anti").select(docs.columns)).unionByName(firsts)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; all documents stay."""
    ship(spark)
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their weights: a document appears as often as the mix begins it, at most twice."""
    return mixing.plan_mix(docs).documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text (little-endian unsigned 32-bit, with begin and end) and whether they decode to it."""
    ship(spark)
    made = pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return made.select("doc_id", "lang", "source", F.expr("length(ids) div 4").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL expresses neither the models nor the signatures; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
