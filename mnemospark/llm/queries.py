"""The thin queries over the given tables: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, decontamination, fingerprints, kneser_ney, language, manifest, minhash, mixing, passages, token_counts, token_store, toxicity, whitening
from mnemospark.llm.common import crc_is, ready, table
from mnemospark.llm.manifest import leaf_digest
from mnemospark.llm.oracle import ORACLE  # noqa: F401
from mnemospark.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(ready(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, folder, "documents")))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    place = new_folder(spark, "token-store")
    token_store.write(table(spark, folder, "documents"), place, end_id=2)
    return token_store.read(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated"
    )


@query
def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(~crc_is(3, 1)))
    return language.identify(docs, model).select("doc_id", crc_is(3, 1).alias("held_out"), "lang_pred", "score")


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents")).select(
        "doc_id", "start", "stop", "n_words", "first_doc_id"
    )


@query
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = kneser_ney.train(docs.where(~crc_is(7, 2)), new_folder(spark, "kneser-ney"), order=3)
    scored = kneser_ney.score(docs, model)
    return scored.select(
        "doc_id", crc_is(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~crc_is(4, 2)))
    return toxicity.toxicity(docs, model).select("doc_id", crc_is(4, 2).alias("held_out"), "score", "predicted")


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    without_lines = leaf_digest(text=F.translate("text", "\n", ""))
    shown = F.when(crc_is(2, 0), without_lines).otherwise(leaf_digest())
    proven = manifest.proofs(manifest.build(table(spark, folder, "documents"), shown=shown))
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        manifest.fold(F.col("shown"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.words_taken(mixing.mix(table(spark, folder, "documents")))


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, dimension = whitening.usable(table(spark, folder, "embeddings"))
    model = whitening.fit(rows, dimension)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], shape)
    explained = F.array(*[F.lit(None if e != e else float(e)).cast("double") for e in model.explained])
    return (
        whitening.whiten(rows, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            explained[F.col("at")].alias("explained"),
            F.lit(model.identity_error).cast("double").alias("identity_error"),
        )
    )
