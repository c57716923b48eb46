"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskgraph.llm import decontaminate, language, minhash, mixing, secrets
from riskgraph.llm.scratch import Scratch

#: Calibrated probability below which a prediction is no decision. Clean texts of a learned language lie far above.
LEAST_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or of no recognisable language go; the others get the predicted language."""
    model = language.train_language_model(docs)
    packed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))
    named = language.predict_language(packed, model, "rest", keep_text=True)
    known = named.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    now = {"doc_id": F.col("doc_id"), "text": F.col("text"), "lang": F.col("lang_pred")}
    return known.select(*[now.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near-duplicates one row stays, that of the smallest id; texts without words stay.

    Rows are told apart by id and text, so a row that shares its id with another text is judged by its own. Rows
    without an id are in the group of their text and stay only where none of the group has one.
    """
    no_id, id_, hash_ = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")
    found = minhash.near_duplicates(docs).filter("group is not null")
    first = found.groupBy("group").agg(F.min(F.struct(no_id.alias("no_id"), id_.alias("id"), F.col("text_hash").alias("hash"))).alias("k")).select("k.*")
    first = Scratch(spark).keep(first, "kept")
    packed = docs.select(no_id.alias("no_id"), id_.alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.struct("*").alias("row"))
    words = F.coalesce(F.col("row.text").rlike(minhash.WORD), F.lit(False))
    one = packed.filter(words).join(first, ["no_id", "id", "hash"], "left_semi").dropDuplicates(["no_id", "id", "hash"])
    return one.select("row.*").unionByName(packed.filter(~words).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a copy of a test item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every found span is replaced by a mark, so no secret is left and no document is lost."""
    ledger = Scratch(spark).keep(secrets.scan_unseen(docs).filter(F.size("kinds") > 0).select("blob", "starts", "ends"), "findings")
    found = ledger.select(F.col("blob").alias("_blob"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    marked = docs.join(found, secrets.blob_id("text") == F.col("_blob"), "left")
    changed = F.col("_starts").isNotNull()
    text = F.when(changed, secrets.redact("text", "_starts", "_ends")).otherwise(F.col("text"))
    now = {"text": text}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.select(*[now.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources: how many words of each document the mix takes."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language", identify_language),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Language ID is a trained model, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
