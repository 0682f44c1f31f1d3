"""Raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronlens.functions.running import running_totals
from patronlens.llm.bpe import encode_documents
from patronlens.llm.decontamination import decontaminate
from patronlens.llm.near_duplicates import near_duplicates
from patronlens.llm.quality import quality_rules
from patronlens.llm.queries import table, tokenizer_path, workers_find_package
from patronlens.llm.surrogates import pseudonymize
from patronlens.sources.stages import new_stage_path, released, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURROGATE_KEY = "patronlens"


def _row_key() -> Column:
    """Tells rows apart by id and text; rows alike in both fare alike."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("text").cast("string"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    workers_find_package(spark)
    keyed = docs.withColumn("row_key", _row_key())
    kept = quality_rules(keyed, key="row_key").where("kept").select("row_key")
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def _own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_id``: the id, or one above all ids for further texts of an id that has several."""
    narrow = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"))
    several = narrow.groupBy("doc_id").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last")
    several = stage(several, "shared-ids")
    if several.isEmpty():
        return docs.withColumn("row_id", F.col("doc_id"))
    further = narrow.join(several, "doc_id").where("mark <> first").select("doc_id", "mark").distinct()
    top = narrow.agg(F.max("doc_id")).first()[0]
    numbered = running_totals(further, ["doc_id", "mark"], F.lit(1), "number")
    numbered = numbered.select(F.col("doc_id").alias("of"), "mark", (F.col("number") + top + 1).alias("other"))
    own = (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("mark"))
    return docs.join(numbered, own, "left").withColumn("row_id", F.coalesce("other", "doc_id")).select(*COLUMNS, "row_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows without an id all stay.

    Different texts of one id are documents of their own; equal rows are one document.
    """
    workers_find_package(spark)
    named = _own_ids(docs)
    found = near_duplicates(named.select(F.col("row_id").alias("doc_id"), "text"))
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("row_id")).distinct()
    # The join has brought equal row ids together; what they have is alike, and one of them stays.
    alone = named.where("row_id is not null").join(kept, "row_id").dropDuplicates(["row_id"])
    return alone.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    workers_find_package(spark)
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the text where it changed."""
    workers_find_package(spark)
    replaced = pseudonymize(docs.select(*COLUMNS), SURROGATE_KEY)
    size = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", size).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (unsigned 32-bit little-endian), with digests of them and of the decoded text."""
    workers_find_package(spark)
    return encode_documents(docs, tokenizer_path()).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("token_ids", token_ids),
]

#: Language model, surrogates and tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = new_stage_path(spark, f"pipeline-{name}")
        # What the operators staged goes once the stage's own result is written.
        with released():
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
