"""The corpus pipeline: quality, toxicity, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``; the mix returns a document as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemill.llm import classify, common, mixing, neardup, packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this stage's labelled documents, does not reject.

    Null and empty texts are scored as the empty text, the longest ones whole; equal texts share a score, repeated rows and null ids
    are judged row by row. Without labels, as for an empty table, every score is 0.5 and no document is kept.
    """
    scorer = classify.quality_scorer(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(classify.scored(docs, scorer) >= classify.QUALITY_THRESHOLD)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. Rows are judged as in ``quality``; without labels, or without toxic ones, all that score below 0.5 stay."""
    scorer = classify.toxic_scorer(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(classify.scored(docs, scorer) < classify.TOXIC_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one with the least doc_id, null coming last. Rows count one by one, whatever their ids.

    Repeated rows are copies of each other. Null and empty texts have no words, link with nothing, and all stay. Whole texts are compared, the longest ones, too.
    """
    rows = common.stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = neardup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    kept = groups.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(first).select(F.col("first.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice. Null texts have size 0; rows with equal id, source and text share their copies evenly; a null source is a source."""
    names = docs.columns
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    sizes = common.stored(keyed.select("doc_id", "source", "__h", common.n_words(F.col("text")).alias("__size")), "sizes")
    taken = mixing.mix(sizes, "__size")
    copies = taken.groupBy("doc_id", "source", "__h").agg(F.sum("copies").alias("__n"), F.count(F.lit(1)).alias("__rows")).where("__n > 0")
    copies = copies.select(*[F.col(k).alias(f"__{k}_") for k in ("doc_id", "source", "__h")], "__n", "__rows")
    found = keyed.join(copies, keyed["doc_id"].eqNullSafe(F.col("__doc_id_")) & keyed["source"].eqNullSafe(F.col("__source_")) & (keyed["__h"] == F.col("____h_")))
    # rows with equal keys share their copies evenly
    k = F.row_number().over(W.partitionBy("doc_id", "source", "__h").orderBy(F.xxhash64(*names)))
    times = F.floor(k * F.col("__n") / F.col("__rows")) - F.floor((k - 1) * F.col("__n") / F.col("__rows"))
    return found.withColumn("__c", times).where("__c > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))).select(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids. Null and empty texts are a piece of the end id, repeated rows and null ids are packed row by row."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: The stages learn, link and pack: SQL can't express them. tests/llm/test_pipeline.py holds each stage and run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            common.dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
