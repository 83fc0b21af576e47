"""The curation flow as one lazy plan: key, duplicates, split, gates, summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, identity
from ..operators import aggregates, control, gates


@dataclass(frozen=True)
class Curation:
    """Settings of a run."""

    seed: int = 17
    validation: float = 0.05
    rules: tuple[gates.Rule, ...] = field(default_factory=tuple)
    audit: bool = False
    demo: bool = False
    #: Least confidences of readings, of the processed crop and of the original; least overlap of a match.
    least_confidence: float = 0.8
    least_original: float = 0.8
    least_overlap: float = 0.5
    #: The long edge that images are brought to, and the least size, context and number of crops.
    long_edge: int = 1024
    crop: tuple[float, float, float, int] = (512.0, 256.0, 0.2, 64)
    variants: int = 1


def identified(records: DataFrame) -> DataFrame:
    """Adds key and digest to records (id, source, content, line_no)."""
    return records.withColumn("key", identity.sample_key(F.col("source"), F.col("id"))).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))


def deduplicated(records: DataFrame) -> DataFrame:
    """Adds duplicate_of and state: the first record of a digest in manifest order is complete, its twins are duplicates, errors neither."""
    able = F.col("error").isNull() if "error" in records.columns else None
    out = control.first_wins(records, "digest", "line_no", "key", able)
    broken = F.col("error").isNotNull() if "error" in records.columns else F.lit(False)
    return out.withColumn("state", F.when(broken, "error").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("complete"))


def decided(records: DataFrame, settings: Curation) -> DataFrame:
    """Adds split, status, reasons and labels: duplicates are rejected, errors are errors, the rest goes by the rules on its columns of the rules' names."""
    scores = {r.name: F.col(r.name).cast("double") for r in settings.rules}
    found = gates.assess(None, None, None, scores, list(settings.rules), audit=settings.audit)
    group = F.coalesce(F.col("group_id"), F.col("digest")) if "group_id" in records.columns else F.col("digest")
    rows = records.withColumn("split", identity.split(group, settings.seed, settings.validation)).withColumn("__d", found)
    status = F.when((F.col("state") == "error") | F.col("__d.error").isNotNull(), "error").when(F.col("state") == "duplicate", "rejected").otherwise(F.col("__d.status"))
    reasons = F.when(F.col("state") == "error", F.array(F.col("error") if "error" in records.columns else F.lit("error"))).when(F.col("__d.error").isNotNull(), F.array("__d.error")).when(F.col("state") == "duplicate", F.array(F.lit("duplicate_image"))).otherwise(F.col("__d.reasons"))
    return rows.withColumn("status", status).withColumn("reasons", reasons).withColumn("labels", F.col("__d.labels")).drop("__d")


def unique_ids(records: DataFrame) -> DataFrame:
    """``records``, or an error when computed if a source and id come twice (C1). A count by key that moves no contents, as a scalar subquery: no job of its own."""
    twice = records.groupBy("source", "id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    example = twice.agg(F.min(F.to_json(F.struct("source", "id")))).scalar()
    fault = F.raise_error(F.concat(F.lit("duplicate source and id: "), example)).cast("boolean")
    return records.where(F.when(example.isNotNull(), fault).otherwise(F.lit(True)))


def curate(records: DataFrame, settings: Curation) -> DataFrame:
    """records (id, source, content, line_no and a column for each rule) with key, digest, duplicate_of, state, split, status, reasons, labels.

    A source and id that come twice are an error of the run (C1).
    """
    return decided(deduplicated(identified(unique_ids(records))), settings)


def crops(records: DataFrame, settings: Curation) -> DataFrame:
    """One row a crop of each record that is left, with all evidence and the decision: the curation flow (2.13).

    ``records``: key, digest, group_id, width, height, and what the stages before gave: ``annotations`` and ``original_ocr`` (arrays of
    regions in the original's pixels; struct(polygon, text, confidence, trusted, reliable)), ``final_ocr`` (regions read in the
    processed image, in its pixels), ``scores`` (a map), ``glyph_status`` and ``glyph_evidence``. These come from a
    precomputed or sidecar back-end, that is from a join; no model runs here.

    A record without regions in the original is one rejected row, ``no_localization_text``, without a crop. Else the
    regions are brought to the long edge, crops grow around them, and a crop has the regions that it holds whole. Where the text
    of a crop is rejected, glyph and scores aren't looked at. Regions that aren't valid make the record an error.
    """
    size = geometry.long_edge_size(F.col("width"), F.col("height"), settings.long_edge)
    bad = lambda c: F.get(F.filter(F.transform(c, lambda r: geometry.region_error(r["polygon"], F.col("width"), F.col("height"))), lambda e: e.isNotNull()), F.lit(0))
    rows = records.withColumn("__size", size).withColumn("region_error", F.coalesce(bad(F.col("annotations")), bad(F.col("original_ocr"))))
    sx, sy = F.col("__size.width") / F.col("width"), F.col("__size.height") / F.col("height")

    def moved(r: Column, polygon: Column) -> Column:
        return r.withField("polygon", polygon).withField("bbox", geometry.bounds(polygon))

    scaled = lambda c: F.transform(F.coalesce(c, F.slice(F.col("final_ocr"), 1, 0)), lambda r: moved(r, geometry.rescaled(r["polygon"], sx, sy)))
    rows = rows.withColumn("__annotations", scaled(F.col("annotations"))).withColumn("__original", scaled(F.col("original_ocr")))
    rows = rows.withColumn("__final", F.transform("final_ocr", lambda r: moved(r, r["polygon"])))
    boxes = F.transform(F.concat("__annotations", "__original"), lambda r: r["bbox"])
    wide, high, context, most = settings.crop
    found = F.when(F.col("region_error").isNull(), geometry.text_crops(boxes, F.col("__size.width"), F.col("__size.height"), wide, high, context, most))
    rows = rows.withColumn("__crops", found).select("*", F.posexplode_outer("__crops").alias("crop_no", "crop"))

    def within(c: str) -> Column:
        crop = F.col("crop")
        shift = lambda p: F.array(p[0] - crop[0], p[1] - crop[1])
        return F.transform(F.filter(c, lambda r: geometry.contains(crop, r["bbox"])), lambda r: moved(r, F.transform(r["polygon"], shift)))

    rows = rows.withColumn("trusted", within("__annotations")).withColumn("original", within("__original")).withColumn("predictions", within("__final"))
    rows = gates.reference_checked(rows, "predictions", "trusted", "original", settings.least_overlap, settings.least_original)
    rows = rows.withColumn("__read", F.size(gates.text_rejections(F.col("predictions"), settings.least_confidence)) == 0)
    read = F.col("__read")
    scores = {r.name: F.when(read, F.col("scores")[r.name]) for r in settings.rules}
    decision = gates.assess(
        F.col("predictions"), F.col("reference.status"), F.when(read, F.col("glyph_status")), scores, list(settings.rules),
        audit=settings.audit, demo=settings.demo, least_confidence=settings.least_confidence, glyph_evidence=F.col("glyph_evidence"),
    )
    group = F.coalesce(F.col("group_id"), F.col("digest"))
    rows = rows.withColumn("__d", decision).withColumn("split", identity.split(group, settings.seed, settings.validation))
    broken, nothing = F.coalesce("region_error", "__d.error"), F.col("crop").isNull()
    error = F.when(nothing, F.col("region_error")).otherwise(broken)
    status = F.when(error.isNotNull(), "error").when(nothing, "rejected").otherwise(F.col("__d.status"))
    reasons = F.when(error.isNotNull(), F.array(error)).when(nothing, F.array(F.lit("no_localization_text"))).otherwise(F.col("__d.reasons"))
    given = [c for c in records.columns if c not in ("annotations", "original_ocr", "final_ocr")]
    return rows.select(
        *given, "crop_no", "crop", "trusted", "original", "predictions", "reference", "split",
        status.alias("status"), reasons.alias("reasons"), F.col("__d.labels").alias("labels"), (status == "accepted").alias("eligible_for_training"),
    )


def with_sidecar(records: DataFrame, sidecar: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """``records`` with the stages' results that a sidecar table has for their key: a precomputed back-end (2.15). Two rows of a key are an error; none leaves nulls."""
    control.require_unique(sidecar, key)
    return records.join(sidecar.select(key, *stages), key, "left")


def demo_record(spark: SparkSession) -> DataFrame:
    """One synthetic record, all of whose evidence is good (X18). Curated in demo mode, it still is only for review."""
    region = "struct<polygon:array<array<double>>,bbox:array<double>,text:string,confidence:double,trusted:boolean,reliable:boolean>"
    box = [[40.0, 50.0], [200.0, 50.0], [200.0, 90.0], [40.0, 90.0]]
    line = (box, [40.0, 50.0, 200.0, 90.0], "DEMO", 0.99, True, True)
    large = ([[x * 4 for x in p] for p in box], [160.0, 200.0, 800.0, 360.0], "DEMO", 0.99, None, None)
    schema = (
        f"key string, digest string, group_id string, width int, height int, annotations array<{region}>, original_ocr array<{region}>, "
        f"final_ocr array<{region}>, scores map<string,double>, glyph_status string, glyph_evidence string"
    )
    return spark.createDataFrame([("demo", "demo", None, 256, 128, [line], [line], [large], {"sharpness": 0.9}, "verified", "drawn")], schema)


def summary(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run's summary."""
    return {"status": aggregates.status_counts(rows), "reasons": aggregates.reason_counts(rows), "states": rows.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"))}
