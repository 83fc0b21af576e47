"""Validation and canonical form of records, regions and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import DONT_CARE, blank, compact


def json_type(document: Column, path: str) -> Column:
    """The JSON type at a path of a VARIANT, upper case, or null where there is nothing. ``from_json`` would turn what doesn't fit into null."""
    return F.schema_of_variant(F.variant_get(document, path, "variant"))


def required_text(document: Column, path: str) -> Column:
    """Whether a VARIANT has a JSON string that isn't blank there."""
    return F.coalesce((json_type(document, path) == "STRING") & ~blank(F.try_variant_get(document, path, "string")), F.lit(False))


def manifest_error(document: Column) -> Column:
    """Why a manifest record is no record, or null."""
    checks = [F.when(document.isNull(), "invalid_json"), F.when(~F.startswith(F.schema_of_variant(document), F.lit("OBJECT")), "not_an_object")]
    return F.coalesce(*checks, *[F.when(~required_text(document, f"$.{name}"), f"missing_{name}") for name in ("id", "source", "image_path")])


def regions(items: Column, width: Column, height: Column) -> Column:
    """Array of struct(polygon, bbox, text, confidence, error) from structs with polygon or bbox, text, confidence.

    A polygon counts before a box. Errors are reported, not dropped: geometry, then confidence outside [0, 1].
    """

    def one(item: Column) -> Column:
        raw = F.coalesce(item["polygon"], F.when(F.size(item["bbox"]) == 4, geometry.box_polygon(item["bbox"])))
        fault = F.coalesce(geometry.region_error(raw, width, height), F.when(item["confidence"].isNotNull() & (~geometry.finite(item["confidence"]) | (item["confidence"] < 0) | (item["confidence"] > 1)), "invalid_confidence"))
        polygon = geometry.snapped(raw, width, height)
        return F.struct(polygon.alias("polygon"), geometry.bounds(polygon).alias("bbox"), item["text"].alias("text"), item["confidence"].alias("confidence"), fault.alias("error"))

    return F.transform(items, one)


def audited(rows: DataFrame, items: str, width: Column, height: Column) -> DataFrame:
    """Splits native annotations into ``valid`` and ``invalid``, the latter with a reason.

    Illegible and withdrawn ones are invalid; an annotation is trusted where it says so and has text. Captions are never transcripts: they aren't looked at.
    """

    def one(a: Column) -> Column:
        raw = F.coalesce(a["polygon"], F.when(F.size(a["bbox"]) == 4, geometry.box_polygon(a["bbox"])))
        reason = F.when(F.coalesce(~a["valid"], F.lit(False)), "marked_invalid").when(F.coalesce(a["illegibility"], F.lit(False)), "illegible").otherwise(geometry.region_error(raw, width, height))
        return F.struct(raw.alias("polygon"), a["text"].alias("text"), a["rec_score"].alias("confidence"), (F.coalesce(a["trusted"], F.lit(False)) & ~blank(a["text"])).alias("trusted"), reason.alias("reason"))

    checked = F.transform(F.col(items), one)
    return rows.withColumn("__c", checked).withColumn("valid", F.filter("__c", lambda a: a["reason"].isNull())).withColumn("invalid", F.filter("__c", lambda a: a["reason"].isNotNull())).drop("__c")


def early_rejects(rows: DataFrame, annotations: str, readings: str) -> tuple[DataFrame, DataFrame]:
    """Rows with something to look at, and those to reject before the dear stage (P5). Put it ahead of mapInPandas: no filter is pushed through that."""
    empty = (F.coalesce(F.size(annotations), F.lit(0)) <= 0) & (F.coalesce(F.size(readings), F.lit(0)) <= 0)
    return rows.where(~empty), rows.where(empty).withColumn("status", F.lit("rejected")).withColumn("reasons", F.array(F.lit("no_text")))


def judged_lines(rows: DataFrame, lines: str, include_difficult: bool = False) -> DataFrame:
    """One row a line that counts, with its index in the list as it was; ``ignored`` is how many of the image don't."""
    exploded = rows.select("*", F.posexplode_outer(lines).alias("index", "line"))
    label = compact(F.col("line.transcription"))
    skip = F.col("line").isNull() | (F.coalesce(label, F.lit("")) == "") | F.col("line.transcription").isin(*DONT_CARE)
    if not include_difficult:
        skip |= F.coalesce(F.col("line.difficult"), F.lit(False))
    return exploded.withColumn("norm_label", label).withColumn("ignored", skip)


def line_record(line: Column, image_aligned: Column) -> Column:
    """struct(quad, text, valid, aligned, teacher_correct, error) of a line in one of several shapes.

    Exactly one of quad, points, bbox and box; the transcript goes by transcript, transcription or text; difficult, ignored and
    don't-care lines aren't valid; alignment needs the image's and the line's own.
    """
    named = [line[k] for k in ("quad", "points", "bbox", "box")]
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in named[1:]), F.when(named[0].isNotNull(), 1).otherwise(0))
    text = F.coalesce(line["transcript"], line["transcription"], line["text"])
    yes = lambda x, default: F.coalesce(x, F.lit(default))
    valid = yes(line["valid"], True) & ~yes(line["difficult"], False) & ~yes(line["ignore"], False) & ~yes(text.isin(*DONT_CARE), False)
    quad = geometry.convex_clockwise(geometry.quad_of(F.coalesce(*named)))
    return F.struct(quad.alias("quad"), text.alias("text"), valid.alias("valid"), (image_aligned & yes(line["alignment_valid"], True)).alias("aligned"), line["teacher_correct"].alias("teacher_correct"), F.when(n != 1, "needs_one_geometry").when(quad.isNull(), "invalid_quad").alias("error"))


def artifact_error(size: Column, processed: Column, digest: Column, pixels: Column) -> Column:
    """Why a sidecar doesn't belong to the processed image, or null; a missing digest isn't checked."""
    return F.when(~size.eqNullSafe(processed), "size_mismatch").when(digest.isNotNull() & (digest != pixels), "digest_mismatch")


def detail_error(quad: Column, size: Column) -> Column:
    """Why the geometry of an OCR detail is bad, or null; both parts may be missing."""
    bad_quad = (F.size(quad) != 4) | ~F.forall(quad, lambda p: (F.size(p) == 2) & geometry.finite(p[0]) & geometry.finite(p[1])) | (geometry.signed_area(quad) == 0)
    return F.when(quad.isNotNull() & bad_quad, "invalid_quad").when(size.isNotNull() & ((F.size(size) != 2) | F.exists(size, lambda s: s <= 0)), "invalid_size")


def over_threshold(score: Column, threshold: float) -> Column:
    """Strictly greater, compared as 32-bit floats."""
    return score.cast("float") > F.lit(threshold).cast("float")


def differing_settings(runs: DataFrame, names: list[str]) -> DataFrame:
    """Settings with more than one value among the runs that have them; a missing one is no difference."""
    parts = None
    for name in names:
        one = runs.agg(F.count_distinct(name).alias("n"), F.collect_set(F.col(name).cast("string")).alias("found")).select(F.lit(name).alias("setting"), "n", "found")
        parts = one if parts is None else parts.union(one)
    return parts.where("n > 1")


def first_present(rows: DataFrame, names: list[str], out: str) -> DataFrame:
    """The first of several columns that has a value; rows without any go."""
    return rows.withColumn(out, F.coalesce(*names)).where(F.col(out).isNotNull())
