"""The accept, review and reject rules, as columns.

Rules speak in a fixed order; a record's reasons are those that reject, then those that ask for review. One that rejects
decides, else one that asks for review does, else the record is accepted. Missing evidence asks for review.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite
from ..functions.text import blank, collapsed, collapsed_list
from .match import greedy_match


@dataclass(frozen=True)
class Rule:
    """A scored dimension: ``higher`` scores have to reach the threshold, ``lower`` ones must not exceed it."""

    name: str
    threshold: float
    direction: str = "higher"

    def __post_init__(self):
        if self.direction not in ("higher", "lower"):
            raise ValueError(f"direction of {self.name} is neither higher nor lower")


def _reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Texts of the conditions that hold, in their order; a condition that is null does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in pairs])) if pairs else F.array().cast("array<string>")


def score_outcome(score: Column, rule: Rule) -> Column:
    """"missing", "pass" or "fail"."""
    good = score >= rule.threshold if rule.direction == "higher" else score <= rule.threshold
    return F.when(score.isNull(), "missing").when(good, "pass").otherwise("fail")


def text_rejections(predictions: Column, least: float) -> Column:
    """No text, or some prediction that is blank or below the confidence asked for."""
    poor = F.exists(predictions, lambda p: blank(p["text"]) | (F.coalesce(p["confidence"], F.lit(0.0)) < least))
    none = predictions.isNull() | (F.size(predictions) <= 0)
    return _reasons((none, "no_text"), (~none & poor, "low_ocr_confidence"))


def decide(rejected: Column, review: Column) -> Column:
    """struct(status, reasons)."""
    status = F.when(F.size(rejected) > 0, "rejected").when(F.size(review) > 0, "review").otherwise("accepted")
    return F.struct(status.alias("status"), F.concat(rejected, review).alias("reasons"))


def assess(
    predictions: Column | None, reference_status: Column | None, glyph_status: Column | None, scores: dict[str, Column], rules: list[Rule], *, audit: bool = False, demo: bool = False, least_confidence: float = 0.0, glyph_evidence: Column | None = None
) -> Column:
    """struct(status, reasons, labels, error) of a record.

    Evidence given as None isn't asked for. ``error`` is set where a score isn't finite, a glyph status is unknown or a verified
    one has no evidence: such records are errors, whatever the status says. All evidence counts, whatever the text's; a flow that
    doesn't look at later evidence once the text is rejected passes it as null (see ``plans.curation``). A null glyph status is unverifiable.
    """
    none = F.array().cast("array<string>")
    rejected = text_rejections(predictions, least_confidence) if predictions is not None else none
    review = [_reasons((F.lit(audit), "audit_mode_uncalibrated"))]
    errors = []
    if reference_status is not None:
        review.append(_reasons((reference_status == "conflict", "text_reference_conflict"), (reference_status.isNull() | ~reference_status.isin("conflict", "matched"), "text_reference_unverifiable")))
    if glyph_status is not None:
        seen = F.coalesce(glyph_status, F.lit("unverifiable"))
        errors.append(F.when(~F.coalesce(seen.isin("verified", "conflict", "unverifiable"), F.lit(False)), "unknown_glyph_status"))
        if glyph_evidence is not None:
            errors.append(F.when((seen == "verified") & blank(glyph_evidence), "verified_glyph_without_evidence"))
        review.append(_reasons((seen != "verified", F.concat(F.lit("glyph_"), seen))))
    labels = []
    for rule in rules:
        score = scores[rule.name]
        errors.append(F.when(score.isNotNull() & ~finite(score), f"score_not_finite:{rule.name}"))
        found = score_outcome(score, rule)
        labels += [F.lit(rule.name), found]
        rejected = F.concat(rejected, _reasons((found == "fail", f"low_iqa:{rule.name}")))
        review.append(_reasons((found == "missing", f"missing_iqa:{rule.name}")))
    review.append(_reasons((F.lit(demo), "demo_backend")))
    decision = decide(rejected, F.concat(*review))
    named = F.create_map(*labels) if labels else F.create_map().cast("map<string,string>")
    return F.struct(decision["status"].alias("status"), decision["reasons"].alias("reasons"), named.alias("labels"), (F.coalesce(*errors) if errors else F.lit(None).cast("string")).alias("error"))


def reference_set(annotations: Column, original: Column, least_original: float) -> Column:
    """What predictions are held against: trusted annotations with text if there are any, else reliable and confident texts read from the original."""
    trusted = F.filter(annotations, lambda r: F.coalesce(r["trusted"], F.lit(False)) & ~blank(r["text"]))
    sure = F.filter(original, lambda r: F.coalesce(r["reliable"], F.lit(False)) & (F.coalesce(r["confidence"], F.lit(0.0)) >= least_original) & ~blank(r["text"]))
    return F.when(F.size(trusted) > 0, trusted).otherwise(F.coalesce(sure, F.slice(original, 1, 0)))


def reference_status(conflicts: Column, unmatched: Column, missing: Column, predictions: Column) -> Column:
    """From counts of a matching: any conflict decides; an unmatched prediction, a missing reference or no prediction is unverifiable."""
    return F.when(conflicts > 0, "conflict").when((unmatched > 0) | (missing > 0) | (predictions == 0), "unverifiable").otherwise("matched")


def same_text(a: Column, b: Column) -> Column:
    """Equal but for form and white space; case counts."""
    return collapsed(a).eqNullSafe(collapsed(b))


def reference_checked(rows: DataFrame, predictions: str, trusted: str, original: str, least_overlap: float, least_original: float) -> DataFrame:
    """Adds ``reference``, struct(status, conflicts, unmatched, missing): predictions held against ``reference_set`` by greedy overlap.

    Each prediction in turn takes the unused reference that it overlaps most, if enough; the texts have to be the same. Columns of
    arrays of struct(bbox, text, ...); null counts as empty. All within the row, no join; each step is a column, so none is computed twice.
    """
    nothing = F.slice(F.array(F.struct(F.array(F.lit(0.0)).alias("bbox"), F.lit("").alias("text"))), 1, 0)
    short = lambda c: F.coalesce(F.transform(c, lambda r: F.struct(r["bbox"].alias("bbox"), r["text"].alias("text"))), nothing)
    part = lambda c, name: F.transform(c, lambda r: r[name])
    out = rows.withColumn("__given", short(F.col(predictions))).withColumn("__held", short(reference_set(F.col(trusted), F.col(original), least_original)))
    out = out.withColumn("__found", greedy_match(part("__given", "bbox"), part("__held", "bbox"), least_overlap))
    out = out.withColumn("__read", collapsed_list(part("__given", "text")))
    out = out.withColumn("__known", collapsed_list(F.transform("__found", lambda k: F.get("__held", k)["text"])))
    same = F.zip_with("__read", "__known", lambda a, b: a.eqNullSafe(b))
    out = out.withColumn("__pairs", F.zip_with(same, "__found", lambda s, k: F.when(k < 0, "none").when(s, "match").otherwise("conflict")))
    count = lambda what: F.size(F.filter("__pairs", lambda x: x == what))
    missing = F.size("__held") - F.size(F.filter("__found", lambda k: k >= 0))
    status = reference_status(count("conflict"), count("none"), missing, F.size("__given"))
    found = F.struct(status.alias("status"), count("conflict").alias("conflicts"), count("none").alias("unmatched"), missing.alias("missing"))
    return out.withColumn("reference", found).drop("__given", "__held", "__found", "__read", "__known", "__pairs")
