"""The curation flow from records with evidence to decided crops, its gates, typed manifests and the stream's states."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievemill.operators import aggregates, gates
from sievemill.plans import curation
from sievemill.sources import readers
from sievemill.streaming import incremental

REGION = "struct<polygon:array<array<double>>,bbox:array<double>,text:string,confidence:double,trusted:boolean,reliable:boolean>"
SCHEMA = (
    f"key string, digest string, group_id string, width int, height int, annotations array<{REGION}>, original_ocr array<{REGION}>, "
    f"final_ocr array<{REGION}>, scores map<string,double>, glyph_status string, glyph_evidence string"
)


def box(x0, y0, x1, y1, text=None, confidence=None, trusted=None, reliable=None):
    return ([[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)]], None, text, confidence, trusted, reliable)


SETTINGS = curation.Curation(rules=(gates.Rule("clean", 0.5),), long_edge=400, crop=(80.0, 40.0, 0.1, 8), least_confidence=0.7, least_original=0.6)


def decide(spark, settings=SETTINGS, *, annotations=(), original=(), final=(), scores=None, glyph="verified", evidence="seen", size=(200, 100)):
    row = ("k", "d", None, *size, list(annotations), list(original), list(final), {"clean": 0.9} if scores is None else scores, glyph, evidence)
    return curation.crops(spark.createDataFrame([row], SCHEMA), settings).orderBy("crop_no").collect()


def test_a_crop_with_all_evidence_is_accepted(spark):
    """The image doubles in size: a line of 30 x 10 becomes 60 x 20, and its crop has the least size, 80 x 40, around it."""
    (r,) = decide(spark, annotations=[box(50, 40, 80, 50, "Shop", None, True)], final=[box(101, 81, 160, 99, "Shop", 0.9), box(300, 10, 340, 20, "far", 0.9)])
    assert list(r.crop) == [90, 70, 170, 110] and r.status == "accepted" and r.reasons == [] and r.eligible_for_training
    assert [list(x.bbox) for x in r.trusted] == [[10, 10, 70, 30]] and [list(x.bbox) for x in r.predictions] == [[11, 11, 70, 29]]
    assert r.reference.asDict() == {"status": "matched", "conflicts": 0, "unmatched": 0, "missing": 0} and r.labels == {"clean": "pass"}


def test_reasons_of_the_flow(spark):
    line, read = box(50, 40, 80, 50, "Shop", None, True), box(101, 81, 160, 99, "Shop", 0.9)
    at = lambda **k: (lambda r: (r.status, r.reasons))(decide(spark, **{"annotations": [line], "final": [read], **k})[0])
    assert at(annotations=[]) == ("rejected", ["no_localization_text"])
    assert at(final=[box(101, 81, 160, 99, "Stop", 0.9)]) == ("review", ["text_reference_conflict"])
    assert at(final=[box(101, 95, 160, 109, "Shop", 0.9)]) == ("review", ["text_reference_unverifiable"])
    assert at(annotations=[], original=[box(50, 40, 80, 50, "Shop", 0.9, None, False)]) == ("review", ["text_reference_unverifiable"])
    assert at(annotations=[], original=[box(50, 40, 80, 50, "Shop", 0.9, None, True)]) == ("accepted", [])
    assert at(annotations=[], original=[box(50, 40, 80, 50, "Shop", 0.5, None, True)]) == ("review", ["text_reference_unverifiable"])
    # once the text is rejected, glyph and scores aren't looked at
    assert at(final=[box(101, 81, 160, 99, "Shop", 0.6)], scores={"clean": 0.1}) == ("rejected", ["low_ocr_confidence", "glyph_unverifiable", "missing_iqa:clean"])
    assert at(final=[]) == ("rejected", ["no_text", "text_reference_unverifiable", "glyph_unverifiable", "missing_iqa:clean"])
    assert at(scores={"clean": 0.1}) == ("rejected", ["low_iqa:clean"])
    assert at(glyph="conflict") == ("review", ["glyph_conflict"])
    assert at(glyph="verified", evidence="") == ("error", ["verified_glyph_without_evidence"])
    assert at(annotations=[box(50, 40, 280, 50, "Shop", None, True)]) == ("error", ["out_of_bounds"])
    audit = curation.Curation(rules=SETTINGS.rules, long_edge=400, crop=SETTINGS.crop, audit=True)
    assert decide(spark, audit, annotations=[line], final=[read])[0].reasons == ["audit_mode_uncalibrated"]


def test_crops_that_touch_and_duplicates_of_them(spark):
    rows = decide(spark, annotations=[box(10, 10, 40, 20, "a", None, True), box(42, 12, 60, 22, "b", None, True), box(150, 70, 170, 80, "c", None, True)], final=[])
    # doubled, the lines are 20 to 80, 84 to 120 and 300 to 340; the crops around the first two, 10 to 90 and 62 to 142, grow to hold both
    assert [list(r.crop) for r in rows] == [[10, 10, 120, 50], [20, 14, 142, 54], [280, 130, 360, 170]]
    assert [[x.text for x in r.trusted] for r in rows] == [["a", "b"], ["a", "b"], ["c"]]
    assert [list(x.bbox) for x in rows[1].trusted] == [[0, 6, 60, 26], [64, 10, 100, 30]]


def test_demo_record_is_for_review(spark):
    settings = curation.Curation(rules=(gates.Rule("sharpness", 0.5),), demo=True)
    r = curation.crops(curation.demo_record(spark), settings).first()
    assert (r.status, r.reasons, r.eligible_for_training) == ("review", ["demo_backend"], False)


def test_sidecar_backend(spark):
    records = spark.createDataFrame([("a",), ("b",)], "key string")
    side = spark.createDataFrame([("a", 1, 2)], "key string, x int, y int")
    assert sorted(map(tuple, curation.with_sidecar(records, side, "key", ["x"]).collect())) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError, match="duplicate key"):
        curation.with_sidecar(records, side.union(side), "key", ["x"])


def test_repeated_ids_stop_the_run(spark):
    rows = [("1", "s", "x", 1), ("1", "t", "y", 2), ("1", "s", "z", 3)]
    records = spark.createDataFrame(rows, "id string, source string, content string, line_no int")
    with pytest.raises(Exception, match="duplicate source and id"):
        curation.curate(records, curation.Curation()).collect()
    assert curation.curate(records.where("line_no < 3"), curation.Curation()).count() == 2


def test_manifest_types_are_strict(spark, tmp_path):
    good = {"id": "a", "source": "s", "image_path": "a.png"}
    region = {"polygon": [[0, 0], [1, 0], [1, 1]], "text": "x", "confidence": 0.5, "trusted": True}
    lines = [
        good | {"annotations": [region]}, good | {"annotations": [region | {"confidence": True}]}, good | {"annotations": [region | {"trusted": "false"}]},
        good | {"annotations": [region | {"text": 5}]}, good | {"annotations": "none"}, good | {"annotations": [3]}, good | {"group_id": ""}, good | {"id": 7}, [1], good | {"annotations": [region | {"confidence": 1}]},
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    got = {r.line_no: (r.error, r.id, r.source) for r in readers.manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert [got[k][0] for k in range(1, 11)] == [
        None, "confidence_not_a_number", "trusted_not_a_boolean", "text_not_a_string", "annotations_not_a_list", "region_not_an_object", "invalid_group_id", "missing_id", "not_an_object", None,
    ]
    assert got[2][1:] == ("a", "s") and got[12] == ("invalid_json", "invalid_line_12", "unknown")


def test_names_that_come_twice_and_empty_charsets_are_errors(spark, tmp_path):
    (tmp_path / "n.txt").write_text("a.png\nb.png\na.jpg\n")
    with pytest.raises(ValueError, match="duplicate stem"):
        readers.name_list(spark, str(tmp_path / "n.txt"))
    with pytest.raises(ValueError, match="no character"):
        aggregates.charset(spark.createDataFrame([(True, False, ["x"])], "valid boolean, aligned boolean, glyphs array<string>"), "glyphs")


def test_broken_tar_says_so(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for k in range(3):
            info = tarfile.TarInfo(f"{k}.txt")
            info.size = 600
            tar.addfile(info, io.BytesIO(b"x" * 600))
    data = (tmp_path / "s.tar").read_bytes()
    (tmp_path / "s.tar").write_bytes(data[: 512 + 1024 + 512 + 100])
    got = readers.tar_samples(spark, str(tmp_path / "*.tar")).orderBy("key").collect()
    assert [r.key for r in got if r.error is None] == ["0"] and sum(r.error is not None for r in got) == 1


def test_stream_keeps_every_state(spark, tmp_path):
    state = str(tmp_path / "state")
    schema = "id string, source string, content string, line_no long"
    incremental.commit_batch(spark.createDataFrame([("a", "s", "one", 1), ("b", "s", "one", 2), ("c", "s", None, 3)], schema), 0, state, incremental.STATE)
    incremental.commit_batch(spark.createDataFrame([("d", "s", "one", 1), ("e", "s", "two", 2)], schema), 1, state, incremental.STATE)
    got = {r.id: (r.state, r.duplicate_of is not None, r.batch) for r in spark.read.parquet(state).collect()}
    assert got == {"a": ("complete", False, 0), "b": ("duplicate", True, 0), "c": ("error", False, 0), "d": ("duplicate", True, 1), "e": ("complete", False, 1)}
    with pytest.raises(Exception, match="committed before"):
        incremental.commit_batch(spark.createDataFrame([("a", "s", "three", 1)], schema), 2, state, incremental.STATE)


def test_escaped_text_and_means(spark):
    from sievemill.functions.text import html_escaped

    r = spark.range(1).select(html_escaped(F.lit("<a b='c'> & \"d\"")).alias("h")).first()
    assert r.h == "&lt;a b=&#x27;c&#x27;&gt; &amp; &quot;d&quot;"
    rows = spark.createDataFrame([("x", 1.0, None), ("x", 3.0, 0.5), ("y", None, None)], "g string, p double, s double")
    assert {tuple(r) for r in aggregates.metric_means(rows, ["p", "s"], "g").collect()} == {("x", 2, 2.0, 0.5), ("y", 1, None, None)}
    assert aggregates.histogram_totals(rows, F.col("p")).first() == Row(n=2, total=4.0, mean=2.0)


def test_runs_and_writers_on_a_shared_file_system(spark, tmp_path):
    from sievemill import config

    folder = f"file://{tmp_path}/run"
    config.check_shared_run(spark, folder, {"a": 1}, "x")
    config.check_shared_run(spark, folder, {"a": 1}, "x")
    with pytest.raises(ValueError, match="another configuration"):
        config.check_shared_run(spark, folder, {"a": 2}, "x")
    with config.single_shared_writer(spark, folder), pytest.raises(RuntimeError, match="written to"), config.single_shared_writer(spark, folder):
        pass
    with config.single_shared_writer(spark, folder):
        pass


def test_code_hash(tmp_path):
    from sievemill.functions.identity import code_hash

    (tmp_path / "a.py").write_text("x = 1")
    first = code_hash(str(tmp_path), ("numpy", "no-such-package"))
    assert first == code_hash(str(tmp_path), ("no-such-package", "numpy")) != code_hash(str(tmp_path))
    (tmp_path / "a.py").write_text("x = 2")
    assert first != code_hash(str(tmp_path), ("numpy", "no-such-package"))
