"""Operators of the curation and evaluation engine on small tables with known answers."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievemill import catalog, config
from sievemill.functions import geometry as g
from sievemill.functions import identity, numeric, text
from sievemill.operators import aggregates, align, control, gates, match, metrics, sampling, validate
from sievemill.plans import assembly, curation, evaluation
from sievemill.sources import readers, writers
from sievemill.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, **columns):
    """The values of expressions."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def arr(x):
    return F.array(*[arr(v) for v in x]) if isinstance(x, list) else F.lit(float(x))


# -- queries against SQL ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def base(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, base, name):
    got = catalog.queries()[name](spark, small)
    rows = got.collect()
    assert rows
    if sql := catalog.oracle_sql().get(name):
        want = base.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        key = lambda r: tuple((v is not None, v) for v in r)
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=key) == sorted(want.project(", ".join(columns)).fetchall(), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# -- text ---------------------------------------------------------------------------------------------------------------


def test_normalisers(spark):
    rows = spark.createDataFrame([("Ａ BＣ ", 0), ("é  x y\n", 1), ("a\tb", 2), (None, 3)], "t string, k int")
    got = {r.k: (r.a, r.b) for r in rows.select("k", text.collapsed(F.col("t")).alias("a"), text.compact(F.col("t"), True).alias("b")).collect()}
    assert got == {0: ("Ａ BＣ", "abc"), 1: ("é x y", "éxy"), 2: ("a b", "ab"), 3: (None, None)}


def test_stems_and_json(spark):
    r = one(spark, a=text.stem(F.lit("x/page.02.png")), b=text.image_stem(F.lit("x\\page.02")), c=text.image_stem(F.lit("d/img_sr_x4.PNG"), ("_x4", "_sr_x4")), d=text.json_list(F.lit('a"é'), F.lit("b")), e=text.image_stem(F.lit("_x4.png"), ("_x4",)))
    assert (r.a, r.b, r.c, r.d, r.e) == ("page.02", "page.02", "img", json.dumps(['a"é', "b"], ensure_ascii=False), "_x4")
    rows = spark.createDataFrame([("{'b': 1, 'a': (1, 2)}",), ('{"z": "é"}',), ("nonsense",), (None,)], "t string")
    assert [x.v for x in rows.select(text.literal_json(F.col("t")).alias("v")).collect()] == ['{"a": [1, 2], "b": 1}', '{"z": "é"}', None, None]
    assert one(spark, d=text.edit_distance(F.lit("é中"), F.lit("e")), e=text.edit_distance(F.lit(None).cast("string"), F.lit("ab"))) == Row(d=2, e=2)


# -- identity -----------------------------------------------------------------------------------------------------------


def test_identity(spark):
    import hashlib

    name = 'x"é'
    key = hashlib.sha256(json.dumps(["s", name], ensure_ascii=False).encode()).hexdigest()
    seed = int.from_bytes(hashlib.sha256(b"5:a:0").digest()[:8], "big")
    r = one(spark, k=identity.sample_key(F.lit("s"), F.lit(name)), s=identity.seed64(F.lit("5"), F.lit("a"), F.lit("0")), p=identity.pixel_digest(F.lit(2), F.lit(1), F.lit(b"abcdef")))
    assert (r.k, int(r.s), r.p) == (key, seed, hashlib.sha256(b"RGB:2:1:abcdef").hexdigest())
    ids = [str(k) for k in range(500)]
    got = {r.i: r.s for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", identity.split(F.col("i"), 9, 0.05).alias("s")).collect()}
    assert got == {i: "validation" if int.from_bytes(hashlib.sha256(f"9:{i}".encode()).digest()[:8], "big") / 2**64 < 0.05 else "train" for i in ids}
    files = spark.createDataFrame([("a", "lq", "/a", 1, 2), ("a", "hq", "/b", 3, 4), ("b", "lq", "/c", 5, 6)], "name string, kind string, path string, size long, mtime long")
    assert identity.manifest_fingerprint(files).first() == identity.manifest_fingerprint(files.repartition(3).orderBy(F.desc("path"))).first()


# -- geometry -----------------------------------------------------------------------------------------------------------


def test_sizes_and_maps(spark):
    p = [[1, 2], [5, 2], [5, 8], [1, 8]]
    m = [[2, 0, 3], [0, 4, -1], [0, 0, 1]]
    r = one(spark, s=g.long_edge_size(F.lit(2000), F.lit(500), 1024), back=g.transformed(g.transformed(arr(p), arr(m)), g.inverse(arr(m))), same=g.composed(arr(m), g.inverse(arr(m))), even=g.long_edge_size(F.lit(8), F.lit(5), 4))
    assert (r.s.width, r.s.height, r.s.scale) == (1024, 256, 0.512) and r.even.height == 2
    assert np.allclose(r.back, p) and np.allclose(r.same, np.eye(3))


@pytest.mark.parametrize(("polygon", "error"), [([[0, 0], [9, 0], [9, 9]], None), ([[0, 0], [1, 1]], "too_few_points"), ([[-1, 0], [9, 0], [9, 9]], "out_of_bounds"), ([[0, 0], [11, 0], [9, 9]], "out_of_bounds"), ([[0, 0], [math.nan, 0], [9, 9]], "not_finite"), ([[3, 0], [3, 5], [3, 9]], "empty_extent"), ([[-1e-8, 0], [9, 0], [9, 9]], None)])
def test_region_errors(spark, polygon, error):
    assert one(spark, e=g.region_error(arr(polygon), F.lit(10), F.lit(10))).e == error


def test_box_relations(spark):
    a, b = [0, 0, 10, 10], [5, 5, 15, 15]
    r = one(spark, i=g.iou(arr(a), arr(b)), z=g.iou(arr([0, 0, 0, 0]), arr([0, 0, 0, 0])), t=g.intersects(arr(a), arr([10, 0, 12, 5])), c=g.contains(arr(a), arr([0, 0, 10, 10])), n=g.complete_regions(arr([[1, 1, 3, 3], [8, 8, 12, 12]]), arr(a)), area=g.signed_area(arr([[0, 0], [4, 0], [4, 3], [0, 3]])))
    assert (round(r.i, 9), r.z, r.t, r.c, r.n, r.area) == (round(25 / 175, 9), 0.0, False, True, [[1.0, 1.0, 3.0, 3.0]], 12.0)


@pytest.mark.parametrize(
    ("quad", "width", "height"),
    [
        ([[3, 1], [53, 1], [53, 12], [3, 12]], 50, 11),
        ([[0, 0], [8, 0], [8, 12], [0, 12]], 12, 8),  # 12 is 1.5 times 8: upright text
        ([[0, 0], [9, 0], [9, 13], [0, 13]], 9, 13),
        ([[0, 0], [30, 0], [36, 8], [0, 10]], math.hypot(36, 2), 10),  # the longer of opposite sides
        ([[0, 0], [20, 0], [40, 0], [40, 7], [0, 7]], 40, 7),  # more corners: the least rectangle around them
        ([[0, 5], [5, 0], [45, 40], [40, 45]], math.hypot(40, 40), math.hypot(5, 5)),
        ([[2, 2], [14, 2], [8, 6]], 12, 4),
    ],
)
def test_line_sizes(spark, quad, width, height):
    found = one(spark, s=g.line_size(arr(quad))).s
    assert np.allclose([found.width, found.height], [width, height])


def test_canonical_quads(spark):
    flat = [[0, 0], [10, 0], [10, 1e-9], [0, 1e-9]]
    r = one(
        spark,
        box=g.quad_of(arr([1, 2, 4, 6])), inverted=g.quad_of(arr([4, 2, 1, 6])), empty=g.quad_of(arr([1, 2, 1, 6])), five=g.quad_of(arr([1, 2, 3, 4, 5])),
        corners=g.quad_of(arr([0, 0, 2, 0, 2, 1, 0, 1])), flat=g.convex_clockwise(arr(flat)), back=g.convex_clockwise(arr([[0, 0], [0, 3], [5, 3], [5, 0]])),
        dent=g.convex_clockwise(arr([[0, 0], [4, 0], [1, 1], [0, 4]])),
    )
    assert r.box == [[1, 2], [4, 2], [4, 6], [1, 6]] and r.corners == [[0, 0], [2, 0], [2, 1], [0, 1]]
    assert r.inverted is None and r.empty is None and r.five is None and r.flat is None and r.dent is None
    assert r.back == [[0, 0], [5, 0], [5, 3], [0, 3]]


def test_crops_have_whole_pixels(spark):
    r = one(spark, c=g.text_crops(arr([[10.3, 10.2, 30.7, 19.9], [31.2, 12.5, 44.4, 15.1]]), F.lit(200), F.lit(100), 12, 8, 0.05, 9))
    # 20.4 x 9.7 with context: 22.44 and 10.67 go up to 23 x 11, its corner at floor(9.0), floor(9.55); it touches the second box and grows to 45
    # the second goes up to 15 x 8, its corner at floor(30.3), floor(9.8), touches the first box and grows to 10 and 20
    assert [list(c) for c in r.c] == [[9, 9, 45, 20], [10, 9, 45, 20]]


def test_trust_and_sharpness(spark):
    line = "struct<polygon:array<array<double>>,valid:boolean,aligned:boolean,teacher_correct:boolean>"
    box = lambda x0, x1: [[x0, 0.0], [x1, 0.0], [x1, 2.0], [x0, 2.0]]
    lines = [(box(0.0, 2.0), True, True, False), (box(2.0, 4.0), True, True, True), (box(3.0, 5.0), True, False, False), (box(4.0, 6.0), True, True, None)]
    rows = spark.createDataFrame([(lines, [0.0] * 4 + [9.0] + [0.0] * 4, 3)], f"l array<{line}>, v array<double>, w int")
    r = rows.select(g.trust_map(F.col("l"), 6, 2, 0.25).alias("t"), g.sharpness("v", "w").alias("s")).first()
    assert list(r.t) == [0.25, 0.25, 1, 1, 1, 1] * 2
    # mirrored edges: the four side pixels see the peak twice, the corners not at all
    assert np.isclose(r.s.variance, np.var([0, 18, 0, 18, -36, 18, 0, 18, 0])) and np.isclose(r.s.deviation, np.std([0] * 8 + [9]))


def test_quads_tiles_masks(spark):
    r = one(spark, q=g.convex_clockwise(arr([[0, 0], [0, 2], [2, 2], [2, 0]])), x=g.convex_clockwise(arr([[0, 0], [2, 2], [2, 0], [0, 2]])), t=g.tile_starts(F.lit(100), 40, 10), u=g.tile_starts(F.lit(30), 40, 10), m=g.polygon_mask(arr([[1, 1], [3, 1], [3, 2], [1, 2]]), 4, 3), o=g.far_outside(arr([[-1.5, 0], [5, 5]]), F.lit(10), F.lit(10)), b=g.pixel_box(arr([[0.5, 0.5], [3.2, 2]]), F.lit(3), F.lit(3)))
    assert r.q == [[0, 0], [2, 0], [2, 2], [0, 2]] and r.x is None
    assert (list(r.t), list(r.u), r.o, r.b) == ([0, 30, 60], [0], False, [0, 0, 3, 2])
    assert sum(r.m) == 2 and r.m[5] and r.m[6]


def test_clipping_and_visibility(spark):
    r = one(spark, c=g.visible_fraction(g.box_polygon(arr([0, 0, 64, 64])), arr([0, 0, 32, 32])), d=g.visible_fraction(g.box_polygon(arr([0, 0, 4, 4])), arr([9, 9, 12, 12])), h=g.homography(g.box_polygon(arr([1, 2, 5, 4])), F.lit(4), F.lit(2)))
    assert r.c == 0.25 and r.d == 0 and np.allclose(r.h, [[1, 0, 1], [0, 1, 2], [0, 0, 1]])


def test_crops_grow_to_a_fixpoint(spark):
    boxes = [[30, 30, 60, 40], [55, 32, 85, 44], [80, 34, 110, 46]]
    crops = one(spark, c=g.text_crops(arr(boxes), F.lit(300), F.lit(100), 40, 20, 0.0, 5)).c
    assert all(all(not (b[0] < c[2] and c[0] < b[2] and b[1] < c[3] and c[1] < b[3]) or (c[0] <= b[0] and c[1] <= b[1] and c[2] >= b[2] and c[3] >= b[3]) for b in boxes) for c in crops)
    assert all(crops[0][0] <= b[0] and crops[0][2] >= b[2] for b in boxes)
    assert len(one(spark, c=g.text_crops(arr([[k * 50, 0, k * 50 + 5, 5] for k in range(5)]), F.lit(300), F.lit(100), 10, 10, 0.1, 2)).c) == 2


@pytest.mark.parametrize("least", [0.05, 0.3, 0.9])
def test_greedy_matching(spark, least):
    rng = np.random.default_rng(4)
    make = lambda n: [[*p, *(p + s)] for p, s in zip(rng.integers(0, 30, (n, 2)).astype(float), rng.integers(5, 20, (n, 2)), strict=True)]
    rows = [([[float(v) for v in x] for x in make(n)], [[float(v) for v in x] for x in make(m)]) for n, m in ((4, 4), (6, 2), (0, 3), (3, 0), (8, 8))]

    def plain(a, b):
        free, out = set(range(len(b))), []
        for x in a:
            best = max(((0.0 if not b else _iou(x, b[k]), -k) for k in free), default=(-1, 0))
            k = -best[1] if best[0] >= least else -1
            free.discard(k)
            out.append(k)
        return out

    def _iou(x, y):
        i = max(min(x[2], y[2]) - max(x[0], y[0]), 0) * max(min(x[3], y[3]) - max(x[1], y[1]), 0)
        u = (x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - i
        return i / u if u else 0.0

    got = spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>").select("a", "b", match.greedy_match(F.col("a"), F.col("b"), least).alias("m"), match.greedy_match_long(F.col("a"), F.col("b"), least).alias("n")).collect()
    for r in got:
        assert list(r.m) == list(r.n) == plain(r.a, r.b)


# -- decisions ----------------------------------------------------------------------------------------------------------

RULES = [gates.Rule("clarity", 0.7), gates.Rule("artifacts", 0.2, "lower")]


def decision(spark, predictions, reference="matched", glyph="verified", scores=(0.8, 0.1), **more):
    rows = spark.createDataFrame([(predictions, reference, glyph, *scores)], "p array<struct<text:string,confidence:double>>, r string, g string, clarity double, artifacts double")
    found = gates.assess(F.col("p"), F.col("r"), F.col("g"), {k: F.col(k) for k in ("clarity", "artifacts")}, RULES, least_confidence=0.9, **more)
    return rows.select(found.alias("d")).first().d


def test_decisions(spark):
    good = [("ABC", 0.95)]
    assert decision(spark, good).status == "accepted"
    assert decision(spark, good, audit=True).asDict(True) | {} == decision(spark, good, audit=True).asDict(True)
    assert (decision(spark, good, audit=True).status, decision(spark, good, audit=True).reasons) == ("review", ["audit_mode_uncalibrated"])
    poor = decision(spark, [("ABC", 0.5)], scores=(0.8, 0.3))
    assert poor.status == "rejected" and poor.reasons == ["low_ocr_confidence", "low_iqa:artifacts"]  # later evidence counts, too
    unseen = decision(spark, [("ABC", 0.5)], glyph=None, scores=(None, None))  # a flow that stops looking passes nulls
    assert unseen.reasons == ["low_ocr_confidence", "glyph_unverifiable", "missing_iqa:clarity", "missing_iqa:artifacts"]
    assert decision(spark, good, scores=(0.8, 0.3)).reasons == ["low_iqa:artifacts"]
    assert decision(spark, []).reasons[0] == "no_text"
    missing = decision(spark, good, scores=(0.8, None))
    assert (missing.status, missing.reasons, missing.labels) == ("review", ["missing_iqa:artifacts"], {"clarity": "pass", "artifacts": "missing"})
    assert decision(spark, good, reference="conflict").reasons == ["text_reference_conflict"]
    assert decision(spark, good, reference="other").reasons == ["text_reference_unverifiable"]
    assert decision(spark, good, glyph="odd").error == "unknown_glyph_status"
    assert decision(spark, good, scores=(math.inf, 0.1)).error == "score_not_finite:clarity"
    assert decision(spark, good, glyph_evidence=F.lit(" ")).error == "verified_glyph_without_evidence"
    assert decision(spark, good, demo=True).reasons == ["demo_backend"]
    assert one(spark, a=gates.same_text(F.lit("ABC"), F.lit("abc")), b=gates.reference_status(F.lit(1), F.lit(1), F.lit(0), F.lit(2)), c=gates.reference_status(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == Row(a=False, b="conflict", c="unverifiable")
    with pytest.raises(ValueError):
        gates.Rule("x", 1, "up")


def test_curation_flow(spark):
    records = spark.createDataFrame([("1", "a", "same", 1, 1.0, None), ("2", "b", "same", 2, 1.0, None), ("3", "a", "other", 3, None, None), ("4", "a", "same", 0, 1.0, "broken"), ("5", "b", "bad", 5, 0.0, None)], "id string, source string, content string, line_no long, clarity double, error string")
    got = {r.id: r for r in curation.curate(records, curation.Curation(rules=(RULES[0],))).collect()}
    assert [(k, got[k].state, got[k].status, got[k].reasons) for k in "12345"] == [("1", "complete", "accepted", []), ("2", "duplicate", "rejected", ["duplicate_image"]), ("3", "complete", "review", ["missing_iqa:clarity"]), ("4", "error", "error", ["broken"]), ("5", "complete", "rejected", ["low_iqa:clarity"])]
    assert got["2"].duplicate_of == got["1"].key and got["1"].split == got["2"].split
    assert set(curation.summary(curation.curate(records, curation.Curation())).keys()) == {"status", "reasons", "states"}


def test_control(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="duplicate k"):
        control.require_unique(rows, "k")
    assert [r.v for r in control.latest(rows, "k", "v").collect()] == ["b"]
    assert sorted(r.v for r in control.upsert(rows, spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string"), "k").collect()) == ["c", "d"]
    assert one(spark, a=control.size_error(F.lit(10), F.lit(10), F.lit(20), F.lit(20)), b=control.size_error(F.lit(10), F.lit(10), F.lit(5), F.lit(5)), c=control.size_error(F.lit(10), F.lit(10), F.lit(20), F.lit(25)), d=control.resolved(F.lit("x/y"), "/m/"), e=control.resolved(F.lit("/x"), "/m")) == Row(a=None, b="smaller_than_input", c="aspect_ratio_changed", d="/m/x/y", e="/x")
    assert control.exit_code(spark.createDataFrame([("error",)], "status string")) == 2
    assert not control.all_done(rows.limit(0), rows, "k") and control.all_done(rows, rows, "k")
    parts = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 1), (2, 0, 9)], "block int, part int, index int")
    assert {r.block for r in control.partition_errors(parts, 8).collect()} == {1, 2}


def test_validation(spark):
    docs = spark.createDataFrame([('{"id": "a", "source": "s", "image_path": "p"}',), ('{"id": 3, "source": "s", "image_path": "p"}',), ("[]",), ("{",), ('{"id": " ", "source": "s", "image_path": "p"}',)], "v string")
    assert [r.e for r in docs.select(validate.manifest_error(F.try_parse_json("v")).alias("e")).collect()] == [None, "missing_id", "not_an_object", "invalid_json", "missing_id"]
    items = spark.createDataFrame([([(None, [1.0, 1.0, 3.0, 3.0], "t", 0.5), (None, [1.0, 1.0, 3.0, 3.0], "t", 1.1), ([[0.0, 0.0], [99.0, 0.0], [9.0, 9.0]], None, "t", None)],)], "i array<struct<polygon:array<array<double>>,bbox:array<double>,text:string,confidence:double>>")
    assert [x.error for x in items.select(validate.regions(F.col("i"), F.lit(10), F.lit(10)).alias("r")).first().r] == [None, "invalid_confidence", "out_of_bounds"]
    native = spark.createDataFrame([([([[0.0, 0.0], [99.0, 0.0], [9.0, 9.0]], None, "x", 0.4, None, None, True), (None, [1.0, 1.0, 3.0, 3.0], "", 0.7, None, None, True), (None, [1.0, 1.0, 3.0, 3.0], "y", 0.7, True, None, True)],)], "a array<struct<polygon:array<array<double>>,bbox:array<double>,text:string,rec_score:double,illegibility:boolean,valid:boolean,trusted:boolean>>")
    r = validate.audited(native, "a", F.lit(10), F.lit(10)).first()
    assert [x.reason for x in r.invalid] == ["out_of_bounds", "illegible"] and [(x.confidence, x.trusted) for x in r.valid] == [(0.7, False)]
    lines = spark.createDataFrame([("i", [("ab", False), ("###", False), ("c", True), (" ", False)])], "image string, lines array<struct<transcription:string,difficult:boolean>>")
    assert [(x["index"], x.ignored) for x in validate.judged_lines(lines, "lines").collect()] == [(0, False), (1, True), (2, True), (3, True)]
    keep, reject = validate.early_rejects(spark.createDataFrame([([1], None), ([], [])], "a array<int>, b array<int>"), "a", "b")
    assert keep.count() == 1 and reject.first().reasons == ["no_text"]
    assert one(spark, a=validate.artifact_error(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)), F.lit("x"), F.lit("y")), b=validate.detail_error(arr([[0, 0], [1, 1], [2, 2], [3, 3]]), F.array(F.lit(4), F.lit(4))), c=validate.detail_error(F.lit(None).cast("array<array<double>>"), F.array(F.lit(0), F.lit(4))), d=validate.over_threshold(F.lit(0.1), 0.1)) == Row(a="digest_mismatch", b="invalid_quad", c="invalid_size", d=False)
    runs = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "model string, score int")
    assert [r.setting for r in validate.differing_settings(runs, ["model", "score"]).collect()] == ["model"]
    assert validate.first_present(runs.select(F.lit(None).cast("string").alias("x"), "model"), ["x", "model"], "y").count() == 3


# -- metrics ------------------------------------------------------------------------------------------------------------


def test_text_scores(spark):
    r = metrics.text_scores(spark.createDataFrame([("abc", "ab")], "t string, l string"), "t", "l").first()
    assert (r.cer, round(r.one_minus_ned, 9)) == (0.5, round(2 / 3, 9))
    rows = spark.createDataFrame([("ab", "ab", 12.0), ("abcd", "abcx", 20.0), ("ab", "ab", 28.0), ("", "ab", 40.0)], "t string, l string, s double")
    got = {r.bucket: (r.n, r.accuracy, r.cer) for r in metrics.bucket_scores(rows, "t", "l", "s", [16, 32, 64]).collect()}
    assert got == {"0-16": (1, 1, 0), "16-32": (2, 0.5, 1 / 6), "32-64": (1, 0, 1)}
    assert one(spark, m=metrics.text_measures(F.lit(None).cast("string"), F.lit("ABCD"))["edits"], n=metrics.text_measures(F.lit("ABXD"), F.lit("ABCD"))["edits"]) == Row(m=4, n=1)


def details(spark, rows):
    return spark.createDataFrame([(s, i, lab, lab, float(h), None, None, (t, t, 0.9, None)) for s, i, lab, h, t in rows], "stem string, index int, label string, norm_label string, size double, quad array<array<double>>, sr_size array<int>, pred struct<text:string,norm_text:string,score:double,edit_distance:int>")


def test_paired_evaluation(spark):
    """Four lines of two images. By hand: labels have 3, 6, 2 and 9 characters, 20 in all; the student errs by 2 in the second and by 9 in the last."""
    truth = [("p", 0, "one", 15), ("p", 1, "twelve", 40), ("q", 0, "go", 41), ("q", 5, "thirtyone", 90)]
    teacher = details(spark, [(*r, t) for r, t in zip(truth, ["one", "twelve", "no", "thirtyone"], strict=True)])
    student = details(spark, [(*r, t) for r, t in zip(truth, ["one", "twe1v3", "go", ""], strict=True)])
    out = {r.bin: r for r in evaluation.evaluate([student], [teacher], [16, 40, 50], samples=300, seed=3).collect()}
    assert [out[b].instances for b in ("0-16", "16-40", "40-50", "50+", "all", "<64")] == [1, 0, 2, 1, 4, 3]
    assert np.isclose(out["all"].student_cer, 11 / 20) and np.isclose(out["all"].teacher_cer, 1 / 20) and np.isclose(out["all"].cer_delta, 0.5)
    assert out["all"].teacher_accuracy == 0.75 and out["all"].student_accuracy == 0.5 and np.isclose(out["all"].retention, 1 / 3)
    assert np.isclose(out["<64"].student_cer, 2 / 11) and np.isclose(out["all"].student_one_minus_ned, 1 - (2 / 6 + 1) / 4)
    assert out["16-40"].student_cer is None and out["16-40"].status == "empty_bin"
    assert out["0-16"].status == "insufficient_images:1<2" and out["all"].status == "paired_image_percentile"
    with pytest.raises(Exception, match="not all runs"):
        align.aligned([student], [teacher.where("stem = 'p'")], ["stem", "index"]).collect()
    assert align.aligned([student], [teacher.where("stem = 'p'")], ["stem", "index"], True).count() == 2
    assert [(r.run, r.excluded) for r in align.exclusions([student, teacher.where("stem = 'p'")], ["stem", "index"]).collect()] == [(0, 2), (1, 0)]
    with pytest.raises(Exception, match="runs differ in size"):
        align.aligned([student], [teacher.withColumn("size", F.col("size") + 1)], ["stem", "index"]).collect()
    with pytest.raises(Exception, match="duplicate stem, index"):
        align.aligned([student.union(student)], [teacher], ["stem", "index"]).collect()
    with pytest.raises(ValueError, match="one teacher"):
        align.aligned([student], [teacher] * 2, ["stem", "index"])
    missing = details(spark, [(*r, t) for r, t in zip(truth, ["one", None, "go", "thirtyone"], strict=True)])
    out = {r.bin: r for r in evaluation.evaluate([missing], [teacher], [40], samples=0).collect()}
    assert out["all"].student_one_minus_ned is None and out["all"].student_cer is not None and out["all"].status == "disabled"


def test_intervals_of_all_metrics(spark):
    rows = [("all" if k % 3 else "some", f"image{k % 12}", 10, k % 4, (k * 7) % 5, int(k % 4 == 0), int(k * 7 % 5 == 0), int(k % 4 == 0 and k * 7 % 5 == 0), k % 4 / 10, None if k == 5 else k * 7 % 5 / 10) for k in range(60)]
    schema = "bin string, stem string, label_length int, teacher_edits int, student_edits int, teacher_correct int, student_correct int, joint_correct int, teacher_distance double, student_distance double"
    frame = spark.createDataFrame(rows, schema)
    got = {(r.bin, r.metric): r for r in metrics.bootstrap_metrics(frame, "bin", "stem", samples=200, seed=5).collect()}
    assert {m for _, m in got} == set(metrics.METRICS) and {b for b, _ in got} == {"all", "some"}
    plain = {r.bin: r for r in metrics.paired_metrics(metrics.paired_totals(frame, "bin")).collect()}
    for (b, m), r in got.items():
        assert r.estimate == plain[b][m] or np.isclose(r.estimate, plain[b][m])
        assert r.estimate is None or (r.valid_samples > 100 and r.low <= r.high)
    lost = got["all", "student_one_minus_ned"]  # one distance is missing there
    assert (lost.estimate, lost.low, lost.valid_samples) == (None, None, 0)
    few = metrics.bootstrap_metrics(frame, "bin", "stem", samples=200, least=99).first()
    assert few.low is None and few.status.startswith("insufficient_images:")


def test_percentiles_of_any_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 30, 401)] + [(None, float(x)) for x in rng.normal(size=57)] + [("one", 4.0), ("none", None)]
    got = {r.g: list(r.percentiles) for r in metrics.percentiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", [0.0, 0.025, 0.5, 0.975, 1.0], "g").collect()}
    assert set(got) == {"a", None, "one"}
    for g_, values in got.items():
        assert np.allclose(values, np.quantile([x for k, x in rows if k == g_], [0.0, 0.025, 0.5, 0.975, 1.0]))


def test_bootstrap_counts_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [("g", f"c{k}", float(x), 1.0) for k in range(40) for x in rng.normal(2, 1, 5)]
    frame = spark.createDataFrame(rows, "g string, c string, x double, y double")
    a = metrics.bootstrap(frame, "g", "c", "x", "y", samples=400, seed=1).first()
    b = metrics.bootstrap(frame.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(9)))).repartition(7), "g", "c", "x", "y", samples=400, seed=1).first()
    assert np.allclose([a.low, a.high, a.estimate], [b.low, b.high, b.estimate])
    assert a.low < a.estimate < a.high and 0.1 < a.high - a.low < 0.6


def test_joins(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int"), spark.createDataFrame([("a", 1), ("c", 3)], "k string, y int")
    with pytest.raises(ValueError, match="prediction without a match"):
        align.matched(left, right, "k", "prediction")
    rows, sides = align.loosely_matched(left, right, "k")
    assert rows.count() == 2 and tuple(sides.first()) == (1, 1)
    with pytest.raises(ValueError, match="outside"):
        align.check_membership(left, right, right.limit(0), "k")
    with pytest.raises(ValueError, match="excluded"):
        align.check_membership(left.where("k = 'a'"), right, right, "k")
    e = spark.createDataFrame([("i", 0, "t", [[0.0, 0.0], [1.0, 1.0]]), ("i", 1, "u", [[0.0, 0.0], [1.0, 1.0]])], "stem string, index int, norm_label string, quad array<array<double>>")
    a = spark.createDataFrame([("i", 0, "t", [[0.005, 0.0], [1.0, 1.0]]), ("i", 1, "u", [[0.5, 0.0], [1.0, 1.0]])], "stem string, index int, norm_label string, quad array<array<double>>")
    assert align.evidence_matched(e, a, ["stem", "index"]).count() == 1


def test_aggregates(spark):
    jobs = spark.createDataFrame([("1", "complete", [("a",), ("b",)]), ("2", "error", [("a",)]), ("3", "complete", [])], "key string, state string, records array<struct<source:string>>")
    assert {(r.source, r.state, r.n) for r in aggregates.job_states(jobs).collect()} == {("a", "complete", 1), ("a", "error", 1)}
    r = one(spark, a=aggregates.region_text(F.array(F.struct(F.lit("x").alias("text"), F.lit(0.5).alias("confidence")), F.struct(F.lit("y").alias("text"), F.lit(0.3).alias("confidence")))), b=aggregates.largest_variant(F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(n).alias("n")) for s, n in ((2.0, 0), (4.0, 1), (4.0, 2))])))
    assert (r.a.text, r.a.confidence, r.b.n) == ("x y", 0.3, 1)
    assert tuple(aggregates.import_counters(spark.createDataFrame([([1], [], [2, 3])], "l array<int>, s array<int>, i array<int>"), "l", "s", "i").first()) == (1, 1, 0, 2)


# -- sampling -----------------------------------------------------------------------------------------------------------


def test_sampling(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"))
    a, b = (sorted(r.k for r in sampling.sample_per_group(x, "g", "k", 100, 5).collect()) for x in (rows, rows.repartition(9)))
    assert a == b and len(a) == 100 and [sum(k % 3 == m for k in a) for m in range(3)] == [34, 33, 33]
    with pytest.raises(ValueError, match="share"):
        sampling.sample_per_group(rows, "g", "k", 5000, 5)
    assert len(sampling.sample_rows(rows, "k", 10, 1).collect()) == 10
    assert sampling.round_robin(rows.where("g <> '0' OR k < 3"), ["g"], "k", 7, 1).groupBy("g").count().count() == 3
    with pytest.raises(Exception, match="invalid repeat"):
        sampling.repeated(spark.createDataFrame([(-1,)], "n int"), "n").collect()
    assert sampling.repeated(spark.createDataFrame([(2,), (1,), (0,)], "n int"), "n").count() == 3


def test_draws(spark):
    draws = spark.range(4000).withColumnRenamed("id", "draw")
    sources = spark.createDataFrame([("a", 1.0, 10), ("b", 9.0, 5), ("c", 0.0, 9), ("d", 5.0, 0)], "source string, weight double, items long")
    got = sampling.weighted_mixture(sources, draws, 3, 1).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("lo"), F.max("item").alias("hi")).collect()
    share = {r.source: r.n / 4000 for r in got}
    assert set(share) == {"a", "b"} and 0.87 < share["b"] < 0.93 and {(r.lo, r.hi) for r in got} == {(0, 9), (0, 4)}
    with pytest.raises(ValueError):
        sampling.weighted_mixture(sources.where("source = 'c'"), draws, 3, 1)
    lines = spark.createDataFrame([(k, 0 if k == 0 else 1) for k in range(10)], "no int, image int")
    picked = sampling.line_balanced(lines, spark.range(2), draws, 7, 1.0).join(lines, "no")
    assert 0.84 < picked.where("image = 1").count() / 4000 < 0.96
    heights = spark.createDataFrame([(float(h),) for h in [10] * 90 + [40] * 10], "h double")
    tall = sampling.bucket_weighted(heights, "h", [16.0, 32.0], [1.0, 5.0, 1.0], draws, 2).where("source = 2").count() / 4000
    assert 0.45 < tall < 0.55
    with pytest.raises(ValueError):
        sampling.bucket_weighted(heights, "h", [16.0], [1.0], draws, 2)
    lists, items = spark.createDataFrame([("x", 2), ("y", 1), ("z", 0)], "path string, repeat int"), spark.createDataFrame([("x", "1"), ("y", "2")], "path string, name string")
    assert assembly.repeated_dataset(lists, items).count() == 3


# -- numbers ------------------------------------------------------------------------------------------------------------


def test_numeric(spark):
    tokens = spark.createDataFrame([("i", s) for s in ("small", "other", "back", "back")] + [("n", "back")] * 2 + [("u", "none")], "image string, s string")
    got = numeric.stratified_weights(tokens, "image", "s", {"small": 0.5, "other": 0.3, "back": 0.2}).collect()
    assert sorted((r.image, round(r.weight, 6)) for r in got) == [("i", 0.4), ("i", 0.4), ("i", 1.2), ("i", 2.0), ("n", 1.0), ("n", 1.0), ("u", 1.0)]
    r = one(spark, c=numeric.cosine(arr([1, 0]), arr([1, 1])), n=numeric.cosine(arr([0, 0]), arr([1, 1])), p=numeric.psnr(F.lit(0.04)), e=numeric.smoothed(arr([1, 2, 3]), 0.5), k=numeric.divergence(arr([0.5, 0.5]), arr([0.25, 0.75])), s=numeric.linear_schedule(F.lit(5), 0.0, 1.0, 10))
    assert round(r.c, 9) == round(0.5**0.5, 9) and r.n is None and round(r.p, 6) == 20 and r.e == 2.25 and round(r.k, 6) == round(0.5 * math.log(2) + 0.5 * math.log(2 / 3), 6) and r.s == 0.5
    tiles = spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 3.0), (1, 5.0, 0.0)], "x int, v double, w double")
    assert {r.x: r.v for r in numeric.blended(tiles, ["x"], "v", "w").collect()} == {0: 2.5, 1: None}
    options = spark.createDataFrame([(k, float(c), float(10 - c * (k + 1))) for k in range(4) for c in (1, 2, 3)], "item int, cost double, loss double")
    price, chosen = numeric.price_for_budget(options, "item", "cost", "loss", 8.0, rounds=12)
    assert price > 0 and chosen.agg(F.sum("cost")).first()[0] <= 8
    with pytest.raises(ValueError):
        numeric.price_for_budget(options, "item", "cost", "loss", 1.0, rounds=2)
    terms = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 1.0), ("b", 8.0, 3.0)], "l string, v double, w double")
    assert numeric.line_balanced_mean(terms, "l", "v", "w").first().mean == 6.5
    groups = spark.createDataFrame([(0, 5.0, 1.0), (1, 4.0, 9.0), (2, 3.0, 5.0), (3, 1.0, 10.0)], "i int, a double, b double")
    assert {r.i: r.protected for r in numeric.protected_top(groups, 3, 1, "a", "b", "i").collect()} == {0: False, 1: True, 2: False}
    pixels = spark.createDataFrame([("i", 0, 0, 1.0), ("i", 1, 0, 3.0), ("i", 2, 0, 9.0)], "image string, x int, y int, v double")
    assert sorted(r.v for r in numeric.pooled(pixels, "image", 2, "v").collect()) == [2.0, 9.0]


# -- files --------------------------------------------------------------------------------------------------------------


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('\n{"id": "a", "source": "s", "image_path": "p", "annotations": [{"bbox": [0, 0, 1, 1], "text": "x"}]}\n[]\n\nnot json\n{"id": "b", "source": "s"}\n')
    rows = readers.manifest(spark, str(tmp_path / "m.jsonl")).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.source, r.error) for r in rows] == [(2, "a", "s", None), (3, "invalid_line_3", "unknown", "not_an_object"), (5, "invalid_line_5", "unknown", "invalid_json"), (6, "invalid_line_6", "unknown", "missing_image_path")]
    assert rows[0].record.annotations[0].text == "x"


def test_listings_and_lists(spark, tmp_path):
    for name in ("a.png", "d/b.02.JPG", "d/c.txt"):
        (tmp_path / "i" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "i" / name).write_bytes(b"x")
    found = readers.images(spark, str(tmp_path / "i"))
    assert sorted(r.stem for r in found.collect()) == ["a", "b.02"] and readers.images(spark, str(tmp_path / "i"), False).count() == 1
    assert sorted(r.r for r in found.select(readers.relative_id(F.col("path"), str(tmp_path / "i")).alias("r")).collect()) == ["a.png", "d/b.02.JPG"]
    with pytest.raises(ValueError, match="no high"):
        readers.mirrored(found, found.where("stem = 'a'"), "stem")
    (tmp_path / "l.txt").write_text("# c\nx/y.txt, 2\n\nz.txt\nw.txt, 0  # off\n")
    assert sorted((r.path, r.repeat) for r in readers.repeat_list(spark, str(tmp_path / "l.txt")).collect()) == [("w.txt", 0), ("x/y.txt", 2), ("z.txt", 1)]
    (tmp_path / "bad.txt").write_text("x, many\n")
    with pytest.raises(ValueError, match="invalid repeat"):
        readers.repeat_list(spark, str(tmp_path / "bad.txt"))
    assert readers.repeat_list(spark, str(tmp_path / "bad.txt"), False).first().repeat == 1
    (tmp_path / "n.txt").write_text("# c\na.png\tx\nb.02.png\n")
    assert sorted(r.stem for r in readers.name_list(spark, str(tmp_path / "n.txt")).collect()) == ["a", "b.02"]
    (tmp_path / "e.txt").write_text("# none\n")
    with pytest.raises(ValueError, match="no names"):
        readers.name_list(spark, str(tmp_path / "e.txt"))


def test_annotation_files(spark, tmp_path):
    quad = [[0, 0], [9, 0], [9, 5], [0, 5]]
    (tmp_path / "Label.txt").write_text("﻿a.png\t" + json.dumps([{"transcription": "x", "points": quad}]) + "\n", encoding="utf-8")
    r = readers.label_file(spark, str(tmp_path / "Label.txt")).first()
    assert (r.name, r.annotations[0].transcription) == ("a.png", "x")
    (tmp_path / "bad.txt").write_text("a.png\t" + json.dumps([{"transcription": "x", "points": quad[:3]}]) + "\n")
    with pytest.raises(ValueError, match="invalid annotations"):
        readers.label_file(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "boxes.json").write_text(json.dumps({"a.png": [[0, 0, 5, 5], {"bbox": [1, 1, 2, 2], "text": "t", "difficult": True}], "b.png": {"alignment_valid": False, "lines": [quad]}}))
    rows = {(r.stem, r["index"]): r for r in readers.boxes(spark, str(tmp_path / "boxes.json")).withColumn("rec", validate.line_record(F.col("line"), F.col("aligned"))).collect()}
    assert rows["a", 0].rec.quad == [[0, 0], [5, 0], [5, 5], [0, 5]] and rows["a", 0].rec.valid and not rows["a", 1].rec.valid and not rows["b", 0].rec.aligned and rows["b", 0].rec.quad[2] == [9, 5]
    (tmp_path / "legacy.txt").write_bytes("0,0,9,0,9,5,0,5,汉,字\n1,2,x\n".encode("gbk"))
    a, b = readers.legacy_annotations(spark, str(tmp_path / "legacy.txt")).orderBy("line_no").collect()
    assert (a.text, a.quad[2], a.malformed, b.malformed) == ("汉,字", [9.0, 5.0], False, True)
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "o.tsv").write_text(head + "5\t1\t1\t1\t1\t2\t20\t5\t10\t8\t60\tb\n5\t1\t1\t1\t1\t1\t5\t4\t10\t8\t90\ta\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t3\t5\t4\t10\t8\t-1\tc\n")
    line = aggregates.joined_words(readers.ocr_words(spark, str(tmp_path / "o.tsv")), ["page_num", "block_num", "par_num", "line_num"], "word_num").first()
    assert (line.text, line.bbox, line.confidence) == ("a b", [5.0, 4.0, 30.0, 13.0], 0.6)
    glyphs = spark.createDataFrame([(["ab", "c"], [0.9, 0.2], [quad, quad], [["a", "bc"], ["c"]], [[quad, quad], [quad]])], "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<int>>>, text_word array<array<string>>, text_word_region array<array<array<array<int>>>>")
    got = readers.adapted_glyphs(glyphs, 0.5).collect()
    assert len(got) == 1 and [x.character for x in got[0].glyphs] == ["a"] and got[0].skipped == 1


def test_details_file(spark, tmp_path):
    row = {"image": "x/a_sr.png", "index": 0, "label": "q", "norm_label": "q", "size": 9.0, "pred": {"text": "q", "norm_text": "q"}}
    (tmp_path / "d.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"index": 1}) + "\n")
    assert {r.stem for r in readers.details(spark, str(tmp_path / "d.jsonl"), ("_sr",)).collect()} == {"a"}
    (tmp_path / "e.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"image": "y/a_sr.png", "index": 1}) + "\n")
    with pytest.raises(ValueError, match="ambiguous"):
        readers.details(spark, str(tmp_path / "e.jsonl"))
    (tmp_path / "f.jsonl").write_text(json.dumps(row | {"size": -1}) + "\n")
    with pytest.raises(ValueError, match="invalid detail"):
        readers.details(spark, str(tmp_path / "f.jsonl"))


def test_shards(spark, tmp_path):
    import io
    import tarfile

    spark.range(100, numPartitions=4).write.parquet(str(tmp_path / "p"))
    rows = readers.indexed_shards(spark, str(tmp_path / "p"))
    assert sorted(r.row_no for r in rows.collect()) == list(range(100))
    assert readers.sampled_shards(spark, str(tmp_path / "p"), 6, 1).count() == 6
    (tmp_path / "j.json").write_text(json.dumps({"data_root": "r", "data_list": [{"img_name": "a"}, {"img_name": "b"}]}))
    assert [(r.row_index, r.img_name) for r in readers.json_items(spark, str(tmp_path / "j.json"), "struct<img_name:string>").collect()] == [(0, "a"), (1, "b")]
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name in ("x/1.jpg", "x/1.json"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "t.tar").write_bytes(b"broken")
    found = readers.tar_samples(spark, str(tmp_path / "*.tar")).collect()
    assert sorted((r.key, r.extension, bytes(r.content)) for r in found if r.error is None) == [("x/1", "jpg", b"abc"), ("x/1", "json", b"abc")]
    assert [r.shard[-5:] for r in found if r.error] == ["t.tar"]
    bad = spark.createDataFrame([("r", "v", "s")], "repo string, revision string, subset string")
    with pytest.raises(ValueError, match="known bad"):
        readers.refuse(bad, bad)


def test_unknown_prototypes_are_unsupported(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0])], "k int, label string, embedding array<double>")
    p = spark.createDataFrame([("a", [1.0, 1.0]), ("a", [2.0, 0.0])], "label string, prototype array<double>")
    assert {r.k: (r.distance, r.supported) for r in numeric.nearest_prototype(v, p, "k", "label").collect()} == {1: (0.0, True), 2: (None, False)}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "accepted", "train", "/h1", [("v0", 2.0), ("v1", 4.0)]), ("k2", "error", "train", None, []), ("k3", "review", "validation", "/h3", [])], "key string, status string, split string, hr_path string, variants array<struct<path:string,scale:double>>")
    writers.by_status(rows, str(tmp_path / "out"), "key")
    assert sorted(p.name for p in (tmp_path / "out").glob("folder=*")) == ["folder=accepted", "folder=errors", "folder=review"]
    with pytest.raises(Exception, match="(?i)exists"):
        writers.by_status(rows, str(tmp_path / "out"), "key")
    writers.write_pairs(rows, str(tmp_path / "pairs"))
    assert [(r.variant_no, r.path) for r in spark.read.json(str(tmp_path / "pairs")).orderBy("variant_no").collect()] == [(0, "v0"), (1, "v1")]
    writers.path_list(rows, "hr_path", str(tmp_path / "list"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "list")).collect()) == ["/h1", "/h3"]
    writers.report_csv(rows, ["key", "status"], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["key", "status"]
    for step in (1, 2):
        writers.append_metrics(spark.createDataFrame([(step, 0.5, "note")], "step long, loss double, note string"), str(tmp_path / "metrics"))
    assert sorted(spark.read.json(str(tmp_path / "metrics")).columns) == ["loss", "step"] and spark.read.json(str(tmp_path / "metrics")).count() == 2
    writers.replace_table(rows, str(tmp_path / "t"), 3)
    writers.detail_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    points = spark.createDataFrame([("c/step_10.pt", True), ("c/step_9.pt", True), ("c/step_20.pt", False)], "path string, complete boolean")
    assert writers.newest_valid(points).first().step == 10
    packed = writers.packed_shards(spark.createDataFrame([("m", k, s) for k, s in enumerate([4, 4, 4, 20, 1])], "list string, k int, s long"), "s", "k", 10)
    assert [r.shard for r in packed.orderBy("k").collect()] == [0, 0, 1, 2, 3]


def test_config(tmp_path):
    assert config.merged({"a": 1, "b": {"c": 2}, "o": {}}, {"b": {"c": 3}, "o": {"x": 1}}, ("o",)) == {"a": 1, "b": {"c": 3}, "o": {"x": 1}}
    with pytest.raises(ValueError, match="b.d"):
        config.merged({"a": 1, "b": {"c": 2}}, {"b": {"d": 3}})
    for bad in (True, float("nan"), 2, "1"):
        with pytest.raises(ValueError):
            config.number(bad, "x", 0, 1)
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}}')
    (tmp_path / "top.json").write_text('{"_base_": "base.json", "a": {"y": 3}}')
    assert config.inherited(tmp_path / "top.json") == {"a": {"x": 1, "y": 3}}
    (tmp_path / "loop.json").write_text('{"_base_": "loop.json"}')
    with pytest.raises(ValueError, match="own base"):
        config.inherited(tmp_path / "loop.json")
    assert config.preferred({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    assert config.same_but({"a": 1, "log": 1}, {"a": 1, "log": 2}, {"log"})
    config.check_run(tmp_path / "run", {"a": 1}, "x")
    config.check_run(tmp_path / "run", {"a": 1}, "x")
    with pytest.raises(ValueError, match="another configuration"):
        config.check_run(tmp_path / "run", {"a": 2}, "x")
    with config.single_writer(tmp_path), pytest.raises(RuntimeError), config.single_writer(tmp_path):
        pass
    assert [config.new_folder(tmp_path, "r").name for _ in range(3)] == ["r", "r-1", "r-2"]


def test_incremental_curation(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        incremental.curate_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()

    run("a.json", [{"id": "1", "source": "s", "content": "x", "line_no": 1}, {"id": "2", "source": "s", "content": "x", "line_no": 2}, {"id": "3", "source": "s", "content": "y", "line_no": 3}])
    run("b.json", [{"id": "4", "source": "s", "content": "y", "line_no": 1}, {"id": "5", "source": "s", "content": "z", "line_no": 2}])
    assert sorted((r.id, r.state) for r in spark.read.parquet(str(tmp_path / "state")).collect()) == [("1", "complete"), ("2", "duplicate"), ("3", "complete"), ("4", "duplicate"), ("5", "complete")]


def test_event_windows(spark, small):
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(small)
    q = incremental.metric_windows(events).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name, n in (("a", 5000), ("b", 1), ("c", 777)):
        (tmp_path / "t" / name).write_text("".join(f"{name}{k}\n" if k % 7 else "\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "t")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5778
    assert all(r.value == (f"{r.path[-1]}{r.line_no}" if r.line_no % 7 else "") for r in rows)
