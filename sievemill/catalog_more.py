"""More queries over the test tables: formats that are written and read back, validation, joins, geometry, sampling and control.

Readers and writers are held to SQL by a round trip: a table's rows are written in the format, read by the operator, and have to
be what SQL finds in the table. Files lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import SEED, query
from .functions import geometry, identity, numeric, text
from .operators import aggregates, align, control, gates, metrics, sampling, validate
from .plans import curation
from .session import scratch, table
from .sources import readers, writers
from .streaming import incremental

_UNIT = "(('0x' || substr(sha256({}), 1, 13))::BIGINT / 4503599627370496.0)"


def _lines(rows, spark, name: str) -> str:
    """Writes the column ``value`` as lines and returns the folder."""
    path = scratch(spark, name)
    rows.select("value").write.text(path)
    return path


def _part(spark, folder):
    return table(spark, folder, "part")


# -- sources ------------------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(error, 'none') AS error, source, count(*) AS n FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'missing_image_path' WHEN 1 THEN 'not_an_object'
WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'confidence_not_a_number' WHEN 4 THEN 'trusted_not_a_boolean' END AS error,
CASE WHEN doc_id % 7 IN (0, 1, 2) THEN 'unknown' ELSE source END AS source FROM documents) GROUP BY ALL""")
def manifest_errors(spark, folder):
    region = lambda **k: F.array(F.struct(F.lit("t").alias("text"), *[F.lit(v).alias(n) for n, v in k.items()]))
    record = lambda *more: F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "source", *more))
    image, kind = F.lit("a.png").alias("image_path"), F.col("doc_id") % 7
    value = F.when(kind == 0, record()).when(kind == 1, "[1]").when(kind == 2, "{bad")
    value = value.when(kind == 3, record(image, region(confidence=True).alias("annotations"))).when(kind == 4, record(image, region(trusted="no").alias("annotations")))
    path = _lines(table(spark, folder, "documents").select(value.otherwise(record(image, region(confidence=0.5).alias("annotations"))).alias("value")), spark, "manifest")
    return readers.manifest(spark, path).groupBy(F.coalesce("error", F.lit("none")).alias("error"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'p.' || p_partkey AS stem, p_brand AS transcription, p_size % 2 = 0 AS difficult, p_size::DOUBLE AS width FROM part""")
def label_file_lines(spark, folder):
    w = F.col("p_size").cast("double")
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(w, F.lit(0.0)), F.array(w, F.lit(9.0)), F.array(F.lit(0.0), F.lit(9.0)))
    lines = F.to_json(F.array(F.struct(F.col("p_brand").alias("transcription"), points.alias("points"), (F.col("p_size") % 2 == 0).alias("difficult"))))
    path = _lines(_part(spark, folder).select(F.concat(F.lit("p."), "p_partkey", F.lit(".png\t"), lines).alias("value")), spark, "label")
    a = F.col("annotations")[0]
    return readers.label_file(spark, path).select("stem", a["transcription"].alias("transcription"), a["difficult"].alias("difficult"), a["points"][1][0].alias("width"))


@query("""SELECT 'i' || o_custkey AS stem, o_orderkey::INTEGER AS index, o_orderpriority AS norm_label, (o_orderkey % 50 + 1)::DOUBLE AS size FROM orders""")
def ocr_detail_rows(spark, folder):
    o = table(spark, folder, "orders")
    image, index = F.concat(F.lit("i"), "o_custkey", F.lit(".jpg")).alias("image"), F.col("o_orderkey").alias("index")
    pred = F.struct(F.col("o_orderpriority").alias("text"), F.col("o_orderpriority").alias("norm_text")).alias("pred")
    rows = o.select(image, index, F.col("o_orderpriority").alias("norm_label"), (F.col("o_orderkey") % 50 + 1).cast("double").alias("size"), pred)
    path = scratch(spark, "details")
    writers.detail_lines(rows, path)
    return readers.details(spark, path).select("stem", "index", "norm_label", "size")


@query("""SELECT 'img' || n_regionkey AS stem, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS index, n_nationkey::DOUBLE AS x1, n_regionkey % 2 = 0 AS aligned FROM nation""")
def boxes_document(spark, folder):
    n = table(spark, folder, "nation")
    box = F.struct(F.col("n_nationkey").alias("k"), F.array(F.lit(0.0), F.lit(0.0), F.col("n_nationkey").cast("double"), F.lit(5.0)).alias("b"))
    per = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(box)), lambda s: s["b"]).alias("lines"))  # 25 nations
    entry = F.to_json(F.struct((F.col("n_regionkey") % 2 == 0).alias("alignment_valid"), "lines"))
    one = per.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"img'), "n_regionkey", F.lit('.png": '), entry)), ", "), F.lit("}")).alias("value"))
    return readers.boxes(spark, _lines(one, spark, "boxes")).select("stem", "index", F.col("line.quad")[2].alias("x1"), "aligned")


@query("""SELECT 'set/' || n_name AS path, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE n_nationkey % 3 END::INTEGER AS repeat FROM nation""")
def repeat_list_entries(spark, folder):
    n = table(spark, folder, "nation")
    value = F.concat(F.lit("set/"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "  # once").otherwise(F.concat(F.lit(", "), F.col("n_nationkey") % 3)))
    return readers.repeat_list(spark, _lines(n.select(value.alias("value")), spark, "lists"))


@query("""SELECT n_name || '.v2' AS stem FROM nation""")
def name_list_stems(spark, folder):
    n = table(spark, folder, "nation").select(F.explode(F.array(F.concat("n_name", F.lit(".v2.png\tmore")), F.lit("# a comment"), F.lit(""))).alias("value"))
    return readers.name_list(spark, _lines(n, spark, "names"))


@query("""SELECT p_size % 5 = 0 AS malformed, CASE WHEN p_size % 5 <> 0 THEN p_name || ',' || p_brand END AS text, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS right_edge, count(*) AS n FROM part GROUP BY ALL""")
def legacy_annotation_lines(spark, folder):
    corners = F.concat(F.lit("0,0,"), "p_size", F.lit(",0,"), "p_size", F.lit(",7,0,7,"))
    value = F.when(F.col("p_size") % 5 == 0, F.lit("1,2,three")).otherwise(F.concat(corners, "p_name", F.lit(","), "p_brand"))
    found = readers.legacy_annotations(spark, _lines(_part(spark, folder).select(value.alias("value")), spark, "legacy"))
    return found.groupBy("malformed", "text", F.col("quad")[1][0].alias("right_edge")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey::INTEGER AS word_num, p_brand AS text, round((p_size - 1) / 100.0, 9)::DOUBLE AS confidence, (p_size + 4)::DOUBLE AS x1 FROM part WHERE p_size % 3 <> 0 AND p_size - 1 >= 0""")
def ocr_table_words(spark, folder):
    names = readers.TSV.split(", ")
    size = F.col("p_size")
    values = {"level": F.when(size % 3 == 0, 4).otherwise(5), "word_num": F.col("p_partkey"), "left": size, "width": F.lit(4), "conf": size - 1, "text": F.concat("p_brand", F.lit(" "))}
    rows = _part(spark, folder).select(*[values.get(x.split()[0], F.lit(1)).alias(x.split()[0]) for x in names])
    path = scratch(spark, "words")
    rows.write.csv(path, sep="\t", header=True, ignoreTrailingWhiteSpace=False)
    return readers.ocr_words(spark, path).select("word_num", "text", F.round("confidence", 9).alias("confidence"), F.col("bbox")[2].alias("x1"))


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_index, n_name AS name, n_regionkey::BIGINT AS region FROM nation""")
def nested_json_items(spark, folder):
    item = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    one = table(spark, folder, "nation").agg(F.to_json(F.struct(F.lit("root").alias("data_root"), F.array_sort(F.collect_list(item)).alias("data_list"))).alias("value"))
    return readers.json_items(spark, _lines(one, spark, "items"), "struct<name:string,region:bigint>").select(F.col("row_index").cast("long").alias("row_index"), "name", "region")


@query("""SELECT count(*) AS n, 0::BIGINT AS least, count(*) - 1 AS most, count(*) AS different, sum(o_orderkey)::BIGINT AS keys FROM orders""")
def shard_rows_numbered(spark, folder):
    path = scratch(spark, "shards")
    table(spark, folder, "orders").select("o_orderkey").repartition(5).write.parquet(path)
    rows = readers.indexed_shards(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("least"), F.max("row_no").alias("most"), F.count_distinct("row_no").alias("different"), F.sum("o_orderkey").cast("long").alias("keys"))


@query("""SELECT source AS repo, lang AS subset, count(*) AS n FROM documents GROUP BY ALL""")
def known_bad_guard(spark, folder):
    asked = table(spark, folder, "documents").groupBy(F.col("source").alias("repo"), F.col("lang").alias("subset")).agg(F.count(F.lit(1)).alias("n")).withColumn("revision", F.lit("main"))
    bad = asked.select("repo", "subset", F.lit("old").alias("revision"))
    return readers.refuse(asked, bad).select("repo", "subset", "n")


@query("""SELECT p_partkey, CASE WHEN i = 0 THEN p_brand ELSE p_type END AS text, i::INTEGER AS index, CASE WHEN i = 0 THEN 2 ELSE 1 END::INTEGER AS glyphs, CASE WHEN i = 0 THEN 1 ELSE 0 END::INTEGER AS skipped
FROM part, (VALUES (0), (1)) t(i) WHERE i = 1 OR p_size >= 25""")
def adapted_glyph_lines(spark, folder):
    poly = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    words = F.array(F.array(F.lit("a"), F.lit("b "), F.lit("cd")), F.array(F.lit("x")))
    boxes = F.transform(words, lambda w: F.transform(w, lambda _: F.array(F.lit(0.0))))
    rows = _part(spark, folder).select("p_partkey", F.array("p_brand", "p_type").alias("rec_texts"), F.array(F.col("p_size") / 50, F.lit(0.9).cast("double")).alias("rec_scores"), F.array(poly, poly).alias("rec_polys"), words.alias("text_word"), boxes.alias("text_word_region"))
    lines = rows.select("p_partkey", F.explode(F.array(F.struct("rec_texts", "rec_scores", "rec_polys", "text_word", "text_word_region"))).alias("r")).select("p_partkey", "r.*")
    found = readers.adapted_glyphs(lines.withColumn("rec_texts", F.transform("rec_texts", lambda t: F.concat(F.col("p_partkey"), F.lit("|"), t))), 0.5)
    key = F.split("text", r"\|")
    return found.select(key[0].cast("long").alias("p_partkey"), key[1].alias("text"), "index", F.size("glyphs").alias("glyphs"), "skipped")


# -- writers ------------------------------------------------------------------------------------------------------------


@query("""SELECT folder, count(*) AS n, min(k) AS least FROM (SELECT p_partkey AS k, ['accepted', 'review', 'rejected', 'errors'][p_size % 4 + 1] AS folder FROM part) GROUP BY folder""")
def status_folders(spark, folder):
    status = F.element_at(F.array(*[F.lit(s) for s in ("accepted", "review", "rejected", "error")]), F.col("p_size") % 4 + 1)
    path = scratch(spark, "status")
    writers.by_status(_part(spark, folder).select(F.col("p_partkey").alias("k"), status.alias("status")), path, "k")
    return spark.read.json(path).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"))


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'validation' END AS split, p_partkey AS key, v::INTEGER AS variant_no, 'hr/' || p_partkey AS hr_path, 'lr/' || p_partkey || '_' || v AS lr_path FROM part, (VALUES (0), (1)) t(v) WHERE p_size > 20""")
def variant_pairs(spark, folder):
    k = F.col("p_partkey")
    variants = F.array(*[F.struct(F.concat(F.lit("lr/"), k, F.lit(f"_{v}")).alias("lr_path")) for v in range(2)])
    rows = _part(spark, folder).select(F.when(F.col("p_size") > 20, "accepted").otherwise("review").alias("status"), F.when(k % 2 == 0, "train").otherwise("validation").alias("split"), k.alias("key"), F.concat(F.lit("hr/"), k).alias("hr_path"), variants.alias("variants"))
    path = scratch(spark, "pairs")
    writers.write_pairs(rows, path)
    return spark.read.schema("key bigint, variant_no int, hr_path string, lr_path string, split string").json(path)


@query("""SELECT 'out/' || p_partkey AS value FROM part WHERE p_size % 3 <> 1""")
def path_lines(spark, folder):
    path = scratch(spark, "paths")
    writers.path_list(_part(spark, folder).select(F.when(F.col("p_size") % 3 != 1, F.concat(F.lit("out/"), "p_partkey")).alias("p")), "p", path)
    return spark.read.text(path)


@query("""SELECT n_nationkey::INTEGER AS key, n_name AS name FROM nation""")
def csv_report(spark, folder):
    path = scratch(spark, "report")
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    writers.report_csv(rows, ["key", "name"], path)
    return spark.read.csv(path, header=True, schema="key int, name string")


@query("""SELECT step, round(sum(loss), 6) AS loss FROM (SELECT p_size::BIGINT AS step, p_retailprice AS loss FROM part UNION ALL SELECT p_size + 100, p_retailprice * 2 FROM part) GROUP BY step""")
def metric_log(spark, folder):
    rows = _part(spark, folder).select(F.col("p_size").cast("long").alias("step"), F.col("p_retailprice").cast("double").alias("loss"), F.col("p_name").alias("note"))
    path = scratch(spark, "log")
    writers.append_metrics(rows, path)
    writers.append_metrics(rows.withColumn("step", F.col("step") + 100).withColumn("loss", F.col("loss") * 2), path)
    return spark.read.json(path).select("step", "loss").groupBy("step").agg(F.round(F.sum("loss"), 6).alias("loss"))


@query("""SELECT 7::BIGINT AS step, count(*) AS n, sum(s_suppkey * 2)::BIGINT AS keys FROM supplier""")
def newest_version(spark, folder):
    rows, path = table(spark, folder, "supplier").select("s_suppkey"), scratch(spark, "versions")
    made = [(writers.replace_table(rows.select((F.col("s_suppkey") * k).alias("s_suppkey")), path, v), True) for k, v in ((1, 3), (2, 7))]
    newest = writers.newest_valid(spark.createDataFrame([*made, (f"{path}/version=00000009", False)], "path string, complete boolean")).first()
    return spark.read.parquet(newest["path"]).agg(F.lit(newest["step"]).alias("step"), F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").cast("long").alias("keys"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def state_upsert(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey")
    return control.upsert(s.where("s_suppkey % 2 = 0").withColumn("state", F.lit("old")), s.where("s_suppkey % 3 = 0").withColumn("state", F.lit("new")), "s_suppkey")


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, -event_id)) IS NOT NULL AS found FROM events GROUP BY user_id""")
def latest_rows(spark, folder):
    return control.latest(table(spark, folder, "events"), "user_id", "ts").select("user_id", "ts", F.col("event_id").isNotNull().alias("found"))


# -- validation ---------------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(CASE WHEN p_size > 40 AND p_size % 10 <> 0 THEN 'out_of_bounds' WHEN p_size % 10 = 0 THEN 'empty_extent' WHEN p_size % 7 = 0 THEN 'invalid_confidence' END, 'none') AS error, count(*) AS n FROM part GROUP BY error""")
def region_faults(spark, folder):
    s = F.col("p_size").cast("double")
    box = F.array(s, F.lit(0.0), F.when(s % 10 == 0, s).otherwise(s + 10), F.lit(5.0))
    item = F.struct(F.lit(None).cast("array<array<double>>").alias("polygon"), box.alias("bbox"), F.lit("t").alias("text"), F.when(s % 7 == 0, 1.5).otherwise(0.5).alias("confidence"))
    found = _part(spark, folder).select(F.explode(validate.regions(F.array(item), F.lit(50), F.lit(10))).alias("r"))
    return found.groupBy(F.coalesce("r.error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(CASE WHEN p_size % 2 = 0 THEN 'marked_invalid' WHEN p_size % 3 = 0 THEN 'illegible' WHEN p_size > 30 THEN 'out_of_bounds' END, 'valid') AS reason, p_size % 5 = 0 AS trusted, count(*) AS n FROM part GROUP BY ALL""")
def audited_annotations(spark, folder):
    s = F.col("p_size")
    box = F.array(F.lit(0.0), F.lit(0.0), s.cast("double"), F.lit(5.0))
    item = F.struct(F.lit(None).cast("array<array<double>>").alias("polygon"), box.alias("bbox"), F.lit("t").alias("text"), F.lit(0.5).alias("rec_score"), (s % 2 != 0).alias("valid"), (s % 3 == 0).alias("illegibility"), (s % 5 == 0).alias("trusted"))
    found = validate.audited(_part(spark, folder).select(F.array(item).alias("items")), "items", F.lit(30), F.lit(10))
    both = found.select(F.explode(F.concat("valid", "invalid")).alias("a"))
    return both.groupBy(F.coalesce("a.reason", F.lit("valid")).alias("reason"), F.col("a.trusted").alias("trusted")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'rejected' ELSE 'kept' END AS status FROM part) GROUP BY status""")
def early_rejects(spark, folder):
    items = lambda k: F.when(F.col("p_size") % k == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    kept, out = validate.early_rejects(_part(spark, folder).select(items(2).alias("a"), items(3).alias("b")), "a", "b")
    both = kept.select(F.lit("kept").alias("status")).union(out.select("status"))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, i::INTEGER AS index, CASE i WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN '###' ELSE '' END AS norm_label, i > 0 OR p_size % 4 = 0 AS ignored FROM part, (VALUES (0), (1), (2)) t(i)""")
def judged_lines(spark, folder):
    line = lambda t, d: F.struct(t.alias("transcription"), d.alias("difficult"))
    lines = F.array(line(F.col("p_name"), F.col("p_size") % 4 == 0), line(F.lit("###"), F.lit(False)), line(F.lit("  "), F.lit(False)))
    return validate.judged_lines(_part(spark, folder).select("p_partkey", lines.alias("l")), "l").select("p_partkey", "index", "norm_label", "ignored")


@query("""SELECT coalesce(error, 'none') AS error, valid, aligned, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'needs_one_geometry' WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 'invalid_quad' END AS error,
p_size % 5 <> 0 AS valid, p_size % 7 <> 0 AS aligned FROM part) GROUP BY ALL""")
def line_records(spark, folder):
    s = F.col("p_size")
    box = F.when(s % 2 == 0, F.array(F.lit(4.0), F.lit(0.0), F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0)))
    quad = F.array(*[F.lit(float(x)) for x in (0, 0, 5, 0, 5, 2, 0, 2)])
    none = F.lit(None).cast("array<double>")
    no = F.lit(None).cast("boolean")
    line = F.struct(
        F.when(s % 3 != 1, quad).alias("quad"), none.alias("points"), F.when(s % 3 != 2, box).alias("bbox"), none.alias("box"), F.lit("t").alias("transcript"), F.lit(None).cast("string").alias("transcription"),
        F.lit(None).cast("string").alias("text"), no.alias("valid"), (s % 5 == 0).alias("difficult"), no.alias("ignore"), no.alias("alignment_valid"), no.alias("teacher_correct"),
    )
    found = _part(spark, folder).select(validate.line_record(line, s % 7 != 0).alias("r"))
    return found.groupBy(F.coalesce("r.error", F.lit("none")).alias("error"), F.col("r.valid").alias("valid"), F.col("r.aligned").alias("aligned")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(CASE WHEN p_size % 3 = 0 THEN 'size_mismatch' WHEN p_size % 4 = 1 THEN 'digest_mismatch' END, 'none') AS error, count(*) AS n FROM part GROUP BY error""")
def artifact_binding(spark, folder):
    s = F.col("p_size")
    size, processed = F.array(s, s), F.array(s, F.when(s % 3 == 0, s + 1).otherwise(s))
    digest = F.when(s % 2 == 1, F.when(s % 4 == 1, "other").otherwise("same"))
    found = _part(spark, folder).select(F.coalesce(validate.artifact_error(size, processed, digest, F.lit("same")), F.lit("none")).alias("error"))
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_discount, l_discount::FLOAT > 0.07::FLOAT AS over, count(*) AS n FROM lineitem GROUP BY ALL""")
def float_threshold(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_discount", validate.over_threshold(F.col("l_discount"), 0.07).alias("over")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(CASE WHEN p_size % 4 = 0 THEN 'invalid_quad' WHEN p_size % 3 = 0 THEN 'invalid_size' END, 'none') AS error, count(*) AS n FROM part GROUP BY error""")
def detail_geometry(spark, folder):
    s = F.col("p_size").cast("double")
    flat = F.when(s % 4 == 0, F.lit(0.0)).otherwise(s)
    quad = F.when(s % 2 == 0, geometry.box_polygon(F.array(F.lit(0.0), F.lit(0.0), flat, F.lit(3.0))))
    size = F.when(s % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))
    return _part(spark, folder).groupBy(F.coalesce(validate.detail_error(quad, size), F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT setting, n FROM (SELECT 'o_orderstatus' AS setting, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL SELECT 'o_kind', count(DISTINCT 1) FROM orders) WHERE n > 1""")
def settings_that_differ(spark, folder):
    return validate.differing_settings(table(spark, folder, "orders").withColumn("o_kind", F.lit("order")), ["o_orderstatus", "o_kind"]).select("setting", "n")


@query("""SELECT event_id, coalesce(value, CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE END) AS first FROM events WHERE coalesce(value, CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE END) IS NOT NULL""")
def first_available(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("double")).alias("other"))
    return validate.first_present(rows, ["value", "other"], "first").select("event_id", "first")


# -- joins --------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def matched_required(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return align.matched(orders, table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k", "order").select("o_orderkey", "c_name")


@query("""WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS left_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS right_only, (SELECT count(*) FROM a) AS n""")
def matched_loosely(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    rows, sides = align.loosely_matched(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("x", F.lit(1)), "k")
    return sides.withColumn("n", F.lit(rows.count()))


@query("""SELECT p_partkey AS stem FROM part WHERE p_size % 3 <> 0 AND p_size % 4 <> 0""")
def evidence_match(spark, folder):
    s = F.col("p_size").cast("double")
    quad = lambda shift: geometry.box_polygon(F.array(s + shift, F.lit(0.0), s + 9, F.lit(4.0)))
    evidence = _part(spark, folder).select(F.col("p_partkey").alias("stem"), F.col("p_name").alias("norm_label"), quad(F.lit(0.0)).alias("quad"))
    moved = F.when(s % 4 == 0, 0.5).otherwise(0.005)
    known = _part(spark, folder).select(F.col("p_partkey").alias("stem"), F.when(s % 3 == 0, "other").otherwise(F.col("p_name")).alias("norm_label"), quad(moved).alias("quad"))
    return align.evidence_matched(evidence, known, ["stem"]).select("stem")


@query("""SELECT count(*) AS evaluated FROM part WHERE p_size % 6 = 0""")
def split_membership(spark, folder):
    k = _part(spark, folder).select(F.col("p_partkey").alias("k"), "p_size")
    evaluated, train, excluded = k.where("p_size % 6 = 0").select("k"), k.where("p_size % 2 = 0").select("k"), k.where("p_size % 2 = 1").select("k")
    align.check_membership(evaluated, train, excluded, "k")
    return evaluated.agg(F.count(F.lit(1)).alias("evaluated"))


_WORDS = """w AS (SELECT l_orderkey AS image, l_linenumber AS no, (l_partkey % 80)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS y0 FROM lineitem),
c AS (SELECT o_orderkey AS image, (o_custkey % 30)::DOUBLE AS x0, 0.0::DOUBLE AS y0 FROM orders)"""


@query(f"""WITH {_WORDS} SELECT c.image, count(*) FILTER (w.x0 >= c.x0 AND w.x0 + 10 <= c.x0 + 50 AND w.y0 >= 0 AND w.y0 + 5 <= 30) AS held, count(*) AS touched
FROM c JOIN w ON w.image = c.image AND w.x0 < c.x0 + 50 AND c.x0 < w.x0 + 10 AND w.y0 < 30 AND 0 < w.y0 + 5 GROUP BY c.image""")
def containment_pairs(spark, folder):
    """Words of an image joined with its crop: by image, then by what the boxes say."""
    box = lambda x, y, w, h: F.array(x.cast("double"), y.cast("double"), x.cast("double") + w, y.cast("double") + h)
    words = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("image"), box(F.col("l_partkey") % 80, F.col("l_suppkey") % 40, 10.0, 5.0).alias("w"))
    crops = table(spark, folder, "orders").select(F.col("o_orderkey").alias("image"), box(F.col("o_custkey") % 30, F.lit(0), 50.0, 30.0).alias("c"))
    pairs = words.join(crops, "image").where(geometry.intersects(F.col("w"), F.col("c")))
    return pairs.groupBy("image").agg(F.count_if(geometry.contains(F.col("c"), F.col("w"))).alias("held"), F.count(F.lit(1)).alias("touched"))


# -- summaries ----------------------------------------------------------------------------------------------------------


@query("""SELECT source, state, count(*) AS n FROM (SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'complete' END AS state FROM documents) WHERE doc_id % 5 <> 0 GROUP BY ALL""")
def job_states_by_source(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("content"), F.col("doc_id").alias("line_no"))
    jobs = curation.deduplicated(curation.identified(docs))
    records = F.when(F.col("line_no") % 5 == 0, F.slice(F.array(F.struct("source")), 1, 0)).otherwise(F.array(F.struct("source"), F.struct(F.lit("other").alias("source"))))
    return aggregates.job_states(jobs.select("key", "state", records.alias("records")))


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS text, CASE WHEN p_size % 9 = 0 THEN 0.0 ELSE least(p_size / 50.0, 0.5) END::DOUBLE AS confidence FROM part""")
def region_readings(spark, folder):
    word = lambda t, c: F.struct(F.col(t).alias("text"), c.alias("confidence"))
    words = F.array(word("p_brand", F.col("p_size") / 50), word("p_type", F.lit(0.5).cast("double")))
    some = F.when(F.col("p_size") % 9 == 0, F.slice(words, 1, 0)).otherwise(words)
    return _part(spark, folder).select("p_partkey", aggregates.region_text(some).alias("r")).select("p_partkey", "r.text", "r.confidence")


@query("""SELECT count(*) AS indexed, sum(p_size % 4)::BIGINT AS lines, sum(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS skipped, 0::BIGINT AS invalid FROM part""")
def import_totals(spark, folder):
    many = lambda n: F.slice(F.array(*[F.lit(1)] * 4), F.lit(1), n)
    rows = _part(spark, folder).select(many(F.col("p_size") % 4).alias("lines"), many((F.col("p_size") % 3 == 0).cast("int")).alias("skipped"), many(F.lit(0)).alias("invalid"))
    return aggregates.import_counters(rows, "lines", "skipped", "invalid")


@query("""SELECT l_returnflag, count(*) AS images, round(avg(l_discount), 9) AS l_discount, round(avg(CASE WHEN l_linenumber > 2 THEN l_tax END), 9) AS l_tax FROM lineitem GROUP BY l_returnflag""")
def mean_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") > 2, F.col("l_tax")))
    return aggregates.metric_means(rows, ["l_discount", "l_tax"], "l_returnflag").select("l_returnflag", "images", *[F.round(c, 9).alias(c) for c in ("l_discount", "l_tax")])


@query("""SELECT count(value) AS n, round(coalesce(sum(value), 0), 4) AS total, round(avg(value), 6) AS mean FROM events""")
def histogram_figures(spark, folder):
    return aggregates.histogram_totals(table(spark, folder, "events"), F.col("value")).select("n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 25 END::DOUBLE AS scale FROM part""")
def largest_variants(spark, folder):
    some = F.array(F.struct(F.lit(25.0).alias("scale")), F.struct(F.col("p_size").cast("double").alias("scale")))
    return _part(spark, folder).select("p_partkey", aggregates.largest_variant(some)["scale"].alias("scale"))


@query("""SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS weighted, (SELECT round(sum(v * w) / sum(w), 9) FROM (SELECT avg(l_discount) AS v, max(l_quantity) AS w FROM lineitem GROUP BY l_orderkey)) AS balanced FROM lineitem""")
def weighted_means(spark, folder):
    rows = table(spark, folder, "lineitem")
    one = rows.agg(F.round(numeric.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("weighted"))
    balanced = numeric.line_balanced_mean(rows, "l_orderkey", "l_discount", "l_quantity").select(F.round("mean", 9).alias("balanced"))
    return one.select("weighted", balanced.scalar().alias("balanced"))


@query("""SELECT p_partkey, round((p_size * 0.9::DOUBLE + 3 * 0.1) * 0.9 + p_size * 2 * 0.1, 9) AS average FROM part""")
def moving_average(spark, folder):
    s = F.col("p_size").cast("double")
    return _part(spark, folder).select("p_partkey", F.round(numeric.smoothed(F.array(s, F.lit(3.0), s * 2), 0.9), 9).alias("average"))


# -- geometry -----------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, (2.0 * p_size + 5)::DOUBLE AS x, (3.0 * (p_size + 1) - 4)::DOUBLE AS y, p_size::DOUBLE AS back_x, (p_size + 1)::DOUBLE AS back_y FROM part""")
def mapped_points(spark, folder):
    s = F.col("p_size").cast("double")
    move = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ((1, 0, 5), (0, 1, -4), (0, 0, 1))])
    m = geometry.composed(move, geometry.scale_matrix(F.lit(2.0), F.lit(3.0)))
    there = geometry.transformed(F.array(F.array(s, s + 1)), m)
    back = geometry.transformed(there, geometry.inverse(m))
    rows = _part(spark, folder).select("p_partkey", there[0].alias("t"), back[0].alias("b"))
    return rows.select("p_partkey", *[F.round(F.col(c)[k], 6).alias(n) for n, c, k in (("x", "t", 0), ("y", "t", 1), ("back_x", "b", 0), ("back_y", "b", 1))])


@query("""SELECT p_partkey, CASE WHEN p_size <= 30 THEN 1 ELSE 0 END::INTEGER AS n, CASE WHEN p_size <= 30 THEN p_size - 1.0 END::DOUBLE AS x0 FROM part""")
def crop_regions(spark, folder):
    s = F.col("p_size").cast("double")
    found = geometry.complete_regions(F.array(F.array(s, F.lit(3.0), s + 10, F.lit(8.0))), F.array(F.lit(1.0), F.lit(2.0), F.lit(40.0), F.lit(9.0)))
    return _part(spark, folder).select("p_partkey", F.size(found).alias("n"), F.get(found, F.lit(0))[0].alias("x0"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'bad' WHEN p_size % 4 = 1 THEN 'bad' WHEN p_size % 4 = 2 THEN 'reversed' ELSE 'kept' END AS kind FROM part) GROUP BY kind""")
def canonical_quads(spark, folder):
    s = F.col("p_size").cast("double")
    corners = lambda *xy: F.array(*[F.array(a, b) for a, b in xy])
    zero, one = F.lit(0.0), F.lit(1.0)
    crossed, flat = corners((zero, zero), (s, one), (s, zero), (zero, one)), corners((zero, zero), (s, zero), (s, F.lit(1e-9)), (zero, F.lit(1e-9)))
    back, fine = corners((zero, zero), (zero, one), (s, one), (s, zero)), corners((zero, zero), (s, zero), (s, one), (zero, one))
    quad = F.when(s % 4 == 0, crossed).when(s % 4 == 1, flat).when(s % 4 == 2, back).otherwise(fine)
    found = geometry.convex_clockwise(quad)
    kind = F.when(found.isNull(), "bad").when(found == quad, "kept").otherwise("reversed")
    return _part(spark, folder).select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, round(greatest(least(p_size + 20.0, 32) - greatest(p_size, 8), 0) * 6 / 160, 9)::DOUBLE AS visible FROM part""")
def visible_fractions(spark, folder):
    s = F.col("p_size").cast("double")
    polygon = geometry.box_polygon(F.array(s, F.lit(0.0), s + 20, F.lit(8.0)))
    box = F.array(F.lit(8.0), F.lit(2.0), F.lit(32.0), F.lit(100.0))
    return _part(spark, folder).select("p_partkey", F.round(geometry.visible_fraction(polygon, box), 9).alias("visible"))


@query("""SELECT p_partkey, (least(p_size, 20) * 3)::INTEGER AS pixels FROM part""")
def raster_pixels(spark, folder):
    s = F.col("p_size").cast("double")
    mask = geometry.polygon_mask(geometry.box_polygon(F.array(F.lit(0.0), F.lit(1.0), s, F.lit(4.0))), 20, 6)
    return _part(spark, folder).select("p_partkey", F.size(F.filter(mask, lambda x: x)).alias("pixels"))


@query("""SELECT p_partkey, (p_size * 2.0)::DOUBLE AS x, p_size * 2.0 > 50 + greatest(2.0, 0.02 * 50) AS outside, least(ceil(p_size * 2.0 + 0.25), 50)::BIGINT AS edge FROM part""")
def rescaled_boxes(spark, folder):
    s = F.col("p_size").cast("double")
    polygon = geometry.rescaled(geometry.box_polygon(F.array(F.lit(0.0), F.lit(0.0), s, F.lit(4.0))), F.lit(2.0), F.lit(0.5))
    wider = F.transform(polygon, lambda p: F.array(p[0] + 0.25, p[1]))
    return _part(spark, folder).select("p_partkey", polygon[1][0].alias("x"), geometry.far_outside(polygon, F.lit(50), F.lit(20)).alias("outside"), geometry.pixel_box(wider, F.lit(50), F.lit(20))[2].alias("edge"))


@query("""WITH c AS (SELECT p_partkey, least(100, greatest(30, ceil(p_size * 1.5)))::DOUBLE AS w, p_size FROM part)
SELECT p_partkey, least(greatest(0, floor((20.5 + p_size - w) / 2)), 100 - w)::DOUBLE AS x0, w FROM c""")
def text_crop_boxes(spark, folder):
    """One box an image, from 10.25 on, which its crop holds: nothing to grow for."""
    s = F.col("p_size").cast("double")
    found = geometry.text_crops(F.array(F.array(F.lit(10.25), F.lit(4.0), s + 10.25, F.lit(8.0))), F.lit(100), F.lit(50), 30, 20, 0.25, 4)
    return _part(spark, folder).select("p_partkey", found[0].alias("c")).select("p_partkey", F.col("c")[0].alias("x0"), (F.col("c")[2] - F.col("c")[0]).alias("w"))


@query("""SELECT l_orderkey, round(sum(l_quantity * (l_linenumber - 1)) / nullif(sum(l_linenumber - 1), 0), 9) AS value FROM lineitem GROUP BY l_orderkey""")
def tile_blend(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").alias("value"), (F.col("l_linenumber") - 1).alias("w"))
    return numeric.blended(rows, ["l_orderkey"], "value", "w").select("l_orderkey", F.round("value", 9).alias("value"))


@query("""SELECT l_linenumber::INTEGER AS l_linenumber, round(-10 * log10(greatest(avg(l_discount) / 4, 1e-12)), 9) AS psnr, round(0.5 + (0.1 - 0.5) * least(l_linenumber / 4.0, 1), 9)::DOUBLE AS rate,
round(exp(-power((l_linenumber - 3.0) / (0.3 * 7), 2) / 2), 9) AS weight FROM lineitem GROUP BY l_linenumber""")
def kernels(spark, folder):
    per = table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(F.avg("l_discount").alias("m"))
    n = F.col("l_linenumber")
    found = {"psnr": numeric.psnr(F.col("m")), "rate": numeric.linear_schedule(n, 0.5, 0.1, 4), "weight": numeric.tile_weight(n, 7)}
    return per.select("l_linenumber", *[F.round(v, 9).alias(k) for k, v in found.items()])


@query("""SELECT l_orderkey % 50 AS image, floor(l_partkey % 12 / 4)::BIGINT AS tx, floor(l_suppkey % 8 / 4)::BIGINT AS ty, round(avg(l_quantity), 9) AS v FROM lineitem GROUP BY ALL""")
def pooled_means(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 50).alias("image"), (F.col("l_partkey") % 12).alias("x"), (F.col("l_suppkey") % 8).alias("y"), F.col("l_quantity").alias("v"))
    return numeric.pooled(rows, "image", 4, "v").withColumn("v", F.round("v", 9))


@query("""SELECT p_partkey, round(4 * (p_size / 60.0 * ln(p_size / 60.0 / 0.5) + (1 - p_size / 60.0) * ln((1 - p_size / 60.0) / 0.5)), 9) AS divergence FROM part""")
def divergences(spark, folder):
    p = F.col("p_size") / 60.0
    return _part(spark, folder).select("p_partkey", F.round(numeric.divergence(F.array(p, 1 - p), F.array(F.lit(0.5), F.lit(0.5)), 2.0), 9).alias("divergence"))


@query("""SELECT p_partkey, round(20 * 6 - CASE WHEN p_size % 2 = 0 THEN least(p_size, 20) * 3 * 0.75 ELSE 0 END, 9)::DOUBLE AS trust FROM part""")
def trust_maps(spark, folder):
    s = F.col("p_size").cast("double")
    line = F.struct(geometry.box_polygon(F.array(F.lit(0.0), F.lit(1.0), s, F.lit(4.0))).alias("polygon"), F.lit(True).alias("valid"), F.lit(True).alias("aligned"), (s % 2 == 1).alias("teacher_correct"))
    total = F.aggregate(geometry.trust_map(F.array(line), 20, 6, 0.25), F.lit(0.0), lambda a, x: a + x)
    return _part(spark, folder).select("p_partkey", F.round(total, 9).alias("trust"))


@query("""SELECT p_partkey, round((4 * pow(2.0 * p_size, 2) + pow(4.0 * p_size, 2)) / 9 - pow((4 * 2.0 * p_size - 4.0 * p_size) / 9, 2), 6) AS variance, round(p_size * sqrt(8) / 9, 6) AS deviation FROM part""")
def image_sharpness(spark, folder):
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    found = geometry.sharpness(F.array(*[zero] * 4, s, *[zero] * 4), F.lit(3))
    return _part(spark, folder).select("p_partkey", found.alias("f")).select("p_partkey", F.round("f.variance", 6).alias("variance"), F.round("f.deviation", 6).alias("deviation"))


# -- identity and text --------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(text) AS content, sha256('RGB:' || doc_id || ':2:' || source) AS pixels, sha256('=' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE '=' || lang END) AS fingerprint FROM documents""")
def content_digests(spark, folder):
    key = F.col("doc_id").cast("string")
    return table(spark, folder, "documents").select(
        "doc_id",
        identity.file_digest(F.col("text").cast("binary")).alias("content"),
        identity.pixel_digest(key, F.lit("2"), F.col("source").cast("binary")).alias("pixels"),
        identity.fingerprint(key, F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).alias("fingerprint"),
    )


@query("""WITH f AS (SELECT n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'lq' ELSE 'hq' END AS kind, n_name || chr(9) || CASE WHEN n_regionkey % 2 = 0 THEN 'lq' ELSE 'hq' END || chr(9) || 'p/' || n_name || chr(9) || n_nationkey || chr(9) || '7' AS line FROM nation)
SELECT sha256(string_agg(kind || chr(9) || name || chr(9) || sha256(line), chr(10) ORDER BY kind || chr(9) || name || chr(9) || sha256(line))) AS fingerprint, count(*) AS names FROM f""")
def manifest_digest(spark, folder):
    n = table(spark, folder, "nation")
    kind = F.when(F.col("n_regionkey") % 2 == 0, "lq").otherwise("hq")
    return identity.manifest_fingerprint(n.select(F.col("n_name").alias("name"), kind.alias("kind"), F.concat(F.lit("p/"), "n_name").alias("path"), F.col("n_nationkey").alias("size"), F.lit(7).alias("mtime")))


@query("""SELECT doc_id, (('0x' || substr(sha256('17:3:' || doc_id), 1, 16))::UBIGINT)::VARCHAR AS key FROM documents""")
def crop_seeds(spark, folder):
    return table(spark, folder, "documents").select("doc_id", identity.crop_key(SEED, F.lit(3), F.col("doc_id")).cast("string").alias("key"))


@query("""SELECT event_id, '{"k": ' || coalesce(props->>'k', 'null') || '}' AS json FROM events WHERE props->>'k' IS NOT NULL AND event_id % 2 = 0""")
def literal_properties(spark, folder):
    e = table(spark, folder, "events").where("event_id % 2 = 0")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").cast("string")
    literal = F.concat(F.lit("{'k': "), k, F.lit(",}"))
    return e.select("event_id", literal.alias("l")).where("l IS NOT NULL").select("event_id", text.literal_json(F.col("l")).alias("json"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS head, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) END AS rest, '&lt;' || p_brand || '&gt; &amp; &quot;' AS html FROM part""")
def split_and_escaped(spark, folder):
    parts = text.split_limited(F.col("p_name"), " ", 2)
    html = text.html_escaped(F.concat(F.lit("<"), "p_brand", F.lit('> & "')))
    return _part(spark, folder).select("p_partkey", parts[0].alias("head"), F.get(parts, F.lit(1)).alias("rest"), html.alias("html"))


# -- control ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/abs/' || doc_id WHEN doc_id % 3 = 1 THEN 's3://b/' || doc_id ELSE 'base/rel/' || doc_id END AS path FROM documents""")
def resolved_paths(spark, folder):
    k = F.col("doc_id") % 3
    path = F.when(k == 0, F.concat(F.lit("/abs/"), "doc_id")).when(k == 1, F.concat(F.lit("s3://b/"), "doc_id")).otherwise(F.concat(F.lit("rel/"), "doc_id"))
    return table(spark, folder, "documents").select("doc_id", control.resolved(path, "base/").alias("path"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 2 END AS doubled, CASE WHEN event_id % 2 = 1 THEN 'ValueError: odd' END AS error FROM events WHERE event_id < 1000""")
def guarded_rows(spark, folder):
    def double(x):
        if x % 2:
            raise ValueError("odd")
        return x * 2

    return control.guarded(table(spark, folder, "events").where("event_id < 1000").select("event_id"), "event_id", double, "bigint", "doubled")


@query("""SELECT p_partkey, (p_size * 2.0 + 5)::DOUBLE AS x0, p_size::DOUBLE AS back FROM part""")
def moved_regions(spark, folder):
    s = F.col("p_size").cast("double")
    region = F.struct(geometry.box_polygon(F.array(s, F.lit(1.0), s + 9, F.lit(4.0))).alias("polygon"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("t").alias("text"))
    m = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ((2, 0, 5), (0, 2, 1), (0, 0, 1))])
    there = geometry.moved_regions(F.array(region), m)
    rows = _part(spark, folder).select("p_partkey", there.alias("r"))
    back = geometry.moved_regions(F.col("r"), geometry.inverse(m))
    return rows.select("p_partkey", F.col("r")[0]["bbox"][0].alias("x0"), F.round(back[0]["bbox"][0], 9).alias("back"))


@query("""SELECT coalesce(CASE WHEN p_size % 3 = 0 THEN 'smaller_than_input' WHEN p_size % 3 = 1 THEN 'aspect_ratio_changed' END, 'none') AS error, count(*) AS n FROM part GROUP BY error""")
def size_checks(spark, folder):
    s = F.col("p_size")
    width = F.when(s % 3 == 0, 99).otherwise(200)
    height = F.when(s % 3 == 0, 50).when(s % 3 == 1, 102).otherwise(101)
    return _part(spark, folder).groupBy(F.coalesce(control.size_error(F.lit(100), F.lit(50), width, height), F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey % 200 AS block, count(*) AS n FROM lineitem GROUP BY block HAVING count(*) <> count(DISTINCT l_linenumber) OR max(l_linenumber) >= 7""")
def partition_faults(spark, folder):
    blocks = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 200).alias("block"), F.lit("a").alias("part"), F.col("l_linenumber").alias("index"))
    return control.partition_errors(blocks, 7).select("block", "n")


@query("""SELECT 2::INTEGER AS with_error, 0::INTEGER AS without, true AS done, false AS lacking""")
def run_outcome(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("stem"))
    status = s.withColumn("status", F.when(F.col("stem") == 1, "error").otherwise("accepted"))
    found = (control.exit_code(status), control.exit_code(status.where("stem > 1")), control.all_done(s, s, "stem"), control.all_done(s, s.where("stem > 1"), "stem"))
    return spark.createDataFrame([found], "with_error int, without int, done boolean, lacking boolean")


@query("""WITH k AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40), p AS (SELECT p_partkey FROM k ORDER BY p_size DESC, p_partkey LIMIT 10) SELECT p_partkey, p_partkey IN (SELECT p_partkey FROM p) AS protected FROM k""")
def protected_best(spark, folder):
    rows = _part(spark, folder).select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").alias("b"))
    return numeric.protected_top(rows, 40, 10, "a", "b", "p_partkey").select("p_partkey", "protected")


@query(f"""WITH d AS (SELECT draw, {_UNIT.format("'17:kind:' || draw")} AS k, {_UNIT.format("'17:no:' || draw")} AS u FROM range(500) t(draw)), n AS (SELECT (SELECT count(*) FROM lineitem) AS l, (SELECT count(*) FROM orders) AS i)
SELECT draw::BIGINT AS draw, CASE WHEN k < 0.6 THEN 'line' ELSE 'image' END AS kind, floor(u * CASE WHEN k < 0.6 THEN l ELSE i END)::BIGINT AS no FROM d, n""")
def line_balanced_draws(spark, folder):
    return sampling.line_balanced(table(spark, folder, "lineitem"), table(spark, folder, "orders"), spark.range(500).withColumnRenamed("id", "draw"), SEED, 0.6)


@query(f"""WITH c AS (SELECT CASE WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS source, count(*) AS items FROM lineitem GROUP BY source), w AS (SELECT *, [0.5, 0.2, 0.3][source + 1] AS weight FROM c),
e AS (SELECT *, sum(weight) OVER (ORDER BY source) / sum(weight) OVER () AS upto FROM w), d AS (SELECT draw, {_UNIT.format("'17:0:source:' || draw")} AS u, {_UNIT.format("'17:0:item:' || draw")} AS v FROM range(500) t(draw)),
f AS (SELECT draw, v, min(source) AS source FROM d JOIN e ON upto > u GROUP BY draw, v) SELECT draw::BIGINT AS draw, source::INTEGER AS source, floor(v * items)::BIGINT AS item FROM f JOIN e USING (source)""")
def height_bucket_draws(spark, folder):
    return sampling.bucket_weighted(table(spark, folder, "lineitem"), "l_quantity", [10, 30], [0.5, 0.2, 0.3], spark.range(500).withColumnRenamed("id", "draw"), SEED)


@query("""WITH d AS (SELECT doc_id, source, text, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS batch FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY batch, doc_id) AS rn FROM d)
SELECT batch::BIGINT AS batch, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'complete' END AS state, count(*) AS n FROM f GROUP BY ALL""")
def incremental_batches(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("content"), F.col("doc_id").alias("line_no"))
    state = scratch(spark, "state")
    for number in (0, 1):
        incremental.commit_batch(docs.where(F.col("line_no") % 2 == number), number, state, incremental.STATE)
    return spark.read.schema(incremental.STATE).parquet(state).groupBy("batch", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, folder):
    """The windows of a stream over the events' file, once all of it has come."""
    schema, out, check = table(spark, folder, "events").schema, scratch(spark, "windows"), scratch(spark, "check")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    sink = incremental.metric_windows(events).writeStream.outputMode("complete").option("checkpointLocation", check).trigger(availableNow=True)
    sink.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT doc_id, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)""")
def sidecar_results(spark, folder):
    """A precomputed back-end's results by key; documents without stay, with nulls."""
    side = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return curation.with_sidecar(table(spark, folder, "documents").select("doc_id"), side, "doc_id", ["quality", "toxic"])


@query("""SELECT 'review' AS status, 'demo_backend' AS reasons, false AS eligible_for_training""")
def demo_run(spark, folder):
    settings = curation.Curation(rules=(gates.Rule("sharpness", 0.5),), demo=True)
    found = curation.crops(curation.demo_record(spark), settings)
    return found.select("status", F.array_join("reasons", ",").alias("reasons"), "eligible_for_training")


@query("""SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents""")
def unique_records(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    return curation.unique_ids(docs).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("""SELECT 'p' || p_partkey AS stem, 'hr/p' || p_partkey || '.png' AS hr_path FROM part WHERE p_size % 2 = 0""")
def mirrored_files(spark, folder):
    stem = F.concat(F.lit("p"), "p_partkey").alias("stem")
    high = _part(spark, folder).select(stem, F.concat(F.lit("hr/p"), "p_partkey", F.lit(".png")).alias("path"))
    return readers.mirrored(_part(spark, folder).where("p_size % 2 = 0").select(stem), high, "stem")


@query("""SELECT p_partkey, p_size::DOUBLE AS shift, 2.0::DOUBLE AS scale, 0.0::DOUBLE AS bend FROM part""")
def rectifications(spark, folder):
    s = F.col("p_size").cast("double")
    h = geometry.homography(geometry.box_polygon(F.array(s, F.lit(3.0), s + 20, F.lit(11.0))), F.lit(10), F.lit(4))
    rows = _part(spark, folder).select("p_partkey", h.alias("h"))
    return rows.select("p_partkey", *[F.round(F.col("h")[r][c], 6).alias(n) for n, r, c in (("shift", 0, 2), ("scale", 0, 0))], F.abs(F.round(F.col("h")[2][0], 6)).alias("bend"))


# -- the whole curation flow --------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT p_partkey, p_size % 5 AS a, p_size % 7 AS b, p_size % 3 AS c FROM part),
x AS (SELECT *, CASE WHEN a = 0 THEN 'none' WHEN b = 1 THEN 'low' ELSE 'read' END AS t FROM r)
SELECT status, reasons, count(*) AS n FROM (SELECT CASE WHEN t = 'none' OR t = 'low' OR c = 1 THEN 'rejected' WHEN b = 0 OR c = 2 OR b = 2 THEN 'review' ELSE 'accepted' END AS status,
CASE WHEN t = 'none' THEN 'no_localization_text' ELSE concat_ws(',', CASE WHEN t = 'low' THEN 'low_ocr_confidence' END, CASE WHEN t = 'read' AND c = 1 THEN 'low_iqa:clean' END, CASE WHEN b = 0 THEN 'text_reference_conflict' END,
CASE WHEN t = 'low' OR b = 2 THEN 'glyph_unverifiable' END, CASE WHEN t = 'low' OR c = 2 THEN 'missing_iqa:clean' END) END AS reasons FROM x) GROUP BY ALL""")
def curation_full(spark, folder):
    """Records with one line each, from the numbers of a part: none, read with little confidence, read otherwise, without score or glyph."""
    s = F.col("p_size")
    a, b, c = s % 5, s % 7, s % 3
    none = F.lit(None).cast("boolean")

    def region(scale: float, value, confidence, trusted):
        polygon = geometry.box_polygon(F.array(*[F.lit(x * scale) for x in (20.0, 30.0, 60.0, 40.0)]))
        return F.struct(polygon.alias("polygon"), F.lit(None).cast("array<double>").alias("bbox"), value.alias("text"), confidence.alias("confidence"), trusted.alias("trusted"), none.alias("reliable"))

    line = F.array(region(1.0, F.col("p_name"), F.lit(1.0), F.lit(True)))
    final = F.array(region(2.0, F.when(b == 0, "other").otherwise(F.concat(F.lit(" "), "p_name")), F.when(b == 1, 0.2).otherwise(0.9), none))
    score = F.when(c == 1, 0.1).when(c == 0, 0.9)
    records = _part(spark, folder).select(
        F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("digest"), F.lit(None).cast("string").alias("group_id"), F.lit(100).alias("width"), F.lit(50).alias("height"),
        F.when(a == 0, F.slice(line, 1, 0)).otherwise(line).alias("annotations"), F.slice(line, 1, 0).alias("original_ocr"), final.alias("final_ocr"),
        F.create_map(F.lit("clean"), score).alias("scores"), F.when(b != 2, "verified").alias("glyph_status"), F.lit("seen").alias("glyph_evidence"),
    )
    settings = curation.Curation(rules=(gates.Rule("clean", 0.5),), long_edge=200, crop=(60.0, 30.0, 0.1, 8))
    rows = curation.crops(records, settings).select("status", F.array_join("reasons", ",").alias("reasons"))
    return rows.groupBy("status", "reasons").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, metric, count(*) AS n, bool_and(fine) AS fine FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT unnest(['teacher_cer', 'student_cer', 'cer_delta', 'teacher_accuracy', 'student_accuracy', 'accuracy_delta',
'teacher_one_minus_ned', 'student_one_minus_ned', 'one_minus_ned_delta', 'retention']) AS metric, true AS fine) GROUP BY ALL""")
def bootstrap_all_metrics(spark, folder):
    """Each metric of each group has an interval around its estimate from all samples."""
    k = F.col("o_orderkey")
    t, s = k % 4, (k * 7) % 5
    rows = table(spark, folder, "orders").select(
        "o_orderpriority", "o_custkey", F.lit(10).alias("label_length"), t.alias("teacher_edits"), s.alias("student_edits"), (t == 0).cast("int").alias("teacher_correct"), (s == 0).cast("int").alias("student_correct"),
        ((t == 0) & (s == 0)).cast("int").alias("joint_correct"), (t / 10).alias("teacher_distance"), (s / 10).alias("student_distance"),
    )
    found = metrics.bootstrap_metrics(rows, "o_orderpriority", "o_custkey", samples=200, seed=SEED)
    fine = (F.col("low") <= F.col("estimate")) & (F.col("estimate") <= F.col("high")) & (F.col("valid_samples") == 200) & (F.col("status") == "paired_image_percentile")
    return found.groupBy("o_orderpriority", "metric").agg(F.count(F.lit(1)).alias("n"), F.bool_and(fine).alias("fine"))
