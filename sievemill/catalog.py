"""The engine's queries over the test tables, by name, and the SQL that each has to agree with.

The test tables hold no images or OCR results, so some columns are taken for others: documents for manifest records, labels for
scored dimensions, orders for lines that runs have read, line items for boxes. The algebra is the operators'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, identity, numeric, text
from .operators import aggregates, align, control, gates, match, metrics, sampling
from .plans import assembly, curation
from .session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and, where there is one, the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_more  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_more  # noqa: F401

    return dict(SQL)


SEED = 17
SETTINGS = curation.Curation(seed=SEED, validation=0.05, rules=(gates.Rule("quality", 1.0, "higher"), gates.Rule("toxic", 0.0, "lower")))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("content"), F.col("doc_id").alias("line_no"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("line_no"), "quality", "toxic")
    return docs.join(labels, "line_no", "left")


_DECIDED = """WITH d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents),
j AS (SELECT d.*, quality, toxic FROM d LEFT JOIN labels USING (doc_id)) """


@query(_DECIDED + """SELECT source, CASE WHEN rn > 1 OR quality < 1 OR toxic > 0 THEN 'rejected' WHEN quality IS NULL OR toxic IS NULL THEN 'review' ELSE 'accepted' END AS status, count(*) AS n FROM j GROUP BY ALL""")
def curation_status_by_source(spark, folder):
    rows = curation.curate(_records(spark, folder), SETTINGS)
    return aggregates.status_counts(rows.select("source", "status")).where("level = 'source_status'").select("source", "status", "n")


@query(_DECIDED + """, r AS (SELECT source, 'duplicate_image' AS reason FROM j WHERE rn > 1
UNION ALL SELECT source, 'low_iqa:quality' FROM j WHERE rn = 1 AND quality < 1 UNION ALL SELECT source, 'low_iqa:toxic' FROM j WHERE rn = 1 AND toxic > 0
UNION ALL SELECT source, 'missing_iqa:quality' FROM j WHERE rn = 1 AND quality IS NULL UNION ALL SELECT source, 'missing_iqa:toxic' FROM j WHERE rn = 1 AND toxic IS NULL)
SELECT source, reason, count(*) AS n FROM r GROUP BY ALL""")
def curation_reason_counts(spark, folder):
    return aggregates.reason_counts(curation.curate(_records(spark, folder), SETTINGS).select("source", "reasons"))


@query(_DECIDED + """SELECT source, status, count(*) AS n, CASE WHEN grouping(source) = 0 THEN 'source_status' WHEN grouping(status) = 0 THEN 'status' ELSE 'total' END AS level
FROM (SELECT source, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'complete' END AS status FROM j) GROUP BY GROUPING SETS ((source, status), (status), ())""")
def job_state_rollup(spark, folder):
    rows = curation.deduplicated(curation.identified(_records(spark, folder)))
    return aggregates.status_counts(rows.select("source", F.col("state").alias("status")))


@query("""SELECT doc_id, CASE WHEN f <> doc_id THEN f::VARCHAR END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)""")
def dedup_first_wins(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return control.first_wins(docs, "digest", "doc_id", "doc_id").select("doc_id", F.col("duplicate_of").cast("string").alias("duplicate_of"))


@query("""SELECT doc_id, sha256('["' || source || '", "' || doc_id || '"]') AS key FROM documents""")
def sample_keys(spark, folder):
    return table(spark, folder, "documents").select("doc_id", identity.sample_key(F.col("source"), F.col("doc_id").cast("string")).alias("key"))


_UNIT = "(('0x' || substr(sha256({}), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"SELECT doc_id, CASE WHEN {_UNIT.format("'17:' || doc_id")} < 0.05 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_assignment(spark, folder):
    return table(spark, folder, "documents").select("doc_id", identity.split(F.col("doc_id").cast("string"), SEED, 0.05).alias("split"))


@query(f"SELECT split, count(*) AS n, count(DISTINCT text) AS groups FROM (SELECT text, CASE WHEN {_UNIT.format("'17:' || sha256(text)")} < 0.2 THEN 'validation' ELSE 'train' END AS split FROM documents) GROUP BY split")
def split_by_group(spark, folder):
    docs = table(spark, folder, "documents").select(F.sha2("text", 256).alias("g"))
    return docs.groupBy(identity.split(F.col("g"), SEED, 0.2).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("groups"))


@query("""SELECT doc_id, (('0x' || substr(sha256('17:' || source || ':' || doc_id), 1, 16))::UBIGINT)::VARCHAR AS seed FROM documents""")
def variant_seeds(spark, folder):
    seed = identity.seed64(F.lit("17"), F.col("source"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select("doc_id", seed.cast("string").alias("seed"))


@query("""SELECT bin, count(*) AS n FROM (SELECT least(19, floor(l_discount * 10 * 20))::INTEGER AS bin FROM lineitem) GROUP BY bin""")
def confidence_histogram_20(spark, folder):
    return aggregates.histogram(table(spark, folder, "lineitem"), F.col("l_discount") * 10)


@query("""SELECT bucket, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM (SELECT l_quantity, CASE WHEN l_quantity < 16 THEN '0-16' WHEN l_quantity < 24 THEN '16-24'
WHEN l_quantity < 32 THEN '24-32' WHEN l_quantity < 48 THEN '32-48' ELSE '48+' END AS bucket FROM lineitem) GROUP BY bucket""")
def size_buckets_open_ended(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_quantity", metrics.size_bucket(F.col("l_quantity"), [16, 24, 32, 48]).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


_MEASURED = "SELECT p_brand, p_size, levenshtein(p_name, p_type) AS d, length(p_name) AS a, length(p_type) AS b FROM part"


@query(f"""SELECT p_brand, count(*) AS n, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(sum(d)::DOUBLE / sum(b)::DOUBLE, 9) AS cer, round(1 - avg(d::DOUBLE / greatest(a, b)), 9) AS one_minus_ned FROM ({_MEASURED}) GROUP BY p_brand""")
def text_exact_match_cer_ned(spark, folder):
    out = metrics.text_scores(table(spark, folder, "part"), "p_name", "p_type", "p_brand")
    return out.select("p_brand", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "cer", "one_minus_ned")])


@query(f"""SELECT CASE WHEN p_size < 16 THEN '0-16' WHEN p_size < 32 THEN '16-32' WHEN p_size < 64 THEN '32-64' ELSE '64+' END AS bucket, count(*) AS n,
round(sum(d)::DOUBLE / sum(b)::DOUBLE, 9) AS cer FROM ({_MEASURED}) GROUP BY bucket""")
def bucket_text_scores(spark, folder):
    out = metrics.bucket_scores(table(spark, folder, "part"), "p_name", "p_type", "p_size", [16, 32, 64])
    return out.select("bucket", "n", F.round("cer", 9).alias("cer"))


def _run(spark: SparkSession, folder: str, every: int, suffix: str) -> DataFrame:
    """A run over orders: the label is the priority, read wrongly for every ``every``th order."""
    o = table(spark, folder, "orders")
    wrong = F.col("o_orderkey") % every == 0
    read = F.when(wrong, F.concat("o_orderpriority", F.lit(suffix))).otherwise(F.col("o_orderpriority"))
    pred = F.struct(read.alias("text"), read.alias("norm_text"), F.lit(0.9).alias("score"), F.lit(None).cast("int").alias("edit_distance"))
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("stem"), F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("label"), F.col("o_orderpriority").alias("norm_label"), (F.col("o_orderkey") % 90 + 1).cast("double").alias("size"), F.lit(None).cast("array<array<double>>").alias("quad"), F.lit(None).cast("array<int>").alias("sr_size"), pred.alias("pred"))


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    return align.paired_rows(align.aligned([_run(spark, folder, 5, "x"), _run(spark, folder, 3, "yy")], [_run(spark, folder, 7, "zzz")], ["stem", "index"]))


_PAIRED = """p AS (SELECT 'c' || o_custkey AS stem, o_orderkey AS index, r AS run, length(o_orderpriority) AS len, (o_orderkey % 90 + 1)::DOUBLE AS size,
CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS te, CASE WHEN r = 0 AND o_orderkey % 5 = 0 THEN 1 WHEN r = 1 AND o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS se FROM orders, (VALUES (0), (1)) t(r))"""


@query(f"""WITH {_PAIRED} SELECT run::INTEGER AS run, count(*) AS n, sum(te)::BIGINT AS teacher_edits, sum(se)::BIGINT AS student_edits, sum(CASE WHEN te = 0 AND se = 0 THEN 1 ELSE 0 END)::BIGINT AS joint FROM p GROUP BY run""")
def paired_run_alignment(spark, folder):
    return _paired(spark, folder).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("teacher_edits").alias("teacher_edits"), F.sum("student_edits").alias("student_edits"), F.sum("joint_correct").alias("joint"))


_EDGES = [16, 24, 32, 64, 96]
_BINS = "(VALUES ('0-16', 0, 16), ('16-24', 16, 24), ('24-32', 24, 32), ('32-64', 32, 64), ('64-96', 64, 96), ('96+', 96, 1e308), ('all', 0, 1e308), ('<64', 0, 64)) b(bin, lo, hi)"


@query(f"""WITH {_PAIRED}, s AS (SELECT index, any_value(size) AS size, any_value(len) AS len, avg(te) AS te, avg(se) AS se, avg(CASE WHEN te = 0 THEN 1.0 ELSE 0 END) AS tc,
avg(CASE WHEN se = 0 THEN 1.0 ELSE 0 END) AS sc, avg(CASE WHEN te = 0 AND se = 0 THEN 1.0 ELSE 0 END) AS jc,
avg(te / (len + te)::DOUBLE) AS td, avg(se / (len + se)::DOUBLE) AS sd FROM p GROUP BY stem, index)
SELECT bin, count(index) AS instances, round(sum(te) / sum(len), 9) AS teacher_cer, round(sum(se) / sum(len), 9) AS student_cer, round(sum(tc) / nullif(count(index), 0), 9) AS teacher_accuracy,
round(sum(sc) / nullif(count(index), 0), 9) AS student_accuracy, round(sum(jc) / nullif(sum(tc), 0), 9) AS retention,
round((sum(se) - sum(te)) / sum(len), 9) AS cer_delta, round((sum(sc) - sum(tc)) / nullif(count(index), 0), 9) AS accuracy_delta, round(1 - sum(td) / nullif(count(index), 0), 9) AS teacher_one_minus_ned,
round(1 - sum(sd) / nullif(count(index), 0), 9) AS student_one_minus_ned, round((sum(td) - sum(sd)) / nullif(count(index), 0), 9) AS one_minus_ned_delta FROM {_BINS} LEFT JOIN s ON size >= lo AND size < hi GROUP BY bin""")
def paired_bin_metrics(spark, folder):
    mean = metrics.seed_average(_paired(spark, folder).withColumnRenamed("size", "height"), "stem", "index", "height")
    out = metrics.height_bins(mean, "height", [float(e) for e in _EDGES])
    return out.select("bin", "instances", *[F.round(c, 9).alias(c) for c in metrics.METRICS])


@query("""SELECT bin, count(p_size) AS n FROM (VALUES ('0-8', 0, 8), ('8-20', 8, 20), ('20-51', 20, 51), ('51-64', 51, 64), ('64+', 64, 1e308), ('all', 0, 1e308), ('<64', 0, 64)) b(bin, lo, hi) LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY bin""")
def height_bins_keep_empty(spark, folder):
    edges = [8.0, 20.0, 51.0, 64.0]
    bins = spark.createDataFrame([(name,) for name, _, _ in metrics.bin_table(edges)], "bin string")
    counts = metrics.in_bins(table(spark, folder, "part").select("p_size"), "p_size", edges).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").fillna(0)


@query("""WITH k AS (SELECT o_orderkey AS k, true AS a, o_orderkey % 10 <> 3 AS b, o_orderkey % 15 <> 4 AS c FROM orders)
SELECT 0 AS run, count(*) FILTER (a AND NOT (b AND c)) AS excluded FROM k UNION ALL SELECT 1, count(*) FILTER (b AND NOT (b AND c)) FROM k UNION ALL SELECT 2, count(*) FILTER (c AND NOT (b AND c)) FROM k""")
def run_exclusions(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    return align.exclusions([o, o.where("o_orderkey % 10 <> 3"), o.where("o_orderkey % 15 <> 4")], ["o_orderkey"])


@query(f"""WITH {_PAIRED}, h AS (SELECT * FROM p WHERE run = 1 AND te = 0 AND se > 0 AND size < 40) SELECT (SELECT count(*) FROM h) AS lines, (SELECT count(*) FROM h) AS aligned_lines,
(SELECT count(DISTINCT stem) FROM h) AS images, (SELECT sha256(string_agg(stem, chr(10) ORDER BY stem)) FROM (SELECT DISTINCT stem FROM h)) AS names_sha256""")
def hard_case_mining(spark, folder):
    rows = _paired(spark, folder).where("run = 1").select("stem", "index", "teacher_correct", "student_correct", "size", F.col("student.score").alias("score"), *[F.lit(v).alias(k) for k, v in (("valid", True), ("ignore", False), ("difficult", False), ("alignment_valid", True))])
    return align.mining_report(align.hard_cases(rows, 40, 0.5), "stem")


@query("""SELECT d.source, count(*) AS n, count(*) FILTER (d.text IN (SELECT text FROM benchmark)) AS held FROM documents d GROUP BY d.source""")
def split_overlap_guard(spark, folder):
    held = table(spark, folder, "benchmark").select("text").distinct().withColumn("h", F.lit(True))
    return table(spark, folder, "documents").select("source", "text").join(held, "text", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h")).alias("held"))


@query("""SELECT doc_id, source, lang, stratum_rank::INTEGER AS stratum_rank FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('17:' || doc_id), doc_id) AS stratum_rank FROM documents)
ORDER BY stratum_rank, source, lang LIMIT 100""")
def stratified_round_robin(spark, folder):
    return sampling.round_robin(table(spark, folder, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 100, SEED)


@query("""WITH g AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT lang FROM documents)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('17:' || lang || ':' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, lang FROM r JOIN g USING (lang) WHERE r <= 42 // m + CASE WHEN k < 42 % m THEN 1 ELSE 0 END""")
def uniform_sample_per_subset(spark, folder):
    return sampling.sample_per_group(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id", 42, SEED)


@query("""SELECT doc_id FROM documents ORDER BY sha256('17:' || doc_id), doc_id LIMIT 150""")
def uniform_sample_rows(spark, folder):
    return sampling.sample_rows(table(spark, folder, "documents").select("doc_id"), "doc_id", 150, SEED)


@query("""SELECT s_suppkey, repeat_no::INTEGER AS repeat_no FROM supplier, generate_series(0, s_nationkey % 3 - 1) t(repeat_no)""")
def repeat_expansion(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("repeat"))
    return sampling.repeated(rows, "repeat").select("s_suppkey", "repeat_no")


@query(f"""WITH s AS (SELECT n_regionkey AS source, count(*) AS items, (n_regionkey + 1)::DOUBLE AS weight FROM nation GROUP BY ALL),
e AS (SELECT *, sum(weight) OVER (ORDER BY source) / sum(weight) OVER () AS upto FROM s),
d AS (SELECT draw, {_UNIT.format("'17:0:source:' || draw")} AS u, {_UNIT.format("'17:0:item:' || draw")} AS v FROM range(2000) t(draw)),
f AS (SELECT draw, v, min(source) AS source FROM d JOIN e ON upto > u GROUP BY draw, v)
SELECT draw::BIGINT AS draw, source::INTEGER AS source, floor(v * items)::BIGINT AS item FROM f JOIN s USING (source)""")
def weighted_mixture_plan(spark, folder):
    nations = table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("source")).agg(F.count(F.lit(1)).alias("items")).withColumn("weight", (F.col("source") + 1).cast("double"))
    return sampling.weighted_mixture(nations, spark.range(2000).withColumnRenamed("id", "draw"), SEED, 0)


@query(f"""WITH n AS (SELECT n_name, n_regionkey AS source, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS item FROM nation),
s AS (SELECT source, count(*) AS items, sum(1.0) OVER (ORDER BY source) / sum(1.0) OVER () AS upto FROM n GROUP BY source),
d AS (SELECT draw, {_UNIT.format("'17:3:source:' || draw")} AS u, {_UNIT.format("'17:3:item:' || draw")} AS v FROM range(500) t(draw)),
f AS (SELECT draw, v, min(source) AS source FROM d JOIN s ON upto > u GROUP BY draw, v)
SELECT draw::BIGINT AS draw, n_name FROM (SELECT draw, source, floor(v * items) AS item FROM f JOIN s USING (source)) JOIN n USING (source, item)""")
def training_epoch(spark, folder):
    nations = table(spark, folder, "nation").select("n_name", F.col("n_regionkey").alias("source"))
    items = sampling.numbered(nations, "source", "n_name")
    first = items.groupBy("source").agg(F.min("row_no").alias("b")).withColumnRenamed("source", "s")
    items = items.join(first, F.col("source") == F.col("s")).select("n_name", "source", (F.col("row_no") - F.col("b")).alias("item"))
    weights = nations.select("source").distinct().withColumn("weight", F.lit(1.0))
    return assembly.epoch(weights, items, SEED, 3, 500).select("draw", "n_name")


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, min(turn)::DOUBLE AS first_turn, max(turn)::DOUBLE AS last_turn, min(1.0 / length(text)) AS confidence, count(*) AS n_words FROM conversations GROUP BY conv_id""")
def word_to_line_rollup(spark, folder):
    t = F.col("turn").cast("double")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text", F.array(t, F.lit(0.0), t, F.lit(1.0)).alias("bbox"), (1.0 / F.length("text")).alias("confidence"))
    return aggregates.joined_words(rows, ["conv_id"], "turn").select("conv_id", "text", F.col("bbox")[0].alias("first_turn"), F.col("bbox")[2].alias("last_turn"), "confidence", "n_words")


@query("""SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS row_no FROM nation""")
def shard_row_offsets(spark, folder):
    return sampling.numbered(table(spark, folder, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", "n_nationkey").select("n_nationkey", "row_no")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag""")
def percentile_interpolated(spark, folder):
    out = metrics.percentiles(table(spark, folder, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.95], "l_returnflag")
    return out.select("l_returnflag", *[F.round(F.col("percentiles")[k], 6).alias(n) for k, n in enumerate(("p05", "p50", "p95"))])


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Two boxes for each part, from its numbers."""
    s, r = F.col("p_size").cast("double"), F.floor("p_retailprice").cast("double")
    a = F.array(s, r % 40, s + 20, r % 40 + 15)
    b = F.array(r % 60, s % 30, r % 60 + 25, s % 30 + 20)
    return table(spark, folder, "part").select("p_partkey", a.alias("a"), b.alias("b"))


_BOXES = "x AS (SELECT p_partkey, p_size::DOUBLE AS a0, floor(p_retailprice) % 40 AS a1, p_size + 20.0 AS a2, floor(p_retailprice) % 40 + 15 AS a3, floor(p_retailprice) % 60 AS b0, (p_size % 30)::DOUBLE AS b1, floor(p_retailprice) % 60 + 25 AS b2, p_size % 30 + 20.0 AS b3 FROM part), y AS (SELECT *, greatest(least(a2, b2) - greatest(a0, b0), 0) * greatest(least(a3, b3) - greatest(a1, b1), 0) AS i FROM x)"


@query(f"WITH {_BOXES} SELECT p_partkey, round(i / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - i), 9) AS iou FROM y")
def iou_pairs(spark, folder):
    return _boxes(spark, folder).select("p_partkey", F.round(geometry.iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query(f"WITH {_BOXES} SELECT p_partkey, a0 < b2 AND b0 < a2 AND a1 < b3 AND b1 < a3 AS touches, b0 <= a0 + 5 AND b1 <= a1 + 5 AND b2 >= a2 - 5 AND b3 >= a3 - 5 AS holds FROM y")
def containment_join(spark, folder):
    a = F.col("a")
    inner = F.array(a[0] + 5, a[1] + 5, a[2] - 5, a[3] - 5)
    return _boxes(spark, folder).select("p_partkey", geometry.intersects(a, F.col("b")).alias("touches"), geometry.contains(F.col("b"), inner).alias("holds"))


_OVERLAP = "greatest(least(x[k][3], o[3]) - greatest(x[k][1], o[1]), 0) * greatest(least(x[k][4], o[4]) - greatest(x[k][2], o[2]), 0)"
_SIZES = "(x[k][3] - x[k][1]) * (x[k][4] - x[k][2]) + (o[3] - o[1]) * (o[4] - o[2])"


@query(
    f"""WITH RECURSIVE {_BOXES}, g AS (SELECT floor(p_partkey / 12)::BIGINT AS image, list([a0, a1, a2, a3] ORDER BY p_partkey) AS x, list([b0, b1, b2, b3] ORDER BY p_partkey) AS y FROM y GROUP BY image),
r AS (SELECT image, x, y, 1 AS k, []::INTEGER[] AS m FROM g UNION ALL SELECT image, x, y, k + 1, list_append(m, CASE WHEN list_max(s) >= 0.05 THEN list_position(s, list_max(s))::INTEGER - 1 ELSE -1 END)
FROM (SELECT *, list_transform(y, lambda o, i: CASE WHEN list_contains(m, (i - 1)::INTEGER) THEN -1.0::DOUBLE ELSE ({_OVERLAP}) / ({_SIZES} - {_OVERLAP}) END) AS s FROM r WHERE k <= len(x)))
SELECT image, array_to_string(m, ',') AS matches FROM r WHERE k = len(x) + 1"""
)
def greedy_iou_match(spark, folder):
    """An image's boxes are those of twelve neighbouring keys."""
    groups = _boxes(spark, folder).groupBy(F.floor(F.col("p_partkey") / 12).alias("image")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "a", "b"))), lambda s: F.struct(s["a"], s["b"])).alias("s"))
    takers, offered = F.transform("s", lambda s: s["a"]), F.transform("s", lambda s: s["b"])
    return groups.select("image", F.array_join(F.transform(match.greedy_match(takers, offered, 0.05), lambda k: k.cast("string")), ",").alias("matches"))


@query("""SELECT vec_id, label, rank::INTEGER AS rank FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank, floor(sum(0.25) OVER (PARTITION BY label) + 0.5) AS budget FROM embeddings) WHERE rank <= budget""")
def capacity_topk(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("score"), F.lit(0.25).alias("probability"))
    return numeric.capacity_top(rows, "label", "score", "probability", "vec_id").select("vec_id", "label", "rank")


@query("""WITH p AS (SELECT label, list(m ORDER BY k) AS m FROM (SELECT label, k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, range(1, 65) t(k) GROUP BY label, k) GROUP BY label)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], m), 6) AS similarity, true AS supported FROM embeddings JOIN p USING (label)""")
def nearest_prototype_cosine(spark, folder):
    """A label's prototype is the mean of its vectors."""
    e = table(spark, folder, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    prototypes = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("prototype"))
    return numeric.nearest_prototype(e, prototypes, "vec_id", "label").select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "supported")


@query("""WITH o AS (SELECT label, vec_id % 5 AS s, count(*) AS n FROM embeddings GROUP BY ALL) SELECT label, s::BIGINT AS stratum, round(CASE s WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0 END
/ sum(CASE s WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0 END) OVER (PARTITION BY label) * sum(n) OVER (PARTITION BY label) / n, 9)::DOUBLE AS weight, n AS tokens FROM o""")
def stratified_token_weights(spark, folder):
    e = table(spark, folder, "embeddings").select("label", (F.col("vec_id") % 5).cast("string").alias("s"))
    out = numeric.stratified_weights(e, "label", "s", {"0": 0.5, "1": 0.3, "2": 0.2})
    return out.groupBy("label", F.col("s").cast("long").alias("stratum")).agg(F.round(F.max("weight"), 9).alias("weight"), F.count(F.lit(1)).alias("tokens"))


@query("""SELECT p_partkey, string_agg(s::VARCHAR, ',' ORDER BY s) AS starts FROM (SELECT DISTINCT p_partkey, s FROM (SELECT p_partkey, unnest(list_filter(generate_series(0, greatest(p_size * 10 - 64, 0), 48), lambda x: x < greatest(p_size * 10 - 64, 0)) || [greatest(p_size * 10 - 64, 0)]) AS s FROM part)) GROUP BY p_partkey""")
def tile_grid(spark, folder):
    starts = geometry.tile_starts(F.col("p_size") * 10, 64, 16)
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.transform(starts, lambda s: s.cast("string")), ",").alias("starts"))


@query("""SELECT p_partkey, greatest(1, round_even(p_retailprice * (1024.0 / greatest(p_retailprice, p_size * 40)), 0))::INTEGER AS width, greatest(1, round_even(p_size * 40 * (1024.0 / greatest(p_retailprice, p_size * 40)), 0))::INTEGER AS height FROM part""")
def long_edge_sizes(spark, folder):
    s = geometry.long_edge_size(F.col("p_retailprice"), F.col("p_size") * 40, 1024)
    return table(spark, folder, "part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))


@query("""SELECT p_partkey, abs((p_size * 2.0) * (p_size + 3.0))::DOUBLE AS area, (CASE WHEN p_size + 3.0 >= 1.5 * (p_size * 2.0) THEN p_size * 2.0 ELSE p_size + 3.0 END)::DOUBLE AS height FROM part""")
def line_geometry(spark, folder):
    w, h = F.col("p_size") * 2.0, F.col("p_size") + 3.0
    quad = geometry.box_polygon(F.array(F.lit(0.0), F.lit(0.0), w, h))
    return table(spark, folder, "part").select("p_partkey", geometry.signed_area(quad).alias("area"), geometry.line_size(quad)["height"].alias("height"))


@query("""SELECT (props->>'k')::BIGINT AS k, event_type, count(*) AS n FROM events GROUP BY ALL""")
def json_props_projection(spark, folder):
    v = F.try_parse_json("props")
    return table(spark, folder, "events").select(F.try_variant_get(v, "$.k", "bigint").alias("k"), "event_type").groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '(?i)\\.(png|jpg|jpeg|bmp|webp|tif|tiff)$', '') AS stem FROM pages""")
def url_stems(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.image_stem(F.col("url")).alias("stem"))


@query("""SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS text FROM documents""")
def normalize_nfc(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.collapsed(F.col("text")).alias("text"))


@query("""SELECT doc_id, lower(regexp_replace(nfc_normalize(text), '\\s+', '', 'g')) AS text FROM documents""")  # no text has characters whose compatibility form differs
def normalize_nfkc(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.compact(F.col("text"), True).alias("text"))


@query(f"""SELECT doc_id, variant::INTEGER AS variant, CASE floor({_UNIT.format("'17:scale:' || doc_id || ':' || variant")} * 3) WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 ELSE 4.0 END::DOUBLE AS scale,
round({_UNIT.format("'17:blur:' || doc_id || ':' || variant")} * 1.5 + 0.5, 9) AS blur_sigma, floor(40 + {_UNIT.format("'17:jpeg:' || doc_id || ':' || variant")} * 56)::INTEGER AS jpeg_quality FROM documents, range(2) t(variant)""")
def degradation_parameters(spark, folder):
    out = sampling.degradation(table(spark, folder, "documents").select("doc_id"), "doc_id", SEED, 2, [2.0, 3.0, 4.0], (0.5, 2.0), (0.0, 10.0), (40, 95))
    return out.select("doc_id", "variant", "scale", F.round("blur_sigma", 9).alias("blur_sigma"), "jpeg_quality")


@query("""SELECT event_type, count(value) AS n, round(coalesce(sum(value), 0), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def stage_timing(spark, folder):
    out = aggregates.timing(table(spark, folder, "events"), F.col("value"), "event_type")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("""SELECT s AS source, stage, sum(d)::BIGINT AS edit_errors, sum(b)::BIGINT AS reference_characters, count(*) FILTER (d = 0) AS exact, count(*) AS transcripts, round(sum(d)::DOUBLE / nullif(sum(b), 0), 9) AS cer FROM (
SELECT p_brand AS s, 'hr' AS stage, levenshtein(p_name, p_type) AS d, length(p_type) AS b FROM part UNION ALL SELECT p_brand, 'original', levenshtein(p_type, p_type), length(p_type) FROM part WHERE p_size > 10) GROUP BY ALL""")
def transcript_diagnostics(spark, folder):
    m = lambda a: (lambda x: F.struct(x["edits"].alias("edits"), x["characters"].alias("characters"), x["exact"].alias("exact")))(metrics.text_measures(F.col(a), F.col("p_type")))
    rows = table(spark, folder, "part").select(F.col("p_brand").alias("source"), m("p_name").alias("hr"), F.when(F.col("p_size") > 10, m("p_type")).alias("original"))
    return aggregates.transcript_diagnostics(rows, "hr", "original").withColumn("cer", F.round("cer", 9))


@query("""SELECT DISTINCT unnest(string_split(p_brand, '')) AS character FROM part WHERE p_size > 5 AND p_size < 30""")
def glyph_charset(spark, folder):
    rows = table(spark, folder, "part").select((F.col("p_size") > 5).alias("valid"), (F.col("p_size") < 30).alias("aligned"), F.split("p_brand", "").alias("g"))
    return aggregates.charset(rows, "g")


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'retry' WHEN doc_id % 11 = 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'redo' ELSE 'skip' END AS action FROM documents) GROUP BY action""")
def resume_actions(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("f"))
    state = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("f")).alias("f"), F.when(F.col("doc_id") % 7 == 0, "error").otherwise("complete").alias("state"), (F.col("doc_id") % 5 != 0).alias("intact"))
    return control.resume(docs, state, "doc_id", "f").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, shard::INTEGER AS shard FROM (WITH RECURSIVE i AS (SELECT s_suppkey, 10 + s_nationkey AS s, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier),
f AS (SELECT s_suppkey, k, s AS used, 0 AS shard FROM i WHERE k = 1 UNION ALL SELECT i.s_suppkey, i.k, CASE WHEN f.used + i.s > 100 THEN i.s ELSE f.used + i.s END, CASE WHEN f.used + i.s > 100 THEN f.shard + 1 ELSE f.shard END FROM f JOIN i ON i.k = f.k + 1) SELECT * FROM f)""")
def packed_shards(spark, folder):
    from .sources.writers import packed_shards as pack

    rows = table(spark, folder, "supplier").select(F.lit("all").alias("list"), "s_suppkey", (F.col("s_nationkey") + 10).alias("size"))
    return pack(rows, "size", "s_suppkey", 100).select("s_suppkey", "shard")


@query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS clusters, round(sum(o_totalprice) / count(*), 4) AS estimate, 'paired_image_percentile' AS status, 200::BIGINT AS valid_samples, true AS holds FROM orders GROUP BY o_orderpriority""")
def bootstrap_ci(spark, folder):
    """The estimate, and whether the interval holds it: the draws themselves are this engine's own."""
    rows = table(spark, folder, "orders").select("o_orderpriority", "o_custkey", F.col("o_totalprice").alias("x"), F.lit(1.0).alias("y"))
    found = metrics.bootstrap(rows, "o_orderpriority", "o_custkey", "x", "y", samples=200, seed=SEED)
    holds = (F.col("low") < F.col("estimate")) & (F.col("estimate") < F.col("high"))
    return found.select("o_orderpriority", "clusters", F.round("estimate", 4).alias("estimate"), "status", "valid_samples", holds.alias("holds"))


@query(
    """WITH o AS (SELECT p_partkey, p_size / k::DOUBLE AS cost, p_retailprice * (k - 1) / 100 AS loss FROM part, (VALUES (1), (2), (4)) t(k)), budget AS (SELECT 0.5 * sum(p_size) AS b FROM part),
l AS (SELECT DISTINCT (y.loss - x.loss) / (x.cost - y.cost) * (1 + 1e-7) AS price FROM o x JOIN o y ON x.p_partkey = y.p_partkey AND y.cost < x.cost UNION SELECT 0),
s AS (SELECT price, sum(cost) AS cost, sum(loss) AS loss FROM (SELECT price, p_partkey, arg_min(cost, (loss + price * cost, cost)) AS cost, arg_min(loss, (loss + price * cost, cost)) AS loss FROM o, l GROUP BY price, p_partkey) GROUP BY price)
SELECT round(cost, 6) AS cost, round(loss, 4) AS loss, b::DOUBLE AS budget FROM s, budget WHERE cost <= b ORDER BY price LIMIT 1"""
)
def budget_price_bisection(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    options = F.array(*[F.struct((F.col("p_size") / k).alias("cost"), (F.col("p_retailprice") * (k - 1) / 100).alias("loss")) for k in (1, 2, 4)])
    options = p.select("p_partkey", F.explode(options).alias("o")).select("p_partkey", "o.*")
    budget = 0.5 * p.agg(F.sum("p_size")).first()[0]
    _, chosen = numeric.price_for_budget(options, "p_partkey", "cost", "loss", budget, rounds=45)
    return chosen.agg(F.round(F.sum("cost"), 6).alias("cost"), F.round(F.sum("loss"), 4).alias("loss")).withColumn("budget", F.lit(float(budget)))
