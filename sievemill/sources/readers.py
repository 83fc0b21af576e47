"""Readers: manifests, listings, shards, nested JSON, annotations, details, lists, tables of words, tar shards."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import IMAGE_SUFFIXES, file_name, image_stem, split_limited
from ..operators.control import require_empty, require_unique
from ..operators.validate import manifest_error, required_text

REGION = "struct<polygon:array<array<double>>,bbox:array<double>,text:string,confidence:double,trusted:boolean,reliable:boolean>"
MANIFEST = f"id string, source string, group_id string, image_path string, hr_path string, annotations array<{REGION}>, iqa map<string,struct<size:array<int>,image_sha256:string,scores:map<string,double>>>, dataset map<string,string>"


def numbered_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Lines of text files: path, ``line_no`` from 1 within their file, blank ones counted, and value; without a byte order mark.

    A large file is read in blocks by many tasks; lines are numbered within their block, and counts of earlier blocks carry the
    numbers on. Files of another encoding than UTF-8, which can't be cut anywhere, are read whole, a row each.
    """
    if encoding:
        decoded = F.pandas_udf(lambda contents: contents.map(lambda c: c.decode(encoding)), "string")  # the JVM's decode knows few encodings
        files = spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("t"))
        return files.select("path", F.posexplode(F.split(F.regexp_replace("t", r"\r?\n$", ""), r"\r?\n")).alias("n", "value")).select("path", (F.col("n") + 1).cast("long").alias("line_no"), "value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    counts = lines.groupBy("path", "__block").agg(F.count(F.lit(1)).alias("__n"))
    ahead = W.partitionBy("path").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    base = counts.select(F.col("path").alias("__p"), F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    own = lines.withColumn("__r", F.row_number().over(W.partitionBy("path", "__block").orderBy("__id")))
    number = (F.col("__before") + F.col("__r")).cast("long")
    value = F.when(number == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return own.join(base, (F.col("path") == F.col("__p")) & (F.col("__block") == F.col("__b"))).select("path", number.alias("line_no"), value.alias("value"))


def region_faults(document: Column) -> Column:
    """Why regions of a manifest VARIANT have the wrong types, or null: ``from_json`` would null them in silence."""
    items = F.try_variant_get(document, "$.annotations", "array<variant>")
    given = F.variant_get(document, "$.annotations", "variant")
    kind = lambda v, path: F.schema_of_variant(F.variant_get(v, path, "variant"))
    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$"
    faults = F.transform(items, lambda v: F.coalesce(
        F.when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "region_not_an_object"),
        F.when(~F.coalesce(kind(v, "$.confidence"), F.lit("VOID")).rlike(number), "confidence_not_a_number"),
        F.when(~F.coalesce(kind(v, "$.text"), F.lit("VOID")).isin("STRING", "VOID"), "text_not_a_string"),
        *[F.when(~F.coalesce(kind(v, f"$.{flag}"), F.lit("VOID")).isin("BOOLEAN", "VOID"), f"{flag}_not_a_boolean") for flag in ("trusted", "reliable")],
    ))
    listed = F.when(given.isNotNull() & (F.schema_of_variant(given) != "VOID") & items.isNull(), "annotations_not_a_list")
    return F.coalesce(listed, F.get(F.array_compact(faults), F.lit(0)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records with path, line_no, raw text, the parsed ``record`` and ``error`` (S1, P1, P3). Blank lines are passed over.

    A line that is no record, lacks a field, or has a region with a field of the wrong type is an error row; one without source and
    id is keyed by its line, of source "unknown".
    """
    rows = numbered_lines(spark, path).where(F.length(F.trim("value")) > 0).withColumn("document", F.try_parse_json("value"))
    group = F.variant_get("document", "$.group_id", "variant")
    bad_group = F.when(group.isNotNull() & ~required_text(F.col("document"), "$.group_id"), "invalid_group_id")
    rows = rows.withColumn("__shape", manifest_error(F.col("document"))).withColumn("error", F.coalesce("__shape", bad_group, region_faults(F.col("document"))))
    rows = rows.withColumn("record", F.when(F.col("error").isNull(), F.from_json("value", MANIFEST)))
    named = lambda name, other: F.when(F.col("__shape").isNull(), F.try_variant_get("document", f"$.{name}", "string")).otherwise(other).alias(name)
    return rows.select("path", "line_no", "value", "error", "record", named("id", F.concat(F.lit("invalid_line_"), "line_no")), named("source", F.lit("unknown")))


def images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Image files by extension: path, name, stem, length, sorted on demand (S2, S3). Contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join([*IMAGE_SUFFIXES, *[s.upper() for s in IMAGE_SUFFIXES]]) + "}")
    found = reader.option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", file_name(F.col("path")).alias("name"), image_stem(F.col("path")).alias("stem"), "length", "modificationTime")


def relative_id(path: Column, root: str) -> Column:
    """The path below a root."""
    return F.regexp_replace(path, f"^.*{root.rstrip('/')}/", "")


def mirrored(low: DataFrame, high: DataFrame, key: str) -> DataFrame:
    """Low-resolution files with their high-resolution ones; a missing one is an error."""
    require_empty(low.join(high, key, "left_anti").select(key), "no high-resolution file")
    return low.join(high.select(key, F.col("path").alias("hr_path")), key)


def indexed_shards(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with ``row_no`` over all files in order of path (S4, W4): counts of earlier files and the row's own index, without a sort of rows."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__file", F.coalesce(F.sum("__n").over(W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row a file
    return rows.join(base, "__file").withColumn("row_no", F.col("__b") + F.col("__row")).withColumnRenamed("__file", "file").drop("__row", "__b")


def sampled_shards(spark: SparkSession, path: str, n: int, seed: int) -> DataFrame:
    """A uniform sample of rows over all shards, in their order."""
    from ..operators.sampling import sample_rows

    return sample_rows(indexed_shards(spark, path), "row_no", n, seed)


def json_items(spark: SparkSession, path: str, schema: str, field: str = "data_list") -> DataFrame:
    """Elements of one array in large JSON documents, with row_index (S5). ``schema`` is that of an element."""
    return spark.read.schema(f"{field} array<{schema}>").option("multiLine", "true").json(path).select(F.posexplode(field).alias("row_index", "item")).select("row_index", "item.*")


def refuse(requests: DataFrame, known_bad: DataFrame) -> DataFrame:
    """``requests`` (repo, revision, subset), or an error if one is on the list of known bad ones."""
    require_empty(requests.join(known_bad, ["repo", "revision", "subset"], "left_semi"), "known bad source")
    return requests


LABELS = "array<struct<transcription:string,points:array<array<double>>,difficult:boolean>>"


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of name, tab, JSON list: name, stem, annotations (S8). Bad JSON, fewer than four points or a name that comes twice are errors with the line."""
    rows = numbered_lines(spark, path).where(F.length(F.trim("value")) > 0)
    parts = split_limited(F.col("value"), "\t", 2)
    read = rows.select("path", "line_no", parts[0].alias("name"), F.from_json(parts[1], LABELS).alias("annotations"))
    require_empty(read.where(F.col("annotations").isNull() | F.exists("annotations", lambda a: F.coalesce(F.size(a["points"]) < 4, F.lit(True)))).select("path", "line_no"), "invalid annotations")
    read = read.withColumn("stem", image_stem(F.col("name")))
    return require_unique(read, "stem")


DETAIL = "image string, index int, label string, norm_label string, size double, quad array<array<double>>, sr_size array<int>, pred struct<text:string,norm_text:string,score:double,edit_distance:int>"


def details(spark: SparkSession, path: str, strip: tuple[str, ...] = ()) -> DataFrame:
    """OCR details by (stem, index), both together unique; two images of one stem are ambiguous."""
    from ..operators.validate import detail_error

    rows = spark.read.schema(DETAIL).json(path).withColumn("stem", image_stem(F.col("image"), strip))
    rows = rows.withColumn("error", F.coalesce(F.when(F.col("image").isNull() | F.col("index").isNull() | F.col("norm_label").isNull() | ~(F.col("size") > 0), "missing_field"), detail_error(F.col("quad"), F.col("sr_size"))))
    require_empty(rows.where("error IS NOT NULL").select("image", "index", "error"), "invalid detail")
    require_empty(rows.groupBy("stem").agg(F.count_distinct("image").alias("n")).where("n > 1"), "ambiguous stem")
    return require_unique(rows.drop("error"), "stem", "index")


LINE = "struct<quad:array<double>,points:array<double>,bbox:array<double>,box:array<double>,transcript:string,transcription:string,text:string,valid:boolean,difficult:boolean,ignore:boolean,alignment_valid:boolean,teacher_correct:boolean,glyphs:array<string>>"


def boxes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of boxes.json: image, stem, index, aligned, line.

    An image has a list, or an object with alignment_valid and lines; an element is an object, or numbers of a box or a quad, nested
    or flat. Two images of one stem are an error.
    """
    documents = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("d"))
    each = documents.select(F.explode(F.variant_get("d", "$", "map<string,variant>")).alias("image", "v"))
    is_list = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    lines = F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.lines", "array<variant>"))
    aligned = F.coalesce(F.when(is_list, True).otherwise(F.try_variant_get("v", "$.alignment_valid", "boolean")), F.lit(True))
    rows = each.select("image", image_stem(F.col("image")).alias("stem"), aligned.alias("aligned"), F.posexplode(lines).alias("index", "e"))
    require_empty(rows.groupBy("stem").agg(F.count_distinct("image").alias("n")).where("n > 1"), "ambiguous stem")
    numbers, points = F.try_variant_get("e", "$", "array<double>"), F.try_variant_get("e", "$", "array<array<double>>")
    flat = F.when(~F.exists(numbers, lambda x: x.isNull()), numbers).otherwise(F.flatten(points))
    line = F.when(flat.isNotNull(), F.from_json(F.to_json(F.struct(flat.alias("quad"))), LINE)).otherwise(F.try_variant_get("e", "$", LINE))
    return rows.select("image", "stem", "index", "aligned", line.alias("line"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """Stems of a list of names: the first tab field, comments and blank lines passed over; an empty list and a stem that comes twice are errors."""
    rows = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.startswith(F.ltrim("value"), F.lit("#")))
    out = rows.select(image_stem(F.trim(F.split("value", "\t")[0])).alias("stem"))
    if not out.limit(1).count():
        raise ValueError(f"no names in {path}")
    return require_unique(out, "stem")


def repeat_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path and repeat of a dataset list (S11). Without a repeat it is 1; a bad one is an error, or, not ``strict``, 1."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where(F.length("v") > 0)
    parts = F.split("v", ",")
    given = F.trim(F.element_at(parts, -1))
    out = rows.select(F.trim(parts[0]).alias("path"), F.when(F.size(parts) < 2, 1).otherwise(given.try_cast("int")).alias("repeat"))
    if strict:
        require_empty(out.where("repeat IS NULL OR repeat < 0"), "invalid repeat")
    return out.fillna(1, ["repeat"])


def legacy_annotations(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """Eight coordinates and a text that may have commas, by line: path, line_no, quad, text, malformed."""
    parts = split_limited(F.col("value"), ",", 9)
    numbers = F.transform(F.slice(parts, 1, 8), lambda x: F.trim(x).try_cast("double"))
    rows = numbered_lines(spark, path, encoding).where(F.length(F.trim("value")) > 0)
    bad = (F.size(parts) < 9) | F.exists(numbers, lambda x: x.isNull())
    quad = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.get(numbers, 2 * k), F.get(numbers, 2 * k + 1)))
    return rows.select("path", "line_no", F.when(~bad, quad).alias("quad"), F.when(~bad, parts[8]).alias("text"), bad.alias("malformed"))


TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of OCR tables: level 5, not blank, confidence from 0 on; as bbox and confidence in [0, 1]."""
    rows = spark.read.schema(TSV).csv(path, sep="\t", header=True, quote="").where("level = 5 AND conf >= 0").where(F.length(F.trim("text")) > 0)
    box = F.array(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height"))
    return rows.select("page_num", "block_num", "par_num", "line_num", "word_num", F.trim("text").alias("text"), box.alias("bbox"), (F.col("conf") / 100).alias("confidence"))


def adapted_glyphs(rows: DataFrame, least: float) -> DataFrame:
    """Lines and single-character glyphs of recognition results (S18): text, score, polygon, glyphs, skipped (groups of several characters). Lines below ``least`` go.

    ``rows``: rec_texts, rec_scores, rec_polys, text_word (array of arrays), text_word_region.
    """
    lines = rows.select("*", F.posexplode(F.arrays_zip("rec_texts", "rec_scores", "rec_polys", "text_word", "text_word_region")).alias("index", "l")).where(F.col("l.rec_scores") >= least)
    words = F.zip_with("l.text_word", "l.text_word_region", lambda w, r: F.struct(w.alias("character"), r.alias("region")))
    single = F.filter(words, lambda w: F.length(F.trim(w["character"])) == 1)
    return lines.select("index", F.col("l.rec_texts").alias("text"), F.col("l.rec_scores").alias("score"), F.col("l.rec_polys").alias("polygon"), single.alias("glyphs"), (F.size(words) - F.size(single)).alias("skipped"))


def tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar shards by sample key: shard, key, extension, content, error (S13). A shard is a task's unit; a broken one has a row that says where it ends."""

    def untar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for member in tar:
                            if member.isfile():
                                key, _, extension = member.name.partition(".")
                                rows.append((shard, key, extension, tar.extractfile(member).read(), None))
                except (tarfile.TarError, EOFError) as e:
                    rows.append((shard, None, None, None, f"broken after {len(rows)} members: {e}"))
                yield pd.DataFrame(rows, columns=["shard", "key", "extension", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(untar, "shard string, key string, extension string, content binary, error string")
