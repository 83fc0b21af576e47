"""Strict alignment of runs and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .control import require_empty, require_unique


def alignment_audit(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per key, in how many runs it is and in which (``present``, an array of booleans): one grouping of the tagged union, no chain of outer joins."""
    tagged = reduce(DataFrame.unionByName, [r.select(*keys).withColumn("__run", F.lit(k)) for k, r in enumerate(runs)])
    return tagged.groupBy(*keys).agg(*[F.max(F.col("__run") == k).alias(f"run_{k}") for k in range(len(runs))]).withColumn("n_runs", sum((F.col(f"run_{k}").cast("int") for k in range(1, len(runs))), F.col("run_0").cast("int")))


def exclusions(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of each run that not all runs have: run, excluded."""
    audit = alignment_audit(runs, keys).where(F.col("n_runs") < len(runs))
    counts = audit.agg(*[F.count_if(F.col(f"run_{k}")).alias(f"run_{k}") for k in range(len(runs))])
    return counts.select(F.posexplode(F.array(*[F.col(f"run_{k}") for k in range(len(runs))])).alias("run", "excluded"))


def close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-4) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def quads_close(a: Column, b: Column) -> Column:
    """Whether all corners are close; true where either is missing, which is unverified and not unequal."""
    return F.when(a.isNull() | b.isNull(), True).otherwise((F.size(a) == F.size(b)) & F.forall(F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: F.coalesce(close(x, y), F.lit(False))), lambda x: x))


def aligned(students: list[DataFrame], teachers: list[DataFrame], keys: list[str], allow_intersection: bool = False) -> DataFrame:
    """Student and teacher rows by key, one row a run: keys, run, label, norm_label, label_length, size, student, teacher.

    One teacher serves all students, or each has its own. Keys are unique in each run. Unless ``allow_intersection``, all runs have to have
    the same keys. Rows of a key must agree in label, size, and, as far as they have them, quad and image size.
    ``student`` and ``teacher`` are the rows' ``pred`` structs. One grouping of the tagged union does all: rows that break a rule
    raise an error when they are computed, and nothing is computed before.
    """
    if len(teachers) not in (1, len(students)):
        raise ValueError("one teacher or one for each student is needed")
    every = [*students, *teachers]
    fields = ["label", "norm_label", "size", "quad", "sr_size", "pred"]
    tagged = reduce(DataFrame.unionByName, [r.select(*keys, F.lit(k).alias("__run"), F.struct(*fields).alias("__row")) for k, r in enumerate(every)])
    runs = range(len(every))
    own = lambda k: F.col("__run") == k
    found = tagged.groupBy(*keys).agg(
        *[F.count_if(own(k)).alias(f"__n{k}") for k in runs],
        *[F.any_value(F.when(own(k), F.col("__row")), True).alias(f"__r{k}") for k in runs],
    )
    twice = reduce(lambda a, b: a | b, [F.col(f"__n{k}") > 1 for k in runs])
    whole = reduce(lambda a, b: a & b, [F.col(f"__n{k}") == 1 for k in runs])
    others, first = F.array(*[F.col(f"__r{k}") for k in runs]), F.col("__r0")
    quads = F.filter(F.transform(others, lambda o: o["quad"]), lambda q: q.isNotNull())
    checks = {
        "label": F.forall(others, lambda r: r["norm_label"].eqNullSafe(first["norm_label"])),
        "size": F.forall(others, lambda r: F.coalesce(close(r["size"], first["size"]), F.lit(False))),
        "quad": F.forall(others, lambda r: quads_close(r["quad"], F.get(quads, F.lit(0)))),
        "sr_size": F.size(F.array_distinct(F.filter(F.transform(others, lambda r: r["sr_size"]), lambda s: s.isNotNull()))) <= 1,
    }
    differs = F.coalesce(*[F.when(whole & ~ok, f"runs differ in {name}") for name, ok in checks.items()])
    gap = F.when(~whole & F.lit(not allow_intersection), "keys that not all runs have")
    fault = F.coalesce(F.when(twice, f"duplicate {', '.join(keys)}"), gap, differs)
    message = F.concat(fault, F.lit(": "), F.to_json(F.struct(*keys)))
    kept = found.where(F.when(fault.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(whole))
    n = len(students)
    pair = lambda k: F.struct(F.lit(k).alias("run"), F.col(f"__r{k}.pred").alias("student"), F.col(f"__r{n + (k if len(teachers) > 1 else 0)}.pred").alias("teacher"))
    out = kept.select(
        *keys,
        first["label"].alias("label"),
        first["norm_label"].alias("norm_label"),
        F.length(first["norm_label"]).alias("label_length"),
        first["size"].alias("size"),
        F.explode(F.array(*[pair(k) for k in range(n)])).alias("__p"),
    )
    return out.select("*", "__p.*").drop("__p")


def paired_rows(rows: DataFrame) -> DataFrame:
    """Aligned rows with the measures that paired metrics sum."""
    def side(who: str) -> list[Column]:
        text = F.col(f"{who}.norm_text")
        edits = F.coalesce(F.col(f"{who}.edit_distance"), F.levenshtein(F.coalesce(text, F.lit("")), F.col("norm_label")))
        longer = F.greatest(F.length(text), F.col("label_length"))
        return [edits.alias(f"{who}_edits"), (edits == 0).cast("int").alias(f"{who}_correct"), F.when(text.isNotNull(), F.coalesce(F.try_divide(edits, longer), F.lit(0.0))).alias(f"{who}_distance")]

    out = rows.select("*", *side("teacher"), *side("student"))
    return out.withColumn("joint_correct", F.col("teacher_correct") * F.col("student_correct"))


def matched(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """An inner join in which every left row must have a partner."""
    require_unique(right, key)
    require_empty(left.join(right, key, "left_anti").select(key), f"{what} without a match")
    return left.join(right, key)


def loosely_matched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A left join, and how many keys of either side have no partner, to warn of."""
    sides = alignment_audit([left, right], [key])
    return left.join(right, key, "left"), sides.agg(F.count_if(~F.col("run_1")).alias("left_only"), F.count_if(~F.col("run_0")).alias("right_only"))


def evidence_matched(evidence: DataFrame, annotations: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Evidence with the annotation of its key, which must have its transcript and coordinates."""
    a = annotations.select(*keys, F.col("norm_label").alias("__label"), F.col("quad").alias("__quad"), *[c for c in annotations.columns if c not in (*keys, "norm_label", "quad")])
    near = F.forall(F.zip_with(F.flatten("quad"), F.flatten("__quad"), lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda x: x)
    same = (F.col("norm_label") == F.col("__label")) & (F.size(F.flatten("quad")) == F.size(F.flatten("__quad"))) & near
    return evidence.join(a, keys).where(same).drop("__label", "__quad")


def check_membership(evaluated: DataFrame, train: DataFrame, excluded: DataFrame, key: str) -> None:
    """Evaluated ones are in the training list, none is excluded, and the lists are apart."""
    require_empty(evaluated.select(key).distinct().join(train, key, "left_anti"), "outside the training list")
    require_empty(evaluated.select(key).distinct().join(excluded, key, "left_semi"), "evaluated but excluded")
    require_empty(train.select(key).distinct().join(excluded, key, "left_semi"), "both trained on and excluded")


def hard_cases(rows: DataFrame, largest: float, least_score: float) -> DataFrame:
    """Lines that the teacher reads and the student does not, small and sure enough, and not marked as unfit."""
    flag = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    return rows.where((F.col("teacher_correct") == 1) & (F.col("student_correct") == 0) & (F.col("size") < largest) & (flag("score", 0.0) >= least_score) & flag("valid", True) & ~flag("ignore", False) & ~flag("difficult", False) & flag("alignment_valid", True))


def mining_report(rows: DataFrame, name: str) -> DataFrame:
    """One row: lines, images, aligned lines, and a digest of the images' sorted names.

    The digest needs the distinct names of the images that have a hard case in one row; a list of these is what the report is for.
    """
    each = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count_if("alignment_valid").alias("a"))
    names = F.sha2(F.array_join(F.array_sort(F.collect_list(name)), "\n"), 256)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return each.agg(total("n")("lines"), total("a")("aligned_lines"), F.count(name).alias("images"), names.alias("names_sha256"))
