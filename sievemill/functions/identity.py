"""Identity: keys, digests, splits and seeds from SHA-256, all in the JVM (H1 to H8)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import json_list


def sample_key(source: Column, name: Column) -> Column:
    """SHA-256 of the JSON list of source and id."""
    return F.sha2(json_list(source, name), 256)


def _word(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10)


def unit(seed: int, text: Column) -> Column:
    """A number in [0, 1) from the seed and a text: the first 52 bits of a digest, which doubles hold exactly."""
    return _word(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 13).cast("double") / F.lit(float(1 << 52))


def split(group: Column, seed: int, validation: float) -> Column:
    """"validation" or "train"; equal groups go together. A null group is in neither."""
    return F.when(group.isNull(), None).when(unit(seed, group) < validation, "validation").otherwise("train")


def seed64(*parts: Column) -> Column:
    """An unsigned 64-bit seed from parts joined by colons, as a decimal: a long can't hold it."""
    return _word(F.sha2(F.concat_ws(":", *parts), 256), 16).cast("decimal(20,0)")


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def pixel_digest(width: Column, height: Column, rgb: Column) -> Column:
    """Digest of decoded pixels with their shape in front, so that equal bytes of other shapes differ."""
    return F.sha2(F.concat(F.concat_ws(":", F.lit("RGB"), width, height, F.lit("")).cast("binary"), rgb), 256)


def fingerprint(*parts: Column) -> Column:
    """Digest of a record's parts, nulls told from empty texts; says whether a finished row is still that row."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]), 256)


def manifest_fingerprint(files: DataFrame) -> DataFrame:
    """One row: fingerprint of (name, kind, path, size, mtime) rows in any order. Partial digests a name keep what is sorted small."""
    line = F.concat_ws("\t", "name", "kind", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))
    per = files.groupBy("kind", "name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "kind", "name", "d"))), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("names"))


def config_hash(config: dict) -> str:
    """Digest of a configuration as canonical JSON, for run identity."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def crop_key(seed: int, epoch: Column, index: Column) -> Column:
    """A seed for draws of one sample, independent of workers."""
    return seed64(F.lit(str(seed)), epoch.cast("string"), index.cast("string"))


def code_hash(folder: str, packages: tuple[str, ...] = ()) -> str:
    """Digest of all source files below a folder, by their names in it, and of the versions of packages: what a run's results depend on beside its configuration (H6)."""
    import hashlib
    from importlib.metadata import PackageNotFoundError, version
    from pathlib import Path

    out = hashlib.sha256()
    for file in sorted(Path(folder).rglob("*.py")):
        out.update(f"{file.relative_to(folder).as_posix()}\n{hashlib.sha256(file.read_bytes()).hexdigest()}\n".encode())
    for name in sorted(packages):
        try:
            out.update(f"{name}=={version(name)}\n".encode())
        except PackageNotFoundError:
            out.update(f"{name} is absent\n".encode())
    return out.hexdigest()
