"""Configurations: closed schemas, inheritance, precedence, identity, run folders."""

from __future__ import annotations

import contextlib
import json
import math
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from .functions.identity import config_hash


def number(value, name: str, low: float = -math.inf, high: float = math.inf, whole: bool = False) -> float:
    """A finite number within bounds; booleans are no numbers."""
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not math.isfinite(value) or not low <= value <= high:
        raise ValueError(f"{name} has to be {'a whole number' if whole else 'a number'} from {low} to {high}")
    return value


def merged(defaults: dict, given: dict, open_keys: tuple[str, ...] = (), path: str = "") -> dict:
    """``defaults`` with what is given; a key that they don't have is an error, except below ``open_keys``."""
    out = dict(defaults)
    for key, value in given.items():
        at = f"{path}{key}"
        if key not in defaults and path.rstrip(".") not in open_keys:
            raise ValueError(f"unknown setting {at}")
        out[key] = merged(defaults[key], value, open_keys, f"{at}.") if isinstance(defaults.get(key), dict) and isinstance(value, dict) and at not in open_keys else value
    return out


def inherited(path: str | Path, read: Callable[[str], dict] = json.loads, _seen: tuple = ()) -> dict:
    """A configuration file on top of those that its ``_base_`` names; cycles are an error."""
    path = Path(path).resolve()
    if path in _seen:
        raise ValueError(f"{path} is its own base")
    own = read(path.read_text())
    bases = own.pop("_base_", [])
    out: dict = {}

    def over(a: dict, b: dict) -> dict:
        return {**a, **{k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    for base in [bases] if isinstance(bases, str) else bases:
        out = over(out, inherited(path.parent / base, read, (*_seen, path)))
    return over(out, own)


def preferred(file_values: dict, line_values: dict) -> dict:
    """Values of the command line where they aren't None, else those of the file."""
    return {**file_values, **{k: v for k, v in line_values.items() if v is not None}}


def same_but(a: dict, b: dict, ignored: set[str]) -> bool:
    """Equal apart from some keys."""
    cut = lambda d: {k: v for k, v in d.items() if k not in ignored}
    return cut(a) == cut(b)


def check_run(folder: Path, config: dict, inputs: str) -> None:
    """Writes the run's identity, or fails where the folder has another one."""
    mine = {"schema_version": 1, "config": config_hash(config), "inputs": inputs}
    at = folder / "run.json"
    if at.exists():
        if json.loads(at.read_text()) != mine:
            raise ValueError(f"{folder} belongs to a run of another configuration or input")
        return
    folder.mkdir(parents=True, exist_ok=True)
    new = at.with_suffix(".tmp")
    new.write_text(json.dumps(mine))
    new.replace(at)


@contextlib.contextmanager
def single_writer(folder: Path) -> Iterator[None]:
    """Fails where another driver writes into the folder."""
    at = folder / "lock"
    try:
        os.close(os.open(at, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        raise RuntimeError(f"{folder} is being written to") from None
    try:
        yield
    finally:
        at.unlink()


def _file_system(spark, path: str):
    """A Hadoop path and its file system: what all drivers of a cluster see."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def check_shared_run(spark, folder: str, config: dict, inputs: str) -> None:
    """``check_run`` in a folder of any file system that Spark reaches: of two drivers that begin at once, only one writes the identity, and the other compares."""
    mine = json.dumps({"schema_version": 1, "config": config_hash(config), "inputs": inputs}, sort_keys=True)
    at, files = _file_system(spark, f"{folder.rstrip('/')}/run.json")
    try:
        stream = files.create(at, False)
    except Exception as e:
        if not files.exists(at):
            raise RuntimeError(f"{folder} can't be written to") from e
        found = "\n".join(r["value"] for r in spark.read.text(at.toString()).collect())  # one line
        if found != mine:
            raise ValueError(f"{folder} belongs to a run of another configuration or input") from None
        return
    stream.write(mine.encode())
    stream.close()


@contextlib.contextmanager
def single_shared_writer(spark, folder: str) -> Iterator[None]:
    """``single_writer`` on any file system whose creation of a file is exclusive."""
    at, files = _file_system(spark, f"{folder.rstrip('/')}/lock")
    try:
        created = files.createNewFile(at)
    except Exception as e:
        raise RuntimeError(f"{folder} can't be written to") from e
    if not created:
        raise RuntimeError(f"{folder} is being written to")
    try:
        yield
    finally:
        files.delete(at, False)


def new_folder(parent: Path, name: str | None = None) -> Path:
    """A folder that wasn't there: by time or name, with -1, -2 and so on after it where that is taken."""
    name = name or time.strftime("%Y%m%d-%H%M%S")
    parent.mkdir(parents=True, exist_ok=True)
    for k in range(10_000):
        try:
            (out := parent / (f"{name}-{k}" if k else name)).mkdir()
            return out
        except FileExistsError:
            continue
    raise RuntimeError(f"no free folder for {name}")
