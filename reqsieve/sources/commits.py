"""Numbered commits: a folder of small JSON files, each the whole state after one change.

A commit is written under a name of its own and then renamed to its number; a number that is
taken is never overwritten, so of two writers one sees the other's commit and starts again
from it. Readers take the highest number, so they see a change whole or not at all. Object
stores without an atomic rename need a single writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def children(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, modification time in seconds) of what is in a folder; none if there is no folder."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in fs.listStatus(at)]


def numbers(spark: SparkSession, folder: str) -> list[int]:
    names = [name.removesuffix(".json") for name, _ in children(spark, folder) if name.endswith(".json")]
    return sorted(int(n) for n in names if n.isdigit())


def _file(folder: str, n: int) -> str:
    return f"{folder.rstrip('/')}/{n:012d}.json"


def read(spark: SparkSession, folder: str, n: int) -> dict:
    fs, at = _fs(spark, _file(folder, n))
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The highest number and its state; 0 and None where nothing was committed."""
    found = numbers(spark, folder)
    return (found[-1], read(spark, folder, found[-1])) if found else (0, None)


def publish(spark: SparkSession, folder: str, n: int, state: dict) -> bool:
    """Commit ``state`` as number ``n``; False if that number is taken."""
    sc = spark.sparkContext
    target, draft = _file(folder, n), f"{folder.rstrip('/')}/.draft-{uuid.uuid4().hex}"
    fs, to = _fs(spark, target)
    if fs.exists(to):
        return False
    at = sc._jvm.org.apache.hadoop.fs.Path(draft)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(json.dumps(state, ensure_ascii=False).encode()))
    finally:
        stream.close()
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    # Without options a rename fails where the target exists.
    none = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(at, to, none)
    except Py4JJavaError:
        fs.delete(at, False)
        if fs.exists(to):
            return False
        raise
    return True


def change(
    spark: SparkSession, folder: str, update: Callable[[dict | None], dict | None], attempts: int = 50
) -> dict | None:
    """Commit ``update(newest state)``, again from the newest where another writer came first.

    ``update`` returns None for no change; it may run more than once.
    """
    for _ in range(attempts):
        n, state = newest(spark, folder)
        changed = update(state)
        if changed is None:
            return state
        if publish(spark, folder, n + 1, changed):
            return changed
    raise RuntimeError(f"{attempts} writers came first in {folder}")


def trim(spark: SparkSession, folder: str, keep: int = 20) -> None:
    """Remove all but the newest commits."""
    for n in numbers(spark, folder)[:-keep]:
        delete(spark, _file(folder, n))
