"""Numbered records: small JSON files whose names are consecutive numbers, each written once.

The newest complete record is the current one, so publishing is one exclusive file creation on the
shared store: readers see the state before or after it. A record that its writer did not finish (driver
lost) does not parse and is skipped; its number stays used. Of two writers that take the same number one
is refused (``ConflictError``) and may start again from the newer state.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAME = re.compile(r"^v-([0-9]{12})\.json$")


class ConflictError(RuntimeError):
    pass


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as its own type."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, where = file_system(spark, folder)
    if not fs.exists(where):
        return []
    names = (_NAME.match(st.getPath().getName()) for st in fs.listStatus(where))
    return sorted(int(m[1]) for m in names if m)


def get(spark: SparkSession, folder: str, number: int) -> dict | None:
    """A record, or None if its writer did not finish it."""
    fs, where = file_system(spark, f"{folder}/v-{number:012d}.json")
    stream = fs.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    for n in reversed(numbers(spark, folder)):
        record = get(spark, folder, n)
        if record is not None:
            return n, record
    return None


def put(spark: SparkSession, folder: str, number: int, record: dict) -> None:
    fs, where = file_system(spark, f"{folder}/v-{number:012d}.json")
    try:
        stream = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(where):
            raise ConflictError(f"version {number} exists in {folder}") from None
        raise
    try:
        stream.write(bytearray(json.dumps(record, separators=(",", ":")).encode()))
    finally:
        stream.close()


def update(spark: SparkSession, folder: str, change: Callable[[dict | None], dict | None], attempts: int = 10) -> int:
    """Publish ``change(current record)`` as the next version; None from ``change`` publishes nothing.
    Where another writer was faster, ``change`` is called again with that writer's record."""
    for _ in range(attempts):
        used = numbers(spark, folder)
        current = latest(spark, folder)
        record = change(current[1] if current else None)
        if record is None:
            return current[0] if current else 0
        number = used[-1] + 1 if used else 1
        try:
            put(spark, folder, number, record)
            return number
        except ConflictError:
            continue
    raise ConflictError(f"no version published in {folder} after {attempts} attempts")
