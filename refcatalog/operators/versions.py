"""Tables kept as numbered versions: a write adds one or leaves everything as it was.

A version is a file ``versions/<number>`` that names its data; the data itself
lies in a folder of its own and is never changed. The file is made last and only
if no other has that number, so readers see the old version or the new one whole.
A writer says which version it started from, and is refused if that is no longer
the latest one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Outdated(RuntimeError):
    """Another run has written a version meanwhile."""


def _files(spark: SparkSession, path: str):
    names = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = lambda *x: names.Path("/".join([path.rstrip("/"), *x]))
    return at, at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> dict[int, dict | None]:
    """What each version's file says; None for one that was not finished."""
    at, files = _files(spark, path)
    if not files.exists(at("versions")):
        return {}
    out = {}
    for status in files.listStatus(at("versions")):
        name = status.getPath().getName()
        if name.isdigit():
            text = "".join(spark.read.text(f"{path.rstrip('/')}/versions/{name}").toPandas().value) if status.getLen() else ""
            out[int(name)] = json.loads(text) if text.endswith("}") else None
    return out


def latest(spark: SparkSession, path: str) -> int:
    """Number of the latest version; 0 before the first."""
    return max((n for n, said in _numbers(spark, path).items() if said), default=0)


def read_version(spark: SparkSession, path: str, number: int | None = None) -> tuple[DataFrame, int]:
    """(rows, number) of a version, of the latest if none is given; an unknown one is an error."""
    known = {n: said for n, said in _numbers(spark, path).items() if said}
    number = max(known, default=0) if number is None else number
    if number not in known:
        raise ValueError(f"{path} has no version {number}")
    return spark.read.parquet(f"{path.rstrip('/')}/{known[number]['data']}"), number


def write_version(df: DataFrame, path: str, based_on: int | None = None, partition_by: list[str] | None = None) -> int:
    """Adds ``df`` as the next version and gives its number; ``based_on`` (if given) must still be the latest one, which is looked up before the work and again after it."""
    spark = df.sparkSession
    at, files = _files(spark, path)
    started = latest(spark, path)
    if based_on is not None and started != based_on:
        raise Outdated(f"{path}: version {started} is the latest, not {based_on}")
    data = f"data/{uuid.uuid4().hex}"
    writer = df.write if partition_by is None else df.write.partitionBy(*partition_by)
    writer.parquet(f"{path.rstrip('/')}/{data}")
    known = _numbers(spark, path)
    if max((n for n, said in known.items() if said), default=0) != started:
        files.delete(at(data), True)
        raise Outdated(f"{path}: another version than {started} was written meanwhile")
    number = max(known, default=0) + 1
    files.mkdirs(at("versions"))
    try:
        out = files.create(at("versions", f"{number:010d}"), False)  # fails if it is there
    except Exception as e:
        files.delete(at(data), True)
        raise Outdated(f"{path}: version {number} was written meanwhile") from e
    out.write(bytearray(json.dumps({"data": data, "based_on": started}).encode()))
    out.close()
    return number


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes all but the ``keep`` latest versions, and data that no version names; gives the numbers removed. Not to be run beside a writer."""
    at, files = _files(spark, path)
    known = _numbers(spark, path)
    kept = sorted((n for n, said in known.items() if said), reverse=True)[: max(1, keep)]
    gone = sorted(set(known) - set(kept))
    for n in gone:
        files.delete(at("versions", f"{n:010d}"), False)
    named = {known[n]["data"].split("/")[1] for n in kept}
    if files.exists(at("data")):
        for status in files.listStatus(at("data")):
            if status.getPath().getName() not in named:
                files.delete(status.getPath(), True)
    return gone
