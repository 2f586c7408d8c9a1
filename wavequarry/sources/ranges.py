"""Files listed by Spark and read in parts, each where it is needed: no row and no task holds a whole file (IO1, IO2).

Spark lists the files and deals the parts; a task opens the file at its place. Local paths are opened as such and must be
shared by all executors; other addresses (s3, gs, hdfs, abfs) are opened by pyarrow's file systems, and one that these don't know is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

#: Other names of a scheme.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Bytes that are worth a task of their own.
LEAST = 1 << 20


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path, length)`` of the files below ``path`` whose name fits ``pattern``; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


@contextmanager
def opened(path: str) -> Iterator[IO[bytes]]:
    """The file at a path or address, as it stands in ``listed``; it can be sought in."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme is None or scheme == "file":
        with open("/" + rest.lstrip("/") if scheme else rest, "rb") as f:
            yield f
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/:@')}")
    with system.open_input_file(at) as f:
        yield f


def read_part(path: str, begin: int, end: int) -> bytes:
    """Bytes from ``begin`` to ``end``, or to the file's end."""
    with opened(path) as f:
        f.seek(begin)
        return f.read(end - begin)


def dealt(parts: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """``parts`` over as many partitions as the bytes of ``files(length)`` are worth: rows say little of the work behind them, so their number is set here and not by their size."""
    spark = parts.sparkSession
    total = files.groupBy().sum("length").first()[0] or 0
    most = int(re.sub(r"\D", "", spark.conf.get("spark.sql.files.maxPartitionBytes")) or 0)
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")[-1:], 1)
    count = max(total // max(LEAST, most * unit), min(spark.sparkContext.defaultParallelism, total // LEAST)) + 1
    return parts.repartition(count, *keys)
