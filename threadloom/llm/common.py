"""What the operators of this subpackage share: storage all executors see, and numbering at scale."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of a text, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(1)
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="threadloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset a local one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/") if named else f"file://{_test_folder()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_caches: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """This Python worker's cache of that name, at the start of a task.

    A worker outlives tasks and operators: caches of other operators go, and what is free
    goes back to the system.
    """
    if name not in _caches:
        _caches.clear()
        _caches[name] = make()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return _caches[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each key group from 0 without gaps.

    A group may hold any share of all rows: it is dealt into buckets by a hash of the
    order columns, rows are numbered within a bucket, and the running total of the
    smaller buckets' counts is added. ``rows`` sets the number of buckets only.
    """
    n = max(partitions(df.sparkSession), rows // per_bucket)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        dealt.withColumn("_row", F.row_number().over(inner))
        .join(starts, [*keys, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_bucket", "_row", "_start")
    )


#: A null id in joins; it sorts after all others.
NO_ID = 2**63 - 1


def key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """_id (never null) and _hash (of the text): equal for equal rows only, up to hash collisions within an id."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash")]


def with_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, _id, _hash): df's columns in a struct, where no name of theirs can clash."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), *key(id_col, text_col))


def only(df: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """df's rows and columns whose key is in kept (_id, _hash); texts are shuffled once, unsorted.

    once: of several rows with one key the first stays, in the order of their other columns as JSON.
    """
    rows = with_key(df, id_col, text_col)
    if once:
        repeats = rows.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id", "_hash")
        if not repeats.isEmpty():
            others = F.to_json(F.struct(*(F.col("row")[c] for c in df.columns if c != text_col)))
            many = rows.join(repeats.hint("shuffle_hash"), ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.min_by("row", others).alias("row"))
            rows = rows.join(repeats.hint("shuffle_hash"), ["_id", "_hash"], "left_anti").unionByName(many.select("row", "_id", "_hash"))
    return rows.join(kept.hint("shuffle_hash"), ["_id", "_hash"], "left_semi").select("row.*")


def text_parts(texts: DataFrame, text_col: str = "text", each: int = 4_000_000, times: int = 4) -> int:
    """Partitions for an exchange of packed words: each gets the words of about ``each`` bytes of text, or there are ``times`` the shuffle partitions."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(times * partitions(texts.sparkSession), size // each)
