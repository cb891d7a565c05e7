"""Where intermediate tables live, and how rows get a rank without one task seeing a whole group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without one, a temporary folder, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _local_roots[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tidemark-{uuid.uuid4().hex}"
    if open_ := _scopes.get():
        open_[-1].add(path.rsplit("/", 1)[1])
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


#: Names of the tables that :func:`cut` has made inside each :class:`Scope` that is open here; every thread has its own.
_scopes: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())


def _names(df: DataFrame) -> set[str]:
    """Names of the tables of :func:`cut` that ``df`` reads."""
    return {part for f in df.inputFiles() for part in f.split("/")[-2:-1] if part.startswith("tidemark-")}


def _delete(spark: SparkSession, names: set[str]) -> None:
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`cut` that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, _names(df))


class Scope:
    """What :func:`scope` gives: says which tables outlive it."""

    def __init__(self) -> None:
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        for df in tables:
            self.kept |= _names(df)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables that :func:`cut` makes inside, in the same thread, are deleted at the end, but for those kept, which belong to the scope around, if any.

    For callers: write an operator's result inside a scope, and its intermediate tables go once it is written.
    """
    own, made, around = Scope(), set[str](), _scopes.get()
    _scopes.set((*around, made))
    try:
        yield own
    finally:
        _scopes.set(around)
        if around:
            around[-1].update(made & own.kept)
        _delete(spark, made - own.kept)


HASHES = 1 << 40


def hash_order(*key: str) -> Column:
    """An even spread of keys over ``HASHES`` numbers."""
    return F.pmod(F.xxhash64(*key), F.lit(HASHES))


def least_by_hash(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """The ``most`` rows that come first by hash of the key, a sample that does not depend on how rows are dealt.

    Rows far beyond are left out before they are sorted, so the task that sorts reads about twice ``most``, from any table.
    """
    n = df.count()
    order = hash_order(*key)
    near = df.where(order < int(HASHES * min(1.0, (2 * most + 1000) / max(n, 1))))
    return near.orderBy(order, *key).limit(most)


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 in the given order.

    Rows are dealt by range over (group, order), so a group that holds a third of all rows spreads over many
    tasks; each task's share gets the offset of the shares before it. Rows that tie get distinct numbers, which
    stay fixed because the dealt table is written before it is counted.
    """
    keys = [*group, *order]
    dealt = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_row", 33))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = dealt.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    shares = shares.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    same: Column = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = dealt.join(shares, same)
    return out.select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_skip")).alias(rank))
