"""Helpers shared by the training-data operators: shared storage, hashing, Arrow batches, bounded samples."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package

#: Rows in one Arrow batch: whole texts travel in them, so a batch stays at a few MB.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    With neither, a temporary folder serves a driver that is its own only executor; on a cluster that is an error, as
    each executor would write to its own disk.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(sc, "_ferrite_shared", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._ferrite_shared = "file://" + tempfile.mkdtemp(prefix="ferrite-")
    return base.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ferrite-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> bool:
    """Delete this application's scratch tables and bundles in the shared folder. Results that still read them fail."""
    return _delete(spark, _own_folder(spark))


def give_back(spark: SparkSession) -> None:
    """Return what the driver's JVM and its Python have freed outside their heaps to the system.

    Each thread of a long-lived driver allocates from an arena of its own, and glibc keeps what is freed there. Nothing in
    use is touched; where a JVM or C library has no such call, its memory stays as it is.
    """
    java, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
    kinds, args = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
    names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    try:
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        for i, n in enumerate(names):
            kinds[i] = java.Class.forName(n)
        # The server's class is hidden, its interface isn't.
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends at files that outlive executors.

    ``by`` makes a folder for each value of that column, so that a later filter on it reads only those. Each table is
    many short tasks' work for the driver, whose freed memory goes back to the system.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._ferrite_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in written:
        _delete(df.sparkSession, df._ferrite_path)


def python_ready(spark: SparkSession) -> None:
    """Ship the package; lower the session's rows per Arrow batch where whole texts would not fit a Python worker."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def map_column(df: DataFrame, column: str, schema: str, work: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """The other columns of ``df`` as they are, and what ``work`` makes of ``column``.

    Columns pass through as Arrow arrays, so a bigint next to a null stays what it is. ``work()`` runs once a task and
    returns a function from a batch's values to the arrays of ``schema``.
    """
    out = StructType([f for f in df.schema if f.name != column] + StructType.fromDDL(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for b in batches:
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != column]
            yield pa.RecordBatch.from_arrays([*rest, *compute(b.column(b.schema.names.index(column)).to_pylist())], out.names)

    return df.mapInArrow(run, out)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value's text, modulo n (null for null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, key: str, stratum: str, per_stratum: int, columns: dict[str, Column]) -> list:
    """min(``per_stratum``, all) keys of each stratum, those of the least hashes: rows (_key, stratum, *columns) in hash order.

    One aggregation counts each stratum's distinct keys. A second keeps those below a hash that lets about twice as many
    pass, so what reaches the driver is bounded by ``per_stratum`` and the number of strata, whatever the input's size;
    should fewer pass, a larger hash is taken. Rows with equal keys count once, with the least of each column.
    """
    rows = df.where(F.col(stratum).isNotNull() & F.col(key).isNotNull())
    distinct = rows.groupBy(F.col(stratum).alias("_s"), F.xxhash64(F.col(key)).alias("_h")).agg(F.count("*").alias("_n"))
    size = {r["_s"]: r["n"] for r in distinct.groupBy("_s").agg(F.count("*").alias("n")).collect()}
    if not size or per_stratum < 1:
        return []
    room = 2.0
    while True:
        limit = {s: int(min(1.0, (per_stratum * room + 64) / n) * 2**64) - 2**63 - 1 for s, n in size.items()}
        least = F.create_map(*[x for s, v in limit.items() for x in (F.lit(s), F.lit(v).cast("bigint"))])
        below = rows.where(F.xxhash64(F.col(key)) <= F.element_at(least, F.col(stratum)))
        got = below.groupBy(F.xxhash64(F.col(key)).alias("_h"), F.col(key).alias("_key"), F.col(stratum)).agg(F.count("*").alias("_n"), *[F.min(c).alias(k) for k, c in columns.items()]).collect()
        held: dict = {}
        for r in sorted(got, key=lambda r: (r["_h"], str(r["_key"]))):
            held.setdefault(r[stratum], []).append(r)
        if all(len(held.get(s, [])) >= min(per_stratum, n) for s, n in size.items()):
            break
        room *= 4
    return sorted((r for rs in held.values() for r in rs[:per_stratum]), key=lambda r: (r["_h"], str(r[stratum])))
