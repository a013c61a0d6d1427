"""Session-level helpers: reading tables, settings, the shared folder and spreading work."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once for each application.

    Spark's own file server distributes the archive, so no worker needs the package installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(f"{root.name}/{source.relative_to(root)}"), source.read_bytes())
    folder = tempfile.mkdtemp(prefix="noteloom-")
    path = os.path.join(folder, "noteloom_package.zip")
    Path(path).write_bytes(archive.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settings(limits: DataFrame) -> dict[str, int]:
    """``analysis_limits`` as a dictionary. The table has one row for each setting, a fixed handful,
    so reading it on the driver is bounded; of repeated rows the largest amount holds."""
    rows = limits.where(F.col("setting").isNotNull()).groupBy("setting").agg(F.max("amount").alias("amount"))
    return {r["setting"]: int(r["amount"]) for r in rows.limit(1000).collect() if r["amount"] is not None}


#: Folders below the shared one that were written and not yet removed, by application.
_folders: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder is set on one machine, as in tests; on a cluster that is
    refused, since executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="noteloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/noteloom-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: several computations start from it, and a
    lost executor repeats none of what came before.

    The folder goes at the end of the surrounding :func:`scratch`, with :func:`release`, or with the application."""
    folder = shared_folder(spark)
    df.write.parquet(folder)
    _path(spark, folder, lambda fs, p: fs.deleteOnExit(p))
    return spark.read.schema(df.schema).parquet(folder)


def _path(spark: SparkSession, path: str, use):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return use(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)


def folders_in(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """The entries below ``path`` that fit a glob pattern, on whatever file system they are."""
    return sorted(status.getPath().toString() for status in _path(spark, f"{path}/{pattern}", lambda fs, p: fs.globStatus(p)) or [])


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    _path(spark, path, lambda fs, p: fs.delete(p, True))


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove what :func:`shared_folder` named (from the ``since``-th on); results that read it must be consumed."""
    listed = _folders.get(spark.sparkContext.applicationId, [])
    while len(listed) > since:
        remove_folder(spark, listed.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Everything written to the shared folder within is removed at the end, also after an error."""
    since = len(_folders.setdefault(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)


#: A key that more than one in so many rows hold is hot, so there are at most so many hot keys.
HOT_SHARE = 1_000
#: Tasks that a hot key's rows are dealt to.
HOT_PARTS = 16


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, which has each key once and in ``rows`` how many rows of ``left`` hold it
    (about: the count only steers the work). Null keys are equal to each other; ``right``'s keys are dropped.

    Rows of hot keys are dealt to several tasks, and only those keys' rows of ``right`` are repeated for
    them. The driver sees at most ``HOT_SHARE`` hashes."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    key = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    hot = [r[0] for r in right.where(F.col(rows) > total / HOT_SHARE).select(key).limit(HOT_SHARE).collect()]
    is_hot = key.isin(hot) if hot else F.lit(False)
    a = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(HOT_PARTS))).otherwise(0).cast("bigint"))
    parts = F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(HOT_PARTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    b = right.drop(rows).withColumn("_parts", F.explode(parts)).withColumnsRenamed({k: f"_{k}" for k in keys})
    met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(b, [F.col("_part") == F.col("_parts"), *met], how).drop("_part", "_parts", *[f"_{k}" for k in keys])


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Repartition by ``keys`` where the input has fewer partitions than the cluster can use.

    A scan of many files keeps its partitions (no shuffle); one small file that feeds CPU-heavy
    work is spread by hash, which gives the same rows again when a lost task is repeated."""
    ship(df.sparkSession)
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want, *keys) if df.rdd.getNumPartitions() < want else df


def sql_over(spark: SparkSession, text: str, **frames: DataFrame | int) -> DataFrame:
    """Run SQL in which ``{name}`` stands for a DataFrame or a number; other braces stay as they are.

    The temporary views behind the names are dropped as soon as the query is analysed."""
    views = {}
    for name, frame in frames.items():
        if not isinstance(frame, DataFrame):
            text = text.replace("{" + name + "}", str(frame))
            continue
        views[name] = f"noteloom_{name}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(views[name])
        text = text.replace("{" + name + "}", views[name])
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
