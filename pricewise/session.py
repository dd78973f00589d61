"""Session construction and shared-storage locations."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "pricewise") -> SparkSession:
    """Local session for tests and the benchmark (a cluster supplies its own)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PRICEWISE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name one (a shared filesystem every executor can reach).
    Only a local session without the setting gets a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not _is_local(spark) and re.match(r"(file:/*)?/?tmp/", current):
            raise RuntimeError(f"{current} is a machine-local folder; executors on other machines cannot see it")
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="pricewise-ckpt-")
    sc.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/pricewise-{name}-{uuid.uuid4().hex[:12]}"


_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor recomputes from the written files, not from the
    raw scan) and lets several consumers share one computation.  Unlike
    ``DataFrame.checkpoint`` it computes the plan once and stores it columnar.
    The result may be read until ``release`` or the end of the process deletes the files.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return os.path.basename(path).replace("-", "_")


def materialize_by(df, name: str, keys: list[str], gather: bool = True):
    """Write ``df`` once in buckets of ``keys``, as many as there are shuffle partitions: a join on ``keys`` reads
    it as it lies and shuffles the other side only.  ``gather`` shuffles it by ``keys`` first, for one file a bucket; without,
    every task writes files of its own.  Returns (table, its name in the catalog, to be dropped after use)."""
    spark = df.sparkSession
    path = work_path(spark, name)
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _table_name(path)
    (df.repartition(parts, *keys) if gather else df).write.format("parquet").option("path", path).bucketBy(parts, *keys).saveAsTable(table)
    return spark.table(table), table


def drop_written(df) -> None:
    """Delete one table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    gone = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    for entry in [e for e in _WRITTEN if os.path.basename(e[1]) in gone]:
        _WRITTEN.remove(entry)
        p = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete all intermediate tables written so far; results that still read them end with it."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")     # of ``materialize_by``, if it is still there
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended: the folder's owner cleans up
            _WRITTEN.clear()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that functions sent to
    Python workers can be imported there without an installed copy."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pricewise-ship-"), "pricewise.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("pricewise", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
