"""Where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import FloatType, IntegerType

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="corpuscade-ship-"), "corpuscade"),
        "zip",
        os.path.dirname(package),
        os.path.basename(package),
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a fresh folder
    on the one machine there is.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder all executors share; "
            f"master {master} has none"
        )
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="corpuscade-")
    return _LOCAL_FALLBACK[app]


def app_dir(spark: SparkSession, name: str) -> str:
    """A stable path for ``name`` that belongs to the running application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path nothing has written to yet."""
    return app_dir(spark, f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input at least one partition per slot.

    Large tables come in many splits and pass through unchanged; only an input
    with fewer splits than slots, such as one small file, is redistributed.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(slots, 256):
        return df
    return df.repartition(min(slots, 256), *keys)


def materialize(df: DataFrame, name: str, into: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in the session ``into`` if one is given.

    Cuts the lineage for loops and for plans that use a result several times;
    unlike a cached block the table outlives any executor.
    """
    spark = into or df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote for these tables, once nothing reads them any more: a loop
    does so with the tables of earlier rounds. Other tables are left alone."""
    for table in tables:
        if path := table.__dict__.pop("_scratch", None):
            _delete(table.sparkSession, path)


def remove_scratch(spark: SparkSession) -> None:
    """Remove all that the running application wrote to the shared folder, indexes built there by
    default included: for its end, when its results are written elsewhere or collected."""
    _delete(spark, app_dir(spark, ""))


def plain(df: DataFrame) -> DataFrame:
    """Widen 32-bit numbers, so results compare across engines by value and type."""
    wide = {IntegerType: "long", FloatType: "double"}
    return df.select(
        *[
            F.col(f.name).cast(wide[type(f.dataType)]) if type(f.dataType) in wide else F.col(f.name)
            for f in df.schema.fields
        ]
    )
