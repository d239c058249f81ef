"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}
_WRITTEN: dict[int, tuple[SparkSession, list[str]]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset is one chosen here: a temporary folder for a local
    master (tests), the warehouse otherwise.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.TemporaryDirectory(prefix="rankwell-")
        return _LOCAL["dir"].name
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files and folders, where they are still there."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = id(spark.sparkContext)
    if key not in _WRITTEN:
        _WRITTEN[key] = (spark, [])
        atexit.register(delete_paths, *_WRITTEN[key])
    _WRITTEN[key][1].append(path)
    return path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors and gives one
    computation to several readers.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table of :func:`materialize` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        delete_paths(df.sparkSession, [files[0].rsplit("/", 1)[0]])


def release(spark: SparkSession) -> None:
    """Lets the cleaner drop the shuffle files of finished steps, which else stay until a driver's own collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
