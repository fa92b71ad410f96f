"""Where intermediate tables live: always a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one in the warehouse, which a cluster shares
    as well. Never a machine's own temporary folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return set_dir.rstrip("/") if set_dir else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kvflow"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/kvflow-{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    vars(spark.sparkContext).setdefault("_kvflow_paths", set()).add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, so a lost executor
    costs a reread and not a recomputation. The files go when the session's JVM ends, or by :func:`drop`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kvflow_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        vars(context).get("_kvflow_paths", set()).discard(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, [df._kvflow_path])


def release(spark: SparkSession) -> None:
    """Delete all that is left in the shared folder, once the results that read it are stored: for long sessions."""
    _delete(spark, sorted(vars(spark.sparkContext).get("_kvflow_paths", ())))
