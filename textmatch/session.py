"""Session helpers: tuned sessions and tables written to the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"


def local_session(app: str = "textmatch", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder: below the cluster's shared one, else below the warehouse.

    It holds the tables an application writes for itself and goes when the driver ends.
    Several machines need a shared folder: a local warehouse is refused there.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        top = spark.conf.get(SHARED_DIR_KEY, None) or context.getConf().get(SHARED_DIR_KEY)
        if top is None:
            top = spark.conf.get("spark.sql.warehouse.dir")
            local = top.startswith(("file:", "/")) and not context.master.startswith("local")
            if local:
                raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all machines share; {top} is local")
        folder = f"{top.rstrip('/')}/textmatch-{context.applicationId}"
        _folders[context.applicationId] = folder
        atexit.register(_remove, context._jvm, context._jsc.hadoopConfiguration(), folder)
    return _folders[context.applicationId]


def _remove(jvm, configuration, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)
    except Exception:  # the JVM is gone already: nothing can be removed through it
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing was written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage where a result feeds several branches of a plan, so that
    neither a model run nor an iteration is repeated when executors are lost.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
