"""Session helpers shared by every operator: table access and materialising between stages."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows and bytes of a batch that goes to a Python worker: whole texts, so a fifth and a quarter of Spark's defaults.
BATCH, BATCH_BYTES = 2000, "16m"


def prepare(spark: SparkSession) -> None:
    """Readies a session for this package's Python functions.

    Workers import the package from where the driver did, if it is not installed there; Arrow batches are
    kept small unless the session has a size of its own, as a worker holds a few of them at a time.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data set at ``sf_dir``."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local applications that name none, by application. Spark does not let a running session set the name.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a local session gets a temporary folder; on a cluster that would be one
    machine's, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='strandframe-')}"
    return _OWN[app]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; they go when the application ends.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a materialised ``df`` that nothing will read again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
