"""Session helpers shared by tests, the bench and the operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cpus: int = 8, app: str = "inkgrid", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not configured:
        configured = f"file://{tempfile.mkdtemp(prefix='inkgrid-')}"
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/inkgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what this package has written to the shared folder. Results that still read from there must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inkgrid")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_inkgrid_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="inkgrid-")) / "inkgrid.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._inkgrid_shipped = True


def give_back() -> None:
    """Returns this process's freed memory to the system, which the C library and Arrow else keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable) -> Callable:
    """f over batches, with its memory given back at the end: idle workers live on beside the tasks of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, f: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow for functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(lean(f), schema)
