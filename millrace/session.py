"""Session helpers: a local session for tests and benches, and the shared work folder of a job."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8, **more: str) -> SparkSession:
    """A local session as the tests and the bench use it; ``more`` holds further settings, with _ for each dot."""
    builder = SparkSession.builder
    for name, value in more.items():
        builder = builder.config(name.replace("_", "."), value)
    return (
        builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.maxResultSize", "1g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )


def uri(path: str | Path) -> str:
    """``path`` with its scheme. One without is a path of the file system that all machines have mounted, for Spark as for Python."""
    return str(path) if "://" in str(path) or str(path).startswith("file:") else Path(path).expanduser().resolve().as_uri()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and all executors run on this machine (tests), a local folder of our own stands
    in, one an application. Elsewhere it is an error: other machines could not read what is written there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, _OWN[app][7:], ignore_errors=True)
        named = _OWN[app]
    return named.rstrip("/")


_MADE: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is deleted by ``clear_work``, or else when the application ends."""
    _MADE.append(f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex[:12]}")
    fs, path = _hadoop(spark, _MADE[-1])
    fs.mkdirs(path.getParent())
    fs.mkdirs(path)  # only what exists can be marked for deletion
    fs.deleteOnExit(path)
    return _MADE[-1]


def clear_work(spark: SparkSession) -> None:
    """Deletes the tables that this process has written to the shared folder; no DataFrame on them may be used after."""
    while _MADE:
        fs, path = _hadoop(spark, _MADE.pop())
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_path(spark, name)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once an application, unless PYTHONPATH holds it anyway."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="millrace-code-")  # the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "millrace.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    ship(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
