"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: set[str] = set()


def session(master: str = "local[8]", app: str = "textloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.maxResultSize": "1g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or, on one machine only, one of our own where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "textloom-checkpoints")


def scratch(spark: SparkSession) -> str:
    """A folder of this application in the shared folder, removed when its Python process ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/textloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes `df` as a table to the shared folder and reads it from there: the lineage ends, a lost executor costs no
    recomputation, and readers take the columns they need. The tables of an application go when its Python process ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the gateway may be gone already; a local folder is removed without it
        if folder.startswith("file:"):
            shutil.rmtree(folder[folder.index("/") :].replace("//", "/", 1), ignore_errors=True)


@contextmanager
def partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """Shuffles of actions inside have at least so many partitions; adaptive execution still joins small ones and splits skewed ones."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, as it is otherwise; counting stops beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "textloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(archive)
    context._textloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
