"""Session settings, table reading and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def create_session(master: str = "local[*]", app: str = "quillon", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; ``conf`` adds or overrides settings (``__`` stands for a dot)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package, wherever the driver was started."""
    root, environment = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join(x for x in [*known, root] if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class FileSystem:
    """Small files and folders through the Hadoop file system of a path, so that any shared storage will do."""

    def __init__(self, spark: SparkSession, path: str):
        self._java = spark._jvm.org.apache.hadoop.fs
        self._jvm = spark._jvm
        self._fs = self._java.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._java.Path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._java.Path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that isn't there yet; false, and nothing written, if it is."""
        try:
            stream = self._fs.create(self._java.Path(path), False)
        except Exception as e:  # the file system's own exception for a file that exists
            if "exists" in str(e).lower():
                return False
            raise
        stream.write(text.encode("utf-8"))
        stream.close()
        return True

    def state(self, path: str) -> tuple:
        """Names, sizes and times of the files of a path; another state means another content."""
        at = self._java.Path(path)
        return tuple((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in self._fs.listStatus(at)) if self._fs.exists(at) else ()

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._java.Path(path)).getLength()

    def delete(self, path: str) -> None:
        self._fs.delete(self._java.Path(path), True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none, and runs in one JVM, is a local temporary folder used instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = getattr(shared_dir, "fallback", None)
    if fallback is None:
        fallback = shared_dir.fallback = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    return fallback


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and return it as a scan of what was written: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(schema).parquet(path)


_written: dict[str, list[str]] = {}


def remove_stored(spark: SparkSession) -> int:
    """Remove what ``stored`` wrote in this application; to be called when no result of it is read any more.  Returns how many tables."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    files = FileSystem(spark, shared_dir(spark))
    for path in paths:
        files.delete(path)
    return len(paths)
