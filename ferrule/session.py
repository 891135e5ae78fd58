"""The package at the Python workers, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a context, for clusters whose machines don't have it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_ferrule_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="ferrule-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(archive))
    sc._ferrule_sent = True


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a URI; where none is set and the master is local, as in tests, a temporary folder stands in."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        sc.setCheckpointDir(where)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def kept(df: DataFrame, name: str, rows: dict[str, int] | None = None) -> DataFrame:
    """df written once to the shared folder and read again, for what is used several times; the files go with the driver. rows[name]: how many were written, as observed while they were."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    atexit.register(forget, folder)
    seen = Observation(name)
    (df if rows is None else df.observe(seen, F.count(F.lit(1)).alias("rows"))).write.parquet(folder)
    if rows is not None:
        rows[name] = seen.get["rows"]
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(folder: str) -> None:
    """Delete a folder when the driver ends; only local ones, as Spark may have gone."""
    if folder.startswith("file:"):
        shutil.rmtree(re.sub("^file:/*", "/", folder), ignore_errors=True)


class Files:
    """A few whole small files (manifests) in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(""))) if self.fs.exists(self._path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; fails if there is one of that name, so of two writers one wins."""
        stream = self.fs.create(self._path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
