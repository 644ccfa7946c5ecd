"""Tables between steps, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a temporary folder on a local master, as in tests; an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own that goes when the driver ends."""
    path = f"{shared_folder(spark)}/loam-{name}-{uuid.uuid4().hex}"
    fs, conf = _hadoop(spark)
    target = fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return path


def discard(spark: SparkSession, path: str) -> None:
    fs, conf = _hadoop(spark)
    target = fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


class Versions:
    """A folder of versions of some tables.  A pointer names the one that readers see, and is swapped in one step."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        fs, conf = _hadoop(self.spark)
        pointer = fs.Path(f"{self.path}/CURRENT")
        if not pointer.getFileSystem(conf).exists(pointer):
            return None
        return f"{self.path}/" + self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def new(self) -> str:
        return f"{self.path}/v-{uuid.uuid4().hex}"

    def publish(self, version: str) -> None:
        """Make a version, all of whose tables are written, the current one; the one before is deleted at the next call."""
        fs, conf = _hadoop(self.spark)
        before, root = self.current(), fs.Path(self.path)
        files = root.getFileSystem(conf)
        written = fs.Path(f"{self.path}/NEXT-{uuid.uuid4().hex}")
        out = files.create(written, True)
        out.write(bytearray(version.rpartition("/")[2].encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(jvm.java.net.URI(files.getUri().toString()), conf).rename(written, fs.Path(f"{self.path}/CURRENT"), options)
        keep = {version.rpartition("/")[2], (before or "").rpartition("/")[2]}
        for status in files.listStatus(root):
            if status.getPath().getName().startswith("v-") and status.getPath().getName() not in keep:
                files.delete(status.getPath(), True)


def saved(df: DataFrame) -> DataFrame:
    """The table, written and read again: worked out once, without lineage."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
