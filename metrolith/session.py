"""Session helpers: a local session for tests, and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session on this machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("metrolith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, so that they need not find it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="metrolith-code-"), "metrolith.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(out)
    atexit.register(shutil.rmtree, os.path.dirname(out), True)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and this machine is all there is (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _fallback
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="metrolith-")
        atexit.register(shutil.rmtree, _fallback, True)
    return "file://" + _fallback


_fallback: str | None = None


class Workspace:
    """Tables written into the shared folder, so that a lost executor costs no lineage.

    ``keep`` writes a frame as parquet and returns it read back; ``drop`` deletes what an
    iteration no longer needs and ``finish`` what a result was made from. What a returned
    result still reads stays until the folder's owner clears it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._metrolith_path = path
        self.kept.append(out)
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """Keeps a result and drops every table it was made from."""
        made, self.kept = self.kept, []
        out = self.keep(df)
        self.drop(*made)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = getattr(df, "_metrolith_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
