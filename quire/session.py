"""Session helpers: builder, shared scratch space, lineage cuts.

Nothing here touches executor-local state: intermediate tables go to the
folder named by ``spark.checkpoint.dir`` so that any executor may be lost at
any time and the table can still be read.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    ``spark.checkpoint.dir`` wins.  Only where it is unset (tests, a laptop)
    a temporary folder is made and remembered in the session.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("quire.scratch.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-scratch-")
        spark.conf.set("quire.scratch.dir", root)
    return root.rstrip("/")


_BASES: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """Scratch tables live as long as results may read them: until the driver ends."""
    for spark, base in _BASES:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, base)
        except Exception:  # the JVM is gone, and with it whoever would read them
            return


class Scratch:
    """Written tables that cut the lineage of an iterative plan.

    ``cut`` writes a DataFrame to the shared folder as Parquet and returns the
    table read back: the plan restarts there, sizes are known to the optimizer
    and nothing depends on a single executor.  ``drop`` removes tables that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/quire-{label}-{uuid.uuid4().hex}"
        self.n = 0
        _BASES.append((spark, self.base))

    def cut(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` from its written table; of one laid out ``by`` a column the optimizer knows how large each part is."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_quire_path", None)
            if path:
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as half the cores, for work that costs far more than reading.

    Only an input of very few splits is shuffled; a large one stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 >= cores:
        return df
    return df.repartition(cores, key)
