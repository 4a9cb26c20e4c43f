"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession


def build_session(app: str = "lanternspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here count on; ``conf`` overrides them (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return ship(builder.config(map=settings).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let the Python workers of every executor import this package; once for a Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_lanternspark_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="lanternspark-code-")  # of the driver, which serves the file to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = Path(folder, "tree", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(Path(folder, "lanternspark_code")), "zip", copy.parent))
        sc._lanternspark_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by a reliable checkpoint in the cluster's shared folder.

    The folder is the one named in ``spark.checkpoint.dir``; it survives the loss of executors. Only a
    local session without that setting gets a temporary folder; a cluster without it is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A folder for tables that are read again, under the checkpoint folder, which is set up if need be."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="lanternspark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def rows_of(df: DataFrame, block: int) -> Iterator[Row]:
    """The rows of ``df`` on the driver: at once if they are at most ``block``, else partition by partition."""
    head = df.limit(block + 1).collect()
    return iter(head) if len(head) <= block else df.toLocalIterator(prefetchPartitions=True)


#: Physical operators whose input is shuffled: their output is already spread by size.
_SHUFFLED = ("Aggregate", "Join", "Window", "Sort", "Repartition", "Exchange")


def _operators(plan) -> Iterator[str]:
    """Class names of a physical plan's operators; names of tables and columns don't count."""
    yield plan.getClass().getSimpleName()
    below = plan.children()
    for k in range(below.size()):
        yield from _operators(below.apply(k))


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that feeds costly Python work, when it has fewer partitions than cores.

    A no-op when the scan already has a partition for every core, and for results of a shuffle, whose
    number of partitions is known only by running it.
    """
    if any(name in own for own in _operators(df._jdf.queryExecution().sparkPlan()) for name in _SHUFFLED):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)
