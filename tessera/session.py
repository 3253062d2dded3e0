"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

# Settings every job of the library relies on (all public Spark configuration).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Data is laid out by document once; joins keyed on (document, ...) may then reuse it
    # instead of re-shuffling on every key. A single document is one input row, so the
    # largest co-partitioned group is bounded by one row's size.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Texts swell after their shuffle: merged partitions stay small.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # A batch of documents becomes words and pieces of many times its bytes; one of hashes may hold many rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "512k",
    # HotSpot leaves larger methods interpreted; beyond it a stage falls back to compiled expressions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs executors inside the driver JVM.
        settings.setdefault("spark.driver.memory", "16g")
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in settings.items():  # of a session that was there before
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark


#: The library's session beside a caller's.
_own: WeakKeyDictionary[SparkSession, SparkSession] = WeakKeyDictionary()


def configured(spark: SparkSession) -> SparkSession:
    """A session of the same application with the library's SQL settings; the caller's stays as it is.

    A session that has them already is used as it is. Settings the caller made for shuffles, broadcasts and
    files are taken over.
    """
    wanted = {k: v for k, v in DEFAULT_CONF.items() if k.startswith("spark.sql.")}
    if all(spark.conf.get(k, None) == v for k, v in wanted.items()):
        return spark
    own = _own.get(spark) or spark.newSession()
    _own[spark] = own
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in wanted.items():
        own.conf.set(k, v)
    return own


#: Folder that holds the package.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the Python path of the workers, whatever folder they start in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p and p != HOME]
    env["PYTHONPATH"] = os.pathsep.join([HOME, *paths])


#: Bytes of an input's files for each partition that a shuffle begins with: some 600,000 words, 900,000 pieces.
LAYOUT_BYTES = 2 << 20


def deal_finely(spark: SparkSession, input_bytes: int) -> None:
    """Let shuffles of the library's session begin with a partition for every ``LAYOUT_BYTES`` of input, and no fewer
    than the caller's number.

    Texts become words and pieces of some sixty times their bytes inside the layout by document, so that a
    number that doesn't follow the input makes a task's sorts grow until they spill. Adaptive execution still merges
    small partitions.
    """
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // LAYOUT_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(number))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is a private scratch folder set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
