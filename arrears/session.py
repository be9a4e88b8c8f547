"""Session helpers and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "arrears",
                  shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """Session with the settings the library relies on.

    AQE stays on: it coalesces small shuffle partitions, turns a join into a
    broadcast only after measuring the built side, and splits skewed join
    partitions (the sentinel actor ids are large groups).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which every
    executor must reach. Only a session that is one process (``local[n]``)
    may go without: it gets a folder of its own, as in tests. On a cluster a
    folder of one machine would lose what other machines write."""
    sc = spark.sparkContext
    root = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
            or sc.getCheckpointDir())
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="arrears-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


_SCOPES = threading.local()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder for a written table: below the innermost
    ``scratch_scope`` if one is open, else below the checkpoint root."""
    stack = getattr(_SCOPES, "stack", None)
    if stack:
        return "/".join([stack[-1], *parts, uuid.uuid4().hex])
    root = checkpoint_root(spark).rstrip("/")
    return "/".join([root, "arrears", *parts, uuid.uuid4().hex])


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def scratch_scope(spark: SparkSession, root: str):
    """Tables pinned inside the block live under ``root`` and are deleted
    when the block ends: for work whose results are fully written inside
    it (a streaming micro-batch), so scratch does not grow with time."""
    stack = getattr(_SCOPES, "stack", None)
    if stack is None:
        stack = _SCOPES.stack = []
    stack.append(root.rstrip("/"))
    try:
        yield root
    finally:
        stack.pop()
        delete_path(spark, root)


#: bytecode of a method beyond which the JVM's compilers leave it to the interpreter
COMPILED_METHOD_BYTES = 8000
_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession):
    """Plans run inside the block are generated as methods that the JVM
    compiles: a stage of many columns and functions, which as one method
    would be interpreted row by row, runs operator by operator. The session
    has its own setting back when the block ends."""
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, str(min(int(before), COMPILED_METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before)


def stable_path(spark: SparkSession, *parts: str) -> str:
    """A fixed folder below the checkpoint root (model store, history)."""
    root = checkpoint_root(spark).rstrip("/")
    return "/".join([root, "arrears", *parts])


def pin(df: DataFrame, *parts: str) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the checkpoint folder and
    read it back: lineage is cut (executor loss does not recompute the
    upstream plan), and the plan runs once. An eager RDD ``checkpoint()``
    would run it twice (one job for the action, one to write the files)
    unless persisted. The read-back also gives the planner real sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, "pinned", *parts)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
