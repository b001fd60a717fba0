"""Session helpers: one place that knows how to build or reuse a session."""

from __future__ import annotations

import atexit
import os
import shutil
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app: str = "edgecraft") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (local
    mode, or a path that executors share), whatever the working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A cluster session without that setting is an error: a folder of one machine
    is not reachable from other executors.  A local-mode session (tests, bench)
    without it uses one folder of its application beside the warehouse, removed
    when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").rstrip("/")
        conf = f"{base}/_checkpoints/{sc.applicationId}"
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


@contextmanager
def garbage_collected(spark: SparkSession, every: float = 5.0) -> Iterator[None]:
    """Collect the driver's garbage every few seconds.  Spark deletes the files of a
    shuffle when the driver has collected what refers to it, which by itself may take
    until after a long iterative job."""
    done, collect = threading.Event(), spark.sparkContext._jvm.java.lang.System.gc

    def run() -> None:
        while not done.wait(every):
            collect()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
