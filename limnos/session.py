"""Session helpers: local builder for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Wide projections (32 features, the confidence chain) generate methods
    # above HotSpot's 8 KB JIT limit; let the JIT compile them (set the same
    # in spark.executor.extraJavaOptions on a cluster).
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "limnos", driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks.  Cluster jobs get their
    session from the platform; nothing in the library calls this."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    if str(cpus).isdigit():
        b = b.config("limnos.input.partitions", str(cpus))  # the test tables are single row groups
    for k, v in _LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must name reliable shared storage; it is read
    as is, and without it this raises.  Only a local session (one process,
    as in tests) gets a fresh folder of its own when it is unset.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="limnos-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local
    on a cluster, because the base comes from ``spark.checkpoint.dir``)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "limnos", *parts, uuid.uuid4().hex)
