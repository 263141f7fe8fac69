"""Session helpers: a tuned local session for tests/bench and the shared scratch root.

On a cluster the session comes from the platform; the library only reads settings from it.
Intermediate tables (published versions, streaming checkpoints, lineage cuts) go under the
shared folder named by ``spark.checkpoint.dir``. A local folder is set only when the session
has none, which happens in tests and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tidesync") -> SparkSession:
    """Session used by tests, bench and the driver entry when none exists yet."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without one (tests, local runs) gets a local folder created and
    set; a cluster session without one is an error, since a folder on the driver's disk is not
    visible to the executors.
    """
    try:
        sc = spark.sparkContext
    except Exception:                                   # e.g. Spark Connect: no SparkContext here
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return root.rstrip("/")
    root = sc.getCheckpointDir()
    if not root:
        conf_dir = sc.getConf().get("spark.checkpoint.dir")
        if conf_dir:
            sc.setCheckpointDir(conf_dir)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidesync-ckpt-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused folder below the shared root (one per call)."""
    return f"{shared_root(spark)}/tidesync/{purpose}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """``file:/x`` → ``/x`` for the few local-only helpers in tests."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return uri


def env_sf_dir(default: str = "/root/testdata/sf0.01") -> str:
    return os.environ.get("TIDESYNC_SF_DIR", default)
