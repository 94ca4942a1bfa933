"""Spark session helpers.

Production jobs get their session (and ``spark.checkpoint.dir``) from the
cluster; :func:`get_spark` only fills in settings that are unset, which is
what the tests and the bench rely on.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a local run needs; a cluster's own values always win.
_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings recommended for a large cluster (100 TB of input, ~1000
# executors). Nothing here is forced: ``get_spark`` leaves a cluster's own
# settings alone; apply these at submit time.
RECOMMENDED_CLUSTER_CONF = {
    # AQE re-plans at run time: coalesces small shuffle partitions, splits
    # skewed ones, turns small sort-merge joins into broadcasts
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # start wide, let AQE coalesce: ~100 TB / 256 MB per partition
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "512m",
    # broadcast only what is known to be small
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Arrow batches for the Python steps (model slot, list repair, JSON)
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.python.worker.reuse": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              driver_memory: str = "16g", app_name: str = "tablefill",
              extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in {**_LOCAL_DEFAULTS, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def spark_context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def _scratch_dir(master: str) -> str:
    """A local folder for ``local[...]`` masters, whose tasks all run in the
    driver's process; any other master needs a folder that all executors share."""
    if not master.startswith("local[") and master != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="tablefill-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a scratch
    folder is made for a local master; any other master raises ``ValueError``."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark_context(spark)
    if sc is None:  # Spark Connect: only the setting matters (see materialize)
        if not conf_dir:
            conf_dir = _scratch_dir(spark.conf.get("spark.master", "a remote session"))
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        return conf_dir
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not conf_dir:
        conf_dir = _scratch_dir(sc.master)
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as parquet under the shared checkpoint dir
    and read it back.

    Used where a frame feeds several consumers (the query corpus of a
    pipeline) or where a non-deterministic step (a model call, a random
    draw) must not be recomputed after an executor loss. Unlike
    ``checkpoint()`` without a cache, the frame is computed once.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tablefill-{uuid.uuid4().hex}"
    _PINNED.append(path)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


_PINNED: list[str] = []  # tables written by ``materialize`` and not yet dropped
_PATHS: dict[int, tuple] = {}  # the table of each frame that ``materialize`` returned


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``materialize`` returned, once all
    their readers have run. Other frames are left alone."""
    for frame in frames:
        ref, path = _PATHS.pop(id(frame), (lambda: None, ""))
        sc = spark_context(frame.sparkSession)
        if ref() is frame and sc is not None:
            if path in _PINNED:
                _PINNED.remove(path)
            _delete(sc, path)


def _delete(sc, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def dropping_pinned(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes in the block when it
    ends: for jobs whose results are written by then."""
    before = len(_PINNED)
    try:
        yield
    finally:
        paths = _PINNED[before:]
        del _PINNED[before:]
        sc = spark_context(spark)
        if sc is not None:  # a Connect client has no file system at hand
            for path in paths:
                _delete(sc, path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablefill`` importable by the Python workers (``addPyFile`` of
    a zip of the package, once per application) — needed when the driver
    does not run from the repository root, and on any real cluster."""
    import zipfile
    sc = spark_context(spark)
    app = sc.applicationId if sc is not None else f"connect:{spark.client.session_id}"
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tablefill-pkg-"), "tablefill.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(out)
    else:  # Spark Connect ships Python code as session artifacts
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(app)
