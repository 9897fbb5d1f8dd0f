"""Session construction and the few SQL settings the operators rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# SQL confs the operators need for parity; all are runtime-settable.
_REQUIRED_CONF = {
    # JSON objects with a repeated key keep the last value, like Python's json.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Confs that shape the physical plan; applied only where the user left them unset.
_PLAN_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What a task holds outside its heap and in its Python worker for each batch: whole
    # texts make 10,000 rows (the other limit) tens of MB. op9 cuts batches into two chunks.
    "spark.sql.execution.arrow.maxBytesPerBatch": "15m",
}


def _ship_by_value() -> None:
    """Pickle rankloom's functions by value inside Python tasks, so executors
    need no installed copy of the package (no --py-files for a quick start)."""
    import rankloom
    from pyspark import cloudpickle
    try:
        cloudpickle.register_pickle_by_value(rankloom)
    except ValueError:
        pass  # already registered


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings rankloom depends on to an existing session."""
    _ship_by_value()
    for k, v in _REQUIRED_CONF.items():
        spark.conf.set(k, v)
    for k, v in _PLAN_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "rankloom") -> SparkSession:
    """A local session for tests and benches; on a cluster use the provided one
    and call :func:`configure`."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("RANKLOOM_DRIVER_MEMORY", "16g")))
    for k, v in {**_PLAN_DEFAULTS, **_REQUIRED_CONF}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    local session gets a temporary folder; on a cluster that is an error, since
    executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        base = tempfile.mkdtemp(prefix="rankloom-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # some sessions reject core confs at runtime
            pass
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cached_column(fn):
    """Memoise a Column builder whose arguments are hashable (column names,
    constants). Large rule expressions take hundreds of py4j calls to build;
    the JVM Column they produce is a plain expression tree, reusable across
    DataFrames of the same SparkContext (the cache is keyed by it)."""
    import functools

    from pyspark import SparkContext

    @functools.lru_cache(maxsize=256)
    def cached(ctx_id, *args):
        return fn(*args)

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        return cached(id(sc) if sc is not None else 0, *args)
    return wrapper
