"""Sinks (SNK1-7) and the canonical-table reuse rule (SRC5).

All writers are Spark writers; nothing is collected to the driver. Sharded
output is one compact JSON array under the byte budget per shard file;
``write_json_shards`` writes Spark's partitioned layout
``<out>/setup=<s>/split=<t>/shard_id=<n>/`` and replaces the whole output folder,
:mod:`rankloom.sources.datasets` puts shards where the manifest names them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.sequence import materialize
from rankloom.operators.sharding import DEFAULT_MAX_BYTES, greedy_shards
from rankloom.sources.readers import _fs_exists


def write_canonical(df: DataFrame, path: str) -> None:
    """SNK1: canonical examples as Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  force: bool = False) -> DataFrame:
    """SRC5: reuse the canonical table when it exists, else build and write
    it first (``force`` rebuilds). Reading it back cuts the lineage: the
    downstream split/fan-out/shard jobs scan Parquet, not the curation plan."""
    if force or not _fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        write_canonical(build(), path)
    return spark.read.parquet(path)


def shard_records(records: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES,
                  group_by: Sequence[str] = ("setup", "split"), order_by: str = "pos",
                  record_col: str = "record") -> DataFrame:
    """Greedy shard ids for JSON records: (group..., pos, record, rec_bytes,
    shard_id). Only the narrow (group, pos, size) columns go through the
    greedy passes; payloads are joined back on (group, pos)."""
    sized = records.withColumn("rec_bytes", (F.octet_length(record_col) + 1).cast("long"))
    ids = greedy_shards(sized, max_bytes, list(group_by), order_by)
    return sized.join(ids.drop("rec_bytes"), [*group_by, order_by])


def write_json_shards(sharded: DataFrame, out_dir: str,
                      group_by: Sequence[str] = ("setup", "split"), order_by: str = "pos",
                      record_col: str = "record") -> None:
    """SNK2/SNK3: one compact JSON array per shard, records in input order.
    A shard holds at most max_bytes of text (or one oversize record), which
    bounds the single row collected per shard."""
    per_shard = sharded.groupBy(*group_by, "shard_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order_by), F.col(record_col)))).alias("_r"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_r", lambda x: x[record_col]), ","), F.lit("]"))
    (per_shard.select(*group_by, "shard_id", text.alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy(*group_by, "shard_id").text(out_dir))


def write_metrics(metrics: DataFrame, path: str, pred_file: str | None = None) -> None:
    """SNK4: metrics rows as JSON, with the scored file's path recorded."""
    out = metrics if pred_file is None else metrics.withColumn("pred_file", F.lit(pred_file))
    # json.dump keeps null values (e.g. KendallTau when undefined)
    out.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_per_example(dump: DataFrame, path: str) -> None:
    """SNK5: per-example scores as JSON Lines; ``pred``/``gold`` are written
    as JSON arrays (ints stay numbers), via variant columns."""
    out = dump
    for c in ("pred", "gold"):
        if c in dump.columns:
            out = out.withColumn(c, F.try_parse_json(c))
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """SNK6 output: the upserted manifest as JSON Lines (one entry per line)."""
    manifest.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def reshard(spark: SparkSession, in_path: str, out_dir: str,
            max_bytes: int = DEFAULT_MAX_BYTES, replace: bool = False) -> DataFrame:
    """SRC7 + SNK2 + AGG9 + SNK7: split an existing JSON-array file into
    budget-bounded shards ``out_dir``/part-00000.json, ... (each record compact, with
    all its keys), report shards/bytes, and optionally delete the source. It is
    deleted only when the shards, read back strictly, have the count and sum of
    record hashes that a fresh strict read of the source has. Never writes into the
    path it reads."""
    from rankloom.operators.sharding import shard_report
    from rankloom.sources.datasets import checksum, read_dataset, write_shard_folder
    from rankloom.sources.readers import read_json_array
    if out_dir.rstrip("/") == in_path.rstrip("/"):
        raise ValueError("output must differ from the input path")
    # cut lineage first: the report must not re-read a source that may be deleted
    sharded = write_shard_folder(materialize(read_json_array(spark, in_path), "reshard"), out_dir, max_bytes)
    report = shard_report(sharded, ["part"]).drop("part")
    if replace:
        there, here = checksum(read_json_array(spark, in_path)), checksum(read_dataset(spark, out_dir)) if sharded.take(1) else (0, None, None)
        if there != here:
            raise RuntimeError(f"{in_path} is kept: it has (records, hashes) {there}, its shards {here}")
        replace_source(spark, in_path)
    return report


def replace_source(spark: SparkSession, src: str) -> None:
    """SNK7: delete the source after its shards were written successfully
    (never overwrite the path being read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(src)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
