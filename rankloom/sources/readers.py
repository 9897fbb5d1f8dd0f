"""File sources (SRC1-7).

The reference reads whole JSON files into memory. Here every reader returns
a DataFrame and keeps the input order as a column where semantics depend on
it (first-wins dedup, row index). All formats split across tasks: line-oriented
ones by themselves, a JSON array or object by :mod:`rankloom.sources.json_split`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import py_strip
from rankloom.sources.json_split import json_elements

# prediction/label key aliases, in priority order.
PRED_KEYS = ("predict", "prediction", "output")
GOLD_KEYS = ("label", "labels", "reference", "gold")
# Metadata split files and their order.
META_SPLITS = ("train", "dev", "test")
META_FILE = "deepseek_listwise_metadata_{split}.json"

RAW_FIELDS = [
    T.StructField("qid", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("thinking", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("ranked_table_ids", T.ArrayType(T.StringType())),
    T.StructField("candidate_ids", T.ArrayType(T.StringType())),
]
RAW_SCHEMA = T.StructType(RAW_FIELDS)


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


_STRICT = {"mode": "FAILFAST", "allowSingleQuotes": "false"}


def _one(text: Column, schema: str | T.DataType, opening: str = "[", closing: str = "]") -> Column:
    """The value of JSON text that has to be exactly one array element (or object
    member), parsed strictly as the only one of a collection."""
    parsed = F.from_json(F.concat(F.lit(opening), text, F.lit(closing)), schema, _STRICT)
    return F.when(F.size(parsed) == 1, parsed).otherwise(F.raise_error(F.concat(F.lit("malformed JSON value: "), F.substring(text, 1, 200))))


def read_raw_examples(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: a JSON file holding a top-level array of examples, or an object
    wrapping it under ``data`` (else ``examples``, else nothing). A missing file,
    or one that isn't strictly such JSON, is an error. Adds ``pos`` (0-based order in
    the file). One file is read by many tasks (:mod:`rankloom.sources.json_split`)."""
    found = json_elements(spark, path, wrapped_by=("data", "examples"))
    row = _one(F.col("text"), T.ArrayType(RAW_SCHEMA))[0]
    row = F.when(row.isNotNull() & F.ltrim("text").rlike(r"^\s*\{"), row).otherwise(F.raise_error(F.lit("expected an array of JSON objects")))
    return found.select("pos", row.alias("r")).select("pos", "r.*")


def read_raw_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw examples as JSON Lines (splittable). ``pos`` = global line order:
    files in path order, lines in file order."""
    df = spark.read.schema(RAW_SCHEMA).option("mode", "FAILFAST").json(path)
    return _line_index(df, "pos", per_file=False)


def with_line_order(df: DataFrame, name: str = "idx") -> DataFrame:
    """WIN1: 0-based row index within each file, in file order."""
    return _line_index(df, name, per_file=True)


def _line_index(df: DataFrame, name: str, per_file: bool) -> DataFrame:
    """Numbers the rows of a file scan without moving them: a scan task reads a
    block of a file from its begin, so a row's place in its block comes from the id
    that counts the task's rows; what comes before the block is a prefix sum over one
    small row a block, which is handed to the tasks. (The driver plans the scan from
    the same list of blocks, so that is no more than it holds anyway.)"""
    rows = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_m"))
    blocks = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_f").orderBy("_b") if per_file else Window.orderBy("_f", "_b")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    shift = blocks.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(shift), ["_f", "_b"]).select((F.col("_m") + F.col("_shift")).alias(name), *df.columns)


def read_metadata(spark: SparkSession, metadata_dir: str, file_pattern: str = META_FILE) -> DataFrame:
    """SRC2: up to three split files, each one JSON object keyed by qid;
    absent split files are skipped, anything but strictly one object is an
    error. Long form: qid, split, pos, reasoning_text, total_thinking (pos = key
    order inside the file; of a repeated key the later one wins downstream). One
    file is read by many tasks."""
    rec = "map<string, struct<reasoning_text: string, total_thinking: string>>"
    out = spark.createDataFrame([], "qid string, split string, pos long, reasoning_text string, total_thinking string")
    for split in META_SPLITS:
        p = f"{metadata_dir.rstrip('/')}/{file_pattern.format(split=split)}"
        if _fs_exists(spark, p):
            member = _one(F.col("text"), rec, "{", "}")
            x = json_elements(spark, p, top="{").select("pos", F.explode(member).alias("qid", "r"))
            out = out.unionByName(x.select("qid", F.lit(split).alias("split"), "pos", "r.reasoning_text", "r.total_thinking"))
    return out


def pick_first_key(v: Column, line: Column, keys: Sequence[str]) -> Column:
    """SRC4: value of the first *present* key among aliases (a present JSON
    null wins over a later alias), as a variant."""
    names = F.json_object_keys(line)
    out = F.lit(None).cast("variant")
    for k in reversed(keys):
        out = F.when(F.array_contains(names, F.lit(k)),
                     F.try_variant_get(v, f"$.{k}", "variant")).otherwise(out)
    return out


def read_predictions(spark: SparkSession, path: str, with_index: bool = True,
                     keep: Sequence[str] = ()) -> DataFrame:
    """SRC3 + SRC4: JSON Lines of model outputs. Blank lines are skipped; a
    malformed line fails the job. Output: ``keep`` columns (e.g. partition
    columns such as ``run``), idx (0-based among non-blank lines, per file),
    predict, label (variants: strings are parsed, arrays are used as native
    id lists)."""
    t = spark.read.text(path)
    line = F.col("value")
    t = t.filter(py_strip(line) != "")
    if with_index:
        t = with_line_order(t, name="idx")
    v = F.try_parse_json(line)
    checked = F.when(v.isNull(), F.raise_error(F.concat(F.lit("malformed JSON line: "),
                                                        F.substring(line, 1, 200)))).otherwise(v)
    lead = [*keep, *(["idx"] if with_index else [])]
    out = t.select(*lead, line.alias("_line"), checked.alias("_v"))
    return out.select(*lead,
                      pick_first_key(F.col("_v"), F.col("_line"), PRED_KEYS).alias("predict"),
                      pick_first_key(F.col("_v"), F.col("_line"), GOLD_KEYS).alias("label"))


def read_trainer_states(spark: SparkSession, runs_root: str, file_name: str = "trainer_state.json") -> DataFrame:
    """SRC6: ``<runs_root>/<run>/trainer_state.json`` of every run (``file_name`` may
    be a glob). Output: run, global_step, max_steps, epoch, last_loss (the last log
    entry that has a loss, in the order of the log)."""
    schema = ("global_step long, max_steps long, epoch double, "
              "log_history array<struct<step: long, loss: double>>")
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(
        f"{runs_root.rstrip('/')}/*/{file_name}")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:run=)?([^/]+)/[^/]+$", 1)
    with_loss = F.filter("log_history", lambda e: e["loss"].isNotNull())
    return df.select(run.alias("run"), F.coalesce("global_step", F.lit(0)).alias("global_step"),
                     F.coalesce("max_steps", F.lit(0)).alias("max_steps"),
                     F.coalesce("epoch", F.lit(0.0)).alias("epoch"),
                     F.try_element_at(with_loss, F.lit(-1))["loss"].alias("last_loss"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: a JSON file whose top level must be an array of objects. Output:
    ``pos`` (0-based order in the file) and ``record``, the object's own compact
    JSON with all its keys in their order, nulls included. A truncated file, text
    after the array, another top level or an element that is no object fails the
    job. One file is read by many tasks."""
    x = json_elements(spark, path).select("pos", _one(F.col("text"), "array<string>")[0].alias("record"))
    return x.select("pos", F.when(F.col("record").startswith("{"), F.col("record")).otherwise(
        F.raise_error(F.lit("expected an array of JSON objects"))).alias("record"))
