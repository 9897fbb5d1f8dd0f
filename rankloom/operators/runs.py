"""Run matrix and training progress (DIM1, JOIN3-5, PRJ16-17, PROG1, WIN3).

A run is (model, setup). Its dimension row carries the dataset names, loss
mask, evaluation token budget and output folder. Progress joins the run
dimension with per-run training-log aggregates; the aggregates are plain
grouped aggregations (partial/final), so a run with a huge log never sits in
one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.setups import setups

# The model matrix (tag -> repository id).
MODELS = {"qwen3_8b": "Qwen/Qwen3-8B", "qwen3_4b": "Qwen/Qwen3-4B"}
NUM_TRAIN_EPOCHS = 3.0
SHORT_BUDGET = 128
LONG_BUDGET = 4096


def val_dataset(train_name: Column) -> Column:
    """PRJ16: first ``_train`` -> ``_val`` (bash ``${x/_train/_val}``)."""
    return F.regexp_replace(train_name, r"^(.*?)_train", "$1_val")


def token_budget(run_name: Column) -> Column:
    """PRJ17: answer-only runs (not hint_full) generate 128 tokens, others 4096."""
    short = run_name.contains("answer_only") & ~run_name.contains("hint_full")
    return F.when(short, F.lit(SHORT_BUDGET)).otherwise(F.lit(LONG_BUDGET))


def setup_dimension(spark: SparkSession) -> DataFrame:
    """The registered setups as a small dimension (name, label, mask)."""
    rows = [(s.name, s.label, s.mask_history, s.description) for s in setups()]
    return spark.createDataFrame(rows, "setup string, label string, mask_history boolean, "
                                       "description string")


def run_dimension(setup_dim: DataFrame, models: Mapping[str, str] = MODELS,
                  output_root: str = "lora_runs",
                  model_paths: DataFrame | None = None) -> DataFrame:
    """DIM1 (+JOIN4, JOIN5): every model x every setup row of ``setup_dim``.

    The model list is a literal array exploded per setup row (a generator,
    not a join). With ``model_paths`` (repo_id, path) each run gets its local
    checkpoint path and a missing one fails the job, as in the reference."""
    tags = F.array(*[F.struct(F.lit(t).alias("model_tag"), F.lit(r).alias("repo_id"))
                     for t, r in models.items()])
    runs = setup_dim.select("setup", "label", "mask_history", F.explode(tags).alias("m"))
    name = F.concat(F.col("m.model_tag"), F.lit("_"), F.col("label"))
    train = F.concat(F.col("setup"), F.lit("_train"))
    out = runs.select(
        F.col("m.model_tag").alias("model_tag"), F.col("m.repo_id").alias("repo_id"),
        "setup", "label", "mask_history", name.alias("run_name"), train.alias("dataset"),
        val_dataset(train).alias("val_dataset"), token_budget(name).alias("max_new_tokens"),
        F.concat(F.lit(output_root.rstrip("/") + "/"), name).alias("output_dir"))
    if model_paths is not None:
        # user-supplied table: no broadcast hint (size not proven); AQE decides
        out = out.join(model_paths.select("repo_id", F.col("path").alias("model_path")),
                       "repo_id", "left")
        out = out.withColumn("model_path", F.when(F.col("model_path").isNull(), F.raise_error(
            F.concat(F.lit("No local path found for "), F.col("repo_id")))).otherwise(F.col("model_path")))
    return out


def log_state(log: DataFrame, run_col: str = "run_id", step_col: str = "step",
              loss_col: str = "loss") -> DataFrame:
    """Per-run trainer state from a long log: global_step = max step,
    last_loss = loss of the highest step that logged one (WIN3)."""
    return log.groupBy(run_col).agg(
        F.max(step_col).alias("global_step"),
        F.max_by(loss_col, F.when(F.col(loss_col).isNotNull(), F.col(step_col))).alias("last_loss"))


def progress(runs: DataFrame, state: DataFrame, run_col: str = "run_id",
             max_steps: int | Column = 0, epochs: float = NUM_TRAIN_EPOCHS) -> DataFrame:
    """PROG1 + JOIN3: runs left-joined to their state; ``not started`` when no
    state, ``DONE`` iff step >= max_steps > 0, else ``running``; pct is 0
    when max_steps is 0; epoch = epochs * step / max_steps."""
    j = runs.join(state, run_col, "left")
    ms = max_steps if isinstance(max_steps, Column) else F.lit(int(max_steps))
    step = F.col("global_step")
    started = step.isNotNull()
    pct = F.when(ms > 0, F.lit(100.0) * step / ms).otherwise(F.lit(0.0))
    epoch = F.when(ms > 0, F.lit(float(epochs)) * step / ms).otherwise(F.lit(0.0))
    status = (F.when(~started, "not started").when((step >= ms) & (ms > 0), "DONE")
              .otherwise("running"))
    return j.select(*runs.columns, status.alias("status"),
                    F.when(started, step).alias("step"),
                    F.when(started, ms).alias("max_steps"),
                    F.when(started, pct).alias("pct"), F.when(started, epoch).alias("epoch"),
                    F.col("last_loss"))


def compare_runs(metrics: DataFrame, runs: DataFrame, on: Sequence[str] = ("run_name",)) -> DataFrame:
    """CMP1: run metrics joined to the run dimension (AQE broadcasts the
    dimension when its measured size allows)."""
    return metrics.join(runs, list(on), "left")


def state_progress(runs: DataFrame, states: DataFrame) -> DataFrame:
    """PROG1 from state files: runs (run and more) left-joined to what
    ``read_trainer_states`` found, each with its own max_steps and epoch, in order of
    run (SORT2). Runs without a state are ``not started``; a state without its run is
    left out, as only the listed runs are asked for."""
    j = runs.join(states, "run", "left")
    step, ms = F.col("global_step"), F.col("max_steps")
    status = F.when(step.isNull(), "not started").when((step >= ms) & (ms > 0), "DONE").otherwise("running")
    pct = F.when(step.isNotNull(), F.when(ms > 0, F.lit(100.0) * step / ms).otherwise(F.lit(0.0)))
    return j.select(*runs.columns, status.alias("status"), step.alias("step"), "max_steps", pct.alias("pct"), "epoch", "last_loss").orderBy("run")
