"""SFT conversation layouts ("setups"), the fan-out and the loss mask.

A setup is a named list of turns built from Column expressions over the
canonical example columns (prompt, thinking, answer). The registry is the
extension point (UDF1): registering a setup adds Column expressions, never
a per-row Python function. The fan-out is a single ``explode`` over an array
of per-setup structs -- one pass over the data for all setups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of the conversation layouts.
SYSTEM_PROMPT = ("You are a careful retrieval assistant that ranks candidate tables by "
                 "their relevance to a user's question.")
HINT_INSTRUCTION = ("Think step-by-step before answering; here is an example of the kind of "
                    "reasoning to learn from:\n")
ANSWER_CUE = "Based on that reasoning, give the final ranking."

Turns = Callable[[], list[tuple[str, Column]]]


@dataclass(frozen=True)
class Setup:
    name: str
    label: str
    mask_history: bool
    description: str
    turns: Turns


_REGISTRY: dict[str, Setup] = {}


def register_setup(name: str, turns: Turns, mask_history: bool = False, label: str | None = None,
                   description: str = "") -> Setup:
    """Add (or replace) a setup. ``turns`` returns [(role, Column)] where role
    is ``human`` or ``gpt``; with ``mask_history`` only the last gpt turn is a
    loss target."""
    s = Setup(name, label or name, mask_history, description, turns)
    _REGISTRY[name] = s
    return s


def unregister_setup(name: str) -> None:
    """Take a setup out again; DataFrames that were built with it keep it."""
    _REGISTRY.pop(name, None)


def setups() -> list[Setup]:
    return list(_REGISTRY.values())


def _p() -> Column:
    return F.col("prompt")


def _t() -> Column:
    return F.col("thinking")


def _a() -> Column:
    return F.col("answer")


def response() -> Column:
    """thinking + blank line + answer."""
    return F.concat(_t(), F.lit("\n\n"), _a())


def hint_prompt() -> Column:
    """prompt + blank line + hint instruction (ends in a newline) + thinking."""
    return F.concat(_p(), F.lit("\n\n" + HINT_INSTRUCTION), _t())


# Fixed registry of the four built-in setups (name, label, mask_history).
register_setup("setup1_full_loss", lambda: [("human", _p()), ("gpt", response())],
               False, "full_loss", "one reply with reasoning and ranking; all of it is trained on")
register_setup("setup2_answer_only",
               lambda: [("human", _p()), ("gpt", _t()), ("human", F.lit(ANSWER_CUE)), ("gpt", _a())],
               True, "answer_only", "reasoning turn, cue, ranking turn; only the ranking is trained on")
register_setup("setup3_1_hint_answer_only", lambda: [("human", hint_prompt()), ("gpt", _a())],
               False, "hint_answer_only", "the prompt carries sample reasoning; the reply is the bare ranking")
register_setup("setup3_2_hint_full_loss", lambda: [("human", hint_prompt()), ("gpt", response())],
               False, "hint_full_loss", "the prompt carries sample reasoning; the reply repeats it, then ranks")


def conversation(s: Setup) -> Column:
    """``array<struct<from, value>>`` for one setup."""
    return F.array(*[F.struct(F.lit(role).alias("from"), value.alias("value"))
                     for role, value in s.turns()])


def fan_out(canonical: DataFrame, only: list[str] | None = None,
            keep: list[str] | None = None) -> DataFrame:
    """PRJ5-11: every example x every setup in one pass (explode of an array
    of structs). Output: keep columns (default pos, qid), setup,
    mask_history, system, conversations."""
    keep = keep if keep is not None else [c for c in ("pos", "qid", "split") if c in canonical.columns]
    chosen = [s for s in setups() if only is None or s.name in only]
    per_setup = F.array(*[F.struct(F.lit(s.name).alias("setup"),
                                   F.lit(s.mask_history).alias("mask_history"),
                                   conversation(s).alias("conversations")) for s in chosen])
    x = canonical.select(*keep, F.explode(per_setup).alias("s"))
    return x.select(*keep, "s.setup", "s.mask_history", F.lit(SYSTEM_PROMPT).alias("system"),
                    "s.conversations")


def record_json(df: DataFrame) -> Column:
    """The ShareGPT record as compact JSON: ``{"system": ..., "conversations":
    [{"from": ..., "value": ...}, ...]}`` (key order, nulls and non-ASCII kept)."""
    return F.to_json(F.struct(F.col("system"), F.col("conversations")), {"ignoreNullFields": "false"})


def with_record(df: DataFrame) -> DataFrame:
    """Adds ``record`` (compact JSON) and PRJ13 ``rec_bytes`` = UTF-8 bytes + 1
    (one separator), computed once."""
    r = df.withColumn("record", record_json(df))
    return r.withColumn("rec_bytes", (F.octet_length("record") + 1).cast("long"))


def loss_turns(fanned: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """PRJ12: one row per turn with ``in_loss``: gpt turns are loss targets,
    except that with ``mask_history`` only the last gpt turn is."""
    keep = keep if keep is not None else [c for c in ("pos", "qid") if c in fanned.columns]
    last_gpt = F.array_max(F.transform(
        F.col("conversations"), lambda t, i: F.when(t["from"] == "gpt", i)))
    t = fanned.select(*keep, "setup", "mask_history", last_gpt.alias("_last"),
                      F.posexplode("conversations").alias("turn", "t"))
    is_gpt = F.col("t.from") == "gpt"
    in_loss = is_gpt & (~F.col("mask_history") | (F.col("turn") == F.col("_last")))
    return t.select(*keep, "setup", "turn", F.col("t.from").alias("role"),
                    F.col("t.value").alias("value"), in_loss.alias("in_loss"))
