"""Dataset manifest (SNK6) and path rebasing (PRJ15) as table operations.

The manifest maps a dataset name to its file and ShareGPT column mapping.
Upsert = old rows whose name is not in the new set, plus the new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ShareGPT column and tag mapping of every entry.
FORMATTING = "sharegpt"
COLUMNS = (("messages", "conversations"), ("system", "system"))
TAGS = (("role_tag", "from"), ("content_tag", "value"), ("user_tag", "human"),
        ("assistant_tag", "gpt"))
# In-repo folders whose absolute prefix is rewritten.
ANCHORS = ("training_data", "lora_runs", "eval_runs")


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def manifest_entries(written: DataFrame) -> DataFrame:
    """Entries for written datasets: ``written`` has (name, file_name)."""
    return written.select("name", "file_name", F.lit(FORMATTING).alias("formatting"),
                          _map(COLUMNS).alias("columns"), _map(TAGS).alias("tags"))


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add or overwrite entries by name; other old entries are kept. The
    anti join shuffles only names; AQE broadcasts the new side when small."""
    kept = old.join(new.select("name"), "name", "left_anti")
    return kept.unionByName(new)


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


# Token = run of characters other than double quote and POSIX space.
_TOKEN = r'[^"\t\n\x0B\f\r ]*'


def rebase_paths(c: Column, repo_dir: str, model_cache_dir: str | None = None) -> Column:
    """PRJ15: in every token, replace everything before the *last*
    ``/training_data/``, ``/lora_runs/`` or ``/eval_runs/`` with ``repo_dir``;
    with a model cache, also re-root ``.../Qwen__<name>``. Idempotent."""
    anchors = "|".join(ANCHORS)
    out = F.regexp_replace(c, rf"{_TOKEN}/({anchors})/", _java_replacement(repo_dir) + "/$1/")
    if model_cache_dir:
        out = F.regexp_replace(out, rf"{_TOKEN}/(Qwen__[A-Za-z0-9._-]+)",
                               _java_replacement(model_cache_dir) + "/$1")
    return out
