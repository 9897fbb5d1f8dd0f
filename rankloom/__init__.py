"""rankloom: table-ranking SFT corpus curation and ranking evaluation on Spark.

Every public operator takes and returns DataFrames (or Columns), so Catalyst
sees one declarative plan per job. See README.md for the operator map.
"""

from rankloom.session import configure, get_session, scratch_dir

__all__ = ["configure", "get_session", "scratch_dir"]
