"""Sources and sinks: CSV ingest (SRC-1/2), fixture views over the test tables, parquet hand-over (SRC-4)."""

from staylink.sources.csv import read_text_csv, write_text_csv
from staylink.sources.fixtures import (
    fx_code_map,
    fx_death,
    fx_diagnosis,
    fx_episode,
    fx_episode_text,
    load_tables,
)
from staylink.sources.stages import StageStore, scratch_store

__all__ = [
    "StageStore",
    "fx_code_map",
    "fx_death",
    "fx_diagnosis",
    "fx_episode",
    "fx_episode_text",
    "load_tables",
    "read_text_csv",
    "scratch_store",
    "write_text_csv",
]
