"""Column names, study parameters and session helpers.

Every operator takes its column names from a small frozen dataclass, so the
same code runs on the course layout (``NOF_PPN``, ``episode_start_date`` ...)
and on the fixture views (``person_id``, ``start_date`` ...).
"""

from __future__ import annotations

import datetime as dt
import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Where a local session without spark.checkpoint.dir keeps its stages.
_OWN_DIR = "spark.staylink.stages"


@dataclass(frozen=True)
class EpisodeCols:
    """Names of the episode columns an operator reads."""

    person: str = "person_id"
    episode: str = "episode_id"  # unique per row: the final tiebreak of every ordering
    start: str = "start_date"
    end: str = "end_date"
    age: str = "age"
    code: str = "diag_code"
    mode: str = "mode"

    def all(self) -> list[str]:
        return [self.person, self.episode, self.start, self.end, self.age, self.code, self.mode]

    def order(self) -> list[str]:
        """Episode order within a person: start, end, then the unique episode id."""
        return [self.start, self.end, self.episode]


@dataclass(frozen=True)
class DeathCols:
    person: str = "person_id"
    date: str = "death_date"
    age: str = "age_death"


@dataclass(frozen=True)
class Study:
    """Study parameters; the defaults are those of the fixture views (FIXTURES.md B)."""

    start: dt.date = dt.date(1996, 1, 1)
    end: dt.date = dt.date(2000, 12, 31)
    age_threshold: int = 65
    hip_pattern: str = r"^[12]-"
    transfer_modes: tuple[str, ...] = ("P",)
    # Ranges of the (person, start, end, id) order that every ordered per-person scan is cut
    # into (see operators/scan.py); None: the session's number of shuffle partitions.
    ranges: int | None = None
    # Persons with more death records than one, named by hand for removal (DQ-6).
    exclude_persons: tuple[int, ...] = field(default_factory=tuple)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local-mode session (one machine) without
    it gets a temporary folder, once; on a cluster that folder would not be shared, so a
    missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if not base:
        if not (spark.conf.get("spark.master", "") + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="staylink-ckpt-")
        spark.conf.set(_OWN_DIR, base)
    return f"{base.rstrip('/')}/{name}"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "staylink") -> SparkSession:
    """Session for tests and the bench: local mode, AQE with skew-join split, no UI."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STAYLINK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark, "")
    return spark
