"""The reference analysis as a chain of lazy stages.

Part one: episodes -> clean and flag -> sequences -> cohort -> deaths resolved ->
linked -> transfer stays (the table part two starts from). Part two: hip stays,
length of stay, next admission, censoring, comorbidity, survival.

Each stage is a DataFrame built on the previous one. Five stages are written
once to the shared checkpoint folder and read back (SRC-4, sources/stages.py): the cleaned
episodes, the sequenced episodes, the linked episodes (end of part one), the
stays table (start of part two, the file the reference hands from one script to
the other) and the scored index episodes (one row per person, the input of every
survival step). That cuts the lineage, so a lost executor recomputes from those files
rather than from the raw tables, and a lost driver from the last committed stage.

The order of the episodes is made once: the cleaned episodes are written in ranges of
(person, start, end, id), and every later stage keeps the range number. Sequences, stays and hip
stays are windows inside the ranges, so none of them shuffles or sorts by person again.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylink.config import DeathCols, EpisodeCols, Study
from staylink.functions.dates import parse_dmy, parse_ymd
from staylink.operators.cohort import select_cohort
from staylink.operators.comorbidity import charlson_map, charlson_prefix_lengths, comorbidity_score, long_diagnoses, score_groups
from staylink.operators.deaths import link_deaths, resolve_deaths, type_deaths
from staylink.operators.episodes import add_flags, clean_episodes, sequence_episodes, type_episodes, with_episode_id
from staylink.operators.readmission import censor_times, index_episodes, next_admission
from staylink.operators.scan import BLOCK, drop_block, range_count, ranged
from staylink.operators.stays import hip_stays, transfer_stays
from staylink.sources import fixtures
from staylink.sources.csv import read_with_rejects
from staylink.sources.stages import StageStore, file_versions, input_version


class Analysis:
    """Stages of the analysis.

    Inputs are typed DataFrames (``episodes``, ``deaths``, a long ``diagnoses`` table and a
    ``code_map``); any left out come from the fixture views of ``sf_dir``. Use
    :meth:`from_csv` for text extracts with the course's own column names.

    ``run`` names the run: an analysis of the same inputs and parameters that is opened under
    that name later, by another driver, continues from the stages committed before.
    :meth:`close` deletes them.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str | None = None,
        study: Study = Study(),
        cols: EpisodeCols = EpisodeCols(),
        dcols: DeathCols = DeathCols(),
        *,
        episodes: DataFrame | None = None,
        deaths: DataFrame | None = None,
        diagnoses: DataFrame | None = None,
        diagnosis_columns: list[str] | None = None,
        code_map: DataFrame | None = None,
        hierarchy: dict[str, str] | None = None,
        prefix_lengths: list[int] | None = None,
        materialize_stages: bool = True,
        run: str | None = None,
    ):
        self.spark, self.sf_dir, self.study, self.cols, self.dcols = spark, sf_dir, study, cols, dcols
        #: lines of text extracts that have not the columns' number of fields (SRC-1); null without extracts
        self.rejects: DataFrame | None = None
        #: the episodes are the linked table of part one already (:meth:`from_linked_csv`)
        self.part_two = False
        self.materialize = materialize_stages
        if sf_dir is None and (episodes is None or deaths is None):
            raise ValueError("give sf_dir or both episodes and deaths")
        self._episodes = episodes if episodes is not None else fixtures.fx_episode(spark, sf_dir)
        #: columns of the episodes that hold codes, used where no long table is given
        self._diagnosis_columns = diagnosis_columns or [cols.code]
        self._deaths = deaths if deaths is not None else fixtures.fx_death(spark, sf_dir)
        if code_map is None and diagnoses is None and sf_dir is not None:
            # the fixture's own map; no hierarchy among its two conditions
            self._diagnoses = fixtures.fx_diagnosis(spark, sf_dir)
            self._code_map = fixtures.fx_code_map(spark)
            self._hierarchy: dict[str, str] | None = {}
            self._lengths = sorted({len(p) for p, _, _ in fixtures.FX_CODE_MAP_ROWS})
        else:
            self._diagnoses = diagnoses
            self._code_map = code_map if code_map is not None else charlson_map(spark)
            self._hierarchy = hierarchy
            self._lengths = prefix_lengths or (charlson_prefix_lengths() if code_map is None else None)
        #: ranges of the order that all scans share
        self.ranges = range_count(self._episodes, study.ranges)
        #: the written stages; a run with a name survives its driver (see sources/stages.py)
        self.store = StageStore(spark, run, self._version() if run else "")

    def _version(self) -> str:
        """What the stages depend on: the files of every input with length and time, how they are
        read (the plan's text, without its expression numbers), and the parameters."""
        inputs = [d for d in (self._episodes, self._deaths, self._diagnoses, self._code_map) if d is not None]
        plans = [re.sub(r"#\d+L?", "", d._jdf.queryExecution().analyzed().toString()) for d in inputs]
        files = [file_versions(self.spark, d.inputFiles()) for d in inputs]
        return input_version(plans, files, self.study, self.cols, self.dcols, self.ranges, self._diagnosis_columns, self._hierarchy, self._lengths)

    @classmethod
    def from_csv(
        cls,
        spark: SparkSession,
        episodes_path: str,
        deaths_path: str,
        study: Study = Study(),
        cols: EpisodeCols = EpisodeCols(),
        dcols: DeathCols = DeathCols(),
        *,
        episode_columns: list[str] | None = None,
        death_columns: list[str] | None = None,
        diagnoses: DataFrame | None = None,
        **kw,
    ) -> Analysis:
        """SRC-1: text extracts with a header row, day-month-year dates, ``NA`` for missing.

        ``episode_columns`` / ``death_columns`` list the files' columns in order (default:
        the names in ``cols`` / ``dcols``). Extra columns are kept as text.
        """
        ecols = episode_columns or [cols.person, cols.episode, cols.start, cols.end, cols.age, cols.code, cols.mode]
        dcols_list = death_columns or [dcols.person, dcols.date, dcols.age]
        raw, bad_episodes = read_with_rejects(spark, episodes_path, ecols)
        episodes = type_episodes(raw, cols)
        if cols.episode not in ecols:
            episodes = with_episode_id(episodes, cols)
        raw_deaths, bad_deaths = read_with_rejects(spark, deaths_path, dcols_list)
        out = cls(spark, None, study, cols, dcols, episodes=episodes, deaths=type_deaths(raw_deaths, dcols), diagnoses=diagnoses, **kw)
        out.rejects = bad_episodes.select(F.lit("episodes").alias("table"), "*").unionByName(bad_deaths.select(F.lit("deaths").alias("table"), "*"))
        return out

    @classmethod
    def from_linked_csv(
        cls, spark: SparkSession, path: str, columns: list[str], study: Study = Study(), cols: EpisodeCols = EpisodeCols(), dcols: DeathCols = DeathCols(), **kw
    ) -> Analysis:
        """SRC-2: part two on its own, from the linked table that part one wrote as text (episodes with
        the death columns beside them, ISO or day-month-year dates, ``NA`` for missing).

        ``columns`` are the file's in order. The persons are the cohort already: sequences are
        made anew from the rows, nothing is selected or linked, and :attr:`deaths` are the file's.
        """
        raw, rejects = read_with_rejects(spark, path, columns)

        def date(c: str):
            return F.coalesce(parse_ymd(c), parse_dmy(c))

        episodes = type_episodes(raw, cols, date_parser=date).withColumns({dcols.date: date(dcols.date), dcols.age: F.col(dcols.age).try_cast("double").cast("int")})
        if cols.episode not in columns:
            episodes = with_episode_id(episodes, cols)
        died = episodes.filter(F.col(dcols.date).isNotNull()).select(F.col(cols.person).alias(dcols.person), dcols.date, dcols.age).distinct()
        out = cls(spark, None, study, cols, dcols, episodes=episodes, deaths=died, **kw)
        out.part_two, out.rejects = True, rejects.select(F.lit("linked").alias("table"), "*")
        return out

    @property
    def stage_paths(self) -> list[str]:
        """The folders of the stages committed so far."""
        return [e["path"] for e in self.store.committed().values()]

    def _stage(self, name: str, make, *, in_ranges: bool = False, dealt: bool = False) -> DataFrame:
        """The committed stage of that name, or the one that make() gives, written and committed."""
        if not self.materialize:
            return make()
        layout = dict(buckets=self.ranges, by=BLOCK, dealt=dealt) if in_ranges else {}
        return self.store.stage(name, make, **layout)

    def close(self) -> None:
        """Delete everything that this analysis wrote (and nothing else), wherever it is."""
        self.store.close()

    # ---- part one -------------------------------------------------------------------
    @cached_property
    def _episodes_in_order(self) -> DataFrame:
        """The cleaned episodes in their ranges: the one shuffle into the order of the scans."""
        clean = add_flags(clean_episodes(self._episodes, self.cols, self.study), self.cols, self.study)
        if not self.materialize:
            return clean
        order = ranged(clean, [self.cols.person], self.cols.order(), self.ranges)
        return self._stage("episodes", lambda: order, in_ranges=True, dealt=True)

    @cached_property
    def episodes(self) -> DataFrame:
        """DOM-1 + DOM-2: distinct episodes inside the study period, with both flags."""
        return drop_block(self._episodes_in_order)

    @cached_property
    def _sequenced(self) -> DataFrame:
        def make() -> DataFrame:
            return sequence_episodes(self._episodes_in_order, self.cols, self.study, keep_block=True, store=self.store)

        return self._stage("sequenced", make, in_ranges=True)

    @cached_property
    def sequenced(self) -> DataFrame:
        """DOM-3 (before the cohort filter, as in the reference)."""
        return drop_block(self._sequenced)

    @cached_property
    def _cohort(self) -> DataFrame:
        if self.part_two:
            return self._sequenced
        return select_cohort(self._sequenced, self.cols)

    @cached_property
    def cohort(self) -> DataFrame:
        """DOM-5."""
        return drop_block(self._cohort)

    @cached_property
    def deaths(self) -> DataFrame:
        return self._deaths.distinct()

    @cached_property
    def resolution(self) -> DataFrame:
        """DQ-6: one row per person with a death record: the record kept, or why the person goes."""
        return resolve_deaths(self.deaths, self.cohort, self.cols, self.dcols, self.study.exclude_persons)

    @cached_property
    def _linked(self) -> DataFrame:
        if self.part_two:
            return self._sequenced
        return self._stage("linked", lambda: link_deaths(self._cohort, self.resolution, self.cols, self.dcols), in_ranges=True)

    @cached_property
    def linked(self) -> DataFrame:
        """JN-1."""
        return drop_block(self._linked)

    @cached_property
    def _stays(self) -> DataFrame:
        def make() -> DataFrame:
            return transfer_stays(self._linked, self.cols, self.study, keep_block=True, store=self.store)

        return self._stage("stays", make, in_ranges=True)

    @cached_property
    def stays(self) -> DataFrame:
        """DOM-4: the linked table with transfer stays (part two's input)."""
        return drop_block(self._stays)

    # ---- part two -------------------------------------------------------------------
    @cached_property
    def hip_stays(self) -> DataFrame:
        """DOM-7."""
        return hip_stays(self._stays, self.cols, self.study, store=self.store)

    @cached_property
    def index(self) -> DataFrame:
        """First hip episode per person, with the discharge date of its stay."""
        return index_episodes(self.stays, self.cols)

    @cached_property
    def readmission(self) -> DataFrame:
        """DOM-8 + DOM-9."""
        return censor_times(next_admission(self.index, self.stays, self.cols), self.study.end)

    @cached_property
    def scored(self) -> DataFrame:
        """DOM-10 on the index episodes, with groups and labels: the analysis table of
        part two (one row per person), written once for the survival steps. Without a
        long diagnosis table, the episodes' own diagnosis columns are scored."""
        return self._stage("scored", self._score)

    def _score(self) -> DataFrame:
        diagnoses = self._diagnoses
        if diagnoses is None:
            diagnoses = long_diagnoses(self.stays, self._diagnosis_columns, episode_col=self.cols.episode)
        scored = comorbidity_score(
            self.readmission,
            diagnoses,
            self._code_map,
            episode_col=self.cols.episode,
            hierarchy=self._hierarchy,
            prefix_lengths=self._lengths,
        )
        return score_groups(scored)
