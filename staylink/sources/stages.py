"""SRC-4: stages of an analysis, committed one by one, resumed after a lost driver, deleted when done.

A run is a folder under the cluster's shared checkpoint folder:

    runs/<run>/_owner.json            the application that may commit
    runs/<run>/_manifest/<stage>.json  one file per committed stage
    runs/<run>/<stage>-<attempt>/      the stage's parquet files

A stage counts once its manifest file stands. That file is written aside and renamed, so it is
whole or absent; it names the data folder, the schema, the bucketing, the version of the input and
of the parameters, and the application. A driver that dies between two stages leaves committed
stages and perhaps a folder that no manifest names. The next driver that opens the run by name
takes it over, reads the committed stages of its own version and deletes everything else; a
driver that lost the run can no longer commit.

Stages whose rows are kept in ranges (operators/scan.py) are written bucketed by the range number:
a later step that groups by it reads each range in one task and shuffles nothing.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from staylink.config import scratch_dir


class StageLost(RuntimeError):
    """Another application has taken the run over."""


class Files:
    """The few file-system calls a manifest needs, through Hadoop's own interface."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def read(self, path: str) -> dict | None:
        at, fs = self._at(path)
        if not fs.exists(at):
            return None
        with_text = fs.open(at)
        try:
            raw = self._jvm.org.apache.commons.io.IOUtils.toString(with_text, "UTF-8")
        finally:
            with_text.close()
        return json.loads(raw)

    def write(self, path: str, content: dict) -> None:
        """The file is whole or absent: written aside, then renamed into place."""
        aside, fs = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        at, _ = self._at(path)
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(aside, at):
            raise OSError(f"cannot commit {path}")


def input_version(*parts) -> str:
    """A digest of whatever decides the stages' content (files with length and time, parameters)."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:32]


def file_versions(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file under the paths."""
    files = Files(spark)
    out = []
    for path in paths:
        at, fs = files._at(path)
        if not fs.exists(at):
            continue
        found = fs.listFiles(at, True)
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


_LIVE: weakref.WeakSet = weakref.WeakSet()


class StageStore:
    """The stages of one run. Without a name the run is this object's own: nobody resumes it, and
    what :meth:`close` has not deleted goes at the interpreter's exit."""

    def __init__(self, spark: SparkSession, run: str | None = None, version: str = ""):
        self.spark, self.version, self.named = spark, version, run is not None
        self.run = run or uuid.uuid4().hex[:16]
        self.root = scratch_dir(spark, f"runs/{self.run}")
        self.files = Files(spark)
        self.app = spark.sparkContext.applicationId
        self._opened = False
        self._tables: list[str] = []
        #: stages read from an earlier driver's commit, by name
        self.resumed: list[str] = []
        _LIVE.add(self)

    # ---- the run's folder -----------------------------------------------------------
    def _manifest(self, name: str) -> str:
        return f"{self.root}/_manifest/{name}.json"

    def _open(self) -> None:
        if self._opened:
            return
        self.files.write(f"{self.root}/_owner.json", {"application": self.app, "store": id(self)})
        self._opened = True
        committed = self.committed()
        for name, entry in committed.items():
            if entry["version"] != self.version or not self.files.exists(entry["path"]):
                self.files.delete(self._manifest(name))
        keep = {e["path"].rsplit("/", 1)[1] for e in self.committed().values()}
        for folder in self.files.names(self.root):
            if not folder.startswith("_") and folder not in keep:
                self.files.delete(f"{self.root}/{folder}")  # superseded, or never committed

    def _own(self) -> None:
        owner = self.files.read(f"{self.root}/_owner.json")
        if owner != {"application": self.app, "store": id(self)}:
            raise StageLost(f"run {self.run} belongs to {owner and owner['application']} now")

    def committed(self) -> dict[str, dict]:
        """The manifest: stage name to its entry."""
        names = [n.removesuffix(".json") for n in self.files.names(f"{self.root}/_manifest") if n.endswith(".json")]
        return {n: e for n in names if (e := self.files.read(self._manifest(n))) is not None}

    # ---- stages ---------------------------------------------------------------------
    def find(self, name: str) -> DataFrame | None:
        """The committed stage of this version, if there is one."""
        self._open()
        entry = self.files.read(self._manifest(name))
        if entry is None or entry["version"] != self.version or not self.files.exists(entry["path"]):
            return None
        if entry["application"] != self.app and name not in self.resumed:
            self.resumed.append(name)
        return self._read(entry)

    def write(self, df: DataFrame, name: str, *, buckets: int = 0, by: str = "", sort: Sequence[str] = (), dealt: bool = False) -> DataFrame:
        """Write the stage, commit it, and continue from its files. With ``buckets`` the rows of one
        value of ``by`` stand in one bucket, sorted; ``dealt``: each partition holds one value already."""
        self._open()
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        if buckets:
            table = f"staylink_w_{uuid.uuid4().hex}"
            # (a shuffle that the planner leaves out where the rows are dealt so)
            out = (df if dealt else df.repartition(buckets, by)).write.format("parquet").bucketBy(buckets, by)
            (out.sortBy(*sort) if sort else out).option("path", path).saveAsTable(table)
            schema = self.spark.table(table).schema
            self.spark.sql(f"DROP TABLE {table}")  # external: the files stay
        else:
            df.write.parquet(path)
            schema = self.spark.read.parquet(path).schema
        entry = {
            "stage": name, "path": path, "schema": schema.json(), "buckets": buckets, "by": by, "sort": list(sort),
            "version": self.version, "application": self.app,
        }
        self._own()
        before = self.files.read(self._manifest(name))
        self.files.write(self._manifest(name), entry)
        if before is not None:
            self.files.delete(before["path"])
        return self._read(entry)

    def stage(self, name: str, make, **layout) -> DataFrame:
        """The committed stage, or ``make()`` written and committed."""
        found = self.find(name)
        return found if found is not None else self.write(make(), name, **layout)

    def _read(self, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if not entry["buckets"]:
            return self.spark.read.schema(schema).parquet(entry["path"])
        table = "staylink_" + hashlib.sha256(entry["path"].encode()).hexdigest()[:24]
        if table not in self._tables:
            ddl = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(entry["schema"]).toDDL()
            sort = f"SORTED BY ({', '.join(f'`{c}`' for c in entry['sort'])}) " if entry["sort"] else ""
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING parquet CLUSTERED BY (`{entry['by']}`) {sort}"
                f"INTO {entry['buckets']} BUCKETS LOCATION '{entry['path']}'"
            )
            self._tables.append(table)
        return self.spark.table(table)

    def close(self) -> None:
        """Delete everything of the run: folders, manifest, catalog entries."""
        if self.spark.sparkContext._jsc is not None:  # a stopped session has no catalog any more
            for table in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()
        if self._opened or self.named:
            self.files.delete(self.root)
        self._opened = False
        _LIVE.discard(self)


_SCRATCH: dict[str, StageStore] = {}


def scratch_store(spark: SparkSession) -> StageStore:
    """The store of operators that are called without one: one a session, deleted at exit or by its
    ``close()``."""
    key = spark.sparkContext.applicationId
    if key not in _SCRATCH:
        _SCRATCH[key] = StageStore(spark)
    return _SCRATCH[key]


@atexit.register
def _delete_unnamed() -> None:
    for store in list(_LIVE):
        if not store.named:
            try:
                store.close()
            except Exception:  # the session is gone; its temporary folder is the system's to clean
                pass
