"""Keyed tables below one folder that change together: one small snapshot file names what every table holds.

A table's rows are dealt into parts by the hash of its key; every write is a run, a folder of its own with a folder for each
part. A snapshot lists the live runs of each part. It is written last and only if its number is free, so all tables change
at once or not at all, a job that dies leaves the last snapshot readable, and of two writers one is told to start again.
Files are never changed: a part that a change does not touch keeps its files and their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 16
#: Runs of one part that are read side by side before `compact` joins them.
MAX_RUNS = 8
FOLDER = "_snapshots"


class Conflict(RuntimeError):
    """Another writer has committed since this change began."""


class Tables:
    """`schemas`: the columns of each table as DDL or a struct type; `keys`: the columns whose hash deals its rows."""

    def __init__(self, spark: SparkSession, base: str, schemas: dict[str, str | T.StructType], keys: dict[str, list[str]], parts: int = PARTS):
        self.spark, self.base, self.keys, self.parts = spark, base.rstrip("/"), keys, parts
        self.schemas = {n: s if isinstance(s, T.StructType) else spark.createDataFrame([], s).schema for n, s in schemas.items()}

    # --- files ---

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *names)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[str]:
        files, path = self._files(), self._path(*folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _state(self, number: int) -> dict[str, dict[str, list[str]]] | None:
        """What snapshot `number` lists, or None if it was not written to its end."""
        if number == 0:
            return {}
        text = self.spark.read.text(f"{self.base}/{FOLDER}/{number:012d}.json", wholetext=True).first()
        try:
            return json.loads(text.value)["tables"]
        except (AttributeError, ValueError):
            return None

    def _numbers(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names(FOLDER) if n.endswith(".json") and n.split(".")[0].isdigit()]

    def latest(self) -> int:
        """Number of the last whole snapshot; 0 before the first."""
        return next((n for n in reversed(self._numbers()) if self._state(n) is not None), 0)

    def snapshots(self) -> list[int]:
        return [n for n in self._numbers() if self._state(n) is not None]

    # --- reading ---

    def part_of(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.parts)).cast("int")

    def parts_in(self, name: str, keys: DataFrame) -> list[int]:
        """Parts of table `name` where rows of these keys are; at most as many numbers as there are parts."""
        return sorted(r.part for r in keys.select(self.part_of(name).alias("part")).distinct().collect())

    def _read(self, name: str, live: dict[str, set[int]]) -> DataFrame:
        """Rows of these parts of these runs."""
        schema = T.StructType([*self.schemas[name].fields, T.StructField("run", T.StringType()), T.StructField("part", T.IntegerType())])
        live = {run: parts for run, parts in live.items() if parts}
        if not live:
            return self.spark.createDataFrame([], self.schemas[name])
        folder = f"{self.base}/{name}"
        rows = self.spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/run={run}" for run in sorted(live)))
        wanted = F.lit(False)
        for run, parts in sorted(live.items()):
            wanted |= (F.col("run") == run) & F.col("part").isin(*sorted(parts))
        return rows.where(wanted).drop("run", "part")

    def load(self, name: str, at: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """Table `name` in snapshot `at`, by default the last one; only some parts, if they are given."""
        return self._load(name, self._state(self.latest() if at is None else at), parts)

    def _load(self, name: str, state: dict, parts: Iterable[int] | None = None) -> DataFrame:
        chosen = None if parts is None else set(parts)
        live: dict[str, set[int]] = {}
        for part, runs in state.get(name, {}).items():
            for run in runs:
                if chosen is None or int(part) in chosen:
                    live.setdefault(run, set()).add(int(part))
        return self._read(name, live)

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """Rows that came and went between two snapshots, with `change` 'added' or 'removed'; equal rows count.

        Only runs that one of the two snapshots lacks are read; a row that moved unchanged from one run to another is no change.
        """
        old, new = (self._state(n).get(name, {}) for n in (since, self.latest() if until is None else until))
        gone, come = {}, {}
        for one, other, out in ((old, new, gone), (new, old, come)):
            for part, runs in one.items():
                for run in set(runs) - set(other.get(part, [])):
                    out.setdefault(run, set()).add(int(part))
        before, after = self._read(name, gone), self._read(name, come)
        added = after.exceptAll(before).withColumn("change", F.lit("added"))
        return added.unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))

    # --- writing ---

    def shaped(self, rows: DataFrame, name: str) -> DataFrame:
        fields = self.schemas[name].fields
        missing = {f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in rows.columns}
        return rows.withColumns(missing).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))

    def begin(self) -> Change:
        return Change(self)

    def compact(self, name: str, max_runs: int = MAX_RUNS) -> int | None:
        """Write each part with more than `max_runs` runs as one; the new snapshot's number, or None if there is no such part."""
        change = self.begin()
        many = [int(p) for p, runs in change.state.get(name, {}).items() if len(runs) > max_runs]
        if not many:
            return None
        change.rewrite(name, change.load(name, many), many)
        return change.commit()

    def expire(self, keep: int = 2) -> list[str]:
        """Delete runs that none of the last `keep` snapshots lists, and all earlier snapshot files; gives the deleted runs.

        For quiet hours: the run of a change that has not been committed yet is also one that no snapshot lists.
        """
        kept = self.snapshots()[-keep:]
        used = {(n, run) for k in kept for n, parts in self._state(k).items() for runs in parts.values() for run in runs}
        dead = [(n, run) for n in self.schemas for run in (x.removeprefix("run=") for x in self._names(n)) if (n, run) not in used]
        files = self._files()
        for number in self._numbers():
            if kept and number < kept[0]:
                files.delete(self._path(FOLDER, f"{number:012d}.json"), False)
        for name, run in dead:
            files.delete(self._path(name, f"run={run}"), True)
        return [run for _, run in dead]


class Change:
    """Writes to several tables that become visible together by `commit`. It reads the snapshot that was the last at its start,
    and its own writes."""

    def __init__(self, tables: Tables):
        self.tables, self.number = tables, tables.latest()
        self.state = {n: {p: list(runs) for p, runs in parts.items()} for n, parts in tables._state(self.number).items()}

    @property
    def changed(self) -> bool:
        return self.state != self.tables._state(self.number)

    def load(self, name: str, parts: Iterable[int] | None = None) -> DataFrame:
        return self.tables._load(name, self.state, parts)

    def holds(self, name: str, parts: Iterable[int]) -> bool:
        """Whether one of these parts has a run."""
        return any(self.state.get(name, {}).get(str(part)) for part in parts)

    def _write(self, name: str, rows: DataFrame, in_place: bool = False) -> tuple[str, list[int]]:
        run, tables = uuid.uuid4().hex, self.tables
        folder = f"{tables.base}/{name}/run={run}"
        dealt = tables.shaped(rows, name).withColumn("part", tables.part_of(name))
        # Parts are files of even size: a large part is split, small ones share a task.
        (dealt if in_place else dealt.hint("rebalance", "part")).write.partitionBy("part").parquet(folder)
        return run, [int(n.removeprefix("part=")) for n in tables._names(name, f"run={run}") if n.startswith("part=")]

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows as a run of their own."""
        run, found = self._write(name, rows)
        for part in found:
            self.state.setdefault(name, {}).setdefault(str(part), []).append(run)

    def rewrite(self, name: str, rows: DataFrame, parts: Iterable[int], in_place: bool = False) -> None:
        """Let `rows` be all that these parts hold; rows of other parts are refused. Other parts keep their files.

        `in_place`: the rows are a choice of those that lie in the parts, so every task writes what it has read, and nothing
        is shuffled.
        """
        parts = set(parts)
        run, found = self._write(name, rows, in_place)
        if not parts.issuperset(found):
            raise ValueError(f"Rows of {name} belong to parts {sorted(set(found) - parts)}, which are not rewritten.")
        held = self.state.setdefault(name, {})
        for part in parts:
            held.pop(str(part), None)
            if part in found:
                held[str(part)] = [run]

    def commit(self) -> int:
        """Write the next snapshot, unless another writer has done so since this change began."""
        tables, files = self.tables, self.tables._files()
        taken = tables._numbers()
        if tables.latest() != self.number:
            raise Conflict(f"Snapshot {self.number} is no longer the last one.")
        number = max([self.number, *taken]) + 1
        path = tables._path(FOLDER, f"{number:012d}.json")
        try:
            out = files.create(path, False)
        except Exception as refused:  # Py4J wraps whatever the file system says about a name that is taken.
            raise Conflict(f"Snapshot {number} is there already.") from refused
        out.write(bytearray(json.dumps({"tables": self.state, "before": self.number}).encode()))
        out.close()
        return number
