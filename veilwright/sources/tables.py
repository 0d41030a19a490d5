"""Published tables, views, keyed merge, contracts and small literal relations."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of manifest entries.
ENTRY = re.compile(r"[0-9]{12}\.json")


class ContractError(ValueError):
    """A relation does not have its declared columns or types."""


def enforce_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail on any drift in column names, order or types; nullability is not compared."""
    declared = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if declared != actual:
        missing = [c for c in declared if c not in actual]
        unexpected = [c for c in actual if c not in declared]
        raise ContractError(f"contract drift: missing {missing}, unexpected {unexpected}")
    return df


def literal_relation(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType) -> DataFrame:
    """A small relation of constants, with an explicit schema."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def merge_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows are replaced, new rows added, rows absent from ``incoming`` kept."""
    if existing.columns != incoming.columns:
        raise ContractError(f"merge needs equal columns: {existing.columns} and {incoming.columns}")
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti").select(existing.columns)
    return kept.unionByName(incoming)


class Conflict(RuntimeError):
    """Tables that a build relies on were switched by another build meanwhile."""


@dataclass(frozen=True)
class Checks:
    """What every row of a table must satisfy, counted while the table is written.

    required: columns without nulls. accepted: the values of a column; null is left to `required`. conditions: named predicates
    that must be true or null, as SQL.
    """

    required: tuple[str, ...] = ()
    accepted: Mapping[str, Sequence] = field(default_factory=dict)
    conditions: Mapping[str, str] = field(default_factory=dict)

    def metrics(self) -> dict[str, Column]:
        """The number of offending rows of each rule, one aggregate each."""
        out = {f"{c} is null": F.count_if(F.col(c).isNull()) for c in self.required}
        for c, values in self.accepted.items():
            out[f"{c} is not one of {', '.join(map(str, values))}"] = F.count_if(~F.col(c).isin(*values))
        return out | {f"not {name}": F.count_if(~F.expr(sql)) for name, sql in self.conditions.items()}


@dataclass(frozen=True)
class Parts:
    """Versions that make up a relation: a base and the changes since, each with its number of rows.

    With changes, the newest row of a key stands.
    """

    versions: tuple[tuple[str, int | None], ...]
    keys: tuple[str, ...] = ()

    @property
    def tip(self) -> str:
        return self.versions[-1][0]


@dataclass(frozen=True)
class Snapshot:
    """What was visible after one entry of the manifest."""

    sequence: int = 0
    relations: Mapping[str, Parts] = field(default_factory=dict)


#: File systems on which an entry is linked, not renamed, into place.
LINKED = ("file",)
#: Changes are merged into a new base when they are more than this share of its rows, or so many versions.
COMPACT_SHARE = 0.25
MOST_CHANGES = 8


class AtomicLog:
    """Numbered entries in a folder; an entry is created whole, and only if there is none of its number.

    The folder must be on a file system whose renames are atomic and refuse an existing target, or on a local disk.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _file_system(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, dict]:
        """The last entry with its number; 0 and nothing if there is none."""
        folder, fs = self._file_system()
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        name = max((n for n in names if ENTRY.fullmatch(n)), default=None)
        if name is None:
            return 0, {}
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            return int(name.removesuffix(".json")), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, sequence: int, entry: dict) -> bool:
        """Entry `sequence`, whole or not at all; False if there is one."""
        jvm = self.spark._jvm
        folder, fs = self._file_system()
        fs.mkdirs(folder)
        draft, name = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f".draft-{uuid.uuid4().hex}", f"{sequence:012d}.json"))
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() in LINKED:
                # A link refuses an existing name in one step, which a local rename does not.
                paths = jvm.java.nio.file.Paths
                none = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
                at = [paths.get(fs.makeQualified(p).toUri().getPath(), none) for p in (name, draft)]
                jvm.java.nio.file.Files.createLink(*at)
            else:
                # Without options a rename refuses an existing target.
                options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(fs.makeQualified(draft), fs.makeQualified(name), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(draft, False)
        return True


class TableStore:
    """Versioned tables on plain parquet, switched by an atomic manifest.

    Each write is a new folder. Readers follow the manifest: numbered entries, each naming every visible version. An entry is created
    only if there is none of its number, so of two switches from one state one wins, and the other looks again: it goes on
    if what it relies on still stands, and fails if not. A lost driver or executor never leaves a half-written table visible.

    A keyed table may be a base and changes (write_changes), merged when read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = AtomicLog(spark, f"{self.root}/_manifest")

    # ---- folders ----

    def version_path(self, name: str, version: str) -> str:
        return f"{self.root}/{name}/version={version}"

    def _write(self, df: DataFrame, name: str, version: str, schema: T.StructType | None, checks: Checks | None) -> tuple[DataFrame, int]:
        """A version folder, read back, and its number of rows. Rows are counted and checked in the write itself."""
        if schema is not None:
            enforce_contract(df, schema)
        rules = {} if checks is None else checks.metrics()
        seen = Observation()
        columns = [F.count("*").alias("rows"), *(c.alias(f"rule_{i}") for i, c in enumerate(rules.values()))]
        path = self.version_path(name, version)
        df.observe(seen, *columns).write.mode("errorifexists").parquet(path)
        counts = seen.get
        broken = {rule: n for i, rule in enumerate(rules) if (n := counts.get(f"rule_{i}", 0))}
        if broken:
            raise ContractError(f"{name}: {'; '.join(f'{rule} in {n} rows' for rule, n in broken.items())}")
        return self.spark.read.schema(df.schema).parquet(path), counts.get("rows", 0)

    def write_version(
        self, df: DataFrame, name: str, version: str, schema: T.StructType | None = None, checks: Checks | None = None
    ) -> DataFrame:
        """Write one version folder and read it back, with exact size statistics for the planner.

        A row that breaks the checks fails the write: the folder is there, but no entry can name it before this returns.
        """
        return self._write(df, name, version, schema, checks)[0]

    def write_changes(
        self,
        changes: DataFrame,
        name: str,
        version: str,
        keys: Sequence[str],
        since: Snapshot,
        schema: T.StructType | None = None,
        checks: Checks | None = None,
    ) -> tuple[DataFrame, DataFrame, Parts]:
        """New and changed rows of a keyed table: the merged table, the changes read back, and the parts to switch to.

        No changes leave the parts as they are. Past COMPACT_SHARE or MOST_CHANGES, all parts become a new base.
        """
        written, rows = self._write(changes, name, version, schema, checks)
        old = since.relations.get(name)
        if old is None:
            return written, written, Parts(((version, rows),), tuple(keys))
        if not rows:
            return self.read_parts(name, old), written, old
        parts = Parts((*old.versions, (version, rows)), tuple(keys))
        base, later = parts.versions[0][1] or 0, sum(n or 0 for _, n in parts.versions[1:])
        merged = self.read_parts(name, parts)
        if later > COMPACT_SHARE * base or len(parts.versions) > MOST_CHANGES:
            merged, rows = self._write(merged, name, f"{version}.base", schema, checks)
            parts = Parts(((f"{version}.base", rows),), tuple(keys))
        return merged, written, parts

    def read_parts(self, name: str, parts: Parts) -> DataFrame:
        """Base and changes as one table: of the changes the newest row a key, of the base the keys without changes."""
        (first, _), *rest = parts.versions
        base = self.spark.read.parquet(self.version_path(name, first))
        if not rest:
            return base
        later = union_all(
            self.spark.read.schema(base.schema).parquet(self.version_path(name, version)).withColumn("_age", F.lit(i))
            for i, (version, _) in enumerate(rest)
        )
        row = F.struct(*base.columns)
        newest = later.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(parts.keys))).agg(F.max_by(row, "_age").alias("_row"))
        return merge_by_key(base, newest.select("_row.*"), parts.keys)

    # ---- manifest ----

    def snapshot(self) -> Snapshot:
        """The state after the last entry; entries are small and complete, so only one is read."""
        sequence, found = self.log.last()
        relations = {
            name: Parts(tuple((v, n) for v, n in parts["versions"]), tuple(parts["keys"])) for name, parts in found.get("relations", {}).items()
        }
        return Snapshot(sequence, relations)

    def current_versions(self) -> dict[str, str]:
        """Newest visible version per relation."""
        return {name: parts.tip for name, parts in self.snapshot().relations.items()}

    def check(self, since: Snapshot, watched: Iterable[str]) -> Snapshot:
        """What is visible now; Conflict if any of ``watched`` is not what it was."""
        now = self.snapshot()
        moved = sorted(n for n in watched if now.relations.get(n) != since.relations.get(n))
        if moved:
            raise Conflict(f"switched by another build since entry {since.sequence}: {', '.join(moved)}")
        return now

    def switch(
        self, names: Iterable[str] | Mapping[str, Parts], version: str, since: Snapshot | None = None, watched: Iterable[str] = ()
    ) -> Snapshot:
        """Make ``version`` (or the given parts) visible for all ``names`` together: the next entry of the manifest.

        If another build has taken that entry, the next one is tried on top of it. With ``since``, none of ``watched`` may differ
        from what was visible then: Conflict.
        """
        changed = dict(names) if isinstance(names, Mapping) else {name: Parts(((version, None),)) for name in names}
        watched = tuple(watched)
        while True:
            now = self.snapshot() if since is None else self.check(since, watched)
            relations = {**now.relations, **changed}
            rows = {name: {"versions": parts.versions, "keys": parts.keys} for name, parts in sorted(relations.items())}
            if self.log.create(now.sequence + 1, {"relations": rows}):
                return Snapshot(now.sequence + 1, relations)

    def publish(self, df: DataFrame, name: str, version: str, schema: T.StructType | None = None, checks: Checks | None = None) -> DataFrame:
        """Full replacement of one table."""
        out = self.write_version(df, name, version, schema, checks)
        self.switch([name], version)
        return out

    def read(self, name: str, snapshot: Snapshot | None = None) -> DataFrame | None:
        parts = (snapshot or self.snapshot()).relations.get(name)
        return None if parts is None else self.read_parts(name, parts)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
