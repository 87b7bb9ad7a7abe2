"""Metadata store (projects, checkpoints, logs) as Parquet tables, and verified, versioned stages."""

from __future__ import annotations

import contextlib
import json
import logging
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import CHECKPOINTS, LOGS, PROJECTS, to_canonical

LOG = logging.getLogger("peakloom.store")
SCHEMAS = {"projects": PROJECTS, "checkpoints": CHECKPOINTS, "processing_logs": LOGS}
KEYS = {"projects": "project_id", "checkpoints": "checkpoint_id", "processing_logs": "log_id"}
#: Retention, applied in this order: age in days, number of projects, gigabytes, versions of a checkpoint.
RETENTION = {"days": 60, "projects": 20, "gb": 50.0, "versions": 5}
SCHEMA_VERSION = 1
#: Stages of the analysis of new samples, in order.
STAGES = ("peak_detection", "temporal_correction", "grouping", "match", "normalization")


def now_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


# --- queries over the three tables -----------------------------------------------------------------------------


def last_valid_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The newest valid checkpoint of each project (ties: greatest id)."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("checkpoint_id"))
    return checkpoints.where("is_valid").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def list_checkpoints(checkpoints: DataFrame, project_id: int, with_invalid: bool = False) -> DataFrame:
    own = checkpoints.where(F.col("project_id") == project_id)
    return (own if with_invalid else own.where("is_valid")).orderBy(F.desc("created_at"), F.desc("checkpoint_id"))


def query_logs(logs: DataFrame, project_id: int, level: str | None = None, step: str | None = None, limit: int = 100) -> DataFrame:
    out = logs.where(F.col("project_id") == project_id)
    if level is not None:
        out = out.where(F.col("log_level") == level)
    if step is not None:
        out = out.where(F.col("step_name") == step)
    return out.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(limit)


def projects_by_change(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("last_modified"), F.desc("project_id"))


def project_statistics(checkpoints: DataFrame, logs: DataFrame) -> DataFrame:
    """For each project: checkpoints, valid ones, their megabytes, the newest; errors, warnings and seconds of its logs."""
    c = checkpoints.groupBy("project_id").agg(
        F.count("*").alias("n_checkpoints"), F.count_if("is_valid").alias("n_valid"), F.sum("file_size_mb").alias("total_mb"), F.max("created_at").alias("last_checkpoint")
    )
    level = F.col("log_level")
    s = logs.groupBy("project_id").agg(F.count_if(level == "ERROR").alias("n_errors"), F.count_if(level == "WARNING").alias("n_warnings"), F.sum("execution_time_seconds").alias("seconds"))
    return c.join(s, "project_id", "full")


def crash_scan(projects: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Projects still marked as running have crashed; they can resume if a valid checkpoint exists."""
    last = last_valid_checkpoint(checkpoints).select("project_id", "checkpoint_id")
    n = checkpoints.where("is_valid").groupBy("project_id").agg(F.count("*").alias("n_valid"))
    return (
        projects.where("status = 'running'")
        .join(last, "project_id", "left")
        .join(n, "project_id", "left")
        .select("project_id", F.lit(True).alias("crashed"), F.col("checkpoint_id").isNotNull().alias("can_resume"), F.col("checkpoint_id").alias("resume_from"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"))
    )


def versions_to_purge(versions: DataFrame, keep: int = RETENTION["versions"], key: str = "checkpoint", version: str = "version") -> DataFrame:
    """Versions of each checkpoint behind the newest ``keep``."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep)


def cleanup_plan(projects: DataFrame, days: float = RETENTION["days"], most: int = RETENTION["projects"], gb: float = RETENTION["gb"], now: str | None = None) -> DataFrame:
    """Projects to delete with the rule that says so: too old; beyond the newest ``most``; or, newest first, beyond the size that
    fits. projects: project_id, last_modified (timestamp), size_mb; one row each, a catalogue of a few thousand at most."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    order = Window.orderBy(F.desc("last_modified"), F.desc("project_id"))
    p = projects.withColumn("old", F.col("last_modified") < at - F.expr(f"INTERVAL {round(days * 86400)} SECONDS"))
    young = p.where("NOT old").withColumn("place", F.row_number().over(order))
    held = young.where(F.col("place") <= most).withColumn("sum_mb", F.sum("size_mb").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rules = (
        p.where("old").select("project_id", F.lit("age").alias("rule")),
        young.where(F.col("place") > most).select("project_id", F.lit("count").alias("rule")),
        held.where(F.col("sum_mb") > gb * 1024).select("project_id", F.lit("size").alias("rule")),
    )
    return rules[0].unionByName(rules[1]).unionByName(rules[2])


def size_by_project(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(F.count("*").alias("n_files"), F.sum("size_mb").alias("total_mb"), F.max("size_mb").alias("largest_mb"))


# --- the store -------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")


class Conflict(Exception):
    """Another writer's commit came first, again and again."""


@dataclass
class Store:
    """The three tables below a folder, each a log of numbered commits. A commit is a folder of changed rows (whole rows, or
    marks that a key is gone) and the list of the commits that make up the table with it. It is written beside and gets its
    number by one rename, which one writer alone can win; who loses reads again and tries anew, so no change is lost and a
    reader sees whole commits. A key's newest row counts. After ``COMPACT`` commits the next one holds the whole table, and
    commits that neither it nor the state before it needs are deleted. Keys only grow, also past rows that are gone. The
    file system's rename of a folder must be atomic and must not replace one that is there."""

    spark: SparkSession
    root: str

    COMPACT = 20
    TRIES = 100

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}.log"

    def _text(self, path: str) -> str | None:
        fs, p = _fs(self.spark, path)
        if not fs.exists(p):
            return None
        data = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()

    def _put_text(self, path: str, text: str) -> None:
        fs, p = _fs(self.spark, path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _latest(self, name: str) -> int:
        """The newest commit: from the hint on as far as there are any, which spares a listing; without a good hint by the listing.
        Old commits are deleted from the first on, so one that is there has all later ones behind it."""
        folder = self._folder(name)
        try:
            hint = self._text(f"{folder}/_hint")
        except Py4JJavaError:  # another writer is putting a new one in its place
            hint = None
        if hint and hint.isdigit() and exists(self.spark, f"{folder}/v{hint}"):
            v = int(hint)
            while exists(self.spark, f"{folder}/v{v + 1}"):
                v += 1
            return v
        fs, p = _fs(self.spark, folder)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def _state(self, name: str, version: int) -> dict:
        return json.loads(self._text(f"{self._folder(name)}/v{version}/_state")) if version else {"parts": [], "owner": None}

    def _changes(self, name: str, version: int, parts: list[int]) -> DataFrame:
        """All changes that make up the table."""
        schema = T.StructType([*SCHEMAS[name].fields, T.StructField("_drop", T.BooleanType()), T.StructField("_version", T.LongType())])
        if parts:
            return self.spark.read.schema(schema).parquet(*[f"{self._folder(name)}/v{p}" for p in parts])
        if not version and exists(self.spark, f"{self.root}/{name}"):  # a table from before there were commits
            old = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
            return old.withColumns({"_drop": F.lit(False), "_version": F.lit(0).cast("long")})
        return self.spark.createDataFrame([], schema)

    def _fold(self, name: str, changes: DataFrame) -> DataFrame:
        """The newest row of each key, with marks of keys that are gone."""
        w = Window.partitionBy(KEYS[name]).orderBy(F.desc("_version"))
        return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def table(self, name: str) -> DataFrame:
        v = self._latest(name)
        return self._fold(name, self._changes(name, v, self._state(name, v)["parts"])).where("NOT _drop").select(*SCHEMAS[name].names)

    def init(self) -> None:
        for name in SCHEMAS:
            if not self._latest(name):
                self._commit(name, lambda table, number: None, empty=True)

    def _commit(self, name: str, change: Callable[[DataFrame, int], DataFrame | None], empty: bool = False) -> None:
        """Apply ``change`` (the table as it is now, the next free number) -> changed rows with ``_drop``, or None for no change."""
        folder, columns = self._folder(name), SCHEMAS[name].names
        for attempt in range(self.TRIES):
            v = self._latest(name)
            state = self._state(name, v)
            changes = self._changes(name, v, state["parts"])
            table = self._fold(name, changes)
            number = (changes.agg(F.max(KEYS[name])).first()[0] or 0) + 1
            rows = change(table.where("NOT _drop").select(*columns), number)
            if rows is None and not empty:
                return
            rows = self.spark.createDataFrame([], changes.schema) if rows is None else rows.select(*columns, "_drop", F.lit(v + 1).cast("long").alias("_version"))
            whole = len(state["parts"]) >= self.COMPACT or (not v and not changes.isEmpty())
            if whole:  # the greatest key stays, also as a mark
                folded = self._fold(name, changes.unionByName(rows))
                rows = folded.where(~F.col("_drop") | (F.col(KEYS[name]) == number - 1)).withColumn("_version", F.lit(v + 1).cast("long"))
            parts, owner = ([v + 1] if whole else [*state["parts"], v + 1]), uuid.uuid4().hex
            part = f"{folder}/.part-{owner}"
            rows.coalesce(1).write.parquet(part)
            self._put_text(f"{part}/_state", json.dumps({"parts": parts, "owner": owner, "before": state["parts"]}))
            with contextlib.suppress(OSError):
                rename(self.spark, part, f"{folder}/v{v + 1}")
            if self._state(name, v + 1)["owner"] == owner:
                if whole:
                    self._forget(name, {*parts, *state["parts"]})
                self._put_text(f"{folder}/.hint-{owner}", str(v + 1))
                delete(self.spark, f"{folder}/_hint")
                with contextlib.suppress(OSError):
                    rename(self.spark, f"{folder}/.hint-{owner}", f"{folder}/_hint")
                return
            # a rename onto a folder that is there may have put this one inside
            delete(self.spark, part)
            delete(self.spark, f"{folder}/v{v + 1}/.part-{owner}")
            time.sleep(random.uniform(0, 0.05 * (attempt + 1)))
        raise Conflict(f"{name}: {self.TRIES} commits of others came first")

    def _forget(self, name: str, needed: set[int]) -> None:
        fs, p = _fs(self.spark, self._folder(name))
        for x in fs.listStatus(p):
            n = x.getPath().getName()
            if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) < min(needed):
                fs.delete(x.getPath(), True)

    def _rows(self, name: str, rows: list[dict]) -> DataFrame:
        made = self.spark.createDataFrame([tuple(r.get(c) for c in SCHEMAS[name].names) for r in rows], SCHEMAS[name])
        return made.withColumn("_drop", F.lit(False))

    def _append(self, name: str, row: dict) -> int:
        """Add a row under the next number."""
        given: list[int] = []

        def add(table: DataFrame, number: int) -> DataFrame:
            given.append(number)
            return self._rows(name, [row | {KEYS[name]: number}])

        self._commit(name, add)
        return given[-1]

    def _next(self, name: str, key: str) -> int:
        """A number that no row has or had."""
        v = self._latest(name)
        return (self._changes(name, v, self._state(name, v)["parts"]).agg(F.max(key)).first()[0] or 0) + 1

    def upsert_project(self, project_name: str, data_directory: str = "", total_files: int = 0, cache_directory: str = "", cache_id: str = "") -> int:
        """By unique name; an existing project starts again as running."""
        given: list[int] = []

        def change(table: DataFrame, number: int) -> DataFrame:
            old = table.where(F.col("project_name") == project_name).first()
            row = old.asDict() if old else {"project_id": number, "project_name": project_name, "created_at": now_text()}
            row |= {"data_directory": data_directory, "total_files": total_files, "cache_directory": cache_directory, "cache_id": cache_id, "last_modified": now_text(), "status": "running", "processing_stage": "initialized"}
            given.append(row["project_id"])
            return self._rows("projects", [row])

        self._commit("projects", change)
        return given[-1]

    def project(self, project_id: int):
        return self.table("projects").where(F.col("project_id") == project_id).first()

    def update_project(self, project_id: int, **changes) -> None:
        """Change the given columns alone."""
        if bad := set(changes) - set(PROJECTS.names):
            raise ValueError(f"no such columns: {sorted(bad)}")
        new = {k: F.lit(v) for k, v in (changes | {"last_modified": now_text()}).items()}
        self._commit("projects", lambda table, _: table.where(F.col("project_id") == project_id).withColumns(new).withColumn("_drop", F.lit(False)))

    def register_checkpoint(self, project_id: int, step_id: str, step_name: str, path: str, size_mb: float, checksum: str, variables: list[str], next_step: str | None = None, seconds: float | None = None) -> int:
        return self._append("checkpoints", {"project_id": project_id, "step_id": step_id, "step_name": step_name, "checkpoint_file_path": path, "created_at": now_text(), "file_size_mb": size_mb, "checksum_md5": checksum, "is_valid": True, "variables_stored": variables, "next_step": next_step, "execution_time_seconds": seconds})

    def log(self, project_id: int | None, step: str, level: str, message: str, seconds: float | None = None, details: str | None = None) -> None:
        LOG.log(getattr(logging, level, logging.INFO), "%s: %s", step, message)
        self._append("processing_logs", {"project_id": project_id, "timestamp": now_text(), "step_name": step, "log_level": level, "message": message, "execution_time_seconds": seconds, "error_details": details})

    def invalidate(self, checkpoint_id: int) -> None:
        self._commit("checkpoints", lambda table, _: table.where(F.col("checkpoint_id") == checkpoint_id).withColumns({"is_valid": F.lit(False), "_drop": F.lit(False)}))

    def _drop(self, name: str, which: Column) -> None:
        self._commit(name, lambda table, _: table.where(which).withColumn("_drop", F.lit(True)))

    def purge_invalid(self, project_id: int) -> int:
        """Delete the project's invalid checkpoints, and then their files; their number."""
        gone = self.table("checkpoints").where((F.col("project_id") == project_id) & ~F.col("is_valid")).select("checkpoint_id", "checkpoint_file_path").collect()
        if gone:
            self._drop("checkpoints", F.col("checkpoint_id").isin([r["checkpoint_id"] for r in gone]))
        for r in gone:
            delete(self.spark, r["checkpoint_file_path"])
        return len(gone)

    def delete_project(self, project_id: int) -> None:
        """From all three tables."""
        for name in SCHEMAS:
            self._drop(name, F.col("project_id") == project_id)

    def clean_up(self, sizes: DataFrame, now: str | None = None, **limits) -> list[int]:
        """Apply ``cleanup_plan``: its projects leave all three tables, and then their cache folders go, so that a run cut short
        leaves folders without a project and not the reverse. sizes: project_id, size_mb. The plan is a catalogue of a few
        thousand projects at most."""
        known = self.table("projects").join(sizes.select("project_id", "size_mb"), "project_id", "left").withColumn("size_mb", F.coalesce("size_mb", F.lit(0.0)))
        plan = cleanup_plan(known.withColumn("last_modified", F.col("last_modified").cast("timestamp")), now=now, **limits).select("project_id").distinct()
        gone = known.join(plan, "project_id", "left_semi").select("project_id", "cache_directory").collect()
        ids = [r["project_id"] for r in gone]
        for name in reversed(SCHEMAS) if ids else ():
            self._drop(name, F.col("project_id").isin(ids))
        for r in gone:
            if r["cache_directory"]:
                delete(self.spark, r["cache_directory"])
        return sorted(ids)

    def crashed(self) -> DataFrame:
        return crash_scan(self.table("projects"), self.table("checkpoints"))

    def statistics(self) -> DataFrame:
        return project_statistics(self.table("checkpoints"), self.table("processing_logs"))


# --- versions of the stored form ---------------------------------------------------------------------------------

Frames = dict[str, DataFrame]
#: Stored version -> the step that makes frames of the next version of it.
MIGRATIONS: dict[int, Callable[[Frames, dict], Frames]] = {}


def migration(version: int) -> Callable[[Callable[[Frames, dict], Frames]], Callable[[Frames, dict], Frames]]:
    """Registers the step from ``version`` to the next: (frames, manifest) -> frames."""

    def register(step: Callable[[Frames, dict], Frames]) -> Callable[[Frames, dict], Frames]:
        if version in MIGRATIONS:
            raise ValueError(f"version {version} has a step")
        MIGRATIONS[version] = step
        return step

    return register


@migration(0)
def _canonical_spellings(frames: Frames, manifest: dict) -> Frames:
    """Version 0 (manifests without a version) kept external spellings of the columns."""
    return {k: to_canonical(df) for k, df in frames.items()}


def migrate(frames: Frames, manifest: dict) -> Frames:
    """Frames as the present version has them. A newer version than this, and one without a step, raise."""
    version = int(manifest.get("schema_version", 0))
    if version > SCHEMA_VERSION:
        raise ValueError(f"checkpoint {manifest.get('name')} is of version {version}; this engine reads up to {SCHEMA_VERSION}")
    for v in range(version, SCHEMA_VERSION):
        if v not in MIGRATIONS:
            raise ValueError(f"no step from version {v} to {v + 1}")
        frames = MIGRATIONS[v](frames, manifest)
    return frames


# --- stages ----------------------------------------------------------------------------------------------------


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, an order-free checksum of all values)."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return r["n"], f"{int(r['s'] or 0) & (2**128 - 1):032x}"


@dataclass
class Checkpoints:
    """Versioned sets of DataFrames: Parquet for each and a manifest with rows and checksum of each version."""

    spark: SparkSession
    root: str
    keep: int = RETENTION["versions"]

    def _read(self, path: str) -> dict | None:
        if not exists(self.spark, path):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def versions(self, name: str) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(x[1:]) for x in found if x[:1] == "v" and x[1:].isdigit())

    def save(self, name: str, frames: dict[str, DataFrame], **info) -> int:
        """Write beside, verify, then rename: a version is whole or absent. Old versions beyond ``keep`` go."""
        version = max(self.versions(name), default=0) + 1
        part = f"{self.root}/{name}/.part-{version}"
        delete(self.spark, part)
        manifest = {"schema_version": SCHEMA_VERSION, "name": name, "version": version, "created_at": now_text(), "frames": {}, **info}
        for k, df in frames.items():
            df.write.option("compression", "zstd").parquet(f"{part}/{k}")
            back = self.spark.read.parquet(f"{part}/{k}")
            n, s = digest(back)
            manifest["frames"][k] = {"rows": n, "checksum": s, "columns": back.columns}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{part}/manifest")
        rename(self.spark, part, f"{self.root}/{name}/v{version}")
        for old in self.versions(name)[: -self.keep]:
            delete(self.spark, f"{self.root}/{name}/v{old}")
        return version

    def manifest(self, name: str, version: int | None = None) -> dict | None:
        have = self.versions(name)
        if not have or (version is not None and version not in have):
            return None
        return self._read(f"{self.root}/{name}/v{version or have[-1]}/manifest")

    def verify(self, name: str, version: int) -> list[str]:
        """Frames of a version that are absent or whose checksum, its own, differs."""
        m = self.manifest(name, version)
        if m is None:
            return ["manifest"]
        bad = []
        for k, want in m["frames"].items():
            path = f"{self.root}/{name}/v{version}/{k}"
            if not exists(self.spark, path) or digest(self.spark.read.parquet(path)) != (want["rows"], want["checksum"]):
                bad.append(k)
        return bad

    def load(self, name: str, version: int | None = None, repair: bool = False) -> dict[str, DataFrame]:
        """The frames of a version (default: newest). A failed check raises; with ``repair`` the newest good version before it serves."""
        have = self.versions(name)
        if not have:
            raise KeyError(f"no checkpoint {name}")
        wanted = version or have[-1]
        for v in [wanted, *([x for x in reversed(have) if x < wanted] if repair else [])]:
            bad = self.verify(name, v)
            if not bad:
                manifest = self.manifest(name, v)
                return migrate({k: self.spark.read.parquet(f"{self.root}/{name}/v{v}/{k}") for k in manifest["frames"]}, manifest)
            LOG.warning("checkpoint %s v%d fails its check: %s", name, v, bad)
        raise ValueError(f"checkpoint {name} v{wanted} fails its check")

    def names(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []

    def info(self) -> list[dict]:
        """The newest manifest of each checkpoint, newest first."""
        out = [m for n in self.names() if (m := self.manifest(n))]
        return sorted(out, key=lambda m: (m["created_at"], m["name"]), reverse=True)

    def clean(self, keep: int | None = None) -> list[str]:
        """Delete all but the newest ``keep`` versions of every checkpoint; what went."""
        gone = [f"{n}/v{v}" for n in self.names() for v in self.versions(n)[: -max(1, keep or self.keep)]]
        for x in gone:
            delete(self.spark, f"{self.root}/{x}")
        return gone

    def health(self, repair: bool = False) -> dict[str, list[str]]:
        """Failed frames of every version; with ``repair`` those versions are deleted."""
        out = {}
        for n in self.names():
            for v in self.versions(n):
                if bad := self.verify(n, v):
                    out[f"{n}/v{v}"] = bad
                    if repair:
                        delete(self.spark, f"{self.root}/{n}/v{v}")
        return out


@dataclass
class StageMachine:
    """The stages in order, each a function from the frames so far to its own; resumed from the last good checkpoint."""

    checkpoints: Checkpoints
    steps: dict[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]
    order: tuple[str, ...] = STAGES

    def resume_point(self) -> str | None:
        """The last stage of an unbroken row of good checkpoints."""
        last = None
        for s in self.order:
            have = self.checkpoints.versions(s)
            if not have or self.checkpoints.verify(s, have[-1]):
                break
            last = s
        return last

    def restore(self, target: str) -> dict[str, DataFrame]:
        """All frames of the stages up to ``target``; later stages replace earlier frames of the same name."""
        out: dict[str, DataFrame] = {}
        for s in self.order[: self.order.index(target) + 1]:
            out |= self.checkpoints.load(s)
        return out

    def variables(self, stage: str) -> list[str]:
        """Names of the frames that are there once ``stage`` is done: its own and those of the stages before it, by their manifests."""
        held = [self.checkpoints.manifest(s) for s in self.order[: self.order.index(stage) + 1]]
        return sorted({k for m in held if m for k in m["frames"]})

    def run(self, frames: dict[str, DataFrame], until: str | None = None, resume: bool = True) -> dict[str, DataFrame]:
        last = self.resume_point() if resume else None
        out = frames | (self.restore(last) if last else {})
        start = self.order.index(last) + 1 if last else 0
        end = self.order.index(until) + 1 if until else len(self.order)
        for s in self.order[start:end]:
            began = time.time()
            made = self.steps[s](out)
            self.checkpoints.save(s, made, seconds=time.time() - began, stage=s)
            out |= self.checkpoints.load(s)
        return out
