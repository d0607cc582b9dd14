"""A store of immutable Parquet shards under a versioned manifest, with size-tiered compaction.

``append`` writes what arrives as small shards.  ``compact`` merges runs of shards of one size tier into files of the
target size and leaves full files alone, so a row is rewritten about once a tier.  A manifest is a whole list of
shards; it becomes visible by one rename to the next version's name, which fails if another writer was first; an append
then tries again on the newer manifest.  Object stores rename by copying, so the store refuses them.  Readers open the
files of one manifest and never list folders.  Files of failed or lost work are in no manifest; ``vacuum`` deletes them
when they are older than any append in flight may be.

Cases: nulls, empty and long texts, ties and repeated rows are kept as they are, each row once; an empty append adds
no shard and an empty store reads as no rows of its schema; columns of any names pass through (names that differ only
in case are refused by Spark's writer); appends of another schema are refused.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a full file; shards of one tier from which a run is merged; growth of a tier; runs merged in one job.
TARGET_BYTES, LEAST_RUN, TIER, RUNS_A_JOB = 128 << 20, 4, 4, 64
#: Seconds for which ``vacuum`` spares files that no manifest names, and tries of an append.
GRACE_SECONDS, TRIES = 86_400, 8
#: Schemes of stores whose rename is a copy, not one step.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "oss", "cos", "cosn", "obs", "wasb", "wasbs", "swift")


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    order: int


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if (scheme := self.files.getUri().getScheme()) in OBJECT_STORES:
            raise ValueError(f"{scheme} has no atomic rename, which commits need")

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self.files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:11]) for s in self.files.listStatus(folder) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest if none is named; an empty one before the first."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "next": 0, "shards": []}
        stream = self.files.open(self._path(f"manifests/v{have[-1] if version is None else version:010d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        """Makes a manifest visible at once, or raises if its version is there already."""
        spare = self._path(f"pending/{uuid.uuid4().hex}.json")
        stream = self.files.create(spare, False)
        stream.write(bytearray(json.dumps(manifest).encode("utf-8")))
        stream.close()
        self.files.mkdirs(self._path("manifests"))
        target = self._path(f"manifests/v{manifest['version']:010d}.json")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self.files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(spare, target, none)
        except Exception as e:
            self.files.delete(spare, False)
            if self.files.exists(target):
                raise CommitConflict(f"version {manifest['version']} exists") from e
            raise
        return manifest["version"]

    def _write(self, df: DataFrame) -> list[tuple[int, str, int, int]]:
        """Writes shards in a new folder: (number of the task, path, bytes, rows) of those that hold rows."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        sizes = {s.getPath().getName(): s.getLen() for s in self.files.listStatus(self._path(name)) if s.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        counted = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
        return sorted((int(r.f.split("-")[1]), f"{name}/{r.f}", sizes[r.f], r.n) for r in counted.collect())

    def append(self, df: DataFrame) -> int:
        """Commits the rows of ``df`` as new small shards; the new version.  The files are written once, whoever commits between."""
        schema, made = df.schema.json(), None
        for left in reversed(range(TRIES)):
            old = self.manifest()
            if old["schema"] is not None and _shape(old["schema"]) != _shape(schema):
                raise ValueError("an append must have the columns of the store")
            made = self._write(df) if made is None else made
            new = [Shard(path, size, rows, old["next"] + i) for i, (_, path, size, rows) in enumerate(made)]
            try:
                return self._commit({"version": old["version"] + 1, "schema": old["schema"] or schema, "next": old["next"] + len(new), "shards": [*old["shards"], *map(asdict, new)]})
            except CommitConflict:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def compact(self, target_bytes: int = TARGET_BYTES, least_run: int = LEAST_RUN) -> list[int]:
        """Merges until no tier has a run left; the versions committed."""
        done = []
        while runs := plan_runs([Shard(**s) for s in self.manifest()["shards"]], target_bytes, least_run):
            for at in range(0, len(runs), RUNS_A_JOB):
                done.append(self._merge(runs[at : at + RUNS_A_JOB]))
        return done

    def _merge(self, runs: list[list[Shard]]) -> int:
        """One file a run, in one job without a shuffle: a task reads its run's shards one after another."""
        old = self.manifest()
        schema = T.StructType.fromJson(json.loads(old["schema"]))
        parts = [self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in run)).coalesce(1) for run in runs]
        made = self._write(reduce(DataFrame.unionAll, parts))
        if sum(m[3] for m in made) != sum(s.rows for run in runs for s in run):
            raise RuntimeError("a merge has other rows than its shards")
        new = [Shard(path, size, rows, runs[i][0].order) for i, path, size, rows in made]
        gone = {s.path for run in runs for s in run}
        kept = [s for s in old["shards"] if s["path"] not in gone]
        if len(kept) + len(gone) != len(old["shards"]):
            raise CommitConflict("a shard of the run has left the manifest")
        shards = sorted([*kept, *map(asdict, new)], key=lambda s: s["order"])
        return self._commit(old | {"version": old["version"] + 1, "shards": shards})

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        got = self.manifest(version)
        if got["schema"] is None:
            raise ValueError("the store has no version yet")
        schema = T.StructType.fromJson(json.loads(got["schema"]))
        if not got["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in got["shards"]))

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> int:
        """Deletes files that the latest manifest doesn't name, and older manifests; the number of files.

        Both are spared for ``grace_seconds``: an append that has not committed yet, and readers of older versions.
        """
        have, live, gone = self.versions(), {s["path"] for s in self.manifest()["shards"]}, 0
        before = time.time() * 1000 - grace_seconds * 1000
        old = lambda status: grace_seconds <= 0 or status.getModificationTime() < before
        for v in have[:-1]:
            path = self._path(f"manifests/v{v:010d}.json")
            if old(self.files.getFileStatus(path)):
                self.files.delete(path, False)
            else:
                live |= {s["path"] for s in self.manifest(v)["shards"]}
        for folder in self.files.listStatus(self._path("data")):
            for file in self.files.listStatus(folder.getPath()):
                name = file.getPath().getName()
                if name.startswith("part-") and f"data/{folder.getPath().getName()}/{name}" not in live and old(file):
                    gone += bool(self.files.delete(file.getPath(), False))
        return gone


def _shape(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(schema)).fields]


def plan_runs(shards: list[Shard], target_bytes: int, least_run: int) -> list[list[Shard]]:
    """Runs of similarly sized shards, oldest first, each about as large as the target at most.

    Shards of half the target or more are full.  Tier k holds sizes from target / 4**(k+1) up to target / 4**k.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: s.order):
        if 2 * s.bytes < target_bytes:
            k = 0
            while s.bytes * TIER ** (k + 1) < target_bytes and k < 15:
                k += 1
            tiers.setdefault(k, []).append(s)
    runs = []
    for tier in tiers.values():
        run: list[Shard] = []
        for s in tier:
            if run and sum(x.bytes for x in run) + s.bytes > target_bytes:
                runs.append(run)
                run = []
            run.append(s)
        runs.append(run)
    return [run for run in runs if len(run) >= least_run or (len(run) > 1 and 2 * sum(s.bytes for s in run) >= target_bytes)]
