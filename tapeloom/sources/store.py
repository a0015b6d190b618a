"""A stored table in buckets that is changed bucket by bucket: a manifest names the files that count, and a new one takes its place at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.merge import latest
from tapeloom.sources.documents import save_text
from tapeloom.sources.shared import stored

BUCKET = "__bucket"
KEPT = 20


class BucketStore:
    """Rows of one schema under a folder, dealt to buckets by an SQL expression over their columns.

    manifests/<version>.json names, for each bucket, the folder that holds it and its number of rows; the highest version counts. An update reads and writes only the
    buckets it touches, then adds the next manifest, which fails if another update has added one meanwhile (FileExistsError: nothing has changed then; run it again). What was written before a
    crash is in no manifest, so it is never read; vacuum deletes it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket: str) -> None:
        self.spark, self.path, self.schema, self.bucket = spark, path.rstrip("/"), schema, bucket
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.system = self.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self.fs.Path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self.system.listStatus(place)] if self.system.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, dict]]:
        """(version, bucket -> folder and rows) of a version, the newest if none is asked for; version 0 is an empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0]
        return version, json.loads(text)

    def read(self, buckets: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of all buckets, or of some: others aren't listed, let alone read."""
        _, found = self.manifest(version)
        wanted = found if buckets is None else [b for b in buckets if b in found]
        paths = [f"{self.path}/data/{found[b]['folder']}" for b in wanted]
        read = self.spark.read.schema(self.schema)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.expr(self.bucket).cast("string")

    def touched(self, rows: DataFrame) -> list[str]:
        """The buckets of rows: names only, as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def replace(self, rows: DataFrame, buckets: list[str], base: int) -> int:
        """The buckets now hold these rows and no others; returns the new version. base: the version that rows come from."""
        _, found = self.manifest(base)
        run = uuid.uuid4().hex
        dealt = rows.withColumn(BUCKET, self._bucket())
        # A bucket's rows meet in few files; Spark splits a large one.
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{run}")
        names = self._names(f"data/{run}")
        counts = {r[0]: r[1] for r in self.spark.read.parquet(f"{self.path}/data/{run}").groupBy(F.col(BUCKET).cast("string")).count().collect()} if any(n.startswith(BUCKET) for n in names) else {}
        if set(counts) - set(buckets):
            raise ValueError(f"rows of other buckets: {sorted(set(counts) - set(buckets))[:3]}")
        new = {b: x for b, x in found.items() if b not in buckets} | {b: {"folder": f"{run}/{BUCKET}={b}", "rows": n} for b, n in counts.items()}
        self._swap(base + 1, new)
        return base + 1

    def _swap(self, version: int, manifest: dict[str, dict]) -> None:
        save_text(self.spark, json.dumps(manifest), f"{self.path}/manifests/{version}.json", replace=False)

    def update(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Applies changes (which have the columns that the bucket's expression needs): apply(rows of the touched buckets, changes) gives what those buckets hold then."""
        changes = stored(changes, "store-changes")
        buckets, (base, _) = self.touched(changes), self.manifest()
        if not buckets:
            return base
        return self.replace(apply(self.read(buckets, base), changes), buckets, base)

    def vacuum(self, keep: int = KEPT) -> None:
        """Deletes the data that none of the newest `keep` manifests names, and older manifests. No update may run meanwhile."""
        versions = self.versions()
        used = {x["folder"].split("/")[0] for v in versions[-keep:] for x in self.manifest(v)[1].values()}
        for run in set(self._names("data")) - used:
            self.system.delete(self.fs.Path(f"{self.path}/data/{run}"), True)
        for v in versions[:-keep]:
            self.system.delete(self.fs.Path(f"{self.path}/manifests/{v}.json"), False)


def segment_store(spark: SparkSession, path: str, schema: str, buckets: int = 256, session: str = "session") -> BucketStore:
    """A store of segments; a session's are in one bucket. The number of buckets belongs to the table: never open it with another."""
    return BucketStore(spark, path, schema, f"pmod(xxhash64(CAST(`{session}` AS string)), {buckets})")


def upsert_segments(store: BucketStore, changes: DataFrame, keys: list[str], arrival: str = "arrival") -> int:
    """Latest-wins changes (with arrival, from 0) into stored segments, as merge_segments: only the changed sessions' buckets are rewritten."""

    def apply(held: DataFrame, new: DataFrame) -> DataFrame:
        both = held.withColumn(arrival, F.lit(-1).cast("long")).unionByName(new.withColumn(arrival, F.col(arrival).cast("long")))
        return latest(both, keys, arrival).select(*held.columns)

    return store.update(changes, apply)


def delete_sessions(store: BucketStore, sessions: DataFrame, session: str = "session") -> int:
    """Without the segments of these sessions."""
    return store.update(sessions, lambda held, gone: held.join(gone.select(session).distinct(), session, "left_anti").select(*held.columns))
