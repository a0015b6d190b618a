"""An index of session documents: folders are listed by tasks, and only documents that changed are read and parsed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.history import clamp_limit, newest
from tapeloom.sources.documents import MAX_DEPTH, NAMES, SCHEMAS, parse_documents
from tapeloom.sources.shared import stored
from tapeloom.sources.store import BucketStore

LISTED = "path string, size long, modified long, folder boolean"
FOLDERS_A_TASK = 200
#: A folder's day is a local date, startedAt is UTC: they are less than two days apart.
DAYS_APART = 2
NO_DAY = "none"


def _entries(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """(path, size, modified, whether it is a folder) of what a folder holds; links of a local one are passed over."""
    if "://" in folder and not folder.startswith("file:"):
        system, root = pafs.FileSystem.from_uri(folder)
        scheme = folder[: len(folder) - len(root)]
        for f in system.get_file_info(pafs.FileSelector(root)):
            yield scheme + f.path, f.size or 0, int(f.mtime_ns or 0), f.type == pafs.FileType.Directory
        return
    with os.scandir(re.sub(r"^file:/+", "/", folder)) as found:
        for e in found:
            if not e.is_symlink():
                stat = e.stat(follow_symlinks=False)
                yield f"file://{e.path}", stat.st_size, stat.st_mtime_ns, e.is_dir(follow_symlinks=False)


def _read(path: str) -> str:
    system, place = pafs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        return f.read().decode("utf-8", "replace")


def _list(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rows = [e for e in _entries(folder) if e[3] or e[0].rpartition("/")[2] == name]
                yield pd.DataFrame(rows, columns=["path", "size", "modified", "folder"])

    return run


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(len(batch)):
            one = batch.iloc[[i]]
            yield one.assign(content=[_read(one["path"].iloc[0])])


def list_files(spark: SparkSession, root: str, name: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(path, size, modified) of the files of a name at most depth folders below a root. A job a level; tasks list FOLDERS_A_TASK folders each, and no list visits the driver."""
    folders, found = spark.createDataFrame([(root.rstrip("/") if "://" in root else "file://" + re.sub(r"^file:/+", "/", root).rstrip("/"),)], "path string"), None
    n = 1
    for _ in range(depth + 1):
        level = stored(folders.repartition(-(-n // FOLDERS_A_TASK), "path").mapInPandas(_list(name), LISTED), "listed")
        files = level.filter("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        folders = level.filter("folder").select("path")
        n = folders.count()
        if not n:
            break
    return found


class DocumentIndex:
    """The documents of a kind below a root, parsed once for each path, size and time of modification; stored by the day that their folder names.

    Options as parse_documents, tolerant: unreadable documents are kept as corrupt, so they aren't parsed anew either."""

    def __init__(self, spark: SparkSession, root: str, path: str, kind: str = "session", depth: int = MAX_DEPTH) -> None:
        self.spark, self.root, self.kind, self.depth = spark, root, kind, depth
        self.store = BucketStore(spark, path, f"path STRING, size BIGINT, modified BIGINT, day STRING, directory STRING, corrupt BOOLEAN, {SCHEMAS[kind]}", "day")

    def refresh(self) -> tuple[int, int]:
        """Brings the index up to date; returns how many documents were parsed and how many are gone. Only days with changes are rewritten."""
        day = F.regexp_extract("path", r"/(\d{4}/\d{2}/\d{2})/[^/]+/[^/]+$", 1)
        there = list_files(self.spark, self.root, NAMES[self.kind], self.depth).withColumn("day", F.when(day == "", NO_DAY).otherwise(F.translate(day, "/", "-")))
        there = stored(there, "there")
        base, _ = self.store.manifest()
        known = self.store.read(version=base).select("path", "size", "modified", "day")
        changed = stored(there.join(known, ["path", "size", "modified"], "left_anti"), "changed")
        gone = stored(known.join(there.select("path"), "path", "left_anti"), "gone")
        counts = changed.count(), gone.count()
        days = sorted({r[0] for r in changed.select("day").unionByName(gone.select("day")).distinct().collect()})
        if days:
            files = changed.repartition(-(-counts[0] // FOLDERS_A_TASK) or 1, "path").mapInPandas(_contents, "path string, size long, modified long, day string, content string")
            files = files.withColumn("directory", F.regexp_replace("path", "/[^/]*$", ""))
            # The directory tells a document apart: one of a kind is in each.
            parsed = parse_documents(files, self.kind).join(changed.withColumn("directory", F.regexp_replace("path", "/[^/]*$", "")), "directory")
            kept = self.store.read(days, base).join(changed.select("path").unionByName(gone.select("path")), "path", "left_anti")
            columns = self.store.read([], base).columns
            self.store.replace(kept.select(*columns).unionByName(parsed.select(*columns)), days, base)
        return counts

    def documents(self) -> DataFrame:
        """All documents, as scan_documents gives them."""
        return self.store.read().drop("path", "size", "modified", "day")

    def newest_days(self, limit: int) -> list[str]:
        """The days that can hold any of the newest documents: from the manifest's counts, without reading anything.

        A corrupt document counts as one, so what is missing for it must be looked for in earlier days; newest_sessions does."""
        _, found = self.store.manifest()
        days, held, out = sorted((d for d in found if d != NO_DAY), reverse=True), 0, [NO_DAY]
        last = None
        for d in days:
            if held >= limit and last is not None and (pd.Timestamp(last) - pd.Timestamp(d)).days > DAYS_APART:
                break
            if held < limit:
                last = d
            held += found[d]["rows"]
            out.append(d)
        return out

    def newest_sessions(self, limit: int) -> DataFrame:
        """The newest readable documents, 1 to 500 of them, of the only days that can hold them."""
        want, asked = clamp_limit(limit), clamp_limit(limit)
        _, found = self.store.manifest()
        while True:
            days = self.newest_days(asked)
            good = self.store.read(days).filter("NOT corrupt")
            if len(set(days) & set(found)) == len(found) or good.limit(want).count() >= want and good.filter("day <> 'none'").count() >= want:
                return newest(good.drop("path", "size", "modified", "day"), limit)
            asked *= 2
