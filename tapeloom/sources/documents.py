"""Session documents: schemas, scans, point reads and sinks."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.text import partial_path

NAMES = {"session": "session.json", "transcript": "transcript.json", "translation": "translation.json"}
MARKER = "install.json"
MARKER_SCHEMA = "model_id string, revision string, artifacts array<struct<name: string, sha256: string, size: bigint>>"
MAX_DEPTH = 5
SCHEMAS = {
    "session": """sessionId STRING, startedAt TIMESTAMP, completedAt TIMESTAMP, status STRING, audioFormat STRING, audioSource STRING, lastError STRING,
        sampleRate BIGINT, schemaVersion BIGINT, segmentMinutes BIGINT,
        segments ARRAY<STRUCT<index: BIGINT, fileName: STRING, sampleCount: BIGINT, durationMs: BIGINT, startedOffsetMs: BIGINT, finalized: BOOLEAN>>""",
    "transcript": """sessionId STRING, status STRING, modelId STRING, forcedLanguage STRING, threads INT, unloadAfterIdleMinutes BIGINT, schemaVersion BIGINT, updatedAt TIMESTAMP,
        translation STRUCT<enabled: BOOLEAN, endpoint: STRING, model: STRING, targetLanguage: STRING>,
        segments ARRAY<STRUCT<id: BIGINT, startMs: BIGINT, endMs: BIGINT, status: STRING, attempts: BIGINT, text: STRING, detectedLanguage: STRING, audioFile: STRING, error: STRING, peakProbability: FLOAT>>""",
    "translation": """sessionId STRING, status STRING, endpoint STRING, model STRING, targetLanguage STRING, schemaVersion BIGINT, updatedAt TIMESTAMP,
        segments ARRAY<STRUCT<segmentId: BIGINT, sourceText: STRING, text: STRING, status: STRING, attempts: BIGINT, error: STRING>>""",
}
REQUIRED = {"session": ("sessionId", "startedAt", "status", "segments"), "transcript": ("sessionId", "status", "segments"), "translation": ("sessionId", "status", "segments")}


def parse_documents(files: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """The documents in files (directory, content) of a kind: the parsed columns, directory, and (tolerant) corrupt.

    strict: any unreadable document fails the query. Tolerant: such a row stays with corrupt = true, so a caller can drop
    what belongs to it and still count it. A document without a required field is unreadable too; unknown fields are ignored."""
    read = F.from_json("content", f"{SCHEMAS[kind]}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": "true"})
    found = files.select("directory", read.alias("d"))
    lacks = F.col("d").isNull() | F.col("d._corrupt").isNotNull()
    for name in REQUIRED[kind]:
        lacks = lacks | F.col(f"d.{name}").isNull()
    if strict:
        return found.select("directory", lacks.alias("__lacks"), "d.*").withColumn("sessionId", F.when(F.col("__lacks"), F.raise_error(F.concat(F.lit("unreadable document in "), "directory")).cast("string")).otherwise(F.col("sessionId"))).drop("_corrupt", "__lacks")
    return found.select("directory", lacks.alias("corrupt"), "d.*").drop("_corrupt")


def plain_files(root: str, name: str, depth: int = MAX_DEPTH) -> list[str]:
    """Paths of the files of a name at most depth folders below a local root; links, to files or folders, are passed over."""
    found, base = [], re.sub(r"^file:/+", "/", root).rstrip("/") or "/"
    for folder, folders, files in os.walk(base, followlinks=False):
        below = 0 if folder == base else folder[len(base) :].strip("/").count("/") + 1
        if below >= depth:
            folders.clear()
        if name in files and not os.path.islink(f"{folder}/{name}"):
            found.append(f"file://{folder}/{name}")
    return sorted(found)


def scan_documents(spark: SparkSession, root: str, kind: str, strict: bool = False, depth: int = MAX_DEPTH) -> DataFrame:
    """All documents of a kind at most depth folders under a root, as parse_documents gives them.

    A local root is listed without following links. Other file systems, which have none, are listed by Spark."""
    if root.startswith(("/", "file:")):
        paths = plain_files(root, NAMES[kind], depth)
        if not paths:
            return parse_documents(spark.createDataFrame([], "directory string, content string"), kind, strict)
        read = spark.read.text(paths, wholetext=True)
    else:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", NAMES[kind]).text(root, wholetext=True)
        below = F.substring(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""), len(root.rstrip("/")) + 1, 1 << 20)
        read = read.filter(F.size(F.split(below, "/")) - 1 <= depth)
    return parse_documents(read.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("directory"), F.col("value").alias("content")), kind, strict)


def load_document(spark: SparkSession, directory: str, kind: str, depth: int = MAX_DEPTH) -> DataFrame | None:
    """One document, strictly; None if there is none. depth 0: that of the folder itself, not of folders below."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{NAMES[kind]}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return scan_documents(spark, directory, kind, strict=True, depth=depth)


def session_date(directory: str = "directory"):
    """The local date that a session's folder names; null elsewhere."""
    return F.try_to_date(F.regexp_extract(F.col(directory), r"/(\d{4}/\d{2}/\d{2})/[^/]+$", 1), "yyyy/MM/dd")


def save_documents(documents: DataFrame, path: str, by: tuple[str, ...] = ("year", "month", "day")) -> None:
    """Documents as Parquet by day (or by the first of these parts), so that later reads prune; Spark's committer makes the write all or nothing.

    A folder's rows meet before the write, so that it holds few files, not one for each task; Spark splits a heavy one."""
    day = F.to_date("startedAt") if "startedAt" in documents.columns else F.to_date("updatedAt")
    dated = documents.withColumns({"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})
    dated.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite").parquet(path)


def save_text(spark: SparkSession, text: str, path: str, replace: bool = True) -> None:
    """A small document under a path, all or nothing: written beside it, then renamed over it. Two writers at once: one of them wins whole.

    replace False: FileExistsError if there is one already, so that of two writers at once one fails."""
    fs = spark._jvm.org.apache.hadoop.fs
    place, beside = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    context = fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        context.rename(system.makeQualified(beside), system.makeQualified(place), over)
    except Exception as fault:
        system.delete(beside, False)
        if "FileAlreadyExists" in str(fault):
            raise FileExistsError(path) from None
        raise


def save_marker(spark: SparkSession, marker: dict, package: str) -> None:
    """The marker of an installed model (model_id, revision, artifacts), in its package's folder."""
    save_text(spark, json.dumps(marker, indent=2, ensure_ascii=False), f"{package}/{MARKER}")


def load_markers(spark: SparkSession, root: str) -> DataFrame:
    """The markers of all packages (root/model/revision), for valid_markers; unreadable ones have nulls, as a model without one."""
    read = spark.read.option("pathGlobFilter", MARKER).option("recursiveFileLookup", True).text(root, wholetext=True)
    return read.select(F.from_json("value", MARKER_SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).select("m.*").filter("model_id IS NOT NULL")


def _resolved(spark: SparkSession, path: str) -> str:
    """The path with its scheme and without links: by the operating system for local folders, by the file system for others."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    full = place.makeQualified(system.getUri(), system.getWorkingDirectory())
    if system.getUri().getScheme() == "file":
        return "file:" + os.path.realpath(full.toUri().getPath())
    return system.resolvePath(full).toString()


def _inside(directory: str, root: str) -> bool:
    """Whether a folder lies below the root; the root itself doesn't."""
    return directory.rstrip("/") != root.rstrip("/") and f"{directory.rstrip('/')}/".startswith(f"{root.rstrip('/')}/")


def without_session(manifests: DataFrame, session_id: str, root: str) -> DataFrame:
    """The manifests that stay. Deleting a session that still records, or one that isn't below the root, is refused; this compares paths as they are written."""
    mine = manifests.filter(F.col("sessionId") == session_id)
    inside = re.sub(r"^file:/+", "/", root.rstrip("/")) + "/"
    folder = F.regexp_replace(F.regexp_replace("directory", "^file:/+", "/"), "/+$", "")
    outside = ~(F.startswith(folder, F.lit(inside)) & (F.length(folder) > len(inside))) | F.contains("directory", F.lit("/../"))
    bad = mine.filter((F.col("status") == "recording") | outside).limit(1).count()
    if bad:
        raise ValueError("an active session, or one outside the root, can't be deleted")
    return manifests.filter(F.col("sessionId") != session_id)


def delete_session(manifests: DataFrame, session_id: str, root: str) -> None:
    """Deletes the folder of a session; an unknown or blank id is an error. What stays shows in a new scan.

    Links in the folder's address and the root's are followed first: the folder must lie below the root and isn't the root. Its manifest
    is then read again: it must still be this session's, and it may not record by now."""
    if not session_id.strip():
        raise ValueError("no such session")
    without_session(manifests, session_id, root)
    folders = [r[0] for r in manifests.filter(F.col("sessionId") == session_id).select("directory").distinct().limit(2).collect()]
    if len(folders) != 1:
        raise ValueError("no such session")
    spark = manifests.sparkSession
    folder = _resolved(spark, folders[0])
    if not _inside(folder, _resolved(spark, root)):
        raise ValueError("a session outside the root can't be deleted")
    now = load_document(spark, folder, "session", depth=0)
    now = now and now.select("sessionId", "status").first()
    if now is None or now.sessionId != session_id or now.status == "recording":
        raise ValueError("an active session can't be deleted")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Fixed values: (model, artifact kind, bytes).
VOICE_DETECTOR_BYTES = 643_854
MODEL_BYTES = {"qwen3-asr-0.6b-int8": 879_346_277, "qwen3-asr-1.7b-int8": 2_404_866_275, "funasr-nano-int8": 842_374_465, "whisper-large-v3-int8": 1_069_126_342}


def model_artifacts(spark: SparkSession) -> DataFrame:
    """What each model of the catalogue is made of, as kinds and sizes; name is the kind."""
    rows = [(m, k, k, n) for m, total in MODEL_BYTES.items() for k, n in (("model", total - VOICE_DETECTOR_BYTES), ("voice_detector", VOICE_DETECTOR_BYTES))]
    return spark.createDataFrame(rows, "model_id string, kind string, name string, size long")


def model_catalog(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("model_id").agg(F.sum("size").alias("total_bytes"))


def _there(artifacts: DataFrame, files: DataFrame, ready: DataFrame) -> DataFrame:
    """artifacts with what is there of each: whole_length and whole_sha256 of its file, part_length of its partial file, and whether its model is ready."""
    by = files.groupBy("model_id", "name").agg(F.max(F.struct("length", "sha256")).alias("f"))
    whole = by.select("model_id", "name", F.col("f.length").alias("whole_length"), F.col("f.sha256").alias("whole_sha256"))
    part = by.select("model_id", F.col("name").alias("__part"), F.col("f.length").alias("part_length"))
    named = artifacts.withColumn("__part", partial_path(F.col("name")))
    return named.join(whole, ["model_id", "name"], "left").join(part, ["model_id", "__part"], "left").join(ready.select("model_id", "ready"), "model_id", "left").drop("__part")


def download_progress(artifacts: DataFrame, files: DataFrame, ready: DataFrame) -> DataFrame:
    """(model_id, done_bytes, total_bytes). artifacts: model_id, kind, name, size; files: model_id, name, length, sha256; ready: as ready_models gives it.

    An artifact is done if its file has its size, or if it is the archive of a model that is ready; else its partial file counts, up to its size."""
    whole = (F.col("whole_length") == F.col("size")) | ((F.col("kind") == "archive") & F.col("ready"))
    done = F.when(F.coalesce(whole, F.lit(False)), F.col("size")).otherwise(F.least(F.coalesce("part_length", F.lit(0)), F.col("size")))
    return _there(artifacts, files, ready).groupBy("model_id").agg(F.sum(done).alias("done_bytes"), F.sum("size").alias("total_bytes"))


def valid_markers(markers: DataFrame, artifacts: DataFrame, files: DataFrame, ready: DataFrame) -> DataFrame:
    """(model_id, valid) for each model that has artifacts: whether it is ready and its marker, of the same revision, lists exactly as many artifacts, among them each of its
    own with its digest and size.

    markers: model_id, revision, artifacts array<struct<name, sha256, size>>; artifacts: model_id, revision, kind, name, sha256, size; files, ready: as in
    download_progress. Relational division over artifacts. By kind: a file must have its size, the voice detector (kind voice_detector) its digest too; an archive
    is gone once unpacked."""
    listed = markers.select("model_id", "revision", F.explode("artifacts").alias("a")).select("model_id", "revision", "a.name", "a.sha256", "a.size").distinct()
    counts = markers.groupBy("model_id", "revision").agg(F.max(F.size("artifacts")).alias("listed"))
    met = _there(artifacts, files, ready).join(listed.withColumn("met", F.lit(True)), ["model_id", "revision", "name", "sha256", "size"], "left").join(counts, ["model_id", "revision"], "left")
    sized = F.col("whole_length") == F.col("size")
    kept = F.when(F.col("kind") == "archive", True).when(F.col("kind") == "voice_detector", sized & (F.lower("whole_sha256") == F.lower("sha256"))).otherwise(sized)
    holds = F.coalesce(F.col("met") & kept & F.col("ready"), F.lit(False))
    return met.groupBy("model_id").agg((F.every(holds) & (F.count(F.lit(1)) == F.coalesce(F.max("listed"), F.lit(-1)))).alias("valid"))


def ready_models(files: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(model_id, ready) for each required model: whether all its files are there and not empty. files: model_id, name, length.

    One that asks for no file is ready; one of which nothing is there isn't."""
    wanted = files.sparkSession.createDataFrame(list(required.items()), "model_id string, names array<string>")
    have = files.filter("length > 0").join(F.broadcast(wanted), "model_id").groupBy("model_id").agg(F.collect_set(F.when(F.array_contains("names", F.col("name")), F.col("name"))).alias("have"))
    joined = wanted.join(have, "model_id", "left")
    return joined.select("model_id", (F.size(F.array_except("names", F.coalesce("have", F.array().cast("array<string>")))) == 0).alias("ready"))
