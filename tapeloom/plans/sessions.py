"""More registered queries: the operators of documents, queues, recovery, codecs and the stream over stand-in columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import codecs, signal, text
from tapeloom.operators import history, merge, queue, resample, sequence
from tapeloom.plans.queries import OPEN, TRACKS, TURNS, _turns, tracks
from tapeloom.plans.registry import query, table
from tapeloom.sources import documents, settings
from tapeloom.sources.shared import shared_path, stored
from tapeloom.streaming import capture


def _pick(n: Column, *values: object) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


# Samples and codecs

FORMATS = ["i8", "i16", "i24", "i32", "i48", "i64", "u8", "u16", "u24", "u32", "u48", "u64", "f32", "f64"]


@query("""
WITH f AS (SELECT * FROM (VALUES (0, 7, FALSE), (1, 15, FALSE), (2, 23, FALSE), (3, 31, FALSE), (4, 47, FALSE), (5, 63, FALSE), (6, 7, TRUE), (7, 15, TRUE), (8, 23, TRUE), (9, 31, TRUE), (10, 47, TRUE), (11, 63, TRUE), (12, 0, FALSE), (13, 0, FALSE)) v(k, bits, raised)),
s AS (SELECT event_id, unnest([event_id % 100, event_id % 7]) AS x, unnest([0, 1]) AS place FROM events)
SELECT event_id, place, (x::DOUBLE - CASE WHEN raised THEN pow(2, bits) ELSE 0 END) / pow(2, bits) AS value FROM s JOIN f ON k = event_id % 14
""")
def sample_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.array(F.expr("event_id % 100").cast("double"), F.expr("event_id % 7").cast("double"))
    read = signal.to_float_samples(samples, _pick(F.col("event_id"), *FORMATS))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(read).alias("place", "value"))


@query("""
WITH i AS (SELECT vec_id, list_transform(range(0, 40), lambda i: CASE WHEN i % 2 = 0 THEN embedding[i // 2 + 1] ELSE embedding[21 + i // 2] END) AS s FROM embeddings)
SELECT vec_id, len(s)::INT AS size, round(list_sum(list_transform(range(1, 41), lambda i: i * s[i]::DOUBLE)), 6) AS weighed FROM i
""")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = F.array(F.slice("embedding", 1, 20), F.slice("embedding", 21, 24))
    i = table(spark, sf_dir, "embeddings").select("vec_id", signal.interleave(planes).alias("s"))
    weighed = F.aggregate(F.transform("s", lambda x, n: (n + 1) * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return i.select("vec_id", F.size("s").alias("size"), F.round(weighed, 6).alias("weighed"))


@query("""
WITH b AS (SELECT page_id, length(url) // 4 AS n, unnest(range(length(url) // 4)) AS i, url FROM pages),
c AS (SELECT page_id, n, i, ascii(url[4 * i + 1]) AS b0, ascii(url[4 * i + 2]) AS b1, ascii(url[4 * i + 3]) AS b2, ascii(url[4 * i + 4]) AS b3 FROM b)
SELECT page_id, n::INT AS n, i::INT AS place, (1 + ((b2 & 127) * 65536 + b1 * 256 + b0) / 8388608.0::DOUBLE) * pow(2, (b3 & 127) * 2 + b2 // 128 - 127) AS value FROM c
""")
def decoded_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of an address stand for raw 32-bit samples."""
    read = table(spark, sf_dir, "pages").select("page_id", codecs.decode_f32(F.col("url").cast("binary")).alias("s"))
    return read.select("page_id", F.size("s").alias("n"), F.posexplode("s").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


_LITTLE = "list_transform({0}, lambda x: printf('%02x%02x', x & 255, (x >> 8) & 255))"
_QUANTISED = "q AS (SELECT vec_id, list_transform(embedding, lambda x: round(least(1, greatest(-1, x::DOUBLE)) * 32767)::BIGINT & 65535) AS q FROM embeddings)"


WAV_SQL = f"""
{_QUANTISED},
h AS (SELECT vec_id, len(q) AS n, array_to_string({_LITTLE.format("q")}, '') AS body FROM q),
f AS (SELECT vec_id, n, '52494646' || printf('%02x%02x0000', (36 + 2 * n) & 255, (36 + 2 * n) >> 8) || '57415645666d742010000000' || '01000100803e0000007d000002001000' || '64617461' || printf('%02x%02x0000', (2 * n) & 255, (2 * n) >> 8) || body AS h FROM h)
"""


@query(f"""
WITH {WAV_SQL}
SELECT vec_id, sha256(unhex(h)) AS wav_sha256, (44 + 2 * n)::INT AS size, (length(h) // 2)::INT AS repaired_size, 16000 AS rate, n::INT AS samples FROM f
""")
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written in rows; each is read again after its header, which states no samples, was repaired."""
    blocks = codecs.pcm_blocks(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    files = codecs.whole_files(codecs.wav_rows(blocks, "vec_id"), "vec_id")
    broken = F.concat(F.substring("content", 1, 40), F.unhex(F.lit("00000000")), F.substring("content", 45, 1 << 30))
    fixed = files.withColumn("fixed", codecs.repair_wav(broken)).withColumn("read", codecs.read_wav(F.col("fixed")))
    return fixed.select("vec_id", F.sha2("fixed", 256).alias("wav_sha256"), F.octet_length("content").alias("size"), F.octet_length("fixed").alias("repaired_size"), "read.rate", F.size("read.samples").alias("samples"))


def _crc(bits: int, polynomial: int, octets: str) -> str:
    """SQL: a CRC of a list of bytes, bit by bit."""
    all_bits = f"flatten(list_transform({octets}, lambda b: list_transform(range(0, 8), lambda k: (b >> (7 - k)) & 1)))"
    return f"list_reduce({all_bits}, lambda c, b: xor((c * 2) & {(1 << bits) - 1}, CASE WHEN ((c >> {bits - 1}) & 1) <> b THEN {polynomial} ELSE 0 END), 0::BIGINT)"


FLAC_SQL = f"""
{_QUANTISED},
h AS (SELECT vec_id, len(q) AS n, [255, 249, 112, 8, 0, 0, len(q) - 1] AS head, flatten(list_transform(q, lambda x: [x >> 8, x & 255])) AS body FROM q),
c AS (SELECT vec_id, n, list_concat(list_concat(head, [{_crc(8, 7, "head")}, 2]), body) AS frame FROM h),
d AS (SELECT vec_id, n, frame, {_crc(16, 0x8005, "frame")} AS crc FROM c),
e AS (SELECT vec_id, n, len(frame) + 2 AS size, array_to_string(list_transform(list_concat(frame, [crc >> 8, crc & 255]), lambda b: printf('%02x', b)), '') AS frame FROM d)
"""
_FLAC_DIGEST = """sha256(unhex('664c614380000022' || printf('%04x1000', n) || printf('%06x%06x', size, size) || '03e800f0' || printf('%08x', n) || repeat('00', 16) || frame))"""


@query(f"WITH {FLAC_SQL} SELECT vec_id, {_FLAC_DIGEST} AS flac_sha256, (42 + size)::INT AS size FROM e")
def flac_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = codecs.pcm_blocks(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    files = codecs.whole_files(codecs.flac_rows(blocks, "vec_id"), "vec_id")
    return files.select("vec_id", F.sha2("content", 256).alias("flac_sha256"), F.octet_length("content").alias("size"))


@query("SELECT user_id AS session, event_type AS source, CASE WHEN event_type = 'click' THEN count(*) * 1 ELSE (count(*) * 40 * 16000 + 47999) // 48000 END::BIGINT AS samples FROM events GROUP BY 1, 2")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks at the target's rate (one sample an event) pass; others (40 samples an event) take a third, rounded up over the whole source."""
    e = table(spark, sf_dir, "events")
    same = F.col("event_type") == "click"
    value = F.col("value").cast("float") / 1000
    blocks = e.select(F.col("user_id").alias("session"), F.col("event_type").alias("source"), F.col("event_id").alias("sequence"), F.when(same, 16000).otherwise(48000).alias("sample_rate"), F.array_repeat(value, F.when(same, 1).otherwise(40)).alias("samples"))
    return resample.resample_sources(blocks).groupBy("session", "source").agg(F.sum(F.size("samples")).alias("samples"))


# Waiting audio and modes

_SIZES = "z AS (SELECT session, source, count(*) AS n FROM t GROUP BY 1, 2)"


@query(f"WITH {TRACKS.split('s AS')[0].rstrip().rstrip(',')}, {_SIZES} SELECT session, source, (n - min(n) OVER (PARTITION BY session))::BIGINT AS pending FROM z")
def waiting_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.check_pending(tracks(spark, sf_dir))


@query(f"WITH {TRACKS} SELECT session, pos, round(least(1, greatest(-1, value * 4)), 9) AS value FROM s WHERE source = 'system'")
def single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source alone, at the largest gain."""
    one = sequence.align_mix(tracks(spark, sf_dir), {"system": 99.0}, mode="system", chunk=7)
    return one.select("session", "pos", F.posexplode("samples").alias("at", "value")).select("session", (F.col("pos") + F.col("at")).alias("pos"), F.round("value", 9).alias("value"))


@query("SELECT event_id, user_id % 3 <> 1 AS microphone, user_id % 3 <> 0 AS \"system\" FROM events")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = _pick(F.col("user_id"), "microphone", "system", "mixed")
    return table(spark, sf_dir, "events").select("event_id", *[history.source_is_enabled(mode, F.lit(s)).alias(s) for s in ("microphone", "system")])


# Documents

_ORDER_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'recording' ELSE 'interrupted' END"


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents as text: some cut short, some without a required field, all with a field that the schema lacks."""
    whole = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("sessionId"), F.col("o_orderdate").cast("timestamp").alias("startedAt"), F.when(F.col("o_orderkey") % 11 != 0, F.expr(_ORDER_STATUS)).alias("status"), F.array(F.struct(F.lit(0).alias("index"), (F.col("o_orderkey") * 3).alias("durationMs"))).alias("segments"), F.lit("x").alias("unknown")))
    cut = F.when(F.col("o_orderkey") % 7 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("/root/"), F.col("o_orderkey")).alias("directory"), cut.alias("content"))


@query(f"""
SELECT '/root/' || o_orderkey AS directory, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS corrupt, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN {_ORDER_STATUS} END AS status,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_orderkey * 3 END AS duration_ms FROM orders
""")
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = documents.parse_documents(_contents(spark, sf_dir), "session")
    good = lambda c: F.when(~F.col("corrupt"), c)
    return read.select("directory", "corrupt", good(F.col("status")).alias("status"), good(F.get("segments", F.lit(0))["durationMs"]).alias("duration_ms"))


@query(f"SELECT o_orderkey::VARCHAR AS \"sessionId\", {_ORDER_STATUS} AS status, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND month(o_orderdate) = 3")
def saved_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable documents, saved by month; a read of one month reads only its folders."""
    read = documents.parse_documents(_contents(spark, sf_dir), "session")
    path = shared_path(spark, "manifests")
    documents.save_documents(read.filter("NOT corrupt").drop("corrupt"), path, ("year", "month"))
    return spark.read.parquet(path).filter("month = 3").select("sessionId", "status", "year", "month", "day")


@query(f"""
WITH {TURNS}, c AS (SELECT session, 'session' AS kind FROM t GROUP BY 1),
p AS (SELECT session, count(*) AS n, coalesce(string_agg(trim(text), ' ' ORDER BY id) FILTER (WHERE status = 'complete' AND trim(text) <> ''), '') AS w FROM t GROUP BY 1),
d AS (SELECT session, sum(id + 1000)::BIGINT AS ms FROM t GROUP BY 1)
SELECT session, ms AS duration_ms, n::INT AS segment_count, CASE WHEN session % 3 = 0 THEN '' WHEN length(w) > 160 THEN w[1:160] || '…' ELSE w END AS preview, CASE WHEN session % 3 = 0 THEN 0 ELSE n::INT END AS transcript_segments,
  CASE WHEN session % 3 = 0 THEN NULL ELSE 'partial' END AS transcript_status, CASE WHEN session % 5 = 0 THEN 'German' END AS target
FROM p JOIN d USING (session) WHERE session % 13 <> 1 AND NOT (session % 3 <> 0 AND session % 7 = 2) AND NOT (session % 5 = 0 AND session % 17 = 3)
""")
def history_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history's own join: sessions with transcripts (two in three) and translations (one in five), some of each corrupt."""
    rows = _turns(spark, sf_dir)
    segments = F.array_sort(F.collect_list(F.struct("id", "status", "text", (F.col("id") + 1000).alias("durationMs"))))
    s = rows.groupBy("session").agg(segments.alias("segments")).withColumn("directory", F.col("session").cast("string"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    sessions = s.select("directory", (F.expr("session % 13") == 1).alias("corrupt"), F.col("session").alias("sessionId"), "segments", *none("audioFormat", "audioSource", "completedAt", "startedAt", "status"))
    transcripts = s.filter("session % 3 <> 0").select("directory", (F.expr("session % 7") == 2).alias("corrupt"), F.lit("partial").alias("status"), "segments")
    translations = s.filter("session % 5 = 0").select("directory", (F.expr("session % 17") == 3).alias("corrupt"), F.lit("complete").alias("status"), "segments", F.lit("German").alias("targetLanguage"))
    return history.history_entries(sessions, transcripts, translations).select(
        F.col("sessionId").alias("session"), F.col("durationMs").alias("duration_ms"), F.col("segmentCount").alias("segment_count"), F.col("transcriptPreview").alias("preview"),
        F.col("transcriptSegmentCount").alias("transcript_segments"), F.col("transcriptStatus").alias("transcript_status"), F.col("translationTargetLanguage").alias("target"))


@query(f"SELECT o_orderkey AS \"sessionId\", {_ORDER_STATUS} AS status FROM orders WHERE o_orderkey <> (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus <> 'O')")
def kept_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when a session that no longer records is deleted."""
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sessionId"), F.expr(_ORDER_STATUS).alias("status"), F.concat(F.lit("/root/"), F.col("o_orderkey")).alias("directory"))
    gone = m.filter("status <> 'recording'").agg(F.max("sessionId")).first()[0]
    return documents.without_session(m, gone, "/root").drop("directory")


@query("SELECT o_orderkey AS session, NULLIF(CASE o_orderkey % 8 WHEN 1 THEN 'segmentMinutes must be 1 to 1440' WHEN 2 THEN 'microphoneGain must be 0 to 4' WHEN 3 THEN 'threads must be 1 to 16' WHEN 4 THEN 'the endpoint must be an http or https address' WHEN 5 THEN 'targetLanguage can''t be blank' WHEN 6 THEN 'the threshold must lie between 0 and 1' WHEN 7 THEN 'the longest segment can''t be shorter than the shortest' ELSE '' END, '') AS fault FROM orders")
def settings_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defaults, with one value spoilt in seven of eight rows."""
    flat = {**settings.DEFAULTS["audio"], **settings.DEFAULTS["transcription"], **settings.DEFAULTS["transcription"]["vad"], **settings.DEFAULTS["translation"]}
    spoilt = {"segmentMinutes": (1, 1441), "microphoneGain": (2, float("nan")), "threads": (3, 0), "endpoint": (4, "ftp://x"), "targetLanguage": (5, "  "), "activationThreshold": (6, 1.5), "maxSegmentMs": (7, 249)}
    names = ("segmentMinutes", "microphoneGain", "systemGain", "threads", "endpoint", "model", "targetLanguage", "activationThreshold", "minSpeechMs", "minSilenceMs", "maxSegmentMs")
    row = {n: F.when(F.col("o_orderkey") % 8 == spoilt[n][0], F.lit(spoilt[n][1])).otherwise(F.lit(flat[n])) if n in spoilt else F.lit(flat[n]) for n in names}
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), settings.settings_fault(row).alias("fault"))


# Names, paths and texts

PATHS = ["model/a.onnx", "/etc/a", "../a", "m/../a", "m\\..\\a", "C:a", "", "a..b/c"]


@query("""
SELECT page_id, page_id % 5 <> 0 AND page_id % 8 IN (0, 7) AS unpacks, page_id % 7 IN (0, 1) AS one_name, CASE page_id % 8 WHEN 0 THEN 'model/a.onnx' WHEN 7 THEN 'a..b/c' ELSE 'x' END || '.partial' AS partial, page_id % 3 <> 0 AS same_digest FROM pages
""")
def guarded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, name = _pick(F.col("page_id"), *PATHS), _pick(F.col("page_id"), "a.wav", "..a", "", ".", "..", "a/b", "a\\b")
    digest = F.when(F.col("page_id") % 3 == 0, F.lit("00")).otherwise(F.upper(F.sha2("html", 256)))
    kept = F.when((F.col("page_id") % 8).isin(0, 7), path).otherwise("x")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_archive_path(path, F.col("page_id") % 5 == 0).alias("unpacks"), text.safe_file_name(name).alias("one_name"), text.partial_path(kept).alias("partial"), text.sha256_matches(F.col("html"), digest).alias("same_digest"))


@query(f"""
WITH {TURNS} SELECT session, id, CASE status WHEN 'complete' THEN CASE WHEN trim(text) = '' OR id % 4 = 3 THEN '…' ELSE trim(text) END WHEN 'failed' THEN 'Transcription failed' ELSE 'Transcribing…' END AS shown,
  CASE status WHEN 'complete' THEN CASE WHEN trim(text) = '' OR id % 4 = 3 THEN '…' ELSE trim(text) END WHEN 'failed' THEN 'Translation failed' ELSE 'Translating…' END AS translation FROM t
""")
def shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("text", F.when(F.expr("id % 4") == 3, F.when(F.expr("id % 8") == 3, "\t ")).otherwise(F.concat(F.lit("　"), "text")))
    return t.select("session", "id", text.display_text(F.col("status"), F.col("text")).alias("shown"), text.display_text(F.col("status"), F.col("text"), "Translating", "Translation failed").alias("translation"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S.%gZ') || '-u' || user_id AS session_id, strftime(ts + INTERVAL 9 HOUR, '%Y/%m/%d') || '/s' || event_id AS path FROM events")
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by UTC, folders by the local date (nine hours on)."""
    local = F.col("ts") + F.expr("INTERVAL 9 HOURS")
    return table(spark, sf_dir, "events").select("event_id", text.session_id(F.col("ts"), F.concat(F.lit("u"), F.col("user_id"))).alias("session_id"), text.session_path(local, F.concat(F.lit("s"), F.col("event_id"))).alias("path"))


# Models

_SPEC = """
a AS (SELECT s_nationkey::VARCHAR AS model_id, 'r' || s_nationkey % 3 AS revision, CASE s_suppkey % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'file' ELSE 'voice_detector' END AS kind, s_name AS name, md5(s_name) AS sha256, s_suppkey AS size, s_suppkey AS k FROM supplier),
f AS (SELECT model_id, name, CASE WHEN k % 41 = 40 THEN size + 1 ELSE size END AS length, CASE WHEN k % 37 = 36 THEN 'other' ELSE sha256 END AS sha256, kind FROM a WHERE k % 43 <> 42),
r AS (SELECT model_id, model_id::INT % 6 <> 5 AS ready FROM a GROUP BY 1)
"""


def _spec(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations stand for models, suppliers for their artifacts (of three kinds) and files: some are missing, some have another size or digest; some models aren't ready."""
    k = F.col("s_suppkey")
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("model_id"), F.concat(F.lit("r"), F.col("s_nationkey") % 3).alias("revision"), _pick(k, "archive", "file", "voice_detector").alias("kind"), F.col("s_name").alias("name"), F.md5("s_name").alias("sha256"), k.alias("size"))
    size = F.col("size")
    files = a.filter(size % 43 != 42).select("model_id", "name", F.when(size % 41 == 40, size + 1).otherwise(size).alias("length"), F.when(size % 37 == 36, "other").otherwise(F.col("sha256")).alias("sha256"))
    # A model is ready if its folder holds its one required file.
    folder = a.select("model_id", F.lit("model").alias("name"), F.when(F.col("model_id").cast("int") % 6 == 5, 0).otherwise(1).alias("length"))
    return a, files, documents.ready_models(folder, {str(m): ["model"] for m in range(25)})


@query(f"""
WITH {_SPEC},
m AS (SELECT model_id, revision, CASE WHEN k % 47 = 46 THEN 'x' ELSE sha256 END AS sha256, name, size FROM a WHERE model_id::INT % 7 <> 6),
n AS (SELECT model_id, count(*) + CASE WHEN model_id::INT % 5 = 4 THEN 1 ELSE 0 END AS listed FROM m GROUP BY 1),
c AS (SELECT a.model_id, coalesce(m.sha256 = a.sha256, FALSE) AND a.model_id::INT % 8 <> 7 AND r.ready AND CASE a.kind WHEN 'archive' THEN TRUE WHEN 'file' THEN coalesce(f.length = a.size, FALSE) ELSE coalesce(f.length = a.size AND f.sha256 = a.sha256, FALSE) END AS holds
      FROM a JOIN r USING (model_id) LEFT JOIN m ON m.model_id = a.model_id AND m.name = a.name LEFT JOIN f ON f.model_id = a.model_id AND f.name = a.name)
SELECT c.model_id, bool_and(holds) AND count(*) = coalesce(max(listed), -1) AS valid FROM c LEFT JOIN n USING (model_id) GROUP BY 1
""")
def marker_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of most models: some list one artifact more, some another revision, some a wrong digest."""
    a, files, ready = _spec(spark, sf_dir)
    nation, size = F.col("model_id").cast("int"), F.col("size")
    told = F.struct("name", F.when(size % 47 == 46, "x").otherwise(F.col("sha256")).alias("sha256"), "size")
    more = F.when(F.first(nation) % 5 == 4, F.array(F.struct(F.lit("more").alias("name"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("size")))).otherwise(F.expr("CAST(array() AS array<struct<name: string, sha256: string, size: bigint>>)"))
    revision = F.when(nation % 8 == 7, "old").otherwise(F.col("revision"))
    markers = a.filter(nation % 7 != 6).withColumn("size", size.cast("long")).groupBy("model_id", revision.alias("revision")).agg(F.concat(F.collect_list(told), more).alias("artifacts"))
    return documents.valid_markers(markers, a, files, ready)


@query(f"""
WITH {_SPEC},
p AS (SELECT model_id, name, length FROM f UNION ALL SELECT model_id, name || '.partial', size * 2 - 100 FROM a WHERE k % 43 = 42 OR k % 41 = 40)
SELECT a.model_id, sum(CASE WHEN coalesce(w.length = size, FALSE) OR kind = 'archive' AND ready THEN size ELSE least(coalesce(q.length, 0), size) END)::BIGINT AS done_bytes, sum(size)::BIGINT AS total_bytes
FROM a JOIN r USING (model_id) LEFT JOIN p w ON w.model_id = a.model_id AND w.name = a.name LEFT JOIN p q ON q.model_id = a.model_id AND q.name = a.name || '.partial' GROUP BY 1
""")
def model_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, what is partly there, and the archives of models that are ready."""
    a, files, ready = _spec(spark, sf_dir)
    part = a.filter("size % 43 = 42 OR size % 41 = 40").select("model_id", text.partial_path(F.col("name")).alias("name"), (F.col("size") * 2 - 100).alias("length"), F.lit("").alias("sha256"))
    return documents.download_progress(a, files.unionByName(part), ready)


@query("""
WITH f AS (SELECT p_partkey % 50 AS m, 'f' || p_size % 5 AS name, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 50 = 49 THEN 0 ELSE p_size END AS length FROM part),
h AS (SELECT m, count(DISTINCT name) AS n FROM f WHERE length > 0 AND name IN ('f0', 'f1', 'f2') GROUP BY 1)
SELECT m::VARCHAR AS model_id, coalesce(n, 0) = 3 AS ready FROM range(45, 55) t(m) LEFT JOIN h USING (m)
""")
def models_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the models asked for, one has only empty files and five have none."""
    files = table(spark, sf_dir, "part").select(F.expr("CAST(p_partkey % 50 AS string)").alias("model_id"), F.concat(F.lit("f"), F.expr("p_size % 5")).alias("name"), F.expr("CASE WHEN p_partkey % 3 = 0 OR p_partkey % 50 = 49 THEN 0 ELSE p_size END").alias("length"))
    return documents.ready_models(files, {str(m): ["f0", "f1", "f2"] for m in range(45, 55)})


# Queues

@query(f"WITH {TURNS} SELECT session, (coalesce((SELECT max(id) FROM t e WHERE e.session = n.session AND e.id < 2), 0) + row_number() OVER (PARTITION BY session ORDER BY id))::BIGINT AS id, id * 20000 * 1000 // 16000 AS \"startMs\", (id * 20000 + 12345) * 1000 // 16000 AS \"endMs\", 'pending' AS status, 0::BIGINT AS attempts, '' AS text FROM t n WHERE id >= 2")
def enqueued_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    clips = turns.filter("id >= 2").select("session", (F.col("id") * 20000).alias("start_sample"), (F.col("id") * 20000 + 12345).alias("end_sample"))
    return queue.enqueue_clips(turns.filter("id < 2").select("session", "id"), clips)


@query(f"WITH {TURNS} SELECT session, id, CASE status WHEN 'processing' THEN 'pending' ELSE status END AS status, attempts FROM t")
def recovered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.recover_segments(_turns(spark, sf_dir)).select("session", "id", "status", "attempts")


@query(f"""
WITH {TURNS} SELECT session, CASE WHEN bool_or({OPEN}) THEN 'pending' WHEN bool_or(status = 'failed') THEN 'partial' ELSE 'complete' END AS status, bool_or({OPEN}) AS waiting, bool_or(status = 'processing') AS save FROM t GROUP BY 1
""")
def recovered_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return queue.recovered_documents(turns, turns.groupBy("session").agg(F.lit("complete").alias("status")), save_on_status=False)


SEGMENT_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"""
WITH s AS (SELECT l_orderkey AS k, l_quantity::BIGINT * 100 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SEGMENT_ORDER}) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
x AS (SELECT k, n = m AND o_orderstatus = 'O' AND k % 2 = 0 AND k % 5000 >= 20 AND k % 10 <> 4 AS fix, c, k % 5000 - 20 AS f, o_orderstatus, o_orderdate FROM s JOIN orders ON k = o_orderkey)
SELECT k AS "sessionId", CASE WHEN o_orderstatus = 'O' THEN 'interrupted' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2026-01-02 03:04:05' ELSE o_orderdate::TIMESTAMP END AS completed_at,
  count(*)::INT AS segments, sum(CASE WHEN fix THEN f ELSE c END)::BIGINT AS samples, sum(CASE WHEN fix THEN f ELSE c END * 1000 // 16000)::BIGINT AS ms FROM x GROUP BY ALL
""")
def recovered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for sessions, even ones in WAV; the last segment of those that recorded takes its counts from a file's length, unless the file is shorter than its
    header or its name leads elsewhere."""
    o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*SEGMENT_ORDER.split(", ")))).alias("all"))
    joined = o.join(rows, o["o_orderkey"] == rows["l_orderkey"])
    folder = F.when(F.col("o_orderkey") % 10 == 4, "../").otherwise("")
    segment = lambda x, i: F.struct(i.alias("index"), F.concat(folder, F.lit("audio-"), i).alias("fileName"), (x["l_quantity"].cast("long") * 100).alias("sampleCount"), F.expr("0").cast("long").alias("durationMs"), F.lit(False).alias("finalized"))
    told = F.transform(F.transform("all", segment), lambda s: s.withField("durationMs", signal.samples_to_ms(s["sampleCount"])))
    recording = F.col("o_orderstatus") == "O"
    m = joined.select(F.col("o_orderkey").alias("sessionId"), F.when(recording, "recording").otherwise("completed").alias("status"), F.when(~recording, F.col("o_orderdate").cast("timestamp_ntz")).alias("completedAt"), F.when(F.col("o_orderkey") % 2 == 0, "wav").otherwise("flac").alias("audioFormat"), F.lit(16000).cast("long").alias("sampleRate"), told.alias("segments"))
    files = m.select("sessionId", F.element_at("segments", -1)["fileName"].alias("fileName"), (4 + 2 * (F.col("sessionId") % 5000)).alias("length"))
    total = lambda f: F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s[f])
    found = queue.recover_manifests(m, files, F.expr("TIMESTAMP_NTZ '2026-01-02 03:04:05'"))
    return found.select("sessionId", "status", F.col("completedAt").alias("completed_at"), F.size("segments").alias("segments"), total("sampleCount").alias("samples"), total("durationMs").alias("ms"))


@query(f"WITH {TURNS} SELECT count(*) FILTER (WHERE {OPEN}) AS pending, count(DISTINCT session) AS sessions FROM t WHERE session <> (SELECT min(conv_id) FROM conversations)")
def dropped_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    rest, pending = queue.drop_session(turns, turns.agg(F.min("session")).first()[0])
    return pending.crossJoin(rest.agg(F.count_distinct("session").alias("sessions")))  # one row each


@query(f"""
WITH {TURNS}, c AS (SELECT session, max(id) AS last FROM t WHERE status = 'failed' AND session % 9 <> 4 GROUP BY 1)
SELECT session, id, coalesce('l' || last, 'auto') AS language, CASE WHEN last IS NULL THEN 'Chinese' ELSE 'T' || last END AS target FROM t LEFT JOIN c USING (session) WHERE {OPEN} AND session % 9 <> 8
""")
def language_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failed segment is also where the settings change; in the end one setting holds for all of a session that still waits. Some sessions have no change, some no document."""
    turns = _turns(spark, sf_dir).withColumn("sessionId", F.col("session"))
    target = lambda c: F.struct(c.alias("targetLanguage"))
    found = turns.filter("session % 9 <> 8").select("sessionId", F.lit("auto").alias("forcedLanguage"), target(F.lit("Chinese")).alias("translation"), F.lit(None).cast("long").alias("updatedAt")).distinct()
    controls = turns.filter("status = 'failed' AND session % 9 <> 4").select("sessionId", F.col("id").alias("at"), F.concat(F.lit("l"), F.col("id")).alias("language"), target(F.concat(F.lit("T"), F.col("id"))).alias("translation"))
    waiting = queue.with_document_settings(turns.drop("sessionId"), queue.update_languages(found, controls))
    return waiting.select("session", "id", "language", F.col("translation.targetLanguage").alias("target"))


@query("""
WITH n AS (SELECT min(o_orderkey)::VARCHAR AS k FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey::VARCHAR AS "sessionId", CASE WHEN o_orderkey::VARCHAR = k THEN 'failed' WHEN o_orderstatus = 'O' THEN 'recording' ELSE 'completed' END AS status, CASE WHEN o_orderkey::VARCHAR = k THEN 'disk full' END AS "lastError", CASE WHEN o_orderkey::VARCHAR = k THEN o_orderdate END AS "completedAt" FROM orders, n
""")
def finished_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session that records fails; one that doesn't is left alone."""
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").cast("string").alias("sessionId"), F.when(F.col("o_orderstatus") == "O", "recording").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("lastError"), F.lit(None).cast("timestamp_ntz").alias("completedAt"), "o_orderdate")
    first = lambda s: str(o.filter(s).agg(F.min("o_orderkey")).first()[0])
    failed = queue.finish_archive(m, first("o_orderstatus = 'O'"), F.col("o_orderdate"), "disk full")
    return queue.finish_archive(failed, first("o_orderstatus <> 'O'"), F.col("o_orderdate"), "no").drop("o_orderdate")


def _recognise(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands for recognition: texts of certain lengths fail."""
    fails = batch["text"].str.len() % 3 == 0
    return pd.DataFrame({"text": ("heard " + batch["text"]).where(~fails, None), "error": pd.Series("noise", batch.index).where(fails, None)})


@query(f"""
WITH {TURNS} SELECT session, id, CASE WHEN NOT {OPEN} THEN status WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN NOT {OPEN} THEN attempts WHEN length(text) % 3 = 0 THEN greatest(attempts + 1, 3) ELSE attempts + 1 END AS attempts FROM t
""")
def worked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes until nothing waits: what fails is tried until it has three attempts."""
    turns = _turns(spark, sf_dir).withColumn("source", F.col("text")).withColumn("error", F.lit(None).cast("string"))

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        return _recognise(batch.assign(text=batch["source"]))

    return queue.run_queue(turns, work, lambda df, n: stored(df, f"queue-{n}")).select("session", "id", "status", "attempts")


def _send(url: str, body: str) -> tuple[int, str]:
    """Stands for a server: it refuses some texts, answers some with blanks, and says others backwards."""
    asked = json.loads(body)["messages"][1]["content"]
    if len(asked) % 5 == 0:
        return 503, "busy " * 200
    return 200, json.dumps({"choices": [{"message": {"content": " " if len(asked) % 5 == 1 else f" {asked[::-1]}\n"}}]})


@query(f"""
WITH {TURNS}, w AS (SELECT session, id, text, status, attempts, {OPEN} AND row_number() OVER (PARTITION BY session, {OPEN} ORDER BY id) = 1 AS now, length(text) % 5 AS k FROM t)
SELECT session, id, CASE WHEN NOT now THEN status WHEN k < 2 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN now THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN NOT now OR k < 2 THEN '' ELSE trim(reverse(text)) END AS text,
  CASE WHEN now AND k = 0 THEN 'HTTP 503: ' || repeat('busy ', 100) WHEN now AND k = 1 THEN 'the answer is empty' END AS error FROM w
""")
def translated_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of the translation queue with a stub of the client."""
    turns = _turns(spark, sf_dir).select("session", "id", "position", F.col("text").alias("sourceText"), F.lit("").alias("text"), "status", "attempts", F.lit(None).cast("string").alias("error"))
    return queue.step(turns, queue.translator(_send, "http://127.0.0.1:8000/v1/chat/completions", "m", "Chinese")).select("session", "id", "status", "attempts", "text", "error")


@query(f"""
WITH {TURNS}, w AS (SELECT session, id, text, {OPEN} AND row_number() OVER (PARTITION BY session, {OPEN} ORDER BY id) = 1 AS now FROM t)
SELECT session, id, 'heard ' || text AS "sourceText", 'pending' AS status, 0::BIGINT AS attempts FROM w WHERE now AND length(text) % 3 <> 0
""")
def chained_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass of the transcript queue completes enters the translation queue."""
    turns = _turns(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    after = stored(queue.step(turns, _recognise), "transcripts")
    none = spark.createDataFrame([], "session long, id long, sourceText string, text string, status string, attempts long, error string")
    return queue.chain_translations(turns, after, none).select("session", "id", "sourceText", "status", "attempts")


# Merging and events

@query(f"WITH {TURNS} SELECT session, string_agg(id, ',' ORDER BY id) AS ids FROM t GROUP BY 1")
def ordered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = merge.as_ordered_lists(_turns(spark, sf_dir).select("session", "id", "status"))
    return lists.select("session", F.array_join(F.transform("segments", lambda s: s["id"].cast("string")), ",").alias("ids"))


@query("""
WITH c AS (SELECT user_id AS "sessionId", event_id % 5 AS "segmentId", event_id AS arrival, event_id % 3 AS attempts, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'complete' END AS status, event_type AS text FROM events WHERE user_id % 10 <> 3),
f AS (SELECT DISTINCT user_id AS "sessionId", unnest([1, 2, 7]) AS "segmentId", -1 AS arrival, 2 AS attempts, 'processing' AS status, 'stored' AS text FROM events WHERE user_id % 2 = 1),
b AS (SELECT * FROM c UNION ALL SELECT * FROM f)
SELECT "sessionId", "segmentId", attempts, status, text FROM b QUALIFY row_number() OVER (PARTITION BY "sessionId", "segmentId" ORDER BY attempts DESC, CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END DESC, arrival DESC) = 1
""")
def merged_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot (of every other session, some of its segments unknown to the changes) and live changes of most sessions."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "sessionId")
    c = events.filter("sessionId % 10 <> 3").select("sessionId", F.expr("event_id % 5").alias("segmentId"), F.col("event_id").alias("arrival"), F.expr("event_id % 3").alias("attempts"), _pick(F.col("event_id"), "pending", "processing", "failed", "complete").alias("status"), F.col("event_type").alias("text"))
    snapshot = events.filter("sessionId % 2 = 1").select("sessionId").distinct().select("sessionId", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 7)])).alias("segmentId"), F.lit(2).cast("long").alias("attempts"), F.lit("processing").alias("status"), F.lit("stored").alias("text"))
    return merge.merge_segments(snapshot, c, ["sessionId", "segmentId"])


@query(f"""
WITH {TURNS}, s AS (SELECT session, count(*) FILTER (WHERE {OPEN}) AS pending FROM t GROUP BY 1)
SELECT 'transcription-status' AS channel, session::VARCHAR AS key, '{{"session":' || session || ',"pending":' || pending || '}}' AS payload FROM s
UNION ALL SELECT 'transcript-segment', session::VARCHAR, '{{"session":' || session || ',"id":' || id || ',"status":"' || status || '"}}' FROM t
UNION ALL SELECT 'translation-segment', session::VARCHAR, '{{"session":' || session || ',"segmentId":' || id || '}}' FROM t WHERE status = 'complete'
UNION ALL SELECT 'model-download-status', model_id, '{{"model_id":"' || model_id || '","done_bytes":0,"total_bytes":' || total || '}}' FROM (VALUES ('qwen3-asr-0.6b-int8', 879346277), ('qwen3-asr-1.7b-int8', 2404866275), ('funasr-nano-int8', 842374465), ('whisper-large-v3-int8', 1069126342)) v(model_id, total)
UNION ALL SELECT 'recording-status', session::VARCHAR, '{{"session":' || session || ',"position":' || max(id) || ',"level_db":-80.0,"pending":' || max_by(attempts, id) || '}}' FROM t GROUP BY session
""")
def channel_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the five channels tell of a batch."""
    turns = _turns(spark, sf_dir)
    mixed = turns.select("session", F.lit("mixed").alias("kind"), F.col("id").alias("position"), F.lit(-80.0).alias("level_db"), F.col("attempts").alias("pending"))
    nothing = spark.createDataFrame([], "model_id string, name string, length long, sha256 string, ready boolean")
    parts = [
        capture.channel_events(turns.groupBy("session").agg(queue.queue_depth().alias("pending")), "transcription-status", "session"),
        capture.channel_events(turns.select("session", "id", "status"), "transcript-segment", "session"),
        capture.channel_events(turns.filter("status = 'complete'").select("session", F.col("id").alias("segmentId")), "translation-segment", "session"),
        capture.channel_events(documents.download_progress(documents.model_artifacts(spark), nothing, nothing), "model-download-status", "model_id"),
        capture.channel_events(capture.recording_status(mixed), "recording-status", "session"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


