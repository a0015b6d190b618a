"""Registered queries: the session operators over stand-in columns of the driver's tables, and the same in SQL.

The tables hold no recordings, so each query runs an operator on columns of like shape: orders stand for sessions, lineitem for
their audio segments, conversations for transcript segments, events for a change or capture stream, embeddings for blocks of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions import signal, text
from tapeloom.operators import history, merge, queue, sequence
from tapeloom.plans.registry import query, table


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


HISTORY_SQL = """
WITH seg AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * 1000 // 16) AS BIGINT) AS duration_ms, count(*) AS segment_count FROM lineitem GROUP BY 1),
h AS (SELECT o_orderkey AS session_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'recording' ELSE 'interrupted' END AS status,
             coalesce(duration_ms, 0) AS duration_ms, coalesce(segment_count, 0) AS segment_count FROM orders LEFT JOIN seg ON o_orderkey = l_orderkey)
"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_div(F.col("l_quantity").cast("long") * 1000, 16)).cast("long").alias("duration_ms"), F.count(F.lit(1)).alias("segment_count"))
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "recording").otherwise("interrupted")
    joined = orders.join(seg, orders["o_orderkey"] == seg["l_orderkey"], "left")
    return joined.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
    )


@query(HISTORY_SQL + "SELECT * FROM h ORDER BY started_at DESC, session_id LIMIT 100")
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest(_history(spark, sf_dir), 100, "started_at", "session_id")


@query(HISTORY_SQL + "SELECT * FROM (SELECT * FROM h ORDER BY started_at DESC, session_id LIMIT 500) WHERE session_id = (SELECT min(o_orderkey) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders))")
def history_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").agg(F.max(F.struct("o_orderdate", -F.col("o_orderkey"))).alias("r")).select((-F.col("r")["col2"]).alias("session_id"))
    return history.newest(_history(spark, sf_dir), history.LIMIT, "started_at", "session_id").join(last, "session_id", "left_semi")


@query("""
WITH r AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS r FROM embeddings)
SELECT vec_id, round(r, 9) AS rms, round(CASE WHEN r > 0 THEN greatest(-80, 20 * log10(r)) ELSE -80 END, 6) AS db,
       round((least(0, greatest(-80, CASE WHEN r > 0 THEN greatest(-80, 20 * log10(r)) ELSE -80 END)) + 80) / 80 * 100, 6) AS percent FROM r
""")
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = signal.rms(F.col("embedding"))
    db = signal.rms_db(level)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(level, 9).alias("rms"), F.round(db, 6).alias("db"), F.round(signal.level_percent(db), 6).alias("percent"))


@query("""
WITH i AS (SELECT vec_id, embedding AS e, len(embedding) AS n, unnest(range(0, 48)) AS bin FROM embeddings),
s AS (SELECT *, least(bin * n // 48, n - 1) AS lo, (bin + 1) * n // 48 AS hi FROM i)
SELECT vec_id, bin::INT AS bin, list_max(list_transform(e[lo + 1 : greatest(hi, lo + 1)], lambda x: abs(x::DOUBLE))) AS peak FROM s
""")
def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = signal.waveform_bins(F.col("embedding"), 48)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(bins).alias("bin", "peak"))


@query("""
WITH m AS (SELECT vec_id, len(embedding) // 2 AS frames, list_transform(range(0, len(embedding) // 2), lambda i: (least(1, greatest(-1, embedding[2 * i + 1]::DOUBLE)) + least(1, greatest(-1, embedding[2 * i + 2]::DOUBLE))) / 2) AS mono FROM embeddings)
SELECT vec_id, frames::BIGINT AS frames, round(list_sum(mono), 6) AS total, round(list_max(mono), 9) AS peak, (frames * 1000 // 16000)::BIGINT AS duration_ms FROM m
""")
def stereo_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono = signal.to_mono(F.col("embedding"), F.lit(2))
    frames = signal.frame_count(F.col("embedding"), F.lit(2))
    return table(spark, sf_dir, "embeddings").select("vec_id", frames.alias("frames"), F.round(F.aggregate(mono, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max(mono), 9).alias("peak"), signal.samples_to_ms(frames).alias("duration_ms"))


@query("""
SELECT a.vec_id AS vec_id, round(list_sum(list_transform(range(1, greatest(len(a.embedding), len(b.embedding)) + 1),
  lambda i: least(1, greatest(-1, 1.5 * coalesce(a.embedding[i]::DOUBLE, 0) + 4.0 * coalesce(b.embedding[i]::DOUBLE, 0))))), 6) AS total
FROM embeddings a JOIN (SELECT vec_id, embedding[1:48] AS embedding FROM embeddings) b ON b.vec_id = a.vec_id + 1
""")
def mix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of a pair is cut to 48 samples, so that the lengths differ."""
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("embedding", 1, 48).alias("b"))
    mixed = signal.mix_mono(F.col("embedding"), F.col("b"), F.lit(1.5), F.lit(9.0))
    return e.join(other, "vec_id").select("vec_id", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: round(least(1, greatest(-1, x::DOUBLE)) * 32767)::BIGINT) AS q FROM embeddings)
SELECT vec_id, list_sum(q)::BIGINT AS total, list_min(q) AS lowest, list_max(q) AS highest, (44 + 2 * len(q))::BIGINT AS wav_bytes FROM q
""")
def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: signal.quantise(x).cast("long")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("q").alias("lowest"), F.array_max("q").alias("highest"), (44 + 2 * F.size("q")).cast("long").alias("wav_bytes"))


# A turn's state, made from its keys so that all states and attempts occur.
STATE = "CASE (conv_id * 7 + turn * 3) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'complete' END"
ATTEMPTS = "((conv_id + turn) % 5)"
TURNS = f"t AS (SELECT conv_id AS session, turn AS id, turn AS position, text, {STATE} AS status, {ATTEMPTS} AS attempts, conv_id % 3 AS kind FROM conversations)"
OPEN = "(status IN ('pending', 'processing') OR (status = 'failed' AND attempts < 3))"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), F.col("turn").alias("position"), "text", F.expr(STATE).alias("status"), F.expr(ATTEMPTS).alias("attempts"), F.expr("conv_id % 3").alias("kind"))


@query(f"""
WITH {TURNS}, p AS (SELECT session, coalesce(string_agg(trim(text), ' ' ORDER BY id) FILTER (WHERE status = 'complete' AND trim(text) <> ''), '') AS w FROM t GROUP BY 1)
SELECT session, CASE WHEN length(w) > 160 THEN w[1:160] || '…' ELSE w END AS preview FROM p
""")
def transcript_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _turns(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("id", "status", "text"))).alias("segments"))
    return segments.select("session", text.preview(F.col("segments")).alias("preview"))


@query(f"""
WITH {TURNS} SELECT session, count(*) FILTER (WHERE {OPEN}) AS waiting,
  CASE WHEN bool_or({OPEN}) THEN 'pending' WHEN bool_or(status = 'failed') THEN 'partial' ELSE 'complete' END AS status FROM t GROUP BY 1
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("session").agg(queue.queue_depth().alias("waiting"), queue.rollup_status().alias("status"))


@query(f"WITH {TURNS} SELECT session, id, position, text, 'processing' AS status, attempts + 1 AS attempts, kind FROM t WHERE {OPEN} QUALIFY row_number() OVER (PARTITION BY session ORDER BY position) = 1")
def next_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim(queue.next_items(_turns(spark, sf_dir)))


@query(f"""
WITH {TURNS}, e AS (SELECT * FROM t WHERE id < 3)
SELECT n.session, (coalesce((SELECT max(id) FROM e WHERE e.session = n.session), 0) + row_number() OVER (PARTITION BY n.session ORDER BY n.position))::BIGINT AS id, n.position, n.text FROM t n WHERE n.id >= 3
""")
def append_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return queue.next_ids(turns.filter("id < 3"), turns.filter("id >= 3").select("session", "position", "text"), "position").select("session", F.col("id").cast("long").alias("id"), "position", "text")


CHANGES = "c AS (SELECT user_id AS session, event_id % 3 AS id, event_id AS arrival, event_id % 4 AS attempts, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'complete' END AS status, event_type AS text FROM events)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'complete' END")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.expr("event_id % 3").alias("id"), F.col("event_id").alias("arrival"), F.expr("event_id % 4").alias("attempts"), status.alias("status"), F.col("event_type").alias("text"))


@query(f"""
WITH {CHANGES}, u AS (SELECT session, id, -1 AS arrival, attempts, status, text FROM c WHERE arrival % 7 = 0 QUALIFY row_number() OVER (PARTITION BY session, id ORDER BY arrival) = 1
  UNION ALL SELECT session, id, arrival, attempts, status, text FROM c WHERE arrival % 7 <> 0)
SELECT session, id, attempts, status, text FROM u QUALIFY row_number() OVER (PARTITION BY session, id
  ORDER BY attempts DESC, CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END DESC, arrival DESC) = 1
""")
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    fetched = changes.filter("arrival % 7 = 0").groupBy("session", "id").agg(F.min_by(F.struct("attempts", "status", "text"), "arrival").alias("r")).select("session", "id", "r.*")
    received = changes.filter("arrival % 7 <> 0").select("session", "id", "attempts", "status", "text", "arrival")
    return merge.merge_segments(fetched, received, ["session", "id"])


@query(f"""
WITH {TURNS} SELECT a.session AS "sessionId", a.id, a.text, b.text AS translation, b.status AS "translationStatus"
FROM t a LEFT JOIN (SELECT * FROM t WHERE kind > 0 AND status <> 'pending') b ON a.session = b.session AND a.id = b.id
""")
def translated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumnRenamed("session", "sessionId")
    told = turns.filter("kind > 0 AND status <> 'pending'").select("sessionId", F.col("id").alias("segmentId"), "text", "status", "position")
    return merge.with_translations(turns.select("sessionId", "id", "text"), told)


@query(f"""
WITH {TURNS}, x AS (SELECT session, id, CASE WHEN kind = 1 THEN 'old ' || text ELSE text END AS src, 'tr ' || text AS tr, status, attempts FROM t WHERE kind > 0),
n AS (SELECT session, id, trim(text) AS new FROM t WHERE status = 'complete' AND trim(text) <> ''),
j AS (SELECT coalesce(x.session, n.session) AS session, coalesce(x.id, n.id) AS id, new, src, tr, status, attempts, new IS NOT NULL AND new IS DISTINCT FROM src AS reset FROM x FULL JOIN n ON x.session = n.session AND x.id = n.id)
SELECT session, id, coalesce(new, src) AS "sourceText", CASE WHEN reset THEN '' ELSE tr END AS text, CASE WHEN reset THEN 'pending' ELSE status END AS status, CASE WHEN reset THEN 0 ELSE attempts END AS attempts FROM j
""")
def translation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    source = F.when(F.col("kind") == 1, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    existing = turns.filter("kind > 0").select("session", "id", source.alias("sourceText"), F.concat(F.lit("tr "), "text").alias("text"), "status", "attempts", F.lit(None).cast("string").alias("error"))
    return queue.enqueue_translations(existing, turns.filter("status = 'complete'").select("session", "id", "text")).drop("error")


@query(f"""
WITH {TURNS}, s AS (SELECT session, CASE WHEN session % 2 = 0 THEN 'pending' ELSE 'complete' END AS stored FROM t GROUP BY 1),
r AS (SELECT session, bool_or({OPEN}) AS waiting, bool_or(status = 'failed') AS failed, bool_or(status = 'processing') AS was FROM t GROUP BY 1),
d AS (SELECT *, CASE WHEN waiting THEN 'pending' WHEN failed THEN 'partial' ELSE 'complete' END AS status FROM r JOIN s USING (session))
SELECT session, status, waiting, was OR status <> stored AS save FROM d
""")
def recovered_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    stored = turns.groupBy("session").agg(F.expr("CASE WHEN session % 2 = 0 THEN 'pending' ELSE 'complete' END").alias("status"))
    return queue.recovered_documents(turns, stored, save_on_status=True)


@query("""
WITH n AS (SELECT user_id AS session, event_type AS source, (row_number() OVER w - 1 + sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER w)::BIGINT AS sequence, CASE WHEN event_id % 5 = 0 THEN 44100 ELSE 48000 END AS sample_rate FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT session, source, sequence <> coalesce(lag(sequence) OVER w + 1, 0) AS gap, sample_rate <> first_value(sample_rate) OVER w AS rate FROM n WINDOW w AS (PARTITION BY session, source ORDER BY sequence ROWS UNBOUNDED PRECEDING))
SELECT session, source, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE rate AND NOT gap) AS rates FROM f GROUP BY 1, 2
""")
def sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a type stand for one source's blocks; numbers jump and rates change here and there."""
    by = W.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    number = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id")) - 1 + F.sum(F.expr("CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END")).over(by)
    rate = F.expr("CASE WHEN event_id % 5 = 0 THEN 44100 ELSE 48000 END").alias("sample_rate")
    checked = sequence.check_sequence(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("source"), number.cast("long").alias("sequence"), rate))
    return checked.groupBy("session", "source").agg(F.count_if(F.col("fault") == "sequence gap").alias("gaps"), F.count_if(F.col("fault") == "sample rate changed").alias("rates"))


BLOCKS = "b AS (SELECT o_custkey AS session, o_orderkey AS block, o_orderkey % 4001 + 100 AS samples FROM orders)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("block"), F.expr("o_orderkey % 4001 + 100").alias("samples"))


@query(f"WITH {BLOCKS}, p AS (SELECT *, coalesce(sum(samples) OVER (PARTITION BY session ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_sample FROM b) SELECT *, first_sample * 1000 // 16000 AS offset_ms FROM p")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.running_offsets(_blocks(spark, sf_dir), "session", ["block"], "samples")


@query(f"""
WITH {BLOCKS}, n AS (SELECT session, sum(samples)::BIGINT AS n FROM b GROUP BY 1), p AS (SELECT session, n, unnest(range(0, (n - 1) // 1000 + 1)) AS part FROM n)
SELECT session, part, least(n - part * 1000, 1000)::BIGINT AS sample_count FROM p
""")
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.split_fixed(_blocks(spark, sf_dir), "session", ["block"], "samples", 1000)


TRACKS = """
t AS (SELECT user_id AS session, CASE WHEN event_type IN ('click', 'view') THEN 'microphone' ELSE 'system' END AS source, event_id, value / 1000 AS value FROM events),
s AS (SELECT session, source, (row_number() OVER (PARTITION BY session, source ORDER BY event_id) - 1)::BIGINT AS pos, value FROM t)
"""


@query(f"""
WITH {TRACKS}, k AS (SELECT session FROM s GROUP BY 1 HAVING count(DISTINCT source) = 2)
SELECT session, pos, round(least(1, greatest(-1, sum(greatest(-1, least(1, value)) * CASE source WHEN 'microphone' THEN 1.0 ELSE 2.0 END))), 9) AS value FROM s WHERE session IN (SELECT session FROM k) GROUP BY 1, 2
""")
def aligned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = sequence.align_mix(tracks(spark, sf_dir), {"microphone": 1.0, "system": 2.0}, chunk=10)
    return mixed.select("session", "pos", F.posexplode("samples").alias("at", "value")).select("session", (F.col("pos") + F.col("at")).alias("pos"), F.round("value", 9).alias("value"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (session, source, block, samples): a user's click and view values stand for the microphone's samples, the others for the system's; blocks of different sizes."""
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.when(F.col("event_type").isin("click", "view"), "microphone").otherwise("system").alias("source"), "event_id", (F.col("value") / 1000).alias("value"))
    block = F.expr("event_id div 97").alias("block")
    return t.groupBy("session", "source", block).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("samples"))


@query("""
WITH f AS (SELECT user_id AS session, event_id AS position, value AS level FROM events WHERE value >= 60),
g AS (SELECT *, coalesce((position - lag(position) OVER w > 15)::INT, 1) AS fresh FROM f WINDOW w AS (PARTITION BY session ORDER BY position)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM g),
r AS (SELECT session, min(position) AS lo, max(position) + 1 AS hi, max(level) AS peak FROM i GROUP BY session, island HAVING max(position) + 1 - min(position) >= 7),
c AS (SELECT session, unnest(range(lo, hi, 20)) AS place, hi, peak FROM r)
SELECT session, place * 512 AS start_sample, (least(place + 20, hi) * 512)::BIGINT AS end_sample, peak, ((least(place + 20, hi) - place) * 512 * 1000 // 16000)::BIGINT AS duration_ms FROM c
""")
def loud_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("position"), F.col("value").alias("level"))
    found = sequence.threshold_segments(frames, "session", "position", "level", threshold=60.0, max_segment_ms=640)
    return sequence.drain_segments(found, F.lit(1 << 40))


LANGUAGES = ["zh", " zh-CN ", "Chinese", "en", "en-US", "English", "yue", "Cantonese", "ja", "Japanese", "ko", "Korean", "auto", "", " ", "fr"]


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 16 WHEN 0 THEN 'Chinese' WHEN 1 THEN 'Chinese' WHEN 2 THEN 'Chinese' WHEN 3 THEN 'English' WHEN 4 THEN 'English' WHEN 5 THEN 'English' WHEN 6 THEN 'Cantonese' WHEN 7 THEN 'Cantonese'
  WHEN 8 THEN 'Japanese' WHEN 9 THEN 'Japanese' WHEN 10 THEN 'Korean' WHEN 11 THEN 'Korean' WHEN 15 THEN 'fr' END AS n FROM documents)
SELECT doc_id, n AS full_name, CASE n WHEN 'Chinese' THEN 'zh' WHEN 'English' THEN 'en' WHEN 'Japanese' THEN 'ja' WHEN 'Cantonese' THEN 'yue' WHEN 'Korean' THEN 'ko' ELSE n END AS whisper_code,
  CASE n WHEN 'Chinese' THEN '中文' WHEN 'English' THEN '英文' WHEN 'Japanese' THEN '日文' WHEN 'Cantonese' THEN '粤语' ELSE n END AS funasr_code FROM d
""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.recognition_language(F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("doc_id") % 16 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("full_name"), text.whisper_language(name).alias("whisper_code"), text.funasr_language(name).alias("funasr_code"))


@query("""
WITH d AS (SELECT doc_id, n_chars::BIGINT * 1000 AS ms, n_chars::BIGINT * n_chars AS size FROM documents)
SELECT doc_id, printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) AS duration,
  CASE WHEN size <= 0 THEN '0 B' WHEN size < 1024 THEN printf('%.0f B', size::DOUBLE) WHEN size < 1048576 THEN printf('%.0f KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0::DOUBLE) ELSE printf('%.1f GB', size / 1073741824.0::DOUBLE) END AS size_text FROM d
""")
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", text.format_duration(n * 1000).alias("duration"), text.format_bytes(n * n, even=True).alias("size_text"))


@query("""
WITH u AS (SELECT page_id, page_id % 10 AS k, html FROM pages)
SELECT page_id, CASE k
  WHEN 0 THEN 'http://h' || page_id || '/v1/chat/completions' WHEN 1 THEN 'https://h' || page_id || ':8443/v1/chat/completions' WHEN 2 THEN 'http://h' || page_id || '/v1/chat/completions'
  WHEN 3 THEN 'https://h' || page_id || '/chat/completions' WHEN 4 THEN 'http://h' || page_id || ':443/v1/chat/completions' WHEN 5 THEN 'http://u:p@h' || page_id || '/a/b/chat/completions'
  WHEN 6 THEN 'http://[::1]:8000/v1/chat/completions' END AS endpoint, sha256(html) AS digest FROM u
""")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as people type them; those of the last kinds are no HTTP endpoints."""
    host = F.concat(F.lit("H"), F.col("page_id"))
    kinds = [(" http://", ":80/v1"), ("HTTPS://", ":8443/v1/?k=1#x"), ("http://", ":/v1//"), ("https://", ":443"), ("http://", ":443/v1/chat/completions/"), ("http://u:p@", "/a/b?x"), ("http://[::1]:8000/v1", None), ("ftp://", "/v1"), ("", "/v1"), ("http:///", None)]
    raw = F.coalesce(*[F.when(F.col("page_id") % 10 == n, F.lit(a) if b is None else F.concat(F.lit(a), host, F.lit(b))) for n, (a, b) in enumerate(kinds)])
    return table(spark, sf_dir, "pages").select("page_id", text.completions_url(raw).alias("endpoint"), F.sha2("html", 256).alias("digest"))


@query("""
SELECT conv_id AS session, turn AS id, CASE WHEN trim(text) <> '' THEN trim(text) END AS answer FROM conversations
""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("  "), "text", F.lit("\n"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), text.completion_text(body).alias("answer"))


@query("SELECT o_custkey AS session, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'mixed' ELSE min(o_orderpriority) END AS source FROM orders GROUP BY 1")
def session_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session")).agg(history.source_rollup("o_orderpriority").alias("source"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.without_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH c AS (SELECT vec_id, unnest(range(0, (len(embedding) - 1) // 24 + 1)) AS frame, embedding AS e FROM embeddings)
SELECT vec_id, frame::INT AS frame, len(e[frame * 24 + 1 : frame * 24 + 24])::INT AS valid, round(list_sum(list_transform(e[frame * 24 + 1 : frame * 24 + 24], lambda x: x::DOUBLE)), 6) AS total FROM c
""")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sequence.framed(F.col("embedding"), 24)).alias("frame", "f"))
    return cut.select("vec_id", "frame", "f.valid", F.round(F.aggregate("f.frame", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
