"""Retryable work queues over segment rows: (session, id, status, attempts, ...)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.text import safe_file_name, trim

MAX_ATTEMPTS = 3
WAV_HEADER_BYTES = 44
ERROR_CHARACTERS = 500


def is_retryable(status: Column, attempts: Column) -> Column:
    """Waiting, interrupted, or failed with attempts left; the first two whatever the attempts."""
    return F.coalesce(status.isin("pending", "processing") | ((status == "failed") & (attempts < MAX_ATTEMPTS)), F.lit(False))


def rollup_status(status: str = "status", attempts: str = "attempts") -> Column:
    """Aggregate: pending while anything is retryable, then partial if anything failed, else complete."""
    open_ = F.coalesce(F.max(is_retryable(F.col(status), F.col(attempts))), F.lit(False))
    failed = F.coalesce(F.max(F.col(status) == "failed"), F.lit(False))
    return F.when(open_, "pending").when(failed, "partial").otherwise("complete")


def queue_depth(status: str = "status", attempts: str = "attempts") -> Column:
    return F.count_if(is_retryable(F.col(status), F.col(attempts)))


def next_items(segments: DataFrame, session: str = "session", position: str = "position") -> DataFrame:
    """The first retryable segment of each session in stored order."""
    open_ = segments.filter(is_retryable(F.col("status"), F.col("attempts")))
    rest = [c for c in segments.columns if c != session]
    return open_.groupBy(session).agg(F.min_by(F.struct(*rest), position).alias("__row")).select(session, "__row.*").select(*segments.columns)


def claim(items: DataFrame) -> DataFrame:
    return items.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def resolve(items: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Claimed items with the outcome of injected work.

    work gets a batch (a pandas frame of the items) and returns text and error for each row, one of them null; it runs once for an
    Arrow batch, so it may load its model once for a Python worker. A raised exception fails that batch's rows."""
    schema = items.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                done = work(batch)
                batch = batch.assign(text=done["text"].to_numpy(), error=done["error"].to_numpy())
            except Exception as fault:
                batch = batch.assign(text=None, error=str(fault)[:ERROR_CHARACTERS])
            batch["status"] = batch["error"].isna().map({True: "complete", False: "failed"})
            batch["text"] = batch["text"].where(batch["error"].isna(), "")
            yield batch[schema.names]

    return items.mapInPandas(run, schema)


def step(segments: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """All segments after one pass: in each session the first retryable one is claimed and resolved, the rest stays.

    The rest is told from the items' keys, not from their outcome, so the work runs once an item."""
    items = next_items(segments)
    rest = segments.join(items.select("session", "id"), ["session", "id"], "left_anti")
    return rest.unionByName(resolve(claim(items), work).select(*segments.columns))


def run_queue(segments: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], store: Callable[[DataFrame, int], DataFrame], passes: int | None = None) -> DataFrame:
    """Passes of step until nothing can be retried, or so many.

    store keeps each pass's result and returns it as read again, so that work done isn't done anew; only a count visits the driver.
    Each pass raises the attempts of one segment a session, so there are at most MAX_ATTEMPTS times a session's segments."""
    done = 0
    while (passes is None or done < passes) and segments.agg(queue_depth().alias("n")).first()["n"]:
        segments = store(step(segments, work), done)
        done += 1
    return segments


class ModelCache:
    """One loaded model in a Python worker: kept while its key is asked for, dropped for another or after it has idled."""

    def __init__(self, load: Callable[..., Any], idle_seconds: float = 600, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.idle, self.clock = load, idle_seconds, clock
        self.key, self.model, self.used = None, None, 0.0

    def get(self, *key: Any) -> Any:
        if self.key != key or self.clock() - self.used >= self.idle:
            self.key = self.model = None
            self.model = self.load(*key)
            self.key = key
        self.used = self.clock()
        return self.model


def transcriber(load: Callable[[str, int, str | None], Callable[[Any], str]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Work for resolve: load(model, threads, language) gives a recogniser of a clip, loaded once for a run of rows of the same three.

    The items have modelId, threads, language and clip; a clip that fails fails alone."""
    cache = ModelCache(load)

    def one(row: dict) -> tuple[str | None, str | None]:
        try:
            return cache.get(row["modelId"], row["threads"], row["language"])(row["clip"]), None
        except Exception as fault:
            return None, str(fault)[:ERROR_CHARACTERS]

    return lambda batch: pd.DataFrame(list(map(one, batch.to_dict("records"))), columns=["text", "error"])


def chat_request(model: str, target_language: str, source_text: str) -> str:
    """The JSON body that asks for a translation."""
    order = f"You are a translator. Render what the user says in {target_language}; leave names, figures and layout as they are, and answer with nothing else."
    return json.dumps({"model": model, "temperature": 0, "messages": [{"role": "system", "content": order}, {"role": "user", "content": source_text}]}, ensure_ascii=False)


def translator(send: Callable[[str, str], tuple[int, str]], url: str, model: str, target_language: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Work for resolve: send(url, body) gives (HTTP status, response text) for each item's sourceText.

    A status that isn't 2xx fails with the status and the response's first ERROR_CHARACTERS; so does an answer without text."""

    def one(source_text: str) -> tuple[str | None, str | None]:
        try:
            status, text = send(url, chat_request(model, target_language, source_text))
            if not 200 <= status < 300:
                return None, f"HTTP {status}: {text[:ERROR_CHARACTERS]}"
            answer = json.loads(text)["choices"][0]["message"]["content"].strip()
            return (answer, None) if answer else (None, "the answer is empty")
        except Exception as fault:
            return None, str(fault)[:ERROR_CHARACTERS]

    return lambda batch: pd.DataFrame([one(t) for t in batch["sourceText"]], columns=["text", "error"])


def chain_translations(before: DataFrame, after: DataFrame, translations: DataFrame, enabled: bool = True) -> DataFrame:
    """The translation queue once a pass of the transcript queue has completed more segments (session, id, status, text): those enter it."""
    done = lambda x: x.filter("status = 'complete'").select("session", "id", "text")
    return enqueue_translations(translations, done(after).join(done(before).select("session", "id"), ["session", "id"], "left_anti"), enabled)


def next_ids(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows with ids that go on from each session's largest (from 1), in order, ties by the other columns; past the largest long: an error."""
    top = existing.groupBy("session").agg(F.max("id").alias("__top"))
    ties = [c for c in new.columns if c not in ("session", order)]
    n = F.row_number().over(W.partitionBy("session").orderBy(order, *ties))
    numbered = new.join(top, "session", "left").withColumn("id", F.try_add(F.coalesce("__top", F.lit(0)).cast("long"), n.cast("long")))
    return numbered.withColumn("id", F.coalesce("id", F.raise_error("no id is left").cast("long"))).drop("__top")


def enqueue_clips(existing: DataFrame, clips: DataFrame) -> DataFrame:
    """Pending transcript segments of speech clips (session, start_sample, end_sample), appended in order of time."""
    from tapeloom.functions.signal import samples_to_ms

    numbered = next_ids(existing.select("session", "id"), clips, "start_sample")
    return numbered.select("session", "id", samples_to_ms(F.col("start_sample")).alias("startMs"), samples_to_ms(F.col("end_sample")).alias("endMs"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit("").alias("text"))


def enqueue_translations(existing: DataFrame, completed: DataFrame, enabled: bool = True) -> DataFrame:
    """The translation queue after transcript segments (session, id, text) completed.

    Blank texts and a switched-off translation add nothing. A new segment is pending; a known one starts again only if its source
    text changed. Texts are stored and compared as they are, white space included. One full join on the key."""
    told = completed.filter(F.lit(enabled) & (trim(F.col("text")) != "")).select("session", "id", F.col("text").alias("__new"))
    both = existing.join(told, ["session", "id"], "full")
    reset = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("sourceText"))
    return both.select(
        "session", "id", F.coalesce("__new", "sourceText").alias("sourceText"), F.when(reset, "").otherwise(F.col("text")).alias("text"),
        F.when(reset, "pending").otherwise(F.col("status")).alias("status"), F.when(reset, 0).otherwise(F.col("attempts")).cast("long").alias("attempts"),
        F.when(~reset, F.col("error")).alias("error"),
    )


def recover_segments(segments: DataFrame) -> DataFrame:
    """After a crash: what was being processed waits again."""
    return segments.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def recovered_documents(segments: DataFrame, stored_status: DataFrame, save_on_status: bool) -> DataFrame:
    """For each session: the status after recovery, whether work waits, and whether the document must be saved.

    Transcripts are saved only if a segment changed, translations (save_on_status) also if the document's status did."""
    status, interrupted = rollup_status(), F.max(F.col("__was") == "processing")
    after = recover_segments(segments.withColumn("__was", F.col("status"))).groupBy("session").agg(status.alias("status"), (queue_depth() > 0).alias("waiting"), interrupted.alias("__changed"))
    joined = after.join(stored_status.select("session", F.col("status").alias("__stored")), "session", "left")
    changed = F.col("__changed") | (F.lit(save_on_status) & ~F.col("status").eqNullSafe(F.col("__stored")))
    return joined.select("session", "status", "waiting", changed.alias("save"))


def recover_manifests(manifests: DataFrame, lengths: DataFrame, at: Column) -> DataFrame:
    """Sessions that still recorded become interrupted, completed at that time; the last unfinished WAV segment takes its counts from the file's length.

    lengths: sessionId, fileName, length (bytes). Counts stay where the name isn't a plain file name, or the file isn't there or shorter than a header.
    finalized stays false; other formats aren't repaired."""
    was = F.col("status") == "recording"
    tail = F.when(F.size("segments") > 0, F.element_at("segments", -1))
    repairs = was & (F.col("audioFormat") == "wav") & ~tail["finalized"] & safe_file_name(tail["fileName"])
    joined = manifests.withColumn("__file", F.when(repairs, tail["fileName"]))
    whole = lengths.filter(F.col("length") >= WAV_HEADER_BYTES).select("sessionId", F.col("fileName").alias("__file"), F.col("length").alias("__length"))
    joined = joined.join(whole, ["sessionId", "__file"], "left")
    count = F.floor((F.col("__length") - WAV_HEADER_BYTES) / 2).cast("long")
    fixed = F.transform("segments", lambda s, i: F.when((i == F.size("segments") - 1) & F.col("__length").isNotNull(), s.withField("sampleCount", count).withField("durationMs", F.floor(count * 1000 / F.col("sampleRate")).cast("long"))).otherwise(s))
    return joined.withColumns({"segments": fixed, "completedAt": F.when(was, at).otherwise(F.col("completedAt")), "status": F.when(was, "interrupted").otherwise(F.col("status"))}).select(*manifests.columns)


def finish_archive(manifests: DataFrame, session_id: str, at: Column, error: str | None = None) -> DataFrame:
    """A recording session becomes completed, or failed with its error."""
    mine = (F.col("sessionId") == session_id) & (F.col("status") == "recording")
    return manifests.withColumns({
        "completedAt": F.when(mine, at).otherwise(F.col("completedAt")),
        "lastError": F.when(mine, F.lit(error)).otherwise(F.col("lastError")),
        "status": F.when(mine, "failed" if error else "completed").otherwise(F.col("status")),
    })


def drop_session(segments: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """(the queue without a session, one row with how many segments still wait)."""
    rest = segments.filter(F.col("session") != session)
    return rest, rest.agg(queue_depth().alias("pending"))


def update_languages(documents: DataFrame, controls: DataFrame) -> DataFrame:
    """Transcript documents (sessionId, forcedLanguage, translation, updatedAt, ...) after changes of settings in mid-session.

    controls: sessionId, at, language, translation (a struct as the document's). A change holds for the whole document, so the last one counts, and with it both
    settings; changes of sessions without a document do nothing. One row a session is joined."""
    last = controls.groupBy("sessionId").agg(F.max_by(F.struct("language", "translation", "at"), F.struct("at", "language")).alias("__set"))
    joined = documents.join(last, "sessionId", "left")
    change = F.col("__set").isNotNull()
    new = {"forcedLanguage": "language", "translation": "translation", "updatedAt": "at"}
    return joined.withColumns({c: F.when(change, F.col("__set")[n]).otherwise(F.col(c)) for c, n in new.items()}).select(*documents.columns)


def with_document_settings(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments that wait (session, ...), with language and translation of their document as it is now: all that still waits takes a change, what is done doesn't."""
    told = documents.select(F.col("sessionId").alias("session"), F.col("forcedLanguage").alias("language"), "translation")
    return segments.filter(is_retryable(F.col("status"), F.col("attempts"))).join(told, "session")
