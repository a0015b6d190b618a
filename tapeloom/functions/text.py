"""Document text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language aliases and per-model codes.
LANGUAGE_ALIASES = {"zh": "Chinese", "zh-CN": "Chinese", "Chinese": "Chinese", "en": "English", "en-US": "English", "English": "English", "yue": "Cantonese", "Cantonese": "Cantonese", "ja": "Japanese", "Japanese": "Japanese", "ko": "Korean", "Korean": "Korean"}
FUNASR_CODES = {"Chinese": "中文", "English": "英文", "Japanese": "日文", "Cantonese": "粤语"}
WHISPER_CODES = {"Chinese": "zh", "English": "en", "Japanese": "ja", "Cantonese": "yue", "Korean": "ko"}
PREVIEW = 160


def trim(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), value)


def recognition_language(language: Column) -> Column:
    """The full name of a language; empty and auto: null; anything else passes."""
    name = trim(language)
    return F.when(name.isin("", "auto"), F.lit(None).cast("string")).otherwise(_mapped(name, LANGUAGE_ALIASES))


def funasr_language(language: Column) -> Column:
    return _mapped(language, FUNASR_CODES)


def whisper_language(language: Column) -> Column:
    return _mapped(language, WHISPER_CODES)


def completions_url(endpoint: Column) -> Column:
    """The chat completions address of an HTTP endpoint: scheme and host in lower case, no default port, query or fragment, the suffix once;
    null where it isn't one."""
    plain = trim(endpoint)
    pattern = r"^((?i:https?))://((?:[^/?#\s@]*@)?)([^/?#\s@:]+|\[[^/?#\s@]+\])(?::(\d*))?(/[^?#\s]*)?(?:[?#].*)?$"
    part = lambda n: F.regexp_extract(plain, pattern, n)
    scheme, port = F.lower(part(1)), F.regexp_replace(part(4), "^0+(?=.)", "")
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    base = F.regexp_replace(part(5), "/+$", "")
    path = F.when(F.endswith(base, F.lit("/chat/completions")), base).otherwise(F.concat(base, F.lit("/chat/completions")))
    return F.when(part(3) != "", F.concat(scheme, F.lit("://"), part(2), F.lower(part(3)), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path))


def completion_text(body: Column) -> Column:
    """The trimmed first answer in a completions response; null where there is none or it is blank."""
    text = trim(F.get_json_object(body, "$.choices[0].message.content"))
    return F.when(text != "", text)


def preview(segments: Column) -> Column:
    """The complete segments' texts in stored order, trimmed, blank ones dropped, joined by spaces: PREVIEW code points and … if there are more.

    segments: array<struct<status, text, ...>>; null: empty text."""
    texts = F.transform(F.filter(segments, lambda s: s["status"] == "complete"), lambda s: trim(s["text"]))
    whole = F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), " "), F.lit(""))
    return F.when(F.length(whole) > PREVIEW, F.concat(F.substring(whole, 1, PREVIEW), F.lit("…"))).otherwise(whole)


def safe_file_name(name: Column) -> Column:
    """Whether a name is exactly one ordinary path component."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~F.rlike(name, F.lit(r"[/\\\x00]")), F.lit(False))


def safe_archive_path(path: Column, is_link: Column) -> Column:
    """Whether an archive member may be unpacked: relative, without .. and no link."""
    return F.coalesce(~is_link & ~F.rlike(path, F.lit(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")) & (path != ""), F.lit(False))


def partial_path(path: Column) -> Column:
    """The name under which an unfinished file is kept."""
    return F.concat(path, F.lit(".partial"))


def sha256_matches(content: Column, digest: Column) -> Column:
    return F.sha2(content, 256) == F.lower(digest)


def format_duration(ms: Column) -> Column:
    """HH:MM:SS of whole seconds; hours go on beyond 99."""
    seconds = F.call_function("div", ms.cast("long"), F.lit(1000).cast("long"))
    part = lambda n, unit, most: F.call_function("div", n, F.lit(unit).cast("long")) % most
    return F.format_string("%02d:%02d:%02d", F.call_function("div", seconds, F.lit(3600).cast("long")), part(seconds, 60, 60), seconds % 60)


def _shares(n: Column, unit: int, scale: int, even: bool) -> Column:
    """How many scale-ths of a unit are nearest to a whole number n; exact ties go up, or to the even one."""
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    rest = (n % unit) * scale
    whole, over = div(n, unit) * scale + div(rest, unit), 2 * (rest % unit)
    tie = whole % 2 == 1 if even else F.lit(True)
    return whole + ((over > unit) | ((over == unit) & tie)).cast("long")


def format_bytes(n: Column, even: bool = False) -> Column:
    """In units of 1024 up to GB; one decimal from MB on. An exact tie goes up, as in the app (toFixed); with even to the even digit, as C's printf does."""
    n = n.cast("long")
    tenths = lambda unit: (lambda t: F.concat(F.call_function("div", t, F.lit(10).cast("long")), F.lit("."), t % 10))(_shares(n, unit, 10, even))
    small = F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1024**2, F.concat(_shares(n, 1024, 1, even), F.lit(" KB")))
    return F.when(n <= 0, "0 B").otherwise(small.when(n < 1024**3, F.concat(tenths(1024**2), F.lit(" MB"))).otherwise(F.concat(tenths(1024**3), F.lit(" GB"))))


def display_text(status: Column, text: Column, working: str = "Transcribing", failed: str = "Transcription failed") -> Column:
    """What a segment shows: its text, … if that is blank, or its state."""
    shown = trim(F.coalesce(text, F.lit("")))
    return F.when(status == "complete", F.when(shown == "", "…").otherwise(shown)).when(status == "failed", failed).otherwise(f"{working}…")


def session_id(started_at: Column, unique: Column) -> Column:
    """UTC time to the millisecond and a unique part."""
    return F.concat(F.date_format(started_at, "yyyyMMdd'T'HHmmss.SSS'Z'"), F.lit("-"), unique)


def session_path(local_date: Column, session: Column) -> Column:
    """The folder of a session: by local date, which need not be the id's."""
    return F.concat_ws("/", F.date_format(local_date, "yyyy/MM/dd"), session)
