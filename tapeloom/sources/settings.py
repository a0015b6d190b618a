"""Settings: nested configuration with defaults for whatever a file leaves out, and its rules."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.text import completions_url
from tapeloom.sources.documents import save_text

# Fixed values.
DEFAULTS: dict[str, dict[str, Any]] = {
    "audio": {"format": "flac", "microphoneGain": 1.0, "outputDirectory": None, "segmentMinutes": 60, "source": "mixed", "systemGain": 1.0},
    "desktop": {"hideWindowOnClose": True, "language": "system", "launchAtLogin": False, "startRecordingOnLaunch": False, "theme": "system"},
    "transcription": {"language": "auto", "modelId": "qwen3-asr-0.6b-int8", "threads": 2, "unloadAfterIdleMinutes": 10, "vad": {"activationThreshold": 0.5, "minSpeechMs": 250, "minSilenceMs": 500, "maxSegmentMs": 30_000}},
    "translation": {"enabled": True, "endpoint": "http://127.0.0.1:8000/v1", "model": "Hy-MT2-1.8B", "targetLanguage": "Chinese"},
}


#: Sections that a file gives whole or not at all, and the fields in them that it may leave out.
WHOLE: dict[str, tuple[str, ...]] = {"audio": ("outputDirectory",), "desktop": ()}


def _filled(default: Any, given: Any) -> Any:
    if isinstance(default, dict):
        if not isinstance(given, dict):
            raise ValueError("a section of the settings must be an object")
        return {k: _filled(v, given[k]) if k in given else v for k, v in default.items()}
    return given


def load_settings(text: str | None) -> dict[str, Any]:
    """Settings from a file's text; none gives the defaults, unknown fields are ignored.

    Missing sections have their defaults, and so have missing fields of transcription (vad's too) and translation; audio and desktop must be whole."""
    given = json.loads(text) if text is not None else {}
    found = _filled(DEFAULTS, given)
    for section, spare in WHOLE.items():
        missing = [k for k in DEFAULTS[section] if section in given and k not in given[section] and k not in spare]
        if missing:
            raise ValueError(f"{section} lacks {', '.join(missing)}")
    return found


def save_settings(spark: SparkSession, settings: dict[str, Any], path: str, models: tuple[str, ...]) -> None:
    """Valid settings, written all or nothing; invalid ones are an error and leave the file as it is."""
    validate_settings(settings, models)
    save_text(spark, json.dumps(settings, indent=2, ensure_ascii=False), path)


def check_segmentation(threshold: float, min_speech_ms: int, min_silence_ms: int, max_segment_ms: int) -> None:
    if not (math.isfinite(threshold) and 0 <= threshold <= 1):
        raise ValueError("the threshold must lie between 0 and 1")
    if min_speech_ms <= 0 or min_silence_ms <= 0:
        raise ValueError("shortest speech and silence must be positive")
    if max_segment_ms < min_speech_ms:
        raise ValueError("the longest segment can't be shorter than the shortest")


def validate_settings(settings: dict[str, Any], models: tuple[str, ...]) -> None:
    audio, asr, translation = (settings[k] for k in ("audio", "transcription", "translation"))
    rules = [
        (1 <= audio["segmentMinutes"] <= 1440, "segmentMinutes must be 1 to 1440"),
        *((math.isfinite(audio[k]) and 0 <= audio[k] <= 4, f"{k} must be 0 to 4") for k in ("microphoneGain", "systemGain")),
        (1 <= asr["threads"] <= 16, "threads must be 1 to 16"),
        (asr["modelId"] in models, "modelId isn't known"),
        (re.match(r"https?://[^/?#\s]+", translation["endpoint"].strip(), re.I) is not None, "the endpoint must be an http or https address"),
        (translation["model"].strip() != "", "the translation model can't be blank"),
        (translation["targetLanguage"].strip() != "", "targetLanguage can't be blank"),
    ]
    for holds, message in rules:
        if not holds:
            raise ValueError(message)
    vad = asr["vad"]
    check_segmentation(vad["activationThreshold"], vad["minSpeechMs"], vad["minSilenceMs"], vad["maxSegmentMs"])


def settings_fault(row: dict[str, Column]) -> Column:
    """The first rule that a row of settings breaks, or null: the rules of validate_settings as one expression.

    row: columns named as the fields of DEFAULTS' audio, transcription (vad's too) and translation sections."""
    finite = lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf")))
    blank = lambda x: F.regexp_replace(x, r"\p{IsWhite_Space}+", "") == ""
    rules = [
        (row["segmentMinutes"].between(1, 1440), "segmentMinutes must be 1 to 1440"),
        *((finite(row[k]) & row[k].between(0, 4), f"{k} must be 0 to 4") for k in ("microphoneGain", "systemGain")),
        (row["threads"].between(1, 16), "threads must be 1 to 16"),
        (completions_url(row["endpoint"]).isNotNull(), "the endpoint must be an http or https address"),
        (~blank(row["model"]), "the translation model can't be blank"),
        (~blank(row["targetLanguage"]), "targetLanguage can't be blank"),
        (finite(row["activationThreshold"]) & row["activationThreshold"].between(0, 1), "the threshold must lie between 0 and 1"),
        ((row["minSpeechMs"] > 0) & (row["minSilenceMs"] > 0), "shortest speech and silence must be positive"),
        (row["maxSegmentMs"] >= row["minSpeechMs"], "the longest segment can't be shorter than the shortest"),
    ]
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), message) for holds, message in rules])
