import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import codecs, signal, text
from tapeloom.operators.resample import Resampler
from tapeloom.sources.settings import DEFAULTS, load_settings, validate_settings


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def doubles(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_scalars(spark):
    nothing = F.expr("CAST(array() AS array<double>)")
    r = one(
        spark, nan=signal.sanitize_sample(F.lit(float("nan"))), inf=signal.sanitize_sample(F.lit(float("inf"))), high=signal.sanitize_sample(F.lit(1.5)),
        mono=signal.to_mono(doubles(1, -1, 0.5, 0.25), F.lit(2)), mix=signal.mix_mono(doubles(0.75, -0.5), doubles(0.75, -0.75), F.lit(1), F.lit(1)), uneven=signal.mix_mono(doubles(0.5), doubles(0.25, 0.25), F.lit(1), F.lit(1)),
        bins=signal.waveform_bins(doubles(-0.1, 0.4, -0.8, 0.2), 2), none=signal.waveform_bins(nothing, 3), quiet=signal.rms_db(signal.rms(nothing)), ms=signal.samples_to_ms(F.lit(2500)), huge=signal.samples_to_ms(F.lit(2**62)),
        planes=signal.interleave(F.array(doubles(1, 2, 3), doubles(4, 5))),
    )
    assert (r.nan, r.inf, r.high, r.quiet, r.ms) == (0, 0, 1, -80, 156)
    assert (r.mono, r.mix, r.uneven, r.bins, r.none) == ([0, 0.375], [1, -1], [0.75, 0.25], [0.4, 0.8], [0, 0, 0])
    assert r.planes == [1, 4, 2, 5] and r.huge == (2**63 - 1) // 16000


def test_partial_frame_is_an_error(spark):
    with pytest.raises(Exception, match="partial frame"):
        one(spark, x=signal.check_block(doubles(0, 1, 0), F.lit(2), F.lit(16000)))


def test_text(spark):
    segments = lambda s: F.array(F.struct(F.lit("complete").alias("status"), F.lit(s).alias("text")), F.struct(F.lit("failed").alias("status"), F.lit("no").alias("text")))
    r = one(
        spark, exact=text.preview(segments("　" + "é" * 160 + "\t")), more=text.preview(segments("x" * 161)), url=text.completions_url(F.lit("http://A:80/v1")), again=text.completions_url(F.lit("http://a/v1/chat/completions/?q=1")), bad=text.completions_url(F.lit("ftp://a")),
        answer=text.completion_text(F.lit('{"choices":[{"message":{"content":"  Hello world.  "}}]}')), blank=text.completion_text(F.lit('{"choices":[{"message":{"content":" "}}]}')), auto=text.recognition_language(F.lit("auto")), zh=text.recognition_language(F.lit(" zh-CN ")), other=text.recognition_language(F.lit("xx")),
        long=text.format_duration(F.lit(360_000_999)), size=text.format_bytes(F.lit(1536 * 1024)), dots=text.safe_file_name(F.lit("..")), name=text.safe_file_name(F.lit("a.wav")),
    )
    assert r.exact == "é" * 160 and r.more == "x" * 160 + "…"
    assert r.url == r.again == "http://a/v1/chat/completions" and r.bad is None
    assert (r.answer, r.blank, r.auto, r.zh, r.other) == ("Hello world.", None, None, "Chinese", "xx")
    assert (r.long, r.size, r.dots, r.name) == ("100:00:00", "1.5 MB", False, True)


def test_sizes_are_rounded_exactly(spark):
    sizes = {12845056: ("12.3 MB", "12.2 MB"), 12845057: ("12.3 MB", "12.3 MB"), 12949914: ("12.4 MB", "12.4 MB"), 12949913: ("12.3 MB", "12.3 MB"), 2560: ("3 KB", "2 KB"), 3584: ("4 KB", "4 KB"), 1023: ("1023 B",) * 2, 1024**2 - 1: ("1024 KB",) * 2, 1024**3 - 1: ("1024.0 MB",) * 2, 5 << 28: ("1.3 GB", "1.2 GB"), 0: ("0 B",) * 2, None: (None,) * 2}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.format_bytes(F.col("n")), text.format_bytes(F.col("n"), even=True)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == sizes


def test_codecs(spark):
    pcm = np.random.default_rng(1).integers(-32767, 32768, 9001)
    rows = [("a", 0, (pcm[:5000] / 32767).tolist()), ("a", 1, (pcm[5000:] / 32767).tolist()), ("b", 0, [0.25] * 16000), ("n", 0, [float("nan"), float("inf"), 2.0, -2.0, 0.5 / 32767])]
    blocks = codecs.pcm_blocks(spark.createDataFrame(rows, "k string, n int, x array<double>"), "k", "x", "n")
    flac = {r.k: bytes(r.content) for r in codecs.whole_files(codecs.flac_rows(blocks, "k"), "k").collect()}
    wav = {r.k: bytes(r.content) for r in codecs.whole_files(codecs.wav_rows(blocks, "k"), "k").collect()}
    rate, back = codecs.decode_flac_bytes(flac["a"])
    assert rate == 16000 and (back == pcm).all() and codecs.decode_flac_bytes(flac["n"])[1].tolist() == [0, 0, 32767, -32767, 1]
    assert len(wav["b"]) == 44 + 32000 and codecs.parse_wav_bytes(wav["b"])[0] == 16000
    assert codecs.repair_wav_bytes(codecs.wav_header(0) + bytes(320))[40:44] == (320).to_bytes(4, "little")
    assert [codecs.utf8_uint(v) for v in (0x7F, 0x80, 0x800, 0x10000, 0x200000, 0x4000000)] == [chr(0x7F).encode(), chr(0x80).encode(), chr(0x800).encode(), chr(0x10000).encode(), b"\xf8\x88\x80\x80\x80", b"\xfc\x84\x80\x80\x80\x80"]
    assert codecs.crc8(b"123456789") == 0xF4 and codecs.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xFEE8
    with pytest.raises(ValueError):
        codecs.flac_header(0, 0, 0, 0)
    with pytest.raises(ValueError):
        codecs.wav_header(2**32)


def test_resampler():
    r, x = Resampler(48000), np.sin(2 * np.pi * 440 * np.arange(48000) / 48000)
    out = np.concatenate([*[r.push(x[i : i + 777]) for i in range(0, 48000, 777)], r.finish()])
    assert len(out) == 16000 and np.abs(out[100:-100] - np.sin(2 * np.pi * 440 * np.arange(100, 15900) / 16000)).max() < 1e-2
    assert Resampler(16000).push(np.array([0.1, -0.2])).tolist() == [0.1, -0.2]


def test_resampler_goes_on_from_its_state():
    x = np.random.default_rng(4).uniform(-1, 1, 9000)
    whole = Resampler(44100)
    want, one, got = np.concatenate((whole.push(x), whole.finish())), Resampler(44100), []
    for i in range(0, 9000, 700):
        got.append(one.push(x[i : i + 700]))
        one = Resampler.resume(44100, one.state())
    assert np.allclose(np.concatenate([*got, one.finish()]), want)


def test_settings():
    assert load_settings(None)["translation"] == {"enabled": True, "endpoint": "http://127.0.0.1:8000/v1", "model": "Hy-MT2-1.8B", "targetLanguage": "Chinese"}
    validate_settings(load_settings(None), ("qwen3-asr-0.6b-int8",))
    audio = {k: v for k, v in DEFAULTS["audio"].items() if k != "outputDirectory"}
    assert load_settings(json.dumps({"audio": audio | {"segmentMinutes": 5}, "more": 1}))["audio"] == DEFAULTS["audio"] | {"segmentMinutes": 5}
    assert load_settings('{"transcription": {"vad": {"minSpeechMs": 1}}}')["transcription"]["vad"] == DEFAULTS["transcription"]["vad"] | {"minSpeechMs": 1}
    for cut in ('{"audio": {"segmentMinutes": 5}}', '{"desktop": {"theme": "dark"}}', '{"translation": []}', "{"):
        with pytest.raises(ValueError):
            load_settings(cut)
    for bad in (json.dumps({"audio": audio | {"microphoneGain": float("nan")}}), '{"transcription": {"threads": 0}}', '{"transcription": {"vad": {"maxSegmentMs": 1}}}', '{"translation": {"endpoint": "ftp://x"}}'):
        with pytest.raises(ValueError):
            validate_settings(load_settings(bad), ("qwen3-asr-0.6b-int8",))
