"""Scalar sample functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
TARGET_RATE = 16_000
FLOOR_DB = -80.0
FORMAT_SCALES = {
    "i8": (128.0, 0.0), "i16": (32768.0, 0.0), "i24": (8388608.0, 0.0), "i32": (2147483648.0, 0.0), "i48": (140737488355328.0, 0.0), "i64": (9223372036854775808.0, 0.0),
    "u8": (128.0, 128.0), "u16": (32768.0, 32768.0), "u24": (8388608.0, 8388608.0), "u32": (2147483648.0, 2147483648.0), "u48": (140737488355328.0, 140737488355328.0), "u64": (9223372036854775808.0, 9223372036854775808.0),
    "f32": (1.0, 0.0), "f64": (1.0, 0.0),
}
LONG_MAX = 9223372036854775807


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sanitize_sample(x: Column) -> Column:
    """Non-finite becomes 0, the rest is held within -1 to 1; null stays null."""
    x = x.cast("double")
    return F.when(_finite(x), clamp(x, -1.0, 1.0)).when(x.isNotNull(), 0.0)


def sanitize_gain(x: Column) -> Column:
    """Non-finite becomes 0, the rest is held within 0 to 4."""
    x = x.cast("double")
    return F.when(_finite(x), clamp(x, 0.0, 4.0)).when(x.isNotNull(), 0.0)


def to_float_samples(samples: Column, sample_format: Column) -> Column:
    """Samples of any of the integer or float formats as doubles in -1 to 1; an unknown format is an error."""
    scaled = None
    for name, (scale, middle) in FORMAT_SCALES.items():
        own = _scaled(samples, scale, middle)
        scaled = F.when(sample_format == name, own) if scaled is None else scaled.when(sample_format == name, own)
    return scaled.otherwise(F.raise_error(F.concat(F.lit("unsupported sample format: "), F.coalesce(sample_format, F.lit("null")))).cast("array<double>"))


def _scaled(samples: Column, scale: float, middle: float) -> Column:
    return F.transform(samples, lambda x: (x.cast("double") - F.lit(middle)) / F.lit(scale))


def interleave(planes: Column) -> Column:
    """array<array<T>> of channels to frames in a row, cut to the shortest channel; no channel: empty."""
    frames = F.coalesce(F.array_min(F.transform(planes, lambda p: F.size(p))), F.lit(0))
    rows = F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.transform(planes, lambda p: F.get(p, i)))
    return F.when(frames > 0, F.flatten(rows)).otherwise(F.filter(F.flatten(planes), lambda _: F.lit(False)))


def check_block(samples: Column, channels: Column, rate: Column) -> Column:
    """samples, or an error for no channels, no rate or a partial frame."""
    fault = F.when(channels <= 0, "channels must be positive").when(rate <= 0, "sample rate must be positive").when(F.size(samples) % F.greatest(channels, F.lit(1)) != 0, "partial frame")
    return F.when(fault.isNull(), samples).otherwise(F.raise_error(fault).cast("array<double>"))


def frame_count(samples: Column, channels: Column) -> Column:
    return F.floor(F.size(samples) / channels).cast("long")


def to_mono(samples: Column, channels: Column) -> Column:
    """The mean of each frame's sanitised samples; one channel is only sanitised."""
    clean = F.transform(samples, sanitize_sample)
    frames = F.floor(F.size(samples) / channels).cast("int")
    mean = F.transform(F.sequence(F.lit(1), F.greatest(frames, F.lit(1))), lambda i: F.aggregate(F.slice(clean, (i - 1) * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels)
    return F.when(frames == 0, F.slice(clean, 1, 0)).when(channels == 1, clean).otherwise(mean)


def apply_gain(samples: Column, gain: Column) -> Column:
    """Each sample times the gain, held within -1 to 1; no check for non-finite samples here."""
    gain = sanitize_gain(gain)
    return F.transform(samples, lambda x: clamp(x.cast("double") * gain, -1.0, 1.0))


def mix_mono(a: Column, b: Column, gain_a: Column, gain_b: Column) -> Column:
    """Position by position to the longer length, what is missing being 0."""
    ga, gb = sanitize_gain(gain_a), sanitize_gain(gain_b)
    part = lambda x, g: F.coalesce(sanitize_sample(x), F.lit(0.0)) * g
    return F.zip_with(a, b, lambda x, y: clamp(part(x, ga) + part(y, gb), -1.0, 1.0))


def rms(samples: Column) -> Column:
    """Root of the mean square; empty: 0."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).when(samples.isNotNull(), 0.0)


def rms_db(level: Column) -> Column:
    """20 log10 of a level, FLOOR_DB at least."""
    return F.when(level > 0, F.greatest(F.lit(FLOOR_DB), 20 * F.log10(F.when(level > 0, level)))).otherwise(FLOOR_DB)


def waveform_bins(samples: Column, bins: int) -> Column:
    """The peak magnitude of each of so many slices; a slice has at least one sample, so short inputs repeat theirs; empty: zeros."""
    n = F.size(samples).cast("long")

    def peak(i: Column) -> Column:
        start = F.least(F.floor(i * n / F.lit(bins)), n - 1)
        end = F.least(F.greatest(F.floor((i + 1) * n / F.lit(bins)), start + 1), n)
        return F.array_max(F.transform(F.slice(samples, (start + 1).cast("int"), (end - start).cast("int")), lambda x: F.abs(x.cast("double"))))

    places = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
    return F.when(n > 0, F.transform(places, peak)).otherwise(F.array_repeat(F.lit(0.0), bins))


def saturating_multiply(a: Column, b: int) -> Column:
    return F.coalesce(F.try_multiply(a.cast("long"), F.lit(b).cast("long")), F.when(a.isNotNull(), F.lit(LONG_MAX)))


def samples_to_ms(samples: Column, rate: int = TARGET_RATE) -> Column:
    """Whole milliseconds of a sample count, saturating."""
    return _div(saturating_multiply(samples, 1000), rate)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def quantise(x: Column) -> Column:
    """-1..1 to 16 bits: non-finite 0, half away from zero."""
    return F.round(sanitize_sample(x) * 32767).cast("smallint")


def level_percent(db: Column) -> Column:
    """Where on a meter of FLOOR_DB to 0 a level stands."""
    return (clamp(db, FLOOR_DB, 0.0) + 80.0) / 80.0 * 100.0
