"""Operators over one long session: two-level scans and filtering by blocks give what one window and one carried filter give."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.signal import LONG_MAX
from tapeloom.operators import resample, sequence


def test_offsets_in_two_levels(spark):
    rng = random.Random(3)
    rows = [(k, n * rng.randint(1, 2) if k == "b" else n, n % 7, rng.randint(0, 50)) for k, size in (("a", 500), ("b", 90), ("c", 1), (None, 30)) for n in range(size)]
    df = spark.createDataFrame(rows, "session string, block long, tie long, samples long").repartition(4)
    told = lambda r: (r[0] or "", *r[1:])
    before = W.partitionBy("session").orderBy("block", "tie", "samples").rowsBetween(W.unboundedPreceding, -1)
    want = sorted(map(told, df.withColumn("first_sample", F.coalesce(F.sum("samples").over(before), F.lit(0))).collect()))
    for stride in (1, 10, 1000):
        found = sequence.running_offsets(df, "session", ["block", "tie", "samples"], "samples", stride)
        assert sorted(map(told, found.drop("offset_ms").collect())) == want and found.columns == [*df.columns, "first_sample", "offset_ms"]
    by_text = sequence.running_offsets(df.withColumn("block", F.lpad(F.col("block").cast("string"), 5, "0")), "session", ["block", "tie", "samples"], "samples", 10)
    assert sorted(r.first_sample for r in by_text.collect()) == sorted(r[-1] for r in want)
    huge = spark.createDataFrame([("s", 0, 2**62), ("s", 10, 2**62), ("s", 20, 5)], "session string, block long, samples long")
    assert [r.first_sample for r in sequence.running_offsets(huge, "session", ["block"], "samples", 10).orderBy("block").collect()] == [0, 2**62, LONG_MAX]


def plain_islands(frames, threshold, gap, least, most):
    out = []
    for key in sorted({k for k, *_ in frames}):
        loud = sorted((p, v) for k, p, v in frames if k == key and v >= threshold)
        runs = []
        for p, v in loud:
            if runs and p - runs[-1][1] <= gap:
                runs[-1][1:] = [p, max(v, runs[-1][2])]
            else:
                runs.append([p, p, v])
        for lo, last, peak in runs:
            if last + 1 - lo >= least:
                out += [(key, at, min(at + most, last + 1), peak) for at in range(lo, last + 1, most)]
    return sorted(out)


@pytest.mark.parametrize("stride", [1, 3, 16, 10_000])
def test_segments_in_two_levels(spark, stride):
    rng = random.Random(5)
    frames = [(k, p, rng.random()) for k in "ab" for p in sorted(rng.sample(range(900), 400))] + [("c", p, 0.9) for p in range(200)] + [("d", 5, 0.9)]
    df = spark.createDataFrame(frames, "session string, position long, level double").repartition(3)
    found = sequence.threshold_segments(df, "session", "position", "level", 0.6, 512, 96, 128, 320, stride=stride)
    assert sorted((r.session, r.start_sample // 512, r.end_sample // 512, r.peak) for r in found.collect()) == plain_islands(frames, 0.6, 4, 3, 10)


@pytest.mark.parametrize(("rate", "size"), [(48_000, 1000), (44_100, 333), (16_000, 100), (8_000, 64), (11_025, 5000)])
def test_blocks_are_filtered_as_one_recording(spark, rate, size):
    rng = np.random.default_rng(rate)
    x = rng.uniform(-1, 1, 4321)
    cuts = [0, *sorted(rng.integers(0, 4321, 12).tolist()), 4321]
    rows = [("s", "microphone", n, rate, x[a:b].tolist()) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("t", "system", 0, rate, [0.5]), ("u", "system", 0, rate, [])]
    df = spark.createDataFrame(rows, "session string, source string, sequence long, sample_rate int, samples array<double>").repartition(3)
    parts = resample.resample_recordings(df, block_samples=size).orderBy("session", "part").collect()
    whole = resample.Resampler(rate)
    want = np.concatenate((whole.push(x), whole.finish()))
    own = [r for r in parts if r.session == "s"]
    got = np.concatenate([r.samples for r in own])
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-9 and len(own) == -(-4321 // size)
    assert [r.first for r in own] == np.cumsum([0, *(len(r.samples) for r in own[:-1])]).tolist()
    assert [len(r.samples) for r in parts if r.session == "t"] == [-(-16_000 // rate)] and not [r for r in parts if r.session == "u"]


def test_a_rate_that_changes_is_an_error(spark):
    df = spark.createDataFrame([("s", "m", 0, 8000, [0.1]), ("s", "m", 1, 16000, [0.1])], "session string, source string, sequence long, sample_rate int, samples array<double>")
    with pytest.raises(Exception, match="rate changed"):
        resample.resample_recordings(df).collect()


@pytest.mark.parametrize("stride", [1, 4, 1000])
def test_numbers_are_checked_in_two_levels(spark, stride):
    rng = random.Random(8)
    rows = []
    for key in ("a", "b", None, "late", "good"):
        numbers = list(range(40)) if key == "good" else [n for n in range(3 if key == "late" else 0, 60) if rng.random() < 0.85 for _ in range(1 + (rng.random() < 0.1))]
        rows += [(key, "m", n, 8000 if key in ("a", None) and n > 50 else 16000, i) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "session string, source string, sequence long, sample_rate int, __at long").repartition(3)
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((n, rate) for k, _, n, rate, _ in rows if k == key)
        for i, (n, rate) in enumerate(own):
            gap = (i and own[i - 1][0] == n) or (n != 0 and (n - 1) not in {m for m, _ in own})
            want.append((key or "", n, "sequence gap" if gap else "sample rate changed" if rate != own[0][1] else ""))
    found = [(r.session or "", r.sequence, r.fault or "") for r in sequence.check_sequence(df, stride=stride).collect()]
    assert sorted(found) == sorted(want) and len({f for *_, f in found}) == 3


def test_runs_of_blocks_are_filtered_as_one_after_another():
    rng = np.random.default_rng(5)
    for rate in (48000, 44100, 8000, 16000):
        blocks = [rng.normal(size=rng.integers(0, 40)) for _ in range(120)]
        one, many = resample.Resampler(rate), resample.Resampler(rate)
        apart, together = [one.push(b) for b in blocks], many.push_all(blocks[:50]) + many.push_all(blocks[50:51]) + many.push_all(blocks[51:])
        assert [x.tolist() for x in apart] == [x.tolist() for x in together] and one.finish().tolist() == many.finish().tolist()


def test_parts_that_many_batches_hold(spark):
    """Parts cut by Arrow batches, sessions without a name, and samples that are null."""
    rng = np.random.default_rng(6)
    rows = [(k, s, n, 48000, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for k in (None, 1, 2) for s in ("a", "b") for n in range(60)]
    blocks = spark.createDataFrame(rows, "session long, source string, sequence long, sample_rate int, samples array<double>")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        found = resample.resample_recordings(blocks, block_samples=50).collect()
    finally:
        spark.conf.set(name, before)
    whole = {(r.session, r.source): r.samples for r in resample.resample_recordings(blocks, block_samples=10_000).filter("session IS NOT NULL").collect()}
    assert len(whole) == 4 and len({(r.session, r.source, r.part) for r in found if r.session}) == 24
    for key, samples in whole.items():
        parts = sorted((r.first, r.samples) for r in found if (r.session, r.source) == key)
        assert np.allclose(np.concatenate([x for _, x in parts]), samples, atol=1e-12) and len(samples) == 100
