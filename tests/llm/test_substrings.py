import numpy as np
import pytest

from tapeloom.llm import substrings
from tapeloom.llm.substrings import common_prefixes, induced, remove_repeats


def brute(rows, length=100):
    """Kept bytes and runs of each row, rows in order of id."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                hit[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        out.append((i, bytes(c for c, m in zip(b, hit, strict=True) if not m), sum(m and (k == 0 or not hit[k - 1]) for k, m in enumerate(hit))))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, rid string, gram int")
    return sorted((r.doc_id, bytes(r.kept), len(r.removed)) for r in remove_repeats(df).collect())


def test_induced_order_is_the_sorted_order():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (200, 40)).astype(np.uint8)
    rows[50:90, 10:] = rows[:40, 10:]
    size = rng.integers(20, 41, 200)
    rows[np.arange(40) >= size[:, None]] = 0
    held, text = rng.integers(0, 11, 200), lambda r, k: rows[r, 10 - k : size[r]].tobytes()
    order = np.array(sorted(range(200), key=lambda r: text(r, 0)))
    common = common_prefixes(rows[order][:, 10:], size[order] - 10)
    for k in range(1, 11):
        order, common = induced(order, common, rows[:, 10 - k], held >= k)
        texts = [text(r, k) for r in order]
        assert texts == sorted(texts) and len(texts) == (held >= k).sum()
        shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(texts, texts[1:], strict=False)]
        assert common.tolist() == shared


@pytest.mark.parametrize("crowd", [substrings.CROWD, 3])
def test_low_entropy_and_near_copies(spark, monkeypatch, crowd):
    """Texts of few letters, copies with edits, and many contexts of one anchor; crowd: with all of them crowded too."""
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rng = np.random.default_rng(7)
    letters = lambda n, k: "".join(rng.choice(list("abcdé"[:k]), n))
    base = letters(400, 5)
    rows = [(i, letters(int(rng.integers(0, 900)), int(rng.integers(1, 4)))) for i in range(30)]
    rows += [(40 + i, letters(60, 4) + base[i * 5 : 300 + i * 5] + letters(40, 4)) for i in range(20)]
    rows += [(70 + i, letters(80, 4) + base[100:150] + letters(80, 4)) for i in range(30)]
    rows += [(110, None), (111, ""), (112, base[:100]), (113, base[:99]), (114, base + base)]
    assert found(spark, rows) == brute(rows)


def test_texts_longer_than_a_piece(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 90_000, 60_000)]
    whole = " ".join(words)
    assert len(whole) > substrings.PIECE
    rows = [(1, whole), (2, "head " + whole[len(whole) // 2 :] + " tail " + whole[: substrings.PIECE + 500]), (3, whole[substrings.PIECE - 150 : substrings.PIECE + 150])]
    assert found(spark, rows) == brute(rows)
