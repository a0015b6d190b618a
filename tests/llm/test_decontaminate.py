import random

import pytest

from tapeloom.llm.common import WordHashes
from tapeloom.llm.decontaminate import MATCH, MIN_SCORE, benchmark_leaks, drop_contaminated, passage_words, short_items, smith_waterman

rng = random.Random(6)
VOCABULARY = [f"v{i}" for i in range(400)]
FRAME = [f"frame{i}" for i in range(30)]


def text(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(words, rate, kinds):
    out = []
    for w in words:
        kind = rng.choice(kinds) if rng.random() < rate else "keep"
        out += {"keep": [w], "replace": [rng.choice(VOCABULARY)], "add": [w, rng.choice(VOCABULARY)], "drop": []}[kind]
    return out


def plain_score(item, doc):
    """The best score by a cell at a time, over the whole text."""
    row, best = [0] * (len(doc) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(doc):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(item)) if item else 0


def test_alignment_is_the_plain_one():
    for _ in range(60):
        a, b = text(rng.randrange(1, 25)), text(rng.randrange(1, 60))
        b[3:3] = edited(a, 0.3, ["replace", "add", "drop"])
        hashes = WordHashes()
        score, end = smith_waterman(hashes.of([w.encode() for w in a]), hashes.of([w.encode() for w in b]))
        assert score == round(plain_score(a, b) * MATCH * len(a)) and 0 <= end <= len(b)


# Items of all lengths; 20 that share 30 of their 40 words; pairs of equal ones; one without words.
ITEMS = [text(n) for n in (1, 2, 3, 5, 8, 10, 11, 12, 20, 40, 90)] + [[*FRAME[:15], *text(10), *FRAME[15:]] for _ in range(20)]


def planted(rate, kinds, most=3):
    rows = []
    for item in ITEMS[3:]:
        for _ in range(most):
            rows.append([*text(rng.randrange(0, 60)), *edited(item, rate, kinds), *text(rng.randrange(0, 60))])
    return rows


def leaks(spark, docs, **more):
    items = spark.createDataFrame([*((i, " ".join(w), "x") for i, w in enumerate(ITEMS)), (900, " ".join(ITEMS[9]).upper(), "x"), (901, None, "x"), (902, " .. ", "x"), (903, " ".join(ITEMS[9]), "x")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(i, ", ".join(d) if d is not None else None, 1) for i, d in enumerate(docs)], "doc_id long, text string, item_id int").repartition(4)
    return benchmark_leaks(df, items, **more).collect()


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_replaced_words_lose_no_passage(spark, rate):
    docs = planted(rate, ["replace"], 2)
    found = {(r.doc_id, r.item_id): r for r in leaks(spark, docs)}
    for d, doc in enumerate(docs):
        for i, item in enumerate(ITEMS):
            score = plain_score(item, doc)
            assert ((d, i) in found) == (score >= MIN_SCORE), (d, i, score)
            if score >= MIN_SCORE:
                r = found[d, i]
                assert r.score == pytest.approx(score) and plain_score(item, doc[r.start_word : r.end_word]) == pytest.approx(score)


def test_recall_with_words_added_and_dropped(spark):
    docs = planted(0.25, ["replace", "add", "drop"])
    found = {(r.doc_id, r.item_id) for r in leaks(spark, docs) if r.item_id < 900}
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(ITEMS) if plain_score(item, doc) >= MIN_SCORE}
    assert found <= want and len(found) >= 0.98 * len(want)


def test_many_blocks_are_one(spark):
    docs = [*planted(0.1, ["replace"], 1), None, [], ITEMS[9] * 2, text(20_000) + ITEMS[10]]
    whole, parts = ({(r.doc_id, r.item_id, round(r.score, 9), r.start_word, r.end_word) for r in leaks(spark, docs, **m)} for m in ({}, {"block_bytes": 1500}))
    assert whole == parts and any(d == len(docs) - 1 and i == 10 for d, i, *_ in whole)
    assert {(d, i, s, a, b) for d, i, s, a, b in whole if d == len(docs) - 2 and i == 9} == {(len(docs) - 2, 9, 1.0, 0, 40)}
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(ITEMS[5:])], "item_id long, text string")
    df = spark.createDataFrame([(None if i % 2 else 7, " ".join(d) if d is not None else None, i) for i, d in enumerate(docs)], "doc_id long, text string, __r int".replace("__r", "item_id"))
    kept = [sorted(r.item_id for r in drop_contaminated(df, items, **m).collect()) for m in ({}, {"block_bytes": 1500})]
    assert kept[0] == kept[1] and {len(docs) - 3, len(docs) - 4} <= set(kept[0]) and len(docs) - 1 not in kept[0]


def test_words():
    assert passage_words("It's A-1, Ünïcode\tx") == [b"it", b"s", b"a", b"1", "Ünïcode".encode(), b"x"]
    assert passage_words(None) == [] == passage_words(" .. ")


def test_short_items_are_told_and_drop_nothing(spark):
    items = spark.createDataFrame([(1, "The"), (2, "of the"), (3, "one, two three!"), (4, "four words of it"), (5, "  ?!"), (6, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat sat of the mat"), (2, "one two three"), (3, "so four words of it are here"), (4, "clean"), (5, None)], "doc_id long, text string")
    for block_bytes in (4_000_000, 8):
        found = {(r.doc_id, r.item_id, r.short) for r in benchmark_leaks(docs, items, block_bytes=block_bytes).collect()}
        assert {(1, 1, True), (1, 2, True), (2, 3, True), (3, 4, False)} <= found and all(short == (item != 4) for _, item, short in found)
        assert {r.doc_id for r in drop_contaminated(docs, items, block_bytes=block_bytes).collect()} == {1, 2, 4, 5}
    assert short_items(items) == 3
