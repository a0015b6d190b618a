"""Shared lines against a plain version, both where the common lines are sent to the tasks and where the lines travel."""

from collections import Counter, defaultdict

import pytest

from tapeloom.llm.lines import common_lines, drop_common_lines

BLANK = " \t\n\x0b\x0c\r"
SHARED, OTHER = "This Line is shared by Several documents and is long", "é" * 40
EDGE = "exactly forty code points, counted once."
TEXTS = [SHARED + "\nown", "  " + SHARED.upper() + "\t\r\nx\n" + SHARED.lower(), SHARED, f"a\n{SHARED}\nb\n\n{SHARED}", SHARED + "\n", "", None, "\n\n", OTHER, "x" * 39, EDGE, "é" * 20 + "\n" + "É" * 40, "y" * 300_000 + "\n" + SHARED]


def rows():
    out = list(enumerate(TEXTS))
    out += [(i, f"{OTHER}\n{EDGE}\n{EDGE[:-1]}\n{'z' * i}") for i in range(20, 24)]  # with 8 and 10 in five documents
    out += [(30, "only in four rows of one document, and in three more of others"[:62])] * 4 + [(i, "only in four rows of one document, and in three more of others"[:62]) for i in (31, 32, 33)]
    out += [(None, SHARED), (None, SHARED), (4, SHARED), (4, SHARED + "\n")]
    return out


def plain(rows, least_chars=40, least_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(-1 if doc is None else doc)
    common = {k: max(d) for k, d in held.items() if len(d) >= least_docs}
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if common.get(key(x), doc) == doc]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out, common


@pytest.mark.parametrize("sent", [1000, 1, 0])
def test_lines_against_a_plain_version(spark, sent):
    df = spark.createDataFrame([(i, t, "x", i, 1) for i, t in rows()], "doc_id long, text string, line string, last long, k1 int").repartition(3)
    want, common = plain(rows())
    assert len(common) == 3
    assert Counter(map(tuple, drop_common_lines(df, sent=sent).collect())) == want
    assert Counter(map(tuple, drop_common_lines(df, 10, 2, sent=sent).collect())) == plain(rows(), 10, 2)[0]
    assert drop_common_lines(df.limit(0), sent=sent).count() == 0


def test_common_lines_tell_their_documents(spark):
    found = common_lines(spark.createDataFrame(rows(), "doc_id long, text string")).collect()
    assert sorted((r.docs, r.last) for r in found) == [(5, 23), (5, 23), (7, 12)]
