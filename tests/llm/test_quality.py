from tapeloom.llm.quality import importance_resample

PLAIN = "the {} of the house and a {} by the river"


def test_toxic_texts_are_not_drawn(spark):
    """Texts with the words of labelled toxic ones go, labelled or not, good or not; clean ones stay."""
    rows = [(i, PLAIN.format(f"door{i % 7}", f"tree{i % 5}") + (" you scum idiot" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (900, ""), (901, None)], "doc_id long, text string")
    for size in (None, 10_000):
        drawn = {r.doc_id for r in importance_resample(docs, labels, size=size).collect()}
        assert drawn == {i for i, _ in rows if i % 4} | {900, 901}
    assert importance_resample(docs, labels.withColumn("toxic", labels.toxic * 0)).count() == 202


def test_few_labels_reject_short_junk(spark):
    """Short junk goes with few labels as it does with many: table rows, and one word over and over."""
    junk = [f"cell{i} | cell{i + 1} | row{i}" if i % 2 else f"word{i} " * 4 for i in range(100)]
    rows = [(i, PLAIN.format(f"door{i % 7}", f"tree{i % 5}")) for i in range(100)] + [(100 + i, t) for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (30, 100):
        labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i % 100 < n], "doc_id long, quality int")
        assert {r.doc_id for r in importance_resample(docs, labels).collect()} == set(range(100))


def test_a_row_goes_by_its_own_label(spark):
    """However few labels there are, and whatever the text."""
    rows = [(i, PLAIN.format(f"door{i % 7}", f"tree{i % 5}"), i) for i in range(60)] + [(None, "the", 0), (3, "the same id again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __rejected long")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 0), (4, 1, 0), (5, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    drawn = importance_resample(docs.drop("__rejected"), labels, size=1000).collect()
    assert {r.doc_id for r in drawn} == {None, *range(60)} - {2, 3, 5} and len(drawn) == 58
