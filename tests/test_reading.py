"""What SQL can't express: layout, extraction, mining, and the screens' own vocabulary."""

import re

from pyspark.sql import functions as F

from folioscope.operators import papers as Q
from folioscope.operators import screening as K
from folioscope.plans.catalog import ROWS_ONLY


def test_covered_boxes(spark):
    rows = [(1, 1, "a b c d e f g h"), (1, 2, "a b c d"), (1, 3, "x y"), (1, 4, "x z"), (1, 5, None), (2, 6, "a b"), (1, 7, "X Y")]
    got = Q.covered_boxes(spark.createDataFrame(rows, "page int, id int, text string"), ["page"]).collect()
    assert {(r.page, r.id) for r in got} == {(1, 2), (1, 7)}


def test_covered_boxes_of_conversations(spark, small):
    from collections import Counter, defaultdict

    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", F.xxhash64("turn", "role", "text").alias("id"), "text").collect()
    pages, expected = defaultdict(list), set()
    for r in rows:
        pages[r.conv_id].append((-len((r.text or "").split()), r.id, Counter((r.text or "").lower().split())))
    for page, own in pages.items():
        kept = Counter()
        for _, i, words in sorted(own, key=lambda x: x[:2]):
            if words and sum((words & kept).values()) >= 0.5 * sum(words.values()):
                expected.add((page, i))
            else:
                kept |= words
    assert {(r.conv_id, r.id) for r in ROWS_ONLY["l1_covered_boxes"](spark, small).collect()} == expected


def test_reading_order(spark, small):
    # a heading across, two columns, a foot across
    rows = [(1, 1, 50.0, 20.0, 650.0, 60.0), (1, 2, 50.0, 100.0, 330.0, 400.0), (1, 3, 50.0, 420.0, 330.0, 800.0), (1, 4, 370.0, 90.0, 650.0, 500.0), (1, 5, 370.0, 505.0, 650.0, 790.0), (1, 6, 50.0, 900.0, 650.0, 950.0)]
    got = Q.reading_order(spark.createDataFrame(rows, "page int, id int, x1 double, y1 double, x2 double, y2 double"), ["page"], 700.0, 1000.0).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [1, 2, 3, 4, 5, 6]
    every = ROWS_ONLY["l3_reading_order"](spark, small)
    assert every.groupBy("page").agg((F.count("*") - F.max("place")).alias("d")).where("d <> 0").isEmpty()


def test_reading_order_of_many_pages(spark):
    """Pages of one box and of several in one batch, a page without a number, and no call for each page."""
    rows = [(p if p else None, i, 10.0 + 100 * (i % 2), 50.0 * (i // 2) + p % 3, 90.0 + 100 * (i % 2), 50.0 * (i // 2) + 30) for p in range(300) for i in range(1 + p % 6)]
    boxes = spark.createDataFrame(rows, "page int, id int, x1 double, y1 double, x2 double, y2 double")
    got = Q.reading_order(boxes.repartition(3, "id"), ["page"], 700.0, 1000.0)
    assert {(r.page, r.id): r.place for r in got.collect()} == {(r[0], r[1]): r[1] + 1 for r in rows} and got.count() == len(rows)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_fields(spark, small):
    text = "In 2019 the model saw 2019 or 300. THE Model and a dog; the model."
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = K.extracted_fields(frame, "doc_id", "text", {"number": [r"\b(\d{3,4})\b"], "word": [r"\bthe (\w+)"]}, {"number": lambda raw, m: f"{int(raw)} "}, quote=10).collect()
    found = {(r.field, r.value): (r.n, r.first_pos) for r in got}
    assert found == {("number", "2019"): (2, 3), ("number", "300"): (1, 30), ("word", "model"): (3, 8)}
    assert {r.quote for r in got if r.value == "300"} == {text[25:38].strip()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for d in docs:
        for p, name in ((r"\b(\d{2,4})\b", "number"), (r"\bthe (\w+)", "word"), (r"\ba (\w+)", "word")):
            for m in re.finditer(p, d.text or "", re.IGNORECASE):
                expected[str(d.doc_id), name, m[1].lower()] = expected.get((str(d.doc_id), name, m[1].lower()), 0) + 1
    assert {(r.key, r.field, r.value.lower()): r.n for r in ROWS_ONLY["j6_fields"](spark, small).collect()} == expected


def test_parameters(spark, small):
    got = {(r.dataset, r.param, r.value) for r in ROWS_ONLY["j7_parameters"](spark, small).where("key = '3'").collect()}
    hcp = {(p, v) for d, p, v in got if d.startswith("HCP (")}
    assert {("TR", "1 s"), ("TE", "30 ms"), ("Voxel_Size", "2x2x2mm"), ("Field_Strength", "3T")} <= hcp and ("Voxel_Size", "6mm") not in hcp
    assert any(d.startswith("NSD") and (p, v) == ("Field_Strength", "7T") for d, p, v in got)


def test_sample_and_likeness(spark, small):
    a, b = (ROWS_ONLY["r4_sample"](spark, small).collect() for _ in range(2))
    assert a == b and len(a) == 25 and all(r.p_partkey % 10 for r in a)
    assert all(r.ok for r in ROWS_ONLY["r6_like_titles"](spark, small).where("p_partkey % 2 = 0").collect())


FMRI = "We decode language from brain fMRI recordings. The proposed model uses a transformer encoder with self-attention over BOLD voxel signals. "


def test_default_screens(spark):
    rows = [
        (1, "Decoding speech from fMRI", FMRI, FMRI * 30, "body"),
        (2, "A systematic review of brain decoding", FMRI, FMRI * 30, "body"),
        (3, "EEG decoding", "We decode text from EEG electrodes with a transformer encoder.", "EEG electrode MEG EMG spike rate " * 80, "EEG"),
        (4, "Linear maps", "We reconstruct images from brain fMRI voxel data by ridge regression.", "fMRI voxel BOLD hemodynamic MNI " * 30, "text"),
        (5, "A resting state", "fMRI voxel BOLD with cross-attention only.", "fMRI voxel BOLD hemodynamic MNI we use cross-attention and self-attention blocks. " * 30, "text"),
        (6, None, None, None, None),
    ]
    papers = spark.createDataFrame(rows, "key int, title string, abstract string, methods string, body string")
    full = {r.key: r for r in K.screen_papers(papers, "key").collect()}
    assert full[1].include and full[1].task == "language / semantic decoding" and full[1].near
    assert [full[k].reason for k in (2, 3, 4, 5, 6)] == [K.REVIEW, K.RIVAL, K.NO_ATTENTION, K.NO_TASK, K.RIVAL]
    short = {r.key: r for r in K.screen_abstracts(papers, "key").collect()}
    assert short[1].include and [short[k].reason for k in (2, 3, 4, 5, 6)] == [K.REVIEW, K.NEVER_NAMED, K.NO_MACHINERY, K.NO_TASK, K.NEVER_NAMED]
    assert short[4].decoding and not short[4].attention and short[4].primary
    names = spark.createDataFrame([("HCP data and HCP again; NSD once; hcp",), (None,)], "t string").select(K.datasets_in(F.col("t")).alias("d")).collect()
    assert [r.d for r in names] == [["HCP (Human Connectome Project)"], []]
