"""The pipeline on a small table: each stage's decisions take effect, clean documents stay."""

import random

import corpus_pipeline
from pyspark.sql import functions

from penmark.session import staged


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    line = lambda n=14: " ".join(word() for _ in range(n))
    item = line(20)
    docs, labels = [], []
    for d in range(300):
        text = "\n".join(line() for _ in range(5))
        if d % 6 == 0:
            text = text.replace(" ", " scum ", 2)
        docs.append((d, text))
        labels.append((d, 0, int(d % 6 == 0)))
    clean = dict(docs)
    repeated = docs[1][1].split("\n")[0]
    docs.append((400, repeated + "\n" + "\n".join(line() for _ in range(4))))
    base = [word() for _ in range(120)]
    docs.append((401, " ".join(base)))
    docs.append((402, " ".join(base[:60] + [word()] + base[61:])))
    docs.append((403, line(60) + " " + item + " " + line(60)))
    docs += [(404, ""), (405, None)]
    folder = str(tmp_path)
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    seen, table = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, table, folder))
        seen.append((name, out.columns))
        if name == "toxicity":
            kept = {r.doc_id for r in out.collect()}
            assert all((d in kept) == (d % 6 != 0) for d in clean)
        if name == "line_dedup":
            texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
            assert texts[400][0].count("\n") == 3 and texts[400][1] == len(texts[400][0]) and texts[1][0] == clean[1]
        if name == "near_dedup":
            ids = {r.doc_id for r in out.collect()}
            assert 401 in ids and 402 not in ids and {404, 405} <= ids
        if name == "decontamination":
            ids = {r.doc_id for r in out.collect()}
            assert 403 not in ids and {d for d in clean if d % 6} <= ids
        table = out
    assert [n for n, _ in seen] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(set(c) == set(corpus_pipeline.COLUMNS) for _, c in seen[:-1])
    assert {r.doc_id for r in table.collect()} == ids


def test_line_stage_drops_lines_two_edits_away(spark):
    rows = [(1, "a line that is long enough to be compared"), (2, "a lime that is long enough to be compaired")]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.n_chars for r in corpus_pipeline.dedup_lines(spark, frame, "").collect()} == {1: len(rows[0][1]), 2: 0}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


def _kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def _tables(spark, tmp_path, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_copies_are_told_by_id_and_text(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    one, two, three, four = text(), text(), text(), text()
    near = one.rsplit(" ", 1)[0] + " other"
    rows = [(1, one), (2, near), (2, two), (None, near), (None, three), (None, four), (None, four), (7, two), (7, two)]
    rows += [(8, ""), (8, ""), (9, None), (9, None), (None, "")]
    kept = _kept(corpus_pipeline.dedup_documents(spark, _frame(spark, rows), ""))
    want = [(1, one), (2, two), (None, three), (None, four), (8, ""), (8, ""), (9, None), (9, None), (None, "")]
    assert kept == sorted(want, key=str)


def test_contaminated_rows_are_told_by_id_and_text(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n=40: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = text(20)
    folder = _tables(spark, tmp_path, items=[(1, item), (None, None), (2, "")])
    clean, bad = text(), text(20) + " " + item
    rows = [(1, clean), (1, bad), (None, bad), (None, clean), (None, None), (3, ""), (3, bad), (3, bad), (4, clean), (4, clean)]
    kept = _kept(corpus_pipeline.drop_contaminated(spark, _frame(spark, rows), folder))
    assert kept == sorted([r for r in rows if r[1] != bad], key=str)


def test_other_stages_keep_every_row(spark, tmp_path):
    folder = _tables(spark, tmp_path, labels=[(1, 1, 0), (2, 1, None), (None, 1, 1)])
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "x"), (None, None), (2, "")]
    frame = _frame(spark, rows)
    assert _kept(corpus_pipeline.drop_toxic(spark, frame, folder)) == sorted(rows, key=str)
    assert _kept(corpus_pipeline.dedup_lines(spark, frame, folder)) == sorted(rows, key=str)
    packed = corpus_pipeline.pack_sequences(spark, frame, folder).collect()
    assert len(packed) == len(rows)


def test_empty_tables(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    _frame(spark, []).withColumn("_th", frame_text()).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_columns_with_clashing_names(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    frame = _frame(spark, [(1, "some words here"), (2, None)])
    for name in ("score", "n", "h1", "_d", "_th", "kept", "near"):
        frame = frame.withColumn(name, frame_text())
    frame.write.parquet(f"{folder}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == [1, 2]


def frame_text():
    return functions.lit("clash")
