import pytest
from pyspark.sql import functions as F

from penmark.plans import experiments as ex
from penmark.plans.feature_sets import feature_sets
from penmark.sources import files


def block(sent_id, text, tokens):
    lines = [f"# sent_id = {sent_id}", f"# text = {text}"]
    lines += ["\t".join([str(i + 1), form, form, tag, *["_"] * 6]) for i, (form, tag) in enumerate(tokens)]
    return "\n".join(lines) + "\n\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    path.joinpath("a.tsv").write_text(
        "ID\tSpeaker_name\tSpeaker_role\tSpeaker_party\tSpeaker_birth\nP.u1\tAna Gil\tRegular\tPP\t1960\nP.u3\tAna Gil\t\tPP\t1960\n",
        encoding="utf8",
    )
    path.joinpath("b.tsv").write_text("Speaker_name\tID\tParty_status\tOther\nBea\tP.u2\tCoalition\tx\n", encoding="utf8")
    path.joinpath("a.conllu").write_text(
        block("P.u1.s1", "¿Qué día?", [("¿", "PUNCT"), ("Qué", "PRON"), ("día", "NOUN")])
        + block("P.u1.s2", "¡FUERA!", [("FUERA", "ADV")])
        + block("P.u1.s10", "Sí señor", [("Sí", "ADV"), ("señor", "NOUN")]),
        encoding="utf8",
    )
    path.joinpath("b.conllu").write_text(block("P.u2.s1", "Dïa", [("Dïa", "NOUN")]), encoding="utf8")
    path.joinpath("00README.txt").write_text("nothing", encoding="utf8")
    return str(path)


def test_metadata_joins_files_by_name(spark, folder):
    rows = {r["ID"]: r for r in files.read_metadata(spark, folder).collect()}
    assert set(rows) == {"P.u1", "P.u2", "P.u3"}
    assert rows["P.u2"]["Speaker_name"] == "Bea" and rows["P.u2"]["Party_status"] == "Coalition"
    assert rows["P.u1"]["Speaker_birth"] == 1960 and rows["P.u2"]["Speaker_birth"] is None
    assert rows["P.u3"]["Speaker_role"] is None


def test_sentences_keep_tokens(spark, folder):
    rows = {r["sent_id"]: r for r in files.read_conllu(spark, folder).collect()}
    assert set(rows) == {"P.u1.s1", "P.u1.s2", "P.u1.s10", "P.u2.s1"}
    first = rows["P.u1.s1"]
    assert first["utterance_id"] == "P.u1" and first["text"] == "¿Qué día?"
    assert [(t["form"], t["upos"]) for t in first["tokens"]] == [("¿", "PUNCT"), ("Qué", "PRON"), ("día", "NOUN")]


def test_speech_table_follows_file_order(spark, folder):
    table = files.speech_table(files.read_metadata(spark, folder), files.read_conllu(spark, folder))
    rows = {r["speech_id"]: r for r in table.collect()}
    assert rows["P.u1"]["text"] == "¿ qué día? sí señor"
    assert rows["P.u1"]["pos_tags"] == "PUNCT PRON NOUN ADV NOUN"
    assert rows["P.u2"]["text"] == "dia" and rows["P.u3"]["text"] == rows["P.u3"]["pos_tags"] == ""


def test_order_holds_when_a_file_is_read_in_splits(spark, tmp_path):
    sentences = "".join(block(f"P.u1.s{i}", f"Frase {i}", [("Frase", "NOUN")]) for i in range(400))
    tmp_path.joinpath("a.conllu").write_text(sentences, encoding="utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        read = files.read_conllu(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 2  # sentences begin in several splits
        tagged = read.withColumn("upos", F.lit("NOUN"))
        text = files.assemble_utterances(tagged, ["file", "block", "line"]).first()["text"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert text == " ".join(f"frase {i}" for i in range(400))


def test_table_is_built_once_and_unknown_ids_fail(spark, folder, tmp_path):
    path = str(tmp_path / "speeches")
    assert files.read_or_build_speeches(spark, path, folder).count() == 3
    assert files.read_or_build_speeches(spark, path, "/nowhere").count() == 3
    bad = tmp_path / "bad"
    bad.mkdir()
    bad.joinpath("a.tsv").write_text("ID\tSpeaker_name\nX.u1\tAna\n", encoding="utf8")
    bad.joinpath("a.conllu").write_text(block("Y.u1.s1", "Hola", [("Hola", "INTJ")]), encoding="utf8")
    with pytest.raises(ValueError):
        files.read_or_build_speeches(spark, str(tmp_path / "other"), str(bad))


def test_tsv_output(spark, folder, tmp_path):
    table = files.speech_table(files.read_metadata(spark, folder), files.read_conllu(spark, folder))
    files.write_speeches(table, str(tmp_path / "out"), tsv=True)
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert back.columns == table.columns and back.count() == 3
    # An empty text reads back as missing, which the text filter treats alike.
    assert back.where("speech_id = 'P.u3'").first()["text"] is None


def test_stored_methods_are_skipped(spark, tmp_path):
    path = str(tmp_path / "results")
    assert files.read_long(spark, path, ex.RESULTS_SCHEMA).count() == 0
    row = spark.createDataFrame([("run1", "ALL", "all", "macro_f1", 0.5, "{}", 3)], ex.RESULTS_SCHEMA)
    files.append_results(row, path)
    stored = files.read_long(spark, path, ex.RESULTS_SCHEMA)
    todo = {r["method"] for r in files.todo_methods(feature_sets(spark), stored, "run1").collect()}
    assert "ALL" not in todo and len(todo) == 12
    assert files.todo_methods(feature_sets(spark), stored, "run2").count() == 13


def test_results_csv_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("ALL", "{}", 3, 0.5, 0.25)], "Method string, Best_params string, Tot_features int, Macro_F1 double, micro_F1 double")
    files.write_results_csv(wide, str(tmp_path / "r"))
    got = {(r["method"], r["label"]): r["value"] for r in files.read_results_csv(spark, str(tmp_path / "r")).collect()}
    assert got == {("ALL", "Macro_F1"): 0.5, ("ALL", "micro_F1"): 0.25}


def test_metadata_cell_that_looks_like_a_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ID\tSpeaker_name\nx1\tID\nx2\tana\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("Speaker_name\tID\nbea\tID\n", encoding="utf-8")
    rows = {(r["ID"], r["Speaker_name"]) for r in files.read_metadata(spark, str(tmp_path)).collect()}
    assert rows == {("x1", "ID"), ("x2", "ana"), ("ID", "bea")}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_conllu_line_ends(spark, tmp_path, end):
    block = "# sent_id = P1.u1.s{0}\n# text = Hola {0}.\n1\tHola\thola\tINTJ\t_\t_\t_\t_\t_\t_\n\n"
    text = "".join(block.format(i) for i in (1, 2, 3)).replace("\n", end)
    (tmp_path / "a.conllu").write_bytes(text.encode())
    got = files.read_conllu(spark, str(tmp_path)).orderBy("sent_id").collect()
    assert [(r["sent_id"], r["text"], r["tokens"][0]["upos"]) for r in got] == [(f"P1.u1.s{i}", f"Hola {i}.", "INTJ") for i in (1, 2, 3)]


def test_conllu_sentence_without_id_is_an_error(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# text = Hola.\n1\tHola\thola\tINTJ\n\n", encoding="utf-8")
    with pytest.raises(Exception, match="without sent_id"):
        files.read_conllu(spark, str(tmp_path)).collect()


def test_repeated_store_keeps_one_copy(spark, tmp_path):
    path = str(tmp_path / "predictions")
    schema = "run string, task_label string, method string, speech_id string, y_true string, y_pred string"
    one = spark.createDataFrame([("r", "t", "m+1", "s1", "a", "b")], schema)
    files.append_predictions(one, path)
    files.append_predictions(one, path)  # the run broke off after its predictions and starts again
    files.append_predictions(spark.createDataFrame([("r", "t", "m2", "s1", "a", "a")], schema), path)
    assert {r["method"] for r in files.read_long(spark, path, schema).collect()} == {"m+1", "m2"}
    assert files.read_long(spark, path, schema).count() == 2


def test_results_csv_keeps_parameters(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Method;Best_params;Tot_features;Macro_F1\nA;{C: 1};12;0.5\n", encoding="utf-8")
    row = files.read_results_csv(spark, str(tmp_path / "r.csv")).first()
    assert (row["method"], row["params"], row["n_features"], row["label"], row["value"]) == ("A", "{C: 1}", 12, "Macro_F1", 0.5)


def _plain_reading(data: bytes):
    """``sent_id, text, tags`` of each sentence, by universal line ends."""
    out, block = [], []
    for line in [*data.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n"), ""]:
        if line.strip():
            block.append(line)
        elif block:
            about = dict(x[1:].split("=", 1) for x in block if x.startswith("#"))
            about = {k.strip(): v.strip() for k, v in about.items()}
            out.append((about["sent_id"], about["text"], [x.split("\t")[3] for x in block if not x.startswith("#")]))
            block = []
    return out


def test_mixed_line_ends_over_split_borders(spark, tmp_path):
    ends = ["\n", "\r\n", "\r"]
    lines, n = [], 0
    for i in range(60):
        rows = [f"# sent_id = P.u1.s{i}", f"# text = Frase {'x' * (i % 7)} {i}", *[f"{j + 1}\tw\tw\tT{i}_{j}" for j in range(i % 4 + 1)]]
        for row in [*rows, *[""] * (i % 3 + 1)]:
            end = ends[(n * 7 + i) % 3 if i % 5 else 0]
            # A bare CR before an empty line that ends with LF would be one line end.
            lines.append(row + ("\r" if row == "" and end == "\n" and lines[-1].endswith("\r") else end))
            n += 1
    data = "".join(lines).encode()
    (tmp_path / "a.conllu").write_bytes(data)
    (tmp_path / "b.conllu").write_bytes(b"\xef\xbb\xbf# sent_id = Q.u1.s1\n# text =\n1\tw\tw\tT")
    want = _plain_reading(data)
    assert len(want) == 60
    for size in ("64", "333", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        try:
            got = files.read_conllu(spark, str(tmp_path)).orderBy("file", "block", "line").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [(r["sent_id"], r["text"], [t["upos"] for t in r["tokens"]]) for r in got] == [*want, ("Q.u1.s1", "", ["T"])]


def test_metadata_layouts_quotes_and_short_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"\xef\xbb\xbfID\tSpeaker_name\tSpeaker_birth\r\nx1\t\"Gil, \\\"Ana\\\"\"\t1950\r\n\r\nx2\t\tno\r\n")
    (tmp_path / "b.tsv").write_text("Other\tSpeaker_birth\tID\no\t1960\tx3\textra\no\n", encoding="utf-8")
    (tmp_path / "c.tsv").write_text("ID\n", encoding="utf-8")
    (tmp_path / "d.tsv").write_text("", encoding="utf-8")
    for size in ("16", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.read_metadata(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = sorted(((r["ID"], r["Speaker_name"], r["Speaker_birth"]) for r in rows), key=str)
        assert got == [("x1", 'Gil, "Ana"', 1950), ("x2", None, None), ("x3", None, 1960), (None, None, None)]


def test_metadata_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("", encoding="utf-8")
    assert files.read_metadata(spark, str(tmp_path)).collect() == []
