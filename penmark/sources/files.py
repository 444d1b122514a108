"""Readers and writers: speech metadata, annotated sentences, speech tables, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from penmark.functions import text as tx

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("Speaker_name", T.StringType()),
        T.StructField("Speaker_role", T.StringType()),
        T.StructField("Speaker_party", T.StringType()),
        T.StructField("Speaker_gender", T.StringType()),
        T.StructField("Speaker_birth", T.IntegerType()),
        T.StructField("Party_status", T.StringType()),
    ]
)


def _lines(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Every line of the files with its place: ``file``, ``start`` of the split, ``line`` rising within a split.

    Any mix of line ends is read; a byte order mark before the first line is dropped.
    """
    value = F.col("value")
    return spark.read.text(folder, pathGlobFilter=suffix).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.when(value.startswith("\ufeff"), F.substring(value, F.lit(2), F.length(value))).otherwise(value).alias("value"),
    )


def read_metadata(spark: SparkSession, folder: str, suffix: str = "*.tsv") -> DataFrame:
    """All ``.tsv`` files of a folder, united by column name.

    The header of each file is joined to its lines, so files that order or omit columns differently
    are read together; only the largest number of columns comes to the driver. Cells beyond the
    header and columns of other names are left out, missing ones are null.
    """
    lines = _lines(spark, folder, suffix).where("value <> ''")
    # Only the first line of a file is its header.
    first = F.min(F.when(F.col("start") == 0, F.struct("line", "value"))).alias("first")
    heads = lines.groupBy("file").agg(first).select("file", F.col("first.line").alias("head_line"), F.col("first.value").alias("head"))
    width = heads.agg(F.max(F.size(F.split("head", "\t")))).first()[0] or 1
    layout = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda c: F.from_csv(c, layout, {"sep": "\t"})
    listed = lambda c: F.array(*[F.col(f"{c}.c{i}") for i in range(width)])
    heads = heads.withColumn("h", cells("head")).select("file", "head_line", listed("h").alias("names"))
    rows = lines.join(heads, "file").where("line <> head_line").withColumn("v", cells("value")).select("names", listed("v").alias("cells"))
    place = lambda f: F.get("cells", F.coalesce(F.array_position("names", f.name), F.lit(0)).cast("int") - 1)
    return rows.select(*[place(f).try_cast(f.dataType).alias(f.name) for f in METADATA_SCHEMA])


def _blocks(lines: DataFrame) -> DataFrame:
    """``file, block, line, value``: lines between blank ones, joined by ``\\n``, with the place of the first.

    The running count of blank lines numbers the blocks of a split; the blank lines of the splits
    before it shift the numbers, so a block that runs over a border is one.
    """
    lines = lines.withColumn("blank", F.col("value").rlike(r"^\s*$"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "start").agg(F.sum(F.col("blank").cast("long")).alias("n"))
    shifts = splits.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    running = F.sum(F.col("blank").cast("long")).over(Window.partitionBy("file", "start").orderBy("line"))
    numbered = lines.withColumn("k", running).where("NOT blank").join(shifts, ["file", "start"])
    blocks = numbered.groupBy("file", (F.col("k") + F.col("shift")).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("start", "line", "value"))).alias("rows")
    )
    return blocks.select(
        "file", F.col("rows")[0]["start"].alias("block"), F.col("rows")[0]["line"].alias("line"), F.array_join("rows.value", "\n").alias("value")
    )


def read_conllu(spark: SparkSession, folder: str, suffix: str = "*.conllu") -> DataFrame:
    """One row per sentence block of every ``.conllu`` file, with any mix of line ends.

    ``file, block, line`` order the sentences as they stand in the files, also
    when a large file is read in several splits. A block with tokens but without
    ``sent_id`` ends the read with an error.
    """
    blocks = _blocks(_lines(spark, folder, suffix))
    rows = F.filter(F.split("value", "\n"), lambda s: (s != "") & ~s.startswith("#"))
    fields = F.transform(rows, lambda s: F.split(s, "\t"))
    token = lambda f: F.struct(
        F.get(f, F.lit(0)).alias("id"),
        F.get(f, F.lit(1)).alias("form"),
        F.get(f, F.lit(2)).alias("lemma"),
        F.get(f, F.lit(3)).alias("upos"),
    )
    sent_id = F.regexp_extract("value", r"(?m)^#[ \t]*sent_id[ \t]*=[ \t]*(.*?)[ \t]*$", 1)
    lost = (sent_id == "") & (F.size(rows) > 0)
    sent_id = F.when(lost, F.raise_error(F.concat(F.lit("a sentence without sent_id in "), "file"))).otherwise(sent_id)
    return (
        blocks.select(
            "file", "block", "line",
            sent_id.alias("sent_id"),
            F.regexp_extract("value", r"(?m)^#[ \t]*text[ \t]*=[ \t]*(.*)$", 1).alias("text"),
            F.transform(fields, token).alias("tokens"),
        )
        .where(F.col("sent_id") != "")
        .withColumn("utterance_id", tx.utterance_id("sent_id"))
    )


def assemble_utterances(sentences: DataFrame, order: list[str]) -> DataFrame:
    """Sentences to one cleaned text and one tag string per utterance, in order.

    All-uppercase sentences (calls from the public) are dropped. ``upos`` is the
    blank-joined tag string of a sentence; it may be absent.
    """
    has_tags = "upos" in sentences.columns
    tags = F.col("upos") if has_tags else F.lit(None).cast("string")
    rows = sentences.where(~tx.all_uppercase("text")).select(
        "utterance_id",
        F.struct(*order, tx.clean_es("text").alias("text"), tags.alias("tags")).alias("s"),
    )
    joined = rows.groupBy("utterance_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    out = [
        F.col("utterance_id"),
        F.array_join(F.col("s.text"), " ").alias("text"),
    ]
    if has_tags:
        out.append(F.array_join(F.col("s.tags"), " ").alias("pos_tags"))
    return joined.select(*out)


def speech_table(metadata: DataFrame, sentences: DataFrame) -> DataFrame:
    """Metadata with the text and tags of its sentences; no sentence means empty text."""
    tagged = sentences.withColumn("upos", F.array_join(F.col("tokens.upos"), " "))
    texts = assemble_utterances(tagged, ["file", "block", "line"]).withColumnRenamed("utterance_id", "ID")
    return metadata.join(texts, "ID", "left").select(
        F.col("ID").alias("speech_id"),
        F.col("Speaker_name").alias("speaker"),
        F.col("Speaker_role").alias("role"),
        F.col("Speaker_party").alias("party"),
        F.col("Speaker_gender").alias("gender"),
        F.col("Speaker_birth").alias("birth"),
        F.col("Party_status").alias("party_status"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("pos_tags", F.lit("")).alias("pos_tags"),
    )


def unknown_utterances(metadata: DataFrame, sentences: DataFrame) -> DataFrame:
    """Utterance ids of kept sentences that no metadata row names; callers fail when any exist."""
    ids = sentences.where(~tx.all_uppercase("text")).select("utterance_id").distinct()
    return ids.join(metadata.select(F.col("ID").alias("utterance_id")), "utterance_id", "left_anti")


def write_speeches(speeches: DataFrame, path: str, tsv: bool = False) -> None:
    if tsv:
        speeches.write.mode("overwrite").csv(path, sep="\t", header=True)
    else:
        speeches.write.mode("overwrite").parquet(path)


def read_or_build_speeches(spark: SparkSession, path: str, corpus_folder: str) -> DataFrame:
    """Read the stored speech table; build and store it first when it is missing."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    metadata, sentences = read_metadata(spark, corpus_folder), read_conllu(spark, corpus_folder)
    lost = unknown_utterances(metadata, sentences).count()
    if lost:
        raise ValueError(f"{lost} utterances have no metadata row")
    write_speeches(speech_table(metadata, sentences), path)
    return spark.read.parquet(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """Wide result view as ``;`` CSV."""
    results.write.mode("overwrite").csv(path, sep=";", header=True)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """``;`` CSV of results to long rows ``method, params, n_features, label, value``.

    ``Best_params`` and ``Tot_features`` are null where the file has no such column.
    """
    wide = spark.read.csv(path, sep=";", header=True)
    method = wide.columns[0]
    extra = {"Best_params": ("params", "string"), "Tot_features": ("n_features", "int")}
    metrics = [c for c in wide.columns[1:] if c not in extra]
    about = [
        (F.col(c) if c in wide.columns else F.lit(None)).cast(kind).alias(name) for c, (name, kind) in extra.items()
    ]
    return (
        wide.select(F.col(method).alias("method"), *about, *[F.col(f"`{c}`").cast("double").alias(c) for c in metrics])
        .unpivot(["method", "params", "n_features"], metrics, "label", "value")
    )


def append_results(results: DataFrame, path: str) -> None:
    """Store long result rows ``run, method, label, metric, value, params, n_features``."""
    _store(results, path)


def _store(rows: DataFrame, path: str) -> None:
    """Replace the rows of each ``(run, method)`` at hand, so that a repeated write changes nothing."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run", "method").parquet(path)


def read_long(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored long table, or an empty one of the same schema when nothing is stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Store long rows ``run, task_label, method, speech_id, y_true, y_pred``."""
    _store(predictions.withColumn("speech_id", F.col("speech_id").cast("string")), path)


def todo_methods(feature_sets: DataFrame, results: DataFrame, run: str) -> DataFrame:
    """Feature sets whose method has no result row in this run yet."""
    done = results.where(F.col("run") == run).select("method").distinct()
    return feature_sets.join(done, "method", "left_anti")
