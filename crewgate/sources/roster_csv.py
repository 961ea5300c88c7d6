"""Raw roster CSV (S2, S3) and the cleaned CSV writer (K2).

Format: ';' separator, UTF-8, '"' quotes (doubled inside a field), two
header records at the top of *every* file, then seven positional fields;
missing ones read as NULL, and the text of a record with fewer or more fields
is kept whole in ``odd_record``.

With ``multi_line=True`` quoted newlines are allowed, and large files still split:
the state of the quotes is carried over the byte ranges (``_records``).  With
``multi_line=False`` every line is a record; header records are then found without a
per-file window: inside one file split the records carry consecutive
``monotonically_increasing_id`` values, so the record number within the split is the
id minus the smallest id of that (file, split) pair — a small aggregate (one row per
split) joined back — and only the split that starts at byte 0 holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewgate.schema import RAW_ODD, RAW_ROSTER
from crewgate.session import ensure_checkpoint_dir

HEADER_RECORDS = 2
RAW_FIELDS = [f.name for f in RAW_ROSTER.fields]


def read_roster_csv(spark: SparkSession, path: str, multi_line: bool = True,
                    header_records: int = HEADER_RECORDS,
                    materialize: bool = True) -> DataFrame:
    """Data records of every CSV file under ``path`` as f0..f6 text
    (NULL for absent fields) and ``odd_record``, with ``file``, ``block`` and ``record``
    (0-based record number in its file, or in its split with ``multi_line=False``; header
    records removed).  Blank lines between records do not count.

    With ``multi_line`` (quoted newlines allowed) the files are read in byte ranges all
    the same: see ``_records``.  With ``materialize`` the lines are checkpointed once (to
    the shared checkpoint folder), and the numbering and every later use (names, rows,
    ids of a load) read that copy instead of the files again.
    """
    if multi_line:
        records = _records(spark, path, materialize)
        return records.where(F.col("record") >= header_records).select(
            F.from_csv("_text", ", ".join(f"{c} string" for c in RAW_FIELDS), {
                "sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
                "columnNameOfCorruptRecord": RAW_ODD}).alias("_r"),
            "file", "block", "record").select("_r.*", "file", "block", "record")
    src = (spark.read.schema(RAW_ROSTER)
           .option("sep", ";").option("quote", '"').option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_ODD)
           .option("encoding", "UTF-8").option("recursiveFileLookup", "true")
           .csv(path))
    raw = (src.select(*RAW_FIELDS,
                   F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_mid")))
    if materialize:
        ensure_checkpoint_dir(spark)
        raw = raw.checkpoint(eager=True)
    starts = raw.groupBy("file", "_block").agg(F.min("_mid").alias("_first"))
    numbered = raw.join(starts, ["file", "_block"]) \
                  .withColumn("record", F.col("_mid") - F.col("_first"))
    return (numbered.where((F.col("_block") > 0) | (F.col("record") >= header_records))
                    .select(*RAW_FIELDS, "file", "_block", "record")
                    .withColumnRenamed("_block", "block"))


def _open_after(line, inside: bool) -> F.Column:
    """Whether a quoted field is open at the end of ``line``, if one is open at its
    start or not.

    The quotes of a line are taken one by one with the text before each.  Outside, a
    quote opens a field only where the field starts; inside, it closes the field unless
    another one follows at once; any other quote is text.
    """
    start, outside, within, closing = 0, 1, 2, 3

    def step(state, before):
        opens = F.when(before.endswith(";"), F.lit(within)).otherwise(F.lit(outside))
        again = F.when(before == "", F.lit(within)).otherwise(opens)
        return F.when(state == within, F.lit(closing)).when(
            state == outside, opens).otherwise(again)

    before = F.split(line, '"')
    before = F.slice(before, F.lit(1), F.size(before) - 1)
    end = F.aggregate(before, F.lit(within if inside else start), step)
    return F.when(F.instr(line, '"') == 0, F.lit(inside)).otherwise(end == within)


def _records(spark: SparkSession, path: str, materialize: bool) -> DataFrame:
    """(file, block, record, _text): the records of all files, cut at the newlines that
    no quoted field holds.

    Lines come from Spark's text reader, many splits a file.  Whether a field is open
    at a line's start depends on all lines before; each line maps that state to the
    next one's.  Such a map keeps the state, turns it round, or sets it, so the state
    at a line is what the last setting line in the split left, turned as often as
    lines since do.  One row per split holds the split's own map and its number of
    records from either state; running over them gives the state and the record number
    at the start of every split.  Only records of several lines are shuffled.
    """
    ensure_checkpoint_dir(spark)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path) \
        .select(F.regexp_replace("value", "\\r$", "").alias("_line"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_mid")) \
        .withColumn("_if_out", _open_after(F.col("_line"), False)) \
        .withColumn("_if_in", _open_after(F.col("_line"), True))
    if materialize:
        lines = lines.checkpoint(eager=True)
    split = Window.partitionBy("file", "_block").orderBy("_mid")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("_if_out") == F.col("_if_in")
    turns = F.when(F.col("_if_out") & ~F.col("_if_in"), 1).otherwise(0)
    lines = lines.withColumn("_turns", F.coalesce(F.sum(turns).over(before), F.lit(0))) \
        .withColumn("_set", F.last(F.when(sets, F.struct(
            F.col("_if_out").alias("open"), F.col("_turns").alias("turns"))), True).over(before))
    # the state at the line's start, from either state at the split's start
    odd = lambda n: n % 2 == 1
    since = F.col("_turns") - F.col("_set.turns")

    def state(at_start: bool):
        return F.when(F.col("_set").isNull(), F.lit(at_start) != odd(F.col("_turns"))) \
                .otherwise(F.col("_set.open") != odd(since))

    def after(s):
        return F.when(s, F.col("_if_in")).otherwise(F.col("_if_out"))

    lines = lines.withColumn("_s_out", state(False)).withColumn("_s_in", state(True))
    first = lambda s: (~s & (F.col("_line") != "")).cast("long")
    lines = lines.withColumn("_n_out", F.coalesce(F.sum(first(F.col("_s_out"))).over(before), F.lit(0))) \
                 .withColumn("_n_in", F.coalesce(F.sum(first(F.col("_s_in"))).over(before), F.lit(0)))
    splits = lines.groupBy("file", "_block").agg(
        F.max_by(after(F.col("_s_out")), "_mid").alias("_to_out"),
        F.max_by(after(F.col("_s_in")), "_mid").alias("_to_in"),
        F.sum(first(F.col("_s_out"))).alias("_r_out"), F.sum(first(F.col("_s_in"))).alias("_r_in"))
    starts = splits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(
        "_block", "_to_out", "_to_in", "_r_out", "_r_in"))).alias("_all")).select(
        "file", F.inline(_run_over("_all")))        # one row per split of a file
    placed = lines.join(starts, ["file", "_block"])
    here = F.when(F.col("_open"), F.col("_s_in")).otherwise(F.col("_s_out"))
    count = F.when(F.col("_open"), F.col("_n_in")).otherwise(F.col("_n_out"))
    placed = placed.withColumn("_inside", here).withColumn("_ends_inside", after(here)) \
        .withColumn("record", F.col("_records") + count - F.col("_inside").cast("long"))
    placed = placed.where(F.col("_inside") | (F.col("_line") != ""))
    whole = ~F.col("_inside") & ~F.col("_ends_inside")
    several = placed.where(~whole).groupBy("file", "record").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_block", "_mid", "_line"))), lambda x: x["_line"]),
        "\n").alias("_text"))
    one = placed.where(whole).select("file", "record", F.col("_line").alias("_text"))
    return one.unionByName(several).withColumn("block", F.lit(0).cast("long"))


def _run_over(splits: str) -> F.Column:
    """State and record number at the start of every split of a file, in order."""
    start = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("records"), F.array().cast(
        "array<struct<_block:bigint,_open:boolean,_records:bigint>>").alias("out"))

    def step(at, s):
        return F.struct(
            F.when(at["open"], s["_to_in"]).otherwise(s["_to_out"]).alias("open"),
            (at["records"] + F.when(at["open"], s["_r_in"]).otherwise(s["_r_out"])).alias("records"),
            F.concat(at["out"], F.array(F.struct(
                s["_block"].alias("_block"), at["open"].alias("_open"),
                at["records"].alias("_records")))).alias("out"))
    return F.aggregate(splits, start, step, lambda at: at["out"])


CLEAN_FIELDS = ["company_name", "given_name", "surname", "note", "expiry_text",
                "issued_mark", "valid_mark"]


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``write_clean_csv``; an empty field reads as ''."""
    schema = ", ".join(f"{c} string" for c in CLEAN_FIELDS)
    return (spark.read.schema(schema).option("sep", ";").option("multiLine", "true")
            .option("quote", '"').option("escape", '"').csv(path).na.fill(""))


def write_clean_csv(df: DataFrame, path: str) -> None:
    """K2: the seven cleaned fields, ';' separated, no header."""
    df.select(*CLEAN_FIELDS).write.mode("error").option("sep", ";").option("quote", '"') \
      .option("escape", '"').csv(path)


def csv_field(c) -> F.Column:
    """Quote a text field for ';' CSV when it holds ';', '"' or a newline."""
    c = F.coalesce(c, F.lit(""))
    needs = c.rlike('[;"\\r\\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))) \
            .otherwise(c)
