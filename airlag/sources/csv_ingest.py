"""Monthly CSV files with free-text preambles.

A file holds metadata lines, a header that starts with ``Carrier Code,Date``,
then data rows; without such a header its first line is the header.  Columns
are read by header name, so files may order them differently; short rows are
padded with nulls, quoted fields keep their commas, blank lines are skipped,
and a footer becomes a row of nulls, which ``remove_invalid_rows`` drops later.

Spark has no line numbers, but a line's place is known from its file, the start
of its split and its order in the split.  One row per file holds the place and
the text of the header; the lines are joined to it and those behind it parsed.
Files are split and read in parallel.

A quoted field may hold line breaks (read as line feeds).  Whether a line starts
inside quotes depends on all lines before it, so every line, and every split of a
file, is taken as a map from the state at its start to the state at its end;
these are composed line by line inside a split and split by split inside a file,
and the lines of a record, which may lie in several splits, are put together.
Only files with a line that leaves a quote open go this way.  A quote that is
never closed is no quote over lines: the lines behind it are read one by one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag import schema as S
from airlag.session import cut_lineage, ensure_checkpoint_dir

CSV_OPTIONS = {"mode": "PERMISSIVE", "escape": '"'}


def with_places(text: DataFrame) -> DataFrame:
    """Lines of a text scan with their file and the start of their split."""
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def parse_monthly_lines(lines: DataFrame) -> DataFrame:
    """Lines of ``with_places`` -> typed raw records (bad numbers -> null, empty -> null)."""
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    place = F.struct("_block", "_id")
    here = F.struct(place.alias("at"), F.col("value").alias("line"))
    # one row per file
    heads = cut_lineage(lines.where(F.col("value") != "").groupBy("_file").agg(F.coalesce(
        F.min(F.when(F.col("value").startswith(S.HEADER_PREFIX), here)), F.min(here)).alias("head"),
        F.bool_or(ends_inside(F.col("value"), False)).alias("_opens")), "headers")
    width = heads.agg(F.max(F.size(F.split("head.line", ",")))).first()[0] or len(S.RAW_COLS)
    ddl = ", ".join(f"f{i} STRING" for i in range(width))

    def fields(line):
        row = F.from_csv(line, ddl, CSV_OPTIONS)
        return F.array(*[row[f"f{i}"] for i in range(width)])

    some_open = not heads.where("_opens").isEmpty()
    heads = heads.select("_file", F.col("head.at").alias("_head"), fields(F.col("head.line")).alias("_names"), "_opens")
    rows = lines.join(heads, "_file").where(place > F.col("_head"))
    if some_open:
        spanning = rows.where("_opens").select("_file", "_block", "_id", "value")
        spanning = records_over_lines(spanning).join(heads.select("_file", "_names"), "_file")
        rows = rows.where("not _opens").select("_names", "value").unionByName(spanning.select("_names", "value"))
    rows = rows.where(F.col("value") != "").select("_names", fields(F.col("value")).alias("_fields"))
    at = lambda c: F.array_position("_names", F.lit(S.ORIGINAL_NAMES[c])).cast("int")
    return typed_raw(rows.select(*[F.when(at(c) > 0, F.get("_fields", at(c) - 1)).alias(c) for c in S.RAW_COLS]))


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line that starts inside (or outside) a quoted field ends inside one.

    A quote opens a field only at the field's start, two inside a quoted field
    are a quote, and any other one there closes it."""
    start, plain, quoted, closing = range(4)
    parts = F.split(line, '"')

    def text(state, t):
        return (F.when((t == "") | (state == quoted), state).when(t.endswith(","), F.lit(start)).otherwise(F.lit(plain)))

    def quote(state):
        return (F.when(state == start, F.lit(quoted)).when(state == plain, F.lit(plain))
                .when(state == quoted, F.lit(closing)).otherwise(F.lit(quoted)))

    last = F.aggregate(F.slice(parts, 2, F.size(parts)), text(F.lit(quoted if inside else start), parts[0]),
                       lambda state, t: text(quote(state), t))
    return F.when(line.contains('"'), last == quoted).otherwise(F.lit(inside))


def records_over_lines(lines: DataFrame) -> DataFrame:
    """Lines behind the header (``_file, _block, _id, value``) -> ``_file, value``, a row per record."""
    # a line keeps the state, turns it round, or sets it; what was set last and the turns since give the state
    kinds = lines.withColumns({"_a": ends_inside(F.col("value"), False).cast("int"), "_b": ends_inside(F.col("value"), True).cast("int")})
    inner = Window.partitionBy("_file", "_block").orderBy("_id")  # a split at most
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    kinds = kinds.withColumn("_turns", F.sum(F.when(F.col("_a") > F.col("_b"), 1).otherwise(0)).over(upto) % 2)
    kinds = kinds.withColumn("_set", F.last(F.when(F.col("_a") == F.col("_b"), (F.col("_a") + F.col("_turns")) % 2), True).over(upto))
    kinds = cut_lineage(kinds.drop("_a", "_b"), "quotes")

    outer = Window.partitionBy("_file").orderBy("_block")  # a row per split
    so_far = outer.rowsBetween(Window.unboundedPreceding, 0)
    splits = kinds.groupBy("_file", "_block").agg(F.max_by("_turns", "_id").alias("t"), F.max_by("_set", "_id").alias("s"))
    splits = splits.withColumn("all", F.sum("t").over(so_far) % 2)
    splits = splits.withColumn("s", F.last(F.when(F.col("s").isNotNull(), (F.col("s") + F.col("t") + F.col("all")) % 2), True).over(so_far))
    splits = splits.withColumn("after", (F.coalesce("s", F.lit(0)) + F.col("all")) % 2)
    splits = splits.select("_file", "_block", F.lag("after", 1, 0).over(outer).alias("_from"), "after")
    splits = cut_lineage(splits, "splits")

    state = kinds.join(splits.drop("after"), ["_file", "_block"])
    state = state.withColumn("_after", (F.coalesce("_set", "_from") + F.col("_turns")) % 2)
    state = state.withColumn("_before", F.coalesce(F.lag("_after").over(inner), "_from"))
    state = state.withColumn("_own", F.last(F.when(F.col("_before") == 0, F.struct("_block", "_id")), True).over(upto))
    state = cut_lineage(state.select("_file", "_block", "_id", "value", "_before", "_after", "_own"), "states")
    # a record may have started in an earlier split; the last one of a file may have no end
    begun = state.groupBy("_file", "_block").agg(F.max("_own").alias("_own"))
    begun = begun.select("_file", "_block", F.max("_own").over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    ends = splits.groupBy("_file").agg(F.max_by("after", "_block").alias("_open")).join(
        state.groupBy("_file").agg(F.max("_own").alias("_last")), "_file")
    whole = (F.col("_before") == 0) & (F.col("_after") == 0)
    parts = state.where(~whole).join(begun, ["_file", "_block"]).join(ends, "_file").withColumn("_record", F.coalesce("_own", "_earlier"))
    parts = parts.withColumn("_record", F.when((F.col("_open") == 1) & (F.col("_record") == F.col("_last")), F.struct("_block", "_id"))
                             .otherwise(F.col("_record")))
    joined = parts.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))).alias("_lines"))
    return state.where(whole).select("_file", "value").unionByName(
        joined.select("_file", F.array_join(F.transform("_lines", lambda r: r["value"]), "\n").alias("value")))


def typed_raw(df: DataFrame) -> DataFrame:
    exprs = []
    for f in S.RAW_SCHEMA.fields:
        c = F.col(f.name)
        c = F.when(F.trim(c) != "", c)           # empty field -> null
        if f.dataType.typeName() != "string":
            c = c.try_cast(f.dataType)
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def combine_monthly_csv(spark: SparkSession, path: str) -> DataFrame:
    """All monthly files under ``path`` as one frame of raw records."""
    return parse_monthly_lines(with_places(spark.read.text(path)))


def load_typed(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """Header CSV with the explicit raw schema (no inference); ``nrows``
    keeps the first rows of the scan order."""
    df = spark.read.schema(S.RAW_SCHEMA).option("header", True).option("mode", "PERMISSIVE") \
        .csv(path)
    return df.limit(nrows) if nrows is not None else df


# ----------------------------------------------------------- writing months

def write_monthly_csv(raw: DataFrame, path: str, preamble_lines: int = 3, parts: int = 1) -> str:
    """Write raw records as text files ``y=/m=/part=``, each with its preamble
    (none in even months) and header on top.  ``parts`` spreads a month over so
    many files; the records are evaluated once."""
    line = F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in S.RAW_COLS]), {"escape": '"'})
    lines = cut_lineage(raw.select(
        line.alias("value"), F.substring("date_mdy", 7, 4).alias("y"), F.substring("date_mdy", 1, 2).alias("m"),
        F.pmod(F.xxhash64(*S.RAW_COLS), F.lit(parts)).alias("part"), F.lit(2).alias("_order")), "months")
    files = lines.select("y", "m", "part").distinct()
    header = ",".join(S.ORIGINAL_NAMES[c] for c in S.RAW_COLS)
    pre = files.where(F.col("m").cast("int") % 2 == 1).select(
        F.concat(F.lit("Report period "), F.col("y"), F.lit("-"), F.col("m"), F.lit(" on-time data")).alias("value"),
        "y", "m", "part", F.explode(F.array_repeat(F.lit(0), preamble_lines)).alias("_order"))
    head = files.select(F.lit(header).alias("value"), "y", "m", "part", F.lit(1).alias("_order"))
    out = pre.unionByName(head).unionByName(lines).repartition("y", "m", "part").sortWithinPartitions("y", "m", "part", "_order")
    out.drop("_order").write.mode("overwrite").partitionBy("y", "m", "part").text(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder under the session's (shared) checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
