"""Records of text files of any size, each file read by as many tasks as it has splits.

What a split does to the reader's state (inside quotes or not, depth of braces) is a function of the state at its
start.  Splits are summed up by that function; a scan over the summaries, a row per split, composes them and gives each
split its start.  Only records that do not end where they begin, in their piece, are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.operators.joins import join_small
from cellweft.session import evaluated_once

SPLIT = ["path", "file_start"]
# all fields of a line that begins outside quotes, and a last one whose quote stays open
_OPENS = '^(?:"[^"]*+(?:""[^"]*+)*+",|[^",][^,]*+,|,)*+"[^"]*+(?:""[^"]*+)*+$'
# the same of a line that begins inside quotes
_GOES_ON = '^[^"]*+(?:""[^"]*+)*+(?:$|",(?:"[^"]*+(?:""[^"]*+)*+",|[^",][^,]*+,|,)*+"[^"]*+(?:""[^"]*+)*+$)'


def read_pieces(spark: SparkSession, root: str, glob: str | None = None, separator: str | None = None) -> DataFrame:
    """path, file_start, line_id, value: the pieces of all files between separators, lines where none is given.

    A reader numbers the pieces of a split in file order, so (file_start, line_id) is the order in a file.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    reader = reader.option("lineSep", separator) if separator else reader
    return reader.text(root).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("file_start"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )


def _in_split() -> tuple:
    order = Window.partitionBy(*SPLIT).orderBy("line_id")
    return order, order.rowsBetween(Window.unboundedPreceding, 0)


def _with_states(rows: DataFrame, opens: str, goes_on: str, so_far, names: tuple[str, str]) -> DataFrame:
    """Adds the states after all rows so far, for a start in state 0 and for one in state 1.

    A row's function gives `opens` for state 0 and `goes_on` for state 1.  Where both agree the state is settled
    whatever came before; other rows keep it or turn it round.
    """
    rows = rows.withColumn("_turns", F.sum((F.col(opens) > F.col(goes_on)).cast("int")).over(so_far))
    settled = F.when(F.col(opens) == F.col(goes_on), F.struct(F.col(opens).alias("to"), F.col("_turns").alias("at")))
    rows = rows.withColumn("_known", F.last(settled, ignorenulls=True).over(so_far))
    left = (F.coalesce(F.col("_known.to"), F.lit(0)) + F.col("_turns") - F.coalesce(F.col("_known.at"), F.lit(0))) % 2
    return rows.withColumns({names[0]: left, names[1]: F.when(F.col("_known").isNull(), 1 - left).otherwise(left)}).drop("_turns", "_known")


def _with_record(rows: DataFrame) -> DataFrame:
    """Adds `record`, the split a row's record began in and its number there, from `fresh`: does a record begin in the row?"""
    _, so_far = _in_split()
    rows = rows.withColumn("_nth", F.sum(F.col("fresh").cast("int")).over(so_far))
    own = F.struct(F.col("file_start").alias("split"), F.col("_nth").alias("nth"))
    last = rows.groupBy(*SPLIT).agg(F.max("_nth").alias("_nth"))
    earlier = Window.partitionBy("path").orderBy("file_start").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*SPLIT, F.last(F.when(F.col("_nth") > 0, own), ignorenulls=True).over(earlier).alias("_carried"))
    return join_small(rows, carried, SPLIT).withColumn("record", F.when(F.col("_nth") > 0, own).otherwise(F.col("_carried"))).drop("_nth", "_carried")


def _joined(parts: DataFrame, between: str) -> DataFrame:
    """path, file_start, line_id, value of the records whose rows are given."""
    rows = F.array_sort(F.collect_list(F.struct("file_start", "line_id", "value")))
    found = parts.groupBy("path", "record").agg(rows.alias("l"))
    first = F.col("l")[0]
    return found.select("path", first["file_start"].alias("file_start"), first["line_id"].alias("line_id"), F.array_join("l.value", between).alias("value"))


def csv_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, open files): lines put together where a line break stands inside quotes.

    A quote inside an unquoted field is text.  Files without quoted line breaks are passed on as they are.  A file
    whose last quote is never closed is listed; the record that it would leave open is not put together.
    """
    opens, goes_on = F.rlike("value", F.lit(_OPENS)).cast("int"), F.rlike("value", F.lit(_GOES_ON)).cast("int")
    marked = lines.withColumn("opens", opens).withColumn("goes_on", goes_on)
    broken = marked.groupBy("path").agg(F.max("opens").alias("any")).where("any = 1").select("path")
    broken = evaluated_once(broken, "broken")
    order, so_far = _in_split()
    within = _with_states(marked.join(broken, "path", "left_semi"), "opens", "goes_on", so_far, ("from_0", "from_1"))
    within = evaluated_once(within.drop("opens", "goes_on"), "quotes")
    ends = within.groupBy(*SPLIT).agg(F.max_by(F.struct("from_0", "from_1"), "line_id").alias("e")).select(*SPLIT, "e.*")
    files = Window.partitionBy("path").orderBy("file_start")
    after = _with_states(ends, "from_0", "from_1", files.rowsBetween(Window.unboundedPreceding, 0), ("after", "_other"))
    starts = after.select(*SPLIT, F.coalesce(F.lag("after").over(files), F.lit(0)).alias("start"))
    open_files = after.groupBy("path").agg(F.max_by("after", "file_start").alias("after")).where("after = 1").select("path")
    left = F.when(F.col("start") == 0, F.col("from_0")).otherwise(F.col("from_1"))
    within = join_small(within, starts, SPLIT).withColumn("left_open", left)
    within = _with_record(within.withColumn("fresh", F.coalesce(F.lag("left_open").over(order), F.col("start")) == 0))
    alone = F.col("fresh") & (F.col("left_open") == 0)
    names = [*SPLIT, "line_id", "value"]
    parts = within.where(~alone).join(open_files, "path", "left_anti")
    whole = marked.join(broken, "path", "left_anti").select(*names)
    return whole.unionByName(within.where(alone).select(*names)).unionByName(_joined(parts, "\n").select(*names)), open_files


def json_objects(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, file_start, line_id, value: the text of each outermost object of JSON files, whether in one list, one to a line or alone.

    Files are cut at closing braces, in texts or not, and these pieces are what splits consist of; so a list on one line is
    read by many tasks, too.
    """
    pieces = read_pieces(spark, root, glob, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    outside = lambda text: F.regexp_replace(text, '(?s)"[^"]*("|$)', "")
    count = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("bigint")
    order, so_far = _in_split()
    rows = pieces.withColumns(
        # quotes turn the state round; braces count outside of texts, so they depend on the state before the piece
        {"turns": count(plain, '"') % 2, "opens_0": count(outside(plain), "{"), "opens_1": count(outside(F.concat(F.lit('"'), plain)), "{")}
    )
    rows = rows.withColumn("turned", F.sum("turns").over(so_far) % 2)

    def change(start: int) -> Column:
        before, after = (F.col("turned") - F.col("turns") + 2 + start) % 2, (F.col("turned") + start) % 2
        return F.when(before == 0, F.col("opens_0")).otherwise(F.col("opens_1")) - (after == 0).cast("int")

    rows = rows.withColumns({f"deeper_{s}": F.sum(change(s)).over(so_far) for s in (0, 1)})
    rows = evaluated_once(rows.drop("turns", "opens_0", "opens_1"), "braces")
    ends = rows.groupBy(*SPLIT).agg(F.max_by(F.struct("turned", "deeper_0", "deeper_1"), "line_id").alias("e")).select(*SPLIT, "e.*")
    earlier = Window.partitionBy("path").orderBy("file_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("inside", F.coalesce(F.sum("turned").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("inside") == 0, F.col("deeper_0")).otherwise(F.col("deeper_1"))
    starts = starts.withColumn("start", F.coalesce(F.sum(own).over(earlier), F.lit(0))).select(*SPLIT, "inside", "start")
    depth = F.col("start") + F.when(F.col("inside") == 0, F.col("deeper_0")).otherwise(F.col("deeper_1"))
    rows = join_small(rows, starts, SPLIT).withColumn("depth", depth)
    rows = _with_record(rows.withColumn("fresh", F.coalesce(F.lag("depth").over(order), F.col("start")) == 0))
    alone = F.col("fresh") & (F.col("depth") == 0)
    names = [*SPLIT, "line_id", "value"]
    # what follows the last object of a file goes below depth 0
    found = rows.where(alone).select(*names).unionByName(_joined(rows.where(~alone & (F.col("depth") >= 0)), "}").select(*names))
    return found.withColumn("value", F.concat(F.regexp_replace("value", r"^[^{]*", ""), F.lit("}")))
