"""Fixed-size grids: padding, masks, and permutations of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD_CELL = "1"
PAD_INDEX = -1


def pad_grid(cells: DataFrame, sizes: DataFrame, max_row: int, max_col: int, pad: str = PAD_CELL) -> DataFrame:
    """Each table on a max_row x max_col grid with a 0/1 mask of its real cells.

    cells(table_id, row_pos from 0, col_pos from 0, value) fill the rectangle that sizes(table_id, n_rows,
    n_cols) gives, so the padding is made from the sizes alone: no join and no shuffle.
    """
    real = cells.where((F.col("row_pos") < max_row) & (F.col("col_pos") < max_col)).select(
        "table_id", "row_pos", "col_pos", "value", F.lit(1).alias("mask")
    )
    grid = (
        sizes.withColumn("row_pos", F.explode(F.sequence(F.lit(0), F.lit(max_row - 1))))
        .withColumn("col_pos", F.explode(F.sequence(F.lit(0), F.lit(max_col - 1))))
        .where((F.col("row_pos") >= F.col("n_rows")) | (F.col("col_pos") >= F.col("n_cols")))
    )
    return real.unionByName(grid.select("table_id", "row_pos", "col_pos", F.lit(pad).alias("value"), F.lit(0).alias("mask")))


def select_masked(df: DataFrame) -> DataFrame:
    return df.where("mask = 1")


def permutation_arrays(permuted: DataFrame) -> DataFrame:
    """One array of source columns per table, in permuted order (a table's columns are few)."""
    arrays = permuted.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("pos", "src_idx"))).alias("p"))
    return arrays.select("table_id", F.transform("p", lambda x: x["src_idx"]).alias("perm"))


def pad_permutation(perm: str | Column, max_col: int) -> Column:
    """Fill a permutation up to max_col with -1."""
    p = F.col(perm) if isinstance(perm, str) else perm
    return F.concat(p, F.array_repeat(F.lit(PAD_INDEX), F.lit(max_col) - F.size(p)))


def resolve_padding(perm: str | Column) -> Column:
    """Each -1 becomes its own position."""
    p = F.col(perm) if isinstance(perm, str) else perm
    return F.transform(p, lambda x, i: F.when(x < 0, i).otherwise(x))


def align_permuted_columns(columns: DataFrame, permuted: DataFrame) -> DataFrame:
    """Column data in permuted order: row `pos` carries the data of column `src_idx`."""
    src = permuted.withColumnRenamed("src_idx", "col_idx")
    return columns.join(src, ["table_id", "col_idx"])


def row_padding_mask(n_rows: str | Column, max_row: int) -> Column:
    """True at row positions past the table's last row."""
    n = F.col(n_rows) if isinstance(n_rows, str) else n_rows
    return F.transform(F.sequence(F.lit(0), F.lit(max_row - 1)), lambda r: r >= n)


def _pair_counts(grid: DataFrame, line: str, item: str) -> DataFrame:
    """How many lines of a table hold both of two items.

    Lines with the same set of items are counted first.  The distinct sets of a table, which a padded grid bounds, meet in
    one row, where the counts of an item's pairs are added up: pairs are only ever given out, and none is grouped.
    """
    lines = select_masked(grid).groupBy("table_id", line).agg(F.array_sort(F.collect_set(item)).alias("items"))
    sets = lines.groupBy("table_id", "items").agg(F.count(F.lit(1)).alias("w"))
    tables = sets.groupBy("table_id").agg(F.collect_list(F.struct("w", "items")).alias("sets"))
    tables = tables.select("table_id", "sets", F.array_distinct(F.flatten(F.transform("sets", lambda s: s["items"]))).alias("all"))
    # per set its number of lines at the place of each of its items, and 0 at those of the others
    weights = F.transform("sets", lambda s: F.transform("all", lambda x: F.when(F.array_contains(s["items"], x), s["w"]).otherwise(F.lit(0).cast("bigint"))))
    rows = tables.select("table_id", "all", weights.alias("weights"), F.posexplode("all").alias("at", "a"))
    own = F.filter("weights", lambda w: F.get(w, F.col("at")) > 0)
    rows = rows.select("table_id", "all", "a", own.alias("own"))
    total = F.transform("all", lambda b, k: F.struct(b.alias("b"), F.aggregate("own", F.lit(0).cast("bigint"), lambda n, w: n + F.get(w, k)).alias("n_joint")))
    return rows.select("table_id", "a", F.inline(total)).where("n_joint > 0")


def pair_masks(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jointly valid cells for each pair of columns, and for each pair of rows, of a padded grid."""
    return _pair_counts(grid, "row_pos", "col_pos"), _pair_counts(grid, "col_pos", "row_pos")
