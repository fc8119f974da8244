"""Global numbering, top-k and paging without gathering the rows in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import parts_of, scratch_path, settle, settle_compact, write_compact

# Up to this many rows a single task may hold and sort the head of a table.
HEAD_ROWS = 100_000

# Rows that give the bounds of a histogram, and the ranges they cut a table into.
PROBE_ROWS = 1024
RANGES = 16

# Beyond this many rows a few passes over two columns cost less than sorting the table.
RANGED_ROWS = 10_000_000

_ROW_BITS = (1 << 33) - 1


def with_ordinal(
    df: DataFrame, order: list[Column], name: str = "ordinal", keep: list[str] | None = None
) -> DataFrame:
    """Number all rows 1..n in a total order; ``keep`` names the columns still wanted."""
    return number_sorted(df.orderBy(*order), name, keep)


def number_sorted(
    df: DataFrame, name: str = "ordinal", keep: list[str] | None = None
) -> DataFrame:
    """Number the rows of a sorted result 1..n as they come.

    The range-sorted rows are settled with their partition number and their place in it; the only
    rows that meet in one task are the partition counts, one per partition.
    """
    keep = df.columns if keep is None else keep
    return _counted(settle(_placed(df.select(*keep), 0)), name)


def number_by(
    df: DataFrame, keys: list[str], name: str = "ordinal", stored: bool = False
) -> DataFrame:
    """Number all rows 1..n in ascending order of some columns, nulls first, equal ones as they lie.

    The rows are settled as they lie, then sorted and settled range by range, so that no more than the
    shuffle of a range lies on disk. The bounds of the ranges are rows of the table itself. Rows that
    are ``stored`` already, in a table that stays as it is, are read from there, equal ones in no order.
    """
    ties = [] if stored else ["_lies"]
    rows = df if stored else settle_compact(df.withColumn("_lies", F.monotonically_increasing_id()))
    parts, path = parts_of(rows), scratch_path(df.sparkSession, "settled")
    for number, inside in enumerate(_ranges(rows, keys, parts)):
        placed = _placed(rows.filter(inside).orderBy(*keys, *ties).drop(*ties), number)
        write_compact(placed, path, "append")
    return _counted(df.sparkSession.read.schema(placed.schema).parquet(path), name)


def _ranges(rows: DataFrame, keys: list[str], parts: int) -> list[Column]:
    """Conditions of about equal ranges of the keys in order, which take every row once."""
    own, fences = F.struct(*keys), []
    if parts > 1:
        drawn = rows.select(*keys).orderBy(F.xxhash64(*keys)).limit(PROBE_ROWS).orderBy(*keys).collect()
        for row in dict.fromkeys(drawn[i * len(drawn) // parts] for i in range(1, parts)):
            fence = [F.lit(row[k]).cast(rows.schema[k].dataType).alias(k) for k in keys]
            fences.append(own < F.struct(*fence))
    below, above = [*fences, F.lit(True)], [F.lit(True), *[~fence for fence in fences]]
    return [low & high for low, high in zip(above, below)]


def _placed(df: DataFrame, run: int) -> DataFrame:
    """Rows with the run that sorted them, their partition in it and their place in that."""
    return df.select(
        *df.columns,
        F.lit(run).alias("_run"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(_ROW_BITS).alias("_place"),
    )


def _counted(placed: DataFrame, name: str) -> DataFrame:
    """Settled rows by number: those of all partitions before their own, and their place in it."""
    own = ["_run", "_part"]
    before = Window.orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*own)
        .agg(F.count("*").alias("_rows"))
        .select(*own, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    numbered = placed.join(F.broadcast(starts), own)
    ordinal = F.col("_start") + F.col("_place") + 1
    return numbered.withColumn(name, ordinal).drop("_start", "_place", *own)


def number_head(
    df: DataFrame,
    order: list[Column],
    limit: int,
    name: str = "ordinal",
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """The first ``limit`` rows in order, numbered; 0 numbers all of them."""
    if 0 < limit <= head_rows:
        first = df.orderBy(*order).limit(limit)
        place = F.row_number().over(Window.orderBy(*order))
        return first.withColumn(name, place.cast("long"))
    numbered = with_ordinal(df, order, name)
    return numbered.filter(F.col(name) <= limit) if limit else numbered


def head(
    df: DataFrame, order: list[Column], limit: int, head_rows: int = HEAD_ROWS
) -> DataFrame:
    """The first ``limit`` rows in order; 0 keeps all of them."""
    if limit > head_rows:
        numbered = number_head(df, order, limit, "_ordinal", head_rows)
        return numbered.orderBy("_ordinal").drop("_ordinal")
    ordered = df.orderBy(*order)
    return ordered.limit(limit) if limit else ordered


def rows_between(
    df: DataFrame,
    order: list[Column],
    start: int,
    count: int,
    keep: list[str] | None = None,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """``count`` rows after skipping ``start``; deep offsets use the numbering, not one task."""
    keep = df.columns if keep is None else keep
    if start + count <= head_rows:
        return df.orderBy(*order).offset(start).limit(count).select(*keep)
    numbered = with_ordinal(df, order, "_ordinal", keep)
    inside = (F.col("_ordinal") > start) & (F.col("_ordinal") <= start + count)
    return numbered.filter(inside).orderBy("_ordinal").drop("_ordinal")


def _at_or_after(df: DataFrame, key: str, desc: bool, tie: str, tie_desc: bool, row) -> Column:
    """Whether a row of the table stands at or behind a given one; nulls last, first if ``desc``."""
    own, at = F.col(key), F.lit(row[key]).cast(df.schema[key].dataType)
    last = F.lit(row[tie]).cast(df.schema[tie].dataType)
    level = F.col(tie) <= last if tie_desc else F.col(tie) >= last
    if desc:
        behind = own.isNotNull() if row[key] is None else own < at
    else:
        behind = F.lit(False) if row[key] is None else own.isNull() | (own > at)
    same = own.isNull() if row[key] is None else own == at
    return F.coalesce(behind, F.lit(False)) | (F.coalesce(same, F.lit(False)) & level)


def _bucket(tests: list[Column], low: int, high: int) -> Column:
    """How many of the bounds a row stands behind, by halving; ``tests`` are rising."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(tests[middle], _bucket(tests, middle + 1, high)).otherwise(_bucket(tests, low, middle))


def rows_of_range(
    df: DataFrame,
    key: str,
    tie: str,
    start: int,
    count: int,
    total: int,
    desc: bool = False,
    tie_desc: bool = False,
    keep: list[str] | None = None,
    head_rows: int | None = None,
) -> DataFrame:
    """``count`` rows after skipping ``start`` of ``total`` by key, then tie, without sorting the rest.

    A histogram of the key, over the bounds that a fixed number of rows gives, tells which range
    holds the page; the range is cut down in the same way until one task may sort it. The two columns
    are settled first, so that no round computes the table, and what it broadcasts, again; every round
    reads them once and shuffles only counts. ``tie`` is unique and not null.
    """
    keep = df.columns if keep is None else keep
    head_rows = HEAD_ROWS if head_rows is None else head_rows
    first = F.col(key).desc_nulls_first() if desc else F.col(key).asc_nulls_last()
    order = [first, F.col(tie).desc() if tie_desc else F.col(tie).asc()]
    left, skipped, size = df, 0, total
    narrow = df.select(key, tie)
    if size > max(head_rows, count):
        narrow = settle(narrow)
    while size > max(head_rows, count):
        drawn = narrow.orderBy(F.xxhash64(key, tie)).limit(PROBE_ROWS).orderBy(*order).collect()
        step = max(1, len(drawn) // RANGES)
        tests = [_at_or_after(df, key, desc, tie, tie_desc, row) for row in drawn[step // 2 :: step]]
        bucket = _bucket(tests, 0, len(tests))
        held = {r["bucket"]: r["rows"] for r in narrow.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows")).collect()}
        before, low, high, inside = skipped, None, None, 0
        for number in sorted(held):
            if before < start + count and before + held[number] > start:
                if low is None:
                    low, skipped = number, before
                high, inside = number, inside + held[number]
            before += held[number]
        if low is None or inside >= size:
            break
        # Two bounds fence the range; the others were for counting.
        fences = [tests[low - 1]] if low else []
        fences += [~tests[high]] if high < len(tests) else []
        for fence in fences:
            left, narrow = left.filter(fence), narrow.filter(fence)
        size = inside
    if size > max(head_rows, count):
        return rows_between(left, order, start - skipped, count, keep, head_rows)
    return left.orderBy(*order).offset(start - skipped).limit(count).select(*keep)
