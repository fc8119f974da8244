"""Browsing a table: filter, typed sort, page."""

from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import collation_key
from ..plans.ordering import HEAD_ROWS, RANGED_ROWS, rows_between, rows_of_range

PAGE_SIZES = (25, 50, 100, 200)
SORT_KEY = "_sort_key"


def filter_holdings(
    holdings: DataFrame,
    name: str = "",
    language: str = "",
    set_code: str = "",
    quantity: int = 0,
    foil_only: bool = False,
) -> DataFrame:
    """Every filled-in field narrows the rows; a null language never matches a text."""
    tests = []
    if name.strip():
        tests.append(F.lower("card_name").contains(name.strip().lower()))
    if language.strip():
        tests.append(F.lower("language").contains(language.strip().lower()))
    if set_code.strip():
        tests.append(F.col("set_code") == set_code.strip())
    if quantity and quantity > 0:
        tests.append(F.col("quantity") == quantity)
    if foil_only:
        tests.append(F.col("foil"))
    return holdings.filter(reduce(lambda a, b: a & b, tests)) if tests else holdings


def sort_order(
    df: DataFrame,
    key: str,
    desc: bool = False,
    tie: str = "id",
    key_expr: Column | None = None,
    tie_desc: bool = False,
) -> tuple[DataFrame, list[Column]]:
    """The rows with their sort key as a column, and the order over it.

    Nulls come last, first when descending; text is in natural order. A sort would evaluate a
    computed key at every comparison, hence the column. The tie column makes the order total, so
    equal keys can spread over range partitions. ``key_expr`` replaces the value compared.
    """
    if key_expr is None:
        text = isinstance(df.schema[key].dataType, StringType)
        key_expr = collation_key(key) if text else F.col(key)
    first = F.col(SORT_KEY)
    first = first.desc_nulls_first() if desc else first.asc_nulls_last()
    last = F.col(tie).desc() if tie_desc else F.col(tie).asc()
    return df.withColumn(SORT_KEY, key_expr), [first, last]


def sort_grid(df: DataFrame, key: str, desc: bool = False, tie: str = "id", key_expr=None):
    keyed, order = sort_order(df, key, desc, tie, key_expr)
    return keyed.orderBy(*order).drop(SORT_KEY)


class Page(NamedTuple):
    rows: DataFrame
    total: int
    page_count: int
    page: int


def paginate(
    df: DataFrame,
    key: str,
    page: int = 1,
    size: int = 25,
    desc: bool = False,
    tie: str = "id",
    key_expr: Column | None = None,
    head_rows: int = HEAD_ROWS,
    ranged_rows: int = RANGED_ROWS,
) -> Page:
    """One page of a sorted table; a page past the end shows the last one.

    A page of the back half is the head of the reverse order, turned round. Up to ``head_rows``
    rows before it are held by one task. Beyond that all rows are numbered; of a table with more
    than ``ranged_rows`` rows, which reads faster than it sorts, the range that holds the page is
    found by histograms of the key, and it alone is sorted.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}, got {size}")
    total = df.count()
    page_count = max(1, ceil(total / size))
    current = min(max(page, 1), page_count)
    keyed, order = sort_order(df, key, desc, tie, key_expr)
    start = (current - 1) * size
    held = min(size, total - start)
    after = total - start - held
    deep = min(start, after) + held > head_rows
    if deep and total > ranged_rows:
        rows = rows_of_range(keyed, SORT_KEY, tie, start, held, total, desc, False, df.columns, head_rows)
    elif deep or after >= start:
        rows = rows_between(keyed, order, start, size, df.columns, head_rows)
    else:
        keyed, back = sort_order(df, key, not desc, tie, key_expr, tie_desc=True)
        last = rows_between(keyed, back, after, held, None, head_rows)
        rows = last.orderBy(*order).select(df.columns)
    return Page(rows, total, page_count, current)
