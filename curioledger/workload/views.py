"""The given tables in the shape of feeds, grid, holdings and snapshots.

The text is plain SQL that both engines run, so a query and its check start from the same rows.
Foreign keys always hold in these tables.
"""

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import project_sets
from ..schemas import CATALOG_SETS, GRID, HOLDINGS, HOLDING_SNAPSHOTS

# Row identity: a composite kept within 62 bits at any scale.
ROW_ID = (
    "((((l_orderkey % 4000000) * 1000000 + l_partkey % 1000000) * 1000 + l_suppkey % 1000) * 10"
    " + l_linenumber) * 100 + cast(l_quantity as int)"
)
_SET_OF = "cast(floor({key} / 20) as bigint)"
_CARD_SET = "concat('s', cast(" + _SET_OF.format(key="l_partkey") + " as string))"
_BLANK_ROW = "(l_suppkey % 29 = 0 and l_linenumber = 3)"

SETS_FEED = """
select concat('s', cast(s_suppkey as string)) as code,
  case when s_suppkey % 10 = 9
    then concat('Supplier#', lpad(cast(s_suppkey - 1 as string), 9, '0'))
    else s_name end as name,
  case when s_suppkey % 5 = 0 then 'not-a-date'
    else concat('20', lpad(cast(s_suppkey % 25 as string), 2, '0'), '-02-18') end as released_at,
  case when s_suppkey % 2 = 0 then 'expansion' else 'core' end as set_type,
  cast(s_suppkey % 300 as int) as card_count,
  cast(case when s_suppkey % 3 = 0 then null else s_suppkey % 290 end as int) as printed_size,
  cast(n_nationkey as string) as block_code,
  n_name as block,
  case when s_suppkey % 4 = 0 then null when s_suppkey % 4 = 1 then ' '
    else concat('icons/', cast(s_suppkey as string), '.svg') end as icon_svg_uri,
  s_suppkey as feed_seq
from {supplier} left join {nation} on s_nationkey = n_nationkey
"""

CARDS_FEED = f"""
select p_partkey as feed_seq,
  case when p_type = 'PROMO' then concat(p_name, ' // alt ', p_name) else p_name end as name,
  case when p_partkey % 97 = 0 then null
    else concat('s', cast({_SET_OF.format(key="p_partkey")} as string)) end as set,
  case when p_partkey % 41 = 0 then null else cast(p_partkey as string) end as collector_number,
  p_type as type_line,
  case when p_partkey % 10 = 0 then null
    else cast(cast(p_retailprice as decimal(12,2)) as string) end as usd,
  case when p_partkey % 7 = 0 then 'n/a'
    else cast(cast(p_retailprice + 5 as decimal(12,2)) as string) end as usd_foil,
  case when p_type = 'PROMO' then 'transform' when p_partkey % 6 = 0 then null
    else 'normal' end as layout,
  case when p_type = 'PROMO' or p_partkey % 11 = 0 then null
    else concat('img/', cast(p_partkey as string), '.png') end as png,
  case when p_type = 'PROMO'
    then concat('img/', cast(p_partkey as string), '-0.png') end as front_png,
  case when p_type = 'PROMO' and p_partkey % 13 <> 0
    then concat('img/', cast(p_partkey as string), '-1.png') end as back_png
from {{part}}
"""

GRID_ROWS = f"""
select l_returnflag as sheet, {ROW_ID} + 10 as row_no,
  case when l_linenumber = 1 then null
    when l_linenumber = 2 then cast(l_partkey + 1000000 as string)
    when l_linenumber = 4 then concat(cast(l_partkey as string), '.0')
    else cast(l_partkey as string) end as a,
  case when {_BLANK_ROW} then '  ' when l_linenumber = 1 and l_suppkey % 13 = 0 then null
    else p_name end as b,
  case when {_BLANK_ROW} then null when l_suppkey % 17 = 0 then 'UNKNOWN SET'
    else concat('  supplier#',
      lpad(cast({_SET_OF.format(key="l_partkey")} as string), 9, '0'), ' ') end as c,
  case when l_linestatus = 'F' then ' Sim' else 'No' end as d,
  case when l_suppkey % 7 = 0 then 'old type' end as e,
  concat(cast(cast(l_quantity as int) - 3 as string),
    case when l_linenumber = 5 then '.5' else '' end) as f,
  case when l_discount = 0 then null when l_tax = 0.01 then 'n/a'
    else cast(cast(l_extendedprice as decimal(12,2)) as string) end as g,
  cast(null as string) as h,
  case when l_tax = 0.08 then '*Conferir sempre Manualmente ok' end as i,
  case when l_linenumber = 6 then ' ' else 'en' end as j,
  cast(null as string) as k,
  case when l_linenumber = 4 then cast(l_partkey as double) end as a_num,
  case when l_linenumber = 5 then cast(cast(l_quantity as int) - 3 as double) + 0.5 end as f_num,
  case when l_discount > 0 and l_linenumber = 7 then cast(l_suppkey as double) + 0.25 end as g_num
from {{lineitem}} left join {{part}} on l_partkey = p_partkey
union all
select sheet, cast(n as bigint), case when n = 3 then 'Number (Optional)' else 'title' end,
  case when n = 3 then ' card ' else 'title' end,
  case when n = 3 and sheet = 'A' then 'Edition' when n = 3 then 'SET' else 'title' end,
  case when n = 3 then 'Foil' end, null, null, null, null, null, null, null, null, null, null
from (select distinct l_returnflag as sheet, l_linenumber as n from {{lineitem}}
  where l_linenumber <= 3) heads
"""

SNAPSHOTS = f"""
select {ROW_ID} as id,
  case when l_partkey % 9 = 0 then null else cast(l_partkey as string) end as card_number,
  p_name as card_name,
  case when l_suppkey % 23 = 0 then null else {_CARD_SET} end as set_code,
  case when l_suppkey % 3 = 0 then '' when l_suppkey % 3 = 1 then null
    else concat('set of ', l_returnflag) end as set_name_raw,
  l_returnflag = 'R' as foil,
  case when l_linenumber = 4 then null else p_type end as card_type,
  case when l_linenumber = 5 then null else l_linestatus end as language,
  cast(l_quantity as int) as quantity,
  case when l_discount = 0 then null else cast(l_extendedprice as decimal(12,2)) end as price,
  case when l_tax = 0 then null else concat('note ', l_returnflag) end as comment,
  case when l_suppkey % 5 = 0 then null
    else concat('box ', cast(l_suppkey as string)) end as location,
  l_partkey as source_card_id,
  {{quarter}} as snapshot_ts
from {{lineitem}} left join {{part}} on l_partkey = p_partkey
"""

# Requests, as tables derived from the given ones.
KEYS = f"""
select case when l_linestatus = 'O' then {ROW_ID} else {ROW_ID} + 8 end as id from {{lineitem}}
"""
ADD_REQUESTS = f"""
select p_partkey + 1 as req_seq,
  case when p_size = 1 then ' ' else upper(p_name) end as card_name,
  case when p_size = 2 then null when p_size = 3 then 'elsewhere'
    else concat('s', cast({_SET_OF.format(key="p_partkey")} as string)) end as set_code,
  p_size > 25 as foil,
  case when p_size = 4 then '' else 'en' end as language,
  cast(p_size - 5 as int) as quantity
from {{part}}
"""
PATCHES = f"""
select {ROW_ID} as id, l_partkey * 2 as req_seq, cast(null as string) as card_name,
  case when l_suppkey % 2 = 0 then ' ' else 'moved' end as set_code, true as foil,
  case when l_linenumber = 7 then ' ' else 'pt' end as language,
  cast(l_quantity as int) - 2 as quantity, cast(null as string) as card_type,
  cast(l_partkey as decimal(12,2)) as price, ' checked ' as comment, '' as location
from {{lineitem}}
union all
select case when l_tax = 0.05 then {ROW_ID} + 8 else {ROW_ID} end, l_partkey * 2 + 1,
  case when l_linenumber > 4 then p_name end, cast(null as string), l_returnflag = 'N',
  'es', cast(l_quantity as int), ' retyped ', cast(null as decimal(12,2)),
  case when l_linenumber = 2 then '  ' end, concat(' shelf ', l_returnflag)
from {{lineitem}} left join {{part}} on l_partkey = p_partkey
"""
SET_REQUESTS = """
select s_suppkey + 1 as req_seq,
  case when s_suppkey % 3 = 0 then concat(' s', cast(s_suppkey as string))
    when s_suppkey % 3 = 1 then concat('new', cast(s_nationkey as string), ' ') else ' ' end
    as set_code,
  case when s_suppkey % 11 = 0 then '' else concat(s_name, ' ') end as set_name,
  case when s_suppkey % 2 = 0 then ' 2024-05-01' else '' end as release_date,
  case when s_suppkey % 4 = 0 then '  ' else 'core ' end as set_type,
  case when s_suppkey % 5 = 0 then 'many' else cast(s_suppkey as string) end as card_count,
  case when s_suppkey % 7 = 0 then null else ' 12 ' end as printed_size,
  '' as block_code,
  s_name as block_name
from {supplier}
"""

TEXTS = {
    "sets_feed": SETS_FEED,
    "cards_feed": CARDS_FEED,
    "grid": GRID_ROWS,
    "snapshots": SNAPSHOTS,
    "keys": KEYS,
    "add_requests": ADD_REQUESTS,
    "patches": PATCHES,
    "set_requests": SET_REQUESTS,
}
TABLES = ("supplier", "nation", "part", "lineitem")
# Bytes of a file that one task of a dealt table gets.
DEAL_BYTES = 16 << 20
# The table that grows fastest, with columns whose combinations are evenly spread.
SPREAD_BY = {"lineitem": ("l_orderkey", "l_partkey", "l_linenumber")}
SPARK_QUARTER = "cast(trunc(l_shipdate, 'QUARTER') as timestamp_ntz)"
CHECK_QUARTER = "date_trunc('quarter', l_shipdate)"


def check_text(name: str) -> str:
    """A view as text for the checking engine, where the tables are known by name."""
    return TEXTS[name].format(quarter=CHECK_QUARTER, **{t: t for t in TABLES})


def _picture(column: str):
    return F.struct(F.col(column).alias("png"))


class Views:
    """The views over one directory of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.layouts: dict[str, tuple[int, int]] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; one whose rows lie in too few places for the cores is dealt out to all of them.

        The small given files have a single row group each, which no setting can split.
        """
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name not in SPREAD_BY or len(df.inputFiles()) >= cores:
            return df
        if name not in self.layouts:
            self.layouts[name] = self._layout(df)
        places, size = self.layouts[name]
        if 2 * places >= cores:
            return df
        return df.repartition(max(cores, ceil(size / DEAL_BYTES)), *SPREAD_BY[name])

    @staticmethod
    def _layout(df: DataFrame) -> tuple[int, int]:
        """Splits that hold rows, and the size of their files. Footers alone are read for it."""
        place = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_block_start")]
        files = df.select(*place).groupBy("file_path", "file_size").agg(F.countDistinct("file_block_start").alias("places"))
        found = files.agg(F.sum("places"), F.sum("file_size")).first()
        return found[0] or 0, found[1] or 0

    def view(self, name: str) -> DataFrame:
        text = TEXTS[name].replace("{quarter}", SPARK_QUARTER)
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def sets_feed(self) -> DataFrame:
        return self.view("sets_feed")

    def sets(self) -> DataFrame:
        """Stored sets: the feed, projected."""
        return project_sets(self.sets_feed()).select(CATALOG_SETS.names)

    def cards_feed(self) -> DataFrame:
        """Card feed with its nested prices, pictures and faces."""
        flat = self.view("cards_feed")
        face = [
            F.struct(F.lit(side).alias("name"), _picture(f"{side}_png").alias("image_uris"))
            for side in ("front", "back")
        ]
        two_faced = F.col("type_line") == "PROMO"
        return flat.select(
            "feed_seq",
            "name",
            "set",
            "collector_number",
            "type_line",
            F.struct("usd", "usd_foil").alias("prices"),
            F.when(~two_faced, _picture("png")).alias("image_uris"),
            "layout",
            F.when(two_faced, F.array(*face)).alias("card_faces"),
        )

    def grid(self) -> DataFrame:
        return self.view("grid").select(GRID.names)

    def snapshots(self) -> DataFrame:
        return self.view("snapshots").select(HOLDING_SNAPSHOTS.names)

    def holdings(self) -> DataFrame:
        return self.view("snapshots").select(HOLDINGS.names)

    def keys(self) -> DataFrame:
        return self.view("keys")

    def add_requests(self) -> DataFrame:
        return self.view("add_requests")

    def patches(self) -> DataFrame:
        return self.view("patches")

    def set_requests(self) -> DataFrame:
        return self.view("set_requests")
