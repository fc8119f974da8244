"""Every operator as a query over the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType
from pyspark.sql.window import Window

from ..functions import parsing, text
from ..functions.cards import face_count, line_total, object_key, png_url, split_faces
from ..operators import catalog, grid, holdings, imports, keyed, lookups, media, snapshots
from ..plans.lineage import scratch_path, settle, settle_compact
from ..plans.ordering import number_sorted, with_ordinal
from ..schemas import HOLDING_SNAPSHOTS
from ..sources import feeds, reports, tables
from .views import Views

# Parameters of the queries; the checks read them too.
FROM = "1996-01-01T00:00"
TO = "1999-12-31T23:59:59"
AT = "1998-04-01T00:00:00"
NOW = "1998-04-01T00:00:00.25"
SET = "s7"
PAGE_SIZE = 200
FAR_PAGE = 1_000_000_000

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(build):
    _QUERIES[build.__name__] = build
    return build


def _money_as_double(df: DataFrame) -> DataFrame:
    """Exact decimals become doubles at the very end, for comparison."""
    return df.select(
        *[
            F.col(f.name).cast("double") if isinstance(f.dataType, DecimalType) else F.col(f.name)
            for f in df.schema
        ]
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, folder: _money_as_double(build(Views(spark, folder)))

    return {name: runner(build) for name, build in _QUERIES.items()}


def _tagged(column: str, **parts: DataFrame) -> DataFrame:
    """Several results as one, told apart by a column; absent columns are null."""
    tagged = [df.withColumn(column, F.lit(name)) for name, df in parts.items()]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


# ---------------------------------------------------------------- snapshots


@query
def total_value_by_snapshot(v: Views):
    return _numbered(snapshots.total_value_by_snapshot(v.snapshots(), FROM, TO))


def _numbered(rows: DataFrame) -> DataFrame:
    """A sorted result with each row's place in it, so that its order is compared too."""
    return number_sorted(rows, "place")


@query
def list_snapshots(v: Views):
    return _numbered(snapshots.list_snapshots(v.snapshots()))


@query
def count_snapshot_rows(v: Views):
    return snapshots.count_snapshot_rows(v.snapshots(), AT)


@query
def count_by_source(v: Views):
    asked = v.cards_feed().select((F.col("feed_seq") * 2).alias("source_card_id"))
    return snapshots.count_by_source(v.snapshots(), asked)


@query
def latest_two(v: Views):
    return _numbered(snapshots.latest_two(v.snapshots(), None, TO))


@query
def range_filter(v: Views):
    return snapshots.range_filter(v.snapshots(), "snapshot_ts", FROM, TO)


@query
def snapshot_rows(v: Views):
    return _numbered(snapshots.snapshot_rows(v.snapshots(), AT))


@query
def snapshot_projection(v: Views):
    return snapshots.snapshot_projection(v.snapshots())


@query
def series_summary(v: Views):
    return snapshots.series_summary(snapshots.total_value_by_snapshot(v.snapshots()))


def _movers(v: Views, limit: int, from_=None, to=None):
    """Both lists in their order, with the seconds compared on a row of their own."""
    found = snapshots.price_movers(v.snapshots(), from_, to, limit)
    compared = v.spark.createDataFrame(
        [(found.old_ts, found.new_ts)], "old_ts timestamp_ntz, new_ts timestamp_ntz"
    )
    return _tagged(
        "part",
        gainer=_numbered(found.gainers),
        loser=_numbered(found.losers),
        compared=compared,
    )


@query
def price_movers_gainers(v: Views):
    return _numbered(snapshots.price_movers(v.snapshots()).gainers)


@query
def price_movers_losers(v: Views):
    return _numbered(snapshots.price_movers(v.snapshots()).losers)


@query
def price_movers_cut(v: Views):
    return _movers(v, 10)


@query
def price_movers_unlimited(v: Views):
    return _movers(v, 0)


@query
def price_movers_of_one(v: Views):
    """A range with a single snapshot: no result, which is not the same as no change."""
    return _movers(v, 10, AT, AT)


def _changes(v: Views):
    return snapshots.price_changes(v.snapshots(), snapshots.compared(v.snapshots()))


@query
def export_projection(v: Views):
    changes = _changes(v).filter(F.col("side") == "gainer")
    return snapshots.export_projection(changes, snapshots.mover_order("gainer"))


@query
def export_movers(v: Views):
    folder = scratch_path(v.spark, "movers")
    reports.export_movers(_changes(v), folder)
    schema = (
        "row_no long, card_name string, set_name string, set_code string, foil string,"
        " language string, price_old double, price_new double, price_diff double"
    )
    read = v.spark.read.schema(schema).options(header=True, escape='"', multiLine=True)
    return _tagged(
        "side",
        gainer=read.csv(f"{folder}/{reports.GAINERS_NAME}"),
        loser=read.csv(f"{folder}/{reports.LOSERS_NAME}"),
    ).withColumn("language", F.coalesce("language", F.lit("")))


@query
def create_snapshot(v: Views):
    taken = snapshots.create_snapshot(v.holdings(), v.snapshots(), NOW)
    return taken.rows.withColumn("ts", F.lit(taken.ts.isoformat()).cast("timestamp_ntz"))


def _stored_ledger(v: Views, *times: str) -> DataFrame:
    """A snapshot table by generations, each numbered after what is stored already."""
    root = scratch_path(v.spark, "ledger")
    stored = v.spark.createDataFrame([], HOLDING_SNAPSHOTS)
    held = snapshots.numbered_holdings(v.holdings(), "no")
    for now in times:
        taken = snapshots.create_snapshot(held, stored, now, numbers="no")
        tables.append_snapshot(taken.rows, root)
        stored = tables.scan_table(v.spark, root, "holding_snapshots")
    return stored


@query
def append_snapshot(v: Views):
    return _stored_ledger(v, AT, FROM, AT)


@query
def append_snapshot_again(v: Views):
    """Generations numbered as the rows lie, each appended twice: one copy, gapless ids."""
    root = scratch_path(v.spark, "ledger")
    stored = v.spark.createDataFrame([], HOLDING_SNAPSHOTS)
    held = snapshots.numbered_holdings(v.holdings(), "no", ordered=False)
    for now in (AT, FROM, AT):
        taken = snapshots.create_snapshot(held, stored, now, numbers="no")
        for _ in range(2):
            tables.append_snapshot(taken.rows, root)
        stored = tables.scan_table(v.spark, root, "holding_snapshots")
    return stored.groupBy("snapshot_ts").agg(
        F.count("*").alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.sum(F.col("source_card_id") % 1_000_003).alias("sources"),
        F.sum(F.coalesce("price", F.lit(0)) * F.col("quantity")).alias("total_value"),
    )


@query
def refresh_totals(v: Views):
    """Totals kept beside the stored snapshots, refreshed after every append."""
    root = scratch_path(v.spark, "ledger")
    tables.write_table(v.snapshots().filter(F.col("snapshot_ts") < _ts(FROM)), root, "holding_snapshots")
    tables.refresh_totals(tables.scan_table(v.spark, root, "holding_snapshots"), root)
    later = v.snapshots().filter(F.col("snapshot_ts") >= _ts(FROM))
    tables.append_snapshot(later, root)
    return tables.refresh_totals(tables.scan_table(v.spark, root, "holding_snapshots"), root)


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query
def price_movers_bucketed(v: Views):
    """The movers of all snapshots stored in buckets by card identity."""
    root = scratch_path(v.spark, "buckets")
    table = root.rpartition("/")[2].replace("-", "_")
    stored = tables.append_bucketed_snapshot(v.snapshots(), root, table, 8)
    found = snapshots.price_movers(stored, limit=10)
    return _tagged("part", gainer=_numbered(found.gainers), loser=_numbered(found.losers))


@query
def stored_snapshot_rows(v: Views):
    """One partition out of the stored table, and the totals of a range of partitions."""
    stored = _stored_ledger(v, AT, FROM)
    rows = snapshots.snapshot_projection(snapshots.snapshot_rows(stored, AT, "place"), "place")
    totals = snapshots.total_value_by_snapshot(stored, None, FROM)
    return _tagged("part", rows=rows, totals=totals)


@query
def delete_snapshot(v: Views):
    kept, removed = snapshots.delete_snapshot(v.snapshots(), AT)
    return _tagged("part", kept=kept, removed=removed)


# ---------------------------------------------------------------- catalog


@query
def project_sets(v: Views):
    return catalog.project_sets(v.sets_feed())


@query
def scan_sets(v: Views):
    root = scratch_path(v.spark, "sets")
    tables.write_table(v.sets(), root, "catalog_sets")
    return tables.scan_table(v.spark, root, "catalog_sets")


@query
def get_set(v: Views):
    asked = v.set_requests().select(F.trim("set_code").alias("set_code"))
    found, missing = keyed.get_by_key(v.sets(), asked, "set_code")
    return _tagged("part", found=found, missing=missing)


@query
def filter_sets(v: Views):
    return catalog.filter_sets(
        v.sets(), set_name=" SUPPLIER#00 ", set_type="Core", block_name="nation_1", release_date=""
    )


@query
def search_sets(v: Views):
    return catalog.search_sets(v.sets(), " S1 ")


@query
def upsert_sets(v: Views):
    """Stored sets of even number, overwritten by a feed in which codes repeat."""
    feed = v.sets_feed()
    again = feed.withColumns(
        {
            "feed_seq": F.col("feed_seq") + 1_000_000_000,
            "name": F.concat(F.col("name"), F.lit(" again")),
            "released_at": F.lit(None).cast("string"),
        }
    ).filter(F.col("block_code") != "3")
    stored = v.sets().withColumn("set_name", F.concat(F.lit("stored "), "set_name"))
    return catalog.upsert_sets(stored, feed.filter(F.col("set_type") == "core").unionByName(again))


def _set_requests(v: Views):
    return catalog.clean_set_input(v.set_requests())


@query
def clean_set_input(v: Views):
    clean, incomplete = catalog.clean_set_input(v.set_requests())
    return _tagged("part", clean=clean, incomplete=incomplete)


@query
def create_set(v: Views):
    grown, conflicts = catalog.create_set(v.sets(), _set_requests(v)[0])
    return _tagged("part", sets=grown, conflicts=conflicts)


@query
def update_set(v: Views):
    wrong = F.col("block_name").endswith("3")
    requests = _set_requests(v)[0].withColumn(
        "path_code", F.when(wrong, F.lit("other")).otherwise(F.col("set_code"))
    )
    updated, rejected = catalog.update_set(v.sets(), requests)
    return _tagged("part", sets=updated, rejected=rejected)


@query
def delete_set(v: Views):
    asked = _set_requests(v)[0].select("set_code")
    kept, missing = catalog.delete_set(v.sets(), asked)
    return _tagged("part", kept=kept, missing=missing)


@query
def icon_worklist(v: Views):
    cached = v.sets().filter(F.col("set_type") == "core")
    return catalog.icon_worklist(
        v.sets(), cached.select(F.concat("set_code", F.lit(".svg")).alias("object_key"))
    )


# ---------------------------------------------------------------- import


def _normalized(v: Views):
    return imports.normalize_grid(imports.data_rows(imports.matching_sheets(v.grid())))


def _keyed_rows(v: Views):
    return imports.build_match_keys(imports.resolve_set(_normalized(v), v.sets()))


def _resolved(v: Views):
    return imports.enrich(_keyed_rows(v), v.cards_feed())


@query
def matching_sheets(v: Views):
    return imports.matching_sheets(v.grid())


@query
def data_rows(v: Views):
    return imports.data_rows(v.grid())


@query
def normalize_grid(v: Views):
    return _normalized(v)


@query
def resolve_set(v: Views):
    return imports.resolve_set(_normalized(v), v.sets()).select("sheet", "row_no", "set_code")


def _key_parts():
    return [F.col(f"match_key.{part}").alias(f"key_{part}") for part in ("kind", "set", "value")]


@query
def build_match_keys(v: Views):
    return _keyed_rows(v).select("sheet", "row_no", "set_code", *_key_parts())


@query
def expand_feed_keys(v: Views):
    cards = lookups.expand_feed_keys(v.cards_feed())
    return cards.select(*_key_parts(), *[c for c in cards.columns if c != "match_key"])


@query
def enrich(v: Views):
    return _resolved(v).select(
        "sheet", "row_no", "set_code", "card_number", "card_type", "price", "reason"
    )


@query
def enrich_without_feed(v: Views):
    rows = settle(imports.enrich(_keyed_rows(v), None))
    return _tagged(
        "part",
        metrics=imports.import_metrics(rows, feed_failed=True, sets_failed=True),
        errors=imports.import_errors(rows, feed_failed=True, sets_failed=True),
    )


@query
def unresolved_report(v: Views):
    return _numbered(imports.unresolved_report(_resolved(v)))


@query
def import_metrics(v: Views):
    return imports.import_metrics(_resolved(v))


@query
def import_errors(v: Views):
    return imports.import_errors(_resolved(v))


@query
def persist_import(v: Views):
    return imports.persist_import(_resolved(v))


@query
def insert_import(v: Views):
    raw = settle_compact(v.grid())
    resolved = imports.resolve_by_parts(raw, v.sets(), v.cards_feed())
    return imports.insert_import(v.holdings(), imports.persist_import(resolved), stored=True)


def _enriched(v: Views):
    raw = settle_compact(v.grid())
    names = imports.matching_names(raw)
    resolved = imports.resolve_by_parts(raw, v.sets(), v.cards_feed(), names)
    return imports.enriched_grid(raw, resolved, names)


@query
def enriched_grid(v: Views):
    return _enriched(v)


@query
def import_grid(v: Views):
    """The whole import, sets taken from their feed because the stored table is empty."""
    nothing = v.sets().filter(F.lit(False))
    result = imports.import_grid(v.grid(), nothing, v.cards_feed(), v.sets_feed())
    return _tagged(
        "part",
        stored=result.stored,
        unresolved=result.unresolved.withColumnRenamed("foil", "foil_text"),
        errors=result.errors,
        metrics=result.metrics,
    )


@query
def write_enriched_grid(v: Views):
    folder = scratch_path(v.spark, "grids")
    path = reports.write_enriched_grid(_enriched(v), folder, "stock.list.xlsx")
    return feeds.read_grid(v.spark, path)


@query
def write_unresolved(v: Views):
    path = scratch_path(v.spark, "unresolved")
    rows = imports.unresolved_rows(_resolved(v))
    # A name as spreadsheets must quote it: with a quote, a comma and a line break in it.
    awkward = F.concat(F.lit('say "'), "card", F.lit('",\nor not'))
    rows = rows.withColumn("card", F.when(F.col("card") != "", awkward).otherwise(""))
    reports.write_unresolved(rows, path)
    columns = "sheet string, row_no long, number string, card string, set string, foil string"
    read = v.spark.read.schema(f"{columns}, reason string")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("number", "card", "set", "foil")}
    return read.csv(path, header=True, escape='"', multiLine=True).withColumns(texts)


# ---------------------------------------------------------------- holdings


@query
def scan_holdings(v: Views):
    root = scratch_path(v.spark, "holdings")
    tables.write_table(v.holdings(), root, "holdings")
    return tables.scan_table(v.spark, root, "holdings")


@query
def holdings_by_set(v: Views):
    return holdings.holdings_by_set(v.holdings(), SET)


@query
def get_by_id(v: Views):
    found, missing = keyed.get_by_key(v.holdings(), v.keys(), "id")
    return _tagged("part", found=found, missing=missing)


@query
def find_stack(v: Views):
    return holdings.find_stack(v.holdings(), SET, "151", False, "O")


@query
def filter_holdings(v: Views):
    return grid.filter_holdings(v.holdings(), name=" Ring ", language="f", foil_only=True)


@query
def line_totals(v: Views):
    return v.holdings().select("id", line_total().alias("line_total"))


@query
def with_set_name(v: Views):
    return holdings.with_set_name(v.holdings(), v.sets()).select("id", "set_code", "set_name")


def _placed(rows: DataFrame, key: str, desc: bool = False):
    """A sorted table with each row's place in it."""
    keyed, order = grid.sort_order(rows, key, desc)
    return with_ordinal(keyed, order, "place", keep=rows.columns)


@query
def sort_grid(v: Views):
    return _numbered(grid.sort_grid(v.holdings().select("id", "location"), "location", desc=True))


@query
def sort_by_set_name(v: Views):
    rows = holdings.with_set_name(v.holdings(), v.sets()).select("id", "set_name")
    return _placed(rows, "set_name")


def _page(v: Views, page: int, **held):
    rows = v.holdings().select("id", "price", "card_name")
    shown = grid.paginate(rows, "price", page, PAGE_SIZE, desc=True, **held)
    numbered = _numbered(shown.rows)
    counts = {"total": shown.total, "page_count": shown.page_count, "page": shown.page}
    return numbered.withColumns({c: F.lit(n).cast("long") for c, n in counts.items()})


@query
def paginate(v: Views):
    return _page(v, 3)


@query
def paginate_numbered(v: Views):
    """The same page by numbering all rows, as a page too deep for one task is found."""
    return _page(v, 3, head_rows=PAGE_SIZE)


@query
def paginate_ranged(v: Views):
    """The same page out of the range that histograms of the key find, as in a very large table."""
    return _page(v, 3, head_rows=PAGE_SIZE, ranged_rows=0)


@query
def paginate_past_end(v: Views):
    return _page(v, FAR_PAGE)


@query
def exists_key(v: Views):
    return keyed.exists_key(v.keys(), v.holdings(), "id")


@query
def delete_rows(v: Views):
    kept, missing = keyed.delete_rows(v.holdings(), v.keys(), "id")
    return _tagged("part", kept=kept, missing=missing)


@query
def validate_add(v: Views):
    ok, rejected = holdings.validate_add(v.add_requests())
    return _tagged("part", ok=ok, rejected=rejected)


@query
def validate_patch(v: Views):
    ok, rejected = holdings.validate_patch(v.patches())
    return _tagged("part", ok=ok, rejected=rejected).select("id", "req_seq", "part", "reason")


@query
def add_holding(v: Views):
    grown, failed = holdings.add_holding(v.holdings(), v.add_requests(), v.cards_feed())
    return _tagged("part", holdings=grown, failed=failed)


@query
def patch_holdings(v: Views):
    patched, rejected = holdings.patch_holdings(v.holdings(), v.patches())
    rejected = rejected.select("id", "req_seq", "reason")
    return _tagged("part", holdings=patched, rejected=rejected)


@query
def refresh_prices(v: Views):
    refreshed, failed = holdings.refresh_prices(v.holdings(), v.cards_feed())
    return _tagged("part", holdings=refreshed, failed=failed)


@query
def refresh_chosen_prices(v: Views):
    held = settle_compact(v.holdings())
    refreshed, failed = holdings.refresh_prices_by_parts(held, v.cards_feed(), v.keys())
    return _tagged("part", holdings=refreshed, failed=failed)


# ---------------------------------------------------------------- lookups


@query
def price_by_name(v: Views):
    asked = v.holdings().select("id", "card_name", "set_code", "foil")
    priced, rejected = lookups.price_by_name(asked, v.cards_feed())
    return _tagged("part", priced=priced, rejected=rejected)


@query
def price_by_number(v: Views):
    asked = v.holdings().select("id", "card_number", "set_code", "foil")
    priced, rejected = lookups.price_by_number(asked, v.cards_feed())
    return _tagged("part", priced=priced, rejected=rejected)


def _identifiers(v: Views):
    return imports.lookup_identifiers(_keyed_rows(v))


@query
def card_lookup(v: Views):
    looked_up = lookups.card_lookup(_identifiers(v), v.cards_feed())
    return looked_up.select(
        "sheet",
        "row_no",
        F.col("card.name").alias("card_name"),
        F.col("card.collector_number").alias("card_number"),
        F.col("card.prices.usd").alias("usd"),
        F.col("card.layout").alias("layout"),
        F.size("card.card_faces").alias("faces"),
    ).withColumn("faces", F.when(F.col("faces") > 0, F.col("faces")))


@query
def not_found(v: Views):
    return lookups.not_found(_identifiers(v), v.cards_feed())


@query
def plan_lookup_batches(v: Views):
    return lookups.plan_lookup_batches(_identifiers(v), [F.col("sheet"), F.col("row_no")])


@query
def image_manifest(v: Views):
    return media.image_manifest(v.holdings(), v.sets(), v.cards_feed())


@query
def image_manifest_cached(v: Views):
    """Pictures of foil cards are held already."""
    names = media.image_manifest(v.holdings().filter("foil"), v.sets(), v.cards_feed())
    return media.image_manifest(v.holdings(), v.sets(), v.cards_feed(), cached=names)


@query
def image_manifest_back(v: Views):
    return media.image_manifest(v.holdings(), v.sets(), v.cards_feed(), face=1)


@query
def face_counts(v: Views):
    return v.cards_feed().select("feed_seq", face_count().alias("face_count"))


# ---------------------------------------------------------------- expressions


@query
def text_functions(v: Views):
    return v.grid().select(
        "sheet",
        "row_no",
        text.norm("c").alias("norm"),
        text.is_blank("b").alias("is_blank"),
        text.blank_to_null("j").alias("blank_to_null"),
        text.natural_key("c").alias("natural_key"),
    )


@query
def parse_functions(v: Views):
    return v.grid().select(
        "sheet",
        "row_no",
        parsing.foil_flag("d").alias("foil_flag"),
        parsing.cell_text("a", "a_num").alias("cell_text"),
        parsing.parse_quantity("f", "f_num").alias("parse_quantity"),
        parsing.manual_flag("i").alias("manual_flag"),
        parsing.cell_decimal("g", "g_num").alias("cell_decimal"),
    )


@query
def date_functions(v: Views):
    with_time = F.concat("released_at", F.lit("T10:22"))
    return v.sets_feed().select(
        "code",
        parsing.safe_date("released_at").alias("safe_date"),
        parsing.safe_date(with_time).alias("date_of_time"),
        parsing.parse_ts(with_time).alias("parse_ts"),
        parsing.parse_ts("released_at").alias("time_of_date"),
    )


@query
def card_functions(v: Views):
    return v.cards_feed().select(
        "feed_seq",
        F.array_join(split_faces("name"), "|").alias("split_faces"),
        parsing.pick_price(F.lit(False), "prices.usd", "prices.usd_foil").alias("plain_price"),
        parsing.pick_price(F.lit(True), "prices.usd", "prices.usd_foil").alias("foil_price"),
        png_url(0).alias("front_png"),
        png_url(1).alias("back_png"),
        object_key("type_line", "set", "collector_number", "name").alias("object_key"),
    )


# ---------------------------------------------------------------- sources


def _landed(v: Views, rows: DataFrame, label: str) -> str:
    """A feed as lines of JSON, with lines cut short and lines that are no JSON among them."""
    path = scratch_path(v.spark, label)
    rows.write.json(path)
    broken = v.table("nation").select(
        F.concat(F.lit('{"object":"list","data":[{"name":"'), "n_name").alias("value")
    )
    broken.write.mode("append").text(path)
    return path


def _text_only(broken: DataFrame) -> DataFrame:
    return broken.select("text")


def _places(rows: DataFrame) -> DataFrame:
    """Records beside the next one of their file and line, by the names they go by."""
    line = Window.partitionBy("feed_seq._file", "feed_seq._block", "feed_seq._line")
    return rows.withColumn("after", F.lag("name").over(line.orderBy("feed_seq._item_no")))


def _lists(rows: DataFrame, **arrays):
    """Reply documents of the records of a batch, in feed order."""
    batch = F.floor(F.col("feed_seq") / lookups.BATCH_SIZE).alias("batch")
    lists = [
        F.transform(
            F.array_sort(F.filter(F.collect_list(F.struct("feed_seq", item.alias("one"))),
                                  lambda x: x["one"].isNotNull())),
            lambda x: x["one"],
        ).alias(name)
        for name, item in arrays.items()
    ]
    return rows.groupBy(batch).agg(*lists).drop("batch").withColumn("object", F.lit("list"))


def _sets_record(v: Views):
    return F.struct(*[c for c in v.sets_feed().columns if c != "feed_seq"])


@query
def read_sets_feed(v: Views):
    path = _landed(v, _lists(v.sets_feed(), data=_sets_record(v)), "sets-feed")
    rows, broken = feeds.read_sets_feed(v.spark, path, multi_line=False)
    return _tagged("part", sets=_places(rows).drop("feed_seq"), broken=_text_only(broken))


@query
def read_sets_files(v: Views):
    """One document per file, as feeds are landed by default."""
    path = scratch_path(v.spark, "sets-files")
    replies = _lists(v.sets_feed(), data=_sets_record(v))
    replies.write.option("maxRecordsPerFile", 1).json(path)
    v.spark.range(1).select(F.lit('{"data":[{"code":').alias("value")).coalesce(1).write.mode(
        "append"
    ).text(path)
    rows, broken = feeds.read_sets_feed(v.spark, path)
    return _tagged("part", sets=_places(rows).drop("feed_seq"), broken=_text_only(broken))


def _flat_cards(cards: DataFrame) -> DataFrame:
    return cards.select(
        "name", "set", "collector_number", "type_line", "prices.usd", "prices.usd_foil", "layout",
        F.col("image_uris.png").alias("png"),
        F.get("card_faces", F.lit(0))["image_uris"]["png"].alias("front_png"),
        F.get("card_faces", F.lit(1))["image_uris"]["png"].alias("back_png"),
    )


@query
def read_card_feed(v: Views):
    path = _landed(v, v.cards_feed().drop("feed_seq"), "cards-feed")
    cards, broken = feeds.read_card_feed(v.spark, path)
    return _tagged("part", cards=_flat_cards(cards), broken=_text_only(broken))


@query
def land_card_feed(v: Views):
    """Cards and broken lines out of one scan, with the numbers that it observed."""
    path = _landed(v, v.cards_feed().drop("feed_seq"), "cards-feed")
    landed = feeds.land_card_feed(v.spark, path, scratch_path(v.spark, "landed"))
    counts = v.spark.createDataFrame(
        [(landed.record_count, landed.broken_count)], "record_count long, broken_count long"
    )
    return _tagged(
        "part", cards=_flat_cards(landed.records), broken=_text_only(landed.broken), counts=counts
    )


@query
def read_batch_replies(v: Views):
    feed = v.cards_feed()
    card = F.struct(*[c for c in feed.columns if c != "feed_seq"])
    unknown = F.struct("name", "set", "collector_number")
    hit = F.col("set").isNotNull()
    replies = _lists(feed, data=F.when(hit, card), not_found=F.when(~hit, unknown))
    cards, missing, broken = feeds.read_batch_replies(v.spark, _landed(v, replies, "replies"))
    columns = ("name", "set", "collector_number", "after")
    matched = _places(cards).select(
        *columns, "type_line", "layout", "prices.usd", "prices.usd_foil"
    )
    return _tagged(
        "part",
        matched=matched,
        not_found=_places(missing).select(*columns),
        broken=_text_only(broken),
    )


@query
def read_grid(v: Views):
    path = scratch_path(v.spark, "grid")
    v.grid().write.parquet(path)
    return feeds.read_grid(v.spark, path)
