"""Card feed as a lookup table: keys, prices, full cards, batches of identifiers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cards import feed_keys, match_key, name_key, number_key
from ..functions.parsing import pick_price
from ..functions.text import is_blank
from ..plans.joins import lookup_join
from ..plans.ordering import with_ordinal

BATCH_SIZE = 75

# Words of 64 bits in the bitmap of keys asked for: 128 KB.
ASKED_WORDS = 16_384

# Feed fields a resolved row needs, by the name they get beside it.
CARD_FIELDS = {
    "feed_name": "name",
    "feed_set": "set",
    "feed_number": "collector_number",
    "feed_type": "type_line",
    "feed_usd": "prices.usd",
    "feed_usd_foil": "prices.usd_foil",
}


def exploded_keys(feed: DataFrame) -> DataFrame:
    """One row per feed card and key, before repeated keys are settled."""
    keys = F.explode(feed_keys("set", "collector_number", "name"))
    return feed.select(keys.alias("match_key"), "feed_seq")


def expand_feed_keys(
    feed: DataFrame, fields: dict | None = None, asked: Column | None = None
) -> DataFrame:
    """One row per key: number key, full name, each face. The first card in feed order wins.

    Keys and places in the feed are aggregated alone, combined before the shuffle, so a key with
    very many copies costs one narrow row per task; what a card carries is fetched once, by place.
    ``asked`` is a bitmap of the keys wanted, other keys may then be missing. Neither side of that is
    ever broadcast: the size of a feed's files says little of that of its rows.
    """
    keyed = exploded_keys(feed)
    keyed = keyed if asked is None else asked_keys(keyed, asked)
    first = keyed.groupBy("match_key").agg(F.min("feed_seq").alias("_seq"))
    fields = CARD_FIELDS if fields is None else fields
    columns = [F.col(c) if isinstance(c, str) else c for c in fields.values()]
    carried = feed.select("feed_seq", *[c.alias(name) for name, c in zip(fields, columns)])
    cards = first.join(carried.hint("merge"), F.col("_seq") == F.col("feed_seq"))
    return cards.select("match_key", *fields)


def asked_words(rows: DataFrame, row_key: str, words: int = ASKED_WORDS) -> Column:
    """A bitmap of the keys that rows ask for, as a scalar subquery over ``64 * words`` bits.

    It is computed when the plan runs, in one aggregate whose groups are bounded by ``words``.
    """
    word, bit = _place(F.col(row_key), words)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")
    asked = rows.filter(F.col(row_key).isNotNull()).groupBy(word.alias("word")).agg(bits)
    empty = rows.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long"))
    every = empty.toDF("word", "bits").unionByName(asked).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return every.agg(F.transform(ordered, lambda w: w["bits"])).scalar()


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """Word and bit of a key in a bitmap."""
    mark = F.xxhash64(key)
    return F.pmod(mark, F.lit(words)).cast("int"), F.pmod(F.shiftrightunsigned(mark, 40), F.lit(64)).cast("int")


def asked_keys(keyed: DataFrame, asked: Column, words: int = ASKED_WORDS) -> DataFrame:
    """Rows of ``keyed(match_key, ..)`` whose key may be among those of :func:`asked_words`.

    No asked key is lost; of the others one in a few passes once the bitmap is that full.
    """
    word, bit = _place(F.col("match_key"), words)
    return keyed.filter(F.bit_get(F.get(asked, word), bit) == 1)


def match_feed(
    rows: DataFrame, row_key: str, feed: DataFrame, fields=None, asked_only: bool = False
) -> DataFrame:
    """Left join on a match key; ``feed_hit`` tells whether a card answered.

    ``fields`` names the columns to carry along, as paths or expressions. Rows without a key are
    spread over the tasks by a hash of their own, under a kind of key that no card has. With
    ``asked_only`` the keys of the rows are read first and the feed's keys are cut down to them
    before they are aggregated: for few rows against a large feed. It reads the rows twice.
    """
    asked = asked_words(rows, row_key) if asked_only else None
    cards = expand_feed_keys(feed, fields, asked).withColumnRenamed("match_key", "_card_key")
    cards = cards.withColumn("feed_hit", F.lit(True))
    own = F.xxhash64(*rows.columns).cast("string")
    spread = rows.withColumn("_spread_key", F.coalesce(row_key, match_key("none", own, F.lit(""))))
    joined = lookup_join(spread, cards, "_spread_key", "_card_key").drop("_spread_key")
    return joined.withColumn("feed_hit", F.coalesce("feed_hit", F.lit(False)))


def _price(requests: DataFrame, feed: DataFrame, key: Column, needed: list[str]):
    blank = is_blank(needed[0])
    for name in needed[1:]:
        blank = blank | is_blank(name)
    fields = {name: CARD_FIELDS[name] for name in ("feed_usd", "feed_usd_foil")}
    asked = requests.filter(~blank).withColumn("_key", key)
    priced = match_feed(asked, "_key", feed, fields, asked_only=True)
    price = pick_price("foil", "feed_usd", "feed_usd_foil").alias("price")
    return priced.select(*requests.columns, price), requests.filter(blank)


def price_by_name(requests: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(card_name, set_code, foil) to a price or null; requests with blanks are turned away."""
    return _price(requests, feed, name_key("set_code", "card_name"), ["card_name", "set_code"])


def price_by_number(requests: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_code, card_number, foil) to a price or null; requests with blanks are turned away."""
    key = number_key("set_code", "card_number")
    return _price(requests, feed, key, ["set_code", "card_number"])


def identifier_key(name="name", set_code="set", number="collector_number") -> Column:
    """Key of an identifier of either shape: set and number, or name and set."""
    return F.when(F.col(number).isNotNull(), number_key(set_code, number)).otherwise(
        name_key(set_code, name)
    )


def card_lookup(identifiers: DataFrame, feed: DataFrame) -> DataFrame:
    """Identifiers with the whole card that answers, null when none does."""
    whole = {"card": F.struct(*[c for c in feed.columns if c != "feed_seq"])}
    asked = identifiers.withColumn("_key", identifier_key())
    found = match_feed(asked, "_key", feed, whole, asked_only=True)
    return found.select(*identifiers.columns, "card")


def not_found(identifiers: DataFrame, feed: DataFrame) -> DataFrame:
    """Identifiers no card answers to."""
    asked = identifiers.withColumn("_key", identifier_key())
    known = asked_keys(exploded_keys(feed), asked_words(asked, "_key")).select("match_key").distinct()
    return lookup_join(asked, known, "_key", "match_key", "left_anti").drop("_key")


def plan_lookup_batches(
    identifiers: DataFrame, order: list[Column], size: int = BATCH_SIZE
) -> DataFrame:
    """Identifiers in order, cut into request bodies of at most ``size``; nulls are left out."""
    numbered = with_ordinal(identifiers, order, "_no")
    one = F.struct("name", "set", "collector_number")
    batches = (
        numbered.withColumn("batch_id", F.floor((F.col("_no") - 1) / size))
        .groupBy("batch_id")
        .agg(F.sort_array(F.collect_list(F.struct("_no", one.alias("one")))).alias("_list"))
    )
    body = F.to_json(F.struct(F.col("_list.one").alias("identifiers")))
    count = F.size("_list").cast("long")
    return batches.select("batch_id", count.alias("identifiers"), body.alias("body"))
