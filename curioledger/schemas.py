"""Explicit schemas of every table and feed; nothing is ever inferred."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(12, 2)


def _struct(**fields):
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def _strings(*names):
    return StructType([StructField(name, StringType()) for name in names])


CATALOG_SETS = _struct(
    set_code=StringType(),
    set_name=StringType(),
    release_date=DateType(),
    set_type=StringType(),
    card_count=IntegerType(),
    printed_size=IntegerType(),
    block_code=StringType(),
    block_name=StringType(),
    icon_svg_uri=StringType(),
)

HOLDINGS = _struct(
    id=LongType(),
    card_number=StringType(),
    card_name=StringType(),
    set_code=StringType(),
    set_name_raw=StringType(),
    foil=BooleanType(),
    card_type=StringType(),
    language=StringType(),
    quantity=IntegerType(),
    price=MONEY,
    comment=StringType(),
    location=StringType(),
)

HOLDING_SNAPSHOTS = StructType(
    HOLDINGS.fields
    + [
        StructField("source_card_id", LongType()),
        StructField("snapshot_ts", TimestampNTZType()),
    ]
)

TABLES = {
    "catalog_sets": CATALOG_SETS,
    "holdings": HOLDINGS,
    "holding_snapshots": HOLDING_SNAPSHOTS,
}

FEED_SET = _struct(
    code=StringType(),
    name=StringType(),
    released_at=StringType(),
    set_type=StringType(),
    card_count=IntegerType(),
    printed_size=IntegerType(),
    block_code=StringType(),
    block=StringType(),
    icon_svg_uri=StringType(),
)
SET_LIST = _struct(object=StringType(), has_more=BooleanType(), data=ArrayType(FEED_SET))

IMAGE_URIS = _strings("small", "normal", "large", "png", "art_crop", "border_crop")
CARD_FACE = _struct(name=StringType(), image_uris=IMAGE_URIS)
PRICES = _strings("usd", "usd_foil", "usd_etched", "eur", "eur_foil", "tix")
FEED_CARD = _struct(
    object=StringType(),
    id=StringType(),
    name=StringType(),
    set=StringType(),
    collector_number=StringType(),
    type_line=StringType(),
    lang=StringType(),
    rarity=StringType(),
    mana_cost=StringType(),
    oracle_text=StringType(),
    prices=PRICES,
    image_uris=IMAGE_URIS,
    layout=StringType(),
    card_faces=ArrayType(CARD_FACE),
)
IDENTIFIER = _strings("name", "set", "collector_number")
BATCH_REPLY = _struct(
    object=StringType(), data=ArrayType(FEED_CARD), not_found=ArrayType(IDENTIFIER)
)

# Spreadsheet columns A..K by position.
GRID_COLUMNS = {
    "a": "number",
    "b": "card",
    "c": "set",
    "d": "foil",
    "e": "type",
    "f": "quantity",
    "g": "price",
    "h": "total",
    "i": "comment",
    "j": "language",
    "k": "location",
}
# Columns whose cells may hold a number; beside the text, it is null for a cell of text.
NUMBER_COLUMNS = ("a", "f", "g")
GRID = StructType(
    [StructField("sheet", StringType()), StructField("row_no", LongType())]
    + [StructField(letter, StringType()) for letter in GRID_COLUMNS]
    + [StructField(f"{letter}_num", DoubleType()) for letter in NUMBER_COLUMNS]
)
