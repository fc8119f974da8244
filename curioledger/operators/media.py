"""Where the pictures of the holdings are and under which names to keep them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cards import face_count, number_key, object_key, png_url
from ..functions.text import is_blank
from ..plans.joins import lookup_join
from .holdings import with_set_name
from .lookups import match_feed

DEFAULT_LAYOUT = "normal"


def image_manifest(
    holdings: DataFrame,
    sets: DataFrame,
    feed: DataFrame,
    face: int = 0,
    cached: DataFrame | None = None,
) -> DataFrame:
    """Per row: object key, picture location, face count, layout, and whether it can be fetched.

    Rows whose ``object_key`` is among the ``cached`` ones need no fetching.
    """
    pictures = {
        "_png": png_url(face),
        "_faces": face_count(),
        "_layout": F.col("layout"),
    }
    usable = ~is_blank("set_code") & ~is_blank("card_number")
    rows = holdings.select("id", "card_name", "set_code", "card_number")
    rows = rows.withColumn("_key", F.when(usable, number_key("set_code", "card_number")))
    matched = match_feed(with_set_name(rows, sets), "_key", feed, pictures)
    key = object_key("set_name", "set_code", "card_number", "card_name", face)
    status = (
        F.when(is_blank("set_code"), "no_set_code")
        .when(is_blank("card_number"), "no_collector_number")
        .when(~F.col("feed_hit"), "card_not_found")
        .when(F.col("_png").isNull(), "no_picture")
        .otherwise("ok")
    )
    manifest = matched.select(
        "id",
        F.when(usable, key).alias("object_key"),
        F.col("_png").alias("png_url"),
        F.coalesce("_faces", F.lit(1)).alias("face_count"),
        F.coalesce("_layout", F.lit(DEFAULT_LAYOUT)).alias("layout"),
        status.alias("status"),
    )
    if cached is None:
        return manifest
    held = cached.select(F.col("object_key").alias("_held")).distinct().withColumn("_hit", F.lit(True))
    flagged = lookup_join(manifest, held, "object_key", "_held")
    held_already = F.when(F.col("_hit"), "cached").otherwise(F.col("status"))
    return flagged.withColumn("status", held_already).select(manifest.columns)
