import sys
import tempfile
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from curioledger import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A fresh folder below /tmp for files a test writes."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


class Tables:
    """Small tables from partial rows; columns not given are null."""

    def __init__(self, spark):
        self.spark = spark

    def frame(self, schema, rows):
        full = [tuple(row.get(name) for name in schema.names) for row in rows]
        return self.spark.createDataFrame(full, schema)

    def sets(self, *rows):
        return self.frame(schemas.CATALOG_SETS, rows)

    def holdings(self, *rows):
        base = {"foil": False, "quantity": 1, "language": "en"}
        return self.frame(schemas.HOLDINGS, [base | row for row in rows])

    def snapshots(self, *rows):
        base = {"foil": False, "quantity": 1, "language": "en"}
        return self.frame(schemas.HOLDING_SNAPSHOTS, [base | row for row in rows])

    def grid(self, *rows):
        return self.frame(schemas.GRID, rows)

    def feed(self, *cards):
        """Cards in feed order; ``usd`` and ``usd_foil`` stand for the nested prices."""
        schema = (
            "name string, set string, collector_number string, type_line string, layout string,"
            " prices struct<usd: string, usd_foil: string>, image_uris struct<png: string>,"
            " card_faces array<struct<name: string, image_uris: struct<png: string>>>,"
            " feed_seq long"
        )
        rows = []
        for seq, card in enumerate(cards):
            prices = None if card.get("no_prices") else (card.get("usd"), card.get("usd_foil"))
            png = (card["png"],) if "png" in card else None
            faces = card.get("faces")
            faces = None if faces is None else [("", None if p is None else (p,)) for p in faces]
            fields = ("name", "set", "collector_number", "type_line", "layout")
            rows.append((*[card.get(f) for f in fields], prices, png, faces, seq))
        return self.spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def make(spark):
    return Tables(spark)


def ts(text):
    return datetime.fromisoformat(text)


def money(text):
    return Decimal(text)


def column(df, name):
    return [row[name] for row in df.collect()]


def rows_of(df, *names):
    return [tuple(row[n] for n in names) for row in df.collect()]
