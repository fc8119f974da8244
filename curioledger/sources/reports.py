"""File outputs: enriched grid, report of unresolved rows, movers export."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snapshots import export_projection, mover_order
from ..plans.lineage import settle

# Headings of the two reports and the suffix of a processed grid.
UNRESOLVED_HEADINGS = ["Aba", "Linha", "Number", "Card", "Set", "Foil", "Motivo"]
MOVERS_HEADINGS = [
    "#",
    "Carta",
    "Coleção",
    "Set Code",
    "Foil",
    "Idioma",
    "Preço Anterior (USD)",
    "Preço Atual (USD)",
    "Variação (USD)",
]
GAINERS_NAME = "Valorizaram"
LOSERS_NAME = "Desvalorizaram"
PROCESSED_SUFFIX = "-processado"
UNNAMED_GRID = "colecao-importada"

# Rows of a file at most: a text with line breaks in it is read back by one task a file.
FILE_ROWS = 250_000


def processed_name(original: str | None) -> str:
    """Name of the enriched copy of a grid: its name without extension plus a suffix."""
    if original is None or not original.strip():
        return UNNAMED_GRID
    stem, dot, _ = original.rpartition(".")
    return (stem if dot and stem else original) + PROCESSED_SUFFIX


def write_enriched_grid(
    grid: DataFrame, folder: str, original: str | None = None, fmt: str = "parquet"
) -> str:
    path = f"{folder}/{processed_name(original)}"
    grid.write.format(fmt).save(path)
    return path


def _write_csv(df: DataFrame, path: str) -> None:
    """Text under display headings, blanks kept as they are, quotes doubled as spreadsheets do.

    A task's rows go on in further files, in order by name, when they are more than ``FILE_ROWS``.
    """
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', maxRecordsPerFile=FILE_ROWS, **keep).csv(path)


def write_unresolved(report: DataFrame, path: str) -> bool:
    """Write the report, sorted, under its headings; nothing is written when it is empty."""
    report = settle(report)
    if report.isEmpty():
        return False
    _write_csv(report.orderBy("sheet", "row_no").toDF(*UNRESOLVED_HEADINGS), path)
    return True


def export_movers(movers: DataFrame, folder: str) -> None:
    """Both full mover lists, numbered, as two outputs; ``movers`` is computed once."""
    movers = settle(movers)
    for name, side in ((GAINERS_NAME, "gainer"), (LOSERS_NAME, "loser")):
        rows = movers.filter(F.col("side") == side)
        numbered = export_projection(rows, mover_order(side)).orderBy("row_no")
        _write_csv(numbered.toDF(*MOVERS_HEADINGS), f"{folder}/{name}")
