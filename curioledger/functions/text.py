"""String normalisation, blank tests and natural ordering."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters each trimming rule removes.
CONTROL_AND_SPACE = "".join(chr(code) for code in range(0x21))
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
    "\u2028\u2029\u205f\u3000"
)
FORM_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# A run length is written in front of every digit run so that text order is numeric order.
_LENGTH_DIGITS = 10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell_trim(c) -> Column:
    """Strip control characters and spaces (up to U+0020) from both ends."""
    return F.btrim(_col(c), F.lit(CONTROL_AND_SPACE))


def form_trim(c) -> Column:
    """Strip what a web form strips, non-breaking spaces included."""
    return F.btrim(_col(c), F.lit(FORM_SPACE))


def norm(c) -> Column:
    """Join-key form of a text: null becomes '', trimmed, lower case."""
    return F.coalesce(F.lower(cell_trim(c)), F.lit(""))


def is_blank(c) -> Column:
    """Null, empty or whitespace only; never null itself."""
    return F.coalesce(F.btrim(_col(c), F.lit(WHITESPACE)) == "", F.lit(True))


def blank_to_null(c) -> Column:
    return F.when(~is_blank(c), _col(c))


def natural_key(c) -> Column:
    """Case-insensitive key in which digit runs of any length order by their value."""

    def encode(run):
        digits = F.regexp_replace(run, r"^0+(?=[0-9])", "")
        width = F.lpad(F.length(digits).cast("string"), _LENGTH_DIGITS, "0")
        return F.when(run.rlike("^[0-9]"), F.concat(width, digits)).otherwise(run)

    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, encode), "")


def collation_key(c) -> Column:
    """Sort form of a text: natural order, ignoring case and accents, by Unicode rules."""
    return F.collate(natural_key(c), "UNICODE_CI_AI")
