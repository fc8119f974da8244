"""Line-first cleaning: rules judge lines, failing lines go, and a text that loses too much goes too.

A line fails when it is mostly navigation, boilerplate, symbols, shouting or one word over and over,
when it ends without punctuation and is too short for a sentence, or when it repeats an earlier
line. What is left is the cleaned text. A document is kept while the lines left hold ``LEAST_SHARE``
of the characters of its words.
"""

import re
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SHARE = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50
SHORT_LINE = 8
MOST_SYMBOLS = 0.1
MOST_BARS = 0.15
MOST_SHOUTED = 0.6
MOST_ONE_WORD = 0.3

# Symbols that are counted, separators of menus, ends of sentences, phrases of pages.
SYMBOLS = "#*$%&|<>"
BARS = "|»«›‹•·>"
ENDS = ".!?…:;。！？"
CLOSERS = "\"'”’)]}»"
WHITE = " \t\n\r\x0b\x0c"
PHRASES = re.compile(
    r"cookie policy|uses cookies|privacy policy|terms of (?:use|service)|all rights reserved"
    r"|enable javascript|lorem ipsum|sign in|log in|sign up|subscribe|click here|read more"
    r"|share this|back to top|skip to content|copyright ©|©",
    re.IGNORECASE,
)
SHORT_PHRASE_LINE = 30
MANY_WORDS = 65_536


def _repeated_of_many(words: list[bytes]) -> int:
    """The same for a very long text, in a few machine words for each of its own."""
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # Pairs get numbers below that of the words, so a window's number fits as well.
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, windows, seen = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = seen[windows] > 1
    covered = np.zeros(len(words), bool)
    for place in range(3):
        covered[place : place + len(twice)] |= twice
    return int(covered.sum())


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that come twice or more."""
    if len(words) > MANY_WORDS:
        return _repeated_of_many(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = 0
    end = 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def line_fails(line: str, words: list[bytes], earlier: set[bytes], whole: bytes) -> bool:
    """Whether a line with words goes; ``earlier`` holds the lines before it."""
    if whole in earlier:
        return True
    chars = len(line) - sum(map(line.count, WHITE))
    if sum(map(line.count, SYMBOLS)) > MOST_SYMBOLS * chars:
        return True
    if sum(map(line.count, BARS)) > MOST_BARS * len(words):
        return True
    if len(words) <= SHORT_PHRASE_LINE and PHRASES.search(line):
        return True
    if len(words) >= 5:
        if line == line.upper() and line != line.lower():
            return True
        upper = sum(1 for w in words if w.isupper() and len(w) > 1)
        if upper > MOST_SHOUTED * len(words):
            return True
        if max(Counter(words).values()) > max(3, MOST_ONE_WORD * len(words)):
            return True
    ended = line.rstrip(WHITE).rstrip(CLOSERS)[-1:]
    return len(words) < SHORT_LINE and (not ended or ended not in ENDS)


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str | None]:
    """Counts of a text, its verdicts, and what is left of it; a null text has no words."""
    text_ = text or ""
    data = text_.encode("utf-8", "surrogatepass")
    words = data.split()
    word_chars = len(text_) - sum(map(text_.count, WHITE))
    symbols = sum(map(text_.count, SYMBOLS))
    repeats = repeated(words)
    seen: set[bytes] = set()
    doubled = left = 0
    kept_lines = []
    for whole, line in zip(data.split(b"\n"), text_.split("\n"), strict=True):
        own = whole.split()
        if not own:
            kept_lines.append(line)
            continue
        doubled += whole in seen
        if not line_fails(line, own, seen, whole):
            kept_lines.append(line)
            left += len(line) - sum(map(line.count, WHITE))
        seen.add(whole)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
    kept = not failed and left >= LEAST_SHARE * word_chars
    clean = None if text is None else "\n".join(kept_lines)
    return len(words), word_chars, symbols, doubled, repeats, failed, kept, clean


_KINDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, clean_text string"
)
_NAMES = [kind.split()[0] for kind in _KINDS.split(",")]


def _judged(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(t) for t in texts], columns=_NAMES)


def _counted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(t)[:-1] for t in texts], columns=_NAMES[:-1])


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdicts of every row of ``docs(doc_id, text)``, by its whole text.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept``. Null and empty texts have no words and fail; repeated rows and null ids each come back;
    an empty table gives no rows. Other columns are not read.
    """
    kinds = _KINDS.rsplit(",", 1)[0]
    return docs.select("doc_id", F.pandas_udf(_counted, kinds)(F.col("text")).alias("v")).select("doc_id", "v.*")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, with the lines that fail taken out.

    Null and empty texts go; repeated rows and null ids go or stay by their text; very long texts are
    cleaned whole; n_chars is in step; an empty table stays empty.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.pandas_udf(_judged, _KINDS)(docs["text"]).alias("v")).filter("v.kept")
    new = {"text": F.col("v.clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("v.clean_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
