"""Personal data by weak supervision.

Regular expressions propose spans, tight ones and loose ones. Five labelers vote on every proposal:
its checksum or range, its shape, a gazetteer, its borders, and the words before it; a labeler may
abstain. Expectation maximisation over the counts of vote patterns estimates how reliable each
labeler is for each kind. The posteriors train a logistic classifier over votes and span features,
which decides on the proposals that the base rules leave out; base spans always stay.

Patterns and features are discrete, so both models are fitted on one table of counts over all
proposals, whose size has a bound that does not depend on the data.
"""

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .spans import SPAN, joined, located, matches

KINDS = ["email", "ip", "card", "phone"]

# The base rules, and looser shapes that find what they miss: addresses spelled out, full IPv6
# addresses, and numbers that a base match has run together with their neighbours.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++"
    r"(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}"
    r"|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})"
    r"(?:[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[\x20.-]?[0-9]{6,8})(?![0-9])"
    r"|(?<![0-9A-Za-z+.(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}

# Gazetteers of domains, card issuers, reserved networks, and words that go before.
_DOMAINS = r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|it|nl)$"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|36|38)"
_RESERVED = r"^(?:0|127|255|22[4-9]|23[0-9])\."
_CALLING = r"^\D*(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_WORDS_FOR = r"(?i)(?:mail|contact|write|tel|phone|call|fax|mobile|card|visa|credit|ip|addr\w*|host|server|from|to)\W{0,3}$"
_WORDS_AGAINST = r"(?i)(?:version|ver|v|isbn|issn|order|sku|section|no|nr|id|token|password|build|release)\W{0,3}$"

CONTEXT = 24
VOTES = 5
ROUNDS = 60

_BASE = "array<struct<rank:int,start:int,end:int>>"
_PROPOSED = "array<struct<rank:int,start:int,end:int,valid:boolean,votes:string,features:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the checksum; only asked of short ones."""
    turned = F.reverse(digits)

    def step(total: Column, place: Column) -> Column:
        d = F.substring(turned, place, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(place % 2 == 0, twice).otherwise(d)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _in_range(hit: Column) -> Column:
    """Dotted parts of at most 255, leading zeros aside."""

    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        number = F.when(short == "", 0).otherwise(F.substring(short, 1, 3).cast("int"))
        return (F.length(short) <= 3) & (number <= 255)

    return F.forall(F.split(hit, r"\."), small)


def base_valid(kind: str, hit: Column) -> Column:
    """What a base match must pass."""
    count = F.length(_digits(hit))
    if kind == "ip":
        return _in_range(hit)
    if kind == "card":
        return F.when(count.between(13, 19), luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """One letter: y, n, or a dash for an abstention."""
    if no is None:
        return F.when(yes, "y").otherwise("n")
    return F.when(yes, "y").when(no, "n").otherwise("-")


def _proposal(rank: int, kind: str, text: Column, span: Column) -> Column:
    hit, start, end = span["hit"], span["start"], span["end"]
    before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    after = F.substring(text, end + 1, F.lit(2))
    digits = _digits(hit)
    if kind == "ip":
        valid = F.when(F.contains(hit, F.lit(":")), F.lit(True)).otherwise(_in_range(hit))
    else:
        valid = base_valid(kind, hit)
    shape = {
        "email": _vote(F.length(hit).between(6, 254)),
        "ip": _vote(~F.rlike(hit, F.lit(r"(?:^|\.)0[0-9]"))),
        "card": _vote(F.rlike(hit, F.lit(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"))),
        "phone": _vote(F.rlike(hit, F.lit(r"^(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,5}$"))),
    }[kind]
    gazetteer = {
        "email": _vote(F.rlike(F.substring(hit, -16, 16), F.lit(_DOMAINS)), F.lit(False)),
        "ip": _vote(F.lit(False), F.rlike(hit, F.lit(_RESERVED))),
        "card": _vote(F.rlike(digits, F.lit(_ISSUERS))),
        "phone": _vote(F.rlike(hit, F.lit(r"^(?:\+|00)")) & F.rlike(F.regexp_replace(hit, "^00", ""), F.lit(_CALLING)), F.lit(False)),
    }[kind]
    glued = F.rlike(before, F.lit(r"[\p{L}0-9_]$")) | F.rlike(after, F.lit(r"^[\p{L}0-9_]"))
    borders = _vote(~glued)
    words = _vote(F.rlike(before, F.lit(_WORDS_FOR)), F.rlike(before, F.lit(_WORDS_AGAINST)))
    size = F.least(F.length(hit) / 8, F.lit(4)).cast("int").cast("string")
    opens = F.when(F.rlike(before, F.lit(r"(?:^|\s)$")), "s").when(F.rlike(before, F.lit(r"\p{L}$")), "l").otherwise("o")
    closes = F.when(F.rlike(after, F.lit(r"^(?:\s|$)")), "s").when(F.rlike(after, F.lit(r"^\p{L}")), "l").otherwise("o")
    parted = F.when(F.rlike(hit, F.lit(r"[\x20()-]")), "p").otherwise("w")
    return F.struct(
        F.lit(rank).alias("rank"),
        start.alias("start"),
        end.alias("end"),
        valid.alias("valid"),
        F.concat(_vote(valid), shape, gazetteer, borders, words).alias("votes"),
        F.concat(size, opens, closes, parted).alias("features"),
    )


def _base_of(rank: int, kind: str) -> Column:
    passed = F.filter(f"b_{kind}", lambda s: base_valid(kind, s["hit"]))
    return F.transform(
        passed,
        lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")),
    )


def _proposed_of(rank: int, kind: str) -> Column:
    both = F.array_distinct(F.concat(f"b_{kind}", f"l_{kind}"))
    return F.transform(both, lambda s: _proposal(rank, kind, F.col("text"), s))


def proposals(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, proposed)`` of every row: base spans, and all spans voted on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cues = {"email": F.contains("text", F.lit("@")) | F.rlike("text", F.lit(r"(?i)[\[(]at[\])]"))}
    some_digits = F.rlike("text", F.lit(r"[0-9]")) | F.contains("text", F.lit(":"))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", text.alias("text")).withColumn("digits", some_digits)
    for kind in KINDS:
        cue = cues.get(kind, F.col("digits"))
        for name, pattern in (("b", BASE[kind]), ("l", LOOSE[kind])):
            found = F.when(cue, matches(F.col("text"), pattern)).otherwise(none)
            rows = rows.withColumn(f"{name}_{kind}", found)
    placed = [
        F.when(F.size(f"{name}_{kind}") > 0, located(F.col("text"), pattern, F.col(f"{name}_{kind}")))
        .otherwise(F.array().cast(SPAN))
        .alias(f"{name}_{kind}")
        for kind in KINDS
        for name, pattern in (("b", BASE[kind]), ("l", LOOSE[kind]))
    ]
    rows = rows.select("doc_id", "text", *placed)
    base, proposed = [], []
    for rank, kind in enumerate(KINDS):
        base.append(_base_of(rank, kind))
        proposed.append(_proposed_of(rank, kind))
    return rows.select(
        "doc_id",
        F.concat(*base).cast(_BASE).alias("base"),
        F.concat(*proposed).cast(_PROPOSED).alias("proposed"),
    )


def reliabilities(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior of each vote pattern: two-class expectation maximisation over pattern counts.

    Each labeler has its own rate of yes among true and among false spans, of those it votes on.
    Eight right and two wrong votes are added to each, which names the classes and steadies small
    tables.
    """
    share = 0.5
    right = [[0.8, 0.2] for _ in range(VOTES)]
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for votes in counts:
            score = math.log(share / (1 - share))
            for labeler, vote in enumerate(votes):
                yes, no = right[labeler]
                if vote == "y":
                    score += math.log(yes / no)
                elif vote == "n":
                    score += math.log((1 - yes) / (1 - no))
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        total = sum(counts.values())
        share = (sum(n * posterior[v] for v, n in counts.items()) + 1) / (total + 2)
        for labeler in range(VOTES):
            cast = [(n, posterior[v], v[labeler]) for v, n in counts.items() if v[labeler] != "-"]
            true = sum(n * p for n, p, _ in cast)
            false = sum(n * (1 - p) for n, p, _ in cast)
            yes_true = sum(n * p for n, p, vote in cast if vote == "y")
            yes_false = sum(n * (1 - p) for n, p, vote in cast if vote == "y")
            right[labeler] = [(yes_true + 8) / (true + 10), (yes_false + 2) / (false + 10)]
    return posterior


def _named(votes: str, features: str) -> list[str]:
    """The active features of a span."""
    return ["bias"] + [f"v{k}{x}" for k, x in enumerate(votes)] + [f"f{k}{x}" for k, x in enumerate(features)]


def classifier(rows: Iterable[tuple[str, str, int, float]], rounds: int = 300) -> dict[str, float]:
    """Logistic weights of features, fitted to the posteriors of counted spans."""
    rows = [(_named(v, f), n, p) for v, f, n, p in rows]
    total = sum(n for _, n, _ in rows) or 1
    weights = {name: 0.0 for names, _, _ in rows for name in names}
    seen = {name: 1e-9 for name in weights}
    for _ in range(rounds):
        slope = {name: 0.001 * w for name, w in weights.items()}
        for names, n, p in rows:
            score = sum(weights[name] for name in names)
            error = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - p)
            for name in names:
                slope[name] += error
        for name, g in slope.items():
            seen[name] += g * g
            weights[name] -= 0.5 * g / math.sqrt(seen[name])
    return weights


def _score(weights: dict[str, dict[str, float]], span: Column) -> Column:
    """The classifier's score of a span, as an expression over its votes and features."""
    known = F.create_map(*[
        F.lit(x)
        for kind, own in weights.items()
        for name, w in own.items()
        for x in (f"{KINDS.index(kind)}{name}", w)
    ])
    rank = span["rank"].cast("string")
    names = [F.concat(rank, F.lit("bias"))]
    names += [F.concat(rank, F.lit(f"v{k}"), F.substring(span["votes"], k + 1, 1)) for k in range(VOTES)]
    names += [F.concat(rank, F.lit(f"f{k}"), F.substring(span["features"], k + 1, 1)) for k in range(4)]
    total = F.lit(0.0)
    for name in names:
        total = total + F.coalesce(F.element_at(known, name), F.lit(0.0))
    return total


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs(doc_id, text)``.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: the base spans counted
    and hashed, and all spans as ``kind:start:end``, by kind, then start. A span is added where its
    checksum or range holds, the classifier is for it, and no base span of its kind overlaps it. A
    null text is an empty one; both have no spans. Repeated rows and null ids each come back; an
    empty table gives no rows and fits no model. Other columns are not read.
    """
    rows = settle(proposals(docs))
    spans = rows.select(F.explode("proposed").alias("s"))
    counts = spans.groupBy("s.rank", "s.votes", "s.features").count().collect()
    weights: dict[str, dict[str, float]] = {}
    for rank, kind in enumerate(KINDS):
        own = sorted((r["votes"], r["features"], r["count"]) for r in counts if r["rank"] == rank)
        patterns: dict[str, int] = {}
        for votes, _, n in own:
            patterns[votes] = patterns.get(votes, 0) + n
        if patterns:
            posterior = reliabilities(patterns)
            weights[kind] = classifier((v, f, n, posterior[v]) for v, f, n in own)

    added = F.filter("proposed", lambda s: s["valid"]) if weights else F.slice("proposed", 1, 0)
    if weights:
        added = F.filter(added, lambda s: _score(weights, s) >= 0)
    plain = F.transform(
        added,
        lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")),
    )
    apart = F.filter(
        plain,
        lambda s: ~F.exists(
            "base",
            lambda b: (b["rank"] == s["rank"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]),
        ),
    )
    every = F.array_sort(F.array_distinct(F.concat("base", apart)))

    def counted(rank: int) -> Column:
        return F.size(F.filter("base", lambda b: b["rank"] == rank)).cast("long")

    return rows.select(
        "doc_id",
        *[counted(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)],
        F.sha2(joined(F.array_sort("base"), KINDS), 256).alias("base_sha256"),
        joined(every, KINDS).alias("spans"),
    )
