"""Personal data and secrets against plain regular expressions."""

import dataclasses
import hashlib
import random

from . import brute
import pytest
from pyspark.sql import functions as F

from curioledger.llm import pii, secret_scan
from curioledger.plans.lineage import scratch_path

PARTS = (
    "a @ . b.c + 1 12 255 256 4111111111111111 - ( ) é 😀 _ % +1·(555)·555-0100 x@y.z 1.2.3.4 token ="
    " \" : password abcdef AKIA A1B2C3D4E5F6G7H8 0123456789abcdef TOKEN api_key secret K"
).split(" ")


def texts():
    rng = random.Random(11)
    made = ["".join(rng.choice([*PARTS, " "]) for _ in range(rng.randrange(14))) for _ in range(400)]
    made = [t.replace("·", " ") for t in made]
    long = ["1" * 50_000, "a" * 50_000, "a." * 20_000 + "@b" + ".c" * 20_000, "1 " * 20_000]
    return [*made, *long, "+" + "1" * 20_000, "toKen=abcdef token=KK", None, "", "x@y.z " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


@pytest.mark.parametrize(
    "operator, plain", [(pii.find_personal_data, brute.personal), (secret_scan.find_secrets, brute.secrets)]
)
def test_base_spans(docs, operator, plain):
    found = {r["doc_id"]: r for r in operator(docs).collect()}
    for key, text in enumerate(texts()):
        spans = plain(text)
        digest = hashlib.sha256(brute.joined(spans).encode()).hexdigest()
        assert found[key]["base_sha256"] == digest, text
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found[key]["spans"].split(",")) | {""}


@pytest.mark.parametrize("operator", [pii.find_personal_data, secret_scan.find_secrets])
def test_odd_tables(odd_docs, operator):
    rows = operator(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["spans"] == "" for r in rows if r["doc_id"] in (1, 2, 3, 13))
    assert operator(odd_docs.limit(0)).count() == 0


def test_number_hidden_in_a_run_is_added(spark):
    lines = [f"pay {4111111111111111} to me {k}" for k in range(40)]
    hidden = "from 10.9.8.127 4111111111111111 on"
    phone = "ring +1 (555) 555-0100 4111111111111111 on"
    docs = spark.createDataFrame(list(enumerate([*lines, hidden, phone])), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert found[40]["n_card"] == 0 and f"card:{hidden.index('4111')}:" in found[40]["spans"]
    assert found[41]["n_phone"] == 0 and f"phone:{phone.index('+1')}:" in found[41]["spans"]


def test_labelers_are_weighed():
    posterior = pii.reliabilities({"yyyyy": 900, "nyyyy": 20, "nnnny": 60, "nnnn-": 20})
    assert posterior["yyyyy"] > 0.95 > 0.05 > posterior["nnnn-"]
    weights = pii.classifier([(v, "3ssw", 10, p) for v, p in posterior.items()])
    assert all(abs(w) < 100 for w in weights.values())


def test_only_unseen_pairs_are_scanned(spark):
    ledger = scratch_path(spark, "ledger")
    first = spark.createDataFrame([("p", "token=abcdef"), ("q", "token=abcdef"), ("r", None)], "doc_id string, text string")
    rules = secret_scan.RULES
    assert secret_scan.scan_new(first, ledger, rules) == 2
    assert secret_scan.scan_new(first, ledger, rules) == 0
    more = first.union(spark.createDataFrame([("p", "gone"), ("s", "token=abcdef")], first.schema))
    assert secret_scan.scan_new(more, ledger, rules) == 1
    newer = (*rules, secret_scan.Rule("gone", 1, "gone"))
    assert secret_scan.scan_new(more, ledger, newer) == 3
    rows = spark.read.schema(secret_scan.LEDGER).parquet(ledger)
    pairs = rows.select("blob", F.explode("rules").alias("rule"))
    assert pairs.count() == pairs.distinct().count() == 3 * len(newer)
    found = secret_scan.findings(more, ledger, rules=newer).collect()
    assert sorted((r["doc_id"], len(r["found"])) for r in found) == [("p", 1), ("p", 1), ("q", 1), ("r", 0), ("s", 1)]


def test_a_kept_ledger_outlives_its_rules(spark):
    """Raised versions, another order and dropped rules on a ledger that has the old spans."""
    ledger = scratch_path(spark, "ledger")
    text = "token=abcdef " + "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, text), (2, "clean")], "doc_id long, text string")
    rules = secret_scan.RULES
    secret_scan.scan_new(docs, ledger, rules)

    def spans(asked):
        rows = secret_scan.findings(docs, ledger, rules=asked).filter("doc_id = 1").first()["found"]
        return [(s["start"], asked[s["rank"]].name, s["end"]) for s in rows]

    expected = [(0, "assign", 12), (13, "hex", 45)]
    assert spans(rules) == expected
    newer = tuple(dataclasses.replace(r, version=2) if r.name == "hex" else r for r in rules)
    # Until it has scanned, a new version has found nothing, and the old one is no stand-in.
    assert spans(newer) == expected[:1]
    assert secret_scan.scan_new(docs, ledger, newer) == 2
    assert spans(newer) == spans(rules) == expected
    turned = newer[::-1]
    assert secret_scan.scan_new(docs, ledger, turned) == 0
    assert spans(turned) == expected
    assert spans(tuple(r for r in newer if r.name != "hex")) == expected[:1]


def test_secrets_are_masked(odd_docs):
    masked = secret_scan.without_secrets(odd_docs)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    texts = {r["doc_id"]: r for r in masked.collect()}
    assert texts[10]["text"] == f'{secret_scan.MASK}" é😀 {secret_scan.MASK}'
    assert texts[10]["n_chars"] == len(texts[10]["text"])
    assert texts[12]["text"] == "😀" * 70 + " " + secret_scan.MASK
    assert texts[1]["text"] is None and texts[13]["text"] == "one two three"
