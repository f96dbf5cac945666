import pytest
from pyspark.sql import functions as F

from evidentia.functions import privacy
from evidentia.functions.text import nfkc
from evidentia.operators import privacy as scan

ALLOWED = "desk@corp.example"
STREET = "7 Willow Lane"
# One group for each kind of detail: numbers with a country code, bare and labelled numbers, mail, places, accounts.
HITS = [
    "+49 1512 3456789", "phone: +1 415 555 0134", "☎ +33 (0) 61-2345-6781",
    "15912345678", "159 1234 5678", "021 6455 0142", "☎ (303) 555-0142", "电话 021-765-4321",
    "email: jo.doe@mailbox.test", "x" + ALLOWED, ALLOWED + ".evil.test",
    "address: PRIVATE_ADDRESS", f"Home address: {STREET}", "Home address: 250 Harbour Road",
    "Post it to 31 Maple Avenue, Springhill", "联系地址：云海市北山区松林路 6 号",
    f"IP address: 198.51.100.7; Home address: {STREET}", "address bus width: 32-bit; 住址：云海市白鹭街 3 号",
    "QQ：7654321",
]
# The same digit shapes where a label says that they are something else.
MISSES = [
    f"Mail {ALLOWED}.", ALLOWED.upper(), "Roadmap 2018-2022", "Date: 2024-03-09", "Size 900 x 210 x 45 mm",
    "Dimensions: 900-210-045 mm", "Part ZK-4410; sheet 3 of 17", "Serial: (303) 555-0142", "Model: 021-6455-0142",
    "Product code: 159 1234 5678", "Artifact ID: 321-654-0987-B", "Page range: 000-765-4321",
    "IP address: 198.51.100.7", "memory address: 0x10ab22cd", "address bus width: 32-bit",
]


def _flags(spark, texts, column):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(column(nfkc(F.col("t")))).collect()]


def test_hits_and_misses(spark):
    flags = _flags(spark, HITS + MISSES, lambda c: privacy.has_private(c, [ALLOWED]))
    assert [t for t, f in zip(HITS + MISSES, flags) if f] == HITS


def test_label_must_end_within_forty_characters(spark):
    near, far = "date" + " " * 30 + "021 6455 0142", "date" + " " * 41 + "021 6455 0142"
    flags = _flags(spark, [near, far], lambda c: F.size(privacy.local_phone_hits(c)) > 0)
    assert flags == [False, True]


def test_second_candidate_on_a_line_sees_its_own_prefix(spark):
    text = "Serial: (303) 555-0142 or 021 6455 0142"
    assert _flags(spark, [text], privacy.local_phone_hits) == [["021 6455 0142"]]


def test_redaction_leaves_nothing_to_find(spark):
    mixed = HITS + MISSES + [f"Reach {ALLOWED} or n@o.example, ring +1 415 555 0134"]
    cleaned = _flags(spark, mixed, lambda c: privacy.redact(c, [ALLOWED]))
    assert ALLOWED in cleaned[-1] and "n@o" not in cleaned[-1]
    assert not any(_flags(spark, cleaned, lambda c: privacy.has_private(c, [ALLOWED])))


def test_secrets(spark):
    texts = ["k sk-abcdefghij0123456789XY", "sk-short", "has hunter2hunter2 inside", "clean"]
    found = _flags(spark, texts, lambda c: privacy.secret_hits(c, ["hunter2hunter2", "short"]))
    assert found == [["sk-abcdefghij0123456789XY"], [], ["hunter2hunter2"], []]


def test_leak_scan_cuts_no_text_per_candidate(spark):
    """Anchors carry their position, so the join of candidates and texts only compares stretches."""
    texts = spark.createDataFrame([(1, "  one two three four five"), (2, "one two"), (3, None)], "id int, t string")
    values = spark.createDataFrame([(" two three four ",), ("one two three four five",), ("ee",)], "value string")
    found = scan.leak_scan(texts, values, "id", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp" not in plan
    assert found.groupBy("id").count().collect() == [(1, 3)]
