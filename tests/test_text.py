import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text


def test_index_terms(evaluate):
    assert evaluate(text.build_terms, "智能交互 AI Product") == ["智能", "能交", "交互", "ai", "product"]
    assert evaluate(text.build_terms, "LAMPSeat，系统思考!") == ["lampseat", "系统", "统思", "思考"]
    assert evaluate(text.build_terms, "it's well-known 人 élève well-known") == [
        "it's", "well-known", "人", "l", "ve"]
    assert evaluate(text.build_terms, "") == []


def test_query_normalization_and_terms(evaluate):
    raw = " ＬＡＭＰＳＥＡＴ，lampseat！ 是什么 "
    normalized = evaluate(text.normalize_query, raw)
    assert normalized == "lampseat lampseat 是什么"
    assert evaluate(lambda c: text.build_query_terms(text.normalize_query(c)), raw) == [
        "lampseat", "是什", "什么"]
    assert evaluate(text.normalize_query, "ai人机a") == "ai 人机 a"
    assert evaluate(text.build_query_terms, "人 ai") == ["ai"]


def test_stop_terms(evaluate):
    assert evaluate(lambda c: text.search_terms(text.build_terms(c)), "What is the lamp 什么灯") == [
        "lamp", "么灯"]


def test_normalizers(evaluate):
    assert evaluate(text.normalize_text, "  Ａ 　b\n\tc ") == "A b c"
    assert evaluate(text.normalize_text, "café ﬁn") == "café fin"
    assert evaluate(text.normalize_phrase, "Ａ-b C. 9") == "abc9"
    assert evaluate(text.unique_key, "  …Systém。 1+1 ") == "systém11"
    assert evaluate(text.term_key, "　 Ink　Seat ") == "ink seat"


def test_visible_and_caps(evaluate):
    assert evaluate(text.has_visible, "​ ⁠") is False
    assert evaluate(text.has_visible, " x ") is True
    assert evaluate(text.cp_length, "😀a") == 2
    assert evaluate(lambda c: text.cp_cap(c, 1), "😀a") == "😀"


def test_visitor_key_is_hmac(evaluate):
    for salt in ("s" * 32, "盐" * 30):
        expected = hmac.new(salt.encode(), "session:é1".encode(), hashlib.sha256).hexdigest()
        assert evaluate(lambda c: text.visitor_key(c, salt), "session:é1") == expected
    assert evaluate(lambda c: text.visitor_key(c, "s" * 32), "") is None
    with pytest.raises(ValueError):
        text.visitor_key(F.lit("x"), "short")


def test_stable_json(spark):
    schema = "r struct<b:int,a:struct<z:string,y:int>,m:map<string,int>,l:array<struct<d:int,c:int>>>"
    frame = spark.createDataFrame([((None, ("q", 1), {"k": 2, "a": 1}, [(1, 2)]),)], schema)
    value = frame.select(text.stable_json(F.col("r"), frame.schema["r"].dataType)).first()[0]
    assert value == '{"a":{"y":1,"z":"q"},"l":[{"c":2,"d":1}],"m":{"a":1,"k":2}}'


@pytest.mark.parametrize("month", [1, 7])
def test_day_window(spark, month):
    local = dt.timezone(dt.timedelta(hours=8))
    last = int(dt.datetime(2026, month, 5, 23, 59, 59, 999000, local).timestamp() * 1000)
    row = spark.range(1).select(text.day_window(F.lit(last)).alias("d")).first()["d"]
    assert (row["day_key"], row["reset_at"]) == (f"2026-{month:02d}-05", last + 1)
    row = spark.range(1).select(text.day_window(F.lit(last + 1)).alias("d")).first()["d"]
    assert row["day_key"] == f"2026-{month:02d}-06"


def test_internal_href(evaluate):
    good = ["#about", "/documents/a.pdf", "a/b?x=1:2", "/%20x"]
    bad = ["//x.test", "http://x.test", "mailto:a@b.c", "/a\\b", " /a", "/a　", "/a%0d", "/a%5Cb", "/a\tb"]
    assert [evaluate(text.is_internal_href, v) for v in good] == [True] * len(good)
    assert [evaluate(text.is_internal_href, v) for v in bad] == [False] * len(bad)


def test_sentence_boundary(evaluate):
    cases = {"One. Two": 5, "没有": 0, "“好。” 然后": 5, "a.\n \n)x": 5, "Hi!": 3}
    for value, expected in cases.items():
        assert evaluate(text.sentence_boundary, value) == expected


def test_labels_and_status(spark):
    row = spark.range(1).select(
        text.chunk_id(F.lit("s"), F.lit(2), F.lit(0)).alias("a"),
        text.claim_id(F.lit("p"), F.lit("p.x")).alias("b"),
        text.page_label(F.lit("T"), F.lit(3)).alias("c"),
        text.owner_label(F.lit("T")).alias("d"),
        *[text.error_category(F.lit(s)).alias(f"s{s}") for s in (401, 402, 429, 500, 404)],
        text.retry_after(F.lit(3001), F.lit(1)).alias("r"),
        text.retry_after(F.lit(1), F.lit(5)).alias("r0"),
    ).first()
    assert row[:4] == ("s:p2:c0", "p:claim:p.x", "T · p. 3", "T · Owner-confirmed")
    assert [tuple(row[f"s{s}"]) for s in (401, 402, 429, 500, 404)] == [
        ("authentication", False), ("balance", False), ("rate_limited", True),
        ("upstream", True), ("upstream", False)]
    assert (row["r"], row["r0"]) == (3, 1)


def test_locale(evaluate):
    zh = ["zh", "zh-CN", "zh-Hans", "zh-Hant-TW", "ZH-hAnT"]
    en = ["en", "en-Latn-US", "EN-gb", "eng"]
    bad = ["", "fr-FR", "zh-invalid", "zh-1901", "en-oxendict", "en-US-u-ca-gregory",
           "en-x-private", "en--US", "en_US", "Chinese"]
    assert {evaluate(text.chat_locale, v) for v in zh} == {"zh"}
    assert {evaluate(text.chat_locale, v) for v in en} == {"en"}
    assert {evaluate(text.chat_locale, v) for v in bad} == {None}


def test_tokenizers_have_no_python_stage(spark):
    frame = spark.createDataFrame([("Plain text",)], "t string")
    plan = frame.select(text.search_terms(text.build_query_terms(F.col("t"))))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_tokens_normalize_the_text_once(spark):
    """The text is the argument of one lambda: neither the Han test nor the tokens repeat its white space pattern."""
    frame = spark.createDataFrame([(" A　b--c  d'e",), ("中文x",), ("",), (None,)], "t string")
    found = frame.select(text.build_terms_folded(text.squeeze(F.col("t"))).alias("v"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r["v"] for r in found.collect()] == [["b", "c", "d'e"], ["中文", "x"], [], None]
