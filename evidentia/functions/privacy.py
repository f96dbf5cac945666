"""Contact-data and secret patterns as Spark columns.

Each function returns the array of hits in a text that is already in
compatibility normal form. Patterns rely on lookarounds so that hits inside
longer digit or word runs are not reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import SPACE

_WS = f"[{SPACE}]"

# The patterns that define a hit.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
INTERNATIONAL = r"(?<![\p{L}\p{N}])\+[\d(][\d() .-]{5,}\d"
LOCAL = (
    r"(?<![\p{L}\p{N}-])(?:\(\d{2,4}\)|\d{2,4})[ .-]+\d{3,4}[ .-]+\d{3,4}(?![\p{L}\p{N}-])"
)
NOT_A_PHONE = (
    rf"(?i)(?:year(?:{_WS}+range)?|timeline|dimensions?|page(?:{_WS}+range)?|model|serial"
    rf"|product(?:{_WS}+code)?|date|年份|日期|尺寸|页码|型号|序列号|产品(?:编号)?)"
    rf"{_WS}*[:：#-]?{_WS}*$"
)
LABELLED = (
    r"(?i)(?:phone|mobile|tel(?:ephone)?|联系电话|联系手机|手机号|手机|电话)"
    rf"{_WS}*[:：]?{_WS}*([+()\d][+()\d .-]{{5,}}\d)"
)
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
TECHNICAL_ADDRESS = (
    rf"(?i){_L}(?:ip|memory|network|physical|virtual|return|base|web|email){_WS}+address{_R}"
    rf"|{_L}address{_WS}+(?:bus|space|width|register){_R}"
)
CERTAIN_ADDRESS = (
    rf"(?i){_L}PRIVATE_ADDRESS{_R}"
    rf"|(?:{_L}(?:home|residential|mailing|contact){_WS}+address{_R}|家庭地址|联系地址|住址)"
    rf"{_WS}*[:：]?{_WS}*[^{SPACE}]"
    rf"|{_L}\d{{1,6}}{_WS}+\p{{L}}[\p{{L}} .'-]{{0,60}}{_WS}+"
    rf"(?:street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|drive|dr){_R}"
    rf"|[路街道巷]{_WS}*\d+{_WS}*号"
)
GENERIC_ADDRESS = rf"(?i){_L}address{_WS}*[:：]{_WS}*[^{SPACE}]"
# What every address rule needs somewhere in the text.
ADDRESS_TRACE = rf"(?i)address|地址|住址|[路街道巷]|\d[{SPACE}]+\p{{L}}"
QQ = rf"(?i)(?:qq|扣扣){_WS}*[:：]?{_WS}*\d{{5,12}}"
SECRET_KEY = r"sk-[A-Za-z0-9_-]{20,}"
SECRET_MINIMUM = 8


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _digits(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"\D", ""))


def _lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def unapproved_emails(c: Column, allow: list[str] | tuple[str, ...] = ()) -> Column:
    tokens = F.when(F.contains(c, F.lit("@")), _all(c, EMAIL))
    approved = [a.lower() for a in allow]
    if approved:
        return F.filter(tokens, lambda t: ~F.lower(t).isin(approved))
    return tokens


def mobile_hits(c: Column) -> Column:
    return _all(c, MOBILE)


def intl_hits(c: Column) -> Column:
    return F.filter(
        F.when(F.contains(c, F.lit("+")), _all(c, INTERNATIONAL)),
        lambda t: _digits(t).between(8, 15),
    )


def local_phone_hits(c: Column) -> Column:
    """Three-group numbers, unless the 40 characters before them end in a label
    for something that is not a phone."""
    opened, closed = "\u0001", "\u0002"

    def in_line(line: Column) -> Column:
        parts = F.split(F.regexp_replace(line, LOCAL, f"{opened}$0{closed}"), opened)
        spans = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.struct(
                F.substring_index(F.get(parts, i), closed, 1).alias("value"),
                F.right(
                    F.replace(F.array_join(F.slice(parts, F.lit(1), i), ""), F.lit(closed), F.lit("")),
                    F.lit(40),
                ).alias("before"),
            ),
        )
        kept = F.filter(
            spans,
            lambda s: _digits(s["value"]).between(10, 11) & ~s["before"].rlike(NOT_A_PHONE),
        )
        return F.transform(kept, lambda s: s["value"])

    candidates = F.filter(_lines(c), lambda line: line.rlike(LOCAL))
    return F.when(c.rlike(LOCAL), F.flatten(F.transform(candidates, in_line)))


def labelled_phone_hits(c: Column) -> Column:
    return F.filter(_all(c, LABELLED, 1), lambda t: _digits(t) >= 7)


def address_hits(c: Column) -> Column:
    """Lines that state a private address; a technical address excuses only the
    generic label."""
    lines = F.filter(
        _lines(c),
        lambda line: line.rlike(CERTAIN_ADDRESS)
        | (line.rlike(GENERIC_ADDRESS) & ~line.rlike(TECHNICAL_ADDRESS)),
    )
    return F.when(c.rlike(ADDRESS_TRACE), lines)


def qq_hits(c: Column) -> Column:
    return _all(c, QQ)


def rules(c: Column, allow: list[str] | tuple[str, ...] = ()) -> dict[str, Column]:
    """Rule name to hits over a text in compatibility form.

    Digit rules are skipped for texts without a digit run.
    """
    numeric = c.rlike(r"\d{2}")
    return {
        "email": unapproved_emails(c, allow),
        "mobile": F.when(numeric, mobile_hits(c)),
        "international": F.when(numeric, intl_hits(c)),
        "local_phone": F.when(numeric, local_phone_hits(c)),
        "labelled_phone": F.when(numeric, labelled_phone_hits(c)),
        "address": address_hits(c),
        "qq": F.when(numeric, qq_hits(c)),
    }


def has_private(c: Column, allow: list[str] | tuple[str, ...] = ()) -> Column:
    hit = F.lit(False)
    for hits in rules(c, allow).values():
        hit = hit | (F.size(F.coalesce(hits, F.array().cast("array<string>"))) > 0)
    return hit


def redact(c: Column, allow: list[str] | tuple[str, ...] = (), mark: str = "[redacted]") -> Column:
    """Replace contact values, keeping approved e-mail tokens."""
    tail = r"(?![A-Za-z]|[A-Za-z0-9.-]*\.[A-Za-z]{2,})"
    approved = "|".join(re.escape(a) for a in allow)
    keep = rf"(?!(?:{approved}){tail})" if approved else ""
    email = rf"(?i)(?<![A-Za-z0-9._%+-]){keep}{EMAIL}"

    def clean_line(line: Column) -> Column:
        private = line.rlike(CERTAIN_ADDRESS) | (
            line.rlike(GENERIC_ADDRESS) & ~line.rlike(TECHNICAL_ADDRESS)
        )
        return F.when(private, F.lit(mark)).otherwise(line)

    found = {n: h for n, h in rules(c, allow).items() if n not in ("email", "address")}
    numbers = F.array_sort(
        F.array_distinct(F.flatten(F.array(*[
            F.coalesce(h, F.array().cast("array<string>")) for h in found.values()]))),
        lambda a, b: F.char_length(b) - F.char_length(a))
    text = F.aggregate(numbers, F.regexp_replace(c, email, mark),
                       lambda acc, v: F.replace(acc, v, F.lit(mark)))
    private = F.coalesce(F.size(address_hits(c)) > 0, F.lit(False))
    return F.when(private, F.array_join(F.transform(_lines(text), clean_line), "\n")).otherwise(text)


def secret_hits(c: Column, known: list[str] | tuple[str, ...] = ()) -> Column:
    shaped = F.when(F.contains(c, F.lit("sk-")), _all(c, SECRET_KEY))
    values = [v for v in known if len(v) >= SECRET_MINIMUM]
    found = [F.when(F.contains(c, F.lit(v)), F.lit(v)) for v in values]
    return F.array_compact(
        F.concat(F.coalesce(shaped, F.array().cast("array<string>")), F.array(*found).cast("array<string>"))
    )
