"""Scalar text functions as Spark columns.

Everything runs inside the JVM except compatibility normalization, for which
Spark has no built-in. That one Arrow UDF receives only the values that hold a
character it could change; plain Latin, Cyrillic and Han text never leaves the
JVM.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space set the contract is written against. Java's own
# \s is ASCII only, so every pattern spells the set out.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Characters beyond ASCII that compatibility normalization leaves
# alone and that never combine with a neighbour. Anything else takes the UDF path.
STABLE = (
    r"\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0-\u00B1\u00B6-\u00B7\u00BB\u00BF-\u0131"
    r"\u0134-\u013E\u0141-\u0148\u014A-\u017E"
    r"\u0400-\u0482\u048A-\u052F"
    r"\u2010\u2012-\u2016\u2018-\u2023\u2030-\u2032\u2039-\u203B"
    r"\u3001-\u3020\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF"
)

# Question wrapper terms that never take part in scoring.
STOP_TERMS = (
    "a an about and are can could do does for how i in is it me my of on please "
    "tell the this to us we what when where which who why with you your"
).split() + "什么 如何 怎么 怎样 哪些 是否 可以 请问 能否 吗 呢 帮我 给我 我想".split()

_FIRST_HAN = "\u2E80"
# One Han character; the range spares other text the script lookup.
HAN = r"[\u2E80-\x{323AF}&&\p{IsHan}]"
_INDEX_TOKEN = rf"[a-z0-9]++(?:['-][a-z0-9]++)*+|{HAN}++"
_QUERY_TOKEN = rf"[a-z0-9]++|{HAN}++"
# One white space character; the ranges spare other characters the whole set.
WHITE = rf"[\t- \u00A0-\uFEFF&&[{SPACE}]]"
# A run of white space that is more than one plain space.
_LOOSE = rf"(?: (?={WHITE})|[\t-\r]|[\u00A0-\uFEFF&&[{SPACE}]]){WHITE}*+"


@F.pandas_udf(T.StringType())
def _compatibility_form(values: pd.Series) -> pd.Series:
    return values.map(
        lambda value: unicodedata.normalize("NFKC", value), na_action="ignore"
    )


def nfkc(c: Column) -> Column:
    """Compatibility normal form; stable values bypass Python as nulls."""
    # The range comes first: it settles ASCII with one comparison per character.
    unstable = c.rlike(rf"[\u0080-\x{{10FFFF}}&&[^{STABLE}]]")
    return F.coalesce(_compatibility_form(F.when(unstable, c)), c)


def squeeze(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _LOOSE, " "))


def normalize_text(c: Column) -> Column:
    return squeeze(nfkc(c))


def fold(c: Column) -> Column:
    """Compatibility form in lower case: the base of every matching key."""
    return F.lower(nfkc(c))


def strip_phrase(folded: Column) -> Column:
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "")


def normalize_phrase(c: Column) -> Column:
    return strip_phrase(fold(c))


def normalize_query_folded(folded: Column) -> Column:
    text = F.regexp_replace(folded, rf"([a-z0-9])({HAN})", "$1 $2")
    text = F.regexp_replace(text, rf"({HAN})([a-z0-9])", "$1 $2")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def normalize_query(c: Column) -> Column:
    """Words and Han runs separated by single spaces."""
    return normalize_query_folded(fold(c))


def unique_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), rf"[\p{{P}}\p{{S}}{SPACE}]", "")


def term_key(c: Column) -> Column:
    return F.lower(js_trim(nfkc(c)))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _pairs(run: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2))
    )


def _tokens(text: Column, pattern: str, keep_single_han: bool) -> Column:
    single = (lambda run: F.array(run)) if keep_single_han else (
        lambda run: F.array().cast("array<string>"))

    def expand(token: Column) -> Column:
        return (
            F.when(token < F.lit(_FIRST_HAN), F.array(token))
            .when(F.char_length(token) == 1, single(token))
            .otherwise(_pairs(token))
        )

    def cut(value: Column) -> Column:
        found = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
        # Text without Han skips the per-token expansion altogether.
        return F.when(value.rlike(HAN), F.flatten(F.transform(found, expand))).otherwise(found)

    # As a lambda's argument the text is normalized once, not for the test and again for its tokens.
    return F.array_distinct(F.get(F.transform(F.array(text), cut), F.lit(0)))


def build_terms(c: Column) -> Column:
    """Distinct index terms in first-seen order: Han bigrams and ASCII words."""
    return build_terms_folded(fold(c))


def build_terms_folded(folded: Column) -> Column:
    return _tokens(folded, _INDEX_TOKEN, keep_single_han=True)


def build_query_terms(normalized: Column) -> Column:
    """Terms of an already normalized query; a lone Han character is dropped."""
    return _tokens(normalized, _QUERY_TOKEN, keep_single_han=False)


def search_terms(terms: Column) -> Column:
    return F.array_except(terms, F.array(*[F.lit(t) for t in STOP_TERMS]))


def has_visible(c: Column) -> Column:
    return c.rlike(rf"[^{SPACE}\p{{Cf}}]")


def cp_length(c: Column) -> Column:
    return F.char_length(c)


def cp_cap(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def visitor_key(identity: Column, salt: str) -> Column:
    """HMAC-SHA256 of the identity; empty identities give null."""
    key = salt.encode("utf-8")
    if len(key) < 32:
        raise ValueError("the salt must hold at least 32 UTF-8 bytes")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.sha2(F.concat(inner, F.encode(identity, "UTF-8")), 256)
    return F.when(F.length(identity) > 0, F.sha2(F.concat(outer, F.unhex(digest)), 256))


def _canonical(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        built = F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNotNull(), built)
    if isinstance(kind, T.ArrayType) and isinstance(
        kind.elementType, (T.StructType, T.ArrayType, T.MapType)
    ):
        return F.transform(c, lambda item: _canonical(item, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.array_sort(F.map_entries(c)),
            lambda e: F.struct(e["key"], _canonical(e["value"], kind.valueType)),
        )
        return F.map_from_entries(entries)
    return c


def stable_json(c: Column, kind: T.StructType) -> Column:
    """JSON with keys sorted at every level and absent values dropped."""
    return F.to_json(_canonical(c, kind))


_DAY_MS = 86_400_000
_OFFSET_MS = 28_800_000


def day_number(ms: Column) -> Column:
    """Days since the epoch at UTC+8."""
    return F.floor((ms + F.lit(_OFFSET_MS)) / F.lit(_DAY_MS)).cast("bigint")


def day_reset(day: Column) -> Column:
    """Epoch milliseconds of the midnight that ends a UTC+8 day."""
    return (day + 1) * F.lit(_DAY_MS) - F.lit(_OFFSET_MS)


def day_window(ms: Column) -> Column:
    day = day_number(ms)
    return F.struct(
        F.date_from_unix_date(day.cast("int")).cast("string").alias("day_key"),
        day_reset(day).alias("reset_at"),
    )


def is_internal_href(c: Column) -> Column:
    unsafe = (
        rf"^[{SPACE}]|[{SPACE}]$"
        r"|[\x00-\x1F\x7F\\]"
        r"|%(?:0[0-9a-fA-F]|1[0-9a-fA-F]|5[cC]|7[fF])"
        r"|^//"
        r"|^[a-zA-Z][a-zA-Z0-9+.-]*:"
    )
    return ~c.rlike(unsafe)


def sentence_boundary(c: Column) -> Column:
    """Length of the prefix made of complete sentences."""
    ender, closer = r"。！？.!?\n", r"\"'”’）)\]"
    pieces = F.regexp_extract_all(
        c, F.lit(rf"[^{ender}]*[{ender}]+[{closer}]*[{SPACE}]*"), F.lit(0)
    )
    return F.char_length(F.array_join(pieces, ""))


def chunk_id(source: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s:p%d:c%d", source, page, index)


def claim_id(project: Column, claim: Column) -> Column:
    return F.concat(project, F.lit(":claim:"), claim)


def page_label(title: Column, page: Column) -> Column:
    return F.concat(title, F.lit(" · p. "), page.cast("string"))


def owner_label(title: Column) -> Column:
    return F.concat(title, F.lit(" · Owner-confirmed"))


def error_category(status: Column) -> Column:
    """Upstream HTTP status to (category, retryable)."""
    category = (
        F.when(status == 401, "authentication")
        .when(status == 402, "balance")
        .when(status == 429, "rate_limited")
        .otherwise("upstream")
    )
    retryable = (status == 429) | ((status >= 500) & (category == "upstream"))
    return F.struct(category.alias("category"), retryable.alias("retryable"))


def retry_after(reset: Column, now: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil((reset - now) / 1000).cast("bigint"))


def chat_locale(c: Column) -> Column:
    """zh or en for a plain language[-Script][-REGION] tag, otherwise null."""
    # Three-letter names that canonicalize to the two languages.
    tag = r"^(zh|en|zho|chi|cmn|eng)(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?$"
    language = F.regexp_extract(F.lower(c), tag, 1)
    return F.when(language.isin("zh", "zho", "chi", "cmn"), "zh").when(
        language.isin("en", "eng"), "en"
    )
