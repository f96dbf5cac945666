"""Scalar functions, privacy rules and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import privacy, text
from evidentia.operators import privacy as ops
from workload.registry import query
from workload.world import (
    SQL_REQUESTS,
    WS,
    event_ms,
    sql_norm,
    sql_phrase,
    sql_query,
    sql_search_terms,
    sql_terms,
)

SALT = "a fixed demonstration salt of more than 32 bytes"


def _digest(c):
    return F.sha2(F.array_join(F.sort_array(c), " "), 256)


def _sql_digest(c):
    return f"sha256(array_to_string(list_sort({c}), ' '))"


@query(f"SELECT doc_id, sha256(n) AS digest, length(n) AS n_chars FROM (SELECT doc_id, {sql_norm('text')} AS n FROM documents)")
def normalize_text(t):
    n = text.normalize_text(F.col("text"))
    return t.documents.select("doc_id", n.alias("n")).select(
        "doc_id", F.sha2("n", 256).alias("digest"), F.char_length("n").alias("n_chars"))


@query(f"SELECT doc_id, sha256({sql_phrase('text')}) AS digest FROM documents")
def normalize_phrase(t):
    return t.documents.select("doc_id", F.sha2(text.normalize_phrase(F.col("text")), 256).alias("digest"))


@query(f"SELECT conv_id, turn, {sql_query('text')} AS normalized FROM conversations")
def normalize_query(t):
    return t.conversations.select("conv_id", "turn", text.normalize_query(F.col("text")).alias("normalized"))


@query(rf"SELECT conv_id, turn, regexp_replace(lower(text), '[\p{{P}}\p{{S}}{WS}]', '', 'g') AS key FROM conversations")
def unique_key(t):
    return t.conversations.select("conv_id", "turn", text.unique_key(F.col("text")).alias("key"))


@query(f"SELECT conv_id, turn, lower(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')) AS key FROM conversations")
def term_key(t):
    return t.conversations.select("conv_id", "turn", text.term_key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, len(w) AS n_terms, {_sql_digest('w')} AS digest FROM (SELECT doc_id, {sql_terms('text')} AS w FROM documents)")
def build_terms(t):
    rows = t.documents.select("doc_id", text.build_terms(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_terms"), _digest("w").alias("digest"))


@query(f"SELECT conv_id, turn, {_sql_digest('w')} AS digest FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all({sql_query('text')}, '[a-z0-9]+', 0)) AS w FROM conversations)")
def build_query_terms(t):
    rows = t.conversations.select("conv_id", "turn", text.build_query_terms(
        text.normalize_query(F.col("text"))).alias("w"))
    return rows.select("conv_id", "turn", _digest("w").alias("digest"))


@query(f"SELECT conv_id, turn, len(w) AS n, {_sql_digest('w')} AS digest FROM (SELECT conv_id, turn, {sql_search_terms('text')} AS w FROM conversations)")
def search_terms(t):
    rows = t.conversations.select("conv_id", "turn", text.search_terms(text.build_terms(F.col("text"))).alias("w"))
    return rows.select("conv_id", "turn", F.size("w").alias("n"), _digest("w").alias("digest"))


@query(rf"SELECT conv_id, turn, regexp_matches(text, '[^{WS}\p{{Cf}}]') AS visible FROM conversations")
def has_visible(t):
    return t.conversations.select("conv_id", "turn", text.has_visible(F.col("text")).alias("visible"))


@query("SELECT doc_id, length(text) AS n, sha256(substr(text, 1, 600)) AS capped FROM documents")
def code_points(t):
    return t.documents.select(
        "doc_id", text.cp_length(F.col("text")).alias("n"), F.sha2(text.cp_cap(F.col("text"), 600), 256).alias("capped"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_hex(t):
    return t.documents.select("doc_id", text.sha256_hex(F.col("text")).alias("digest"))


_BLOCK = SALT.encode().ljust(64, b"\0")
_INNER = bytes(b ^ 0x36 for b in _BLOCK).hex()
_OUTER = bytes(b ^ 0x5C for b in _BLOCK).hex()


@query(f"SELECT DISTINCT user_id, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode('session:' || user_id)))) AS visitor_key FROM events")
def visitor_key(t):
    users = t.events.select("user_id").distinct()
    identity = F.concat(F.lit("session:"), F.col("user_id").cast("string"))
    return users.select("user_id", text.visitor_key(identity, SALT).alias("visitor_key"))


@query("SELECT p_partkey, json_object('a', json_object('brand', p_brand, 'type', p_type), 'name', p_name, 'size', p_size) AS json FROM part")
def stable_json(t):
    rows = t.part.select("p_partkey", F.struct(
        F.col("p_size").alias("size"), F.col("p_name").alias("name"),
        F.struct(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).alias("a")).alias("r"))
    return rows.select("p_partkey", text.stable_json(F.col("r"), rows.schema["r"].dataType).alias("json"))


@query("""SELECT event_id, strftime(DATE '1970-01-01' + d::INT, '%Y-%m-%d') AS day_key, (d + 1) * 86400000 - 28800000 AS reset_at
FROM (SELECT event_id, ((epoch_us(ts) // 1000) + 28800000) // 86400000 AS d FROM events)""")
def day_window(t):
    return t.events.select("event_id", text.day_window(event_ms()).alias("w")).select(
        "event_id", "w.day_key", "w.reset_at")


_HREF = (rf"^[{WS}]|[{WS}]$|[\x00-\x1F\x7F\\]|%(?:0[0-9a-fA-F]|1[0-9a-fA-F]|5[cC]|7[fF])|^//"
         r"|^[a-zA-Z][a-zA-Z0-9+.-]*:")


@query(f"SELECT page_id, NOT regexp_matches(url, '{_HREF}') AS absolute_ok, NOT regexp_matches(p, '{_HREF}') AS relative_ok, NOT regexp_matches('/' || p, '{_HREF}') AS doubled_ok FROM (SELECT page_id, url, regexp_replace(url, '^https?://[^/]+', '') AS p FROM pages)")
def is_internal_href(t):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return t.pages.select(
        "page_id", text.is_internal_href(F.col("url")).alias("absolute_ok"),
        text.is_internal_href(path).alias("relative_ok"),
        text.is_internal_href(F.concat(F.lit("/"), path)).alias("doubled_ok"))


@query(rf"""SELECT conv_id, turn, length(array_to_string(regexp_extract_all(text, '[^。！？.!?\n]*[。！？.!?\n]+["''”’）)\]]*[{WS}]*', 0), '')) AS boundary FROM conversations""")
def sentence_boundary(t):
    return t.conversations.select("conv_id", "turn", text.sentence_boundary(F.col("text")).alias("boundary"))


@query("""SELECT doc_id, source || ':p' || (doc_id // 20 + 1) || ':c0' AS chunk_id, source || ':claim:d' || doc_id AS claim_id,
source || ' · p. ' || (doc_id // 20 + 1) AS page_label, source || ' · Owner-confirmed' AS owner_label FROM documents""")
def labels_and_ids(t):
    page = F.floor(F.col("doc_id") / 20) + 1
    return t.documents.select(
        "doc_id", text.chunk_id(F.col("source"), page, F.lit(0)).alias("chunk_id"),
        text.claim_id(F.col("source"), F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("claim_id"),
        text.page_label(F.col("source"), page).alias("page_label"), text.owner_label(F.col("source")).alias("owner_label"))


@query("""SELECT event_id, CASE s WHEN 401 THEN 'authentication' WHEN 402 THEN 'balance' WHEN 429 THEN 'rate_limited' ELSE 'upstream' END AS category,
s = 429 OR s >= 500 AS retryable FROM (SELECT event_id, 400 + event_id % 130 AS s FROM events)""")
def error_category(t):
    rows = t.events.select("event_id", text.error_category(F.lit(400) + F.col("event_id") % 130).alias("e"))
    return rows.select("event_id", "e.category", "e.retryable")


@query(f"""WITH {SQL_REQUESTS} SELECT request_id, greatest(1, CAST(ceil((reset - now_ms) / 1000.0) AS BIGINT)) AS seconds
FROM (SELECT request_id, now_ms, ((now_ms + 28800000) // 86400000 + 1) * 86400000 - 28800000 AS reset FROM requests_)""")
def retry_after(t):
    reset = text.day_window(event_ms())["reset_at"]
    return t.events.select(
        F.format_string("r%010d", "event_id").alias("request_id"), text.retry_after(reset, event_ms()).alias("seconds"))


_LOCALES = ["lang", "upper(lang) || '-gb'", "'zh-Hant-' || upper(lang)", "lang || '_US'", "lang || '-x-private'",
            "'en-Latn-' || (100 + doc_id % 900)"]
_LOCALE_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_LOCALES)) + " END"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(l, '^(zh|en|zho|chi|cmn|eng)(-[a-z]{{4}})?(-([a-z]{{2}}|[0-9]{{3}}))?$')
THEN CASE WHEN l[1] = 'e' THEN 'en' ELSE 'zh' END END AS locale FROM (SELECT doc_id, lower({_LOCALE_SQL}) AS l FROM documents)""")
def chat_locale(t):
    return t.documents.select("doc_id", text.chat_locale(F.expr(_LOCALE_SQL)).alias("locale"))


# -------------------------------------------------------------------- privacy
_SQL_RULES = {
    "email": r"regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 0)",
    "mobile": r"regexp_extract_all(text, '(?:^|[^0-9])(1[3-9][0-9]{9})(?:[^0-9]|$)', 1)",
    "international": r"list_filter(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}])(\+[0-9(][0-9() .-]{5,}[0-9])', 1),"
                     r" lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)",
    "local_phone": r"list_filter(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}-])((?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]+[0-9]{3,4}[ .-]+[0-9]{3,4})(?:[^\p{L}\p{N}-]|$)', 1),"
                   r" lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 11)",
    "labelled_phone": rf"list_filter(regexp_extract_all(text, '(?i)(?:phone|mobile|tel(?:ephone)?|联系电话|联系手机|手机号|手机|电话)[{WS}]*[:：]?[{WS}]*([+()0-9][+()0-9 .-]{{5,}}[0-9])', 1),"
                      r" lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7)",
    "address": rf"list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '(?i)\bPRIVATE_ADDRESS\b|(?:\b(?:home|residential|mailing|contact)[{WS}]+address\b|家庭地址|联系地址|住址)[{WS}]*[:：]?[{WS}]*[^{WS}]|\b[0-9]{{1,6}}[{WS}]+\p{{L}}[\p{{L}} .''-]{{0,60}}[{WS}]+(?:street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|drive|dr)\b|[路街道巷][{WS}]*[0-9]+[{WS}]*号')"
               rf" OR (regexp_matches(x, '(?i)\baddress[{WS}]*[:：][{WS}]*[^{WS}]') AND NOT regexp_matches(x, '(?i)\b(?:ip|memory|network|physical|virtual|return|base|web|email)[{WS}]+address\b|\baddress[{WS}]+(?:bus|space|width|register)\b')))",
    "qq": rf"regexp_extract_all(text, '(?i)(?:qq|扣扣)[{WS}]*[:：]?[{WS}]*[0-9]{{5,12}}', 0)",
}
_SQL_ANY = " OR ".join(f"len({r}) > 0" for r in _SQL_RULES.values())


# Documents hold no mobile, labelled or QQ numbers and no addresses of their own: each gets a contact line by its id.
_CONTACTS = """text || chr(10) || CASE doc_id % 5
WHEN 0 THEN 'call 13' || lpad(CAST(doc_id * 7919 % 1000000000 AS STRING), 9, '0')
WHEN 1 THEN 'phone: ' || CAST(5550000 + doc_id AS STRING)
WHEN 2 THEN 'Home address: ' || CAST(doc_id AS STRING) || ' Willow Lane'
WHEN 3 THEN 'QQ: ' || CAST(10000 + doc_id AS STRING) ELSE 'no contact here' END"""


def _rule_sql(name, contacts=False):
    table = f"(SELECT doc_id, {_CONTACTS} AS text FROM documents)" if contacts else "documents"
    return f"SELECT doc_id, unnest({_SQL_RULES[name]}) AS value FROM {table}"


def _rule(t, hits, contacts=False):
    body = F.expr(_CONTACTS) if contacts else F.col("text")
    return t.documents.select("doc_id", F.explode(hits(text.nfkc(body))).alias("value"))


@query(_rule_sql("email"))
def unapproved_emails(t):
    return _rule(t, privacy.unapproved_emails)


@query(_rule_sql("mobile", contacts=True))
def mobile_hits(t):
    return _rule(t, privacy.mobile_hits, contacts=True)


@query(_rule_sql("international"))
def intl_hits(t):
    return _rule(t, privacy.intl_hits)


@query(_rule_sql("local_phone"))
def local_phone_hits(t):
    return _rule(t, privacy.local_phone_hits)


@query(_rule_sql("labelled_phone", contacts=True))
def labelled_phone_hits(t):
    return _rule(t, privacy.labelled_phone_hits, contacts=True)


@query(_rule_sql("address", contacts=True))
def address_hits(t):
    return _rule(t, privacy.address_hits, contacts=True)


@query(_rule_sql("qq", contacts=True))
def qq_hits(t):
    return _rule(t, privacy.qq_hits, contacts=True)


@query(" UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule, unnest({r}) AS value FROM documents" for n, r in _SQL_RULES.items()))
def privacy_findings(t):
    return ops.privacy_findings(t.documents, "doc_id", "text")


@query(f"SELECT source, count(*) FILTER (NOT hit) AS safe, count(*) FILTER (hit) AS quarantined FROM (SELECT source, {_SQL_ANY} AS hit FROM documents) GROUP BY source")
def privacy_gate(t):
    gate = ops.privacy_gate(t.documents.select("doc_id", "source", "text"), "text")
    both = gate["safe"].select("source", F.lit(1).alias("s"), F.lit(0).alias("q")).unionByName(
        gate["quarantined"].select("source", F.lit(0).alias("s"), F.lit(1).alias("q")))
    return both.groupBy("source").agg(F.sum("s").alias("safe"), F.sum("q").alias("quarantined"))


@query(f"SELECT doc_id, {_SQL_ANY} AS changed, true AS clean FROM documents")
def redact_contacts(t):
    redacted = ops.redact_contacts(
        t.documents.select("doc_id", F.col("text").alias("original"), "text"), "text")
    return redacted.select("doc_id", (F.col("text") != F.col("original")).alias("changed"), "clean")


SECRETS = ["https://th", "@mail5.example.com", "tindwhst"]


@query("SELECT doc_id, sha256(v) AS secret_sha256 FROM documents, (VALUES "
       + ",".join(f"('{s}')" for s in SECRETS) + ") s(v) WHERE contains(text, v)"
       " UNION SELECT doc_id, sha256(unnest(regexp_extract_all(text, 'sk-[A-Za-z0-9_-]{20,}', 0))) FROM documents")
def secret_findings(t):
    return ops.secret_findings(t.documents, "doc_id", "text", SECRETS)


@query("SELECT DISTINCT doc_id, sha256(b.text) AS sentinel_sha256 FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def leak_scan(t):
    return ops.leak_scan(t.documents, t.benchmark.select(F.col("text").alias("value")), "doc_id", "text")


@query("SELECT DISTINCT page_id, sha256(v) AS sentinel_sha256 FROM pages, (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS v FROM pages) WHERE v <> '' AND contains(html, v)")
def leak_scan_identifiers(t):
    hosts = t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("value"))
    return ops.leak_scan(t.pages, hosts, "page_id", "html")
