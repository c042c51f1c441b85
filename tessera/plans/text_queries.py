"""Text, date and request-column queries over the driver text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import AS_OF, fixture, table, with_fixtures
from tessera.functions.text import EMAIL_PATTERN, indexed
from tessera.functions.useragent import parse_user_agent
from tessera.operators import dates as D
from tessera.operators import text as T
from tessera.operators.usage import client_ip
from tessera.plans.oracle_sql import (fullwidth_sql, html_decode_sql, ireplace_sql, no_null_sql, q, strip_tags_sql,
                                      strip_ws_sql, transliterate_sql)
from tessera.plans.registry import register

NL = "chr(10)"


# ----------------------------------------------------------------------- T1
def _clean_text_sql(col: str) -> str:
    t = f"coalesce({col}, '')"
    x = f"regexp_replace({t}, 'class=\".*?\"', '', 'g')"
    x = f"regexp_replace({x}, 'style=\".*?\"', '', 'g')"
    x = f"regexp_replace({x}, {q('(?i)<(' + '|'.join(T.GAP_TAGS) + ') >')}, '<\\1>', 'g')"
    for find, repl in T.CLEAN_SWAPS:
        x = ireplace_sql(x, find, repl)
    x = html_decode_sql(x)
    for letter, ch in (("r", "\r"), ("n", "\n"), ("t", "\t")):
        x = f"regexp_replace({x}, {q('(?i)' + chr(92) * 2 + '{1,2}' + letter)}, {q(ch)}, 'g')"
    x = ireplace_sql(x, "<br />* ", "\r\n* ")
    for tag, opening, closing in T.MD_TAGS:
        x = ireplace_sql(x, f"<{tag}>", opening)
        x = ireplace_sql(x, f"</{tag}>", closing)
    x = f"replace(replace({x}, '<', '&lt;'), '>', '&gt;')"
    x = (f"array_to_string(list_filter(list_transform(string_split({x}, {NL}), lambda s: {strip_ws_sql('s')}), "
         f"lambda s: length(s) > 0), {NL} || {NL})")
    return f"CASE WHEN length({no_null_sql(t)}) <= 10 THEN {no_null_sql(t)} ELSE {no_null_sql(x)} END"


@register("t1_clean_text", oracle=f"SELECT page_id, {_clean_text_sql('html')} AS clean_text FROM pages")
def t1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML clean-up with Markdown conversion of every page."""
    return T.clean_text(table(spark, sf_dir, "pages").select("page_id", "html"), "html", True).drop("html")


@register("t2_scrub_notes")
def t2_scrub_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note scrub (HTML → Markdown line rules) of every page; rows-only (Python line state machine)."""
    return T.scrub_notes(table(spark, sf_dir, "pages").select("page_id", "html"), "html").drop("html")


def _plain_sql(col: str) -> str:
    x = f"coalesce({col}, '')"
    for s in ("<div>", "</div>", "<p>", "</p>", "<br>", "<br/>", "\r", "\n"):
        x = ireplace_sql(x, s, "\n\n")
    x = f"regexp_replace({x}, {q(chr(10) + '{3,}')}, {NL} || {NL}, 'g')"
    return f"CASE WHEN length({no_null_sql(col)}) <= 0 THEN '' ELSE {no_null_sql(x)} END"


@register("t3_plain_text", oracle=f"SELECT page_id, {_plain_sql('html')} AS plain_text FROM pages")
def t3_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text line breaks of every page."""
    return T.plain_text(table(spark, sf_dir, "pages").select("page_id", "html"), "html").drop("html")


# ----------------------------------------------------------------------- T4
def _words_sql(col: str) -> str:
    x = f"translate(coalesce({col}, ''), {q(T.WORD_JOINERS)}, '')"
    x = html_decode_sql(strip_tags_sql(x))
    x = no_null_sql(f"translate({x}, {q(T.WORD_PUNCT)}, {q(' ' * len(T.WORD_PUNCT))})")
    return f"string_split(' ' || {x} || ' ', ' ')"


def _first_seen_sql(source: str, key: str, arr: str, word_expr: str, keep: str, out: str = "word") -> str:
    return f"""
, arr AS (SELECT {key}, {arr} AS a FROM {source}),
tok AS (SELECT {key}, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM arr),
w AS (SELECT {key}, {word_expr} AS word, i FROM tok),
f AS (SELECT {key}, word, min(i) AS i FROM w WHERE {keep} GROUP BY {key}, word)
SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS INTEGER) AS pos, word AS {out} FROM f
"""


@register("t4_unique_words", oracle="WITH x AS (SELECT 1)" + _first_seen_sql(
    "documents", "doc_id", _words_sql("text"), f"lower({no_null_sql('w')})", "length(word) > 1 AND length(word) <= 64"))
def t4_unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: distinct words (first-seen position) of every document, whole texts."""
    return T.word_index(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("t5_keyword_tokens", oracle="WITH x AS (SELECT 1)" + _first_seen_sql(
    "conversations", "conv_id, turn",
    f"string_split({no_null_sql('translate(coalesce(text, ' + q('') + '), ' + q(chr(0x3000) + ',:;|') + ', ' + q(' ' * 5) + ')')}, ' ')",
    f"lower({no_null_sql('w')})", "length(word) > 0"))
def t5_keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: search tokens (first-seen position) of every conversation turn."""
    df = T.keyword_tokens(table(spark, sf_dir, "conversations"), "text")
    return df.select("conv_id", "turn", indexed(F.col("keywords"), "pos", "word"))


def _clean_names_sql(col: str) -> str:
    x = fullwidth_sql(no_null_sql(col))
    x = f"translate({x}, '_[]*#', ' ()')"
    x = f"regexp_replace({x}, '\\s*\\(', ' (', 'g')"
    x = f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s*\\([^)]*\\)', '', 'g')"
    return no_null_sql(x)


@register("t6_clean_names", oracle=f"SELECT p_partkey, {_clean_names_sql('p_name || ' + q(' (') + ' || p_type || ' + q(')') + ' || p_brand')} AS clean_name FROM part")
def t6_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name clean-up of every part name (with its type in brackets and brand)."""
    p = table(spark, sf_dir, "part")
    df = p.select("p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"), "p_brand").alias("name"))
    return T.clean_names(df, "name").drop("name")


def _slug_sql(col: str) -> str:
    x = transliterate_sql(no_null_sql(col))
    x = f"replace(replace({x}, '''', ''), '&', 'and')"
    x = f"regexp_replace({x}, '[^A-Za-z0-9-]+', '-', 'g')"
    x = f"regexp_replace({x}, '[\\s-]+', '-', 'g')"
    x = f"regexp_replace({x}, '^-+|-+$', '', 'g')"
    return no_null_sql(f"lower({x})")


@register("t7_slugify", oracle=f"SELECT conv_id, turn, {_slug_sql('text')} AS slug FROM conversations")
def t7_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug of every conversation turn (whole text, accents folded)."""
    return T.slugify(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").drop("text")


def _url_safe_sql(col: str) -> str:
    x = strip_tags_sql(f"coalesce({col}, '')")
    for s in T.URL_STRIP:
        x = f"replace({x}, {q(s)}, '')"
    x = f"regexp_replace(replace({no_null_sql(x)}, ' ', '-'), '[^a-zA-Z0-9-.]', '', 'g')"
    x = f"regexp_replace({x}, '\\.', '', 'g')"
    return f"lower(CASE WHEN {no_null_sql(x)} = '' THEN url_encode(coalesce({col}, '')) ELSE {x} END)"


@register("t7_url_safe", oracle=f"SELECT p_partkey, {_url_safe_sql('p_name')} AS url_safe FROM part")
def t7_url_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-safe name of every part."""
    return T.url_safe(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").drop("p_name")


def _clean_url_sql(col: str) -> str:
    x = f"lower(url_decode({no_null_sql(col)}))"
    for s in T.URL_NOISE:
        x = f"replace({x}, {q(s)}, '')"
    x = f"split_part({x} || '?', '?', 1)"
    for a, b in T.DOMAIN_ALIASES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"regexp_replace({x}, '[/?]+$', '', 'g')"


@register("t8_clean_urls", oracle=f"SELECT page_id, {_clean_url_sql('url')} AS clean_url FROM pages")
def t8_clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable form of every page URL."""
    return T.clean_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "url").drop("url")


def _url_guid_sql(col: str) -> str:
    u = no_null_sql(col)
    x = f"CASE WHEN starts_with({u}, 'https://') THEN substr({u}, 9) ELSE {u} END"
    x = f"replace(CASE WHEN starts_with({x}, 'http://') THEN substr({x}, 8) ELSE {x} END, '//', '/')"
    s = f"regexp_replace({x}, '/+$', '', 'g')"
    h = f"md5({s})"
    guid = (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")
    return f"CASE WHEN length({u}) > 5 AND length({x}) - length({s}) < 10 THEN {guid} END"


@register("t9_url_identity", oracle=f"SELECT page_id, {_url_guid_sql('url')} AS url_guid FROM pages")
def t9_url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity GUID of every page URL."""
    return T.url_identity(table(spark, sf_dir, "pages").select("page_id", "url"), "url").drop("url")


@register("t9_duplicate_urls", oracle=with_fixtures("page_link") + f"""
, g AS (SELECT page_id, url, {_url_guid_sql('url')} AS url_guid FROM page_link),
c AS (SELECT url_guid, count(*) AS dup_count FROM g WHERE url_guid IS NOT NULL GROUP BY url_guid HAVING count(*) > 1)
SELECT g.page_id, g.url, g.url_guid, c.dup_count FROM g JOIN c USING (url_guid)
""")
def t9_duplicate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links whose URL identity is shared, with group size."""
    return T.duplicate_urls(fixture(spark, sf_dir, "page_link"), "page_id", "url")


# Top-level domains accepted by the host check.
KNOWN_TLDS = ["com", "net", "org", "edu", "gov", "io", "jp", "ca", "uk", "de", "fr", "es"]


@register("t10_valid_hosts", oracle=f"""
WITH u AS (SELECT page_id, lower({no_null_sql('url')}) AS u0 FROM pages),
h AS (SELECT page_id, regexp_extract(CASE WHEN contains(u0, '://') THEN u0 ELSE 'http://' || u0 END,
                                     '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2) AS host FROM u)
SELECT page_id, nullif(host, '') AS host, nullif(split_part(host, '.', -1), '') AS tld,
       coalesce(regexp_matches(host, '^([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,63}}$'), false)
       AND split_part(host, '.', -1) IN ({", ".join(q(t) for t in KNOWN_TLDS)}) AS is_valid_host
  FROM h
""")
def t10_valid_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host shape and known top-level domain of every page URL."""
    tlds = spark.createDataFrame([(t,) for t in KNOWN_TLDS], "tld string")
    out = T.valid_hosts(table(spark, sf_dir, "pages").select("page_id", "url"), "url", tlds)
    return out.select("page_id", "host", "tld", "is_valid_host")


@register("t11_valid_emails", oracle=with_fixtures("contact_request") + f"""
SELECT request_id, coalesce(regexp_matches(lower({no_null_sql('mail')}), {q(EMAIL_PATTERN)}), false) AS is_valid_email
  FROM contact_request
""")
def t11_valid_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail check of every contact request address."""
    return T.valid_emails(fixture(spark, sf_dir, "contact_request"), "mail").select("request_id", "is_valid_email")


@register("t11_text_direction", oracle=f"""
SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[֐-׿]')
                     OR (length(coalesce(text, '')) > 0 AND (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[؀-ۿ]', '', 'g')))
                         / length(coalesce(text, '')) > 0.6) THEN 'rtl' ELSE 'ltr' END AS direction
  FROM documents
""")
def t11_text_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text direction of every document."""
    return T.text_direction(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def _hashtags_sql(col: str) -> str:
    words = f"regexp_split_to_array(' ' || coalesce({col}, '') || ' ', '[ \\t\\r\\n]+')"
    cleaned = f"list_transform({words}, lambda w: {no_null_sql(strip_tags_sql('w'))})"
    tagged = f"list_filter({cleaned}, lambda w: starts_with(w, '#'))"
    return f"list_transform({tagged}, lambda w: lower({no_null_sql("translate(w, '#?.,!', '')")}))"


@register("t12_hashtags", oracle=with_fixtures("tagged_text") + _first_seen_sql(
    "tagged_text", "doc_id", _hashtags_sql("text"), "w", "length(word) > 0", out="tag"))
def t12_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash tags (first-seen position) of every document."""
    df = T.hashtags(fixture(spark, sf_dir, "tagged_text"), "text")
    return df.select("doc_id", indexed(F.col("hashtags"), "pos", "tag"))


@register("t12_hashtag_counts", oracle=with_fixtures("tagged_text") + f"""
, t AS (SELECT doc_id, unnest(list_distinct(list_filter({_hashtags_sql('text')}, lambda w: length(w) > 0))) AS tag FROM tagged_text)
SELECT tag, count(*) AS n FROM t GROUP BY tag
""")
def t12_hashtag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents per hash tag."""
    return T.hashtag_counts(fixture(spark, sf_dir, "tagged_text"), "text")


# the oracle knows notes with at most one level of brackets inside, as these texts have
@register("t13_footnotes", oracle=with_fixtures("tagged_text") + r"""
, m AS (SELECT doc_id, regexp_extract_all(text, '\[[^\[\]]{0,3}\. (?:[^\[\]]|\[[^\[\]]*\])*\]') AS notes FROM tagged_text),
b AS (SELECT doc_id, raw, pos, trim(substr(raw, strpos(raw, '. ') + 2, length(raw) - strpos(raw, '. ') - 2), E' \t\n\r') AS note
        FROM (SELECT doc_id, unnest(notes) AS raw, unnest(range(1, len(notes) + 1)) AS pos FROM m)),
f AS (SELECT doc_id, raw, note, min(pos) AS pos FROM b WHERE note <> '' GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS idx, note FROM f
""")
def t13_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed foot notes of every document."""
    return T.footnotes(fixture(spark, sf_dir, "tagged_text"), "doc_id", "text")


def _fold_sql(col: str) -> str:
    x = f"regexp_replace(coalesce({col}, ''), '(?m)\\s*$^\\s*', {NL}, 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)(<[^>]+) style=\".*?\"', '\\1', 'g')"
    return no_null_sql(x)


@register("t14_fold_whitespace", oracle=f"SELECT page_id, {_fold_sql('html')} AS folded FROM pages")
def t14_fold_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace folding and inline-style removal of every page."""
    df = table(spark, sf_dir, "pages").select("page_id", "html")
    return T.fold_whitespace(df, "html", scrub_styles=True).drop("html")


ITEM_TEMPLATE = "<item><title>[NAME]</title><link>[SRC]</link><category>[TYPE]</category>\n  <brand>[BRAND]</brand></item>"


@register("t14_fill_template", oracle=f"""
SELECT p_partkey, replace(regexp_replace(regexp_replace(
         replace(replace(replace(replace({q(ITEM_TEMPLATE)}, '[NAME]', coalesce(p_name, '')), '[SRC]', coalesce(CAST(p_size AS VARCHAR), '')),
                 '[TYPE]', coalesce(p_type, '')), '[BRAND]', coalesce(p_brand, '')),
         '\\r\\n|\\r|\\n|\\t', ' ', 'g'), ' {{2,}}', ' ', 'g'), '> <', '><') AS filled
  FROM part
""")
def t14_fill_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item template filled (and minified) for every part."""
    p = table(spark, sf_dir, "part")
    out = T.fill_template(p, ITEM_TEMPLATE, {"[NAME]": F.col("p_name"), "[SRC]": F.col("p_size"),
                                             "[TYPE]": F.col("p_type"), "[BRAND]": F.col("p_brand")}, minify=True)
    return out.select("p_partkey", "filled")


@register("t15_normalisers", oracle="""
SELECT event_id,
       CASE WHEN coalesce(TRY_CAST(regexp_replace(coalesce(props, ''), '[^0-9+\\-.]', '', 'g') AS DOUBLE), 7.0) = 0
            THEN 7.0 ELSE coalesce(TRY_CAST(regexp_replace(coalesce(props, ''), '[^0-9+\\-.]', '', 'g') AS DOUBLE), 7.0) END AS props_number,
       CASE WHEN length(trim(coalesce(event_type, ''))) > 0 THEN trim(event_type) ELSE 'none' END AS event_type_text,
       coalesce(lower(event_type) IN ('true', 'yes', 'y', 't', 'on', '1'), false) AS event_type_flag
  FROM events
""")
def t15_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, text and yes/no normalisers over every event."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.norm_number(F.col("props"), 7).alias("props_number"),
                    T.norm_text(F.col("event_type"), "none").alias("event_type_text"),
                    T.parse_bool(F.col("event_type")).alias("event_type_flag"))


def _licence_sql() -> str:
    lic = (f"CASE WHEN upper(coalesce(licence_code, '')) IN ({', '.join(q(x) for x in T.LICENCES)}) "
           f"THEN coalesce(licence_code, '') ELSE {q(T.DEFAULT_LICENCE)} END")
    typ = f"lower({no_null_sql(f'replace(replace({lic}, ' + q('CC') + ', ' + q('') + '), ' + q('4.0') + ', ' + q('') + ')')})"
    words = "CASE lower(e) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in T.LICENCE_WORDS.items()) + " ELSE '' END"
    desc = no_null_sql(f"array_to_string(list_transform(string_split({typ}, '-'), lambda e: {words}), '-')")
    return (f"SELECT id, licence_code, {lic} AS licence, {typ} AS licence_type, {desc} AS licence_desc, "
            f"'http://creativecommons.org/licenses/' || {typ} || '/4.0/' AS licence_url FROM licence_request")


@register("t16_licence_text", oracle=with_fixtures("licence_request") + _licence_sql())
def t16_licence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statement parts for every site licence code."""
    return T.licence_text(fixture(spark, sf_dir, "licence_request"), "licence_code")


# ------------------------------------------------------------------------ D*
@register("d1_api_dates", oracle="""
SELECT event_id, CASE WHEN floor(epoch(ts)) BETWEEN 0 AND 1000 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts_api
  FROM events
""")
def d1_api_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO-8601 API form of every event time."""
    return D.api_dates(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"]).drop("ts")


def _strict_sql(x: str) -> str:
    parts = []
    for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        parts.append(f"CASE WHEN strftime(try_strptime({x}, '{fmt}'), '{fmt}') = {x} THEN try_strptime({x}, '{fmt}') END")
    return f"coalesce({', '.join(parts)})"


@register("d2_convert_times", oracle=with_fixtures("local_time") + f"""
SELECT id, coalesce(strftime(timezone('UTC', timezone(tz, {_strict_sql('trim(local_text)')})), '%Y-%m-%d %H:%M:%S'), '') AS local_text_utc,
       strftime(timezone(tz, timezone('UTC', {_strict_sql('trim(local_text)')})), '%Y-%m-%d %H:%M:%S') AS local_text_local
  FROM local_time
""")
def d2_convert_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local → UTC and UTC → local conversion of every order time text."""
    out = D.convert_times(fixture(spark, sf_dir, "local_time"), "local_text", "tz")
    return out.select("id", "local_text_utc", "local_text_local")


def _age_sql(t: str) -> str:
    expr = "''"
    for unit, name in reversed(D.AGE_UNITS):
        n = f"floor({t} / {unit})"
        expr = (f"CASE WHEN {t} >= {unit} THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) || ' {name}' || "
                f"CASE WHEN {n} > 1 THEN 's' ELSE '' END ELSE {expr} END")
    return expr


@register("d3_age_buckets", oracle=f"""
WITH x AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t,
                  CAST(floor(epoch(TIMESTAMP '{AS_OF}')) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS since FROM events)
SELECT event_id, CASE WHEN t > 0 THEN {_age_sql('since')} ELSE '' END AS age,
       CASE WHEN t > 0 AND since > 60 THEN CAST(floor(since / 60) AS BIGINT) ELSE 0 END AS minutes_since,
       CASE WHEN t > 0 AND -since > 60 THEN CAST(floor(-since / 60) AS BIGINT) ELSE 0 END AS minutes_until
  FROM x
""")
def d3_age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: age text and minutes since/until as_of for every event."""
    out = D.age_buckets(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", AS_OF)
    return out.select("event_id", "age", F.col("minutes_since").cast("long").alias("minutes_since"),
                      F.col("minutes_until").cast("long").alias("minutes_until"))


@register("d4_dates_and_durations", oracle=with_fixtures("local_time") + """
, x AS (SELECT l.id, l.local_text, CAST(trunc(o.o_totalprice) AS BIGINT) AS secs FROM local_time l JOIN orders o ON o.o_orderkey = l.id),
h AS (SELECT *, CASE WHEN secs > 3600 THEN substr('00' || CAST(CAST(floor(secs / 3600) AS BIGINT) AS VARCHAR), -2) || ':' ELSE '' END
                || lpad(CAST(CAST(floor(secs / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') AS hms
        FROM x),
p AS (SELECT *, string_split(hms, ':') AS parts FROM h),
q AS (SELECT *, CASE WHEN len(parts) < 3 THEN list_concat(parts, list_transform(range(3 - len(parts)), lambda i: '0')) ELSE parts END AS padded FROM p)
SELECT id, coalesce(strftime(try_strptime(local_text, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') = local_text, false) AS is_valid_date,
       hms,
       CASE WHEN regexp_matches(hms, '[0-9]') THEN CAST(list_sum(list_transform(list_reverse(padded),
            lambda v, i: coalesce(TRY_CAST(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) * pow(60, i - 1))) AS BIGINT)
            ELSE 0 END AS seconds_back
  FROM q
""")
def d4_dates_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict date check of every order time text; order total as a duration text and back."""
    lt = fixture(spark, sf_dir, "local_time")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"),
                                               F.col("o_totalprice").cast("long").alias("secs"))
    j = lt.join(o, "id")
    j = j.withColumn("hms", D.seconds_to_hms(F.col("secs")))
    return j.select("id", D.valid_date(F.col("local_text")).alias("is_valid_date"), "hms",
                    D.hms_to_seconds(F.col("hms")).alias("seconds_back"))


@register("d5_sizes_and_padding", oracle="""
WITH x AS (SELECT p_partkey, greatest(CAST(p_size * 1000 + p_partkey % 700 AS DOUBLE) * p_retailprice, 0.0) AS b FROM part),
y AS (SELECT *, CAST(least(CASE WHEN b > 0 THEN floor(ln(b) / ln(1024.0)) ELSE 0 END, 4) AS INTEGER) AS p FROM x)
SELECT p_partkey,
       regexp_replace(regexp_replace(printf('%.2f', round(b / pow(1024.0, p), 2)), '0+$', ''), '\\.$', '') || ' ' ||
       ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] AS size_text,
       CASE WHEN p_partkey > 0 AND substr(repeat('0', 8) || CAST(p_partkey AS VARCHAR), -8) <> repeat('0', 8)
            THEN substr(repeat('0', 8) || CAST(p_partkey AS VARCHAR), -8) ELSE '' END AS padded
  FROM y
""")
def d5_sizes_and_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable byte size (part size × price) and zero-padded part key for every part."""
    p = table(spark, sf_dir, "part")
    b = (F.col("p_size") * 1000 + F.col("p_partkey") % 700).cast("double") * F.col("p_retailprice")
    return p.select("p_partkey", D.format_bytes(b).alias("size_text"), D.pad_number(F.col("p_partkey")).alias("padded"))


# ------------------------------------------------------------------------ U*
@register("u1_parse_user_agent")
def u1_parse_user_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform, browser and version of every request agent (rows-only; the
    non-Mozilla fallback needs a look-ahead the oracle engine lacks)."""
    raw = fixture(spark, sf_dir, "usage_raw").select("id", "agent")
    return parse_user_agent(raw, "agent", distinct=True).select("id", "platform", "browser", "version")


@register("u2_client_ip", oracle=with_fixtures("ip_headers") + """
, v AS (SELECT *,
          CASE WHEN cf_connecting_ip IS NOT NULL AND (regexp_matches(cf_connecting_ip, '{v4}') OR regexp_matches(cf_connecting_ip, '{v6}')) THEN cf_connecting_ip END AS a,
          CASE WHEN x_forwarded_for IS NOT NULL AND (regexp_matches(x_forwarded_for, '{v4}') OR regexp_matches(x_forwarded_for, '{v6}')) THEN x_forwarded_for END AS b,
          CASE WHEN remote_addr IS NOT NULL AND (regexp_matches(remote_addr, '{v4}') OR regexp_matches(remote_addr, '{v6}')) THEN remote_addr END AS c
        FROM ip_headers)
SELECT request_id, trim(coalesce(a, b, c, 'Invalid IP (' || CAST(greatest(coalesce(length(trim(cf_connecting_ip)), 0),
       coalesce(length(trim(x_forwarded_for)), 0), coalesce(length(trim(remote_addr)), 0)) AS VARCHAR) || ' Characters)')) AS client_ip
  FROM v
""")
def u2_client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client address from three headers for every event request."""
    return client_ip(fixture(spark, sf_dir, "ip_headers")).select("request_id", "client_ip")


def _fill_ip_patterns() -> None:
    from tessera.operators.usage import _IPV4, _IPV6
    from tessera.plans.registry import REGISTRY

    qy = REGISTRY["u2_client_ip"]
    qy.oracle = qy.oracle.replace("{v4}", _IPV4.replace("'", "''")).replace("{v6}", _IPV6.replace("'", "''"))


_fill_ip_patterns()
