"""Label, locale and key/value shaping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import __version__
from tessera.fixtures import AS_OF_DATE, fixture, with_fixtures
from tessera.operators import content as C
from tessera.plans.oracle_sql import no_null_sql, q
from tessera.plans.registry import register
from tessera.plans.request_queries import LOCALES

DEFAULT_LOCALE = "en_US"
LABEL_TOKENS = {"{version_id}": __version__, "{year}": AS_OF_DATE[:4]}


@register("j15_overlay_labels", oracle=with_fixtures("label_file", "account_request") + f"""
, req AS (SELECT DISTINCT lower(replace(coalesce(locale, ''), '_', '-')) AS locale FROM account_request),
cands AS (SELECT locale, 'en-us' AS lang_code, 1 AS prio FROM req
          UNION ALL SELECT locale, left(locale, 2), 2 FROM req WHERE length(locale) > 2
          UNION ALL SELECT locale, locale, 3 FROM req),
lab AS (SELECT lower(replace(coalesce(lang_code, ''), '_', '-')) AS lang_code, key,
               replace(replace({no_null_sql('value')}, '{{version_id}}', {q(__version__)}), '{{year}}', {q(AS_OF_DATE[:4])}) AS value
          FROM label_file)
SELECT c.locale, l.key, arg_max(l.value, c.prio) AS value FROM cands c JOIN lab l USING (lang_code) GROUP BY c.locale, l.key
""")
def j15_overlay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label strings for every requested locale (default, then language, then locale)."""
    return C.overlay_labels(fixture(spark, sf_dir, "label_file"), fixture(spark, sf_dir, "account_request"),
                            DEFAULT_LOCALE, LABEL_TOKENS)


def _negotiate_sql() -> str:
    locs = "[" + ", ".join(q(x) for x in LOCALES) + "]"
    cookie = no_null_sql("cookie_lang")
    segs = f"list_transform(string_split({no_null_sql('request_uri')}, '/'), lambda p: lower({no_null_sql('p')}))"
    in_path = f"list_filter({segs}, lambda p: length(p) > 0 AND list_contains({locs}, p))[1]"
    opts = (f"list_filter(list_transform(regexp_split_to_array({no_null_sql('accept_language')} || '|', '[,;|]'), "
            f"lambda o: lower({no_null_sql(chr(39).join(['translate(o, ', '_', ', ', '-', ')']))})), lambda o: length(o) >= 2)")
    picks = (f"list_transform({opts}, lambda o: CASE WHEN list_contains({locs}, o) THEN o "
             f"ELSE list_filter({locs}, lambda l: left(l, 2) = o)[1] END)")
    chosen = (f"lower(coalesce(CASE WHEN length({cookie}) BETWEEN 2 AND 5 THEN {cookie} END, {in_path}, "
              f"list_filter({picks}, lambda p: p IS NOT NULL)[1], ''))")
    return f"CASE WHEN list_contains({locs}, {chosen}) THEN {chosen} ELSE 'en-us' END"


@register("j16_negotiate_locale", oracle=with_fixtures("lang_request") + f"""
SELECT request_id, {_negotiate_sql()} AS display_lang FROM lang_request
""")
def j16_negotiate_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display language of every request (explicit, path, Accept-Language, default)."""
    out = C.negotiate_locale(fixture(spark, sf_dir, "lang_request"), LOCALES, "en-us")
    return out.select("request_id", "display_lang")


def _nest_sql() -> str:
    segs = f"list_transform(string_split({no_null_sql('key')}, '.'), lambda s: lower({no_null_sql('s')}))"
    num = f"TRY_CAST(trim(value) AS DOUBLE)"
    val = f"CASE WHEN {num} IS NOT NULL THEN CAST({num} AS VARCHAR) ELSE to_json({no_null_sql('value')})::VARCHAR END"

    def members(src: str, keys: str, name: str) -> str:
        return (f"SELECT {keys}, '{{' || string_agg(to_json({name})::VARCHAR || ':' || v, ',' ORDER BY to_json({name})::VARCHAR || ':' || v) || '}}' AS obj "
                f"FROM {src} GROUP BY {keys}")
    return f"""
, m0 AS (SELECT file_id, {segs} AS s, {val} AS v FROM file_meta WHERE NOT is_deleted),
m AS (SELECT file_id, len(s) AS d, s[1] AS k1, s[2] AS k2, s[3] AS k3, s[4] AS k4, v FROM m0 WHERE len(s) BETWEEN 2 AND 4),
l4 AS ({members("(SELECT * FROM m WHERE d = 4)", "file_id, k1, k2, k3", "k4")}),
i3 AS (SELECT file_id, k1, k2, k3, v FROM m WHERE d = 3 UNION ALL SELECT file_id, k1, k2, k3, obj FROM l4),
l3 AS ({members("i3", "file_id, k1, k2", "k3")}),
i2 AS (SELECT file_id, k1, k2, v FROM m WHERE d = 2 UNION ALL SELECT file_id, k1, k2, obj FROM l3),
l2 AS ({members("i2", "file_id, k1", "k2")}),
i1 AS (SELECT file_id, k1, obj AS v FROM l2)
SELECT file_id, obj AS meta_json FROM ({members("i1", "file_id", "k1")}) x
"""


@register("a5_nest_meta", oracle=with_fixtures("file_meta") + _nest_sql())
def a5_nest_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: nested meta document of every file (2–4 level dotted keys)."""
    return C.nest_meta(fixture(spark, sf_dir, "file_meta"), "file_id")


_MELT = [("stripe.id", "id", 10), ("stripe.name", "name", 10), ("contact.phone", "phone", 10),
         ("contact.email", "email", 10), ("address.postal_code", "postal_code", 0), ("address.country", "country", 0),
         ("address.state", "state", 0), ("address.line1", "line1", 0), ("address.line2", "line2", 0),
         ("address.city", "city", 0)]


@register("a6_melt_customer", oracle=with_fixtures("customer_record") + "\n UNION ALL\n".join(
    f"SELECT customer_id, {q(k)} AS key, {no_null_sql(c)} AS value FROM customer_record WHERE length({no_null_sql(c)}) > {n}"
    for k, c, n in _MELT))
def a6_melt_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta rows of every external customer record."""
    return C.melt_customer(fixture(spark, sf_dir, "customer_record"))


@register("a8_review_stats", oracle=with_fixtures("location_review") + """
SELECT location_id, round(avg(CAST(rating AS DOUBLE)), 3) AS rating_avg, count(*) AS review_count
  FROM location_review WHERE NOT is_deleted GROUP BY location_id
""")
def a8_review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rating and review count of every reviewed place."""
    return C.review_context(fixture(spark, sf_dir, "location_review"))[0]


@register("a8_review_blocks", oracle=with_fixtures("location_review") + f"""
SELECT location_id, strftime(publish_at, '%Y-%m-%d %H:%M:%S') AS publish_at, key AS review_key,
       {no_null_sql('content')} || chr(10) || '----------' || chr(10) AS block
  FROM location_review WHERE NOT is_deleted
""")
def a8_review_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review text blocks (with dash separators) of every reviewed place."""
    blocks = C.review_context(fixture(spark, sf_dir, "location_review"))[1]
    return blocks.withColumn("publish_at", F.date_format("publish_at", "yyyy-MM-dd HH:mm:ss"))
