"""Relational catalogue queries (countries, accounts, notes, sites)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import AS_OF, fixture, table, with_fixtures
from tessera.operators import catalog as C
from tessera.plans.registry import register


def _f(spark, sf_dir):
    return lambda n: fixture(spark, sf_dir, n)


@register("p1_country_list", oracle=with_fixtures("country") + """
SELECT lower(code) AS code, name, label, sort_order FROM country
 WHERE NOT is_deleted AND is_available ORDER BY sort_order, name
""")
def p1_country_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available countries in display order."""
    return C.country_list(fixture(spark, sf_dir, "country"))


@register("s4_country_dim", oracle="""
SELECT upper(left(n_name, 2)) AS code, n_name AS name, 'lblCountry' || upper(left(n_name, 2)) AS label,
       CASE WHEN upper(left(n_name, 2)) IN ('JP', 'US', 'CA', 'MX', 'CO')
            THEN CASE WHEN upper(left(n_name, 2)) = 'JP' THEN 0 WHEN upper(left(n_name, 2)) IN ('CA', 'US') THEN 10 ELSE 25 END
            ELSE 999 END AS sort_order,
       upper(left(n_name, 2)) IN ('JP', 'US', 'CA', 'MX', 'CO') AS is_available, false AS is_deleted
  FROM nation
""")
def s4_country_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed rules applied to a raw country list (nation names, 2-letter codes)."""
    raw = table(spark, sf_dir, "nation").select(F.upper(F.left("n_name", F.lit(2))).alias("code"),
                                                F.col("n_name").alias("name"))
    return C.build_country_dim(raw)


_P2 = with_fixtures("account", "account_meta") + """
SELECT id AS account_id, type AS account_type, login AS nickname, coalesce(display_name, first_name) AS display_name,
       last_name, first_name, email, locale_code, type IN ('account.global', 'account.admin') AS is_admin,
       EXISTS (SELECT 1 FROM account_meta z WHERE NOT z.is_deleted AND z.account_id = a.id) AS has_meta
  FROM account a WHERE NOT is_deleted
"""


@register("p2_account_profile", oracle=_P2)
def p2_account_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 (+J6): profile of every live account with has_meta."""
    f = _f(spark, sf_dir)
    return C.account_profile(f("account"), f("account_meta"))


@register("p3_entitlement", oracle=with_fixtures("account") + """
SELECT id AS account_id, type,
       CASE WHEN type IN ('account.global', 'account.admin') THEN 'basic|pro|expert|all'
            WHEN type IN ('account.expert', 'account.education') THEN 'basic|pro|expert'
            WHEN type IN ('account.standard', 'account.pro') THEN 'basic|pro' ELSE 'basic' END AS models
  FROM account
""")
def p3_entitlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model tiers of every account."""
    a = fixture(spark, sf_dir, "account")
    return a.select(F.col("id").alias("account_id"), "type", C.entitlement(F.col("type")).alias("models"))


@register("p4_visible_to", oracle=with_fixtures("note", "account", "note_request") + """
SELECT r.request_id, r.account_id AS viewer_id, r.note_id,
       NOT n.is_private OR coalesce(a.id = n.updated_by, false)
         OR coalesce(a.type IN ('account.global', 'account.admin'), false) AS can_read
  FROM note_request r JOIN note n ON n.id = r.note_id AND NOT n.is_deleted
  LEFT JOIN account a ON a.id = r.account_id AND NOT a.is_deleted
""")
def p4_visible_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May each (viewer, note) request read the note?"""
    f = _f(spark, sf_dir)
    req = f("note_request").withColumnRenamed("account_id", "viewer_id")
    return C.visible_to(f("note"), req, f("account")).select("request_id", "viewer_id", "note_id", "can_read")


@register("p5_mask_account", oracle=with_fixtures("account") + """
SELECT id AS account_id, CASE WHEN id % 3 = 0 THEN id ELSE id + 1 END AS viewer_id,
       CASE WHEN id = CASE WHEN id % 3 = 0 THEN id ELSE id + 1 END THEN email END AS email
  FROM account
""")
def p5_mask_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: e-mail masking for every account, viewed by itself or by another account."""
    a = fixture(spark, sf_dir, "account").select(F.col("id").alias("account_id"), "email")
    a = a.withColumn("viewer_id", F.when(F.col("account_id") % 3 == 0, F.col("account_id"))
                     .otherwise(F.col("account_id") + 1))
    return C.mask_account(a).select("account_id", "viewer_id", "email")


@register("j2_meta_rows", oracle=with_fixtures("account", "account_meta") + """
SELECT mm.account_id, mm.key, mm.value
  FROM account acct JOIN account_meta mm ON acct.id = mm.account_id
 WHERE NOT acct.is_deleted AND NOT mm.is_deleted ORDER BY mm.account_id, mm.key
""")
def j2_meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live key/value rows of every live account."""
    f = _f(spark, sf_dir)
    return C.meta_rows(f("account"), f("account_meta"), "account_id")


def _live_meta(parent: str, fk: str) -> str:
    return with_fixtures(parent, f"{parent}_meta") + (
        f"SELECT m.{fk}, m.key, m.value FROM {parent} p JOIN {parent}_meta m ON p.id = m.{fk} WHERE NOT p.is_deleted AND NOT m.is_deleted")


@register("j2_note_meta", oracle=_live_meta("note", "note_id"))
def j2_note_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live key/value rows of every live note."""
    f = _f(spark, sf_dir)
    return C.meta_rows(f("note"), f("note_meta"), "note_id")


@register("j2_site_meta", oracle=_live_meta("site", "site_id"))
def j2_site_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live key/value rows of every live site."""
    f = _f(spark, sf_dir)
    return C.meta_rows(f("site"), f("site_meta"), "site_id")


_J3 = with_fixtures("host_request", "site", "site_url", "site_meta", "locale") + """
, hosts AS (SELECT DISTINCT lower(trim(host)) AS host FROM host_request),
active AS (SELECT site_id, id AS url_id, url AS site_url FROM (
             SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY id) AS rn
               FROM site_url WHERE NOT is_deleted AND is_active) x WHERE rn = 1),
best AS (SELECT a.*, si.https, si.guid AS site_guid, si.name AS site_name, si.locale_code, si.theme, si.is_default
           FROM active a JOIN site si ON si.id = a.site_id AND NOT si.is_deleted),
a10 AS (SELECT * FROM (
          SELECT h.host, b.*, 10 AS sort_order,
                 row_number() OVER (PARTITION BY h.host ORDER BY b.site_id, b.url_id) AS rn
            FROM hosts h JOIN site_url bb ON bb.url = h.host AND NOT bb.is_deleted
            JOIN best b ON b.site_id = bb.site_id) x WHERE rn = 1),
dflt AS (SELECT * FROM best WHERE is_default ORDER BY site_id, url_id LIMIT 1),
res AS (SELECT host, site_id, url_id, site_url, https, site_guid, site_name, locale_code, theme, is_default, sort_order FROM a10
        UNION ALL
        SELECT h.host, d.site_id, d.url_id, d.site_url, d.https, d.site_guid, d.site_name, d.locale_code, d.theme,
               d.is_default, 20 AS sort_order
          FROM hosts h CROSS JOIN dflt d WHERE h.host NOT IN (SELECT host FROM a10))
SELECT r.*, (SELECT min(value) FROM site_meta z WHERE NOT z.is_deleted AND z.key = 'banner.src' AND z.site_id = r.site_id) AS banner_src,
       lo.language_code, r.site_url <> r.host AS do_redirect
  FROM res r LEFT JOIN locale lo ON lo.code = r.locale_code
"""


@register("j3_resolve_host", oracle=_J3)
def j3_resolve_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 (+O2, J5): every request host resolved to a site (alias match, else default site)."""
    f = _f(spark, sf_dir)
    return C.resolve_host(f("host_request"), f("site"), f("site_url"), f("site_meta"), f("locale")).select(
        "host", "site_id", "url_id", "site_url", "https", "site_guid", "site_name", "locale_code", "theme",
        "is_default", "sort_order", "banner_src", "language_code", "do_redirect")


@register("j4_site_by_domain", oracle=with_fixtures("site", "site_url") + """
SELECT domain, site_id FROM (
  SELECT su.url AS domain, su.site_id,
         row_number() OVER (PARTITION BY su.url ORDER BY su.updated_at DESC, su.site_id DESC) AS rn
    FROM site_url su JOIN site si ON si.id = su.site_id
   WHERE NOT su.is_deleted AND NOT si.is_deleted) x
 WHERE rn = 1
""")
def j4_site_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest live site for every live url text."""
    f = _f(spark, sf_dir)
    return C.site_by_domain(f("site_url"), f("site"))


@register("j5_with_meta_value", oracle=with_fixtures("site", "site_meta") + """
SELECT s.id AS site_id, s.name,
       (SELECT min(value) FROM site_meta z WHERE NOT z.is_deleted AND z.key = 'banner.src' AND z.site_id = s.id) AS banner_src
  FROM site s
""")
def j5_with_meta_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banner.src meta value for every site."""
    f = _f(spark, sf_dir)
    s = f("site").select(F.col("id").alias("site_id"), "name")
    return C.with_meta_value(s, f("site_meta"), "banner.src", "site_id", "banner_src")


@register("j7_note_detail", oracle=with_fixtures("note", "account", "note_meta", "note_history") + """
SELECT nn.id AS note_id, nn.type AS note_type, nn.content AS note_text, nn.is_private, nn.updated_by,
       EXISTS (SELECT 1 FROM note_meta z WHERE NOT z.is_deleted AND z.note_id = nn.id) AS has_meta,
       EXISTS (SELECT 1 FROM note_history z WHERE NOT z.is_deleted AND z.note_id = nn.id) AS has_history
  FROM account acct JOIN note nn ON acct.id = nn.updated_by
 WHERE NOT acct.is_deleted AND NOT nn.is_deleted
""")
def j7_note_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 (+J6): every live note of a live editor with has_meta / has_history."""
    f = _f(spark, sf_dir)
    return C.note_detail(f("note"), f("account"), f("note_meta"), f("note_history"))


SESSION_LIFESPAN_DAYS = 10

_J8 = with_fixtures("account", "tokens", "account_meta") + f"""
, meta AS (SELECT account_id,
                  max(CASE WHEN key = 'profile.avatar' THEN value END) AS avatar,
                  max(CASE WHEN key = 'preference.fontfamily' THEN value END) AS pref_fontfamily,
                  max(CASE WHEN key = 'preference.fontsize' THEN value END) AS pref_fontsize,
                  max(CASE WHEN key = 'preference.theme' THEN value END) AS pref_colour,
                  max(CASE WHEN key = 'preference.can_email' THEN value END) AS pref_canemail
             FROM account_meta WHERE NOT is_deleted
              AND key IN ('profile.avatar', 'preference.fontfamily', 'preference.fontsize', 'preference.theme',
                          'preference.can_email', 'permission.can_admin')
            GROUP BY account_id)
SELECT acct.id AS account_id, tt.id AS token_id, tt.guid AS token_guid, acct.email, acct.type, acct.display_name,
       acct.last_name, acct.first_name, acct.locale_code, coalesce(meta.avatar, 'default.png') AS avatar,
       CASE WHEN acct.type IN ('account.global', 'account.admin') THEN 'basic|pro|expert|all'
            WHEN acct.type IN ('account.expert', 'account.education') THEN 'basic|pro|expert'
            WHEN acct.type IN ('account.standard', 'account.pro') THEN 'basic|pro' ELSE 'basic' END AS models,
       meta.pref_fontfamily, meta.pref_fontsize, meta.pref_colour,
       coalesce(upper(meta.pref_canemail) IN ('Y', 'T', '1'), false) AS pref_canemail,
       strftime(tt.created_at, '%Y-%m-%d %H:%M:%S') AS login_at
  FROM account acct JOIN tokens tt ON acct.id = tt.account_id
  LEFT JOIN meta ON meta.account_id = acct.id
 WHERE NOT acct.is_deleted AND NOT tt.is_deleted
   AND tt.updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL {SESSION_LIFESPAN_DAYS} DAY
"""


@register("j8_session_profile", oracle=_J8)
def j8_session_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 (+A3, P3): every live session touched within 10 days of as_of, with preferences."""
    f = _f(spark, sf_dir)
    out = C.session_profile(f("account"), f("tokens"), f("account_meta"), SESSION_LIFESPAN_DAYS, AS_OF)
    return out.withColumn("login_at", F.date_format("login_at", "yyyy-MM-dd HH:mm:ss"))


@register("j9_note_can_edit", oracle=with_fixtures("note", "account", "note_history", "note_request") + """
, pairs AS (SELECT DISTINCT account_id, note_id FROM note_request),
past AS (SELECT DISTINCT note_id, updated_by AS account_id FROM note_history WHERE NOT is_deleted)
SELECT p.account_id, p.note_id,
       CASE WHEN a.id IS NULL THEN false WHEN a.type IN ('account.global', 'account.admin') THEN true
            WHEN n.updated_by = a.id THEN true WHEN n.is_private = false AND pa.account_id = a.id THEN true
            ELSE false END AS can_edit
  FROM pairs p
  LEFT JOIN account a ON a.id = p.account_id AND NOT a.is_deleted
  LEFT JOIN note n ON n.id = p.note_id AND NOT n.is_deleted
  LEFT JOIN past pa ON pa.note_id = p.note_id AND pa.account_id = p.account_id
""")
def j9_note_can_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit permission for every requested (account, note) pair."""
    f = _f(spark, sf_dir)
    return C.note_can_edit(f("note_request"), f("account"), f("note"), f("note_history"))


@register("j10_file_can_edit", oracle=with_fixtures("file", "account", "file_request") + f"""
, pairs AS (SELECT DISTINCT account_id, file_id FROM file_request)
SELECT p.account_id, p.file_id,
       CASE WHEN a.id IS NULL THEN false WHEN a.type IN ('account.global', 'account.admin') THEN true
            WHEN f.id IS NOT NULL THEN true WHEN coalesce(p.file_id, 0) <= 0 THEN true ELSE false END AS can_edit
  FROM pairs p
  LEFT JOIN account a ON a.id = p.account_id AND NOT a.is_deleted
  LEFT JOIN file f ON f.id = p.file_id AND NOT f.is_deleted AND f.account_id = a.id
                  AND coalesce(f.expires_at, TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY) >= TIMESTAMP '{AS_OF}'
""")
def j10_file_can_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit permission for every requested (account, file) pair at as_of."""
    f = _f(spark, sf_dir)
    return C.file_can_edit(f("file_request"), f("account"), f("file"), AS_OF)


@register("j11_best_locale", oracle=with_fixtures("account_request", "locale") + """
, wanted AS (SELECT DISTINCT locale FROM account_request),
ranked AS (SELECT w.locale, l.code, row_number() OVER (PARTITION BY w.locale ORDER BY
                  CASE WHEN l.code = w.locale THEN 0 ELSE 1 END,
                  CASE WHEN l.language_code = left(w.locale, 2) THEN 0 ELSE 1 END,
                  CASE WHEN l.is_available THEN 0 ELSE 1 END, CASE WHEN l.is_default THEN 0 ELSE 1 END, l.code) AS rn
             FROM wanted w CROSS JOIN (SELECT * FROM locale WHERE NOT is_deleted) l)
SELECT r.request_id, r.locale, k.code AS locale_code
  FROM account_request r JOIN ranked k ON k.locale = r.locale AND k.rn = 1
""")
def j11_best_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best locale for every account request (exact, language, available, default)."""
    f = _f(spark, sf_dir)
    return C.best_locale(f("account_request"), f("locale"), "locale").select("request_id", "locale", "locale_code")


@register("j12_match_account", oracle=with_fixtures("account_request", "account") + """
SELECT r.request_id,
       (SELECT min(a.id) FROM account a WHERE NOT a.is_deleted
           AND (a.login = lower(r.login) OR (length(r.email) > 5 AND a.email = lower(r.email)))) AS account_id
  FROM account_request r
""")
def j12_match_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing account (lowest id) for every sign-up request by login or e-mail."""
    f = _f(spark, sf_dir)
    return C.match_account(f("account_request"), f("account")).select("request_id", "account_id")


@register("j13_url_conflicts", oracle=with_fixtures("site_request", "site", "site_url") + """
SELECT r.request_id, r.url,
       EXISTS (SELECT 1 FROM site_url su JOIN site si ON si.id = su.site_id
                WHERE NOT su.is_deleted AND NOT si.is_deleted AND su.is_active AND su.url = lower(r.url)) AS url_taken
  FROM site_request r
""")
def j13_url_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each requested site url already taken by a live site?"""
    f = _f(spark, sf_dir)
    return C.url_conflicts(f("site_request"), f("site"), f("site_url")).select("request_id", "url", "url_taken")


@register("j14_localise", oracle=with_fixtures("state", "label_text") + """
SELECT s.id, s.name, s.label,
       coalesce(nullif(trim((SELECT max(value) FROM label_text t WHERE t.label = s.label)), ''), s.name) AS display
  FROM state s
""")
def j14_localise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localised state names with fallback to the stored name."""
    f = _f(spark, sf_dir)
    return C.localise(f("state"), f("label_text"), "label", "name").select("id", "name", "label", "display")


@register("a3_pivot_meta", oracle=with_fixtures("account_meta") + """
SELECT account_id,
       max(CASE WHEN key = 'profile.avatar' THEN value END) AS avatar,
       max(CASE WHEN key = 'preference.can_email' THEN value END) AS can_email,
       max(CASE WHEN key = 'preference.fontsize' THEN value END) AS fontsize,
       max(CASE WHEN key = 'preference.theme' THEN value END) AS theme
  FROM account_meta WHERE NOT is_deleted
   AND key IN ('profile.avatar', 'preference.can_email', 'preference.fontsize', 'preference.theme')
 GROUP BY account_id
""")
def a3_pivot_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: account preferences pivoted to columns."""
    return C.pivot_meta(fixture(spark, sf_dir, "account_meta"), "account_id", {
        "profile.avatar": "avatar", "preference.can_email": "can_email",
        "preference.fontsize": "fontsize", "preference.theme": "theme"})


@register("a4_site_url_summary", oracle=with_fixtures("site_request", "site", "site_url") + """
SELECT r.request_id, r.site_id,
       (SELECT max(su.id) FROM site_url su WHERE NOT su.is_deleted AND su.site_id = r.site_id AND su.url = lower(r.url)) AS url_id,
       (SELECT count(su.id) FROM site_url su WHERE NOT su.is_deleted AND su.site_id = r.site_id) AS url_count
  FROM site_request r JOIN site s ON s.id = r.site_id AND NOT s.is_deleted
""")
def a4_site_url_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: for every site request, the matching live url id and the site's live url count."""
    f = _f(spark, sf_dir)
    return C.site_url_summary(f("site"), f("site_url"), f("site_request"))


@register("s1_live_scan", oracle="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F')
""")
def s1_live_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live-row scan (the delete flag here: order status 'F' = closed); the
    filter and the three-column projection reach the Parquet reader."""
    from tessera.sources.tables import live

    o = table(spark, sf_dir, "orders").withColumn("is_deleted", F.col("o_orderstatus") == "F")
    return live(o).select("o_orderkey", "o_custkey", "o_totalprice")


@register("j6_with_exists_flag", oracle=with_fixtures("location", "location_meta") + """
SELECT l.id, EXISTS (SELECT 1 FROM location_meta z WHERE NOT z.is_deleted AND z.location_id = l.id) AS has_meta
  FROM location l
""")
def j6_with_exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """has_meta flag (any live meta row) of every location."""
    f = _f(spark, sf_dir)
    return C.with_exists_flag(f("location").select("id"), f("location_meta"), "id", "location_id", "has_meta")


@register("j12_match_email", oracle=with_fixtures("lookup_request", "account") + """
SELECT r.request_id, (SELECT min(a.id) FROM account a WHERE NOT a.is_deleted AND a.type <> 'account.expired'
                         AND length(r.lookup) >= 3 AND a.email = r.lookup) AS account_id
  FROM lookup_request r
""")
def j12_match_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account of every forgotten-password request, by exact e-mail."""
    f = _f(spark, sf_dir)
    return C.match_email(f("lookup_request"), f("account")).select("request_id", "account_id")


@register("j12_match_login", oracle=with_fixtures("lookup_request", "account") + """
SELECT r.request_id, (SELECT min(a.id) FROM account a WHERE NOT a.is_deleted AND a.type <> 'account.expired'
                         AND length(r.lookup) >= 3 AND length(r.password) >= 8
                         AND a.email = lower(r.lookup) AND 'password' || CAST(a.id % 2 AS VARCHAR) = r.password) AS account_id
  FROM lookup_request r
""")
def j12_match_login(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account of every log-in request, by e-mail and password."""
    f = _f(spark, sf_dir)
    plain = F.concat(F.lit("password"), (F.col("id") % 2).cast("string"))
    acct = f("account").withColumn("password", F.sha2(F.concat(F.lit("pepper"), plain), 512))
    return C.match_login(f("lookup_request"), acct, "pepper").select("request_id", "account_id")


@register("p5_mask_file", oracle=with_fixtures("file", "account") + """
SELECT f.id AS file_id, f.name, v.type AS viewer_type,
       CASE WHEN coalesce(v.type, 'account.guest') <> 'account.guest' THEN f.account_id END AS account_id,
       CASE WHEN coalesce(v.type, 'account.guest') <> 'account.guest' THEN o.display_name END AS owner_name
  FROM file f LEFT JOIN account o ON o.id = f.account_id
  LEFT JOIN account v ON v.id = f.id % 90 AND NOT v.is_deleted
""")
def p5_mask_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: owner of every file, masked for guests (viewers without a live account)."""
    f = _f(spark, sf_dir)
    owner = f("account").select(F.col("id").alias("account_id"), F.col("display_name").alias("owner_name"))
    viewer = f("account").filter(~F.col("is_deleted")).select(F.col("id").alias("_v"), F.col("type").alias("viewer_type"))
    files = f("file").join(owner, "account_id", "left").withColumn("_k", F.col("id") % 90).join(viewer, F.col("_k") == F.col("_v"), "left")
    return C.mask_file(files).select(F.col("id").alias("file_id"), "name", "viewer_type", "account_id", "owner_name")
