"""Batch-merge queries (write rules) over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import AS_OF, fixture, with_fixtures
from tessera.functions.text import EMAIL_PATTERN
from tessera.operators import merge as M
from tessera.plans.registry import register

SALT = "tessera-salt"


def _f(spark, sf_dir):
    return lambda n: fixture(spark, sf_dir, n)


@register("m1_merge_meta", oracle=with_fixtures("account", "account_meta", "meta_change") + """
, c AS (SELECT account_id, lower(trim(key)) AS key, trim(coalesce(value, '')) AS value, seq FROM meta_change
         WHERE contains(lower(trim(key)), '.') AND account_id IN (SELECT id FROM account WHERE NOT is_deleted)),
last AS (SELECT account_id, key, arg_max(value, seq) AS _new FROM c GROUP BY account_id, key)
SELECT coalesce(m.account_id, l.account_id) AS account_id, coalesce(m.key, l.key) AS key,
       CASE WHEN l._new IS NOT NULL THEN l._new ELSE m.value END AS value,
       CASE WHEN l._new IS NOT NULL THEN length(l._new) = 0 ELSE m.is_deleted END AS is_deleted,
       l._new IS NOT NULL AS touched
  FROM account_meta m FULL OUTER JOIN last l ON m.account_id = l.account_id AND m.key = l.key
""")
def m1_merge_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: apply every account-meta change (last per key wins) to the account meta table."""
    f = _f(spark, sf_dir)
    out = M.merge_meta(f("account_meta"), f("meta_change"), f("account"), "account_id", AS_OF)
    return out.select("account_id", "key", "value", "is_deleted", "touched")


def _merged_meta(parent: str, fk: str) -> str:
    return with_fixtures(parent, f"{parent}_meta", f"{parent}_meta_change") + f"""
, c AS (SELECT {fk}, lower(trim(key)) AS key, trim(coalesce(value, '')) AS value, seq FROM {parent}_meta_change x
         WHERE strpos(key, '.') > 0 AND EXISTS (SELECT 1 FROM {parent} p WHERE p.id = x.{fk} AND NOT p.is_deleted)),
last AS (SELECT {fk}, key, value FROM (SELECT *, row_number() OVER (PARTITION BY {fk}, key ORDER BY seq DESC) AS k FROM c) WHERE k = 1)
SELECT {fk}, key, value, value = '' AS is_deleted, true AS touched FROM last
UNION ALL SELECT {fk}, key, value, is_deleted, false FROM {parent}_meta m
 WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.{fk} = m.{fk} AND l.key = m.key)
"""


@register("m1_merge_note_meta", oracle=_merged_meta("note", "note_id"))
def m1_merge_note_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: apply every note-meta change to the note meta table."""
    f = _f(spark, sf_dir)
    return M.merge_meta(f("note_meta"), f("note_meta_change"), f("note"), "note_id", AS_OF).drop("updated_at")


@register("m1_merge_file_meta", oracle=_merged_meta("file", "file_id"))
def m1_merge_file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: apply every file-meta change to the file meta table."""
    f = _f(spark, sf_dir)
    return M.merge_meta(f("file_meta"), f("file_meta_change"), f("file"), "file_id", AS_OF).drop("updated_at")


def _note_states(spark, sf_dir):
    v = fixture(spark, sf_dir, "note_version")
    return M.merge_notes(v.filter(F.col("version") == 0), v.filter(F.col("version") > 0), AS_OF)


_M2_BASE = with_fixtures("note_version") + """
, s AS (SELECT *, lead(type) OVER w AS nt, lead(content) OVER w AS nc, lead(is_private) OVER w AS np,
               lead(version) OVER w AS nv
          FROM note_version WINDOW w AS (PARTITION BY note_id ORDER BY version))
"""


@register("m2_note_history", oracle=_M2_BASE + """
SELECT note_id, version, type, content, is_private FROM s
 WHERE nv IS NOT NULL AND (type <> nt OR content <> nc OR is_private <> np)
""")
def m2_note_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: history rows written while applying every note version in order."""
    return _note_states(spark, sf_dir)[1].select("note_id", "version", "type", "content", "is_private")


@register("m2_notes_current", oracle=_M2_BASE + """
SELECT note_id, version, type, content, is_private FROM s WHERE nv IS NULL
""")
def m2_notes_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: final note rows after all versions (guid kept, hash recomputed)."""
    return _note_states(spark, sf_dir)[0].select("note_id", "version", "type", "content", "is_private")


_M3 = with_fixtures("note", "account", "note_history", "note_change").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, r AS (SELECT request_id, account_id, coalesce(note_id, 0) AS note_id, trim(coalesce(content, '')) AS content,
               CASE WHEN lower(trim(coalesce(type, ''))) IN ({", ".join(f"'{t}'" for t in M.NOTE_TYPES)})
                    THEN lower(trim(type)) ELSE 'note.normal' END AS type,
               upper(trim(coalesce(private, ''))) IN ('Y', '1', 'TRUE') AS is_private
          FROM note_change),
q AS (SELECT r.*, row_number() OVER (PARTITION BY r.note_id ORDER BY request_id) AS k, a.type IN ('account.global', 'account.admin') AS admin
        FROM r JOIN account a ON a.id = r.account_id AND NOT a.is_deleted JOIN note n ON n.id = r.note_id WHERE r.note_id > 0),
-- one row a note and request: the note after it
st AS (SELECT n.id AS note_id, 0::BIGINT AS k, n.type, n.content, n.is_private, n.is_deleted, n.updated_by, false AS ok,
              coalesce((SELECT list(DISTINCT h.updated_by) FROM note_history h WHERE h.note_id = n.id AND NOT h.is_deleted), []) AS past
         FROM note n WHERE n.id IN (SELECT note_id FROM q)
       UNION ALL
       SELECT note_id, k, CASE WHEN can THEN t ELSE type END, CASE WHEN can AND length(c) > 0 THEN c ELSE content END,
              CASE WHEN can THEN p ELSE is_private END, CASE WHEN can THEN length(c) = 0 ELSE is_deleted END,
              CASE WHEN can THEN a ELSE updated_by END, can,
              CASE WHEN can AND NOT is_deleted AND (t <> type OR p <> is_private OR (length(c) > 0 AND c <> content))
                   THEN list_append(past, updated_by) ELSE past END
         FROM (SELECT st.note_id, q.k, st.type, st.content, st.is_private, st.is_deleted, st.updated_by, st.past,
                      q.type AS t, q.content AS c, q.is_private AS p, q.account_id AS a,
                      q.admin OR (NOT st.is_deleted AND (st.updated_by = q.account_id
                                                         OR (NOT st.is_private AND list_contains(st.past, q.account_id)))) AS can
                 FROM st JOIN q ON q.note_id = st.note_id AND q.k = st.k + 1)),
ok AS (SELECT q.* FROM q JOIN st ON st.note_id = q.note_id AND st.k = q.k AND st.ok),
agg AS (SELECT note_id, arg_max(type, request_id) AS type, arg_max(is_private, request_id) AS is_private,
               arg_max(length(content) = 0, request_id) AS is_deleted, arg_max(account_id, request_id) AS updated_by,
               arg_max(content, CASE WHEN length(content) > 0 THEN request_id END) AS last_content
          FROM ok GROUP BY note_id)
SELECT CAST(a.note_id AS BIGINT) AS id, a.type, coalesce(a.last_content, n.content) AS content, a.is_private, a.is_deleted,
       a.updated_by, 'update' AS action
  FROM agg a JOIN note n ON n.id = a.note_id
UNION ALL
SELECT CAST((SELECT coalesce(max(id), 0) FROM note) + r.request_id AS BIGINT), r.type, r.content, r.is_private, false,
       r.account_id, 'insert'
  FROM r WHERE r.note_id <= 0 AND length(r.content) > 0 AND r.account_id IN (SELECT id FROM account WHERE NOT is_deleted)
"""


@register("m3_apply_note_changes", oracle=_M3)
def m3_apply_note_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 (+J9): apply every note write request (permissions, type pick, blank = delete)."""
    f = _f(spark, sf_dir)
    return M.apply_note_changes(f("note"), f("note_change"), f("account"), f("note_history"))


@register("m4_enforce_active_url", oracle=with_fixtures("site_url", "url_change") + f"""
, c AS (SELECT id, site_id, lower(trim(url)) AS url, is_active, false AS is_deleted, TIMESTAMP '{AS_OF}' AS updated_at
           FROM url_change x WHERE NOT EXISTS (SELECT 1 FROM url_change y WHERE y.id = x.id AND y.seq > x.seq)),
merged AS (SELECT id, site_id, url, is_active, is_deleted, updated_at FROM site_url WHERE id NOT IN (SELECT id FROM c)
           UNION ALL SELECT * FROM c),
win AS (SELECT site_id, id AS _win FROM (
          SELECT site_id, id, row_number() OVER (PARTITION BY site_id ORDER BY updated_at DESC, id DESC) AS rn
            FROM merged WHERE is_active AND NOT is_deleted) x WHERE rn = 1)
SELECT m.id, m.site_id, m.url, m.is_active AND m.id = w._win AS is_active, m.is_deleted,
       m.site_id IN (SELECT site_id FROM url_change) AS site_touched
  FROM merged m LEFT JOIN win w ON w.site_id = m.site_id
""")
def m4_enforce_active_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: upsert every url change and keep one active url per site."""
    f = _f(spark, sf_dir)
    return M.enforce_active_url(f("site_url"), f("url_change"), AS_OF).drop("updated_at")


@register("m5_soft_delete", oracle=with_fixtures("account") + """
SELECT id, is_deleted OR id IN (SELECT CAST(c_custkey + 1 AS INT) FROM customer WHERE c_acctbal < 0) AS is_deleted,
       CASE WHEN id IN (SELECT CAST(c_custkey + 1 AS INT) FROM customer WHERE c_acctbal < 0) THEN 'account.expired'
            ELSE type END AS type
  FROM account
""")
def m5_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: soft-delete (and expire) every account whose customer balance is negative."""
    acct = fixture(spark, sf_dir, "account")
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(F.col("c_acctbal") < 0) \
        .select((F.col("c_custkey") + 1).cast("int").alias("id"))
    out = M.soft_delete(acct, keys, "id", {"type": F.lit("account.expired")})
    return out.select("id", "is_deleted", "type")


@register("m6_stamp_rows", oracle=with_fixtures("file_stamp") + f"""
SELECT id, true AS has_guid, strftime(coalesce(start_at, TIMESTAMP '{AS_OF}'), '%Y-%m-%d %H:%M:%S') AS start_at,
       CASE WHEN TIMESTAMP '{AS_OF}' > coalesce(until_at, TIMESTAMP '{AS_OF}') THEN false ELSE is_active END AS is_active,
       '{AS_OF}' AS updated_at
  FROM file_stamp
""")
def m6_stamp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: guid, start default, expiry and update stamps on every file row."""
    out = M.stamp_rows(fixture(spark, sf_dir, "file_stamp"), AS_OF)
    return out.select("id", F.col("guid").isNotNull().alias("has_guid"),
                      F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "is_active",
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


# requests are applied one after another, as sequential calls would be
_M7 = with_fixtures("account_signup", "account", "locale").replace("WITH ", "WITH RECURSIVE ", 1) + """
, r AS (SELECT *, length(coalesce(nickname, '')) < 3 OR length(coalesce(password, '')) < 8
                  OR (length(coalesce(email, '')) > 0 AND length(coalesce(email, '')) < 6) AS rej
          FROM account_signup),
ok AS (SELECT *, lower(trim(left(nickname, 64))) AS login FROM r WHERE NOT rej),
m AS (SELECT ok.request_id,
             (SELECT min(a.id) FROM account a WHERE NOT a.is_deleted
                 AND (a.login = lower(ok.nickname) OR (length(ok.email) > 5 AND a.email = lower(ok.email)))) AS mid
        FROM ok),
ok2 AS (SELECT ok.*, m.mid, a.type AS mtype FROM ok JOIN m USING (request_id)
          LEFT JOIN account a ON a.id = m.mid AND NOT a.is_deleted),
seq AS (SELECT *, row_number() OVER (ORDER BY request_id) AS n, CASE WHEN length(email) > 5 THEN lower(email) END AS mk
          FROM ok2 WHERE mid IS NULL),
walk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS logins, []::VARCHAR[] AS mails, []::BIGINT[] AS ids, NULL::BIGINT AS first
         UNION ALL
         SELECT n, CASE WHEN f IS NULL THEN list_append(logins, login) ELSE logins END,
                CASE WHEN f IS NULL THEN list_append(mails, coalesce(mk, '')) ELSE mails END,
                CASE WHEN f IS NULL THEN list_append(ids, request_id::BIGINT) ELSE ids END, coalesce(f, request_id)
           FROM (SELECT s.n, s.login, s.mk, s.request_id, w.logins, w.mails, w.ids,
                        least(w.ids[list_position(w.logins, s.login)], w.ids[list_position(w.mails, s.mk)]) AS f
                   FROM walk w JOIN seq s ON s.n = w.n + 1) x),
new AS (SELECT seq.*, walk.first FROM seq JOIN walk USING (n)),
ex AS (SELECT *, lower(CASE WHEN type LIKE 'account.%' THEN type ELSE 'account.basic' END) AS it FROM ok2 WHERE mid IS NOT NULL),
fx AS (SELECT mid, min(request_id) AS f, arg_min(it, request_id) AS nt FROM ex
        WHERE mtype = 'account.expired' AND it <> 'account.expired' GROUP BY mid),
wanted AS (SELECT DISTINCT locale FROM new),
ranked AS (SELECT w.locale, l.code, row_number() OVER (PARTITION BY w.locale ORDER BY
                  CASE WHEN l.code = w.locale THEN 0 ELSE 1 END,
                  CASE WHEN l.language_code = left(w.locale, 2) THEN 0 ELSE 1 END,
                  CASE WHEN l.is_available THEN 0 ELSE 1 END, CASE WHEN l.is_default THEN 0 ELSE 1 END, l.code) AS rn
             FROM wanted w CROSS JOIN (SELECT * FROM locale WHERE NOT is_deleted) l)
SELECT n.request_id, CASE WHEN n.request_id = n.first THEN 'insert' ELSE 'duplicate' END AS action,
       CAST((SELECT coalesce(max(id), 0) FROM account) + n.first AS BIGINT) AS account_id, n.login,
       trim(left(CASE WHEN coalesce(n.display_name, '') <> '' THEN n.display_name ELSE n.first_name END, 80)) AS display_name,
       trim(left(n.last_name, 120)) AS last_name, trim(left(n.first_name, 120)) AS first_name,
       trim(left(lower(n.email), 160)) AS email,
       CASE WHEN upper(coalesce(n.gender, '')) IN ('F', 'G') THEN 'F' ELSE 'M' END AS gender,
       k.code AS locale_code, n.timezone,
       lower(CASE WHEN n.type LIKE 'account.%' THEN n.type ELSE 'account.basic' END) AS type
  FROM new n LEFT JOIN ranked k ON k.locale = n.locale AND k.rn = 1
UNION ALL
SELECT request_id, CASE WHEN mtype = 'account.expired' AND NOT coalesce(request_id > f, false) THEN 'reactivate' ELSE 'match' END,
       CAST(ex.mid AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN mtype <> 'account.expired' THEN mtype WHEN coalesce(request_id > f, false) THEN nt ELSE it END
  FROM ex LEFT JOIN fx ON fx.mid = ex.mid
UNION ALL
SELECT request_id, 'reject', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE rej
"""

_M7_COLS = ["request_id", "action", "account_id", "login", "display_name", "last_name", "first_name", "email",
            "gender", "locale_code", "timezone", "type"]


@register("m7_create_accounts", oracle=_M7)
def m7_create_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 (+J11, J12): decision and written fields for every sign-up request."""
    f = _f(spark, sf_dir)
    decisions, _ = M.create_accounts(f("account_signup"), f("account"), f("locale"), SALT)
    return decisions.select(*_M7_COLS)


@register("m7_default_meta", oracle=_M7.split("\nSELECT n.request_id")[0] + """
, ins AS (SELECT CAST((SELECT coalesce(max(id), 0) FROM account) + first AS BIGINT) AS account_id
            FROM new WHERE request_id = first)
SELECT account_id, k.key, k.value FROM ins CROSS JOIN (
  SELECT 'profile.avatar' AS key, 'default.png' AS value UNION ALL SELECT 'profile.bio', ''
  UNION ALL SELECT 'profile.location', '' UNION ALL SELECT 'preference.can_email', 'N'
  UNION ALL SELECT 'preference.fontfamily', 'auto' UNION ALL SELECT 'preference.fontsize', 'md'
  UNION ALL SELECT 'preference.theme', 'default') k
""")
def m7_default_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: default meta rows of every account created from the sign-up requests."""
    f = _f(spark, sf_dir)
    _, meta = M.create_accounts(f("account_signup"), f("account"), f("locale"), SALT)
    return meta


@register("m8_update_accounts", oracle=with_fixtures("account", "account_update") + """
, c AS (SELECT u.* FROM account_update u JOIN account a ON a.id = u.account_id AND a.guid = u.account_guid
         WHERE NOT a.is_deleted),
last AS (SELECT account_id, arg_max(display_name, request_id) AS display_name, arg_max(email, request_id) AS email,
                arg_max(gender, request_id) AS gender, arg_max(locale_code, request_id) AS locale_code
           FROM c GROUP BY account_id)
SELECT a.id, coalesce(l.display_name, a.display_name) AS display_name,
       CASE WHEN l.account_id IS NOT NULL THEN lower(l.email) ELSE a.email END AS email,
       CASE WHEN l.account_id IS NOT NULL THEN CASE WHEN upper(l.gender) IN ('F', 'G') THEN 'F' ELSE 'M' END END AS gender,
       coalesce(l.locale_code, a.locale_code) AS locale_code, l.account_id IS NOT NULL AS updated
  FROM account a LEFT JOIN last l ON l.account_id = a.id
""")
def m8_update_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: apply every profile update matched by (id, guid) of a live account."""
    f = _f(spark, sf_dir)
    out = M.update_accounts(f("account"), f("account_update"))
    return out.select("id", "display_name", "email", "gender", "locale_code", "updated")


_M9 = with_fixtures("file_register", "account", "file") + f"""
, a AS (SELECT id AS account_id, type IN ('account.global', 'account.admin') AS admin FROM account WHERE NOT is_deleted),
f AS (SELECT account_id AS owner, guid, id AS file_id, expires_at AS runs_to FROM file WHERE NOT is_deleted),
j AS (SELECT r.*, coalesce(r.file_guid, '') AS g, a.admin, f.owner, f.file_id, f.runs_to
        FROM file_register r LEFT JOIN a ON a.account_id = r.account_id
        LEFT JOIN f ON f.guid = coalesce(r.file_guid, '')),
d AS (SELECT *,
        length(coalesce(local_name, '')) >= 3 AND length(coalesce(file_name, '')) >= 3 AND length(coalesce(mimetype, '')) >= 3
        AND (length(g) = 0 OR length(g) = 36) AND coalesce(bytes, 0) >= 1 AS valid,
        admin IS NOT NULL AND (admin OR length(g) = 0 OR coalesce(owner = account_id
          AND coalesce(runs_to, TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY) >= TIMESTAMP '{AS_OF}', false)) AS can
        FROM j)
SELECT request_id, account_id,
       CASE WHEN NOT valid OR NOT coalesce(can, false) THEN 'reject'
            WHEN length(g) = 36 AND file_id IS NULL THEN 'reject'
            WHEN length(g) = 36 THEN 'update' ELSE 'insert' END AS action,
       CASE WHEN length(g) = 36 THEN file_id END AS file_id,
       CASE WHEN length(g) <> 36 THEN trim(left(local_name, 64)) END AS name, trim(left(file_name, 256)) AS public_name,
       CASE WHEN length(g) <> 36 THEN trim(left(path, 256)) END AS location,
       CASE WHEN length(g) <> 36 THEN greatest(coalesce(bytes, 0), 0) END AS bytes,
       CASE WHEN length(g) <> 36 THEN file_hash END AS hash, lower(trim(left(mimetype, 64))) AS mimetype,
       strftime(CASE WHEN length(coalesce(expires_at, '')) >= 10 THEN TRY_CAST(expires_at AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS expires_at,
       lower(coalesce(access, '')) <> 'public-read-write' AS is_readonly, lower(coalesce(access, '')) <> 'private' AS is_public
  FROM d
"""


@register("m9_register_files", oracle=_M9)
def m9_register_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 (+J10): decision and written fields for every file register/update request."""
    f = _f(spark, sf_dir)
    out = M.register_files(f("file_register"), f("account"), f("file"), AS_OF)
    return out.withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


@register("m10_intake_messages", oracle=with_fixtures("contact_request") + f"""
, x AS (SELECT request_id, trim(coalesce(name, '')) AS n,
               CASE WHEN regexp_matches(lower(trim(coalesce(mail, ''))), '{EMAIL_PATTERN.replace("'", "''")}')
                    THEN lower(trim(coalesce(mail, ''))) ELSE '' END AS m,
               trim(coalesce(subject, '')) AS s, trim(coalesce(message, '')) AS msg
          FROM contact_request)
SELECT request_id, length(n) > 0 AND length(m) > 0 AND length(msg) > 0 AS accepted,
       CASE WHEN length(n) > 0 THEN left(n, 512) END AS clean_name,
       CASE WHEN length(m) > 0 THEN lower(left(m, 160)) END AS clean_mail,
       CASE WHEN length(s) > 0 THEN left(s, 512) END AS clean_subject, msg AS clean_message
  FROM x
""")
def m10_intake_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 (+T11): contact intake rules for every message request."""
    out = M.intake_messages(fixture(spark, sf_dir, "contact_request"))
    return out.select("request_id", "accepted", "clean_name", "clean_mail", "clean_subject", "clean_message")


_M11 = with_fixtures("site_change", "site", "site_url", "account", "locale") + """
, taken AS (SELECT DISTINCT su.url FROM site_url su JOIN site si ON si.id = su.site_id
             WHERE NOT su.is_deleted AND NOT si.is_deleted AND su.is_active),
loc AS (SELECT lower(code) AS lk, min(code) AS loc FROM locale WHERE NOT is_deleted GROUP BY lower(code)),
r AS (SELECT c.*, coalesce(c.site_id, 0) AS sid, lower(c.url) IN (SELECT url FROM taken) AS url_taken,
             a.locale_code AS acct_locale, l.loc, coalesce(s.account_id = c.account_id, false) AS owned,
             (SELECT coalesce(max(id), 0) FROM site) AS mx
        FROM site_change c LEFT JOIN account a ON a.id = c.account_id AND NOT a.is_deleted
        LEFT JOIN loc l ON l.lk = lower(c.locale)
        LEFT JOIN site s ON s.id = coalesce(c.site_id, 0) AND NOT s.is_deleted),
d0 AS (SELECT request_id,
             CASE WHEN acct_locale IS NULL AND account_id IS NOT NULL AND sid <= 0 THEN 'reject'
                  WHEN sid <= 0 AND url_taken THEN 'reject' WHEN sid <= 0 THEN 'insert'
                  WHEN owned THEN 'update' ELSE 'reject' END AS action,
             CAST(CASE WHEN sid <= 0 THEN mx + request_id ELSE sid END AS BIGINT) AS site_id,
             trim(left(name, 256)) AS name, trim(left(description, 512)) AS description,
             lower(trim(left(keywords, 1024))) AS keywords,
             CASE WHEN sid <= 0 THEN coalesce(loc, acct_locale) ELSE loc END AS locale_code,
             upper(coalesce(https, '')) = 'Y' AS https, lower(theme) AS theme, lower(url) AS url
        FROM r),
d AS (SELECT x.* REPLACE (CASE WHEN action = 'insert' AND EXISTS (SELECT 1 FROM d0 y WHERE y.url = x.url AND y.action <> 'reject'
                                                                  AND y.request_id < x.request_id)
                               THEN 'reject' ELSE action END AS action) FROM d0 x)
SELECT d.*, CASE WHEN d.action <> 'reject' THEN u.url_id END AS url_id,
       CASE WHEN d.action = 'reject' THEN NULL WHEN u.url_id IS NULL THEN 'insert_active' ELSE 'activate' END AS url_action
  FROM d LEFT JOIN (SELECT site_id, url, max(id) AS url_id FROM site_url WHERE NOT is_deleted GROUP BY site_id, url) u
    ON u.site_id = d.site_id AND u.url = d.url AND d.action <> 'reject'
"""


@register("m11_merge_sites", oracle=_M11)
def m11_merge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 (+J13, A4): decision, written fields and url action for every site request."""
    f = _f(spark, sf_dir)
    out, _ = M.merge_sites(f("site_change"), f("site"), f("site_url"), f("account"), f("locale"))
    return out


@register("m12_touch_tokens", oracle=with_fixtures("tokens", "token_seen") + f"""
SELECT t.id, t.guid, t.is_deleted,
       s.id IS NOT NULL AND NOT t.is_deleted AS touched,
       strftime(CASE WHEN s.id IS NOT NULL AND NOT t.is_deleted THEN TIMESTAMP '{AS_OF}' ELSE t.updated_at END,
                '%Y-%m-%d %H:%M:%S') AS updated_at
  FROM tokens t LEFT JOIN (SELECT DISTINCT id, guid FROM token_seen WHERE length(guid) >= 36) s
    ON s.id = t.id AND s.guid = t.guid
""")
def m12_touch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touch every token seen in `view` events (valid guid, live token)."""
    f = _f(spark, sf_dir)
    out = M.touch_tokens(f("tokens"), f("token_seen"), AS_OF)
    return out.select("id", "guid", "is_deleted", "touched",
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@register("m12_revoke_tokens", oracle=with_fixtures("tokens", "token_revoke") + """
SELECT t.id, t.is_deleted OR EXISTS (SELECT 1 FROM token_revoke k WHERE k.id = t.id AND k.guid = t.guid) AS is_deleted
  FROM tokens t
""")
def m12_revoke_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revoke every token named by an `error` event (matching id and guid)."""
    f = _f(spark, sf_dir)
    return M.revoke_tokens(f("tokens"), f("token_revoke")).select("id", "is_deleted")


@register("m12_issue_tokens", oracle=with_fixtures("login_request", "account") + """
SELECT l.login_id, l.account_id, left(md5(coalesce(a.email, '')), 4) || '-' || left(md5(coalesce(a.guid, '')), 8) AS guid_suffix
  FROM login_request l JOIN account a ON a.id = l.account_id AND NOT a.is_deleted AND a.type <> 'account.expired'
""")
def m12_issue_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue a token for every completed login of a live, non-expired account."""
    f = _f(spark, sf_dir)
    out = M.issue_tokens(f("login_request"), f("account"))
    return out.select("login_id", "account_id", F.substring("token_guid", 38, 13).alias("guid_suffix"))
