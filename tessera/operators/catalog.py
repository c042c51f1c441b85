"""Relational read jobs over the catalogue tables (places, accounts, notes,
sites): the reference's per-id lookups lifted to whole-table joins.

Join policy: no hints; the planner and adaptive execution broadcast a side
while its size is below Spark's threshold, and shuffle both beyond.  Per-key "first match" picks use ``min_by`` aggregates
(map-side partial aggregation, skew safe) rather than windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import live

ADMIN_TYPES = ["account.global", "account.admin"]


def epoch_round(c: Column) -> Column:
    """``ROUND(EXTRACT(EPOCH FROM ts))`` as bigint."""
    return F.round(F.unix_micros(c.cast("timestamp")) / 1_000_000).cast("bigint")


# --------------------------------------------------------------------- P1-P5
def country_list(country: DataFrame) -> DataFrame:
    """Available live countries, lower-case code, by sort order then name."""
    return (country.filter(~F.col("is_deleted") & F.col("is_available"))
            .select(F.lower("code").alias("code"), "name", "label", "sort_order")
            .orderBy("sort_order", "name"))


def build_country_dim(raw: DataFrame, available: list[str] | None = None) -> DataFrame:
    """Seed rules for the country dimension: label = 'lblCountry' + code;
    sort order JP 0, CA/US 10, others 25 and available, for the available
    set; the rest sort 999 and unavailable."""
    # Codes made available by the seed.
    avail = available or ["JP", "US", "CA", "MX", "CO"]
    code = F.upper(F.col("code"))
    is_av = code.isin(avail)
    return raw.select(
        code.alias("code"), F.col("name"),
        F.concat(F.lit("lblCountry"), code).alias("label"),
        F.when(is_av, F.when(code == "JP", 0).when(code.isin("CA", "US"), 10).otherwise(25))
         .otherwise(999).alias("sort_order"),
        is_av.alias("is_available"),
        F.lit(False).alias("is_deleted"),
    )


def entitlement(c: Column) -> Column:
    """Account type → pipe list of model tiers."""
    return (F.when(c.isin("account.global", "account.admin"), "basic|pro|expert|all")
            .when(c.isin("account.expert", "account.education"), "basic|pro|expert")
            .when(c.isin("account.standard", "account.pro"), "basic|pro")
            .otherwise("basic"))


def with_exists_flag(df: DataFrame, child: DataFrame, left_key: str, child_key: str, name: str) -> DataFrame:
    """``name`` = the row has at least one live child row.

    The child side is reduced to its distinct keys (partial aggregation
    first), then left-joined; no per-row correlated count.
    """
    keys = live(child).select(F.col(child_key).alias("_ek")).distinct().withColumn(name, F.lit(True))
    out = df.join(keys, F.col(left_key) == F.col("_ek"), "left").drop("_ek")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def account_profile(acct: DataFrame, meta: DataFrame) -> DataFrame:
    """Live account profiles with admin flag, display-name fallback,
    has_meta (any live meta row) and, when present, epoch versions."""
    a = live(acct)
    cols = [F.col("id").alias("account_id"), F.col("type").alias("account_type"),
            F.col("login").alias("nickname"),
            F.coalesce("display_name", "first_name").alias("display_name"),
            "last_name", "first_name", "email", "locale_code",
            F.col("type").isin(ADMIN_TYPES).alias("is_admin")]
    for c in ("updated_at", "created_at"):
        if c in acct.columns:
            cols.append(epoch_round(F.col(c)).alias(c.replace("_at", "_unix")))
    out = a.select(*cols)
    return with_exists_flag(out, meta, "account_id", "account_id", "has_meta")


def visible_to(notes: DataFrame, viewers: DataFrame, acct: DataFrame) -> DataFrame:
    """(viewer, note) pairs the viewer may read: public notes, or private
    ones for a live viewer who last edited them or is admin/global.

    ``viewers`` holds (viewer_id, note_id) requests; joined to the note by
    key, never a cross product.
    """
    a = live(acct).select(F.col("id").alias("viewer_id"), F.col("type").alias("viewer_type"))
    n = live(notes).select(F.col("id").alias("note_id"), "is_private", "updated_by")
    j = viewers.join(n, "note_id").join(a, "viewer_id", "left")
    own = F.col("viewer_type").isNotNull() & F.coalesce(F.col("updated_by") == F.col("viewer_id"), F.lit(False))
    ok = (~F.col("is_private")) | own | F.coalesce(F.col("viewer_type").isin(ADMIN_TYPES), F.lit(False))
    return j.withColumn("can_read", ok)


def mask_account(df: DataFrame, viewer_col: str = "viewer_id") -> DataFrame:
    """P5: e-mail shown only to the account itself."""
    return df.withColumn("email", F.when(F.col("account_id") == F.col(viewer_col), F.col("email")))


def mask_file(df: DataFrame, viewer_type_col: str = "viewer_type") -> DataFrame:
    """P5: owner and meta dropped for guests (``viewer_type`` NULL or 'account.guest')."""
    guest = F.coalesce(F.col(viewer_type_col), F.lit("account.guest")) == "account.guest"
    out = df
    for c in ("account_id", "owner_name", "meta"):
        if c in df.columns:
            out = out.withColumn(c, F.when(~guest, F.col(c)))
    return out


# --------------------------------------------------------------------- J1-J14
def location_detail(loc: DataFrame, acct: DataFrame, country: DataFrame, state: DataFrame,
                    region: DataFrame, note: DataFrame, meta: DataFrame,
                    country_code: str | None = "JP") -> DataFrame:
    """Playable locations with account, country, state, region and note.

    Inner joins to the creating account and the country; left joins to
    state, region and note with the live test *inside* the join (the right
    side is filtered before the outer join, so a deleted state yields NULL
    columns rather than dropping the place).  ``country_code=None`` keeps
    every country.
    """
    lo = loc.filter(~F.col("is_deleted") & F.col("is_published") & F.col("is_visible"))
    co = country.filter(~F.col("is_deleted"))
    if country_code is not None:
        lo = lo.filter(F.col("country_code") == country_code)
        co = co.filter(F.col("code") == country_code)
    co = co.select(F.col("code").alias("country_code"), F.col("name").alias("country_name"), F.col("label").alias("country_label"))
    cs = live(state).select(F.col("id").alias("state_id"), F.col("name").alias("state_name"),
                            F.col("label").alias("state_label"), "region_id")
    cr = live(region).select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    nn = live(note).select(F.col("id").alias("note_id"), F.col("type").alias("note_type"),
                           F.col("is_private").alias("note_private"))
    ac = live(acct).select(F.col("id").alias("created_by"), F.col("display_name").alias("account_name"),
                           "first_name")
    out = (lo.select(F.col("id").alias("location_id"), "src", "name",
                     F.col("longitude").cast("double").alias("longitude"),
                     F.col("latitude").cast("double").alias("latitude"),
                     "country_code", "state_id", "note_id", "created_by", "is_published", "is_visible")
           .join(ac, "created_by")
           .join(co, "country_code")
           .join(cs, "state_id", "left")
           .join(cr, "region_id", "left")
           .join(nn, "note_id", "left"))
    return with_exists_flag(out, meta, "location_id", "location_id", "has_meta")


def meta_rows(parent: DataFrame, meta: DataFrame, fk: str) -> DataFrame:
    """Live key/value rows of live parents, ordered by parent then key."""
    p = live(parent).select(F.col("id").alias(fk))
    return (live(meta).join(p, fk, "left_semi").select(fk, "key", "value").orderBy(fk, "key"))


def resolve_host(requests: DataFrame, site: DataFrame, siteurl: DataFrame, sitemeta: DataFrame,
                 locale: DataFrame, host_col: str = "host") -> DataFrame:
    """Request host → site.

    A host resolves to the site that owns it as any live url (alias),
    returning that site's active live url (priority 10); a host owned by no
    live site falls back to the default site's active url (priority 20).
    ``do_redirect`` is true when the returned url differs from the host.

    Lifted plan: distinct hosts only; each site is first reduced to one
    active url (lowest id) so the alias join is linear (no alias × active
    pairs); ties between sites are broken by ``min_by`` (site_id, url id)
    with partial aggregation; the single default row comes from a
    TakeOrdered and is attached by a one-row broadcast.
    """
    si = live(site)
    su = live(siteurl)
    active = (su.filter(F.col("is_active"))
              .groupBy("site_id").agg(F.min_by(F.struct(F.col("id").alias("url_id"), F.col("url").alias("site_url")),
                                               F.col("id")).alias("a"))
              .select("site_id", "a.url_id", "a.site_url"))
    banner = (live(sitemeta).filter(F.col("key") == "banner.src")
              .groupBy("site_id").agg(F.min("value").alias("banner_src")))
    loc = locale.select(F.col("code").alias("locale_code"), "language_code")
    site_cols = si.select(F.col("id").alias("site_id"), "https", F.col("guid").alias("site_guid"),
                          F.col("name").alias("site_name"), "locale_code", "theme", "is_default")
    best = active.join(site_cols, "site_id")
    hosts = requests.select(F.lower(F.trim(F.col(host_col))).alias("host")).distinct()
    alias = su.select(F.col("url").alias("host"), "site_id")
    a = (hosts.join(alias, "host").join(best, "site_id")
         .groupBy("host").agg(F.min_by(F.struct("site_id", "url_id", "site_url", "https", "site_guid", "site_name",
                                                "locale_code", "theme", "is_default"),
                                       F.struct("site_id", "url_id")).alias("m"))
         .select("host", "m.*", F.lit(10).alias("sort_order")))
    default = (best.filter(F.col("is_default")).orderBy("site_id", "url_id").limit(1)
               .withColumn("sort_order", F.lit(20)))
    unresolved = hosts.join(a.select("host"), "host", "left_anti")
    # the default row as a scalar subquery (at most one row; none → no rows)
    d = default.select(F.struct(*default.columns).alias("_d")).scalar()
    b = (unresolved.withColumn("_d", d).filter(F.col("_d").isNotNull())
         .select("host", *[F.col(f"_d.{c}").alias(c) for c in default.columns]))
    res = a.unionByName(b)
    res = res.join(banner, "site_id", "left").join(loc, "locale_code", "left")
    return res.withColumn("do_redirect", F.col("site_url") != F.col("host"))


def site_by_domain(siteurl: DataFrame, site: DataFrame) -> DataFrame:
    """For each live url text, the site of its most recently updated live
    row (ties: higher site id)."""
    s = live(site).select(F.col("id").alias("site_id"))
    su = live(siteurl).join(s, "site_id", "left_semi")
    return su.groupBy(F.col("url").alias("domain")).agg(
        F.max_by("site_id", F.struct("updated_at", "site_id")).alias("site_id"))


def with_meta_value(df: DataFrame, meta: DataFrame, key: str, fk: str, out: str,
                    left_key: str | None = None) -> DataFrame:
    """One live meta value per parent (lowest value wins) as a column."""
    m = (live(meta).filter(F.col("key") == key).groupBy(F.col(fk).alias("_mk"))
         .agg(F.min("value").alias(out)))
    return df.join(m, F.col(left_key or fk) == F.col("_mk"), "left").drop("_mk")


def note_detail(note: DataFrame, acct: DataFrame, meta: DataFrame, hist: DataFrame) -> DataFrame:
    """Live notes edited by a live account, with has_meta and has_history."""
    a = live(acct).select(F.col("id").alias("updated_by"))
    n = live(note).join(a, "updated_by", "left_semi").select(
        F.col("id").alias("note_id"), F.col("type").alias("note_type"), F.col("content").alias("note_text"),
        "is_private", "updated_by")
    n = with_exists_flag(n, meta, "note_id", "note_id", "has_meta")
    return with_exists_flag(n, hist, "note_id", "note_id", "has_history")


def session_profile(acct: DataFrame, tokens: DataFrame, acctmeta: DataFrame,
                    lifespan_days: int, as_of: str) -> DataFrame:
    """Live sessions (token touched within ``lifespan_days`` of ``as_of``)
    of live accounts, with pivoted preferences, avatar default, entitlement
    tiers and the can-email flag."""
    t = live(tokens).filter(F.col("updated_at") >= F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(lifespan_days)))
    a = live(acct)
    prefs = pivot_meta(acctmeta, "account_id", {
        "profile.avatar": "avatar", "preference.fontfamily": "pref_fontfamily",
        "preference.fontsize": "pref_fontsize", "preference.theme": "pref_colour",
        "preference.can_email": "pref_canemail", "permission.can_admin": "can_admin"})
    j = (a.select(F.col("id").alias("account_id"), "email", "type", "display_name", "last_name", "first_name",
                  "locale_code")
         .join(t.select(F.col("id").alias("token_id"), F.col("guid").alias("token_guid"), "account_id",
                        F.col("created_at").alias("login_at")), "account_id")
         .join(prefs, "account_id", "left"))
    return j.select(
        "account_id", "token_id", "token_guid", "email", "type", "display_name", "last_name", "first_name",
        "locale_code", F.coalesce("avatar", F.lit("default.png")).alias("avatar"),
        entitlement(F.col("type")).alias("models"),
        "pref_fontfamily", "pref_fontsize", "pref_colour",
        F.coalesce(F.upper("pref_canemail").isin("Y", "T", "1"), F.lit(False)).alias("pref_canemail"),
        "login_at")


def pivot_meta(meta: DataFrame, fk: str, keys: dict[str, str]) -> DataFrame:
    """A3: EAV rows → one row per parent with one column per wanted key
    (``MAX(CASE key ...)``), over live meta rows.  One pass with
    conditional ``max`` — no pivot value discovery job."""
    m = live(meta).filter(F.col("key").isin(list(keys)))
    return m.groupBy(fk).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(v) for k, v in keys.items()])


def note_can_edit(pairs: DataFrame, acct: DataFrame, note: DataFrame, hist: DataFrame) -> DataFrame:
    """May account A edit note N?  Live accounts only: admin/global ones,
    the note's last editor, or a past editor (in history) of a public note.
    A deleted or unknown account may edit nothing.

    ``pairs``: (account_id, note_id).  Each rule is an equi-join; the result
    is OR-ed per pair (``bool_or``), never an account × note product.
    """
    a = live(acct).select(F.col("id").alias("account_id"), F.col("type").isin(ADMIN_TYPES).alias("is_admin"))
    n = live(note).select(F.col("id").alias("note_id"), F.col("updated_by").alias("last_editor"),
                          F.col("is_private").alias("note_private"))
    past = (live(hist).select("note_id", F.col("updated_by").alias("account_id")).distinct()
            .withColumn("past_editor", F.lit(True)))
    j = (pairs.select("account_id", "note_id").distinct()
         .join(a, "account_id", "left").join(n, "note_id", "left")
         .join(past, ["note_id", "account_id"], "left"))
    ok = (F.coalesce(F.col("is_admin"), F.lit(False))
          | F.coalesce(F.col("last_editor") == F.col("account_id"), F.lit(False))
          | (F.coalesce(F.col("past_editor"), F.lit(False)) & F.coalesce(~F.col("note_private"), F.lit(False))))
    return j.select("account_id", "note_id", (F.col("is_admin").isNotNull() & ok).alias("can_edit"))


def file_can_edit(pairs: DataFrame, acct: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """May account A edit file F?  Live accounts only: admin/global ones,
    the owner of a live file that expires at ``as_of`` or later (or never), or
    anyone registering a new file (no file named: NULL, 0 or less).  A deleted
    or unknown file is nobody's to edit but an admin's."""
    a = live(acct).select(F.col("id").alias("account_id"), F.col("type").isin(ADMIN_TYPES).alias("is_admin"))
    f = live(files).select(F.col("id").alias("file_id"), F.col("account_id").alias("owner_id"), "expires_at")
    j = pairs.select("account_id", "file_id").distinct().join(a, "account_id", "left").join(f, "file_id", "left")
    owner_ok = (F.col("owner_id") == F.col("account_id")) & (
        F.col("expires_at").isNull() | (F.col("expires_at") >= F.to_timestamp(F.lit(as_of))))
    new = F.coalesce(F.col("file_id"), F.lit(0)) <= 0
    ok = F.col("is_admin").isNotNull() & (F.coalesce(F.col("is_admin"), F.lit(False)) | F.coalesce(owner_ok, F.lit(False)) | new)
    return j.select("account_id", "file_id", ok.alias("can_edit"))


def best_locale(df: DataFrame, locale: DataFrame, in_col: str, out: str = "locale_code") -> DataFrame:
    """Best live locale for a requested code: exact code, then same
    language (first two letters), then available, then default; lowest code
    breaks ties.

    The request side is reduced to distinct requested codes; for each, the
    exact and same-language candidates are equi-joins, and the global
    fallback is a single TakeOrdered row.  No requests × locales product.
    """
    loc = live(locale).select("code", "language_code", "is_available", "is_default")
    wanted = df.select(F.col(in_col).alias("_want")).distinct()
    rank_tail = F.struct((~F.col("is_available")).alias("a"), (~F.col("is_default")).alias("d"), F.col("code"))
    exact = wanted.join(loc, F.col("_want") == F.col("code")).select("_want", F.struct(
        F.lit(0).alias("x"), F.lit(0).alias("l"), rank_tail.alias("t")).alias("r"), "code")
    lang = wanted.join(loc, F.left(F.col("_want"), F.lit(2)) == F.col("language_code")).select("_want", F.struct(
        F.when(F.col("_want") == F.col("code"), 0).otherwise(1).alias("x"), F.lit(0).alias("l"),
        rank_tail.alias("t")).alias("r"), "code")
    fallback_row = loc.orderBy((~F.col("is_available")), (~F.col("is_default")), "code").limit(1).select(
        F.col("code").alias("_fb"))
    picks = exact.unionByName(lang).groupBy("_want").agg(F.min_by("code", "r").alias("_pick"))
    res = (wanted.join(picks, "_want", "left")
           .select("_want", F.coalesce("_pick", fallback_row.scalar()).alias(out)))
    return df.join(res, F.col(in_col).eqNullSafe(F.col("_want")), "left").drop("_want")


def match_account(requests: DataFrame, acct: DataFrame) -> DataFrame:
    """Existing live account by login (lower-cased) or by e-mail when the
    requested e-mail is longer than 5 characters; lowest id wins.

    The OR predicate is split into two equi-joins, unioned, then reduced
    per request with ``min`` (never a nested-loop join).
    """
    a = live(acct).select("id", "login", "email")
    r = requests.select("request_id", F.lower(F.col("login")).alias("_lg"), F.lower(F.col("email")).alias("_em"))
    by_login = r.join(a, F.col("_lg") == F.col("login")).select("request_id", "id")
    by_mail = (r.filter(F.length("_em") > 5).join(a, F.col("_em") == F.col("email")).select("request_id", "id"))
    best = by_login.unionByName(by_mail).groupBy("request_id").agg(F.min("id").alias("account_id"))
    return requests.join(best, "request_id", "left")


def _usable(acct: DataFrame) -> DataFrame:
    return live(acct).filter(F.col("type") != "account.expired")


def match_email(requests: DataFrame, acct: DataFrame) -> DataFrame:
    """J12, forgotten password: the live, unexpired account (lowest id) whose
    e-mail is exactly the ``lookup`` of at least 3 characters.  Adds
    ``account_id`` (NULL: none)."""
    a = _usable(acct).filter(F.col("email").isNotNull()).groupBy(F.col("email").alias("_em")).agg(F.min("id").alias("account_id"))
    key = F.when(F.length("lookup") >= 3, F.col("lookup"))
    return requests.withColumn("_lk", key).join(a, F.col("_lk") == F.col("_em"), "left").drop("_lk", "_em")


def match_login(requests: DataFrame, acct: DataFrame, salt: str) -> DataFrame:
    """J12, log-in: the live, unexpired account (lowest id) with the ``lookup``
    (at least 3 characters, lower-cased) as e-mail and the salted SHA-512 of
    the ``password`` (at least 8) as password.  Adds ``account_id``."""
    a = _usable(acct).groupBy(F.col("email").alias("_em"), F.col("password").alias("_pw")).agg(F.min("id").alias("account_id"))
    r = requests.withColumn("_lk", F.when(F.length("lookup") >= 3, F.lower("lookup"))) \
        .withColumn("_h", F.when(F.length("password") >= 8, F.sha2(F.concat(F.lit(salt), F.col("password")), 512)))
    return r.join(a, (F.col("_lk") == F.col("_em")) & (F.col("_h") == F.col("_pw")), "left").drop("_lk", "_h", "_em", "_pw")


def url_conflicts(requests: DataFrame, site: DataFrame, siteurl: DataFrame) -> DataFrame:
    """Request rows whose url is already the live, active url of a live
    site (``url_taken``).  Left join to the distinct taken urls."""
    s = live(site).select(F.col("id").alias("site_id"))
    taken = live(siteurl).filter(F.col("is_active")).join(s, "site_id", "left_semi").select(F.col("url").alias("_u")).distinct() \
        .withColumn("url_taken", F.lit(True))
    out = requests.join(taken, F.lower(F.col("url")) == F.col("_u"), "left").drop("_u")
    return out.withColumn("url_taken", F.coalesce("url_taken", F.lit(False)))


def localise(df: DataFrame, labels: DataFrame, label_col: str, name_col: str, out: str = "display") -> DataFrame:
    """Localised label when one exists and is not blank, else the name.
    ``labels``: (label, value) for one language."""
    lab = labels.select(F.col("label").alias("_lk"), F.col("value").alias("_lv"))
    lab = lab.groupBy("_lk").agg(F.max("_lv").alias("_lv"))
    j = df.join(lab, F.col(label_col) == F.col("_lk"), "left")
    return j.withColumn(out, F.coalesce(F.nullif(F.trim("_lv"), F.lit("")), F.col(name_col))).drop("_lk", "_lv")


def site_url_summary(site: DataFrame, siteurl: DataFrame, requests: DataFrame) -> DataFrame:
    """A4: for each (site_id, url) request against a live site: the id of the
    site's live url equal to the lower-cased request url (highest id) and the
    number of the site's live urls (0 when none).

    Two aggregates keyed by site (and by (site, url)) joined back by key —
    linear in urls plus requests, no per-request scan.
    """
    su = live(siteurl)
    counts = su.groupBy("site_id").agg(F.count("url").alias("url_count"))
    match = su.groupBy("site_id", F.col("url").alias("_u")).agg(F.max("id").alias("url_id"))
    r = requests.join(live(site).select(F.col("id").alias("site_id")), "site_id", "left_semi")
    r = (r.withColumn("_u", F.lower("url")).join(match, ["site_id", "_u"], "left")
         .join(counts, "site_id", "left"))
    return r.select("request_id", "site_id", "url_id", F.coalesce("url_count", F.lit(0)).alias("url_count"))
