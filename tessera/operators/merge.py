"""Write rules as batch merges: ``merge_x(current, changes, ...) -> new``.

No table format with MERGE is assumed; each job is a union / aggregate /
join over whole tables whose result is written to a new path.

"Last change wins" is computed with ``max_by`` over an ordering struct —
an aggregate with map-side partial aggregation, so a key with millions of
changes never lands whole in one task.  New ids are derived from request
ids plus the current maximum (one scalar row), never from a global window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.catalog import ADMIN_TYPES, best_locale, match_account
from tessera.operators.sequence import next_in_sequence
from tessera.sources.tables import live


def _ts(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def _one_row_join(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (e.g. the current maximum id)
    to every row as a scalar subquery (computed once, no join)."""
    s = one.select(F.struct(*one.columns).alias("_s")).scalar()
    return df.withColumn("_s", s).select("*", *[F.col(f"_s.{c}").alias(c) for c in one.columns]).drop("_s")


# ----------------------------------------------------------------------- M1
def merge_meta(cur: DataFrame, chg: DataFrame, parent: DataFrame, fk: str, as_of: str) -> DataFrame:
    """M1: key/value upsert on (parent, key).

    Change rows (fk, key, value, seq) are kept when the key (lower-cased,
    trimmed) contains a '.' and the parent is live.  Per key the last change
    (highest seq) wins; its trimmed value is stored, and a blank value marks
    the row deleted while a non-blank one revives it.  Untouched rows are
    kept as they are; ``created_at`` is kept, ``updated_at`` = as_of for
    touched rows.
    """
    c = chg.select(F.col(fk), F.lower(F.trim("key")).alias("key"),
                   F.trim(F.coalesce(F.col("value"), F.lit(""))).alias("value"), "seq")
    c = c.filter(F.contains(F.col("key"), F.lit(".")))
    c = c.join(live(parent).select(F.col("id").alias(fk)), fk, "left_semi")
    last = c.groupBy(fk, "key").agg(F.max_by("value", "seq").alias("_new"))
    j = cur.join(last, [fk, "key"], "full_outer")
    touched = F.col("_new").isNotNull()
    out = j.select(
        fk, "key",
        F.when(touched, F.col("_new")).otherwise(F.col("value")).alias("value"),
        F.when(touched, F.length("_new") == 0).otherwise(F.col("is_deleted")).alias("is_deleted"),
        touched.alias("touched"),
        *([F.coalesce(F.col("created_at"), _ts(as_of)).alias("created_at")] if "created_at" in cur.columns else []),
        *([F.when(touched, _ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at")]
          if "updated_at" in cur.columns else [F.when(touched, _ts(as_of)).alias("updated_at")]),
    )
    return out


# ----------------------------------------------------------------------- M2
def note_hash(type_col: Column, content: Column, private: Column) -> Column:
    """sha512 hex of type ‖ content (backslashes doubled) ‖ 'Y'/'N'."""
    return F.sha2(F.concat(F.coalesce(type_col, F.lit("")),
                           F.replace(F.coalesce(content, F.lit("")), F.lit("\\"), F.lit("\\\\")),
                           F.when(private, F.lit("Y")).otherwise(F.lit("N"))), 512)


def merge_notes(cur: DataFrame, chg: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """M2: note versioning.  Returns (notes, history).

    ``cur``: note_id, version, type, content, is_private (+ guid when
    present); ``chg``: the same columns, several versions per note allowed.
    Every state is hashed; a state whose successor has a different hash is
    appended to history (so history has one row per real change, for every
    step, not only the last); the final state is the note.  The guid of the
    current row is kept; history rows are new and never rewritten.

    Plan: the successor of each state comes from ``next_in_sequence``
    (range partitioning on (note, version), so a note with a huge number of
    versions is split over several tasks); the guid is a per-note aggregate.
    """
    base_cols = ["note_id", "version", "type", "content", "is_private"]
    c = cur.select(*base_cols, *(["guid"] if "guid" in cur.columns else []))
    if "guid" not in c.columns:
        c = c.withColumn("guid", F.lit(None).cast("string"))
    states = c.unionByName(chg.select(*base_cols).withColumn("guid", F.lit(None).cast("string")))
    states = states.withColumn("hash", note_hash(F.col("type"), F.col("content"), F.col("is_private")))
    states = next_in_sequence(states, "note_id", "version", ["hash"], prefix="_next_")
    history = states.filter(F.col("_next_hash").isNotNull() & (F.col("hash") != F.col("_next_hash"))) \
        .select(*base_cols, "hash", _ts(as_of).alias("recorded_at"))
    # the guid stays the one of the existing row: an aggregate per note (not a
    # whole-note window), joined back to the final states
    guids = c.filter(F.col("guid").isNotNull()).groupBy("note_id").agg(F.min("guid").alias("_guid0"))
    notes = states.filter(F.col("_next_hash").isNull()).join(guids, "note_id", "left").select(
        *base_cols, "hash", F.coalesce("_guid0", F.expr("uuid()")).alias("guid"))
    return notes, history


# ----------------------------------------------------------------------- M3
# Note types a write may request.
NOTE_TYPES = ["note.normal", "note.secret", "note.private", "note.locked"]


def _permitted(upd: DataFrame, acct: DataFrame, cur: DataFrame, hist: DataFrame) -> DataFrame:
    """The (note_id, request_id) of the updates that their account may make
    (J9), each judged on the note as the earlier ones of the batch left it.

    Admin and global accounts may always; the note's last editor and, of a
    public note, its past ones may while the note is not deleted.  Only these
    accounts' requests can change a note, so all others leave before the ordered
    pass, and of the past editors a batch can add, the one that matters is the
    editor before the batch (the others are admins or were past ones already).
    The pass therefore reads the requests of a note in order with a state of a
    few values; no note's requests are held together."""
    a = live(acct).select(F.col("id").alias("account_id"), F.col("type").isin(ADMIN_TYPES).alias("admin"))
    past = live(hist).select("note_id", F.col("updated_by").alias("account_id"), F.lit(True).alias("past")).distinct()
    n = cur.select(F.col("id").alias("note_id"), F.col("updated_by").alias("editor0"), F.col("is_private").alias("private0"),
                   F.col("is_deleted").alias("deleted0"), F.xxhash64("type").alias("type0"),
                   F.xxhash64(F.coalesce("content", F.lit(""))).alias("content0"))
    rows = upd.join(a, "account_id").join(n, "note_id").join(past, ["note_id", "account_id"], "left").select(
        "note_id", "request_id", "account_id", "admin", F.coalesce("past", F.lit(False)).alias("past"),
        "is_private", (F.length("content") == 0).alias("blank"), F.xxhash64("type").alias("type"), F.xxhash64("content").alias("content"),
        F.coalesce("editor0", F.lit(-1)).alias("editor0"), F.coalesce("private0", F.lit(True)).alias("private0"), "deleted0", "type0", "content0")
    rows = rows.where(F.col("admin") | F.col("past") | (F.col("account_id") == F.col("editor0")))

    def judge(batches):
        note = object()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.note_id != note:
                    note, editor, private, deleted = r.note_id, r.editor0, r.private0, r.deleted0
                    text, moved = (r.type0, r.content0, private), False
                past = r.past or moved and r.account_id == r.editor0
                if r.admin or not deleted and (r.account_id == editor or past and not private):
                    out.append((r.note_id, r.request_id))
                    now = (r.type, text[1] if r.blank else r.content, r.is_private)
                    if now != text and editor == r.editor0 and not deleted:
                        moved = True  # its state is in the history from here on
                    text, editor, private, deleted = now, r.account_id, r.is_private, r.blank
            yield pd.DataFrame(out, columns=["note_id", "request_id"])

    ordered = rows.repartition("note_id").sortWithinPartitions("note_id", "request_id")
    return ordered.mapInPandas(judge, upd.select("note_id", "request_id").schema)


def apply_note_changes(cur: DataFrame, chg: DataFrame, acct: DataFrame, hist: DataFrame) -> DataFrame:
    """M3: apply note write requests.

    ``chg``: request_id, account_id, note_id (≤ 0 / NULL = new note),
    content, type, private ('Y'/'1'/'TRUE' = private).  Type: the requested
    one when it is a known note type, else 'note.normal'.  Existing notes are
    updated only by permitted accounts (J9), and requests act in the order of
    their ids: each is judged on the note as the ones before left it.  The last
    permitted request wins for type, privacy, editor and deletion, blank content
    keeps the previous content and marks the note deleted.  New notes need a live
    account and non-blank content; their id is the current maximum id plus the
    request id.

    Returns the touched notes: id, type, content, is_private, is_deleted,
    updated_by, action ('update' / 'insert').
    """
    t = F.lower(F.trim(F.coalesce(F.col("type"), F.lit(""))))
    r = chg.select("request_id", "account_id", F.coalesce(F.col("note_id"), F.lit(0)).alias("note_id"),
                   F.trim(F.coalesce(F.col("content"), F.lit(""))).alias("content"),
                   F.when(t.isin(NOTE_TYPES), t).otherwise(F.lit("note.normal")).alias("type"),
                   F.upper(F.trim(F.coalesce(F.col("private"), F.lit("")))).isin("Y", "1", "TRUE").alias("is_private"))
    upd = r.filter(F.col("note_id") > 0)
    ok = upd.join(_permitted(upd, acct, cur, hist), ["note_id", "request_id"], "left_semi")
    order = F.struct("request_id")
    agg = ok.groupBy("note_id").agg(
        F.max_by(F.struct("type", "is_private", (F.length("content") == 0).alias("is_deleted"),
                          F.col("account_id").alias("updated_by")), order).alias("last"),
        F.max_by("content", F.when(F.length("content") > 0, F.col("request_id"))).alias("last_content"),
    )
    existing = cur.select(F.col("id").alias("note_id"), F.col("content").alias("old_content"))
    updated = agg.join(existing, "note_id").select(
        F.col("note_id").alias("id"), "last.type",
        F.coalesce("last_content", "old_content").alias("content"),
        "last.is_private", "last.is_deleted", "last.updated_by", F.lit("update").alias("action"))
    ins = r.filter((F.col("note_id") <= 0) & (F.length("content") > 0)) \
        .join(live(acct).select(F.col("id").alias("account_id")), "account_id", "left_semi")
    max_id = cur.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    inserted = _one_row_join(ins, max_id).select(
        (F.col("_max") + F.col("request_id")).cast("long").alias("id"), "type", "content", "is_private",
        F.lit(False).alias("is_deleted"), F.col("account_id").alias("updated_by"), F.lit("insert").alias("action"))
    return updated.withColumn("id", F.col("id").cast("long")).unionByName(inserted)


# ----------------------------------------------------------------------- M4
def enforce_active_url(siteurl: DataFrame, chg: DataFrame, as_of: str) -> DataFrame:
    """M4: upsert url rows by id (the last change of an id, by ``seq``, holds),
    then keep one active url per site: the
    newest (updated_at, then id) live active row stays active, the others of
    that site are switched off.  Rows of changed sites get ``site_touched``.

    The winner per site is a ``max_by`` aggregate (skew safe); it is joined
    back on site_id (one row per site).
    """
    cols = ["id", "site_id", "url", "is_active", "is_deleted", "updated_at"]
    c = chg.select("id", "site_id", F.lower(F.trim("url")).alias("url"), "is_active",
                   F.coalesce(F.col("is_deleted"), F.lit(False)).alias("is_deleted") if "is_deleted" in chg.columns
                   else F.lit(False).alias("is_deleted"),
                   _ts(as_of).alias("updated_at"), "seq")
    last = c.groupBy("id").agg(F.max_by(F.struct(*[x for x in cols if x != "id"]), "seq").alias("s")) \
        .select("id", "s.*")
    merged = siteurl.select(*cols).join(last.select("id"), "id", "left_anti").unionByName(last)
    winners = (merged.filter(F.col("is_active") & ~F.col("is_deleted"))
               .groupBy("site_id").agg(F.max_by("id", F.struct("updated_at", "id")).alias("_win")))
    touched = c.select("site_id").distinct().withColumn("site_touched", F.lit(True))
    out = merged.join(winners, "site_id", "left").join(touched, "site_id", "left")
    return out.select("id", "site_id", "url",
                      (F.col("is_active") & (F.col("id") == F.col("_win"))).alias("is_active"),
                      "is_deleted", "updated_at",
                      F.coalesce("site_touched", F.lit(False)).alias("site_touched"))


# ----------------------------------------------------------------------- M5
def soft_delete(cur: DataFrame, keys: DataFrame, key: str = "id",
                extra: dict[str, Column] | None = None) -> DataFrame:
    """M5: rows named in ``keys`` get is_deleted = true plus the table's
    extra assignments (e.g. is_available = false, type = 'account.expired').
    Left join on the distinct key set; other rows are unchanged."""
    k = keys.select(F.col(key).alias("_dk")).distinct().withColumn("_hit", F.lit(True))
    j = cur.join(k, F.col(key) == F.col("_dk"), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    j = j.withColumn("is_deleted", hit | F.col("is_deleted"))
    for col, value in (extra or {}).items():
        j = j.withColumn(col, F.when(hit, value).otherwise(F.col(col)))
    return j.drop("_dk", "_hit")


# ----------------------------------------------------------------------- M6
def stamp_rows(df: DataFrame, as_of: str) -> DataFrame:
    """M6: row stamps on write: a guid when missing, start_at defaults to
    as_of, a row whose until_at has passed is made inactive (on insert and
    update alike), updated_at = as_of."""
    now = _ts(as_of)
    cols = set(df.columns)
    out = df
    out = out.withColumn("guid", F.coalesce(F.col("guid"), F.expr("uuid()")) if "guid" in cols else F.expr("uuid()"))
    if "start_at" in cols:
        out = out.withColumn("start_at", F.coalesce(F.col("start_at"), now))
    if "until_at" in cols and "is_active" in cols:
        out = out.withColumn("is_active", F.when(now > F.coalesce(F.col("until_at"), now), F.lit(False))
                             .otherwise(F.col("is_active")))
    return out.withColumn("updated_at", now)


# ----------------------------------------------------------------------- M7
# Meta rows every new account starts with.
ACCOUNT_DEFAULT_META = [
    ("profile.avatar", "default.png"),
    ("profile.bio", ""),
    ("profile.location", ""),
    ("preference.can_email", "N"),
    ("preference.fontfamily", "auto"),
    ("preference.fontsize", "md"),
    ("preference.theme", "default"),
]


#: Pairs of names of one component that a task judges one after another.
COMPONENT_PAIRS = 2_000_000


def _first_claims(new: DataFrame, component_pairs: int = COMPONENT_PAIRS) -> DataFrame:
    """The requests (request_id, login, _mail) that insert an account when all
    act in the order of their ids, and one is refused if an account inserted
    before has its login or its e-mail (NULL: none).

    Of the requests with one pair of names only the first can insert.  Pairs
    that share no name with another insert at once; the others depend on each
    other only inside a component of pairs linked by shared names, and each
    component is judged in order by one pass that keeps the names taken.  The
    number of jobs grows with the logarithm of the longest chain of requests.
    A component of more than ``component_pairs`` pairs, whose names a task
    should not hold, is judged in rounds instead (``_claims_in_rounds``)."""
    from tessera.operators.graph import components
    from tessera.operators.sequence import _materialise

    pairs = _materialise(new.groupBy("login", "_mail").agg(F.min("request_id").alias("request_id")))
    logins = pairs.groupBy("login").agg(F.count("*").alias("_nl"))
    mails = pairs.filter(F.col("_mail").isNotNull()).groupBy("_mail").agg(F.count("*").alias("_nm"))
    shared = _materialise(pairs.join(logins, "login").join(mails, "_mail", "left").withColumn(
        "_alone", (F.col("_nl") == 1) & (F.coalesce("_nm", F.lit(1)) == 1)).select("request_id", "login", "_mail", "_alone"))
    alone, crowd = shared.filter("_alone").drop("_alone"), shared.filter("NOT _alone").drop("_alone")
    if crowd.isEmpty():
        return alone
    # names by hash: two that fall together join two components, which are then judged together
    name = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    crowd = crowd.withColumn("_node", name("login", "login"))
    roots = components(crowd.filter(F.col("_mail").isNotNull()).select(F.col("_node").alias("a"), name("mail", "_mail").alias("b")))
    crowd = _materialise(crowd.join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left")
                         .select("request_id", "login", "_mail", F.coalesce("root", "_node").alias("_root")))
    huge = crowd.groupBy("_root").agg(F.count("*").alias("n")).filter(F.col("n") > component_pairs).select("_root")

    def judge(batches):
        root, taken = None, set()
        for pdf in batches:
            keep = []
            for k, (r, login, mail) in enumerate(zip(pdf["_root"], pdf["login"], pdf["_mail"], strict=True)):
                if r != root:
                    root, taken = r, set()
                names = [(0, login)] + ([(1, mail)] if mail is not None else [])
                if taken.isdisjoint(names):
                    taken.update(names)
                    keep.append(k)
            yield pdf.iloc[keep][["request_id", "login", "_mail"]]

    small = crowd.join(huge, "_root", "left_anti").repartition("_root").sortWithinPartitions("_root", "request_id")
    out = alone.unionByName(small.mapInPandas(judge, alone.schema))
    rest = crowd.join(huge, "_root", "left_semi").drop("_root")
    return out if rest.isEmpty() else out.unionByName(_claims_in_rounds(rest))


def _claims_in_rounds(new: DataFrame) -> DataFrame:
    """``_first_claims`` in rounds: the requests that are the first left of
    their login and of their e-mail insert; they and all that share a name with
    them leave.  The smallest id left always inserts, so the rounds end; there
    are as many as the longest chain of requests that each free the next."""
    from tessera.operators.sequence import _materialise

    out, left = None, _materialise(new)
    while not left.isEmpty():
        by_login = left.groupBy("login").agg(F.min("request_id").alias("_l"))
        by_mail = left.filter(F.col("_mail").isNotNull()).groupBy("_mail").agg(F.min("request_id").alias("_m"))
        j = left.join(by_login, "login").join(by_mail, "_mail", "left")
        won = _materialise(j.filter((F.col("request_id") == F.col("_l")) & (F.col("request_id") == F.coalesce("_m", "request_id")))
                           .select("request_id", "login", "_mail"))
        out = won if out is None else out.unionByName(won)
        left = _materialise(left.join(won.select("login"), "login", "left_anti")
                            .join(won.filter(F.col("_mail").isNotNull()).select("_mail"), "_mail", "left_anti"))
    return new.limit(0) if out is None else out


def create_accounts(reqs: DataFrame, acct: DataFrame, locale: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """M7: bulk account creation.  Returns (decisions, default meta rows).

    ``reqs``: request_id, nickname, email, display_name, password, gender,
    last_name, first_name, locale, timezone, type.  Requests with a
    nickname under 3, a password under 8, or an e-mail of 1–5 characters are
    rejected.  A request matching a live account (J12) reactivates it when
    it is expired, else it just returns it.  Requests act in the order of
    their ids: only the first one reactivates an account, and later ones that
    match it return it with its new type.  Otherwise a new account is inserted,
    unless an earlier request of the batch has inserted one with the same
    login or e-mail (over 5 characters), to which it resolves, with normalised fields, salted sha512 password, gender
    code, best locale (J11) and default type, plus the default meta rows.
    """
    r = reqs.withColumn("_email", F.coalesce(F.col("email"), F.lit("")))
    bad = (F.length(F.coalesce("nickname", F.lit(""))) < 3) | (F.length(F.coalesce("password", F.lit(""))) < 8) \
        | ((F.length("_email") > 0) & (F.length("_email") < 6))
    r = r.withColumn("_reject", bad)
    ok = r.filter(~F.col("_reject")).withColumn("login", F.lower(F.trim(F.left("nickname", F.lit(64)))))
    matched = match_account(ok.select("request_id", F.col("nickname").alias("login"), "email"), acct) \
        .select("request_id", F.col("account_id").alias("_match"))
    ok = ok.join(matched, "request_id", "left")
    types = live(acct).select(F.col("id").alias("_match"), F.col("type").alias("_mtype"))
    # the matched requests feed four branches below: materialise them once
    # (reliable checkpoint) instead of re-running the matching joins per branch
    from tessera.operators.sequence import _materialise

    ok = _materialise(ok.join(types, "_match", "left"))
    new = ok.filter(F.col("_match").isNull()).withColumn("_mail", F.when(F.length("_email") > 5, F.lower("_email")))
    inserts = _materialise(_first_claims(new.select("request_id", "login", "_mail")))
    by_login = inserts.select("login", F.col("request_id").alias("_by_login"))
    by_mail = inserts.filter(F.col("_mail").isNotNull()).select("_mail", F.col("request_id").alias("_by_mail"))
    new = new.join(by_login, "login", "left").join(by_mail, "_mail", "left").withColumn(
        "_first", F.least(*[F.when(F.col(c) <= F.col("request_id"), F.col(c)) for c in ("_by_login", "_by_mail")]))
    max_id = acct.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    new = _one_row_join(new, max_id)
    new = best_locale(new, locale, "locale", out="_locale")
    in_type = F.lower(F.when(F.col("type").like("account.%"), F.col("type")).otherwise(F.lit("account.basic")))
    inserted = new.select(
        "request_id",
        F.when(F.col("request_id") == F.col("_first"), F.lit("insert")).otherwise(F.lit("duplicate")).alias("action"),
        (F.col("_max") + F.col("_first")).cast("long").alias("account_id"),
        "login",
        F.sha2(F.concat(F.lit(salt), F.col("password")), 512).alias("password_hash"),
        F.trim(F.left(F.when(F.coalesce(F.col("display_name"), F.lit("")) != "", F.col("display_name"))
                      .otherwise(F.col("first_name")), F.lit(80))).alias("display_name"),
        F.trim(F.left("last_name", F.lit(120))).alias("last_name"),
        F.trim(F.left("first_name", F.lit(120))).alias("first_name"),
        F.trim(F.left(F.lower("email"), F.lit(160))).alias("email"),
        F.when(F.upper(F.coalesce("gender", F.lit(""))).isin("F", "G"), "F").otherwise("M").alias("gender"),
        F.col("_locale").alias("locale_code"), "timezone", in_type.alias("type"))
    hits = ok.filter(F.col("_match").isNotNull())
    expired = F.col("_mtype") == "account.expired"
    # a request for the expired type itself leaves the account expired
    takes = F.when(in_type != "account.expired", F.col("request_id"))
    first_of = hits.filter(expired).groupBy("_match").agg(F.min(takes).alias("_first"), F.min_by(in_type, takes).alias("_new_type"))
    hits = hits.join(first_of, "_match", "left")
    after = expired & F.coalesce(F.col("request_id") > F.col("_first"), F.lit(False))
    existing = hits.select(
        "request_id", F.when(expired & ~after, F.lit("reactivate")).otherwise(F.lit("match")).alias("action"),
        F.col("_match").cast("long").alias("account_id"),
        F.when(after, F.col("_new_type")).when(expired, in_type).otherwise(F.col("_mtype")).alias("type"))
    rejected = r.filter("_reject").select("request_id", F.lit("reject").alias("action"),
                                          F.lit(None).cast("long").alias("account_id"))
    decisions = inserted.unionByName(existing, allowMissingColumns=True) \
        .unionByName(rejected, allowMissingColumns=True)
    defaults = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in ACCOUNT_DEFAULT_META])
    meta = inserted.filter(F.col("action") == "insert").select(
        "account_id", F.explode(defaults).alias("kv")).select("account_id", "kv.key", "kv.value")
    return decisions, meta


# ----------------------------------------------------------------------- M8
def update_accounts(cur: DataFrame, chg: DataFrame, salt: str | None = None) -> DataFrame:
    """M8: profile (and optional password) updates matched on (id, guid)
    of live accounts; the last request per account wins.  Returns the full
    account table with ``updated`` set on changed rows."""
    fields = ["display_name", "last_name", "first_name", "gender", "email", "locale_code", "timezone"]
    present = [f for f in fields if f in chg.columns]
    c = chg.select("request_id", F.col("account_id").alias("id"), F.col("account_guid").alias("guid"),
                   *present, *(["password"] if "password" in chg.columns else []))
    c = c.join(live(cur).select("id", "guid"), ["id", "guid"], "left_semi")
    vals = []
    for f in present:
        v = F.col(f)
        if f == "gender":
            v = F.when(F.upper(F.coalesce(v, F.lit(""))).isin("F", "G"), "F").otherwise("M")
        if f == "email":
            v = F.lower(v)
        vals.append(v.alias(f))
    if "password" in c.columns and salt is not None:
        vals.append(F.when(F.length(F.coalesce("password", F.lit(""))) > 0,
                           F.sha2(F.concat(F.lit(salt), F.col("password")), 512)).alias("password"))
    last = c.groupBy("id").agg(F.max_by(F.struct(*vals), "request_id").alias("n"))
    j = cur.join(last, "id", "left")
    out = j
    for f in present + (["password"] if "password" in c.columns and salt is not None else []):
        newv = F.col(f"n.{f}")
        if f == "password":
            out = out.withColumn(f, F.coalesce(newv, F.col(f)) if f in cur.columns else newv)
        else:
            out = out.withColumn(f, F.when(F.col("n").isNotNull(), newv).otherwise(F.col(f)) if f in cur.columns
                                 else newv)
    return out.withColumn("updated", F.col("n").isNotNull()).drop("n")


# ----------------------------------------------------------------------- M9
def register_files(reqs: DataFrame, acct: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """M9: file register/update requests → decisions and written values.

    ``reqs``: request_id, account_id, file_guid, local_name, file_name,
    path, bytes, mimetype, expires_at (text), access.  Rejected: local or
    public name under 3, MIME under 3, a guid that is neither empty nor 36
    long, bytes < 1, or no permission (live account that is admin/global,
    or owns the live unexpired file, or registers a new file).  A 36-long
    guid updates that live file, expired or not; otherwise a new file is
    inserted.  Text fields are trimmed to their lengths, MIME lower-cased,
    expiry parsed when at least 10 characters, and the access list sets
    read-only/public.  An update writes only the public name, MIME, expiry and
    the two flags: ``name``, ``location``, ``bytes`` and ``hash`` are NULL for
    it.  ``hash`` is the request's ``file_hash`` where there is one.
    """
    now = _ts(as_of)
    r = reqs.withColumn("_guid", F.coalesce(F.col("file_guid"), F.lit("")))
    valid = (F.length(F.coalesce("local_name", F.lit(""))) >= 3) & (F.length(F.coalesce("file_name", F.lit(""))) >= 3) \
        & (F.length(F.coalesce("mimetype", F.lit(""))) >= 3) \
        & ((F.length("_guid") == 0) | (F.length("_guid") == 36)) & (F.coalesce(F.col("bytes"), F.lit(0)) >= 1)
    a = live(acct).select(F.col("id").alias("account_id"), F.col("type").isin(ADMIN_TYPES).alias("_admin"))
    f = live(files).select(F.col("account_id").alias("_owner"), F.col("guid").alias("_guid"), F.col("id").alias("file_id"),
                           F.coalesce(F.col("expires_at") >= now, F.lit(True)).alias("_current"))
    j = r.join(a, "account_id", "left").join(f, "_guid", "left")
    owns = F.coalesce((F.col("_owner") == F.col("account_id")) & F.col("_current"), F.lit(False))
    can = F.col("_admin").isNotNull() & (F.col("_admin") | owns | (F.length("_guid") == 0))
    exp_txt = F.coalesce(F.col("expires_at"), F.lit(""))
    acc = F.lower(F.coalesce(F.col("access"), F.lit("")))
    fresh = F.length("_guid") != 36
    file_hash = F.col("file_hash") if "file_hash" in reqs.columns else F.lit(None).cast("string")
    out = j.select(
        "request_id", "account_id",
        F.when(~valid | ~F.coalesce(can, F.lit(False)), F.lit("reject"))
         .when(F.length("_guid") == 36, F.lit("update")).otherwise(F.lit("insert")).alias("action"),
        F.when(F.length("_guid") == 36, F.col("file_id")).alias("file_id"),
        F.when(fresh, F.trim(F.left("local_name", F.lit(64)))).alias("name"),
        F.trim(F.left("file_name", F.lit(256))).alias("public_name"),
        F.when(fresh, F.trim(F.left("path", F.lit(256)))).alias("location"),
        F.when(fresh, F.greatest(F.coalesce(F.col("bytes"), F.lit(0)), F.lit(0))).alias("bytes"),
        F.when(fresh, file_hash).alias("hash"),
        F.lower(F.trim(F.left("mimetype", F.lit(64)))).alias("mimetype"),
        F.when(F.length(exp_txt) >= 10, F.try_to_timestamp(exp_txt)).alias("expires_at"),
        (acc != "public-read-write").alias("is_readonly"),
        (acc != "private").alias("is_public"),
    )
    # an update whose guid names no live file of anyone writes nothing
    return out.withColumn("action", F.when((F.col("action") == "update") & F.col("file_id").isNull(), F.lit("reject"))
                          .otherwise(F.col("action")))


# ---------------------------------------------------------------------- M10
def intake_messages(df: DataFrame) -> DataFrame:
    """Contact intake.  Name, mail and message are required (after
    trimming; an invalid e-mail counts as blank); accepted rows get capped,
    lower-cased mail, blank→NULL optional fields and the message sha512.
    Adds ``accepted``."""
    from tessera.functions.text import valid_email

    name = F.trim(F.coalesce(F.col("name"), F.lit("")))
    mail = F.lower(F.trim(F.coalesce(F.col("mail"), F.lit(""))))
    mail = F.when(valid_email(mail), mail).otherwise(F.lit(""))
    subject = F.trim(F.coalesce(F.col("subject"), F.lit("")))
    message = F.trim(F.coalesce(F.col("message"), F.lit("")))
    ok = (F.length(name) > 0) & (F.length(mail) > 0) & (F.length(message) > 0)
    return df.select(
        "*",
        ok.alias("accepted"),
        F.when(F.length(name) > 0, F.left(name, F.lit(512))).alias("clean_name"),
        F.when(F.length(mail) > 0, F.lower(F.left(mail, F.lit(160)))).alias("clean_mail"),
        F.when(F.length(subject) > 0, F.left(subject, F.lit(512))).alias("clean_subject"),
        message.alias("clean_message"),
        F.sha2(F.replace(message, F.lit("\\"), F.lit("\\\\")), 512).alias("hash"),
    )


# ---------------------------------------------------------------------- M11
# Meta rows every new site starts with.
SITE_DEFAULT_META = [
    ("show.article", "Y"),
    ("show.note", "N"),
    ("show.quotation", "Y"),
    ("show.location", "N"),
    ("site.explicit", "C"),
    ("site.license", "CC BY-NC-SA"),
    ("site.rss-cover", ""),
    ("site.rss-items", "25"),
]


def merge_sites(reqs: DataFrame, site: DataFrame, siteurl: DataFrame, acct: DataFrame,
                locale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Site create/update requests, in the order of their ids.  Returns
    (decisions, default meta).

    ``reqs``: request_id, account_id, site_id (≤0 = new), name, description,
    keywords, locale, https, theme, url.  A new site whose url is already
    the active url of a live site (J13), or one that an earlier accepted request
    of the batch has taken, is rejected; otherwise it is created
    (name/description/keywords trimmed to length, keywords lower-cased,
    locale = a live locale equal ignoring case, else the account's locale,
    https from 'Y', theme lower-cased) with the default meta rows.  Updates
    need the id of a live site that the account owns.  Each decision carries the url action: insert the
    url as active, or re-activate the matching url (A4).
    """
    from tessera.operators.catalog import url_conflicts

    r = reqs.withColumn("site_id", F.coalesce(F.col("site_id"), F.lit(0)))
    conf = url_conflicts(r.select("request_id", "url"), site, siteurl).select("request_id", "url_taken")
    r = r.join(conf, "request_id", "left")
    loc = live(locale).select(F.lower("code").alias("_lk"), F.col("code").alias("_loc"))
    loc = loc.groupBy("_lk").agg(F.min("_loc").alias("_loc"))
    a = live(acct).select(F.col("id").alias("account_id"), F.col("locale_code").alias("_acct_locale"))
    r = r.join(a, "account_id", "left").join(loc, F.lower(F.col("locale")) == F.col("_lk"), "left")
    live_sites = live(site).select(F.col("id").alias("site_id"), F.col("account_id").alias("_owner"))
    r = r.join(live_sites, "site_id", "left")
    max_id = site.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    r = _one_row_join(r, max_id)
    is_new = F.col("site_id") <= 0
    action = (F.when(F.col("_acct_locale").isNull() & F.col("account_id").isNotNull() & is_new, "reject")
              .when(is_new & F.coalesce(F.col("url_taken"), F.lit(False)), "reject")
              .when(is_new, "insert")
              .when(F.coalesce(F.col("_owner") == F.col("account_id"), F.lit(False)), "update").otherwise("reject"))
    r = r.withColumn("_action", action).withColumn("_url", F.lower("url"))
    first = r.filter((F.col("_action") != "reject") & F.col("_url").isNotNull()).groupBy("_url").agg(F.min("request_id").alias("_first"))
    r = r.join(first, "_url", "left")
    late = (F.col("_action") == "insert") & F.coalesce(F.col("request_id") > F.col("_first"), F.lit(False))
    out = r.select(
        "request_id", F.when(late, F.lit("reject")).otherwise(F.col("_action")).alias("action"),
        F.when(is_new, F.col("_max") + F.col("request_id")).otherwise(F.col("site_id")).cast("long").alias("site_id"),
        F.trim(F.left("name", F.lit(256))).alias("name"),
        F.trim(F.left("description", F.lit(512))).alias("description"),
        F.lower(F.trim(F.left("keywords", F.lit(1024)))).alias("keywords"),
        F.when(is_new, F.coalesce("_loc", "_acct_locale")).otherwise(F.col("_loc")).alias("locale_code"),
        (F.upper(F.coalesce("https", F.lit(""))) == "Y").alias("https"),
        F.lower("theme").alias("theme"), F.lower("url").alias("url"))
    defaults = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in SITE_DEFAULT_META])
    meta = out.filter(F.col("action") == "insert").select("site_id", F.explode(defaults).alias("kv")) \
        .select("site_id", "kv.key", "kv.value")
    summary_in = out.filter(F.col("action") != "reject").select("request_id", "site_id", "url")
    urls = live(siteurl).select("site_id", F.col("url").alias("_u"), F.col("id").alias("_uid"))
    match = urls.groupBy("site_id", "_u").agg(F.max("_uid").alias("url_id"))
    summary = summary_in.join(match, (summary_in.site_id == match.site_id) & (F.col("url") == F.col("_u")), "left") \
        .select("request_id", "url_id")
    out = out.join(summary, "request_id", "left").withColumn(
        "url_action", F.when(F.col("action") == "reject", F.lit(None))
        .when(F.col("url_id").isNull(), F.lit("insert_active")).otherwise(F.lit("activate")))
    return out, meta


# ---------------------------------------------------------------------- M12
def issue_tokens(logins: DataFrame, acct: DataFrame) -> DataFrame:
    """M12 issue: a token per successful login of a live, non-expired
    account: guid = uuid ‖ '-' ‖ md5(email)[:4] ‖ '-' ‖ md5(account guid)[:8]."""
    a = live(acct).filter(F.col("type") != "account.expired").select(
        F.col("id").alias("account_id"), "email", F.col("guid").alias("account_guid"))
    j = logins.join(a, "account_id")
    return j.select("login_id", "account_id", F.concat(
        F.expr("uuid()"), F.lit("-"), F.left(F.md5(F.coalesce("email", F.lit(""))), F.lit(4)), F.lit("-"),
        F.left(F.md5(F.coalesce("account_guid", F.lit(""))), F.lit(8))).alias("token_guid"))


def touch_tokens(cur: DataFrame, seen: DataFrame, as_of: str) -> DataFrame:
    """M12 touch: live tokens seen (by id and guid, guid ≥ 36 chars) get
    updated_at = as_of; the read that checks the lifespan happens before
    the touch (J8)."""
    s = seen.select("id", "guid").filter(F.length("guid") >= 36).distinct().withColumn("_seen", F.lit(True))
    j = cur.join(s, ["id", "guid"], "left")
    hit = F.coalesce(F.col("_seen"), F.lit(False)) & ~F.col("is_deleted")
    return j.withColumn("updated_at", F.when(hit, _ts(as_of)).otherwise(F.col("updated_at"))) \
        .withColumn("touched", hit).drop("_seen")


def revoke_tokens(cur: DataFrame, keys: DataFrame) -> DataFrame:
    """M12 revoke: live tokens named by (id, guid) are soft-deleted."""
    k = keys.select("id", "guid").distinct().withColumn("_hit", F.lit(True))
    j = cur.join(k, ["id", "guid"], "left")
    return j.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")
