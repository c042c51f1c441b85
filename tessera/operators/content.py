"""Label, locale and key/value shaping jobs: J15 label overlay, J16
locale negotiation, A5 meta nesting, A6 record melting, A8 review context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import no_null
from tessera.sources.tables import live


def _norm_locale(c: Column) -> Column:
    return F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit("-")))


# ---------------------------------------------------------------------- J15
def overlay_labels(labels: DataFrame, requests: DataFrame, default: str, replacements: dict[str, str],
                   locale_col: str = "locale") -> DataFrame:
    """Label strings for each requested locale.

    ``labels``: (lang_code, key, value) rows of every language file.
    Sources in priority order: the default language, then the request's
    two-letter language, then its full locale; a later source overwrites
    an earlier one.  ``{token}`` replacements are applied to the values.

    Plan: the distinct requested locales expand to at most three
    (lang_code, priority) candidates, equi-joined to the label rows; the
    winner per (locale, key) is a ``max_by`` aggregate.
    """
    d = _norm_locale(F.lit(default))
    req = requests.select(_norm_locale(F.col(locale_col)).alias("locale")).distinct()
    cands = req.select("locale", F.explode(F.array(
        F.struct(d.alias("lang_code"), F.lit(1).alias("prio")),
        F.struct(F.when(F.length("locale") > 2, F.left("locale", F.lit(2))).alias("lang_code"), F.lit(2).alias("prio")),
        F.struct(F.col("locale").alias("lang_code"), F.lit(3).alias("prio")))).alias("c")).select("locale", "c.*")
    lab = labels.select(_norm_locale(F.col("lang_code")).alias("lang_code"), "key", "value")
    j = cands.filter(F.col("lang_code").isNotNull()).join(lab, "lang_code")
    value = no_null(F.col("value"))
    for token, repl in replacements.items():
        value = F.replace(value, F.lit(token), F.lit(repl))
    j = j.withColumn("value", value)
    return j.groupBy("locale", "key").agg(F.max_by("value", "prio").alias("value"))


# ---------------------------------------------------------------------- J16
def negotiate_locale(df: DataFrame, locales: list[str], default: str, cookie_col: str = "cookie_lang",
                     uri_col: str = "request_uri", header_col: str = "accept_language",
                     out: str = "display_lang") -> DataFrame:
    """Display language of each request: an explicit value (query or
    cookie, 2–5 characters), else the first path segment that is a known
    locale, else the first Accept-Language option that is a known locale or
    the two-letter prefix of one (first locale in list order), else the
    default.  A value that is not a known locale also falls back to the
    default.  All array work is native (split / filter / transform)."""
    locs = F.array(*[F.lit(x.lower()) for x in locales])
    cookie = no_null(F.col(cookie_col))
    explicit = F.when(F.length(cookie).between(2, 5), cookie)
    segs = F.transform(F.split(no_null(F.col(uri_col)), "/"), lambda p: F.lower(no_null(p)))
    in_path = F.try_element_at(F.filter(segs, lambda p: (F.length(p) > 0) & F.array_contains(locs, p)), F.lit(1))
    opts = F.transform(F.split(F.concat(no_null(F.col(header_col)), F.lit("|")), "[,;|]"),
                       lambda o: F.lower(no_null(F.translate(o, "_", "-"))))
    opts = F.filter(opts, lambda o: F.length(o) >= 2)
    picks = F.transform(opts, lambda o: F.when(F.array_contains(locs, o), o).otherwise(
        F.try_element_at(F.filter(locs, lambda l: F.left(l, F.lit(2)) == o), F.lit(1))))
    from_header = F.try_element_at(F.filter(picks, lambda p: p.isNotNull()), F.lit(1))
    chosen = F.lower(F.coalesce(explicit, in_path, from_header, F.lit("")))
    return df.withColumn(out, F.when(F.array_contains(locs, chosen), chosen).otherwise(F.lit(default.lower())))


# ----------------------------------------------------------------------- A5
def _json_str(c: Column) -> Column:
    """JSON string literal of a text column."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def _json_value(v: Column) -> Column:
    """Decimal text → JSON number (as a double), else a JSON string ('NaN',
    '1d' and numbers beyond a double are strings)."""
    text = F.trim(v)
    num = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(num) < float("inf"), num.cast("string")).otherwise(_json_str(no_null(v)))


def _members(df: DataFrame, keys: list[str], name: str, val: str) -> DataFrame:
    """Group member rows '"name":value' into one '{...}' object per keys.  Of
    rows with one name an object wins over a value, then the largest."""
    one = df.groupBy(*keys, name).agg(F.max(F.struct(F.col(val).startswith("{").alias("o"), F.col(val).alias("v")))["v"].alias(val))
    member = F.concat(_json_str(F.col(name)), F.lit(":"), F.col(val))
    return one.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(member)), ","),
                                          F.lit("}")).alias("obj"))


def nest_meta(meta: DataFrame, fk: str) -> DataFrame:
    """A5: live dotted-key rows → one nested JSON object per parent.

    Keys of 2–4 segments (lower-cased, trimmed) nest one level per segment;
    other depths are dropped.  Numeric values become numbers.  Built bottom
    up with one aggregate per level; each group holds the distinct keys
    under one prefix of one parent (a key vocabulary, not a row count).
    """
    segs = F.transform(F.split(no_null(F.col("key")), r"\."), lambda s: F.lower(no_null(s)))
    m = live(meta).select(F.col(fk), segs.alias("s"), _json_value(F.col("value")).alias("v")) \
        .filter(F.size("s").between(2, 4))
    k = [F.col("s")[i].alias(f"k{i + 1}") for i in range(4)]
    m = m.select(fk, F.size("s").alias("d"), *k, "v")
    l4 = _members(m.filter(F.col("d") == 4), [fk, "k1", "k2", "k3"], "k4", "v")
    l3_items = m.filter(F.col("d") == 3).select(fk, "k1", "k2", "k3", "v") \
        .unionByName(l4.select(fk, "k1", "k2", "k3", F.col("obj").alias("v")))
    l3 = _members(l3_items, [fk, "k1", "k2"], "k3", "v")
    l2_items = m.filter(F.col("d") == 2).select(fk, "k1", "k2", "v") \
        .unionByName(l3.select(fk, "k1", "k2", F.col("obj").alias("v")))
    l2 = _members(l2_items, [fk, "k1"], "k2", "v")
    return _members(l2.select(fk, "k1", F.col("obj").alias("v")), [fk], "k1", "v").withColumnRenamed("obj", "meta_json")


# ----------------------------------------------------------------------- A6
def melt_customer(df: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """External customer record → meta rows: stripe.id, stripe.name,
    contact.phone, contact.email (kept when longer than 10 characters) and
    address.* parts (kept when not blank).  One ``stack`` (unpivot) and a
    filter — no join."""
    pairs = [("stripe.id", "id", 10), ("stripe.name", "name", 10), ("contact.phone", "phone", 10),
             ("contact.email", "email", 10), ("address.postal_code", "postal_code", 0),
             ("address.country", "country", 0), ("address.state", "state", 0), ("address.line1", "line1", 0),
             ("address.line2", "line2", 0), ("address.city", "city", 0)]
    cols = [F.struct(F.lit(k).alias("key"), no_null(F.col(c).cast("string")).alias("value"), F.lit(n).alias("min_len"))
            for k, c, n in pairs if c in df.columns]
    out = df.select(F.col(id_col), F.explode(F.array(*cols)).alias("kv")).select(id_col, "kv.*")
    return out.filter(F.length("value") > F.col("min_len")).drop("min_len")


# ----------------------------------------------------------------------- A8
def review_context(reviews: DataFrame, key: str = "location_id") -> tuple[DataFrame, DataFrame]:
    """Per place the average rating (3 decimals) and the review count
    (live reviews), plus the review blocks in (publish_at, key) order, each
    followed by a row of dashes.  The blocks stay one row per review (the
    consumer concatenates them in order), so no place's reviews are
    gathered into a single value."""
    r = live(reviews)
    stats = r.groupBy(key).agg(F.round(F.avg(F.col("rating").cast("double")), 3).alias("rating_avg"),
                               F.count("*").alias("review_count"))
    blocks = r.select(key, "publish_at", F.col("key").alias("review_key"),
                      F.concat(no_null(F.col("content")), F.lit("\n----------\n")).alias("block"))
    return stats, blocks
