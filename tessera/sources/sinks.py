"""Sinks and output shapes: sitemap (S5), hreflang links (S6), RSS items
(S7), JSON envelope (S8), XML rows (S9) and the wire form (S10).

Each builder is a projection (row-local string building over small fixed
lists with ``transform``), so output rows are produced where the data
lives and written by the usual partitioned writers; nothing is gathered
into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, TimestampNTZType, TimestampType

TAB = "    "
CRLF = "\r\n"


def _hreflang(lang: str) -> str:
    lang = lang.replace("_", "-")
    return lang[:2] + "-" + lang[-2:].upper() if len(lang) >= 5 else lang


def sitemap_rows(pages: DataFrame, langs: list[str], default: str, home_url: str, as_of: str,
                 path_col: str = "path") -> DataFrame:
    """One sitemap ``<url>`` item per page path: the location, one
    canonical/alternate link per language (the default language without a
    path prefix) and the hour-truncated ``lastmod``."""
    default = default.lower().replace("_", "-")
    path = F.col(path_col)
    suffix = F.when(F.length(path) > 1, path).otherwise(F.lit(""))
    links = []
    for lang in langs:
        lang = lang.replace("_", "-")
        rel = "canonical" if lang == default else "alternate"
        prefix = "" if lang == default else "/" + lang
        links.append(F.concat(F.lit(f'{TAB * 2}<xhtml:link rel="{rel}" hreflang="{_hreflang(lang)}" href="{home_url}{prefix}'),
                              suffix, F.lit('"/>' + CRLF)))
    lastmod = F.date_format(F.date_trunc("hour", F.to_timestamp(F.lit(as_of))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.concat(F.lit(f"{TAB}<url>{CRLF}{TAB * 2}<loc>{home_url}"), suffix, F.lit(f"</loc>{CRLF}"),
                    *links, F.lit(f"{TAB * 2}<lastmod>"), lastmod, F.lit(f"</lastmod>{CRLF}{TAB}</url>{CRLF}"))
    return pages.select("*", item.alias("sitemap_item"))


def hreflang_rows(pages: DataFrame, langs: list[str], default: str, home_url: str,
                  path_col: str = "path") -> DataFrame:
    """Link rows per page: canonical, x-default, one alternate per
    language and one RSS alternate per language.  Expanded with a generator
    over the fixed language list (no join)."""
    default = default.lower().replace("_", "-")
    p = F.regexp_replace(F.coalesce(F.col(path_col), F.lit("")), "^/+", "")
    base = F.concat(F.lit(home_url + "/"), p)
    entries = [F.struct(F.lit(0).alias("ord"), F.lit("canonical").alias("rel"), F.lit(None).cast("string").alias("hreflang"),
                        F.lit(None).cast("string").alias("type"), base.alias("href")),
               F.struct(F.lit(1).alias("ord"), F.lit("alternate").alias("rel"), F.lit("x-default").alias("hreflang"),
                        F.lit(None).cast("string").alias("type"), base.alias("href"))]
    for i, lang in enumerate(langs):
        pre = "" if lang == default else lang + "/"
        entries.append(F.struct(F.lit(10 + i).alias("ord"), F.lit("alternate").alias("rel"), F.lit(lang).alias("hreflang"),
                                F.lit(None).cast("string").alias("type"),
                                F.concat(F.lit(f"{home_url}/{pre}"), p).alias("href")))
    for i, lang in enumerate(langs):
        pre = "" if lang == default else lang + "/"
        entries.append(F.struct(F.lit(100 + i).alias("ord"), F.lit("alternate").alias("rel"), F.lit(lang).alias("hreflang"),
                                F.lit("application/rss+xml").alias("type"), F.lit(f"{home_url}/{pre}rss.xml").alias("href")))
    return pages.select("*", F.explode(F.array(*entries)).alias("l")).select(*pages.columns, "l.*")


RSS_ITEM_TEMPLATE = (
    "        <item>\n"
    "            <title>[TITLE]</title>\n"
    "            <link>[URL]</link>\n"
    "            <pubDate>[PUBLISH_DTS]</pubDate>\n"
    "            <dc:creator>[AUTHOR]</dc:creator>\n"
    "            <guid isPermaLink=\"false\">[UUID]</guid>\n"
    "            <description>[SUMMARY]</description>\n"
    "            <content:encoded><![CDATA[[CONTENT]]]></content:encoded>\n"
    "            <atom:updated>[UPDATED_DTS]</atom:updated>\n"
    "        </item>"
)


def rfc822(ts: Column) -> Column:
    """'Mon, 01 Jan 2024 09:00:00 +0000' (session zone UTC)."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")


def rss_items(df: DataFrame) -> DataFrame:
    """RSS ``<item>`` text per row.  ``df``: guid, locale, title,
    author, url, summary, html, publish_at, updated_at.  The item id is
    guid + '-' + locale without separators, lower-cased."""
    uuid = F.lower(F.concat(F.trim("guid"), F.lit("-"), F.translate(F.trim("locale"), "-_", "")))
    text = F.lit(RSS_ITEM_TEMPLATE)
    for token, value in (("[TITLE]", "title"), ("[AUTHOR]", "author"), ("[URL]", "url"), ("[SUMMARY]", "summary"),
                         ("[CONTENT]", "html")):
        text = F.replace(text, F.lit(token), F.trim(F.coalesce(F.col(value), F.lit(""))))
    text = F.replace(text, F.lit("[UUID]"), uuid)
    text = F.replace(text, F.lit("[PUBLISH_DTS]"), rfc822(F.col("publish_at")))
    text = F.replace(text, F.lit("[UPDATED_DTS]"), rfc822(F.col("updated_at")))
    return df.select("*", uuid.alias("item_id"), F.concat(F.lit("\r\n"), text).alias("rss_item"))


def to_envelope(df: DataFrame, code: int = 200, errors_col: str | None = None) -> DataFrame:
    """JSON result envelope per row: ``{"meta": {"code", "text",
    "more"}, "data": row}``.  ``text`` is the last error of the row's error
    list, ``more`` the distinct earlier errors other than it (only when
    there are several)."""
    data_cols = [c for c in df.columns if c != errors_col]
    meta = [F.lit(code).alias("code")]
    if errors_col:
        errs = F.coalesce(F.col(errors_col), F.array().cast("array<string>"))
        last = F.try_element_at(errs, F.lit(-1))
        more = F.array_distinct(F.filter(errs, lambda e: e != last))
        meta.append(F.when(F.length(last) > 0, last).alias("text"))
        meta.append(F.when((F.size(errs) > 1) & (F.size(more) > 0), more).alias("more"))
    env = F.struct(F.struct(*meta).alias("meta"), F.struct(*data_cols).alias("data"))
    return df.select(F.to_json(env, {"ignoreNullFields": "true"}).alias("envelope"))


def to_xml_rows(df: DataFrame, row_tag: str = "row") -> DataFrame:
    """Each row as an XML element; columns named ``@x`` become
    attributes, booleans are written as 'true'/'false'."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, BooleanType):
            c = F.when(c, F.lit("true")).otherwise(F.lit("false"))
        name = "_" + f.name[1:] if f.name.startswith("@") else f.name
        cols.append(c.alias(name))
    return df.select(F.to_xml(F.struct(*cols), {"rowTag": row_tag, "attributePrefix": "_"}).alias("xml"))


def wire_form(df: DataFrame) -> DataFrame:
    """API wire form in one projection: booleans → 'Y'/'N',
    timestamps → epoch seconds, other columns unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, BooleanType):
            c = F.when(c, F.lit("Y")).otherwise(F.lit("N"))
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType)):
            c = F.unix_timestamp(c.cast("timestamp"))
        out.append(c.alias(f.name))
    return df.select(*out)
