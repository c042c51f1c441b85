"""User-agent → (platform, browser, version) with native Spark
expressions: the candidate tokens are pulled out with
``regexp_extract_all`` and the special cases are an ordered ``when`` chain
over those arrays — no Python in the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Platform tokens looked for inside the first parenthesised
# part, the platforms preferred when several are present, the browser
# tokens, and the fallback for agents that do not start with "Mozilla".
PLATFORM_RE = (r"(?i)(BB\d+;|Android|CrOS|Tizen|iPhone|iPad|iPod|Linux|Macintosh|Windows( Phone)?|Silk|linux-gnu"
               r"|BlackBerry|PlayBook|X11|(New )?Nintendo (WiiU?|3?DS)|Xbox( One)?)(?: [^;]*)?(?:;|$)")
PLATFORM_PRIORITY = ["Xbox One", "Xbox", "Windows Phone", "Tizen", "Android", "CrOS", "X11"]
BROWSER_RE = (r"(?i)(Camino|Kindle( Fire)?|Firefox|Iceweasel|Safari|MSIE|Trident|AppleWebKit|TizenBrowser|Chrome"
              r"|Vivaldi|IEMobile|Opera|OPR|Silk|Midori|Edge|Brave|CriOS|UCBrowser"
              r"|Baiduspider|Googlebot|YandexBot|bingbot|Lynx|Version|Wget|curl"
              r"|Valve Steam Tenfoot"
              r"|NintendoBrowser|PLAYSTATION (\d|Vita)+)"
              r"(?:\)?;?)"
              r"(?:(?:[:/ ])([0-9A-Z.]+)|/(?:[A-Z]*))")
FALLBACK_RE = r"(?i)^(?!Mozilla)([A-Z0-9\-]+)(/([0-9A-Z.]+))?"
RV_RE = r"(?i)rv:([0-9A-Z.]+)"


def _blank_null(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


# every browser token the special cases look up
_TERMS = ["Version", "Playstation Vita", "Kindle Fire", "Silk", "NintendoBrowser", "Kindle", "OPR", "Opera",
          "IEMobile", "Edge", "Midori", "Vivaldi", "Valve Steam Tenfoot", "Chrome", "Trident", "UCBrowser",
          "CriOS", "Safari", "TizenBrowser"]


def _stage(df: DataFrame, col: str) -> DataFrame:
    """Compute the token arrays and positions once per row as columns, so
    the decision chain below only reads them (small generated code, no
    repeated regular-expression scans)."""
    ua = F.coalesce(F.col(col), F.lit(""))
    out = (df.withColumn("_ua", ua)
             .withColumn("_paren", F.regexp_extract("_ua", r"\((.*?)\)", 1))
             .withColumn("_has_paren", F.col("_ua").rlike(r"\((.*?)\)"))
             .withColumn("_b", F.regexp_extract_all("_ua", F.lit(BROWSER_RE), 1))
             .withColumn("_v", F.regexp_extract_all("_ua", F.lit(BROWSER_RE), 4))
             .withColumn("_rv", _blank_null(F.regexp_extract("_ua", RV_RE, 1))))
    out = out.withColumn("_lb", F.transform("_b", F.lower)) \
        .withColumn("_plats", F.array_distinct(F.regexp_extract_all("_paren", F.lit(PLATFORM_RE), 1)))
    cols = {f"_p{i}": F.array_position("_lb", F.lit(t.lower())).cast("int") for i, t in enumerate(_TERMS)}
    cols["_bv"] = F.array_position("_b", F.lit("Version")).cast("int")
    cols["_ps"] = F.filter("_lb", lambda x: x.rlike("playstation [0-9]"))
    cols["_fb_b"] = _blank_null(F.regexp_extract("_ua", FALLBACK_RE, 1))
    cols["_fb_v"] = _blank_null(F.regexp_extract("_ua", FALLBACK_RE, 3))
    return out.withColumns(cols)


def _decide() -> tuple[Column, Column, Column]:
    plats = F.col("_plats")
    prio = F.array_intersect(F.array(*[F.lit(p) for p in PLATFORM_PRIORITY]), plats)
    platform = F.when(~F.col("_has_paren") | (F.size(plats) == 0), F.lit(None).cast("string")) \
        .when((F.size(plats) > 1) & (F.size(prio) > 0), F.try_element_at(prio, F.lit(1))) \
        .otherwise(F.try_element_at(plats, F.lit(1)))
    platform = (F.when(platform.isin("linux-gnu", "X11"), F.lit("Linux"))
                .when(platform == "CrOS", F.lit("Chrome OS")).otherwise(platform))
    b, v, rv, ps = F.col("_b"), F.col("_v"), F.col("_rv"), F.col("_ps")

    def pos(term: str) -> Column:  # 1-based position of the first match, 0 if absent
        return F.col(f"_p{_TERMS.index(term)}")

    def ver(i: Column) -> Column:
        return F.try_element_at(v, F.greatest(i, F.lit(1)))

    def first_of(terms: list[str]) -> tuple[Column, Column]:
        """(position, term) of the first term (in search order) present."""
        p = F.lit(0)
        t = F.lit(None).cast("string")
        for term in reversed(terms):
            p = F.when(pos(term) > 0, pos(term)).otherwise(p)
            t = F.when(pos(term) > 0, F.lit(term)).otherwise(t)
        return p, t

    b0 = F.try_element_at(b, F.lit(1))
    v0 = F.try_element_at(v, F.lit(1))
    p_version = pos("Version")
    kf_pos, kf_term = first_of(["Kindle Fire", "Silk"])
    kf_ver = ver(kf_pos)
    kf_ver = F.when(F.coalesce(kf_ver, F.lit("")).rlike("^[0-9]"), kf_ver).otherwise(ver(F.col("_bv")))
    ie_pos, ie_term = first_of(["IEMobile", "Edge", "Midori", "Vivaldi", "Valve Steam Tenfoot", "Chrome"])
    sf_pos, sf_term = first_of(["Safari", "TizenBrowser"])
    webkit_key = F.when(p_version > 0, p_version).when(platform == "Android", F.lit(1)) \
        .when(sf_pos > 0, sf_pos).otherwise(F.lit(1))
    nintendo = (pos("NintendoBrowser") > 0) | F.coalesce(platform == "Nintendo 3DS", F.lit(False))
    msie = (b0 == "MSIE") | (rv.isNotNull() & (pos("Trident") > 0))

    browser = (
        F.when(b0 == "Iceweasel", F.lit("Firefox"))
        .when(pos("Playstation Vita") > 0, F.lit("Browser"))
        .when(kf_pos > 0, F.when(kf_term == "Silk", F.lit("Silk")).otherwise(F.lit("Kindle")))
        .when(nintendo, F.lit("NintendoBrowser"))
        .when(pos("Kindle") > 0, F.try_element_at(b, F.greatest(pos("Kindle"), F.lit(1))))
        .when(pos("OPR") > 0, F.lit("Opera Next"))
        .when(pos("Opera") > 0, F.lit("Opera"))
        .when(ie_pos > 0, ie_term)
        .when(msie, F.lit("MSIE"))
        .when(pos("UCBrowser") > 0, F.lit("UC Browser"))
        .when(pos("CriOS") > 0, F.lit("Chrome"))
        .when(b0 == "AppleWebKit",
              F.when(platform == "Android", F.lit("Android Browser"))
              .when(F.coalesce(platform.startswith("BB"), F.lit(False)), F.lit("BlackBerry Browser"))
              .when(platform.isin("BlackBerry", "PlayBook"), F.lit("BlackBerry Browser"))
              .when(sf_pos > 0, sf_term).otherwise(b0))
        .when(F.size(ps) > 0, F.lit("NetFront"))
        .otherwise(b0))
    version = (
        F.when(b0 == "Iceweasel", v0)
        .when(pos("Playstation Vita") > 0, v0)
        .when(kf_pos > 0, kf_ver)
        .when(nintendo, ver(pos("NintendoBrowser")))
        .when(pos("Kindle") > 0, ver(pos("Kindle")))
        .when(pos("OPR") > 0, ver(pos("OPR")))
        .when(pos("Opera") > 0, ver(F.when(p_version > 0, p_version).otherwise(pos("Opera"))))
        .when(ie_pos > 0, ver(ie_pos))
        .when(msie, F.coalesce(rv, v0))
        .when(pos("UCBrowser") > 0, ver(pos("UCBrowser")))
        .when(pos("CriOS") > 0, ver(pos("CriOS")))
        .when(b0 == "AppleWebKit", ver(webkit_key))
        .otherwise(v0))
    earlier = ((b0 == "Iceweasel") | nintendo | (pos("Kindle") > 0) | (pos("OPR") > 0) | (pos("Opera") > 0)
               | (ie_pos > 0) | msie | (pos("UCBrowser") > 0) | (pos("CriOS") > 0))
    platform = (F.when(pos("Playstation Vita") > 0, F.lit("PlayStation Vita"))
                .when(kf_pos > 0, F.lit("Kindle Fire"))
                .when((pos("Kindle") > 0) & ~((b0 == "Iceweasel") | nintendo), F.lit("Kindle"))
                .when((b0 == "AppleWebKit") & F.coalesce(platform.startswith("BB"), F.lit(False)) & ~earlier,
                      F.lit("BlackBerry"))
                .when((F.size(ps) > 0) & (b0 != "AppleWebKit") & ~earlier,
                      F.concat(F.lit("PlayStation "), F.regexp_replace(F.try_element_at(ps, F.lit(1)), "[^0-9]", "")))
                .otherwise(platform))

    no_match = F.size(b) == 0
    fb_b, fb_v = F.col("_fb_b"), F.col("_fb_v")
    empty_ua = F.col("_ua") == ""
    out_p = F.when(empty_ua, F.lit(None)).otherwise(_blank_null(platform))
    out_b = F.when(empty_ua, F.lit(None)).when(no_match, fb_b).otherwise(_blank_null(browser))
    out_v = F.when(empty_ua, F.lit(None)).when(no_match, F.when(fb_b.isNotNull(), fb_v)).otherwise(_blank_null(version))
    out_p = F.when(no_match & fb_b.isNull(), F.lit(None)).otherwise(out_p)
    return out_p, out_b, out_v


def parse_user_agent(df: DataFrame, col: str = "agent", distinct: bool = False) -> DataFrame:
    """Add ``platform``, ``browser`` and ``version`` parsed from ``col``.

    ``distinct=True`` (batch only): agent strings repeat heavily, so each
    distinct string is parsed once and joined back on a null-safe key.  The
    de-dup is a map-side partial aggregation (a hot agent collapses before
    the shuffle); the planner broadcasts the parsed table only when its
    runtime size is under the broadcast threshold, else it shuffles and
    AQE splits skewed keys.
    """
    if distinct:
        agents = df.select(F.col(col).alias("_agent")).distinct()
        parsed = parse_user_agent(agents, "_agent")
        out = df.drop("platform", "browser", "version") if {"platform", "browser", "version"} & set(df.columns) else df
        return out.join(parsed, out[col].eqNullSafe(parsed["_agent"]), "left").drop("_agent")
    staged = _stage(df, col)
    p, b, v = _decide()
    tmp = [c for c in staged.columns if c.startswith("_") and c not in df.columns]
    return (staged.withColumn("platform", p).withColumn("browser", b).withColumn("version", v).drop(*tmp))
