"""Shared DuckDB SQL pieces for the oracles.

These are independent SQL formulations of the library's operators, used
only to check the Spark results.  Each is a CTE body over fixture CTEs.
"""

from __future__ import annotations

from tessera.fixtures import AS_OF_DATE, HOME_URL, with_fixtures

# M13 written as SQL over the `usage_raw` stand-in.
USAGE_NORM = f"""
SELECT id,
       CASE WHEN site_id > 0 THEN site_id END AS site_id,
       CASE WHEN token_id > 0 THEN token_id END AS token_id,
       CAST(CASE WHEN http_code BETWEEN 100 AND 599 THEN http_code ELSE 200 END AS SMALLINT) AS http_code,
       CASE WHEN coalesce(request_type, '') = '' THEN 'GET' ELSE trim(left(request_type, 8)) END AS request_type,
       lower(CASE WHEN coalesce(request_uri, '') = '' THEN '/' ELSE trim(left(request_uri, 512)) END) AS request_uri,
       CASE WHEN length(coalesce(ref1, '')) > 3 THEN lower(ref1) END AS referrer,
       CASE WHEN length(locale_code) BETWEEN 2 AND 5 THEN lower(trim(left(locale_code, 6))) END AS locale_code,
       event_at,
       strftime(event_at, '%Y-%m-%d') AS event_on,
       trim(left(coalesce(from_ip, ''), 64)) AS from_ip,
       CASE WHEN coalesce(agent, '') = '' THEN NULL ELSE trim(left(agent, 2048)) END AS agent,
       abs(seconds) AS seconds,
       CAST(sqlops AS SMALLINT) AS sqlops,
       coalesce(is_deleted, false) AS is_deleted
  FROM (SELECT *, CASE WHEN coalesce(ref0, '') = '' THEN NULL ELSE trim(left(ref0, 1024)) END AS ref1
          FROM (SELECT *, replace(url_decode(referrer), '{HOME_URL}', '') AS ref0 FROM usage_raw) a) b
"""

USAGE_FLAGS = """
SELECT *, request_uri LIKE '%/api/%' AS is_api,
       NOT (request_uri LIKE '%/api/%') AND (request_uri LIKE '%/file/%' OR request_uri LIKE '%/files/%') AS is_file
  FROM usage_n0
"""


def usage_ctes() -> str:
    """``WITH usage_raw, usage_n0, usage`` — the normalised usage log."""
    return (with_fixtures("usage_raw")
            .rstrip("\n") + f",\nusage_n0 AS ({USAGE_NORM}),\nusage AS ({USAGE_FLAGS})\n")


def window_start(days: int) -> str:
    return f"strftime(DATE '{AS_OF_DATE}' - INTERVAL {days} DAY, '%Y-%m-%d')"


def encode_key_sql(n: str) -> str:
    """G4 encode written as DuckDB SQL (oracle side)."""
    from tessera.functions.keys import KEY_ALPHABETS

    off = f"(({n}) % 62)"
    high = f"(({n}) // 62)"
    parts = [f"substr('{KEY_ALPHABETS[0]}', CAST({off} + 1 AS INTEGER), 1)"]
    for pos in range(1, 6):
        digit = f"(({high} // {62 ** (5 - pos)}) % 62)"
        parts.append(f"substr('{KEY_ALPHABETS[pos]}', CAST((({digit} + {off}) % 62) + 1 AS INTEGER), 1)")
    return f"(CASE WHEN ({n}) > 0 THEN {' || '.join(parts)} ELSE '' END)"


LOCATION_DETAIL = """
SELECT lo.id AS location_id, lo.src, lo.name, CAST(lo.longitude AS DOUBLE) AS longitude,
       CAST(lo.latitude AS DOUBLE) AS latitude, lo.country_code, lo.state_id, lo.note_id, lo.created_by,
       lo.is_published, lo.is_visible,
       acct.display_name AS account_name, acct.first_name,
       co.name AS country_name, co.label AS country_label,
       cs.name AS state_name, cs.label AS state_label, cs.region_id, cr.name AS region_name,
       nn.type AS note_type, nn.is_private AS note_private,
       EXISTS (SELECT 1 FROM location_meta z WHERE NOT z.is_deleted AND z.location_id = lo.id) AS has_meta
  FROM account acct INNER JOIN location lo ON acct.id = lo.created_by
                    INNER JOIN country co ON lo.country_code = co.code
               LEFT OUTER JOIN state cs ON lo.state_id = cs.id AND NOT cs.is_deleted
               LEFT OUTER JOIN country_region cr ON cs.region_id = cr.id AND NOT cr.is_deleted
               LEFT OUTER JOIN note nn ON lo.note_id = nn.id AND NOT nn.is_deleted
 WHERE NOT acct.is_deleted AND NOT lo.is_deleted AND NOT co.is_deleted AND co.code = 'JP'
   AND lo.is_published AND lo.is_visible
"""

LOCATION_FIXTURES = ("location", "account", "country", "state", "country_region", "note", "location_meta")


# ---- text helpers as DuckDB SQL (oracle side) -------------------------------
def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x00\\x0B]+|[\\s\\x00\\x0B]+$', '', 'g')"


def no_null_sql(x: str) -> str:
    return strip_ws_sql(f"translate(coalesce({x}, ''), {q(chr(0xFF03) + chr(0xFE0F) + chr(0x3000))}, '#  ')")


def _re_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


def ireplace_sql(x: str, find: str, repl: str) -> str:
    return f"regexp_replace({x}, {q('(?i)' + _re_quote(find))}, {q(repl.replace(chr(92), chr(92) * 2))}, 'g')"


def strip_tags_sql(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def html_decode_sql(x: str) -> str:
    """Character references, named ones among those written out here."""
    names = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "nbsp": 160, "copy": 169, "reg": 174, "middot": 183, "eacute": 233,
             "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "ldquo": 8220, "rdquo": 8221, "hellip": 8230}
    known = "MAP {" + ", ".join(f"'{n}': chr({c})" for n, c in names.items()) + "}"
    ref = "regexp_extract(p, '^(#[0-9]+|[A-Za-z][A-Za-z0-9]*);', 1)"
    one = (f"CASE WHEN {ref} = '' THEN '&' || p WHEN {ref}[1] = '#' THEN chr(CAST({ref}[2:] AS INT)) || p[length({ref}) + 2:]"
           f" WHEN {known}[{ref}] IS NOT NULL THEN {known}[{ref}] || p[length({ref}) + 2:] ELSE '&' || p END")
    return f"substr(array_to_string(list_transform(string_split({x}, '&'), lambda p: {one}), ''), 2)"


def transliterate_sql(x: str) -> str:
    from tessera.functions.text import TRANSLIT_FROM, TRANSLIT_MULTI, TRANSLIT_TO

    x = f"translate({x}, {q(TRANSLIT_FROM)}, {q(TRANSLIT_TO)})"
    for a, b in TRANSLIT_MULTI:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def fullwidth_sql(x: str) -> str:
    src, dst = [], []
    for cp in range(0x21, 0x7F):
        if chr(cp) in "\"'\\~":
            continue
        src.append(chr(cp + 0xFEE0))
        dst.append(chr(cp))
    return f"translate({x}, {q(''.join(src) + chr(0x3000))}, {q(''.join(dst) + ' ')})"
