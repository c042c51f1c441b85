"""Column-level text helpers shared by the text jobs.

All helpers are built-in Spark expressions (regexp_replace, translate,
split, transform/filter/aggregate on arrays), so they run inside the JVM
and, except for the higher-order array functions, inside generated code.
Regular expressions use ASCII classes and no look-around so that Java's
engine and RE2 (the oracle's) agree.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# E-mail shape: local part of the usual allowed characters, '@', then at
# least two dot-separated DNS labels.
EMAIL_PATTERN = (r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
                 r"(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$")

WS = r"[ \t\n\r\x0B\f]"  # the whitespace a PHP-style trim removes (plus NUL handled separately)


def valid_email(c: Column) -> Column:
    """E-mail shape check (NULL → false)."""
    return F.coalesce(c.rlike(EMAIL_PATTERN), F.lit(False))


# characters a PHP-style trim removes: space, tab, LF, CR, VT, FF and NUL
TRIM_CHARS = " \t\n\r\x0b\x0c\x00"


def strip_ws(c: Column) -> Column:
    """Trim spaces, tabs, new lines and NULs at both ends (a plain
    character-set trim, no regular expression)."""
    return F.trim(c, F.lit(TRIM_CHARS))


def no_null(c: Column) -> Column:
    """NULL → '', full-width '#' → '#', variation selector and ideographic
    space → ' ', then trimmed (the request-helper convention)."""
    c = F.translate(F.coalesce(c, F.lit("")), "＃\ufe0f\u3000", "#  ")
    return strip_ws(c)


def ireplace(c: Column, find: str, repl: str) -> Column:
    """Case-insensitive literal replace of every occurrence."""
    return F.regexp_replace(c, "(?i)" + _quote(find), _quote_repl(repl))


def ireplace_any(c: Column, finds: list[str], repl: str) -> Column:
    """Case-insensitive replace of any of ``finds`` in one pass.  Equal to
    replacing them one after another when no replacement can create or
    break another find (callers only merge such groups)."""
    return F.regexp_replace(c, "(?i)" + "|".join(_quote(f) for f in finds), _quote_repl(repl))


def _quote(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch)
    return "".join(out)


def _quote_repl(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def strip_tags(c: Column) -> Column:
    """Remove HTML tags (anything from '<' to the next '>')."""
    return F.regexp_replace(c, r"<[^>]*>", "")


def _entity_table(names: dict[str, str]) -> str:
    """One literal that a name is looked up in by position: every name between
    \\x01 and \\x02, its text behind."""
    return "\x01" + "\x01".join(f"{n}\x02{t}" for n, t in sorted(names.items())) + "\x01"


#: Named entities, from Python's public tables: HTML 4.01, and HTML 5 names that
#: end with a semicolon.
_ENTITIES = {
    4: _entity_table({n: chr(c) for n, c in html.entities.name2codepoint.items()}),
    5: _entity_table({n[:-1]: t for n, t in html.entities.html5.items() if n.endswith(";")}),
}
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def html_decode(c: Column, version: int = 4) -> Column:
    """Decode HTML character references, named (HTML 4.01 or 5) and numeric,
    each once ('&amp;lt;' → '&lt;'); unknown names and code points that are no
    text stay as they are.

    The text is cut at '&' once; each piece starts with its reference, if any,
    which is looked up in one literal."""
    table = F.lit(_ENTITIES[version])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        rest = F.substr(piece, F.length(name) + 2)
        is_hex = F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x"
        code = F.when(is_hex, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("int")
        is_text = code.isin(9, 10, 13) | code.between(32, 126) | code.between(160, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        by_code = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        at = F.call_function("locate", F.concat(F.lit("\x01"), name, F.lit("\x02")), table)
        by_name = F.substring_index(F.substr(table, at + F.length(name) + 2, F.lit(8)), "\x01", 1)
        return (F.when(name == "", F.concat(F.lit("&"), piece))
                .when(F.left(name, F.lit(1)) == "#", F.when(is_text, F.concat(by_code, rest)).otherwise(F.concat(F.lit("&"), piece)))
                .when(at > 0, F.concat(by_name, rest)).otherwise(F.concat(F.lit("&"), piece)))

    pieces = F.split(c, "&")
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), "")


# Characters folded for slugs (accented Latin letters to
# ASCII), given as parallel strings, plus multi-letter folds.
TRANSLIT_FROM = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿ"
TRANSLIT_TO = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyy"
TRANSLIT_MULTI = [("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")]


def transliterate(c: Column) -> Column:
    c = F.translate(c, TRANSLIT_FROM, TRANSLIT_TO)
    for a, b in TRANSLIT_MULTI:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fullwidth_to_ascii(c: Column) -> Column:
    """Full-width ASCII variants (U+FF01..U+FF5E) → ASCII, except the
    full-width quote, apostrophe, backslash and tilde; ideographic space
    becomes a space."""
    src, dst = [], []
    for cp in range(0x21, 0x7F):
        if chr(cp) in "\"'\\~":
            continue
        src.append(chr(cp + 0xFEE0))
        dst.append(chr(cp))
    return F.translate(c, "".join(src) + "　", "".join(dst) + " ")


def indexed(arr: Column, pos: str = "pos", value: str = "word") -> Column:
    """Generator of (position, element) rows of an array.  Written as
    ``inline(transform(arr, (x, i) -> struct(i, x)))``, which measured
    about twice as fast as ``posexplode`` over arrays built by lambdas."""
    return F.inline(F.transform(arr, lambda x, i: F.struct(i.alias(pos), x.alias(value))))
