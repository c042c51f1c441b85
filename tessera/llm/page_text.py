"""Main text of web pages (operator 6).

A page is cut into elements; every element's subtree (tags and words) has a
hash, and the different pages of a host that hold it are counted in Spark:
copies of a page count as one, and no subtree that holds the page's body or an
article is counted.  A subtree
that recurs on many pages of its host is part of the site's template and goes,
as do elements whose tag, role or class says that they are no main text.  What
is left is the article (or main) element where there is one, else the body.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A subtree recurs if at least MIN_PAGES pages of the host hold it and they are
#: this share of the host's pages: less is asked for outside the main element.
MIN_PAGES, SHARE_OUTSIDE, SHARE_INSIDE = 5, 0.2, 0.5
#: Places over which the pages of one host are spread.
SALTS = 32
#: Elements that are never main text, whatever is in them.
DROPPED = frozenset("nav footer aside select option textarea input menu audio video canvas map".split())
#: Elements that go as well, unless they are wrapped around an article, main or
#: h1 from outside the main element (some sites put the whole page into a form).
WRAPPERS = frozenset("form button label fieldset dialog object".split())
#: Elements whose content is not text at all.
_RAW = "script|style|noscript|template|title|iframe|svg|math|xmp|noembed|noframes|textarea"
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: A subtree with one of these is never template as a whole.
_WHOLE = frozenset("html body main article".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class or id, and roles, of what surrounds an article.
MARKS = frozenset("""ad ads alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion
replies reply respond responses share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
#: "related" marks a list of links, not a section on related matters.
_RELATED = frozenset("related posts post articles article stories links content items reading news box list block widget".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert banner complementary contentinfo menu menubar navigation".split())
#: Roles that go like WRAPPERS.
WRAPPER_ROLES = frozenset("dialog form search toolbar".split())
#: An open element that a start tag of the group closes, up to the named borders.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?/>"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Parts of a name that say only how or where a thing is set; the part before is its head.
_SETTING = frozenset("area block box container inner item items left link links list outer right section top bottom".split())
#: A name with one of these tells the state of what holds it.
_STATE = frozenset("has is no not with without".split())
#: An element with one of these is no mark's, whatever its class or id, and no wrapper's.
_KEPT = frozenset("article main h1".split())


def _is_dropped(tag: str, attrs: str, in_main: bool) -> bool:
    """By its tag, role or state, whatever it holds."""
    if tag in DROPPED or (tag in WRAPPERS and in_main) or (tag == "header" and not in_main):
        return True
    if attrs and not attrs.isspace() and tag not in ("html", "body", "article", "main") and tag not in _HEADINGS:
        for name, a, b, c in _ATTR.findall(attrs):
            value = (a or b or c).lower()
            name = name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "role" and (value in ROLES or (in_main and value in WRAPPER_ROLES))):
                return True
    elif tag == "article" and attrs and any({"comment", "comments", "reply"} & set(_PART.findall((a or b or c).lower())) for _, a, b, c in _ATTR.findall(attrs)):
        return True
    return False


def _is_marked(tag: str, attrs: str, in_main: bool) -> bool:
    """As a wrapper by its tag or role, or by a class or id that is a word of
    MARKS or has it as its head: the last part of the name that says more than
    how a thing is set."""
    if tag in WRAPPERS:
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body", "article", "main") or tag in _HEADINGS:
        return False
    for kind, a, b, c in _ATTR.findall(attrs):
        if kind.lower() == "role" and (a or b or c).lower() in WRAPPER_ROLES:
            return True
        if kind.lower() in ("class", "id"):
            for name in (a or b or c).split():
                parts = [x.lower() for x in _NAME_PART.findall(name)]
                if not parts or not _STATE.isdisjoint(parts):
                    continue
                if "related" in parts and len(parts) > 1 and set(parts) <= _RELATED:
                    return True
                while len(parts) > 1 and parts[-1] in _SETTING:
                    parts.pop()
                if parts[-1] in MARKS or (not in_main and parts[-1] == "header"):
                    return True
    return False


class Page:
    """Blocks of text of a page, and the subtrees of its block elements.

    ``blocks``: (text, inside article, inside main element);
    ``trees``: (hash, first block, block after the last, inside main) of every
    block element with text that holds no html, body, main or article."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.trees: list[tuple[int, int, int, bool]] = []
        self._text: list[tuple[str, int]] = []  # with the innermost marked element, 0 for none
        self._held: list[list[tuple[str, int]]] = []  # the same, by block
        self._marked, self._around, self._gone = 0, [0], set()  # by marked element: the one around it; those that go
        self._stack: list[list] = []  # [tag, parts to hash, first block, drops, article, main, holds one of _WHOLE, marked element around, is or holds one of _KEPT]
        self._drops = self._articles = self._mains = 0
        at = 0
        html = html or ""
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._add(html[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(tag)
            else:
                self._open(tag, m["attrs"])
        if at < len(html):
            self._add(html[at:])
        while self._stack:
            self._pop()
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """Take the text of the marked elements that go out of the blocks."""
        blocks, at = [], [0]
        gone = [False] * len(self._around)
        for k in range(1, len(gone)):
            gone[k] = k in self._gone or gone[self._around[k]]
        for held, (_, article, main) in zip(self._held, self.blocks, strict=True):
            text = " ".join(unescape("".join(x for x, marked in held if not gone[marked])).split())
            if text:
                blocks.append((text, article, main))
            at.append(len(blocks))
        self.blocks = blocks
        self.trees = [(h, at[first], at[last], inside) for h, first, last, inside in self.trees]

    def _add(self, text: str) -> None:
        if not self._drops:
            self._text.append((text, self._marked))
        if self._stack:
            self._stack[-1][1].append(text)

    def _flush(self) -> None:
        if self._text:
            if any(x and not x.isspace() for x, _ in self._text):
                self.blocks.append(("", self._articles > 0, self._mains > 0))
                self._held.append(self._text)
            self._text = []

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
            if any(f[0] == "p" for f in self._stack[-4:]):
                self._close_until({"p"}, {"button", "table"})
        if tag in _ENDS:
            for _ in range(3):
                if not self._close_until(*_ENDS[tag]):
                    break
        if tag in VOID:
            if tag in ("br", "hr"):
                self._add(" ")
            return
        inside = self._articles > 0 or self._mains > 0
        drops = _is_dropped(tag, attrs, inside)
        article, main = tag == "article" and not drops, tag == "main" and not drops
        self._stack.append([tag, [f"<{tag}>"], len(self.blocks), drops, article, main, tag in _WHOLE, self._marked, tag in _KEPT and not drops and not self._drops])
        if not drops and _is_marked(tag, attrs, inside):
            self._around.append(self._marked)
            self._marked = len(self._around) - 1
        self._drops += drops
        self._articles += article
        self._mains += main

    def _close_until(self, tags: set[str], borders: set[str]) -> bool:
        """Close the nearest open element of ``tags``, if it lies within the
        nearest border."""
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in tags:
                while len(self._stack) > k:
                    self._pop()
                return True
            if self._stack[k][0] in borders or self._stack[k][0] in ("article", "main", "body", "section", "div"):
                return False
        return False

    def _close(self, tag: str) -> None:
        if any(f[0] == tag for f in self._stack):
            if tag in BLOCK:
                self._flush()
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, parts, first, drops, article, main, whole, marked, kept = self._stack[-1]
        if tag in BLOCK:
            self._flush()
        self._stack.pop()
        inside = self._articles > 0 or self._mains > 0
        if self._marked != marked:
            if not kept:
                self._gone.add(self._marked)
            self._marked = marked
        self._drops -= drops
        self._articles -= article
        self._mains -= main
        text = " ".join("".join(parts).split())
        if tag in BLOCK:
            h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
            h -= (h >> 63) << 64
            if not whole and (len(self.blocks) > first or drops):
                self.trees.append((h, first, len(self.blocks), inside))
            text = f"<{h}>"
        if self._stack:
            self._stack[-1][1].append(text)
            self._stack[-1][6] |= whole
            self._stack[-1][8] |= kept
        return tag

    def main_text(self, template: set[int]) -> list[str]:
        """Blocks left when the subtrees with a hash in ``template`` go."""
        gone = bytearray(len(self.blocks))
        for h, first, last, _ in self.trees:
            if h in template:
                gone[first:last] = b"\x01" * (last - first)
        where = 1 if any(b[1] for b in self.blocks) else 2 if any(b[2] for b in self.blocks) else None
        return [b[0] for k, b in enumerate(self.blocks) if not gone[k] and (where is None or b[where])]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns one row per input row: the id, the url and ``text``: blocks in page
    order joined by one newline, character references decoded, white space in a
    block turned into one space.  Whole pages are read, truncated or malformed
    as they may be; text in no dropped element is kept.

    A null or empty page gives an empty text; a page whose url is null or has
    no host shares the template of such pages; copies of a page on a host,
    repeated rows among them, count as one page and give equal texts; a null id stays null; other columns are not read.  An
    empty table gives no rows.  A host's template is at most a few times the
    subtrees of a page, since each of them is on a fixed share of its pages."""
    id_type = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.withColumn("host", host).withColumn("page", F.xxhash64("html"))

    def trees(batches):
        for pdf in batches:
            out = []
            for h, page, html in zip(pdf["host"], pdf["page"], pdf["html"], strict=True):
                seen: tuple[dict, dict] = {}, {}
                for t, _, _, inside in Page(html).trees:
                    seen[inside][t] = None
                out.append((h, page, list(seen[0]), [t for t in seen[1] if t not in seen[0]]))
            yield pd.DataFrame(out, columns=["host", "page", "outer", "inner"])

    held = rows.select("host", "page", "html").mapInPandas(trees, StructType([
        StructField("host", StringType()), StructField("page", LongType()), StructField("outer", ArrayType(LongType())), StructField("inner", ArrayType(LongType()))]))
    # one row a different page, whatever its copies
    held = held.groupBy("host", "page").agg(F.first("outer").alias("outer"), F.first("inner").alias("inner"))
    held = held.select("host", F.explode(F.array(F.struct(F.col("outer").alias("trees"), F.lit(False).alias("inside")),
                                                 F.struct(F.col("inner").alias("trees"), F.lit(True).alias("inside")))).alias("x"))
    held = held.select("host", F.col("x.inside").alias("inside"), F.explode("x.trees").alias("tree"))
    held = held.groupBy("host", "tree").agg(F.count("*").alias("n"), F.min("inside").alias("inside")).where(F.col("n") >= MIN_PAGES)
    n_pages = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    share = F.when(F.col("inside"), SHARE_INSIDE).otherwise(SHARE_OUTSIDE)
    template = (held.join(n_pages, "host").where(F.col("n") >= share * F.col("pages"))
                .groupBy("host").agg(F.collect_list("tree").alias("template")))

    def texts(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": [
                "\n".join(Page(html).main_text(set() if gone is None else set(gone))) for html, gone in zip(pdf["html"], pdf["template"], strict=True)]})

    # a host's template, small as it is, goes to SALTS places, so that a host with many pages is no single task's
    template = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    out = rows.join(template, ["host", "salt"], "left").mapInPandas(texts, "id string, url string, text string")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("url").alias(url_col), "text")


def op6_page_text(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over whole `pages`."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
