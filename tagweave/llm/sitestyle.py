"""Main text of pages with a site style tree.

The element trees of a host's pages are merged: an element of the tree is a path of
block elements (tag and classes), and it holds, over the host's pages, the different
sequences of children seen there (its styles) and the different texts seen below it.
Importance follows the entropies of both:

* presentation: ``-sum p log_m p`` over the styles of an element, ``m`` pages; an
  element that looks the same on every page scores 0;
* content: ``1 - mean H`` over the texts below it, where a text that is on n of m pages
  has ``H = log_m n``; text that recurs on every page scores 0;
* composite: ``(1 - g^l) presentation + g^l content`` for ``l`` styles, g = 0.9; an
  element counts as its content does where that is more, so that many pages of one
  layout cost its text nothing.

Branches below a bar are removed from each page of hosts with enough pages to tell. An
``article`` or ``main`` raises what is in it and lowers what is beside it: branches in
it, where each distinct article of a host counts once, go below ``INSIDE``; branches
beside it need ``BESIDE``; a page without one has ``THRESHOLD``. On hosts with too few
pages the article is the text, unless more text lies beside it than in it: then both
are. Elements that say what they are (navigation, footers, forms, scripts, ...; by tag
or role) are removed on every page, and so are those whose class or id is the name of
furniture or, outside an article, begins with one. A name never removes an article, what
holds one, a heading or a paragraph; where a name only has such a word in it, the tree
decides, by the bar ``BESIDE``.

Counting is a pair of map-side aggregations on (host, path, value); pages are parsed in
their tasks and never gathered per host. The list of removed branches is joined to the
pages of its host (broadcast by Spark when small, split when skewed).

Defined results: null or empty html gives an empty text; broken markup is read as far as
it goes (an unfinished tag at the end is dropped, unclosed elements end with their
parent); a null or unparseable URL belongs to no host; pages that repeat are each
answered and count once for their host; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages
from .urlfilter import url_host

#: Importance below which a branch goes, and pages (or distinct articles) a host needs for it.
THRESHOLD, PAGES, DECAY = 0.3, 8, 0.9
#: The same in an article or main element, and beside one.
INSIDE, BESIDE = 0.15, 0.6

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose start ends an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "menu", "table", "dl", "select", "article", "main", "section", "aside", "nav", "body", "td", "th"}
#: Elements that are no text of the page.
NOISE_TAGS = set("head nav footer aside form script style noscript template button select textarea option iframe noembed noframes svg math object canvas audio video dialog menu search title datalist".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words in a class or id that name something other than the article.
NOISE_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion
nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars aside widget widgets
footer footnav masthead cookie cookies consent gdpr notice notices banner banners popup modal overlay alert
newsletter subscribe signup login comment comments commentlist disqus respond reply replies
share sharing social related recommended""".split())
#: These name page furniture only outside an article.
OUTER_NAMES = {"header", "topbar"}
#: These name boxes of real text inside one.
BOX_NAMES = {"alert", "notice", "notices"}
#: Text in itself, whatever its name; and elements whose id is an anchor.
TEXT_TAGS, ANCHORED = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "html", "body"}, {"section"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)
|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SAYS = re.compile(r"class|id|role", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Element:
    """``hard`` says noise by its tag or role, ``named`` noise by name unless it turns out
    to hold an article; ``noise`` is known when the page has been read."""

    __slots__ = ("tag", "path", "hard", "named", "main", "block", "above", "children", "holds", "noise")

    def __init__(self, tag, path, hard, named, main, block, above):
        self.tag, self.path, self.hard, self.named, self.main, self.block, self.above = tag, path, hard, named, main, block, above
        self.children, self.holds, self.noise = [], False, False


def _names(attributes: str) -> tuple[list[str], list[tuple[str, list[str]]], set[str]]:
    """Classes, the words of each class and id with its kind, and roles."""
    classes, names, roles = [], [], set()
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        kind = kind.lower()
        if kind == "role":
            roles |= set(value.lower().split())
            continue
        if kind == "class":
            classes += value.split()
        names += [(kind, words) for name in value.split() if (words := _NAME.findall(_CAMEL.sub("-", name).lower()))]
    return sorted(re.sub(r"\d+", "", c) for c in classes), names, roles


def _furniture(tag: str, names: list[tuple[str, list[str]]], inside: bool) -> tuple[bool, bool]:
    """Whether names make an element noise, and whether they leave it to the style tree."""
    strong = doubt = False
    for kind, words in names:
        said = [w in NOISE_NAMES or not inside and w in OUTER_NAMES for w in words]
        doubt |= any(said)
        if tag not in TEXT_TAGS and not (kind == "id" and tag in ANCHORED):
            strong |= all(said) and not BOX_NAMES.issuperset(words) if inside else said[0]
    return strong, doubt and not strong and tag not in ("html", "body")


def parse(html: str | None) -> tuple[list[tuple], list[tuple]]:
    """``(blocks, styles)`` of a page. A block is ``(path, noise, main, text)`` in page
    order: the text between two block boundaries, references decoded, white space
    single; ``path`` its ancestors, outermost first; ``main`` how many of them reach to
    the outermost article or main element, 0 without one. A style is ``(path, main, children)``."""
    html = html or ""
    root = _Element("", (), False, False, 0, True, None)
    stack, elements, blocks, styles, text = [root], [], [], [], []

    def flush():
        if text:
            clean = " ".join("".join(text).split())
            text.clear()
            if clean:
                owner = next(e for e in reversed(stack) if e.block)
                owner.children.append("#text")
                blocks.append((owner, stack[-1], clean))

    def pop():
        gone = stack[-1]
        if gone.block or gone.hard or gone.named:
            flush()
        stack.pop()
        if gone.block:
            styles.append(gone)

    def close(tag, scope):
        """Close the innermost open ``tag`` unless an element of ``scope`` is in between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in scope:
                return

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text.append(htmllib.unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if m[1]:
            name = m[1].lower()
            if name == "p" and not any(e.tag == "p" for e in stack):
                flush()
            elif name == "br":
                text.append(" ")
            else:
                close(name, {e.tag for e in stack if e.block} - {name} if name in INLINE else {"body"} if name not in ("body", "html") else set())
            continue
        if not tag or (m[4] and not m[0].endswith(">")):
            continue
        attributes = m[3] or m[5] or ""
        if tag in VOID:
            if tag == "hr":
                close("p", SCOPES)
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "body" and any(e.tag == "body" for e in stack) or tag == "html" and len(stack) > 1:
            continue
        if tag == "body":
            while stack[-1].tag == "head" or stack[-1].tag in NOISE_TAGS:
                pop()
        if tag in ENDS_P:
            close("p", SCOPES)
        for sibling in SIBLINGS.get(tag, ()):
            close(sibling, SCOPES - {sibling, "body"} if tag not in ("td", "th", "tr") else {"table", "body"} if tag != "td" and tag != "th" else {"table", "tr", "body"})
        classes, names, roles = _names(attributes) if _SAYS.search(attributes) else ([], [], set())
        above = stack[-1]
        article = tag in ("article", "main") or "main" in roles or "article" in roles
        block = article or tag not in INLINE
        hard = tag in NOISE_TAGS or bool(roles & NOISE_ROLES) or tag == "header" and not above.main
        named, doubt = _furniture(tag, names, above.main > 0) if names and not article else (False, False)
        if article:
            e = above
            while e and not e.holds:
                e.holds, e = True, e.above
        # What follows a blank cannot be part of a class.
        step = tag + "".join("." + c for c in classes) + (" main" if article else " ?" if doubt else "")
        main = above.main or (len(above.path) + 1 if article else 0)
        if block or hard or named:
            flush()
        element = _Element(tag, (*above.path, step) if block else above.path, hard, named, main, block, above)
        elements.append(element)
        if block:
            next(e for e in reversed(stack) if e.block).children.append(step)
        stack.append(element)
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = closing.start() if closing else end
            if tag not in NOISE_TAGS and closing:
                text.append(htmllib.unescape(html[m.end():at]))
    flush()
    while len(stack) > 1:
        pop()
    for e in elements:
        e.noise = e.above.noise or e.hard or e.named and not e.holds
    return ([(owner.path, e.noise, e.main, clean) for owner, e, clean in blocks],
            [(e.path, e.main, tuple(e.children)) for e in styles if not e.noise])


def path_key(path: tuple) -> int:
    return xxhash.xxh3_64_intdigest("/".join(path).encode("utf-8", "surrogatepass")) - 2**63


def _hash(value) -> int:
    return xxhash.xxh3_64_intdigest(str(value).encode("utf-8", "surrogatepass")) - 2**63


def main_text(blocks: list[tuple], importance: dict[int, float] | None = None, threshold: float = THRESHOLD) -> str:
    """The text of a parsed page without noise and without branches that ``importance``,
    by path, puts below their bar; ``None`` for a host that cannot tell."""
    kept = [b for b in blocks if not b[1]]
    known = importance or {}

    def stays(path, least, start=1):
        return not known or all(known.get(path_key(path[:i]), 1.0) >= (BESIDE if path[i - 1].endswith(" ?") else least) for i in range(start, len(path) + 1))

    inside = [b[2] > 0 and stays(b[0], INSIDE, b[2]) for b in kept]
    if importance is None and any(inside):
        beside = sum(len(b[3]) for b in kept if not b[2]) > sum(len(b[3]) for b in kept if b[2])
        return "\n".join(b[3] for b in kept if b[2] or beside)
    least = BESIDE if any(inside) else threshold
    return "\n".join(b[3] for b, own in zip(kept, inside) if own or not b[2] and stays(b[0], least))


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page and element: its style (kind 0) and the texts below it (kind 1), each
    value once; an article is one text of what it is in. Elements of an article are
    told of the article, by a hash of its texts, not of the page. Path 0 with kind 2
    counts pages and articles."""
    for rows in batches:
        out = []
        for host, h1, html in zip(rows["host"], rows["h1"], rows["html"]):
            blocks, styles = parse(html)
            blocks = [b for b in blocks if not b[1]]
            own = [b[3] for b in blocks if b[2]]
            article = _hash("\n".join(own)) if own else None
            seen = {(h1, False, 0, 2, 0)}
            if own:
                seen.add((article, True, 0, 2, 0))
            for path, main, children in styles:
                if path and path[-1] not in ("html", "body") and (own or not main):
                    seen.add((article if main else h1, main > 0, path_key(path), 0, _hash(children)))
            keys: dict = {}
            for path, _, main, text in blocks:
                if path not in keys:
                    keys[path] = [(main > 0 and i + 1 >= main, path_key(path[: i + 1])) for i in range(len(path)) if path[i] not in ("html", "body")]
                value = _hash(text)
                for within, key in keys[path]:
                    seen.add((article, True, key, 1, value) if within else (h1, False, key, 1, article if main else value))
            out += [(host, *s) for s in seen]
        yield pd.DataFrame(out, columns=["host", "id", "main", "path", "kind", "value"])


def style_tree(pages: DataFrame, stages: Stages) -> DataFrame:
    """``pages(host, h1, html)`` -> ``(host, main, path, pages, presentation, content,
    importance)``; where ``main``, pages are the host's distinct articles."""
    told = pages.where("host <> ''").mapInPandas(_observe, "host string, id bigint, main boolean, path bigint, kind int, value bigint")
    n = told.distinct().groupBy("host", "main", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    logs = n.groupBy("host", "main", "path").agg(
        *[F.sum(F.when(F.col("kind") == k, e)).alias(name + str(k)) for k in (0, 1) for name, e in
          (("total", F.col("n")), ("nlogn", F.col("n") * F.log("n")), ("values", F.lit(1)), ("logn", F.log(F.col("n").cast("double"))))],
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("pages"))
    logs = stages.write(logs, "logs")
    m = logs.where("pages is not null").select("host", "main", "pages")
    logs = logs.where("pages is null").drop("pages")
    unit = F.log(F.col("pages").cast("double"))
    presentation = F.when(F.col("pages") > 1, (F.log(F.col("total0")) - F.col("nlogn0") / F.col("total0")) / unit).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.col("logn1") / F.col("values1") / unit).otherwise(1.0)
    styles = F.pow(F.lit(DECAY), F.coalesce("values0", F.lit(1)))
    composite = (1 - F.col("decay")) * F.col("presentation") + F.col("decay") * F.coalesce("content", F.lit(1.0))
    return (logs.join(m, ["host", "main"]).select("host", "main", "path", "pages", F.coalesce(presentation, F.lit(0.0)).alias("presentation"), content.alias("content"), styles.alias("decay"))
            .withColumn("importance", F.greatest(composite, "content")).drop("decay"))


def _extract(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    sets: dict = {}
    for batch in batches:
        texts = []
        for host, html, low in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "low"))):
            if host not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[host] = None if low is None else {e["path"]: e["importance"] for e in low}
            texts.append(main_text(parse(html)[0], sets[host], threshold))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(spark: SparkSession, pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = PAGES) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text)`` per row."""
    stages = Stages(spark, "sitestyle")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
                        F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"))
    tree = style_tree(rows.select("host", F.xxhash64("html").alias("h1"), "html"), stages).where(F.col("pages") >= least_pages)
    # Hosts that can tell have a list, if an empty one, of their branches below some bar.
    low = tree.groupBy("host").agg(F.collect_list(F.when(F.col("importance") < max(BESIDE, threshold), F.struct("path", "importance"))).alias("low"))
    low = stages.write(low, "low")
    return (rows.join(low, "host", "left").select("page_id", "url", "html", "host", "low")
            .mapInArrow(lambda batches: _extract(batches, threshold), "page_id bigint, url string, text string"))
