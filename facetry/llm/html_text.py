"""HTML extraction (operator 2): the maximum-scoring run of a page's tokens.

Words score positive and tags negative. The weights come from pages that mark their main content themselves (one
`article` or `main` element): a tag costs in proportion to how often it stands outside such content, a word gains by
how often its kind stands inside. Words in page furniture (menus, adverts, forms, comments ...) are a kind of their own.
One linear scan finds the contiguous region of the largest sum; its words outside furniture are the text.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept, small

#: Pages that the weights are fitted on, at most, and the most characters of one of them.
LABELLED, CHARACTERS = 1_000, 200_000

# Elements whose content is never shown, or is a control.
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "head", "title", "textarea", "select", "button", "object", "canvas", "math", "audio", "video"}
# Elements that hold page furniture; a header inside the main content belongs to it.
FURNITURE = {"nav", "footer", "aside", "form", "dialog", "menu", "header"}
# Words of a class, id or role that name page furniture.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "masthead",
    "toolbar", "comment", "comments", "reply", "replies", "respond", "disqus", "social", "share", "sharing", "related", "recommended", "recommendations", "newsletter",
    "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "copyright", "contentinfo", "complementary", "dialog", "form",
}
# Elements that hold inline text; all others end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MAIN = {"article", "main"}
# Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)")

#: Kinds of words: in running text, in a link, in furniture; on pages that mark their main content, those in it, those
#: outside it, and furniture in it.
PLAIN, LINK, AWAY, WITHIN, OUTSIDE, INNER = "plain", "link", "away", "within", "outside", "inner"
_MARK = re.compile(r"<(?:article|main)[\s>]", re.I)


def names_furniture(attributes: str) -> bool:
    """Whether a class, id or role names page furniture; `has-sidebar` and the like say something of the rest."""
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _WORD.findall(name)
            if parts and parts[0] not in ("has", "with", "no", "is", "not") and not NAMES.isdisjoint(parts):
                return True
    return False


def tokens(page: str, marked: bool):
    """(kind, value) of a page in order: ("tag" or, in furniture within the main content, "quiet", name) and (kind, raw
    text); hidden content is left out.

    Furniture lasts to the end tag of the element that opened it; a container that isn't closed, to the start of the
    page's main content. Comments and broken tags give nothing. With `marked`, main elements decide the kind of words.
    """
    at, away, depth, link, main, begun = 0, None, 0, False, 0, False
    end = len(page)

    def kind() -> str:
        if away:
            return INNER if marked and main else AWAY
        if marked:
            return WITHIN if main else OUTSIDE
        return LINK if link else PLAIN

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield kind(), page[at:]
            return
        if m.start() > at:
            yield kind(), page[at : m.start()]
        at = m.end()
        closing, name = bool(m[1]), m[2]
        attributes = m[3] or ""
        if name is None:
            # A comment, a declaration, or a tag whose quotes don't close.
            loose = _LOOSE.match(m[0])
            if m[0].startswith("<!") or loose is None:
                continue
            closing, name = m[0][1] == "/", loose[1]
        name = name.lower()
        if name in HIDDEN and not closing:
            if attributes.rstrip().endswith("/"):
                continue
            stop = _end_of(name).search(page, at)
            # Without an end tag a script hides the rest; other elements hide nothing.
            if stop:
                at = stop.end()
            elif name in ("script", "style", "title", "textarea"):
                return
            continue
        named = not closing and name not in ("html", "body") and name not in VOID and names_furniture(attributes)
        if name in MAIN and not named:
            if closing:
                main = max(0, main - (away != name))
            elif not begun and away and away not in FURNITURE:
                away = None
            if not closing and not away:
                main, begun = main + 1, True
        opens = not away and (named or not closing and name in FURNITURE and not (name == "header" and main))
        yield "quiet" if (away or opens) and marked and main else "tag", name
        if away:
            if name == away:
                depth += -1 if closing else 1
                if depth == 0:
                    away = None
        elif opens:
            away, depth = name, 1
        if name == "a":
            link = not closing


@functools.cache
def _end_of(name: str) -> re.Pattern:
    if name == "head":
        return re.compile(r"</head\s*>|(?=<body[\s>])|(?=<(?:article|main)[\s>])", re.I)
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def observed(page: str) -> Counter:
    """How often each kind of word and each tag stands inside (True) and outside the one main element of a labelled page.

    The kinds are those that a page without marks has: what is learned holds for such pages too.
    """
    out: Counter = Counter()
    inside = False
    for kind, value in tokens(page, False):
        if kind != "tag":
            out[kind, "", inside] += len(html.unescape(value).split())
        elif value in MAIN:
            inside = not inside
        else:
            out["tag", value, inside] += 1
    return out


#: Weights without labelled pages: words, and a tag in general.
DEFAULT = {("word", PLAIN): 1.0, ("word", LINK): -0.5, ("word", AWAY): -4.0, ("word", WITHIN): 1.0, ("word", OUTSIDE): -4.0, ("word", INNER): 0.0, ("tag", None): 0.5, **{("tag", t): 0.02 for t in ("p", "br", "b", "i", "em", "strong", "span", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main", "blockquote", "a")}}


def fit(counts: Counter) -> dict:
    """Weights from the counts of labelled pages: gains of words, costs of tags."""
    out = dict(DEFAULT)
    for kind in (PLAIN, LINK, AWAY):
        i, o = counts[kind, "", True], counts[kind, "", False]
        if i + o:
            out["word", kind] = max(-4.0, min(4.0, math.log((i + 1) / (o + 1))))
    out["word", PLAIN] = max(0.5, out["word", PLAIN])
    out["word", LINK] = min(0.5, out["word", LINK])
    out["word", AWAY] = min(-1.0, out["word", AWAY])
    for name in {n for k, n, _ in counts if k == "tag"} - MAIN:
        i, o = counts["tag", name, True], counts["tag", name, False]
        out["tag", name] = 2 * (o + 0.5) / (i + o + 1) if o else 0.01
    out["word", WITHIN], out["word", OUTSIDE], out["word", INNER] = max(1.0, out["word", PLAIN]), out["word", AWAY], 0.0
    return out


def extract(page: str | None, weights: dict | None = None) -> str:
    """The main text of a page: blocks joined by one space; empty for a null page or one without words of its own."""
    if not page:
        return ""
    weights = weights or DEFAULT
    return (_region(page, weights, True) if _MARK.search(page) else "") or _region(page, weights, False)


def _region(page: str, weights: dict, marked: bool) -> str:
    """The text of the best region of a page by one scan: the sum starts anew wherever it isn't above zero."""
    other = weights["tag", None]
    stream = list(tokens(page, marked))
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    texts: dict[int, str] = {}
    for i, (kind, value) in enumerate(stream):
        if kind == "tag":
            total -= weights.get(("tag", value), other)
        elif kind != "quiet":
            texts[i] = text = html.unescape(value)
            n = len(text.split())
            if not n:
                continue
            total += n * weights["word", kind]
            if total > best:
                best, best_at = total, (start, i + 1)
        if total <= 0:
            total, start = 0.0, i + 1
    parts = []
    for i in range(*best_at):
        kind, value = stream[i]
        if kind in ("tag", "quiet"):
            if value not in INLINE:
                parts.append(" ")
        elif kind not in (AWAY, INNER, OUTSIDE):
            parts.append(texts[i])
    return " ".join("".join(parts).split())


def learned(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict:
    """fit() on a bounded sample of pages: of those with exactly one main element, LABELLED with the least hashes of their id."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 24).cast("double") / float(1 << 40)
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), hashed.alias("draw"))
    marks = F.size(F.split(F.lower("html"), r"<(?:article|main)[\s>]")) - 1
    share = 4 * LABELLED / max(1, rows.count())
    while True:
        # Only hashes below a threshold are looked at, and only those go to the task that orders them.
        some = rows.where((F.col("draw") < share) & (F.length("html") <= CHARACTERS) & (marks == 1))
        if share >= 1 or some.count() >= LABELLED:
            break
        share *= 8
    some = some.orderBy("draw", "id").limit(LABELLED).select("html")
    schema = pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])

    def count(batches):
        for b in small(batches):
            c = sum((observed(x) for x in b.column(0).to_pylist()), Counter())
            yield pa.record_batch([pa.array([f(k, n) for k, n in c.items()], t.type) for f, t in zip((lambda k, n: k[0], lambda k, n: k[1], lambda k, n: k[2], lambda k, n: n), schema)], schema=schema)

    # Distinct tag names of a bounded sample.
    found = some.mapInArrow(count, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    return fit(Counter({(r["kind"], r["name"], r["inside"]): r["n"] for r in found}))


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", weights: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html; a null html is empty.

    Rows are independent: repeated and null ids stay rows of their own, and other columns are not read. Equal sums go to
    the region that ends first.
    """
    weights = weights or learned(pages, id_col, html_col)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        kept("html_text")
        for b in small(batches):
            found = [extract(x, weights) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
