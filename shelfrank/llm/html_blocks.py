"""Main text of raw web pages by rules on blocks, in two passes.

A page is cut into blocks at its block elements. What stands in elements that are never part
of an article (menus, footers, sidebars, forms, adverts, notices, reader comments, scripts, by
tag, role, class or id) gives no block. In the first pass stop-word density, length and link
density decide a block: running text is good, lists of links and long strings without stop words
are bad, and short or mixed blocks stay open. In the second pass an open block inherits the label
of the nearest decided block of its region. Where a page marks its article (``article``, else ``main``),
the regions are inside and outside: outside is bad, and inside only menus are decided bad, as nothing else
of an article may go.
"""

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfrank.llm.common import pick, ship, utf8

# HTML's element classes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
NEVER = frozenset("aside audio button canvas datalist dialog footer form head label menu nav object optgroup option search select svg template video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# A start tag ends the open element of the first set, unless one of the second set is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
# Words in a class or id that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adsense adv advert advertisement advertisements adverts aside banner breadcrumb breadcrumbs captcha colophon comment commentlist comments "
    "consent cookie cookies disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification notifications "
    "overlay pager pagination paywall popup promo promoted promotion recommendations recommended related replies reply respond search share sharebar sharing sidebar signin "
    "signup skip social sponsor sponsored subscribe subscription toast toolbar topbar trending widget widgets".split()
)
# These mark a page's header only outside an article, where they hold its title inside.
HEADS = frozenset({"header", "hero"})
# Classes that say what a page has, not what an element is.
SAYS = re.compile(r"(?:has|no|not|with|without|is|hide)-", re.I)
STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how if in into is it its more not of on one or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et être ils il je la le les leur leurs lui mais ne nous on ont ou où par pas plus pour qu que qui sa sans se ses son sont sur un une vous",
    "de": "aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist kann man mit nach nicht noch nur oder sein sich sie sind über um und uns von vor war was wenn werden wie wir wird zu zum zur",
    "es": "a al ante como con cuando de del desde donde el ella ellos en entre era es esta este fue ha hasta la las le les lo los más mi muy no nos o para pero por que quien se ser si sin sobre son su sus también un una uno y ya",
}
STOP = {language: frozenset(words.split()) for language, words in STOP_WORDS.items()}

# Lengths in characters, densities in shares of words, links in shares of characters.
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.15, 0.3
MOST_LINKS = 0.5
GOOD, BAD, OPEN = 1, -1, 0

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>)""", re.S)
# After a quote without its partner, tags end at the next sign.
_PLAIN_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
_OPENS = re.compile(r"<(?=[/!?a-zA-Z])")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


def marked(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag, role, class or id says it is no part of an article."""
    if name in NEVER or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main") or "=" not in attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
            continue
        for one in value.split():
            if SAYS.match(one):
                continue
            parts = {p.lower() for p in _PARTS.findall(one)}
            # An article is told by what it is called as a whole: "comment", not "post comments-open".
            known = parts if name != "article" else parts & {"comment", "reply", "ad", "advert", "sponsored", "promo", "related"} if len(parts) == 1 else set()
            if known & MARKS or (not in_article and known & HEADS):
                return True
    return False


def tags(page: str):
    """(text before, slash, name, attributes) of each tag in order; comments have no name; last the text behind, without a tag."""
    at, behind, pattern = 0, 0, _TAG
    while found := _OPENS.search(page, at):
        match = pattern.match(page, found.start())
        if not match and pattern is _TAG and (match := _PLAIN_TAG.match(page, found.start())):
            pattern = _PLAIN_TAG
        if not match:
            at = found.end()
            # No later tag can be closed either.
            if page.find(">", at) < 0:
                break
            continue
        name = (match[2] or "").lower()
        yield page[behind : match.start()], match[1], name, match[3] or ""
        at = behind = match.end()
        if name in RAW and not match[1]:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = behind = end.start() if end else len(page)
    yield page[behind:], "", "", None


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, share of link characters, in an article, in main, in a list) of each block outside marked elements."""
    stack, open_, out = [], {}, []
    parts, linked, plain = [], 0, 0
    dropped = articles = mains = lists = 0
    in_link = False

    def flush():
        nonlocal linked, plain
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, linked / max(1, plain), articles > 0, mains > 0, lists > 0))
        parts.clear()
        linked = plain = 0

    def close(name):
        """Ends the innermost open element of that name and all inside it."""
        nonlocal dropped, articles, mains, lists, in_link
        while True:
            top, drop = stack.pop()
            open_[top] -= 1
            dropped -= drop
            articles -= top == "article"
            mains -= top == "main"
            lists -= top in ("ul", "ol")
            in_link &= top != "a"
            if top == name:
                return

    for text, slash, name, attributes in tags(page):
        if text and not dropped:
            parts.append(text)
            size = len(text.strip())
            plain += size
            linked += size if in_link else 0
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if slash:
            if open_.get(name):
                close(name)
            continue
        if name in BLOCKS:
            # A paragraph ends where another block starts.
            inner = next((n for n, _ in reversed(stack) if n in BLOCKS), None)
            if inner == "p":
                close("p")
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            inner = next((n for n, _ in reversed(stack) if n in ends or n in stops), None)
            if inner in ends:
                close(inner)
        if name == "a" and open_.get("a"):
            in_link = False
        if name in VOID:
            continue
        # An article inside an article is a reader's comment.
        drop = marked(name, attributes, articles > 0 or mains > 0) or (name == "article" and articles > 0)
        stack.append((name, drop))
        open_[name] = open_.get(name, 0) + 1
        dropped += drop
        articles += name == "article"
        mains += name == "main"
        lists += name in ("ul", "ol")
        in_link |= name == "a"
    flush()
    return out


def stop_density(text: str) -> float:
    """Share of a text's words that are stop words of one language, the one with most."""
    words = [w.lower() for w in _WORD.findall(text)]
    return max(sum(w in stop for w in words) for stop in STOP.values()) / len(words) if words else 0.0


def first_pass(text: str, link_share: float, inside: bool, in_list: bool) -> int:
    """GOOD, BAD or OPEN by length, stop words and links; ``inside`` a marked article only menus are bad."""
    if link_share > MOST_LINKS:
        return BAD if in_list or not inside else OPEN
    if len(text) < SHORT:
        return OPEN
    density = stop_density(text)
    if density >= MANY_STOPS or (density >= FEW_STOPS and len(text) >= LONG):
        return GOOD
    return OPEN if inside or density >= FEW_STOPS else BAD


def second_pass(labels: list[int], otherwise: int) -> list[int]:
    """Open labels become that of the nearest decided block; of two as near, the one behind, whose heading an open block may be. Without any, ``otherwise``."""
    n, last = len(labels), None
    before = [None] * n
    for i, label in enumerate(labels):
        last = i if label != OPEN else last
        before[i] = last
    out, following = list(labels), None
    for i in range(n - 1, -1, -1):
        if labels[i] != OPEN:
            following = i
        elif before[i] is None and following is None:
            out[i] = otherwise
        elif following is None or (before[i] is not None and i - before[i] < following - i):
            out[i] = labels[before[i]]
        else:
            out[i] = labels[following]
    return out


def main_text(page: str) -> str:
    """The good blocks of a page in its order, joined by one space.

    Without a decided good block all open ones are kept: a page of one short line is its main text.
    """
    found = blocks(page)
    for at in (2, 3):
        inside = [b for b in found if b[at]]
        if inside:
            break
    else:
        inside = []
    kept = inside or found
    labels = [first_pass(text, links, bool(inside), in_list) for text, links, _, _, in_list in kept]
    labels = second_pass(labels, GOOD) if GOOD in labels else [GOOD if label == OPEN else label for label in labels]
    return " ".join(b[0] for b, label in zip(kept, labels) if label == GOOD)


def main_text_udf():
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p.decode("utf-8", "replace")) for p in pages], dtype=object)

    return of


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``df``: the main text and its length in characters.

    Null, empty and blank pages, and pages with nothing but marked elements, have the empty
    text. Null ids and urls stay null, repeated rows are repeated, an empty table gives no rows. Bytes that are no UTF-8
    become replacement characters. A page is read whole, in time proportional to its length.
    """
    rows = pick(df, id=id_col, url=url_col, html=html_col)
    return rows.select("id", "url", main_text_udf()(utf8(F.col("html"))).alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))


ship(__name__)
