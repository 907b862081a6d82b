"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass calls a block good if it is
long, has few link characters and many stop words; bad if most of it is link text or if it
stands in a part that is no article (menus, page headers and footers, side bars, notices,
adverts, forms, reader comments); all others are ambiguous. In the second pass an ambiguous
block takes the label of its nearest decided neighbours of the same region; where the two
sides differ, the nearer one counts, and of equally near ones the good one inside an article.

A page with an article element (article, main, role=main) has two regions, and only
the inside can be good; blocks there that no neighbour decides are good. A page without one
is a single region in which undecided blocks are good only if nothing on the page is decided
and they aren't bad by their place.

Defined results: null, empty and text-free pages give ''. Unclosed tags end with the block
around them, unclosed comments and scripts with the page. An inline element that is left out
(a button, an advert's span) leaves the block around it whole. Character references are decoded
once; white space in a block becomes one space. Nothing is capped; repeated pages repeat; an empty
table gives no rows; columns other than the key, those kept and the html are ignored and may have any name.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_map

# Thresholds: characters of a block, share of its words that are stop words, share of link characters.
LONG, MEDIUM, DENSE, SOME, LINKS = 200, 70, 0.30, 0.15, 0.5

# Elements and words of class, id and role attributes.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas audio video select xmp noframes".split())
RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in RAW}
OUTSIDE = set("head nav aside footer form menu dialog button fieldset label".split())
BOILER = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments complementary consent "
    "contentinfo cookie cookies copyright disclaimer discussion disqus footer form gdpr legal login menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promotion promoted recommended related replies reply respond "
    "search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: Last words of a two-word name that speak of a part of the page.
PART = set(
    "area articles bar block body box button buttons container content form group header holder inner item items link links list menu module "
    "outer panel posts row section slot stories text title top unit widget wrap wrapper zone".split()
)
STOP = set(
    # English, German, French, Spanish
    "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into "
    "is it its more no not of on one or our out she so some than that the their them then there they this to up was we were what when "
    "which who will with would you your "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im "
    "ist ja kein man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes mon ne nos notre nous on "
    "ou où par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous y "
    "al algo como con cual cuando del desde donde el ella ellos era eran es esa ese eso esta este esto fue ha han hay la las lo los más "
    "me mi muy nada ni no nos o os para pero por porque que quien se ser si sin sobre su sus también te tiene todo un una unos y ya yo".split()
)

TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>""")
#: One attribute after another, from where the last one ended: a name, and the value that may follow it.
ATTR = re.compile(r"""[\s/]*([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|[\s/]*["'<=]""")
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-z0-9]+")


class Block:
    __slots__ = ("text", "linked", "boiler", "inside", "hint", "label")

    def __init__(self, text: str, linked: int, boiler: bool, inside: bool, hint: bool = False):
        self.text, self.linked, self.boiler, self.inside, self.hint, self.label = text, linked, boiler, inside, hint, ""


def attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag, in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        if m[1]:
            out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return out


def named(value: str) -> str:
    """What a class, id or role says: "boiler", "header", "hint" or nothing.

    A name that begins or ends with a word of ``BOILER`` in a compound of at most two words speaks of a part of
    the page ("sidebar", "ad-box", "post-comments"). Where the word has another beside it that makes it a topic
    ("social-history", "related-work"), it is a hint only, which the text of the block may outweigh.
    """
    said = ""
    for name in value.split():
        words = NAME.findall(name)
        if not words:
            continue
        if words[-1] in BOILER or words[0] in BOILER and (len(words) == 1 or words[-1] in PART or words[-1].isdigit()):
            return "boiler"
        if "header" in words:
            said = "header"
        elif not said and any(w in BOILER for w in words):
            said = "hint"
    return said


def place(tag: str, text: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is no part of an article, whether it is the article, and whether its name hints at the first."""
    boiler = tag in OUTSIDE or tag == "header" and not inside
    article, hint = tag in ("article", "main"), False
    if text and len(text) > 3:
        found = attributes(text)
        for name in ("class", "id", "role"):
            said = named(found.get(name, ""))
            # The body and html elements carry page-wide names; the article may say that it has comments.
            if said == "boiler" and tag not in ("html", "body", "main") and not (tag == "article" and not inside and "comment" not in found[name]):
                boiler = True
            boiler |= said == "header" and not inside and tag not in ("html", "body")
            hint |= said == "hint" and tag not in ("html", "body", "main", "article")
        article |= found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
        boiler |= "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    return boiler, article and not boiler, hint


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, each with its link characters and place."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boiler, inside, hint
    where: dict[str, list[int]] = {}  # places of each open tag in the stack
    edges: list[int] = []  # places of open block tags
    boiler = inside = hint = False
    links, breaks, at, n = 0, 0, 0, len(html)
    # Of an open inline element that is left out: its place in the stack, and what stood before it.
    inline: tuple[int, int, int, bool, bool] | None = None

    def add(parts, linked, boiler, inside, hint):
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(unescape("".join(linked)).split())), boiler, inside, hint))

    def flush():
        nonlocal parts, linked, inline
        if inline:
            _, k, j, i, h = inline
            add(parts[:k], linked[:j], False, i, h)
            parts, linked, inline = parts[k:], linked[j:], None
        if parts:
            add(parts, linked, boiler, inside, hint)
            parts, linked = [], []

    def close(k: int):
        nonlocal boiler, inside, hint, links
        while len(stack) > k:
            t = stack.pop()[0]
            where[t].pop()
            if edges and edges[-1] >= len(stack):
                edges.pop()
            links -= t == "a"
        boiler, inside, hint = stack[-1][1:] if stack else (False, False, False)

    while at < n:
        m = TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            parts.append(text)
            if links:
                linked.append(text)
            if not text.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:  # comment, CDATA or declaration
            head = m[0]
            close_at = html.find({"<!--": "-->", "<![CDATA[": "]]>"}.get(head, ">"), at)
            if head == "<![CDATA[":
                parts.append(html[at : close_at if close_at >= 0 else n].replace("&", "&amp;"))
            at = n if close_at < 0 else close_at + (1 if head in ("<!", "<?") else 3)
            continue
        tag, end, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if end:
            if tag == "p" and not where.get("p"):
                flush()
                continue
            k = where[tag][-1] if where.get(tag) else -1
            # An inline end tag doesn't reach past the block around it.
            if k >= 0 and tag not in BLOCK and edges and edges[-1] > k:
                k = -1
            if tag not in BLOCK and k >= 0 and inline and k <= inline[0]:
                # What it held goes; the block around it stays whole.
                parts, linked, inline = [*parts[: inline[1]], " "], linked[: inline[2]], None
            elif tag in BLOCK or k >= 0 and stack[k][1] != (stack[k - 1][1] if k else False):
                flush()
            if k >= 0:
                close(k)
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                e = RAW_END[tag].search(html, at)
                at = e.end() if e else n
            parts.append(" ")
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
            continue
        if tag in VOID or attrs.endswith("/"):
            if tag in BLOCK:
                flush()
            continue
        b, a, h = place(tag, attrs, inside)
        if tag not in BLOCK and b and not boiler:
            inline = inline or (len(stack), len(parts), len(linked), inside, hint)
        elif tag in BLOCK or h and not hint:
            flush()
            # A new block ends an open paragraph and open inline elements; items end their like.
            k = edges[-1] + 1 if edges else 0
            if k and stack[k - 1][0] == "p" and tag in BLOCK:
                close(k - 1)
            elif k and tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[k - 1][0] == tag:
                close(k - 1)
            elif tag in BLOCK and k < len(stack) and not any(x[1] for x in stack[k:]) and not any(x[0] == "a" for x in stack[k:]):
                close(k)
        boiler, inside, hint = boiler or b, inside or a, hint or h
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            edges.append(len(stack))
        stack.append((tag, boiler, inside, hint))
        links += tag == "a"
    flush()
    return out


def classify(found: list[Block]) -> None:
    """Label every block good or bad."""
    article = any(b.inside and not b.boiler for b in found)
    for b in found:
        size = len(b.text)
        if b.boiler or article and not b.inside or b.linked > LINKS * size:
            b.label = "bad"
            continue
        words = WORD.findall(b.text.lower())
        share = sum(w in STOP for w in words) / len(words) if words else 0.0
        if size >= LONG and share >= SOME or size >= MEDIUM and share >= DENSE:
            b.label = "good"
        elif b.hint and not (article and share >= DENSE):
            b.label = "bad"
    # Blocks outside an article are decided already: what is left is one region.
    for region in [[b for b in found if not b.boiler and (b.inside or not article)]]:
        decided = [k for k, b in enumerate(region) if b.label]
        after, j = [None] * len(region), None
        for k in range(len(region) - 1, -1, -1):
            after[k] = j = k if region[k].label else j
        before, given = None, {}
        for k, b in enumerate(region):
            if b.label:
                before = k
                continue
            near = [(abs(k - x), region[x].label == ("bad" if article else "good"), region[x].label) for x in (before, after[k]) if x is not None]
            given[k] = min(near)[2] if near else "good" if article or not decided else "bad"
        for k, label in given.items():
            region[k].label = label


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(df: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, keep..., text, n_chars) of every page."""
    schema = StructType([*(df.schema[c] for c in (key, *keep)), StructField("text", StringType()), StructField("n_chars", LongType())])

    def make():
        def work(rows):
            texts = [main_text(h) for h in rows["_html"]]
            return {**{c: rows[c] for c in (key, *keep)}, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return arrow_map(df.select(key, *keep, F.col(html).alias("_html")), schema, make)
