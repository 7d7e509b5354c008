"""Main text of web pages: flat text blocks classified by a decision tree on their and their neighbours' shape.

A page is read once into flat blocks of text, split at block-level tags; markup, comments, scripts, styles
and form controls leave no text.  Each block has its number of words, its link density, the same of the
block before and after it, whether it is a heading, its zone (in an article or main element, in an element
that by tag or role holds menus, headers, footers, side bars or dialogues, or neither) and the zone's share of
the page's words outside links (of articles and what is neither; all of it for the other elements of a page
that has nothing else).  A decision tree, grown on the small labelled table below,
says which blocks are main text; no zone is a verdict: a teaser article beside a long body goes, a menu of
links inside an article too, and a page that lies whole in a dialogue stays.  Forms and elements with a class
or id that names boilerplate are no verdict either: a second tree, grown on labelled containers, decides by
how the name matches, the element's words and link density and its share of the page (a layout wrapper or a
page in one form holds most of it), and a block stays only if each of them around it does.  Names are read on
containers, list items, paragraphs and table cells, in parts (``user-comments``, ``userComments``,
``commentlist``).  An article or main element opens its own zone in any of these, but not in reader comments,
related links, adverts or hidden elements, which go whole.  Pages are independent rows, so Spark spreads them as they lie, without a shuffle.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one
newline in page order; nothing else is dropped or capped.  Only raw-text elements (scripts, styles, titles,
text areas, frames) run to the end of the page when unclosed; other elements without text (buttons, drawings,
selects, media) end at their close tag, or unclosed at the next block-level tag or the close of what holds
them; a self-closed svg or math element is empty.  Defined results: null or empty html, or a page
without main text, gives an empty text; unclosed or stray tags are read as far as they go; repeated rows
give one row each; a null page_id or url is carried along.
"""
from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankwear.llm.common import slices

BOILER, NEITHER, ARTICLE = 0, 1, 2       # zones
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "zone", "heading", "share")

#: Labelled blocks: the features above (share: of the zone, among the page's words outside links), then 1 for main text.
#: Blocks of articles first, then of boilerplate elements, then of neither, where length and links decide as well.
LABELLED = (
    (48, 0.00, 9, 0.00, 60, 0.00, ARTICLE, 0, 1.00, 1), (9, 0.00, 0, 0.00, 48, 0.00, ARTICLE, 1, 0.90, 1),
    (1, 0.00, 80, 0.00, 35, 0.00, ARTICLE, 0, 0.70, 1), (3, 0.00, 1, 0.00, 2, 0.00, ARTICLE, 0, 1.00, 1),
    (120, 0.05, 40, 0.00, 0, 0.00, ARTICLE, 0, 0.60, 1), (25, 0.40, 60, 0.00, 70, 0.10, ARTICLE, 0, 0.95, 1),
    (6, 1.00, 40, 0.00, 50, 0.00, ARTICLE, 0, 0.50, 1), (2, 0.00, 6, 1.00, 12, 0.00, ARTICLE, 0, 1.00, 1),
    (14, 0.00, 4, 1.00, 3, 0.00, ARTICLE, 0, 0.90, 1), (70, 0.00, 3, 1.00, 9, 0.20, ARTICLE, 1, 0.70, 1),
    (4, 0.00, 0, 0.00, 2, 0.00, ARTICLE, 1, 1.00, 1), (2, 0.50, 4, 0.00, 1, 0.00, ARTICLE, 0, 0.60, 1),
    (1, 1.00, 1, 1.00, 2, 1.00, ARTICLE, 0, 0.95, 0), (3, 1.00, 9, 0.00, 1, 1.00, ARTICLE, 0, 0.50, 1),
    (8, 0.75, 2, 1.00, 4, 0.00, ARTICLE, 0, 1.00, 1), (5, 0.00, 3, 0.00, 4, 0.00, ARTICLE, 0, 0.90, 1),
    (2, 0.00, 2, 0.00, 1, 0.00, ARTICLE, 0, 0.70, 1), (6, 0.00, 1, 1.00, 0, 0.00, ARTICLE, 0, 1.00, 1),
    (1, 0.00, 0, 0.00, 0, 0.00, ARTICLE, 0, 0.60, 1), (20, 1.00, 3, 0.00, 18, 1.00, ARTICLE, 0, 0.95, 1),
    (12, 1.00, 0, 0.00, 15, 1.00, BOILER, 0, 0.00, 0), (1, 1.00, 1, 1.00, 1, 1.00, BOILER, 0, 0.00, 0),
    (9, 0.00, 1, 1.00, 11, 0.00, BOILER, 0, 0.00, 0), (40, 0.00, 6, 0.00, 60, 0.00, BOILER, 0, 0.00, 0),
    (85, 0.02, 70, 0.00, 64, 0.00, BOILER, 0, 0.00, 0), (16, 0.10, 55, 0.00, 0, 0.00, BOILER, 0, 0.00, 0),
    (4, 0.00, 0, 0.00, 40, 0.00, BOILER, 1, 0.00, 0), (30, 0.00, 30, 0.00, 8, 0.50, BOILER, 0, 0.00, 0),
    (3, 0.00, 120, 0.00, 2, 1.00, BOILER, 0, 0.00, 0), (22, 0.60, 14, 0.00, 90, 0.00, BOILER, 1, 0.00, 0),
    (60, 0.00, 8, 0.00, 45, 0.02, NEITHER, 0, 1.00, 1), (35, 0.10, 50, 0.00, 28, 0.00, NEITHER, 0, 0.90, 1),
    (18, 0.00, 40, 0.00, 33, 0.05, NEITHER, 0, 1.00, 1), (150, 0.20, 1, 1.00, 2, 1.00, NEITHER, 0, 0.80, 1),
    (7, 0.00, 0, 0.00, 60, 0.00, NEITHER, 1, 1.00, 1), (5, 0.00, 45, 0.00, 52, 0.00, NEITHER, 1, 0.70, 1),
    (2, 0.00, 38, 0.00, 41, 0.00, NEITHER, 0, 1.00, 1), (1, 0.00, 60, 0.02, 24, 0.00, NEITHER, 0, 0.90, 1),
    (4, 0.00, 70, 0.00, 19, 0.00, NEITHER, 0, 1.00, 1), (11, 0.00, 26, 0.00, 55, 0.10, NEITHER, 0, 0.80, 1),
    (30, 0.00, 2, 0.00, 2, 0.00, NEITHER, 0, 1.00, 1), (22, 0.00, 40, 0.00, 2, 0.00, NEITHER, 0, 0.70, 1),
    (40, 0.00, 3, 0.00, 4, 1.00, NEITHER, 0, 1.00, 1), (25, 0.05, 5, 0.00, 1, 1.00, NEITHER, 0, 0.90, 1),
    (17, 0.00, 0, 0.00, 0, 0.00, NEITHER, 0, 1.00, 1), (90, 0.00, 0, 0.00, 0, 0.00, NEITHER, 0, 0.80, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, NEITHER, 0, 1.00, 0), (2, 1.00, 0, 0.00, 2, 1.00, NEITHER, 0, 0.70, 0),
    (5, 0.80, 3, 1.00, 40, 0.00, NEITHER, 0, 1.00, 0), (20, 0.90, 2, 1.00, 25, 0.90, NEITHER, 0, 0.90, 0),
    (45, 0.70, 60, 0.00, 12, 1.00, NEITHER, 0, 1.00, 0), (4, 0.00, 2, 1.00, 3, 1.00, NEITHER, 0, 0.80, 0),
    (3, 0.00, 4, 0.00, 2, 0.00, NEITHER, 0, 1.00, 0), (6, 0.00, 5, 0.60, 4, 0.00, NEITHER, 0, 0.70, 0),
    (2, 0.00, 1, 1.00, 6, 0.00, NEITHER, 1, 1.00, 0), (8, 0.00, 3, 0.00, 0, 0.00, NEITHER, 0, 0.90, 0),
    (5, 1.00, 60, 0.00, 40, 0.00, NEITHER, 0, 1.00, 0), (9, 0.60, 52, 0.00, 30, 0.10, NEITHER, 0, 0.80, 0),
    (1, 1.00, 2, 1.00, 1, 1.00, ARTICLE, 0, 0.90, 0), (3, 1.00, 2, 1.00, 4, 1.00, ARTICLE, 0, 1.00, 0),
    (5, 0.95, 3, 1.00, 2, 1.00, ARTICLE, 0, 0.70, 0), (2, 1.00, 4, 0.95, 3, 1.00, ARTICLE, 0, 0.60, 0),
    (2, 1.00, 30, 0.00, 2, 1.00, ARTICLE, 0, 0.90, 1), (4, 1.00, 3, 1.00, 25, 0.00, ARTICLE, 0, 0.80, 1),
    (7, 1.00, 2, 1.00, 60, 0.00, ARTICLE, 0, 1.00, 1), (30, 0.90, 12, 1.00, 20, 0.90, ARTICLE, 0, 0.90, 1),
    (30, 0.00, 4, 0.00, 50, 0.00, ARTICLE, 0, 0.12, 0), (6, 0.00, 1, 1.00, 28, 0.00, ARTICLE, 1, 0.15, 0),
    (18, 0.20, 7, 0.00, 3, 1.00, ARTICLE, 0, 0.05, 0), (45, 0.00, 9, 0.00, 40, 0.00, ARTICLE, 0, 0.20, 0),
    (25, 0.00, 5, 0.00, 31, 0.00, ARTICLE, 0, 0.10, 0), (40, 0.00, 8, 0.00, 60, 0.00, ARTICLE, 0, 0.45, 1),
    (22, 0.00, 30, 0.00, 12, 0.00, ARTICLE, 0, 0.40, 1), (5, 0.00, 2, 0.00, 44, 0.00, ARTICLE, 1, 0.42, 1),
    (40, 0.00, 60, 0.00, 30, 0.00, NEITHER, 0, 0.10, 0), (12, 0.00, 80, 0.00, 5, 1.00, NEITHER, 0, 0.05, 0),
    (30, 0.00, 50, 0.00, 0, 0.00, NEITHER, 0, 0.30, 0), (5, 0.00, 1, 1.00, 30, 0.00, NEITHER, 1, 0.20, 0),
    (70, 0.05, 45, 0.00, 38, 0.00, NEITHER, 0, 0.35, 0), (25, 0.00, 9, 0.00, 90, 0.00, NEITHER, 0, 0.15, 0),
    (33, 0.00, 28, 0.00, 40, 0.00, NEITHER, 0, 0.25, 0), (60, 0.00, 30, 0.00, 80, 0.00, NEITHER, 0, 0.40, 0),
    (80, 0.00, 40, 0.00, 66, 0.00, NEITHER, 0, 0.87, 1), (35, 0.00, 60, 0.00, 44, 0.10, NEITHER, 0, 0.62, 1),
    (60, 0.00, 8, 0.00, 45, 0.00, BOILER, 0, 1.00, 1), (90, 0.05, 30, 0.00, 70, 0.00, BOILER, 0, 1.00, 1),
    (35, 0.00, 50, 0.00, 28, 0.00, BOILER, 0, 1.00, 1), (45, 0.00, 0, 0.00, 33, 0.00, BOILER, 0, 1.00, 1),
    (9, 1.00, 3, 1.00, 2, 1.00, BOILER, 0, 1.00, 0), (2, 1.00, 1, 1.00, 4, 1.00, BOILER, 0, 1.00, 0),
    (4, 0.00, 0, 0.00, 0, 0.00, BOILER, 0, 1.00, 0), (3, 0.50, 6, 1.00, 2, 0.00, BOILER, 0, 1.00, 0),
    (16, 0.00, 0, 0.00, 0, 0.00, BOILER, 0, 1.00, 0), (25, 0.10, 3, 1.00, 0, 0.00, BOILER, 0, 1.00, 0),
    (12, 0.00, 2, 1.00, 4, 1.00, BOILER, 0, 1.00, 0), (21, 0.20, 9, 0.50, 0, 0.00, BOILER, 0, 1.00, 0),
    (28, 0.00, 6, 0.00, 2, 0.00, BOILER, 0, 1.00, 0), (70, 0.00, 20, 0.00, 35, 0.00, ARTICLE, 0, 0.38, 1),
    (12, 0.00, 40, 0.00, 9, 0.00, ARTICLE, 0, 0.36, 1), (33, 0.00, 15, 0.00, 60, 0.00, ARTICLE, 0, 0.41, 1),
    (4, 0.00, 33, 0.00, 48, 0.00, ARTICLE, 0, 0.39, 1), (52, 0.10, 4, 0.00, 20, 0.00, ARTICLE, 0, 0.37, 1),
    (20, 0.00, 35, 0.00, 28, 0.00, NEITHER, 0, 0.41, 0), (9, 0.00, 44, 0.00, 31, 0.00, NEITHER, 0, 0.38, 0),
    (33, 0.00, 12, 0.00, 50, 0.00, NEITHER, 0, 0.44, 0), (5, 0.00, 50, 0.00, 21, 0.00, NEITHER, 1, 0.40, 0),
    (48, 0.00, 6, 0.00, 37, 0.00, NEITHER, 0, 0.39, 0), (2, 0.00, 0, 0.00, 11, 0.00, NEITHER, 0, 1.00, 0),
    (1, 0.00, 3, 0.00, 2, 1.00, NEITHER, 0, 0.90, 0), (6, 0.00, 0, 0.00, 40, 0.00, NEITHER, 1, 1.00, 1),
    (3, 0.00, 1, 1.00, 55, 0.00, NEITHER, 1, 0.90, 1), (2, 0.00, 9, 1.00, 37, 0.00, NEITHER, 1, 1.00, 1),
    (5, 0.00, 2, 1.00, 30, 0.00, NEITHER, 1, 0.80, 1),
    (60, 0.00, 3, 1.00, 4, 1.00, ARTICLE, 0, 0.90, 1), (14, 0.00, 2, 1.00, 3, 1.00, ARTICLE, 0, 1.00, 1),
    (5, 0.00, 1, 1.00, 2, 1.00, ARTICLE, 0, 0.80, 1), (110, 0.20, 6, 1.00, 9, 1.00, ARTICLE, 0, 0.95, 1),
    (2, 0.00, 4, 1.00, 1, 1.00, ARTICLE, 1, 0.70, 1), (26, 0.40, 5, 0.90, 7, 1.00, ARTICLE, 0, 1.00, 1),
    (9, 0.30, 1, 1.00, 1, 1.00, ARTICLE, 0, 0.60, 1), (40, 0.10, 2, 0.95, 3, 0.98, ARTICLE, 0, 0.85, 1),
    (60, 0.00, 45, 0.00, 0, 0.00, BOILER, 0, 1.00, 1), (35, 0.00, 50, 0.00, 3, 0.50, BOILER, 0, 1.00, 1),
    (70, 0.00, 60, 0.00, 8, 0.00, BOILER, 0, 1.00, 1), (48, 0.10, 80, 0.00, 0, 0.00, BOILER, 0, 1.00, 1),
)

_RAW = "script|style|title|textarea|iframe"
_DROPPED = frozenset("noscript template select button svg math object canvas audio video datalist".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>" + _RAW + r")(?=[\s/>])(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>", re.S | re.I)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden|type)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr".split())
_BOXES = frozenset("nav header footer aside form article main section div ul ol table details dialog fieldset figure menu "
                   "p li td th tr dl dt dd blockquote".split())
#: Elements whose close tag may be left out: the start tags that end an open one, and the elements it is not looked for beyond.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block-level tags, at which an unclosed dropped element ends.
_FLOW = _BOXES | _HEADINGS | frozenset("p pre blockquote address li dl dt dd tr td th tbody thead tfoot caption figcaption hr center "
                                       "summary body html".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = frozenset("nav footer aside dialog menu".split())
_FORMS = frozenset("form fieldset".split())
#: Words of class or id values (split at other characters) that name boilerplate.
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav "
                   "navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal "
                   "overlay newsletter subscribe subscription signup login social share sharing related recommended comment comments "
                   "respond replies disqus widget toolbar pagination pager legal copyright disclaimer search".split())
#: Of these, the ones whose containers hold no article of the page.
_SEALED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended comment "
                    "comments respond replies disqus".split())
#: Words that leave a name what it is ("sidebar-left", "comment-list"); with any other word it is a name in part ("related-work").
_SHAPES = frozenset("box wrap wrapper container inner outer list item items block area section group row col column left right top "
                    "bottom main primary secondary site page post posts article articles content contents links link thread form bar "
                    "button buttons icons slot unit zone panel region body text title the user users reader readers visitor visitors "
                    "latest recent popular more new all my your our page pages single entry entries default".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

NONE, PART, WHOLE, SEALED = 0, 1, 2, 3   # how far a container's names or tag mark it
BOX_FEATURES = ("mark", "words", "links", "share", "zone")

#: Labelled containers: how they are marked, words, link density, share of the page's words outside links, zone of the
#: place they stand in, then 1 if they may hold main text.
LABELLED_BOXES = (
    (WHOLE, 900, 0.05, 0.97, NEITHER, 1), (WHOLE, 300, 0.30, 0.90, NEITHER, 1), (WHOLE, 80, 0.10, 1.00, NEITHER, 1),
    (WHOLE, 1500, 0.20, 0.70, NEITHER, 1), (WHOLE, 40, 0.00, 0.80, NEITHER, 1), (WHOLE, 700, 0.02, 0.95, ARTICLE, 1),
    (WHOLE, 60, 0.00, 0.75, ARTICLE, 1), (WHOLE, 25, 0.10, 1.00, ARTICLE, 1), (WHOLE, 12, 0.00, 0.90, NEITHER, 1),
    (WHOLE, 3, 0.00, 0.02, ARTICLE, 0), (WHOLE, 14, 0.00, 0.06, ARTICLE, 0), (WHOLE, 60, 0.10, 0.20, ARTICLE, 0),
    (WHOLE, 120, 0.00, 0.40, ARTICLE, 0), (WHOLE, 30, 1.00, 0.00, ARTICLE, 0), (WHOLE, 9, 0.20, 0.30, ARTICLE, 0),
    (WHOLE, 40, 0.00, 0.08, NEITHER, 0), (WHOLE, 15, 1.00, 0.00, NEITHER, 0), (WHOLE, 150, 0.40, 0.30, NEITHER, 0),
    (WHOLE, 300, 0.10, 0.40, NEITHER, 0), (WHOLE, 2, 0.50, 0.10, NEITHER, 0), (WHOLE, 60, 0.95, 0.80, NEITHER, 0),
    (WHOLE, 20, 0.90, 0.75, ARTICLE, 0),
    (PART, 3, 0.00, 0.01, ARTICLE, 1), (PART, 9, 0.00, 0.05, ARTICLE, 1), (PART, 40, 0.10, 0.10, ARTICLE, 1),
    (PART, 200, 0.05, 0.25, ARTICLE, 1), (PART, 600, 0.20, 0.80, ARTICLE, 1), (PART, 1, 0.00, 0.01, ARTICLE, 1),
    (PART, 12, 0.30, 0.03, ARTICLE, 1), (PART, 30, 0.40, 0.08, ARTICLE, 1),
    (PART, 4, 1.00, 0.00, ARTICLE, 0), (PART, 25, 0.90, 0.01, ARTICLE, 0), (PART, 60, 0.80, 0.05, ARTICLE, 0),
    (PART, 900, 0.10, 0.95, NEITHER, 1), (PART, 120, 0.00, 0.20, NEITHER, 1), (PART, 60, 0.10, 0.10, NEITHER, 1),
    (PART, 45, 0.00, 0.15, NEITHER, 1), (PART, 300, 0.30, 0.50, NEITHER, 1), (PART, 20, 0.00, 0.90, NEITHER, 1),
    (PART, 5, 1.00, 0.00, NEITHER, 0), (PART, 14, 0.00, 0.05, NEITHER, 0), (PART, 3, 0.00, 0.02, NEITHER, 0),
    (PART, 20, 0.10, 0.08, NEITHER, 0), (PART, 60, 0.90, 0.03, NEITHER, 0), (PART, 200, 0.80, 0.20, NEITHER, 0),
)


def _name_words(token: str) -> set[str]:
    """Words of a class or id: split at other characters, digits and capitals after small letters, and between two known
    words written as one."""
    words: set[str] = set()
    for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()):
        if w in _NAMES or w in _SHAPES:
            words.add(w)
        elif w:
            cut = next((k for k in range(2, len(w) - 1) if (w[:k] in _NAMES and (w[k:] in _SHAPES or w[k:] in _NAMES))
                        or (w[:k] in _SHAPES and w[k:] in _NAMES)), 0)
            words |= {w[:cut], w[cut:]} if cut else {w}
    return words


def _marked(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether a container is boilerplate by tag or role, and how far its names or its being a form mark it."""
    boiler = tag in _NO_TEXT or (tag == "header" and not in_article)
    mark = WHOLE if tag in _FORMS else NONE
    for name, *value in _ATTR.findall(attrs):
        name, raw = name.lower(), "".join(value)
        v = raw.lower()
        if name == "hidden" or (name == "aria-hidden" and v == "true") \
                or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
            mark = SEALED
        elif name == "role":
            boiler = boiler or v in _ROLES
            mark = max(mark, WHOLE if v == "form" else NONE)
        elif name in ("class", "id"):
            for token in raw.split():
                words = _name_words(token)
                named = words & _NAMES or (words & {"header"} if not in_article else set())
                if named:
                    mark = max(mark, PART if words - named - _SHAPES else SEALED if words & _SEALED else WHOLE)
    return boiler, mark


def _dropped_ends(tokens: list[re.Match]) -> dict[int, tuple[int, int]]:
    """For the start tag of each dropped element, the token to go on with and the character from which text counts again."""
    ends: dict[int, tuple[int, int]] = {}
    stack: list[tuple[str, int]] = []    # open elements
    count: dict[str, int] = {}
    unclosed: list[tuple[int, int]] = []                    # (start tag, token that closes what holds it)
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if not tag or tag in _VOID:
            continue
        if not m["end"]:
            if not (tag in ("svg", "math") and m["attrs"].endswith("/")):
                stack.append((tag, i))
                count[tag] = count.get(tag, 0) + 1
        elif count.get(tag):
            while True:
                t, at = stack.pop()
                count[t] -= 1
                if t == tag:
                    break
                if t in _DROPPED:
                    unclosed.append((at, i))
            if tag in _DROPPED:
                ends[at] = (i + 1, m.end())
    unclosed += [(at, len(tokens)) for t, at in stack if t in _DROPPED]
    if unclosed:
        after, following = len(tokens), [0] * len(tokens)   # the next block-level tag after each token
        for i in range(len(tokens) - 1, -1, -1):
            following[i] = after
            if (tokens[i]["tag"] or "").lower() in _FLOW:
                after = i
        for at, i in unclosed:
            to = min(i, following[at])
            ends[at] = (to, tokens[to].start() if to < len(tokens) else tokens[0].endpos)
    return ends


def blocks(page: str) -> tuple[list[tuple[str, int, float, int, int, tuple]], list[tuple[int, int]]]:
    """(text, words, link density, zone, heading, numbers of the marked containers around it) of the text blocks of a
    page, in order, and (mark, zone of its place) of the marked containers."""
    out: list[tuple[str, int, float, int, int, tuple]] = []
    marked: list[tuple[int, int]] = []
    parts: list[str] = []
    linked = 0                           # words inside links of the open block
    in_link = heading = False
    boxes: list[tuple[str, int, tuple, bool]] = []    # open containers: zone, marked ones around, whether sealed

    def close() -> None:
        nonlocal linked, in_link
        words = _html.unescape("".join(parts)).split()
        if words:
            zone, around = boxes[-1][1:3] if boxes else (NEITHER, ())
            out.append((" ".join(words), len(words), min(1.0, linked / len(words)), zone, int(heading), around))
        parts.clear()
        linked, in_link = 0, False

    def text(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if in_link:
                linked += len(s.split())

    at, in_head = 0, False
    tokens = list(_TOKEN.finditer(page))
    ends = _dropped_ends(tokens) if any((m["tag"] or "").lower() in _DROPPED for m in tokens) else {}
    skip = 0                             # tokens before this one lie in a dropped element
    for i, m in enumerate(tokens):
        if i < skip:
            continue
        if not in_head:
            text(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _DROPPED:
            if i in ends:
                skip, at = ends[i]
            continue
        if tag == "head" or (in_head and tag in ("body", *_BOXES)):
            in_head = tag == "head" and not m["end"]
            if tag == "head":
                close()
                continue
        if in_head:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m["end"]
        elif tag not in _INLINE:
            close()
            if tag in _HEADINGS:
                heading = not m["end"]
                if heading and boxes and boxes[-1][0] == "p":
                    boxes.pop()
            elif tag in _BOXES:
                heading = False
                if m["end"]:
                    if any(x[0] == tag for x in boxes):
                        while boxes.pop()[0] != tag:
                            pass
                    continue
                if boxes and boxes[-1][0] == "p":
                    boxes.pop()              # a block ends an open paragraph
                if tag in _IMPLIED:
                    ended, beyond = _IMPLIED[tag]
                    for k in range(len(boxes) - 1, -1, -1):
                        if boxes[k][0] in beyond:
                            break
                        if boxes[k][0] in ended:
                            del boxes[k:]
                            break
                if not m["attrs"].endswith("/"):
                    zone, around, sealed = boxes[-1][1:] if boxes else (NEITHER, (), False)
                    if not sealed:
                        boiler, mark = _marked(tag, m["attrs"], zone == ARTICLE)
                        sealed = mark == SEALED
                        if tag in ("article", "main") and not (boiler or sealed):
                            zone, around = ARTICLE, ()
                        elif boiler or sealed:
                            zone = BOILER
                        if mark in (PART, WHOLE) and zone != BOILER:
                            around = (*around, len(marked))
                            marked.append((mark, zone))
                    boxes.append((tag, zone, around, sealed))
            else:
                heading = False
                if tag == "body":
                    boxes.clear()
    if not in_head:
        text(page[at:])
    close()
    return out, marked


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 2) -> tuple | int:
    """A decision tree by Gini impurity: (feature, bound, tree up to the bound, tree above it) or a label."""
    ones = int(labels.sum())
    if ones in (0, len(labels)) or len(labels) < 2 * least:
        return int(2 * ones >= len(labels))
    best = None
    for f in range(rows.shape[1]):
        vals = np.unique(rows[:, f])
        for bound in (vals[:-1] + vals[1:]) / 2:
            low = rows[:, f] <= bound
            if min(low.sum(), (~low).sum()) < least:
                continue
            cost = sum(len(y) * (p := y.mean()) * (1 - p) for y in (labels[low], labels[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(bound), low)
    if best is None:
        return int(2 * ones >= len(labels))
    _, f, bound, low = best
    return f, bound, grow(rows[low], labels[low], least), grow(rows[~low], labels[~low], least)


def decide(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def train_tree() -> tuple | int:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


_BOX_TREE = grow(np.array(LABELLED_BOXES, float)[:, :-1], np.array(LABELLED_BOXES, float)[:, -1])


def _boxes_with_text(found: list[tuple], marked: list[tuple[int, int]]) -> list[int]:
    """Of each marked container, 1 if it may hold main text."""
    words, linked = [0] * len(marked), [0.0] * len(marked)
    for _, n, d, _, _, around in found:
        for b in around:
            words[b] += n
            linked[b] += n * d
    free = sum(n * (1 - d) for _, n, d, *_ in found)
    return [decide(_BOX_TREE, (mark, n, k / n, (n - k) / free if free else 0.0, zone)) if n else 0
            for (mark, zone), n, k in zip(marked, words, linked)]


def main_text(page: str | None, tree: tuple | int) -> str:
    """Main text of one page."""
    found, marked = blocks(page or "")
    holds = _boxes_with_text(found, marked)
    stays = [all(holds[b] for b in around) for *_, around in found]
    free = [0.0, 0.0, 0.0]                   # words outside links by zone, of kept containers
    for (_, n, d, zone, _, _), ok in zip(found, stays):
        free[zone] += n * (1 - d) if ok else 0.0
    open_ = free[NEITHER] + free[ARTICLE]
    share = [0.0 if open_ else 1.0, *(free[z] / open_ if open_ else 1.0 for z in (NEITHER, ARTICLE))]
    shape = [(0, 0.0), *((n, d) for _, n, d, *_ in found), (0, 0.0)]
    return "\n".join(t for k, (t, n, d, zone, h, _) in enumerate(found)
                     if stays[k] and decide(tree, (n, d, *shape[k], *shape[k + 2], zone, h, share[zone])))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, empty if none), n_chars (its code points) of every page."""
    tree = train_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
