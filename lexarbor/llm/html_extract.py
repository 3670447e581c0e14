"""HTML extraction: flat text blocks classified by a decision tree.

A page is read once into flat blocks of text. Each block is described by its word count and link density, those of its
neighbours, and by what its open elements say of themselves: how strongly they are named as surroundings (menu, advert,
comments, ...) inside and outside the innermost element that is named as an article, and what share of the page's text
the named element holds. A decision tree, grown here from the small labelled table LABELLED, weighs all of it; no name
decides by itself.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

# Fixed values of HTML: elements inside a line of text, elements without content, elements of the head, and elements whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link base style script noscript template".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button option datalist".split())
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in "script style textarea title noscript iframe".split()}
HEADINGS, PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p blockquote pre".split())
#: A new one of these ends an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: How strongly a name says that an element surrounds the article: readers' comments, elements by their tag or role, telling words, and words that also name parts of articles.
COMMENTS, BY_TAG, TELLING, WEAK = 4, 3, 2, 1
BOILER_TAGS = {"nav": BY_TAG, "footer": BY_TAG, "aside": BY_TAG, "form": BY_TAG, "dialog": BY_TAG, "menu": BY_TAG, "header": BY_TAG, "address": TELLING}
BOILER_ROLES = frozenset("navigation complementary contentinfo search banner dialog alertdialog alert menu menubar toolbar form".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
TELLING_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice newsletter subscribe subscription popup modal overlay sidebar widget widgets related recommended recommendations share sharing
    menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar search searchbox disclaimer complementary contentinfo paywall""".split())
WEAK_WORDS = frozenset("side social legal copyright alert signup login discussion reviews foot skip teaser meta".split())
#: A class that begins or ends with one of these tells a state of what it stands on, such as has-sidebar.
STATE_WORDS = frozenset("has no with without is not hide show js enabled disabled active layout page".split())
ARTICLE_WORDS = frozenset("article post entry story main content body text".split())

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/][^\s=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+)))?""")
OF_INTEREST = re.compile(r"class|id|role|hidden|style", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART, CAMEL = re.compile(r"[a-z]+", re.I), re.compile(r"([a-z])([A-Z])")


@dataclass(eq=False)
class Open:
    """An open element. below and above: the most strongly named elements from it up to the innermost article, and beyond; mass: unlinked words inside."""

    tag: str
    strength: int = 0
    article: int = 0
    silent: bool = False
    heading: bool = False
    paragraph: bool = False
    below: Open | None = None
    above: Open | None = None
    mass: int = 0
    again: int = 0


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    within: Open


BODY = Open("")


def attributes_of(given: str) -> dict[str, str]:
    """Attributes in lower case with decoded values; of repeated ones the first counts. Quotes out of place are part of a name."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(given):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def name_parts(value: str) -> list[list[str]]:
    """The words of each name in a class or id: `site-Nav mainMenu` has [site, nav] and [main, menu]."""
    return [[x.lower() for x in PART.findall(CAMEL.sub(r"\1 \2", name))] for name in value.split()]


def naming(tag: str, given: dict[str, str]) -> tuple[int, bool]:
    """(how strongly an element is named as surroundings, whether it is named as an article)."""
    strength = BOILER_TAGS.get(tag, 0)
    if given.get("role", "").lower() in BOILER_ROLES:
        strength = max(strength, BY_TAG)
    article = given.get("role", "").lower() in ("main", "article")
    for words in name_parts(f"{given.get('class', '')} {given.get('id', '')}"):
        if not words or words[0] in STATE_WORDS or words[-1] in STATE_WORDS:
            continue
        ends = {words[0], words[-1]}
        if ends & COMMENT_WORDS:
            own = COMMENTS
        elif ends & TELLING_WORDS:
            own = TELLING
        else:
            own = WEAK if any(w in TELLING_WORDS or w in WEAK_WORDS or w in COMMENT_WORDS for w in words) else 0
        strength = max(strength, own)
        article = article or (not own and not ARTICLE_WORDS.isdisjoint(words))
    return strength, article


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page: runs of text between elements that are not inline, white space made one space each, references decoded.

    Tags are read as browsers do: a quote opens a value only after `=`, a slash closes nothing, an unknown or surplus end
    tag is passed over, and what is never closed ends with the page. An inline element that is hidden or named as
    surroundings parts a block.
    """
    out: list[Block] = []
    stack: list[Open] = []
    pieces: list[tuple[str, bool]] = []
    links, open_tags = 0, Counter()

    def pop() -> Open:
        gone = stack.pop()
        open_tags[gone.tag] -= 1
        if stack:
            stack[-1].mass += gone.mass
        return gone

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            linked = sum(len(t.split()) for t, link in pieces if link)
            words = text.count(" ") + 1
            (stack[-1] if stack else Open("")).mass += max(0, words - linked)
            out.append(Block(text, words, min(words, linked), stack[-1] if stack else BODY))
        pieces.clear()

    def say(raw: str) -> None:
        if raw and not (stack and stack[-1].silent):
            pieces.append((entities.unescape(raw) if "&" in raw else raw, links > 0))

    at = 0
    while True:
        found = TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            say(page[at:end])
        if not found:
            break
        at = found.end()
        closing, tag, text = found[1], (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        given = attributes_of(text) if text and not closing and OF_INTEREST.search(text) else {}
        top = stack[-1] if stack else BODY
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(given.get("style", "")))
        strength, article = naming(tag, given) if given or tag in BOILER_TAGS else (0, False)
        if tag in INLINE:
            if tag == "br":
                say(" ")
            if tag == "a":
                links = 0 if closing else 1
            if stack and top.tag == tag:
                top.again += -1 if closing else 1
                if top.again < 0:
                    flush()
                    pop()
                continue
            if closing or tag in VOID or not (hidden or strength >= TELLING):
                continue
            flush()
        else:
            flush()
            links = 0
            if closing:
                if open_tags[tag]:
                    while pop().tag != tag:
                        pass
                continue
            if stack and top.tag == "head" and tag not in HEAD:
                pop()
            while stack and stack[-1].tag in CLOSES.get(tag, ()):
                pop()
            if stack and stack[-1].tag == "p":
                pop()
            if tag in VOID:
                continue
            if tag in RAW:
                over = RAW[tag].search(page, at)
                at = over.end() if over else len(page)
                continue
            top = stack[-1] if stack else BODY
        if tag in ("html", "body") or (tag == "header" and top.article and strength == BY_TAG):
            strength = 0
        kind = 0 if strength >= TELLING else 2 if tag in ("article", "main") else int(article and tag not in INLINE)
        new = Open(tag, strength, max(top.article, kind), top.silent or tag in SILENT or hidden, top.heading or tag in HEADINGS, top.paragraph or tag in PARAGRAPHS, top.below, top.above)
        if kind:
            new.below, new.above = None, max((x for x in (top.below, top.above) if x), key=lambda x: x.strength, default=None)
        if strength and (not new.below or new.below.strength < strength):
            new.below = new
        stack.append(new)
        open_tags[tag] += 1
    flush()
    while stack:
        pop()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "named inside", "share of it", "named outside", "share of that", "article", "heading", "paragraph")


def features(found: list[Block]) -> np.ndarray:
    """A row per block; beyond the ends of the page there are 0 words and no links."""
    own = np.array([[b.words, b.link_words / b.words] for b in found]).reshape(-1, 2)
    pad = np.vstack([np.zeros((1, 2)), own, np.zeros((1, 2))])
    whole = max(1, sum(b.words - b.link_words for b in found))
    named = lambda x: (x.strength, x.mass / whole) if x else (0, 0.0)
    said = np.array([[*named(b.within.below), *named(b.within.above), b.within.article, b.within.heading, b.within.paragraph] for b in found], float).reshape(-1, 7)
    return np.hstack([own, pad[:-2], pad[2:], said])


SCALES = (0.4, 1.0, 2.0, 4.0)
# Labelled by hand: small pages whose blocks of main text begin with "+" and all others with "-". Words stand for length only.
LABELLED = (
    "<body><nav><ul><li><a href=x>- home</a></li><li><a href=x>- world news</a></li></ul></nav><div class=ad>- buy this thing now</div><article><h1>+ a title of few words</h1><p>+ {40}</p><p>+ {90}</p><p>+ {5}</p></article><footer>- copyright {8}</footer></body>",
    "<body><header><h1>- the site</h1><p>- {9}</p></header><div id=content><h1>+ short title</h1><p>+ {60}</p><h2>+ part</h2><p>+ {3}</p><blockquote>+ {14}</blockquote></div><aside><h3>- popular</h3><p>- {30}</p><a href=x>- more of it</a></aside></body>",
    "<body><div class='cookie-notice'><p>- {35}</p></div><main><p>+ {25} <a href=x>a link</a> {20}</p><ul><li>+ {6}</li><li>+ {4}</li></ul></main><section class=comments><h2>- comments</h2><div class=comment><p>- {45}</p></div><div class=comment><p>- {80}</p></div></section></body>",
    "<body><div><a href=x>- one</a> | <a href=x>two</a> | <a href=x>three</a></div><p>+ {70}</p><p>+ {55}</p><p>+ {2}</p><div><a href=x>- about the company</a> <a href=x>contact</a></div></body>",
    "<body><form><p>- {12}</p></form><div class=sidebar><p>- {50}</p><ul><li><a href=x>- link {4}</a></li></ul></div><div class=post><p>+ {8}</p><table><tr><td>+ {2}</td><td>+ {1}</td></tr></table><p>+ {33}</p></div><div class=related><p>- {22}</p></div></body>",
    "<body><article><header><h1>+ {6}</h1></header><p>+ {120}</p><div class=share><a href=x>- share this</a></div><p>+ {30}</p><div class=advert><p>- {25}</p></div><p>+ {64}</p></article><div class=comments><p>- {16}</p></div><footer><p>- {18}</p><a href=x>- imprint</a></footer></body>",
    "<body><div class=ad>- {7}</div><article><h1>+</h1><p>+ {1}</p><p>+</p><p>+ {2}</p><p>+ {1}</p></article><footer>- {7}</footer></body>",
    "<body><nav><a href=x>- all</a></nav><article><p>+ {1}</p><p><a href=x>+ {9}</a></p><p>+ {1}</p><p>+ {30}</p><p>+ {1}</p><p>+</p></article>",
    "<body><article><p>+ {3}</p><p>+ <a href=x>{4}</a> {2}</p><p>+</p><ul><li><a href=x>+ {3}</a></li><li><a href=x>+</a></li></ul></article><aside>- {2}</aside>",
    "<body><div>- {3}</div><div>+ {45}</div><div>+ {80}</div><div><a href=x>- next page of many</a></div><div>- {2}</div></body>",
    # A name that stands on the wrapper of an article, and weak names inside one.
    "<body><div class='content has-sidebar'><h1>+ {4}</h1><p>+ {50}</p><p>+ {7}</p></div><div class=sidebar><p>- {20}</p></div></body>",
    "<body><div class=no-sidebar><article><p>+ {12}</p><p>+ {31}</p></article></div><div id=footer><p>- {11}</p></div></body>",
    "<body><article><div class='legal text'><p>+ {22}</p><p>+ {48}</p></div><div class=social><p>+ {15}</p></div><p>+ {20}</p></article><div class=social><a href=x>- follow us</a></div></body>",
    "<body><div class=banner><article><h1>+ {5}</h1><p>+ {60}</p><p>+ {9}</p></article></div><footer><p>- {6}</p></footer></body>",
    "<body><div class=modal><main><p>+ {18}</p><p>+ {77}</p></main></div><div class=popup><p>- {12}</p></div></body>",
    "<body><article><p>+ {20}</p></article><section id=comments><article><p>- {70}</p></article><article><p>- {90}</p></article><article><p>- {60}</p></article></section></body>",
    "<body><main><p>+ {55}</p></main><aside><article><h2>- {6}</h2><p>- {40}</p></article></aside><div class=related><article><p>- {14}</p></article></div></body>",
    "<body><article><p>+ {15}</p><div class=comments><p>- {40}</p><p>- {85}</p><p>- {99}</p></div></article></body>",
    "<body><div class=social><h1>+ {5}</h1><p>+ {45}</p><p>+ {62}</p></div><div class=legal><p>- {14}</p></div></body>",
    "<body><article><p>+ {30}</p><form><p>- {20}</p></form><p>+ {9}</p><aside><p>- {28}</p></aside><p>+ {33}</p><footer><p>- {10}</p></footer></article></body>",
    "<body><article><p>+ {14}</p><div class=ad><p>- {60}</p></div><p>+ {8}</p><span class=ad>- {5}</span></article></body>",
    "<body><article><h1>+ {3}</h1><p>+ {40}</p><p>+ {6}</p></article></body>",
    "<body><div class=entry><p>+ {40}</p><p>+ {2}</p></div></body>",
    "<body><article><ul><li><a href=x>+ {3}</a></li><li><a href=x>+ {2}</a></li></ul><p>+ {10}</p></article></body>",
    "<body><div id=main><p><a href=x>+ {5}</a></p><p>+ {30}</p><p><a href=x>+ {8}</a></p></div></body>",
    "<body><article><p>+ {30}</p><div class=legal><p>+ {20}</p></div></article></body>",
    "<body><article><div class='legal text'>+ {20}</div></article></body>",
    "<body><div class=sidebar><div class=content><h1>+ {3}</h1><p>+ {25}</p><p>+ {40}</p></div></div></body>",
    "<body><div class=banner><article><p>+ {33}</p></article></div></body>",
    "<body><article><p>+ {44}</p></article><div class=widget><article><p>- {12}</p></article></div><div class=promo><div class=post><h3>- {4}</h3><p>- {11}</p></div></div></body>",
    "<body><article><p>+ {20}</p><ul><li>+ {3}</li></ul></article></body>",
    "<body><article><div>+ {30}</div><div>+ {7}</div></article></body>",
    "<body><div id=main><p>+ {11}</p><div>+ {16}</div></div></body>",
    "<body><article><h2>+ {4}</h2><table><tr><td>+ {8}</td><td>+ {5}</td></tr></table></article></body>",
    "<body><div class=alert><p>- {9}</p></div><p>+ {40}</p><p>+ {21}</p><div class=copyright>- {12}</div></body>",
    "<body><div class=login>- {4}</div><div class=social><p>- {18}</p></div><h1>+ {4}</h1><p>+ {52}</p><p>+ {16}</p><div class=legal>- {25}</div></body>",
    "<body><article><p>+ {30}</p><div class=legal><p>+ {12}</p></div><div class=side>+ {5}</div></article><div class=signup>- {20}</div></body>",
    # No names at all: words and links of a block and its neighbours are what there is.
    "<body><div><a href=x>- start</a></div><div><a href=x>- news {2}</a></div><h1>+ {6}</h1><p>+ {20}</p><p>+ {11}</p><p>+ {38}</p><h2>+ {3}</h2><p>+ {26}</p><div><a href=x>- imprint</a> <a href=x>contact</a></div><div>- {4}</div></body>",
    "<body><table><tr><td><a href=x>- {2}</a></td><td><a href=x>- {1}</a></td></tr></table><div>+ {33}</div><div>+ {8}</div><div>+ {51}</div><div>+ {17}</div><ul><li><a href=x>- {3}</a></li><li><a href=x>- {4}</a></li></ul></body>",
    "<body><div>- {2}</div><ul><li><a href=x>- {1}</a></li><li><a href=x>- {2}</a></li><li><a href=x>- {1}</a></li></ul><h1>+ {8}</h1><div>+ {29}</div><div>+ {64}</div><p>+ {4}</p><p>+ {40}</p><ul><li><a href=x>- {5}</a></li></ul><div>- {6}</div></body>",
    "<body><h1>+ {5}</h1><p>+ {24}</p><p>+ {6} <a href=x>{2}</a> {9}</p><p>+ {19}</p></body>",
    "<body><h1>+ {5}</h1><p>+ {24}</p><p>+ {6}</p></body>",
    "<body><div>+ {40}</div><div>+ {12}</div></body>",
    "<body><p>+ {12}</p></body>",
    "<body>+ {9}</body>",
    "<body><div>+ {21}</div><div><a href=x>- {6}</a></div></body>",
    "<body><div><a href=x>- {2}</a> <a href=x>{1}</a></div><p>+ {16}</p><p>+ {5}</p><p>+ {13}</p><div>- {3} <a href=x>{4}</a></div></body>",
)


@dataclass(frozen=True)
class Node:
    """A split (value at most `cut` goes to `low`) or, without a feature, a leaf."""

    verdict: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def says(self, row) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.verdict


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 10, least: int = 4) -> Node:
    """A tree by Gini impurity with at least `least` rows in a leaf; of equal splits the first feature and the lowest cut."""
    verdict = bool(labels.mean() >= 0.5)
    if depth == 0 or labels.all() or not labels.any():
        return Node(verdict)
    gini = lambda y: 2 * y.mean() * (1 - y.mean()) * len(y) if len(y) else 0.0
    best = (gini(labels) - 1e-9, -1, 0.0)
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, k] <= cut
            if not least <= low.sum() <= len(low) - least:
                continue
            best = min(best, (gini(labels[low]) + gini(labels[~low]), k, cut), key=lambda x: x[0])
    _, k, cut = best
    if k < 0:
        return Node(verdict)
    low = rows[:, k] <= cut
    return Node(verdict, k, float(cut), grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


def labelled_table(pages: tuple[str, ...] = LABELLED, scales: tuple[float, ...] = SCALES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages, each in several lengths, so that no cut hangs on a page's own numbers."""
    rows, labels = [], []
    for page in pages:
        for scale in scales:
            found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * max(1, round(int(m[1]) * scale))), page))  # noqa: B023
            rows.append(features(found))
            labels += [b.text.startswith("+") for b in found]
    return np.vstack(rows), np.array(labels)


@lru_cache(1)
def content_tree() -> Node:
    return grow(*labelled_table())


def main_text(page: str | None, tree: Node | None = None) -> str:
    """The blocks of main text in page order, joined by a space; a null, empty or text-less page gives the empty text."""
    found = blocks(page or "")
    tree = tree or content_tree()
    return " ".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if tree.says(row))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): a row per input row, from the whole page. No shuffle.

    Null and empty pages, and those without main text, have the empty text; null ids and urls stay null, repeated rows
    stay. Other columns are not read. A page is one task's work, its memory a few times its length.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = content_tree()
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.selectExpr(f"CAST(`{id_col}` AS LONG) page_id", f"`{url_col}` url", f"`{html_col}` html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
