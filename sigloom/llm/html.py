"""Main-text extraction by the maximum-scoring subsequence of a page's tokens.

A page becomes a run of words and tags. Words score positive, tags negative;
one linear scan finds the contiguous region with the highest sum. The weights
are log-odds of a token lying inside the marked article, learned from pages
that mark theirs (<article> or <main>), from a bounded sample of them
(FIT_PAGES, by hash of the id).

Subtrees that are never content by their element or role (menus, asides, forms,
scripts, ...) are cut before the scan. A class or id is evidence only: each of
its words has a weight, a prior (MARKS, CONTENT) plus log-odds learned from the
same pages, and an element is cut where they sum to more than CUT. No subtree is
cut that holds the page's main part (the first main or article, or else the
first h1), nor one cut for its class that holds most of the page's words.

Character references are decoded, white space of any kind inside a block (tabs,
no-break and other Unicode spaces) becomes one space, and blocks are joined by
an empty line.

Edge cases: null or empty html and pages without words give empty text; a tag
cut off by the page's end is dropped; p, li, dt, dd, td, th, tr and option end
at a sibling or with their parent; another element that never closes ends with
its parent, or before the page's main part if it holds that; repeated pages give
repeated rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the sample that the weights are fitted on.
FIT_PAGES = 500

# HTML element names and the words of class, id and role that mark parts of a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noframes ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title nav footer aside form button select textarea noscript template iframe object svg math canvas audio video menu dialog datalist script style".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner sidebar side aside menu menus submenu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer bottom cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus widget widgets toolbar pagination pager copyright legal "
    "disclaimer login search skip hidden".split()
)
CONTENT = frozenset("article articles post posts entry story content contents main body text page news hentry".split())
#: Words before a name that only say whether a part is there.
ABOUT = frozenset("has with no without is not enabled".split())
#: Elements that a start tag of the second group ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select div section article main body blockquote form aside nav header footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
#: Weights where no page marks its article.
DEFAULT = {"word": 1.0, "linked": 0.3, "a": -0.5, "li": -0.5, "ul": -1.0, "p": -0.1, "br": -0.1, "b": -0.1, "i": -0.1, "em": -0.1, "strong": -0.1, "other": -0.5}

#: Prior weights of a word of MARKS and of CONTENT in a class, the bound of a learned one, and the sum above which an element is cut.
MARK, HOLD, LEARNED, CUT = 2.0, -3.0, 1.9, 1.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:.-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]++)*+)>"
    r"|<(/?)([a-zA-Z][\w:.-]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes): kind is text, open or close; the name of a text is the text."""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = m[3] or m[6]
        if name:
            yield ("close" if (m[2] or m[5]) else "open"), name.lower(), (m[4] or m[7] or "")
    if at < len(page):
        yield "text", page[at:], ""


def class_words(value: str) -> list[str]:
    """Words of a class or id, without those that a word like `has` precedes."""
    out: list[str] = []
    for name in value.split():
        parts = [x.lower() for x in PARTS.findall(name)]
        out += [x for i, x in enumerate(parts) if x not in ABOUT and (i == 0 or parts[i - 1] not in ABOUT) and "enabled" not in parts]
    return out


def attributes_of(attributes: str) -> tuple[list[str], bool]:
    """Words of class and id, and whether role or visibility says that the element is no content."""
    named: list[str] = []
    apart = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            named += class_words(value)
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            apart = True
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            apart = True
    return named, apart


def class_weight(named: list[str], weights: dict[str, float]) -> float:
    return sum((MARK if x in MARKS else HOLD if x in CONTENT else 0.0) + weights.get("." + x, 0.0) for x in dict.fromkeys(named))


def element_ends(found: list[tuple[str, str, str]]) -> tuple[dict[int, int], set[int]]:
    """For each start tag, the index after its element; and the start tags whose own end tag is there."""
    ends: dict[int, int] = {}
    closed: set[int] = set()
    stack: list[int] = []

    def end_top(until: tuple[str, ...], i: int) -> None:
        # Ends the nearest of these elements, unless the stack's scope ends first.
        for k in range(len(stack) - 1, -1, -1):
            name = found[stack[k]][1]
            if name in until:
                for j in stack[k:]:
                    ends[j] = i
                    closed.add(j)
                del stack[k:]
                return
            if name in SCOPES:
                return

    open_names: dict[str, int] = {}
    for i, (kind, name, _) in enumerate(found):
        if kind == "text" or name in VOID:
            continue
        if kind == "open":
            if name in ENDS:
                end_top(ENDS[name], i)
            elif name in BLOCKS:
                end_top(("p",), i)
            stack.append(i)
            open_names[name] = open_names.get(name, 0) + 1
        elif open_names.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if found[stack[k]][1] == name:
                    for j in stack[k:]:
                        ends[j] = i
                        if found[j][1] in ENDS or found[j][1] == "p":
                            closed.add(j)
                    ends[stack[k]] = i + 1
                    closed.add(stack[k])
                    del stack[k:]
                    break
            else:
                open_names[name] = 0
    for j in stack:
        ends[j] = len(found)
    return ends, closed


def without_furniture(found: list[tuple[str, str, str]], weights: dict[str, float]) -> list[tuple[str, str, str]]:
    """The tokens outside the subtrees that are no content; a bare block stands for each of these."""
    ends, closed = element_ends(found)
    words = [0]
    for kind, name, _ in found:
        words.append(words[-1] + (len(name.split()) if kind == "text" else 0))
    opens = {name: i for i, (kind, name, _) in reversed(list(enumerate(found))) if kind == "open" and name in ("main", "article", "h1")}
    core = min((opens[n] for n in ("main", "article") if n in opens), default=opens.get("h1", -1))

    def cut_end(i: int, inside: int) -> int:
        """Index after the subtree at i if it is cut, else i."""
        name, attributes = found[i][1], found[i][2]
        never = name in NEVER or name == "header" and not inside
        named, apart = attributes_of(attributes) if attributes else ([], False)
        if not (never or apart) and class_weight(named, weights) <= CUT or name in ("html", "body", "article", "main"):
            return i
        end = ends[i]
        if i < core < end:
            return i if i in closed else core
        if not (never or apart) and 2 * (words[end] - words[i]) > seen:
            return i
        return end

    # Words of the page outside what its elements and roles cut.
    seen = sum(len(name.split()) for name in _texts(found, ends, core))
    kept, i, inside = [], 0, 0
    while i < len(found):
        kind, name, _ = found[i]
        if kind == "open" and name not in VOID and (end := cut_end(i, inside)) > i:
            kept.append(("open", "div", ""))
            i = end
            continue
        if name in ("article", "main") and kind != "text":
            inside += 1 if kind == "open" else -1
        kept.append(found[i])
        i += 1
    return kept


def _texts(found: list[tuple[str, str, str]], ends: dict[int, int], core: int) -> Iterator[str]:
    i = 0
    while i < len(found):
        kind, name, _ = found[i]
        if kind == "open" and name in NEVER and not i < core < ends.get(i, i):
            i = max(i + 1, ends.get(i, i))
            continue
        if kind == "text":
            yield name
        i += 1


def best_region(found: list[tuple[str, str, str]], weights: dict[str, float]) -> tuple[int, int]:
    """[start, end) of the contiguous tokens with the highest total, the first such, the longest of its start."""
    best, region, total, start, links = 0.0, (0, 0), 0.0, 0, 0
    word, linked, other = weights["word"], weights["linked"], weights["other"]
    for i, (kind, name, _) in enumerate(found):
        if kind == "text":
            n = len(name.split())
            total += n * (linked if links > 0 else word)
        else:
            total += weights.get(name, other)
            if name == "a":
                links = links + 1 if kind == "open" else max(0, links - 1)
        if total >= best and total > 0:
            best, region = total, (start, i + 1)
        if total <= 0:
            total, start = 0.0, i + 1
    return region


def whole_article(found: list[tuple[str, str, str]], start: int, end: int) -> tuple[int, int]:
    """The innermost article or main around the region, so that its short first and last blocks stay; else the region."""
    ends, _ = element_ends(found)
    for i in range(start if start < end else -1, -1, -1):
        kind, name, _ = found[i]
        if kind == "open" and name in ("article", "main") and ends[i] >= end:
            return i, ends[i]
    return start, end


def blocks(found: list[tuple[str, str, str]]) -> list[str]:
    out, parts = [], []
    for kind, name, _ in [*found, ("open", "div", "")]:
        if kind == "text":
            parts.append(name)
        elif name in BLOCKS:
            if parts and (text := " ".join(entities.unescape("".join(parts)).split())):
                out.append(text)
            parts = []
        elif name == "br":
            parts.append(" ")
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    found = without_furniture(list(tokens(page or "")), weights)
    start, end = whole_article(found, *best_region(found, weights))
    return "\n\n".join(blocks(found[start:end]))


def learn(pages: list[str]) -> dict[str, float]:
    """Log-odds of lying inside the marked article: words at least 0.1, tags at most -0.1. Of the words of classes (under `.word`),
    the log-odds of standing outside it, up to LEARNED either way, from the text that elements with them hold."""
    outside, weights = class_odds(pages), dict(DEFAULT)
    weights.update(outside)
    counts: dict[str, list[int]] = {}
    for page in pages:
        inside = links = 0
        for kind, name, _ in without_furniture(list(tokens(page)), weights):
            if kind == "text":
                if n := len(name.split()):
                    counts.setdefault("linked" if links > 0 else "word", [0, 0])[inside > 0] += n
                continue
            step = 1 if kind == "open" else -1
            if name in ("article", "main"):
                inside = max(0, inside + step)
                continue
            if name == "a":
                links = max(0, links + step)
            if name in BLOCKS or name in DEFAULT or name in VOID:
                counts.setdefault(name, [0, 0])[inside > 0] += 1
    if not any(inner for _, inner in counts.values()):
        return weights
    for name, (outer, inner) in counts.items():
        odds = math.log((inner + 1) / (outer + 1))
        weights[name] = min(2.0, max(0.1, odds)) if name in ("word", "linked") else max(-6.0, min(-0.1, odds))
    return weights


def class_odds(pages: list[str]) -> dict[str, float]:
    """Weights of the words of classes, by whether their elements lie outside the page's first article or main, and hold none."""
    counts: dict[str, list[int]] = {}
    for page in pages:
        found = list(tokens(page))
        core = next((i for i, (kind, name, _) in enumerate(found) if kind == "open" and name in ("article", "main")), None)
        if core is None:
            continue
        ends, _ = element_ends(found)
        for i, (kind, name, attributes) in enumerate(found):
            if kind != "open" or not attributes or name in VOID:
                continue
            named, _ = attributes_of(attributes)
            apart = not (i <= core < ends.get(i, i) or core < i < ends[core])
            for word in set(named):
                counts.setdefault("." + word, [0, 0])[apart] += 1
    return {word: max(-LEARNED, min(LEARNED, 0.5 * math.log((apart + 1) / (within + 1)))) for word, (within, apart) in counts.items()}


def fit(pages: DataFrame, limit: int = FIT_PAGES) -> dict[str, float]:
    """Weights from the pages of at most `limit` ids that mark their article, the same ones on every run."""
    marked = pages.filter("page_id IS NOT NULL").filter(F.lower("html").rlike("<(article|main)[ >]"))
    # Ids alone are ranked; the pages themselves are fetched by the few that are chosen, one page of each id.
    chosen = [r.page_id for r in marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(limit).collect()]
    few = pages.filter(F.col("page_id").isin(chosen)).filter(F.lower("html").rlike("<(article|main)[ >]"))
    return learn([r.html for r in few.groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").select("html").toLocalIterator()])


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(x, weights) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
