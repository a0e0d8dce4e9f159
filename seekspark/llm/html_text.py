"""HTML extraction: the maximum-scoring contiguous subsequence of a page's words and tags.

A page is read as a sequence of text runs and tags. A word scores by where it stands (its block, and whether in a link), a tag scores
below zero; both weights are log-odds from labelled pages, namely pages whose authors marked the content with one <article>, <main> or
role=main. Words of class, id and role that the labelled pages have outside
their content only mark boilerplate on all pages, beside a list of usual ones. One linear scan finds the contiguous region of the largest sum. Inside it, words of boilerplate elements (navigation,
notices, adverts, forms, comments ...) are left out; the rest is the text. Left-out words score below zero, but those of an element
opened inside the content (an insert: aside, advert, newsletter form) score nothing, nor do its tags, so that a region goes on behind it.
The text of noscript, scripts, styles, templates, frames, drawings, text areas and media fallbacks is no content.

Fitting takes at most SAMPLE labelled pages; extraction reads whole pages. Character references are decoded, white space within a
block becomes one space, blocks are joined by one space in page order; inline tags separate nothing.
Defined results: null or empty html and pages without content give an empty text. Without any labelled page the weights are the defaults.
Broken markup never fails: unmatched end tags are ignored, open elements end with the page, a tag or comment that the page does not end is
dropped. Work is linear in the page. Repeated rows get equal results, ties go to the earliest and shortest region. Empty tables work. Other
columns pass through, but for those of the added names (text, n_chars), which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common

SAMPLE = 400
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The next attribute (name, and a value in double quotes, in single quotes or in none), or the tag's end.
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]+|=)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?)")
READ = frozenset("class id role hidden aria-hidden style".split())
WORDS = re.compile(r"[a-z0-9]+")
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold content, and those that hold none outside the article.
OUTSIDE = frozenset("nav footer aside form button select dialog menu head".split())
OUTER = frozenset(["header"])
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navigation navbar breadcrumb breadcrumbs toolbar pager pagination footer share sharing social related recommended comment comments reply replies disqus widget form search hidden skip complementary contentinfo".split())
OUTER_MARKS = frozenset("header masthead topbar".split())
INLINE = frozenset("b i em strong a span u font".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
WORD, LINK, BAD, TAG_DEFAULT, BLOCK_DEFAULT = 1.0, 0.2, -2.0, -0.05, -0.3

PLAIN, INSERT = 1, 2


def marked(attributes: dict[str, str], inside: bool, learned: frozenset = frozenset()) -> tuple[bool, bool]:
    """Whether an element's attributes make it boilerplate, and whether they make it the content."""
    words = named(attributes)
    bad = bool(words & MARKS) or bool(words & learned) or not inside and bool(words & OUTER_MARKS)
    bad |= "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    return bad, "main" in WORDS.findall(attributes.get("role", ""))


def named(attributes: dict[str, str]) -> set[str]:
    """The words of class, id and role."""
    return {w for k in ("class", "id", "role") if k in attributes for w in WORDS.findall(attributes[k])}


def tokens(page: str) -> Iterator[tuple]:
    """(text,) or (end tag or not, name, attributes, self-closing), in time linear in the page: quotes count after an equals sign only.

    A tag, comment or quoted value that the page does not end is dropped with what follows it. Raw elements give their tag only.
    """
    at, low, unclosed = 0, page.lower(), set()
    low = low if len(low) == len(page) else page
    while at < len(page):
        open_ = page.find("<", at)
        if open_ < 0:
            yield (page[at:],)
            return
        if open_ > at:
            yield (page[at:open_],)
        m = TAG.match(page, open_ + 1)
        if not m:
            after = page[open_ + 1 : open_ + 2]
            if after not in ("!", "?", "/") or not after:
                yield ("<",)
                at = open_ + 1
                continue
            dashes = page.startswith("<!--", open_)
            stop = page.find("-->" if dashes else ">", open_ + (4 if dashes else 1))
            if stop < 0:
                return
            at = stop + (3 if dashes else 1)
            continue
        at, found, ended = m.end(), {}, False
        while a := ATTRIBUTE.match(page, at):
            at = a.end()
            if a[1]:
                ended = True
                break
            name = a[2].lower()
            if name in READ:
                found.setdefault(name, (a[3] or a[4] or a[5] or "").lower())
            if page[at : at + 1] in ('"', "'") and a[3] is None and a[4] is None and page[at - 1] in "= \t\n\r\f":
                return  # a value whose quote is never closed
        if not ended:
            return
        name, alone = m[2].lower(), page[at - 2] == "/"
        yield m[1], name, found, alone
        if name in RAW and not m[1] and not alone:
            stop = low.find(f"</{name}", at) if name not in unclosed else -1
            if stop < 0 and name in ("script", "style"):
                return
            if stop < 0:
                unclosed.add(name)
                continue
            end = page.find(">", stop)
            if end < 0:
                return
            at = end + 1


def events(page: str, learned: frozenset = frozenset()) -> Iterator[tuple]:
    """(kind, value, bad, inside, context): `text` with its block and whether it is linked, or `tag` with its name.

    bad: 0, PLAIN in boilerplate, or INSERT in boilerplate whose outermost element was opened inside the content.
    """
    stack, blocks, bad, inside, which, links = [], ["body"], 0, 0, PLAIN, 0
    counts: dict[str, int] = defaultdict(int)

    def pop() -> None:
        nonlocal bad, inside, links
        name, was_bad, was_main = stack.pop()
        counts[name] -= 1
        bad -= was_bad
        inside -= was_main
        links -= name == "a"
        if name in BLOCKS:
            blocks.pop()

    for token in tokens(page):
        if len(token) == 1:
            yield "text", token[0], which if bad else 0, inside > 0, (blocks[-1], links > 0)
            continue
        end, name, attributes, alone = token
        yield "tag", name, which if bad else 0, inside > 0, (end, named(attributes) if attributes else ())
        if end:
            if counts[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW or name in VOID or alone:
            continue
        if name in CLOSES:
            while stack and counts[name] and stack[-1][0] in CLOSES[name] | INLINE and any(counts[x] for x in CLOSES[name]):
                pop()
        worse, main = marked(attributes, inside > 0, learned) if attributes else (False, False)
        worse |= name in OUTSIDE or name in OUTER and not inside
        main |= name in ("article", "main")
        if worse and not bad:
            which = INSERT if inside else PLAIN
        stack.append((name, worse, main))
        counts[name] += 1
        bad += worse
        inside += main
        links += name == "a"
        if name in BLOCKS:
            blocks.append(name)


class Weights:
    """Log-odds of contexts and tags."""

    def __init__(self, words: dict | None = None, tags: dict | None = None, marks: frozenset = frozenset()):
        self.words, self.tags, self.marks = words or {}, tags or {}, marks

    def word(self, context: tuple[str, bool], bad: int) -> float:
        return 0.0 if bad == INSERT else BAD if bad else self.words.get(context, LINK if context[1] else WORD)

    def tag(self, name: str) -> float:
        return self.tags.get(name, BLOCK_DEFAULT if name in BLOCKS else TAG_DEFAULT)


def learn(pages: list[str]) -> Weights:
    """Weights from pages that mark their content themselves."""
    words, tags, marks = defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2))
    for page in pages:
        found = [*events(page or "")]
        if not any(e[3] for e in found):
            continue
        for kind, value, bad, inside, context in found:
            if kind == "tag":
                tags[value][int(inside)] += 1
                for w in context[1]:
                    marks[w][int(inside)] += 1
            elif not bad:
                words[context][int(inside)] += len(value.split())
    odds = lambda x: float(np.log((x[1] + 0.5) / (x[0] + 0.5)))
    # a word counts between -2 and 2, a tag between -2 and nearly nothing: tags never attract
    return Weights({k: float(np.clip(odds(v), -2, 2)) for k, v in words.items() if v.sum() >= 20}, {k: float(np.clip(odds(v) - 1, -2, -0.001)) for k, v in tags.items() if v.sum() >= 20}, frozenset(k for k, v in marks.items() if v[0] >= 20 and not v[1]))


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    items = [*events(page, weights.marks)]
    best, best_at, run, begin = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, bad, _, context) in enumerate(items):
        if kind == "tag":
            score = 0.0 if bad == INSERT else weights.tag(value)
        else:
            n = len(value.split())
            score = n * weights.word(context, bad) if n else 0.0
        if run <= 0:
            run, begin = 0.0, i
        run += score
        if run > best:
            best, best_at = run, (begin, i + 1)
    blocks, now = [], []
    for kind, value, bad, _, _ in items[best_at[0] : best_at[1]]:
        if kind == "text":
            if not bad:
                now.append(value)
        elif value in BLOCKS:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return " ".join(b for b in clean if b)


def extract_pages(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """pages with text and n_chars."""
    labelled = pages.where(F.lower(F.col(html)).rlike("<(article|main)[ >]|role=.?main")).select(key, html)
    weights = learn([r[0] for r in common.bounded_sample(labelled, key, SAMPLE).select(html).collect()])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(x, weights) for x in b], dtype=object)

    return pages.withColumn("text", run(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))


def op7(spark, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
