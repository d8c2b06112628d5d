"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page is a sequence of words and tags.  Each word scores positive and each tag negative, and one
linear scan finds the contiguous region of the greatest sum.  The weights are log ratios learnt from
labelled pages, pages that mark their content by an article or main element: how much more often than
elsewhere a word right inside a tag, or a tag itself, occurs in content.  Where a page marks its
content, that is known of a word or tag in advance: inside the mark words keep their learnt weight and
tags cost next to nothing, outside it words score what labelled pages say of such words and are left out:
as nothing of them is taken, they cost no more than a tag, so that the region holds all marks of the page.
A mark with few words beside many paragraphs outside it (a teaser in an article element, and the text itself
in another) is not believed: such a page is scored as one without.

An element that its class, id or role, or a tag that says what it is (PRIOR_TAGS), shows to be no
content has words that score nothing and are left out wherever it stands: menus, adverts, forms and
comments stand inside marked content, too, so that marks alone can't teach them.  It ends with its close or that of an element around it.
A form around the whole page is a wrapper: one that holds a mark, or most of the page's words.  Names are weighed the same way,
by the words inside elements of that name that are content or not, on top of a prior count for names that say what they are.

Character references are decoded, white space in a block is one space, blocks are trimmed and
joined by a line feed; empty blocks are left out.  Null and empty pages, and pages without content, give an empty
text.  Repeated rows each have their result.  Without labelled pages the prior stands alone.  Other
columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import small_batches

#: Labelled pages that weights are learnt from: about so many different ones, those of the least hashes of their content.
LABELLED_PAGES = 4000
#: Weights of a word and a tag that labelled pages don't have, bounds of learnt ones, and the least that a word and a tag weigh: words score positive, tags negative.
WORD, TAG, MOST, LEAST_WORD, LEAST_TAG = 1.0, -0.2, 3.0, 0.05, -0.01
#: Prior words outside content, for elements of these names, classes, ids or roles.
PRIOR_WORDS = 50
PRIOR_TAGS = frozenset("aside audio button canvas dialog embed footer form head header iframe input map menu nav noscript object option script select style svg template textarea title video".split())
PRIOR_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies disqus footer form header masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination popup promo promotion related replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Parts that a compound name may have beside these.
PRIOR_PARTS = frozenset("area bar block bottom box button buttons container content desktop global group icons inner item items left link links list main mobile module outer page panel primary right row secondary section site slot top unit wrap wrapper".split())
CONTENT_TAGS = ("article", "main")
#: Tags of elements that may be around a whole page, and the share of its words from which they are; the share of the words of marks and of paragraphs outside them that marks must have.
WRAPPERS, WRAPPED_SHARE, MARKED_SHARE = ("form",), 0.7, 0.15
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", content, ""), ("open", tag, attributes) and ("close", tag, "") in page order; comments and declarations are left out."""
    at, find = 0, _TOKEN.search
    while m := find(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            yield "close", tag, ""
        else:
            yield "open", tag, rest
            if tag in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                stop = end.start() if end else len(page)
                if stop > at:
                    yield "text", page[at:stop], ""
                at = stop
    if at < len(page):
        yield "text", page[at:], ""


def features(tag: str, rest: str) -> list[str]:
    """The names of an element: its tag, and its tag with each class, id and role."""
    found = [tag]
    if rest and "=" in rest:
        for m in _ATTRIBUTE.finditer(rest):
            found += [f"{tag}.{x.lower()}" for x in (m[2] or m[3] or m[4] or "").split()]
    return found


def prior(feature: str) -> int:
    tag, _, name = feature.partition(".")
    parts = [x for x in re.split("[-_]+|[0-9]+", name) if x]
    named = any(x in PRIOR_NAMES for x in parts) and all(x in PRIOR_NAMES or x in PRIOR_PARTS for x in parts)
    return PRIOR_WORDS if (named if name else tag in PRIOR_TAGS) else 0


def count_tokens(page: str) -> Counter:
    """((sort, name), is content): tags by name, words by the tag right around them, words inside elements by all their names, and words outside the mark, of a labelled page; empty for a page without marked content."""
    counts: Counter = Counter()
    stack: list[tuple[str, list[str], bool, bool]] = []
    marked = False
    for kind, value, rest in tokens(page):
        inside, other = (stack[-1][2], stack[-1][3]) if stack else (False, False)
        if kind != "text":
            counts[("tag", value), inside and not other] += 1
        if kind == "open" and value not in VOID:
            names = features(value, rest)
            marked |= value in CONTENT_TAGS
            stack.append((value, names, inside or value in CONTENT_TAGS, other or any(map(prior, names))))
        elif kind == "close":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == value), None)
            if at is not None:
                del stack[at:]
        elif kind == "text" and (n := len(value.split())):
            content = inside and not other
            counts[("word", stack[-1][0] if stack else ""), content] += n
            counts[("outside", ""), content] += n * (not inside)
            for name in {x for _, names, _, _ in stack for x in names}:
                counts[("element", name), content] += n
    return counts if marked else Counter()


class Weights(NamedTuple):
    """Of words by the tag right around them, of tags, of elements (log odds that their words are content), and of a word outside the mark of a page that has one."""

    words: dict[str, float]
    tags: dict[str, float]
    elements: dict[str, float]
    outside: float


def weigh(counts: dict[tuple[str, str], tuple[float, float]]) -> Weights:
    """Weights from the counts (content, other) of each (sort, name)."""
    whole = [sum(x[i] for (sort, _), x in counts.items() if sort in ("word", "tag")) for i in (0, 1)]

    def ratios(sort: str) -> dict[str, float]:
        return {name: float(np.clip(np.log((a + 0.5) / (b + 0.5) * (whole[1] + 1) / (whole[0] + 1)), -MOST, MOST)) for (x, name), (a, b) in counts.items() if x == sort}

    outside = counts.get(("outside", ""), (0, 0))
    return Weights(
        {k: max(x, LEAST_WORD) for k, x in ratios("word").items()}, {k: min(x, LEAST_TAG) for k, x in ratios("tag").items()},
        {name: float(np.log((a + 1) / (b + prior(name) + 1))) for (sort, name), (a, b) in counts.items() if sort == "element"}, float(np.log((outside[0] + 1) / (outside[1] + PRIOR_WORDS + 1))),
    )


def is_other(names: list[str], weights: dict[str, float]) -> bool:
    """Whether one of an element's names shows it to be no content; a tag's own name does only if it says what it is."""
    return any(weights.get(x, -float(prior(x))) < 0 for x in names if "." in x or x in PRIOR_TAGS)


def learn(pages: DataFrame, most: int = LABELLED_PAGES) -> Weights:
    """Weights from about `most` different labelled pages (html), a fraction of the hashes of their content; as long as these pages have different names."""
    small_batches(pages.sparkSession)
    marked = pages.where(F.col("html").rlike("(?i)<(?:article|main)[\\s>]")).select("html", F.xxhash64("html").alias("h"))
    different = marked.agg(F.approx_count_distinct("h")).first()[0]
    under = min(1.0, most / max(1, different)) * 2.0**64 - 2.0**63
    sample = marked.where(F.col("h") <= F.lit(under)).groupBy("h").agg(F.min("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count_tokens(page))
        columns = [x for (sort, name), content in total for x in [(sort, name, content)]]
        sorts, names, contents = zip(*columns, strict=True) if columns else ((), (), ())
        yield pa.record_batch({"sort": pa.array(sorts, pa.string()), "name": pa.array(names, pa.string()), "content": pa.array(contents, pa.bool_()), "n": pa.array(list(total.values()), pa.int64())})

    n = F.col("n")
    sums = sample.mapInArrow(run, "sort string, name string, content boolean, n long").groupBy("sort", "name").agg(F.sum(F.when(F.col("content"), n).otherwise(0)).alias("a"), F.sum(F.when(F.col("content"), 0).otherwise(n)).alias("b"))
    return weigh({(r["sort"], r["name"]): (r["a"], r["b"]) for r in sums.collect()})


def best_region(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous region of the greatest sum begins and ends; (0, 0) if none is above zero.  A region that sums to nothing or less is never gone on with."""
    best, first, last, total, begin = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, first, last = total, begin, i + 1
    return first, last


def wrappers(found: list[tuple[str, str, str]]) -> set[int]:
    """Places of the opening tags, among a page's tokens, of elements that are around the page."""
    opened: list[tuple[str, int, int]] = []  # tag, place, words before it
    words, sizes, holds = 0, {}, set()
    for i, (kind, value, _) in enumerate(found):
        if kind == "text":
            words += len(value.split())
        elif kind == "open":
            if value in CONTENT_TAGS:
                holds |= {at for _, at, _ in opened}
            if value in WRAPPERS:
                opened.append((value, i, words))
        elif any(tag == value for tag, _, _ in opened):
            while True:
                tag, at, before = opened.pop()
                sizes[at] = words - before
                if tag == value:
                    break
    sizes |= {at: words - before for _, at, before in opened}
    return {at for at, n in sizes.items() if at in holds or n >= WRAPPED_SHARE * words}


def extract(page: str, weights: Weights) -> str:
    """Main text of a page."""
    scores: list[float] = []
    pieces: list[str | None] = []  # text, or None for a block's end; inline tags are empty text
    around: list[tuple[int, int, bool]] = []  # places of words and tags, how many words, whether a mark is around
    stack: list[str] = []
    skip = 0  # how many elements are open from the one on whose words are not content; 0 outside such ones
    marks = marked = apart = 0  # marks around; words inside marks, and in paragraphs outside them
    cached: dict[tuple[str, str], bool] = {}
    found = list(tokens(page))
    wrapping = wrappers(found) if any(kind == "open" and value in WRAPPERS for kind, value, _ in found) else set()
    for place, (kind, value, rest) in enumerate(found):
        if kind == "text":
            n = 0 if skip else len(value.split())
            marked += n * (marks > 0)
            apart += n * (not marks and "p" in stack[-1:])
            around.append((len(scores), n, marks > 0))
            scores.append(n and n * weights.words.get(stack[-1] if stack else "", WORD))
            pieces.append("" if skip else value)
            continue
        around.append((len(scores), 0, marks > 0))
        scores.append(LEAST_TAG if skip else weights.tags.get(value, TAG))
        pieces.append(None if value in BLOCKS else " " if value in ("td", "th") else "")
        if kind == "open":
            if value in VOID:
                continue
            key = (value, rest)
            if key not in cached:
                cached[key] = is_other(features(value, rest), weights.elements)
            stack.append(value)
            if skip:
                skip += 1
            elif cached[key] and place not in wrapping:
                skip = 1
            else:
                marks += value in CONTENT_TAGS
        elif value in stack:
            while True:
                last = stack.pop()
                if skip:
                    skip -= 1
                else:
                    marks -= last in CONTENT_TAGS
                if last == value:
                    break
    believed = marked > 0 and marked >= MARKED_SHARE * (marked + apart)
    for i, n, inside in around if believed else ():
        if not inside and n:
            scores[i], pieces[i] = max(weights.outside, LEAST_TAG), ""
        elif not inside or not n:
            scores[i] = LEAST_TAG
    first, last = best_region(scores)
    blocks, block = [], []
    for i in range(first, last + 1):
        piece = pieces[i] if i < last else None
        if piece is None:
            text = " ".join(html.unescape("".join(block)).split())
            blocks += [text] if text else []
            block = []
        else:
            block.append(piece)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text of each row; weights are learnt from the pages themselves if none are given."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(learn(pages) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                yield pa.record_batch({"page_id": part.column(0), "url": part.column(1), "text": pa.array([extract(x or "", sent.value) for x in part.column(2).to_pylist()], pa.string())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
