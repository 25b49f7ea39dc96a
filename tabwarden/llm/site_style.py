"""HTML extraction by a site style tree.

The pages of a host are merged into one tree: nodes with the same path of tags and
classes are one element. What a page shows in an element are its features: texts,
their phrases and the targets of links. Two statistics are counted over the m pages
that have an element:

* content: one less the mean of log_m(pages with the feature) over its features. What
  one page has is content, what all have is furniture. A heading counts with what
  it heads.
* presentation: for an element with children, the entropy, to the base m, of the
  sequences of children it has. Furniture looks alike on all pages.

A leaf is a block of text. Its importance joins its content with its parent's
presentation, and is raised a little inside a marked article. A branch is an element
that markup calls furniture, by its tag (nav, footer, form and the like) or by a word
of its classes, id or role, unless it holds the page's article. Its content counts a
feature once for each page that shows it, its presentation is its own, and the mark
takes a fixed part of its importance: most where nothing else speaks for it, none of
it for good. Leaves and branches of low importance are removed from every page, inside
an article as outside. Hosts of too few pages tell nothing; the marks decide there.

Scripts, styles, heads, embedded objects and hidden elements show no text and take no part.

The statistics are counts by host, path and feature, which combine before the shuffle,
so a host with a third of all pages is no hot group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import staged

#: Pages a host needs before its tree tells anything.
LEAST_PAGES = 5
#: Importance below which an element is removed, and the weight of content in a leaf's and a branch's.
LEAST_IMPORTANCE = 0.3
CONTENT_WEIGHT = 0.9
BRANCH_CONTENT_WEIGHT = 0.5
#: What standing in a marked article adds to an importance. Text on every page has at
#: most 1 - CONTENT_WEIGHT, so it stays below the least one also there.
ARTICLE_RAISE = 0.1
#: What a name and a tag of furniture take from an importance. A named branch stays from
#: 0.75 on, one with such a tag from 0.9 on.
NAME_COST = 0.45
TAG_COST = 0.6
#: Low elements (16 bytes each) that are broadcast at most; beyond it they are joined.
BROADCAST_ROWS = 500_000

# Elements by their role in HTML, and words that name furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("head style script noscript template iframe svg textarea input object canvas audio video map title".split())
FURNITURE = frozenset("nav footer aside form button select option label dialog menu fieldset".split())
#: Furniture unless it stands inside the article.
PAGE_FURNITURE = frozenset(["header"])
ARTICLE = frozenset(["article", "main"])
FURNITURE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted recommended related reply replies share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Elements that head what follows them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt caption figcaption summary".split())
#: Elements that a start tag of the same kind closes.
CLOSED_BY = {
    "li": frozenset(["li"]), "p": BLOCKS - {"br"}, "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HREF = re.compile(r"(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Ends of phrases: marks before white space, and dots, bars and marks that need none.
_PHRASE_END = re.compile(r"[.!?;:,]+\s|[\u00b7\u2022|\u3001\u3002\uff01\uff0c\uff1f]")


#: Leads the path of a branch, by what marks it.
NAMED = "named "
TAGGED = "tagged "


class Block(NamedTuple):
    """A block of text: its path, its parent's path, the targets of its links, and
    what markup says of it: ``marks`` are the branches around it, outermost first, as
    their paths led by ``NAMED`` or ``TAGGED``."""

    path: str
    parent: str
    text: str
    links: tuple[str, ...]
    marks: tuple[str, ...]
    article: bool


class _Element:
    __slots__ = ("tag", "path", "unseen", "article", "tagged", "marked", "children", "holds_main", "holds_article")

    def __init__(self, tag: str, path: str, unseen: bool, article: bool, tagged: bool = False, marked: tuple[_Element, ...] = ()) -> None:
        self.tag, self.path, self.unseen, self.article = tag, path, unseen, article
        #: Whether its own tag says furniture, and the elements from the page's root to it that are marked so.
        self.tagged, self.marked = tagged, marked
        self.children: list[str] = []
        self.holds_main = self.holds_article = False


def _named(attributes: str) -> tuple[str, bool, bool, bool]:
    """The sign of an element in its path (its classes, without numbers), whether
    its names or role say furniture, whether it is hidden, and whether its role is main."""
    sign, names, hidden, main = [], False, False, False
    known = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden") or name in known:
            continue
        known.add(name)
        value = unescape(next((v for v in values if v), "")).lower()
        if name in ("class", "id"):
            sign += _NAME.findall(value)
            names = names or not FURNITURE_NAMES.isdisjoint(value.split())
        elif name == "role":
            names = names or value.strip() in FURNITURE_ROLES
            main = value.strip() == "main"
        else:
            hidden = hidden or name == "hidden" or value.strip() == "true"
    return ".".join(sorted(set(sign))), names, hidden, main


def parse(html: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Blocks in page order, and for each element with children its path and the
    sequence of its children. Broken markup is read as far as it goes: unknown end
    tags are ignored and open elements end with what holds them."""
    root = _Element("", "", False, False)
    stack, styles = [root], []
    found_blocks: list[tuple[Block, tuple[_Element, ...]]] = []
    free_article = False  # whether an article stands in nothing that names furniture
    said: list[str] = []
    links: list[str] = []
    at, n = 0, len(html)

    def flush() -> None:
        if said:
            text = _SPACE.sub(" ", "".join(said)).strip()
            to = tuple(links)
            said.clear()
            links.clear()
            if text:
                # Inline elements do not make a path.
                holder = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
                k = stack.index(holder)
                parent = next((e for e in reversed(stack[:k]) if e.tag in BLOCKS), root)
                found_blocks.append((Block(holder.path, parent.path, text, to, (), holder.article), stack[-1].marked))

    def close(k: int) -> None:
        for element in stack[k:]:
            if element.children:
                # A run of equal children counts as one, else each length were a style.
                runs = [c for i, c in enumerate(element.children) if not i or element.children[i - 1] != c]
                styles.append((element.path, " ".join(runs)))
        del stack[k:]

    while at < n:
        found = _TAG.search(html, at)
        end = found.start() if found else n
        if end > at and not stack[-1].unseen:
            said.append(unescape(html[at:end]))
        if not found:
            break
        at = max(found.end(), end + 1)
        tag = (found.group(2) or "").lower()
        if not tag:
            if found.group().startswith("<![CDATA[") and not stack[-1].unseen:
                said.append(found.group()[9:].removesuffix("]]>"))
            continue
        if found.group(1):
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag not in BLOCKS and any(e.tag in BLOCKS for e in stack[k + 1 :]):
                        break  # an inline end tag does not end a block
                    if stack[-1].unseen != stack[k - 1].unseen or stack[-1].marked != stack[k - 1].marked or any(e.tag in BLOCKS for e in stack[k:]):
                        flush()
                    close(k)
                    break
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        while len(stack) > 1 and (shut := CLOSED_BY.get(next((e.tag for e in reversed(stack) if e.tag in BLOCKS), ""), ())) and tag in shut:
            k = max(i for i, e in enumerate(stack) if e.tag in BLOCKS)
            close(k)
        up = stack[-1]
        sign, names, hidden, main = _named(found.group(3))
        mark = f"{tag}.{sign}" if sign else tag
        if main:
            mark += "@main"  # so that a path tells whether it is an article's
        names, hidden = (said_so and tag not in ("html", "body") for said_so in (names, hidden))
        unseen = hidden or tag in UNSEEN
        tagged = tag in FURNITURE or (tag in PAGE_FURNITURE and not up.article)
        path = f"{up.path}>{mark}" if tag in BLOCKS or unseen or tagged or names or main else up.path
        element = _Element(tag, path, up.unseen or unseen, up.article or tag in ARTICLE or main, tagged, up.marked)
        if (unseen and not up.unseen or tagged or names) and tag not in BLOCKS:
            flush()
        if tagged or names:
            element.marked += (element,)
        if (tag in ARTICLE or main) and not element.unseen and not any(e.tagged for e in element.marked):
            for around in element.marked:
                around.holds_main |= tag != "article"
                around.holds_article = True
            free_article = free_article or tag == "article" and not element.marked
        if tag == "a" and not element.unseen and (target := _HREF.search(found.group(3))):
            links.append(next((v for v in target.groups() if v), ""))
        if tag in BLOCKS:
            up.children.append(mark)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        if not found.group(3).rstrip().endswith("/") or tag in BLOCKS:
            stack.append(element)
    flush()
    close(1)

    def mark_of(element: _Element) -> str:
        """Its mark as a branch; none if it is named only, but holds the article."""
        if element.tagged:
            return TAGGED + element.path
        spared = element.holds_main or element.holds_article and not free_article
        return "" if spared else NAMED + element.path

    blocks = [b._replace(marks=tuple(filter(None, map(mark_of, marked)))) for b, marked in found_blocks]
    return blocks, styles


def _hash(*parts: str) -> int:
    """A 64-bit hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """The host of an address, in lower case; none if it has none."""
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _deciding(block: Block) -> tuple[str, ...]:
    """The elements that decide on a block: its branches or, if it has none, its leaf."""
    return block.marks or (block.path,)


def _content(blocks: list[Block], k: int) -> str:
    """The text by which a block is judged. A heading is what it heads, the next block
    beside it that is none: the same headings on all pages stay if those differ."""
    block = blocks[k]
    is_heading = lambda b: b.path.rsplit(">", 1)[-1].split(".")[0].removesuffix("@main") in HEADINGS
    if is_heading(block):
        for other in blocks[k + 1 :]:
            if other.path != block.parent and not other.path.startswith(f"{block.parent}>"):
                break
            if not is_heading(other):
                return other.text
    return block.text


def _shown(blocks: list[Block], k: int) -> set[str]:
    """The features of a block: its text, the phrases of it, and where its links go."""
    text = _content(blocks, k)
    phrases = {p for p in map(str.strip, _PHRASE_END.split(text)) if p}
    return phrases | {text} | {f"\0{target}" for target in blocks[k].links}


#: Kinds of features: the page has the element, a feature, a sequence of children, and
#: features in a marked article, a named branch and a tagged branch.
_HAS, _SHOWS, _LOOKS, _IN_ARTICLE, _IN_NAMED, _IN_TAGGED = range(6)


def _features(pages: DataFrame) -> DataFrame:
    """``element, parent, feature, kind``: the distinct features of each page."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: list[tuple[int, int, int]] = []
            sizes: list[int] = []
            features: list[str] = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                host = host_of(url)
                blocks, styles = parse(html or "")
                branches = {mark for b in blocks for mark in b.marks}
                seen: dict[tuple[str, str, int], set[str]] = {}  # by path, parent's path and kind
                for k, b in enumerate(blocks):
                    shown = _shown(blocks, k)
                    for mark in b.marks:
                        # The blocks of a branch have different parents; its own look counts.
                        seen.setdefault((mark, "", _HAS), {""})
                        seen.setdefault((mark, "", _IN_NAMED if mark.startswith(NAMED) else _IN_TAGGED), set()).update(shown)
                    if not b.marks:
                        seen.setdefault((b.path, b.parent, _HAS), {""})
                        seen.setdefault((b.path, b.parent, _IN_ARTICLE if b.article else _SHOWS), set()).update(shown)
                for path, style in styles:
                    for key in (path, NAMED + path, TAGGED + path):
                        if key == path or key in branches:
                            seen.setdefault((key, "", _HAS), {""})
                            seen.setdefault((key, "", _LOOKS), set()).add(style)
                hashed = {path: _hash(host, path) for key in seen for path in key[:2]}
                for (path, parent, kind), own in seen.items():
                    keys.append((hashed[path], hashed[parent], kind))
                    sizes.append(len(own))
                    features += own
            told = pd.DataFrame(keys, columns=["element", "parent", "kind"]).loc[np.repeat(np.arange(len(keys)), sizes)]
            # One call hashes the features of a batch, the same in every process.
            hashes = pd.util.hash_array(np.array(features, object), categorize=False).view(np.int64)
            yield told.assign(feature=hashes)[["element", "parent", "feature", "kind"]]

    return pages.select("url", "html").mapInPandas(run, "element long, parent long, feature long, kind int")


def importances(pages: DataFrame) -> DataFrame:
    """``element`` (hash of host and path), ``branch``, ``told`` and ``importance`` of
    the leaves and branches that their hosts' trees can tell of: ``told`` is what the
    tree tells, ``importance`` what marks make of it."""
    counts = _features(pages).groupBy("element", "parent", "feature", "kind").count()
    n, log_n, kind = F.col("count"), F.log("count"), F.col("kind")
    is_feature, is_look = kind.isin(_SHOWS, _IN_ARTICLE, _IN_NAMED, _IN_TAGGED), kind == _LOOKS
    # Sums by element combine before the shuffle; joining its features with its pages
    # would bring all texts of a large host's element to one task.
    sums = counts.groupBy("element").agg(
        F.max(F.when(kind == _HAS, n)).alias("m"),
        F.max(F.when(is_feature, F.col("parent"))).alias("parent"),
        F.max(kind == _IN_ARTICLE).alias("article"),
        F.max(kind == _IN_NAMED).alias("named"),
        F.max(kind == _IN_TAGGED).alias("tagged"),
        F.avg(F.when(is_feature, log_n)).alias("features"),
        F.sum(F.when(is_feature, n)).alias("showings"),
        F.sum(F.when(is_feature, n * log_n)).alias("showing_logs"),
        F.sum(F.when(is_look, n)).alias("looks"),
        F.sum(F.when(is_look, n * log_n)).alias("look_logs"),
    )
    log_m, branch = F.log("m"), F.col("named") | F.col("tagged")
    found = staged(
        sums.filter(F.col("m") >= LEAST_PAGES).select(
            "element",
            "parent",
            "article",
            "tagged",
            branch.alias("branch"),
            # A leaf's features count once each, so that copies of a page say little against it.
            (1 - F.when(branch, F.col("showing_logs") / F.col("showings")).otherwise(F.col("features")) / log_m).alias("content"),
            # The sum of -(n / m) log_m(n / m) over the sequences of children.
            ((F.col("looks") * log_m - F.col("look_logs")) / (F.col("m") * log_m)).alias("look"),
        ),
        "style-elements",
    )
    parents = found.filter("look IS NOT NULL AND NOT branch").select(F.col("element").alias("parent"), F.col("look").alias("around"))
    leaves = found.filter("content IS NOT NULL AND NOT branch").join(parents, "parent", "left")
    told_leaf = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.coalesce("around", F.lit(1.0))
    raised = F.col("told") + F.when(F.col("article"), ARTICLE_RAISE).otherwise(0.0)
    # A branch without elements below it looks alike everywhere.
    told_branch = BRANCH_CONTENT_WEIGHT * F.col("content") + (1 - BRANCH_CONTENT_WEIGHT) * F.coalesce("look", F.lit(0.0))
    lowered = F.col("told") - F.when(F.col("tagged"), TAG_COST).otherwise(NAME_COST)
    columns = "element", "branch", "told"
    judged_leaves = leaves.withColumn("told", told_leaf).select(*columns, raised.alias("importance"))
    branches = found.filter("branch").withColumn("told", told_branch).select(*columns, lowered.alias("importance"))
    return judged_leaves.unionByName(branches)


def low_elements(pages: DataFrame) -> DataFrame:
    """``element`` of the leaves of low importance, and of the branches whose
    importance is not low: these stay though marks say furniture."""
    return importances(pages).filter(F.col("branch") != (F.col("importance") < LEAST_IMPORTANCE)).select("element").distinct()


def decisions(pages: DataFrame) -> DataFrame:
    """``decided, removed, blocks``: what decides on how many blocks of all pages.

    ``leaf`` and ``branch`` are decided by the tree, whose importance marks do not
    move over the least one; ``mark`` by a mark that does, and ``few pages`` by marks
    alone. A block with several branches counts for the least important one."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, (url, html) in zip(batch["page"], zip(batch["url"], batch["html"], strict=True), strict=True):
                for k, b in enumerate(parse(html or "")[0]):
                    rows += [(page, k, _hash(host_of(url), path), bool(b.marks)) for path in _deciding(b)]
            yield pd.DataFrame(rows, columns=["page", "block", "element", "branch"])

    numbered = pages.select(F.monotonically_increasing_id().alias("page"), "url", "html")
    blocks = numbered.mapInPandas(run, "page long, block int, element long, branch boolean")
    known = importances(pages).select("element", "told", "importance")
    least = F.min_by(F.struct("told", "importance"), F.coalesce("importance", F.lit(-1.0)))
    judged = blocks.join(known, "element", "left").groupBy("page", "block", "branch").agg(least.alias("by"))
    low, alone = F.col("by.importance") < LEAST_IMPORTANCE, F.col("by.told") < LEAST_IMPORTANCE
    by_tree = F.when(F.col("branch"), "branch").otherwise("leaf")
    decided = F.when(low.isNull(), "few pages").when(low == alone, by_tree).otherwise("mark").alias("decided")
    return judged.groupBy(decided, F.coalesce(low, F.col("branch")).alias("removed")).agg(F.count(F.lit(1)).alias("blocks"))


def main_text(blocks: list[Block], low) -> str:
    """The text of a page. ``low`` says of a leaf whether it is removed, and of a
    branch whether it stays. A page of which nothing would be left, a copy of all
    others, keeps its article."""
    kept = [b for b in blocks if (all(map(low, b.marks)) if b.marks else not low(b.path))]
    kept = kept or [b for b in blocks if b.article and not b.marks]
    return "\n".join(b.text for b in kept)


def _elements(pages: DataFrame) -> DataFrame:
    """``page, element``: elements of each page that a host's tree may remove."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, _hash(host_of(url), path))
                for page, url, html in zip(batch["page"], batch["url"], batch["html"], strict=True)
                for path in {path for b in parse(html or "")[0] for path in _deciding(b)}
            ]
            yield pd.DataFrame(rows, columns=["page", "element"])

    return pages.mapInPandas(run, "page long, element long")


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, text`` of every page.

    A null html is empty, and an empty page's text is empty. Pages whose address
    has no host, or is null, are one host. Character references are decoded, white
    space inside a block is one space, blocks are joined by line ends; ``br`` ends a
    block. Repeated rows are all returned and count as pages of their host; other
    columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    low = staged(low_elements(pages), "low-elements")
    few = [r.element for r in low.limit(broadcast_rows + 1).collect()]
    if len(few) <= broadcast_rows:
        shared = spark.sparkContext.broadcast(np.sort(np.array(few, np.int64)))

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = set(shared.value.tolist())
            for batch in batches:
                texts = []
                for url, html in zip(batch["url"], batch["html"], strict=True):
                    host = host_of(url)
                    texts.append(main_text(parse(html or "")[0], lambda path, h=host: bool(known) and _hash(h, path) in known))
                yield batch[["page_id", "url"]].assign(text=texts)

        return pages.select("page_id", "url", "html").mapInPandas(run, kinds)

    # Too many to broadcast: each page is sent the low ones of its own elements.
    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("page"))
    named = _elements(keyed.select("page", "url", "html")).distinct().join(low, "element")
    lists = named.groupBy("page").agg(F.collect_list("element").alias("low"))

    def run_listed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for url, html, own in zip(batch["url"], batch["html"], batch["low"], strict=True):
                host, known = host_of(url), set() if own is None else set(own)
                texts.append(main_text(parse(html or "")[0], lambda path, h=host, k=known: _hash(h, path) in k))
            yield batch[["page_id", "url"]].assign(text=texts)

    return keyed.join(lists, "page", "left").select("page_id", "url", "html", "low").mapInPandas(run_listed, kinds)
