"""HTML main text by consensus host paths: pages score their containers, hosts vote on generalised tag-class paths, winning paths are extracted again."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidentia.llm.shared import materialize, python_workers
from evidentia.llm.url_filter import host_of

#: A path wins if it is the best one on at least this share of its host's pages, so a host has 1 / LEAST_SHARE winners at most.
LEAST_SHARE = 0.1
#: A winning path is taken on a page if it gives at least this share of the characters that the page's own best container gives.
LEAST_TEXT = 0.5
#: Up to so many winning paths (hosts times at most 10, about 100 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_PATHS = 200_000

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head nav menu header footer aside form dialog button select datalist script style template svg math canvas object audio video noscript textarea title xmp iframe noembed noframes option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
PARTS = frozenset("address blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre summary tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element of the first kind ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
# End of the fixed values.

#: Elements open at once, as browsers limit them: deeper ones are taken as part of the innermost. A path has at most STEPS steps.
DEPTH, STEPS = 512, 64
#: Words in the class or id of what is no article.
NOISE = frozenset(
    "nav navbar navigation menu menus header masthead footer foot sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments disqus replies respond widget widgets toolbar search skip copyright".split()
)
#: Words in the class or id of what may well be one.
ARTICLE = frozenset("article content main post entry story text body page blog".split())
_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?/][^>]*+>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(written: str) -> dict[str, str]:
    """Name -> value of an element's attributes; the first of one name counts."""
    out: dict[str, str] = {}
    if written and not written.isspace():
        for name, value in _ATTRIBUTE.findall(written):
            if value[:1] in "\"'":
                value = value[1:-1]
            out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def _noisy(names: list[str]) -> bool:
    """Whether a class or id names boilerplate: with its first or last word (ad-slot, site-footer), unless it says that something is or is not there."""
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in ("with", "has", "no", "without") and (words[0] in NOISE or words[-1] in NOISE):
            return True
    return False


class _Element:
    __slots__ = ("tag", "label", "path", "steps", "parent", "skip", "factor")

    def __init__(self, tag: str, label: str = "", parent: _Element | None = None, skip: bool = False, factor: float = 1.0):
        self.tag, self.label, self.parent, self.skip, self.factor = tag, label, parent, skip, factor
        # Inline elements, runs of equal labels and what lies very deep add nothing to a path.
        same = parent is not None and (tag in INLINE or label == parent.label or parent.steps >= STEPS)
        self.path = (parent.path if same else f"{parent.path}/{label}") if parent else ""
        self.steps = parent.steps + (not same) if parent else 0


def _open(tag: str, written: str, parent: _Element) -> _Element:
    a = _attributes(written)
    classes = a.get("class", "").split()
    names = [*classes, *([a["id"]] if "id" in a else [])]
    whole = tag in ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6")
    skip = parent.skip or tag in SKIPPED or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or bool(_HIDDEN.search(a.get("style", "")))
    skip = skip or (not whole and bool(names) and _noisy(names))
    # Digits and the order of classes tell pages of one template apart, not templates.
    kinds = sorted({k for c in classes if (k := re.sub(r"\d+", "", c.lower()).strip("-_"))})
    factor = 3.0 if tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody" else 1.5 if any(w.lower() in ARTICLE for n in names for w in _WORD.findall(n)) else 1.0
    return _Element(tag, ".".join([tag, *kinds]), parent, skip, factor)


def blocks(page: str) -> list[tuple[_Element, str, int]]:
    """(element, text, characters in links) of each text block of a page, boilerplate left out, in page order.

    A block is the text between two tags that are not inline: character references decoded, white space turned into one blank, trimmed. Its element is the
    innermost one, inline ones aside, that holds it. Elements left open are closed as browsers do in the common cases: by what may not stand inside them,
    by an end tag of an outer element, or by the end of the page. Text after the last > that opens like a tag is not text.
    """
    root = _Element("")
    stack, out, held, links = [root], [], [], 0
    anchors, unheld, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            owner = next(e for e in reversed(stack) if e.tag not in INLINE)
            if text and not owner.skip:
                out.append((owner, text, min(links, len(text))))
            links = 0

    def close(to: int) -> None:
        nonlocal anchors
        for e in stack[to:]:
            anchors -= e.tag == "a"
        del stack[to:]

    last = page.rfind(">") + 1
    while at < n:
        m = _TAG.search(page, at, last)
        end = m.start() if m else n
        if end > at and not stack[-1].skip:
            text = page[at:end]
            if not m and (cut := re.search(r"<(?:!--|[/!?]?[a-zA-Z])", text)):
                text = text[: cut.start()]
            held.append(html.unescape(text) if "&" in text else text)
            if anchors:
                links += len(text)
        if not m:
            break
        at = m.end() if m[1] is None or m[0].endswith("-->") else n
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            if unheld:
                unheld -= 1
                flush()
                continue
            if tag == "p" and not any(e.tag == "p" for e in stack) or tag == "br":
                flush()
                continue
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # An inline end tag closes no block, so <b> left open in one paragraph does not end where another one's does.
            if place and not (tag in INLINE and any(e.tag not in INLINE for e in stack[place + 1 :])):
                if any(e.tag not in INLINE for e in stack[place:]):
                    flush()
                close(place)
            elif tag not in INLINE:
                flush()
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
                if place and all(e.tag in INLINE for e in stack[place + 1 :]):
                    close(place)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES.get(tag, {"table"}) or tag not in CLOSES:
                    break
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
        if tag in VOID:
            continue
        written = m[4] if m[3] else m[7]
        if tag in RAW:
            ends = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = ends.end() if ends else n
            continue
        if tag in ("svg", "math") and (written or "").endswith("/"):
            continue
        if len(stack) >= DEPTH:
            unheld += 1
            continue
        stack.append(_open(tag, written or "", stack[-1]))
        anchors += tag == "a"
    flush()
    return out


def scored(found: list[tuple[_Element, str, int]]) -> dict[str, float]:
    """Path -> score of a page's containers: a block counts its characters outside links for the element that holds it, half for the next, then a quarter.

    A paragraph, heading or the like is not a container itself. Blocks that are mostly links count nothing. Elements that say they are the article count
    threefold, those that are named like one one and a half times. Scores of elements with equal paths are added up.
    """
    out: dict[str, float] = {}
    for element, text, links in found:
        value = float(len(text) - 2 * links)
        if value <= 0:
            continue
        e = element
        while e.tag in PARTS or e.tag in INLINE:
            e = e.parent
        while e is not None and value >= 1:
            out[e.path] = out.get(e.path, 0.0) + value * e.factor
            e, value = e.parent, value / 2
    return out


def best_path(found: list[tuple[_Element, str, int]]) -> str | None:
    """The path with the highest score; of equal ones the longer, then the smaller. None if no block scores."""
    scores = scored(found)
    return min(scores, key=lambda p: (-scores[p], -len(p), p)) if scores else None


def text_of(found: list[tuple[_Element, str, int]], path: str) -> str:
    """The blocks inside elements of ``path``, joined by one blank."""
    def inside(e: _Element | None) -> bool:
        while e is not None and e.path != path:
            e = e.parent
        return e is not None

    return " ".join(t for e, t, _ in found if inside(e))


def votes(pages: DataFrame, host: Column, page: str = "html") -> DataFrame:
    """(host, path, pages, score): on how many pages of its host each path is the best, and its score there. Combined before the exchange."""
    python_workers(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = [], []
            for x in batch.column(1).to_pylist():
                s = scored(blocks(x or ""))
                p = min(s, key=lambda p: (-s[p], -len(p), p)) if s else None
                paths.append(p)
                scores.append(int(s[p]) if p is not None else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    best = pages.select(host.alias("host"), F.col(page).cast("string").alias("page")).mapInArrow(run, "host string, path string, score long")
    return best.filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("score"))


def winning_paths(counted: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(host, paths): the paths with at least ``least`` of their host's votes, most votes first; of equal ones the higher score, then the smaller path."""
    counted = materialize(counted, "votes")
    totals = counted.groupBy("host").agg(F.sum("pages").alias("all"))
    won = counted.join(totals, "host").filter(F.col("pages") >= least * F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("p"), (-F.col("score")).alias("s"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text", least: float = LEAST_SHARE) -> DataFrame:
    """``pages`` with ``out``, the main text of each page, and n_chars, its code points, in place of ``page``.

    Every page is parsed, its containers are scored, and its best one's path (tags and classes, without digits) is its vote. Each page is then extracted by
    the first of its host's winning paths that it has with enough text, else by its own best. Menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, hidden parts and comments are left out wherever they stand. A null or empty page, or one without text of its own, gives ''. A null url,
    or one without ://, counts for the host ''. Columns of ``pages`` named like the outputs are replaced. Pages are read twice and exchanged never:
    only votes are, and a host has few winners, so a host with a third of all pages is no hot spot.
    """
    spark = pages.sparkSession
    python_workers(spark)
    won = materialize(winning_paths(votes(pages, host_of(F.col(url)), page), least), "winning-paths")
    small = won.count() <= BROADCAST_PATHS
    rest = [c for c in pages.columns if c not in (out, "n_chars", page)]
    keyed = pages.select(F.struct(*rest).alias("_row"), F.col(page).cast("string").alias("_page"), host_of(F.col(url)).alias("host"))
    keyed = keyed.join(F.broadcast(won) if small else won, "host", "left").select("_row", "paths", "_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for paths, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = blocks(x or "")
                own = best_path(found)
                best = text_of(found, own) if own is not None else " ".join(t for _, t, _ in found)
                taken = (t for p in paths or () if len(t := text_of(found, p)) >= max(1, LEAST_TEXT * len(best)))
                texts.append(next(taken, best))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_text"])

    schema = keyed.select("_row").schema.add("_text", "string")
    done = keyed.mapInArrow(run, schema)
    return done.select(*(F.col("_row")[c].alias(c) for c in rest), F.col("_text").alias(out), F.length("_text").cast("long").alias("n_chars"))
