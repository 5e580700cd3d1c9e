"""Main text of web pages by site style trees (operator 10).

The DOMs of all pages of a host are merged into one tree: a node stands for a place (the tags and classes from the root),
with counts of its styles (the sequence of its children's tags) and of its contents. After Yi, Liu and Li (2003) a place
that looks and reads the same on all pages carries little: its importance is the entropy of its styles, and of contents
one minus the mean share of the pages' logarithm that a content repeats on; a branch has the weighted mean of what
is in it, on all levels. Branches of low importance are removed from each page, but none that holds an <article>, a
<main> or a text of its own importance. Pages that are alike but for what always goes count once a host.

What HTML itself names is not left to statistics, so hosts of one page work too: navigation, headers, footers, asides,
forms, scripts and elements named as what differs from page to page without being the page's text (adverts, comments,
related links) always go, outside <article> and <main> also those named as menus, notices or the like; but a name, or a form, never takes away a
branch that holds most of the page's paragraphs, unless it is readers' comments. Inside, such names
are a prior: the element goes unless its place is known to carry something, and headings and sections, whose ids are
made from their own words, are not judged by ids, nor is an article's own header by its name. A page with <article> or
<main> has its text there (unless paragraphs outside outweigh it) and in places outside that are known to carry something.
What is known of a place grows smoothly with the different pages that have it; where little is, tags and names decide. An
<article> or <main> that importance would empty stays as it is. All counting is by pre-aggregated sums over (host, place),
so a host with a third of all pages is no hot group; the list of removed places goes to the pages by a join that Spark
broadcasts only below its size limit.

Defined results: null and empty html give an empty text; pages of any length and depth take time in proportion; a null or odd url counts as a host of its own name; cut-off
tags, comments and scripts end with the page; repeated rows are each extracted; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, stored, table

#: Branches below LOW go, texts from HIGH on are known to carry something; both importances are drawn to the neutral side by
#: as much as PRIOR pages say, so that places which few different pages have are left to tags and names.
LOW, HIGH, PRIOR = 0.35, 0.5, 3
#: A page's text is not in its article or main if paragraphs outside have over so many times its characters.
OUTWEIGHED = 3
#: How much less a node counts for the branches that hold it, a level up.
FADE = 0.9

#: A quote opens a value only after an equals sign; elsewhere it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split())
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist"))}
NEVER = frozenset("head script style noscript template nav footer aside form iframe object svg canvas button select textarea input menu dialog title audio video map xmp noembed noframes search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|comments?|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|widget)(?=$|[\s_-])", re.I)
#: Names of what differs from page to page, so that importance can't tell it from the text.
VARIED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|breadcrumbs?|sidebar|comments?|disqus|respond|related|recommend\w*|pagination|pager)(?=$|[\s_-])", re.I)
#: Names that say nothing inside an article: its own header holds its title.
OWN = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
#: Elements whose ids are made from their headings' words.
SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of readers' comments, which may outweigh the page's own text.
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond)(?=$|[\s_-])", re.I)
MAIN = frozenset(("article", "main"))


class Node:
    __slots__ = ("tag", "parent", "place", "label", "gone", "never", "doubted", "main", "named", "children", "depth")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes and attributes != "/" else {}
        classes = f"{named.get('class', '')} {named.get('id', '')}".strip()
        self.label = f"{tag}.{classes.split()[0]}" if classes else tag
        above = parent.place if parent else 0
        self.place = xxhash.xxh3_64_intdigest(f"{above}/{self.label}".encode("utf-8", "surrogatepass")) >> 1
        role = named.get("role", "").lower()
        self.main = bool(parent and parent.main) or tag in MAIN or role == "main"
        inside = bool(parent and parent.main)
        words = named.get("class", "") if inside and tag in SLUGGED else classes
        judged = bool(words) and tag not in ("html", "body", "article", "main")
        #: Named as no part of the text, if its place isn't known to carry something.
        inner = OWN.sub(" ", words) if inside or tag in HEADINGS else words
        self.named = judged and inside and bool(NAMED.search(inner)) and not VARIED.search(inner)
        #: What goes whatever it holds, and what goes by its name or as a form unless most of the page's text is in it.
        self.never = bool(
            tag in NEVER and tag != "form" or tag == "header" and not inside or role in ROLES and role != "form" or "hidden" in named or named.get("aria-hidden") == "true"
            or judged and REMARKS.search(inner) or tag == "article" and classes and re.search(r"comment", classes, re.I)
        )
        self.doubted = not self.never and bool(tag == "form" or role == "form" or judged and not self.named and NAMED.search(inner))
        self.gone = False


def settle(events: list[tuple[int, object]]) -> None:
    """Decides what goes: elements that always do, and doubted ones that hold at most half of the page's paragraphs, or of its text where it has none; with them all inside."""
    held: dict[int, list[int]] = {}
    stack: list[Node] = []
    never = paragraphs = 0
    total = [0, 0]
    for kind, x in events:
        if kind == 1:
            if not never and (size := len(x) - x.count(" ")):
                for k in (0, 1) if paragraphs else (0,):
                    total[k] += size
                    for node in stack:
                        held[id(node)][k] += size
            continue
        step = 1 - kind
        never += step * x.never
        paragraphs += step * (x.tag == "p")
        if x.doubted and kind == 0:
            stack.append(x)
            held[id(x)] = [0, 0]
        elif x.doubted:
            stack.pop()
    k = 1 if total[1] else 0
    for kind, x in events:
        if kind == 0:
            x.gone = x.parent.gone or x.never or x.doubted and 2 * held[id(x)][k] <= total[k]


def parse(html: str) -> list[tuple[int, object]]:
    """(0, node) where an element opens, (1, text), (2, node) where it closes, in page order; references in texts are decoded."""
    root = Node("", None, "")
    events: list[tuple[int, object]] = []
    stack, at = [root], 0
    # The depths at which each tag is open, so that no search walks the stack.
    opened: dict[str, list[int]] = {}

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            events.append((2, stack.pop()))
            opened[events[-1][1].tag].pop()

    def deepest(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def nearest(tags, stops) -> int:
        found = deepest(tags)
        return found if found >= deepest(stops) else 0

    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            events.append((1, unescape(html[at:])))
            break
        if m.start() > at:
            events.append((1, unescape(html[at : m.start()])))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if i := nearest((tag,), ()):
                close_to(i)
            continue
        if tag in BLOCKS and (i := nearest(("p",), ("td", "th", "button", "object", "article", "main", "div", "section", "li", "body"))):
            close_to(i)
        if tag in CLOSED_BY:
            closes, stops = CLOSED_BY[tag]
            if i := nearest(closes.split(), stops):
                close_to(i)
        node = Node(tag, stack[-1], m[3])
        stack[-1].children.append(node.label)
        events.append((0, node))
        if tag in VOID:
            events.append((2, node))
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            events.append((2, node))
        else:
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
    close_to(1)
    settle(events)
    return events


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def main_text(html: str, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset(), told: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's main text; low: places whose branches are removed; high: places whose branches hold a text of importance; told: places whose own texts have it."""
    events = parse(html)
    has_main = _in_main(events)
    text, in_main = _blocks(events, has_main, low, high, told)
    if has_main and low and not in_main:
        text, _ = _blocks(events, has_main, low - {x.place for kind, x in events if kind == 0 and x.main}, high, told)
    return text


def _in_main(events: list[tuple[int, object]]) -> bool:
    """Whether the page has an article or main that its text is in: not one that paragraphs outside outweigh."""
    inside = outside = open_main = gone = open_p = 0
    for kind, x in events:
        if kind == 1:
            if not gone and open_main:
                inside += len(x)
            elif not gone and open_p:
                outside += len(x)
            continue
        step = 1 - kind
        open_main += step * x.main
        gone += step * (x.gone or x.named)
        open_p += step * (x.tag == "p")
    return inside > 0 and inside * OUTWEIGHED >= outside


def _blocks(events: list[tuple[int, object]], has_main: bool, low: frozenset[int], high: frozenset[int], told: frozenset[int]) -> tuple[str, bool]:
    """The blocks that stay, and whether any of their text is in an article or main."""
    blocks, run, gone, in_main = [], [], 0, False
    open_main = 0
    # Whether the text of each open element stays where it stands outside article and main.
    known = [not has_main]

    def flush() -> None:
        if run and (text := _squeeze("".join(run))):
            blocks.append(text)
        run.clear()

    for kind, x in events:
        if kind == 1:
            if not gone and (open_main or known[-1]):
                run.append(x)
                in_main = in_main or open_main > 0 and not x.isspace()
            continue
        if kind == 0 and x.tag in BLOCKS or kind == 2 and x.tag in BLOCKS:
            flush()
        elif x.tag == "br" and kind == 0:
            run.append(" ")
        out = x.gone or x.place in low or x.named and x.place not in high
        if kind == 0:
            gone += out
            open_main += x.main
            # Inline elements go with the block that they stand in.
            known.append(not has_main or x.place in told or known[-1] and x.tag not in BLOCKS)
        else:
            gone -= out
            open_main -= x.main
            known.pop()
    flush()
    return "\n".join(blocks), in_main


def style_rows(html: str) -> Counter:
    """Times of each (place, place above, kind, feature) of a page: kind 0 is a style, 1 a content; 2 is once for each place, 3 once for that of an outermost article or main.

    Elements that always go count for nothing.
    """
    out: Counter = Counter()
    stack: list[tuple[Node, list[str]]] = []
    for kind, x in parse(html):
        if kind == 0:
            stack.append((x, []))
        elif kind == 1:
            if stack:
                stack[-1][1].append(x)
        else:
            _, texts = stack.pop()
            if x.gone:
                continue
            key = (x.place, x.parent.place if x.parent.parent else None)
            style = "|".join(c for i, c in enumerate(x.children) if i == 0 or c != x.children[i - 1])
            out[(*key, 0, xxhash.xxh3_64_intdigest(style.encode("utf-8", "surrogatepass")) >> 1)] += 1
            if x.tag not in RAW and (text := _squeeze(" ".join(texts))):
                out[(*key, 1, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1)] += 1
            out[(*key, 2, 0)] = 1
            if x.main and not x.parent.main:
                out[(*key, 3, 0)] = 1
    return out


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")), "url", F.lit(""))))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, place, seen, importance, own, best, holds) of the merged trees of pages (host, html).

    seen: different pages that have the place; own: the importance of its own texts, 0 without; best: the highest importance of a text in the branch; holds: whether an
    article or main is in it.
    """
    keyed = pages.select("host", "html", F.xxhash64("host", "html").alias("page"))

    def digests(batch: pa.RecordBatch):
        found = [xxhash.xxh3_64_intdigest(repr(sorted(style_rows(h or "").items(), key=repr)).encode()) >> 1 for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("host"), pa.array(found, pa.int64())], names=["page", "host", "digest"])

    known = stored(arrow_map(keyed, digests, "page bigint, host string, digest bigint"), "page-digests")
    often = known.groupBy("host", "digest").agg(F.count("*").alias("copies")).filter("copies > 1")
    copies = stored(known.join(often, ["host", "digest"]).select("page", "copies").distinct(), "page-copies")

    def rows(batch: pa.RecordBatch):
        total: dict = {}
        for host, html, copies in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            for key, n in style_rows(html or "").items():
                key = (host, *key)
                total[key] = total.get(key, 0) + n / (copies or 1)
            if len(total) > 100_000:
                yield out(total)
                total = {}
        if total:
            yield out(total)

    def out(total: dict) -> pa.RecordBatch:
        host, place, above, kind, feature = zip(*total, strict=True)
        arrays = (pa.array(host, pa.string()), pa.array(place, pa.int64()), pa.array(above, pa.int64()), pa.array(kind, pa.int32()), pa.array(feature, pa.int64()), pa.array(list(total.values()), pa.float64()))
        return pa.RecordBatch.from_arrays(list(arrays), names=["host", "place", "above", "kind", "feature", "n"])

    found = arrow_map(keyed.join(copies, "page", "left").select("host", "html", "copies"), rows, "host string, place bigint, above bigint, kind int, feature bigint, n double")
    # The shares of a page's copies add up to one page.
    counts = found.groupBy("host", "place", "kind", "feature").agg(F.round(F.sum("n")).alias("n"), F.first("above").alias("above"))
    n = F.col("n")
    only = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(F.lit(0.0)))
    nodes = counts.groupBy("host", "place").agg(
        F.first("above").alias("up"),
        only(0, n).alias("m"),
        only(0, n * F.log(n)).alias("style_logs"),
        only(1, n).alias("texts"),
        only(1, n * F.log(n)).alias("text_logs"),
        only(2, n).cast("bigint").alias("seen"),
        F.max(F.col("kind") == 3).alias("holds"),
    )
    style = F.when(F.col("m") > 1, (F.log("m") - F.col("style_logs") / F.col("m")) / F.log("m")).otherwise(1.0)
    # The mean over occurrences of the logarithm of how often the same content occurs, against that of the pages.
    content = F.when(F.col("seen") > 1, F.greatest(F.lit(0.0), 1 - F.col("text_logs") / F.col("texts") / F.log("seen"))).otherwise(1.0)
    nodes = nodes.withColumn("own", F.when(F.col("texts") > 0, content).otherwise(style)).withColumn("size", F.when(F.col("texts") > 0, F.col("texts")).otherwise(0.01 * F.col("m")))
    best = F.when(F.col("texts") > 0, F.col("own")).otherwise(0.0)
    branches = _branches(nodes.select("host", "place", "up", "seen", (F.col("size") * F.col("own")).alias("carried"), "size", best.alias("own"), best.alias("best"), "holds"))
    return branches.select("host", "place", "seen", (F.col("carried") / F.col("size")).alias("importance"), "own", "best", "holds")


def _branches(nodes: DataFrame) -> DataFrame:
    """nodes (host, place, up, seen, carried, size, own, best, holds) with what is in their branches, on however many levels.

    Each round adds what the places 2^k levels below have gathered and doubles the levels, so a tree takes as many rounds
    as its depth has binary digits.
    """
    fade, nodes = FADE, stored(nodes, "branches")
    while not nodes.filter("up is not null").isEmpty():
        below = nodes.filter("up is not null").groupBy("host", F.col("up").alias("place")).agg(F.sum("carried").alias("more"), F.sum("size").alias("wider"), F.max("best").alias("better"), F.max("holds").alias("held"))
        higher = nodes.filter("up is not null").select("host", F.col("place").alias("up"), F.col("up").alias("next"))
        joined = nodes.join(below, ["host", "place"], "left").join(higher, ["host", "up"], "left")
        add = lambda a, b: F.col(a) + F.lit(fade) * F.coalesce(b, F.lit(0.0))  # noqa: E731, B023
        nodes = stored(joined.select("host", "place", F.col("next").alias("up"), "seen", add("carried", "more").alias("carried"), add("size", "wider").alias("size"), "own", F.greatest("best", "better").alias("best"), F.greatest("holds", "held").alias("holds")), "branches")
        fade *= fade
    return nodes


def judged_places(tree: DataFrame, low: float = LOW, high: float = HIGH, prior: float = PRIOR) -> DataFrame:
    """(host, low, high, told): the places of each host whose branches carry little and hold no article, main or important text, those that hold a text of importance, and those whose own texts have it."""
    seen = F.col("seen")
    below = lambda name: (F.col(name) * seen + prior) / (seen + prior) < low
    above = lambda name: F.col(name) * seen / (seen + prior) >= high
    is_low, is_high = below("importance") & below("best") & ~F.col("holds"), above("best")
    known = tree.filter(is_low | is_high)
    return known.groupBy("host").agg(F.collect_list(F.when(is_low, F.col("place"))).alias("low"), F.collect_list(F.when(is_high, F.col("place"))).alias("high"), F.collect_list(F.when(above("own"), F.col("place"))).alias("told"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    pages = with_host(pages.select("page_id", "url", "html"))
    judged = stored(judged_places(style_tree(pages)), "judged-places")
    joined = pages.join(judged, "host", "left")

    def rows(batch: pa.RecordBatch):
        texts, size, first = [], 0, 0
        known: dict[str, tuple[frozenset, ...]] = {}
        for i, (host, html, *judged) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), *map(batch.column, ("low", "high", "told")), strict=True)):
            if host not in known:
                known[host] = tuple(frozenset(places.as_py() or ()) for places in judged)
            texts.append(main_text(html or "", *known[host]))
            size += len(texts[-1])
            if size > 1 << 22 or i + 1 == batch.num_rows:
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(first, n), batch.column("url").slice(first, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                texts, size, first = [], 0, first + n

    return arrow_map(joined.select("page_id", "url", "host", "html", "low", "high", "told"), rows, "page_id bigint, url string, text string, n_chars bigint")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
