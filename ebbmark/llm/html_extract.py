"""Main text of web pages by paths that the pages of a host agree on.

A page is read as blocks: runs of text between block tags, each with the path of its containers (tags with their
classes, digits taken out). Menus, headers, footers, forms, scripts, styles and the like are left out by tag and role. A class
or id that says nothing but sidebar, notice, advert or comment leaves its container out too. One that has such a word beside
others only puts it under suspicion: it is left out unless it holds most of the text without links (of the article or main
element's, where the page has one), as the wrappers do that themes name after what stands in or beside them. Elements
deeper than DEEPEST count as part of the one at that depth. Each container of a page is scored by the text of its blocks
without links; the best one is widened to hold what lies beside it and has much text with few links, unless it is in an
article or main element. Its path is the page's vote, and votes are summed by host in Spark. In a second pass each page is
extracted by the path among its host's winners that it holds, or else by its own best path.

Null html counts as empty; a page without text has an empty text. Repeated rows give equal texts; pages are read whole, in
time linear in their length. Null urls form one host. Votes are pre-aggregated, so a
host of any size is only a few rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrays, map_batches, text_of, written

#: A path wins for a host with this share of the best path's votes.
SHARE = 0.2
#: Text beside a container belongs to it from this share of the container's text, or from so many characters.
BESIDE, BESIDE_CHARACTERS = 0.1, 140
#: A container under suspicion stays if it holds this share of the text without links.
MOSTLY = 0.5
#: Nesting up to which elements are told apart.
DEEPEST = 200
#: Winning paths are broadcast up to so many characters in all; beyond, they are joined.
MOST_BROADCAST = 4 << 20

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article aside blockquote body center dd details div dl fieldset figure footer form header main nav ol section table tbody td tr ul".split())
LEFT_OUT = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe input label math menu nav noscript object script search select style svg template textarea title video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "thead": {"caption"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())

#: Words in classes and ids that put a container under suspicion: a choice.
UNWANTED = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies gdpr footer foot header masthead menu menus nav navbar navigation newsletter notice notices alert popup modal overlay promo promoted promotion recommended related sidebar share sharing social sponsor sponsored sponsors subscribe subscription signup login toolbar widget widgets pagination pager skip disclaimer".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|aria-label|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?![\w-]))")
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[\d]+")


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    doubts: tuple[int, ...] = ()  # numbers of the containers under suspicion around it
    article: bool = False  # whether it is in an article or main element


def unescaped(text: str) -> str:
    """With character references decoded; quickly where all are of the four commonest kinds."""
    n = text.count("&")
    if not n:
        return text
    if n == text.count("&amp;") + text.count("&lt;") + text.count("&gt;") + text.count("&quot;"):
        return text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
    return html.unescape(text)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source and "=" in source or "hidden" in source else {}


def _left_out(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden") == "true" or "hidden" in attributes:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    return any(words and words <= UNWANTED for words in _names(attributes))


def _names(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each class and of the id."""
    return [{w.lower() for w in _PARTS.split(name) if w} for source in ("class", "id") for name in attributes.get(source, "").split()]


def _doubtful(tag: str, attributes: dict[str, str]) -> bool:
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return any(not words.isdisjoint(UNWANTED) for words in _names(attributes))


def _name(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("", c) for c in attributes.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


def blocks(source: str, rough: bool = False) -> list[Block]:
    """The wanted text of a page in order. rough: as it stands, for its length alone."""
    out: list[Block] = []
    # Tag; its name in the path if it is a container; whether it is an article or main element; its number if it is under suspicion.
    stack: list[tuple[str, str | None, bool, int | None]] = []
    path: tuple[str, ...] = ()
    doubts: tuple[int, ...] = ()
    words: list[str] = []
    open_: Counter[str] = Counter()  # open elements by tag
    dropped, links, linked, at, articles, number, deeper = 0, 0, 0, 0, 0, 0, 0  # open elements above which all is left out; open links; characters in links; ..; elements below DEEPEST

    def flush() -> None:
        nonlocal linked
        if words:
            text = "".join(words)
            text = text.strip() if rough else " ".join(text.split())
            if text:
                out.append(Block(path, text, linked, doubts, articles > 0))
            words.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            text = raw if rough else unescaped(raw)
            words.append(text)
            if links:
                linked += len(text)

    def close(depth: int) -> None:
        nonlocal path, dropped, links, articles, doubts
        for tag, name, article, doubt in reversed(stack[depth:]):
            if tag in BLOCK and not dropped:
                flush()
            if name is not None:
                path = path[:-1]
            if doubt is not None:
                doubts = doubts[:-1]
            links -= tag == "a"
            articles -= article
            open_[tag] -= 1
        del stack[depth:]
        if dropped and len(stack) < dropped:
            dropped = 0

    def open_at(tags: set[str], scope: set[str]) -> int | None:
        if not any(open_[t] for t in tags):
            return None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in scope:
                return None
        return None

    while m := _TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            if deeper and tag in CONTAINER:  # closes an element that wasn't told apart
                deeper -= 1
                if not dropped:
                    flush()
                continue
            k = open_at({tag}, {"table", "td", "th"} if tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html") else set())
            if k is not None:
                close(k)
            elif tag in BLOCK and not dropped:
                flush()
            if tag == "br" and not dropped:
                words.append(" ")
            continue
        if tag in RAW and tag not in ("plaintext",):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID:
            if tag == "hr" and not dropped:
                flush()
            elif tag == "br" and not dropped:
                words.append(" ")
            continue
        if tag in CLOSES and (k := open_at(CLOSES[tag], SCOPE[tag])) is not None:
            close(k)
        elif tag in BLOCK and (k := open_at({"p"}, CONTAINER | {"li", "td", "th", "button"})) is not None:
            close(k)
        if tag in BLOCK and not dropped:
            flush()
        attributes = _attributes(m[3] or m[6] or "")
        left_out = not dropped and _left_out(tag, attributes, articles > 0)
        if len(stack) >= DEEPEST and not left_out:
            deeper += tag in CONTAINER
            continue
        name = _name(tag, attributes) if tag in CONTAINER and not dropped else None
        doubt = None
        if not dropped and not left_out and _doubtful(tag, attributes):
            doubt = number = number + 1
            doubts = (*doubts, doubt)
        article = tag in ("article", "main")
        stack.append((tag, name, article, doubt))
        open_[tag] += 1
        if name is not None:
            path = (*path, name)
        links += tag == "a"
        articles += article
        if left_out:
            dropped = len(stack)
    say(source[at:])
    if not dropped:
        flush()
    return _cleared(out)


def _worth(b: Block) -> float:
    return max(0.0, len(b.text) - 2.0 * b.linked)


def _cleared(found: list[Block]) -> list[Block]:
    """Without the blocks of containers under suspicion that hold less than MOSTLY of the text around them. From the outside in: what one holds is weighed against what its container keeps."""
    if not any(b.doubts for b in found):
        return found
    held: Counter[tuple[int, ...]] = Counter()
    article = any(b.article and _worth(b) for b in found)
    for b in found:
        if article and not b.article:
            held[b.doubts] += 0
            continue
        for k in range(len(b.doubts) + 1):
            held[b.doubts[:k]] += _worth(b)
    kept: dict[tuple[int, ...], bool] = {(): True}
    for doubts in sorted({b.doubts[:k] for b in found for k in range(1, len(b.doubts) + 1)}, key=len):
        kept[doubts] = kept[doubts[:-1]] and held[doubts] > MOSTLY * held[doubts[:-1]]
    return [b for b in found if kept[b.doubts]]


def best_path(found: list[Block]) -> tuple[str, float]:
    """The path of the container that holds the main text, and its score; the path is empty for a page without text."""
    direct: dict[tuple[str, ...], float] = {}
    total: dict[tuple[str, ...], float] = {}
    here: dict[tuple[str, ...], tuple[float, float]] = {}  # worth and length of the blocks right in a container
    for b in found:
        worth = _worth(b) + 1
        a, n = here.get(b.path, (0.0, 0.0))
        here[b.path] = a + worth, n + len(b.text)
    for path, (worth, _) in here.items():  # each path once, whatever its number of blocks
        for back, part in enumerate((1.0, 0.5)):
            if len(path) > back:
                up = path[: len(path) - back]
                direct[up] = direct.get(up, 0.0) + part * worth
        for k in range(len(path) + 1):
            total[path[:k]] = total.get(path[:k], 0.0) + worth
    if not direct:
        return "", total.get((), 0.0)
    path = max(direct, key=lambda p: (direct[p], -len(p), p))
    for k in range(len(path), 0, -1):
        if path[k - 1].split(".")[0] in ("article", "main"):
            path = path[:k]
            break
    else:
        path = _with_beside(path, here, total)
        while len(path) > 2 and total[path[:-1]] <= 1.25 * total[path]:
            path = path[:-1]
    return ">".join(path), total[path]


def _with_beside(path: tuple[str, ...], here: dict[tuple[str, ...], tuple[float, float]], total: dict[tuple[str, ...], float]) -> tuple[str, ...]:
    """The lowest container of path and of all text beside it that is substantial and has few links, at any level."""
    beside: dict[tuple[int, tuple[str, ...]], tuple[float, float]] = {}  # by level of the common container and child of it; the container itself for text right in it
    for other, (worth, length) in here.items():
        level = 0
        while level < min(len(path), len(other)) and path[level] == other[level]:
            level += 1
        if level < len(path):
            a, n = beside.get((level, other[: level + 1]), (0.0, 0.0))
            beside[level, other[: level + 1]] = a + worth, n + length
    sums: dict[int, float] = {}
    for (level, _), (worth, length) in beside.items():
        if worth >= length / 2:
            sums[level] = sums.get(level, 0.0) + worth
    least = min(BESIDE * total[path], BESIDE_CHARACTERS)
    return path[: min([level for level, worth in sums.items() if worth >= least], default=len(path))]


def text_at(found: list[Block], path: str) -> str:
    want = tuple(path.split(">")) if path else ()
    return "\n".join(b.text for b in found if b.path[: len(want)] == want)


def main_text(source: str, winners: list[str]) -> str:
    """By the first winner that the page holds, else by its own best path."""
    found = blocks(source)
    held = {path[:k] for path in {b.path for b in found} for k in range(len(path) + 1)}
    for path in winners:
        if (tuple(path.split(">")) if path else ()) in held:
            return text_at(found, path)
    return text_at(found, best_path(found)[0])


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", source: str = "html", share: float = SHARE) -> DataFrame:
    """(host, paths): per host the paths with enough votes, most first. A vote weighs the root of the page's score."""
    types = {"host": pa.string(), "path": pa.string(), "votes": pa.float64()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple[str, str], float] = {}
        for h, x in zip(batch.column("host").to_pylist(), batch.column("source").to_pylist(), strict=True):
            path, value = best_path(blocks(x, rough=True))
            if value:
                sums[h, path] = sums.get((h, path), 0.0) + float(round(value**0.5))
        return arrays(types, {"host": [k[0] for k in sums], "path": [k[1] for k in sums], "votes": list(sums.values())})

    votes = map_batches(pages.select(host(url).alias("host"), text_of(source).alias("source")), run, "host string, path string, votes double")
    summed = written(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    best = summed.groupBy("host").agg(F.max("votes").alias("best"))
    won = summed.join(best, "host").filter(F.col("votes") >= share * F.col("best"))  # at most 1 / share of a host's votes each
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, url: str = "url", source: str = "html", column: str = "main_text") -> DataFrame:
    """pages with their main text; a column of that name is replaced."""
    paths = written(host_paths(pages, url, source)).select(F.col("host").alias("__host"), F.col("paths").alias("__paths"))
    size = paths.agg(F.sum(F.length("__host") + F.length(F.array_join("__paths", "")) + 64)).head()[0] or 0
    rows = pages.select(*[c for c in pages.columns if c != column], host(url).alias("__host"))
    joined = rows.join(F.broadcast(paths) if size <= MOST_BROADCAST else paths, "__host", "left").drop("__host")
    kept = [f for f in joined.schema if f.name != "__paths"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x or "", p or []) for x, p in zip(batch.column(source).to_pylist(), batch.column("__paths").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), column])

    return map_batches(joined, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{column}` string"]))
