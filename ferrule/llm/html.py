"""Main text of web pages by their markup and by what the pages of a host have in common.

A page is cut into blocks of text.  Blocks inside article or main elements are its text, but for parts that their element or
class marks as something else; blocks inside navigation, headers, footers, forms and the like never are.  What remains open - text
of pages or regions without such marks - is decided per host: the token streams of all these blocks are concatenated, a suffix
array finds the runs of tokens that stand in several distinct pages, runs they cover are boilerplate, and unique runs stay.
Hosts are worked on in shards of a bounded number of pages; runs that repeat only across shards are found by hashes of windows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import require, settle, slices

#: Tokens of a run that marks boilerplate where it stands in two pages, and pages of a host in a shard.
RUN, SHARD = 6, 512
#: Articles of fewer words are teasers if outside them there are so many times more.
TEASER, FAR_MORE = 25, 8

_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "option", "textarea", "canvas", "audio", "video"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Elements that the start of another ends.
_CLOSED_BY = {"p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of class, id or role that mark a part as something other than the article.
_MARKS = re.compile(r"(?:^|[\s_-])(?:ads?(?=$|\s|[_-](?:slot|unit|box|container|wrapper|wrap|block|banner|space|zone|label|placeholder|content|inner|frame|text|top|bottom|left|right|\d))|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side-?bar|aside|related|recommend\w*|share|sharing|social|comments?|comment-?list|disqus|replies|reply|respond|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|search|pagination|pager|widget|toolbar|skip-?link|hidden|contentinfo|navigation|complementary|alert)(?=$|[\s_-])", re.I)
#: Such words that on a paragraph, heading or other piece of an article's own text say how it looks: it stays.
_LOOKS = re.compile(r"(?:^|(?<=\s))(?:notices?|alert|header|footer|banner|search|hidden)(?=$|\s)", re.I)
_PIECES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BLANK = re.compile(r"\s+")

ARTICLE, OPEN = 1, 0


def blocks(page: str) -> list[tuple[int, str]]:
    """(ARTICLE or OPEN, text) of the page's blocks that no mark excludes, in page order; references decoded, white space single.

    Runs in one pass over the tags and never fails: unclosed and stray tags, comments and quotes are taken as browsers take them
    where that is simple, and otherwise end with their parent or the page.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, excluded, in an article
    excluded = article = False

    def flush() -> None:
        if text:
            joined = _BLANK.sub(" ", "".join(text)).strip()
            text.clear()
            if joined:
                out.append((ARTICLE if article else OPEN, joined))

    def pop() -> None:
        nonlocal excluded, article
        name, excluded, article = stack.pop()

    at, raw = 0, None
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not excluded and raw is None:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[3] or "").lower()
        if raw is not None:
            continue
        if m[1] is not None:
            if not excluded:
                text.append(m[1])
            continue
        if not name:
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in _INLINE or depth is not None and stack[depth][1] != excluded:
                flush()
            if depth is not None:
                while len(stack) > depth:
                    if stack[-1][0] not in _INLINE:
                        flush()
                    pop()
            continue
        closes = [n for n, by in _CLOSED_BY.items() if name in by]
        if closes:
            inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in closes or stack[i][0] in ("table", "ul", "ol", "dl", "div", "article", "section", "main")), None)
            if inner is not None and stack[inner][0] in closes:
                flush()
                while len(stack) > inner:
                    pop()
        if name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        if name in _RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        marked = name in _SKIP or name in _ASIDE
        opens = name in ("article", "main")
        if not marked and m[4].strip():
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            marks = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            if article and name in _PIECES:
                marks = _LOOKS.sub(" ", marks)
            marked = bool(marks.strip() and _MARKS.search(marks)) and name not in ("html", "body") and not opens
            opens = opens or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
            marked = marked or _HIDDEN.search(_QUOTED.sub(" ", m[4])) is not None or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        if marked != excluded or opens:
            flush()
        stack.append((name, excluded, article))
        excluded, article = excluded or marked, article or opens
    if at < len(page) and not excluded:
        text.append(entities.unescape(page[at:]))
    flush()
    return out


def teaser(found: list[tuple[int, str]]) -> bool:
    """Whether marked articles hold so little beside the rest of the page that they can't be its main text."""
    words = [0, 0]
    for k, t in found:
        words[k] += t.count(" ") + 1
    return words[ARTICLE] < TEASER and words[OPEN] >= FAR_MORE * words[ARTICLE]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = new
        if rank.max() == n - 1 or step >= n:
            break
        step *= 2
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many tokens each suffix in order shares with the one before it, up to `most`."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    live = np.arange(1, n)
    for k in range(most):
        a, b = order[live] + k, order[live - 1] + k
        live = live[(a < n) & (b < n)]
        if not len(live):
            break
        live = live[tokens[order[live] + k] == tokens[order[live - 1] + k]]
        out[live] += 1
    return out


def covered(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Tokens inside a run of at least `run` tokens that stands in several distinct pages.  Pages must be set apart by unique tokens."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, dtype=bool)
    order = suffix_array(tokens)
    shared = common_prefixes(tokens, order, run) >= run
    group = np.cumsum(~shared)
    low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, page[order])
    np.maximum.at(high, group, page[order])
    start = order[(low != high)[group]]
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, np.minimum(start + run, n), -1)
    return np.cumsum(mark)[:-1] > 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """(id_col, url_col, text, n_chars): the main text of every row; blocks in page order, joined by one space.

    Null and empty pages, and pages of nothing but boilerplate, have the empty text.  A null url is a host of its own.  Repeated
    rows and pages are compared by content: a page repeated whole is no boilerplate of itself.  Nothing is cut off.
    """
    require(pages, id_col, url_col, html_col)
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*:?//([^/?#]*)", 1))
    plain = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    kind = plain.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [blocks(x) for x in batch.column("html").to_pylist()]
            sure = [[t for k, t in b if k == ARTICLE] for b in found]
            # a page with an article needs nothing from outside it, unless that is a teaser beside far more text
            left = [[] if s and not teaser(b) else [t for _, t in b] for s, b in zip(sure, found, strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "url": batch.column("url"), "host": batch.column("host"), "sure": pa.array([" ".join(s) for s in sure], pa.string()), "left": pa.array(left, pa.list_(pa.string()))})

    parsed = settle(plain.mapInArrow(cut, f"id {kind}, url string, host string, sure string, left array<string>"), pages.sparkSession)
    sure = parsed.filter(F.size("left") == 0).select("id", "url", F.col("sure").alias("text"))
    undecided = parsed.filter(F.size("left") > 0).select("id", "url", "host", "left", F.xxhash64("left").alias("content"))
    rest = _decide(undecided, kind, run)
    out = sure.unionAll(rest)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))


def _decide(undecided: DataFrame, kind: str, run: int) -> DataFrame:
    """(id, url, text) of the pages without a marked article: what stays when runs that pages of the host share are taken out."""
    sizes = undecided.groupBy("host").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int"))
    placed = undecided.join(sizes.select("host", "shards"), "host").withColumn("shard", F.pmod(F.xxhash64("content"), F.col("shards")).cast("int"))

    # hosts of several shards: windows that stand in pages of different content anywhere on the host
    words = F.split(F.concat_ws(" ", "left"), " ")
    window = F.transform(F.sequence(F.lit(0), F.col("many") - run), lambda i: F.xxhash64(F.slice(F.col("words"), i + 1, run)))
    large = placed.filter("shards > 1").select("host", "content", words.alias("words")).dropDuplicates(["host", "content"]).withColumn("many", F.size("words")).filter(F.col("many") >= run)
    each = large.select("host", "content", F.posexplode(window).alias("at", "window"))
    twice = each.groupBy("host", "window").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select("host", "window")
    marks = each.join(twice, ["host", "window"]).groupBy("host", "content").agg(F.collect_list("at").alias("marks"))
    placed = placed.join(marks, ["host", "content"], "left").select("id", "url", "host", "shard", "left", "content", "marks")

    def shard(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        number: dict[str, int] = {}
        first: dict[int, int] = {}
        stream: list[int] = []
        page: list[int] = []
        for i, r in enumerate(rows):
            if r["content"] in first:
                continue
            first[r["content"]] = len(stream)
            own = [number.setdefault(t, len(number)) for t in " ".join(r["left"]).split(" ")]
            stream += [*own, -1 - i]
            page += [i] * (len(own) + 1)
        gone = covered(np.array(stream), np.array(page), run)
        text = []
        for r in rows:
            at, kept = first[r["content"]], []
            out = gone[at : at + sum(b.count(" ") + 1 for b in r["left"])].copy()
            for m in r["marks"] or ():
                out[m : m + run] = True
            k = 0
            for block in r["left"]:
                tokens = block.split(" ")
                if stay := [t for t, o in zip(tokens, out[k : k + len(tokens)], strict=True) if not o]:
                    kept.append(" ".join(stay))
                k += len(tokens)
            text.append(" ".join(kept))
        return pa.table({"id": group.column("id"), "url": group.column("url"), "text": pa.array(text, pa.string())})

    return placed.groupBy("host", "shard").applyInArrow(shard, f"id {kind}, url string, text string")
