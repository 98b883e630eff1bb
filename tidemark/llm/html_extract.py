"""Main text of web pages by consensus host paths.

Each page's containers are scored by the share of the page's free text that they
hold, and every container votes with its score for its generalised tag-class
path (digits in class names become #). Votes are summed by host and path in
Spark; the page is then extracted again from the containers on its host's winning
path, or from its own best one where it has none on that path. Where the page's main
heading lies outside them, the nearest container of both is taken, and neighbours whose
name differs by a number alone belong together. A path is told by a
hash of all its steps and its last step, so deep pages stay small.

Left out are menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles: by element name, role, and class or id names that are
such a word or made of such words (COMPANIONS may stand beside them: "site-header"
is one, "has-sidebar" and "comment-open" aren't). Boxes named like things that can
also be text (SOFT) go only where they are mostly links. A form, or a box by its
class, that holds most of the page's free text and its heading or article is kept, and so
is a header inside the article that has the main heading.
Character references are decoded once. White space is one space, blocks are
joined by one space, and nothing else is dropped. Null html, and pages without
text, give the empty string. Pages without url or host vote together under the
empty host. Unclosed elements end with their parent or the page; repeated rows
each give a row; extra columns pass through extract(), whatever their names.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read, small_batches, spare

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<[!?][^>]*+>?"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_RAW = {"script", "style", "template", "iframe", "textarea", "title", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "datalist", "head"}
_HOLD = {"html", "body", "main", "article", "section", "div", "td", "center", "blockquote", "table", "tbody", "tr", "ul", "ol", "dl", "figure", "details"}
_BLOCK = _HOLD | _DROP | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "br", "th", "thead", "tfoot", "caption", "figcaption", "summary", "address", "fieldset", "legend", "option", "hgroup", "search"}
#: Elements that a start tag ends if they are open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = (_BLOCK - {"br", "option", "legend", "caption", "td", "tr", "th"})
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAMES = re.compile(r"[a-z0-9]+(?:[-_]+[a-z0-9]+)*")
COMMENTS = set("comment comments commentlist commentform disqus reply replies respond".split())
NOISE = COMMENTS | set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer header masthead ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "pagination pager toolbar login signin signup register search searchform copyright skip dialog paywall".split())
SOFT = set("share sharing social related recommended recommendations discussion widget widgets".split())
#: Words that leave a name of noise words what it is.
COMPANIONS = set(
    "site page main top bottom left right primary secondary global inner outer wrapper wrap container box area bar block section list links link item items posts post "
    "slot unit form button buttons icon icons bubble thread count group row col column panel mobile desktop fixed sticky js the".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
_GOOD = set("article content entry post story main text body".split())
_KEEP = {"html", "body", "main", "article"}
_HARD, _FORM, _BY_NAME, _COMMENT, _LINKS, _HEADER = range(1, 7)


def _noise(tag: str, attrs: str) -> int:
    """What kind of noise an element is, 0 for none."""
    if tag in _DROP:
        return _FORM if tag == "form" else _HARD
    worst = 0
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        value = _HUMPS.sub("-", a or b or c).lower()
        if name.lower() == "role":
            if tag not in _KEEP and any(w in ROLES for w in value.split()):
                worst = max(worst, _BY_NAME)
            continue
        for token in _NAMES.findall(value):
            words = [w for w in re.split(r"[-_0-9]+", token) if w]
            said = [w for w in words if w in NOISE or w in SOFT]
            if not said or not all(w in NOISE or w in SOFT or w in COMPANIONS for w in words):
                continue
            comment = any(w in COMMENTS for w in said)
            if tag in _KEEP and not (tag == "article" and comment):
                continue
            worst = max(worst, _COMMENT if comment else _BY_NAME if any(w in NOISE for w in said) else _LINKS if not worst else 0)
    return worst


def _step(tag: str, attrs: str) -> str:
    """An element's place in a path: its tag and its generalised classes."""
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if name.lower() == "class":
            return ".".join([tag, *sorted({re.sub(r"\d+", "#", w) for w in (a or b or c).lower().split()})])
    return tag


def parse(page: str) -> tuple[list[tuple[str, int, bool]], list[tuple[str, str, int, int]], int]:
    """Runs of kept text (text, container, in a link), containers (path, step, parent, depth), and the container of the main heading, -1 without one."""
    runs: list[tuple[str, int, bool, int]] = []  # the last is the noisy region it lies in
    holds: list[tuple[str, str, int, int]] = [("", "", -1, 0)]
    regions: list[list] = [[0, 0, False]]  # parent, kind, holds a heading or article
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, container, region (-1: dropped), in a link
    open_: dict[str, int] = {}
    heads: list[tuple[int, int]] = []
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        m = None
        if lt < 0:
            lt = end
        else:
            m = _TOKEN.match(page, lt)
            if m is None:  # a bare < is text
                nxt = page.find("<", lt + 1)
                lt = end if nxt < 0 else nxt
        if lt > at:
            _, hold, region, link = stack[-1]
            if region >= 0:
                runs.append((page[at:lt], hold, link, region))
        if m is None:
            at = lt
            continue
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attrs = tag.lower(), m[3] or m[6] or ""
        block = tag in _BLOCK
        if block and stack[-1][2] >= 0:
            runs.append((" ", stack[-1][1], False, stack[-1][2]))
        if m[1] or m[4]:  # an end tag closes down to its element, if that is open
            if open_.get(tag, 0):
                while True:
                    closed, hold, region, _ = stack.pop()
                    open_[closed] -= 1
                    if closed in _BLOCK and not block and region >= 0:
                        runs.append((" ", hold, False, region))
                    if closed == tag:
                        break
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at) if not attrs.endswith("/") else None
            at = close.end() if close else (at if attrs.endswith("/") else end)
            continue
        if attrs.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _ENDS_P and open_.get("p", 0):
            while stack[-1][0] not in _HOLD and stack[-1][0]:
                closed = stack.pop()[0]
                open_[closed] -= 1
                if closed == "p":
                    break
        ends = _ENDS.get(tag)
        if ends and stack[-1][0] in ends:
            while stack[-1][0] in ends:
                open_[stack.pop()[0]] -= 1
        _, hold, region, link = stack[-1]
        if region >= 0:
            kind = _noise(tag, attrs)
            if tag == "header" and (open_.get("article", 0) or open_.get("main", 0)):
                kind = _HEADER
            if kind == _HARD:
                region = -1
            elif kind:
                regions.append([region, kind, False])
                region = len(regions) - 1
            if tag in ("h1", "article", "main") and kind != _COMMENT:
                up = region
                while up and not regions[up][2]:
                    regions[up][2] = True
                    up = regions[up][0]
            if tag in _HOLD and region >= 0:
                path, step = holds[hold][0], _step(tag, attrs)
                holds.append((hashlib.blake2b(f"{path}/{step}".encode(), digest_size=8).hexdigest() + "/" + step, step, hold, holds[hold][3] + 1))
                hold = len(holds) - 1
        if tag == "h1" and region >= 0:
            heads.append((hold, region))
        stack.append((tag, hold, region, link or tag == "a"))
        open_[tag] = open_.get(tag, 0) + 1
    drop = _dropped(runs, regions)
    return [(text, hold, link) for text, hold, link, region in runs if not drop[region]], holds, next((hold for hold, region in heads if not drop[region]), -1)


def _dropped(runs: list[tuple[str, int, bool, int]], regions: list[list]) -> list[bool]:
    """Which regions are noise."""
    free, linked = [0] * len(regions), [0] * len(regions)
    for text, _, link, region in runs:
        (linked if link else free)[region] += len(text) - text.count(" ")
    for i in range(len(regions) - 1, 0, -1):  # regions follow those around them
        free[regions[i][0]] += free[i]
        linked[regions[i][0]] += linked[i]
    drop = [False] * len(regions)
    for i, (parent, kind, heading) in enumerate(regions):
        if i:
            most = heading and 2 * free[i] > free[0]
            drop[i] = drop[parent] or kind == _COMMENT or (linked[i] >= free[i] if kind == _LINKS else not heading if kind == _HEADER else not most)
    return drop


def scores(page: str) -> dict[str, float]:
    """Votes of a page: the score of each path by its part of the free text."""
    return _scores(*parse(page)[:2])


def _scores(runs: list[tuple[str, int, bool]], holds: list[tuple[str, str, int, int]]) -> dict[str, float]:
    free, linked = [0] * len(holds), [0] * len(holds)
    for text, hold, link in runs:
        (linked if link else free)[hold] += len(text) - text.count(" ")
    for i in range(len(holds) - 1, 0, -1):  # children follow their parents
        free[holds[i][2]] += free[i]
        linked[holds[i][2]] += linked[i]
    by: dict[str, list] = {}
    for i, (path, step, _, depth) in enumerate(holds):
        if i and free[i]:
            v = by.setdefault(path, [0, 0, step, depth])
            v[0] += free[i]
            v[1] += linked[i]
    out = {}
    for path, (f, k, step, d) in by.items():
        tag, *classes = step.split(".")
        bonus = 1.6 if tag in ("article", "main") else 1.3 if any(w in _GOOD for c in classes for w in _WORDS.findall(c)) else 1.0
        out[path] = min(1.0, f / free[0]) ** 2 * (1 - k / (f + k)) * bonus * (1 + 0.01 * min(d, 20))
    return out


def _weights(runs: list[tuple[str, int, bool]], holds: list[tuple[str, str, int, int]]) -> list[int]:
    """Unlinked text of each container with all that it holds."""
    free = [0] * len(holds)
    for text, hold, link in runs:
        if not link:
            free[hold] += len(text) - text.count(" ")
    for i in range(len(holds) - 1, 0, -1):
        free[holds[i][2]] += free[i]
    return free


def _stem(step: str) -> str:
    return step.rstrip("#").rstrip("-_")


def _article(wanted: set[int], runs: list[tuple[str, int, bool]], holds: list[tuple[str, str, int, int]], head: int) -> set[int]:
    """The containers on the winning path, and what else belongs to their article.

    That is their neighbours whose name differs by a number alone, and, where the main heading
    lies outside, the nearest container that holds both, if half of its unlinked text is theirs.
    """
    parts = {(holds[i][2], _stem(holds[i][1])) for i in wanted if i}
    wanted = wanted | {i for i, h in enumerate(holds) if i and "." in h[1] and (h[2], _stem(h[1])) in parts}
    above: set[int] = set()
    for i in wanted:
        while i not in above and i >= 0:
            above.add(i)
            i = holds[i][2]
    own = head
    while own >= 0 and own not in wanted:
        own = holds[own][2]
    if head < 0 or own >= 0:
        return wanted
    both = head
    while both not in above:
        both = holds[both][2]
    free = _weights(runs, holds)
    return {both} if 2 * sum(free[i] for i in wanted if holds[i][2] not in wanted) >= free[both] else wanted


def text_of(page: str, path: str | None) -> str:
    """The text inside the containers on the path, or on the page's own best path, and in the rest of their article."""
    runs, holds, head = parse(page)
    wanted = {i for i, h in enumerate(holds) if path and h[0] == path}
    if not wanted:
        votes = _scores(runs, holds)
        best = max(votes, key=lambda p: (votes[p], p), default=None)
        wanted = {i for i, h in enumerate(holds) if h[0] == best} or {0}
    wanted = _article(wanted, runs, holds, head)
    for i, h in enumerate(holds):
        if h[2] in wanted:
            wanted.add(i)
    whole = "".join([_html.unescape(t) if "&" in t else t for t, hold, _ in runs if hold in wanted])
    return " ".join(whole.split())


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host: host, path, votes."""
    def vote(html: pa.Array) -> pa.Array:
        return pa.array([list(scores(h).items()) if h else [] for h in html.to_pylist()], pa.map_(pa.string(), pa.float64()))

    votes = pages.select(host_of(F.col("url")).alias("host"), F.explode(F.arrow_udf(vote, "map<string,double>")("html")).alias("path", "score"))
    sums = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 1e6).cast("long")).alias("votes"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"), F.max("votes").alias("votes"))


def extract(pages: DataFrame, out: str = "text") -> DataFrame:
    """pages with the main text of each in column `out`.

    The paths table has a row for each host. Spark broadcasts it where its size in
    the shared folder is under the session's threshold, and else joins by shuffle,
    cutting up hot hosts.
    """
    spark = pages.sparkSession
    small_batches(spark, "500")
    host, path = spare(pages, "host", "path")
    paths = Scratch(spark, "paths").save(host_paths(pages), "paths").select(F.col("host").alias(host), F.col("path").alias(path))

    def take(html: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array([text_of(h, p) if h else "" for h, p in zip(html.to_pylist(), path.to_pylist(), strict=True)], pa.string())

    joined = pages.withColumn(host, host_of(F.col("url"))).join(paths, host, "left")
    return joined.withColumn(out, F.arrow_udf(take, "string")("html", path)).drop(host, path)


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    got = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
