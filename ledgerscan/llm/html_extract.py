"""Main text of web pages by consensus host paths.

Every page scores its containers by the running text they hold directly (links count against it) and
climbs from the best one to the smallest that holds all running text of the page; an article or main
element with nearly all of it and no first headline outside is the end of the climb. The path of tags and
classes of the container found, with numbers generalised, is the page's vote; votes are counted per host
in Spark, and all pages of a host are extracted again at the winning path. A page without text there,
with most of its text elsewhere, with a headline elsewhere, or whose own container below the body holds
more around it, is extracted at its own container.

Left out everywhere: navigation, page headers, footers, asides, forms, scripts, hidden parts, and
elements whose class, id or role names them as such, as adverts, notices or comments.

Cases: null or empty html has the empty text; a page without host votes alone; equal rows repeat;
broken markup is read as far as it goes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import prepare, text_of, written

#: Hosts up to this number (at most 600 bytes each) are broadcast; beyond, Spark joins by shuffle.
BROADCAST_HOSTS = 100_000
LONGEST_PATH = 400
#: Share of the running text with which an article or main element is taken for the whole.
NEARLY_ALL = 0.9

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    " caption legend option".split()
)
CONTAINERS = frozenset("html body main article section div td th blockquote center details dl ol ul table figure".split())
LISTS = ("ul", "ol", "dl", "table", "select")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEFT_OUT = frozenset(
    "head nav aside footer form button select option input menu svg canvas object template dialog audio video map math"
    " script style textarea title noscript iframe noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner cookie cookies consent gdpr notice notices sidebar"
    " menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus respond share sharing social related"
    " recommended recommendations newsletter subscribe signup promo promotion sponsor sponsored popup modal widget widgets"
    " skip toolbar pagination pager login search alert reply replies discussion outbrain taboola".split()
)
PAGE_PARTS = frozenset("header footer masthead".split())
OWN_PARTS = frozenset("article post entry content story".split())

OPENING = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?/])")
NAME = re.compile(r"[^\s/>]+")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
SPACE = re.compile(r"\s+")
NUMBER = re.compile(r"\d+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def tags_of(source: str):
    """``start, end, closing, name, attributes`` of every tag, comments and declarations with an empty name.

    A tag ends at the first ``>`` outside quotes; where its quotes never close, at the first ``>`` of all, and
    without any it is text. Quotes from which no end was reached are remembered, so each is followed
    once and the time is linear in the page.
    """
    last = source.rfind(">")
    hopeless: set[int] = set()

    def end_of(at: int) -> int:
        tried = []
        while True:
            m = QUOTE_OR_END.search(source, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            if m.start() in hopeless:
                break
            tried.append(m.start())
            close = source.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        hopeless.update(tried)
        return -1

    at = 0
    while True:
        m = OPENING.search(source, at)
        if m is None:
            return
        start = m.start()
        if m[0] == "<!--":
            close = source.find("-->", m.end())
            at = len(source) if close < 0 else close + 3
            moved = yield start, at, False, "", ""
        elif start > last:
            at = m.end()
            continue
        elif m[0][-1] in "!?/":
            at = source.index(">", m.end()) + 1
            moved = yield start, at, False, "", ""
        else:
            name = NAME.match(source, m.end() - 1)
            close = end_of(name.end())
            if close < 0:
                close = source.find(">", name.end())
            at = close + 1
            moved = yield start, at, m[0][1] == "/", name[0].lower(), source[name.end() : close]
        if moved is not None:
            at = moved


class Page:
    """Blocks of a page and the containers they stand in."""

    def __init__(self, source: str):
        self.paths: list[str] = [""]  # of every container
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, letters in links
        self.headlines: list[int] = []  # containers of h1 elements with text
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, str]] = []  # tag, container, left out, path
        places: dict[str, list[int]] = defaultdict(list)  # of every open tag in the stack
        boxes: list[int] = []  # places of open containers
        text: list[str] = []
        linked = 0
        links = 0

        def state():
            return stack[-1] if stack else ("", 0, False, "")

        def flush():
            nonlocal linked
            if text:
                block = SPACE.sub(" ", "".join(text)).strip()
                if block:
                    self.blocks.append((state()[1], block, linked))
                    if places["h1"]:
                        self.headlines.append(state()[1])
                text.clear()
            linked = 0

        def pop():
            nonlocal links
            tag = stack[-1][0]
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links -= 1
            stack.pop()
            places[tag].pop()
            if tag in CONTAINERS:
                boxes.pop()

        def pop_to(k: int):
            while len(stack) > k:
                pop()

        def push(tag: str, container: int, out: bool, path: str):
            places[tag].append(len(stack))
            if tag in CONTAINERS:
                boxes.append(len(stack))
            stack.append((tag, container, out, path))

        def add(raw: str):
            nonlocal linked
            if raw and not state()[2]:
                piece = html.unescape(raw) if "&" in raw else raw
                text.append(piece)
                if links:
                    linked += len(piece.strip())

        at = 0
        scan = tags_of(source)
        found_tag = next(scan, None)
        while True:
            if found_tag is None:
                add(source[at:])
                break
            start, end, closing, tag, attributes = found_tag
            add(source[at:start])
            at = end
            if tag in RAW and not closing:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = len(source) if close is None else close.start()
            found_tag = self._step(scan, at if at != end else None)
            if not tag:
                continue
            if closing:
                if tag == "p" and not places["p"]:
                    flush()
                if places[tag]:
                    pop_to(places[tag][-1])
                continue
            if tag in BLOCKS:
                flush()
                if places["p"] and places["p"][-1] > (boxes[-1] if boxes else -1):
                    pop_to(places["p"][-1])
            if tag in CLOSES:
                k = max((places[x][-1] for x in CLOSES[tag] if places[x]), default=-1)
                if k > max((places[x][-1] for x in LISTS if places[x]), default=-1):
                    pop_to(k)
            if tag in VOID:
                if tag in ("br", "hr", "wbr") and tag != "wbr":
                    add(" ")
                continue
            if tag in RAW:
                push(tag, state()[1], True, state()[3])
                continue
            if attributes.endswith("/") and tag not in BLOCKS:
                continue
            found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
            above = state()
            out = above[2] or self._left_out(tag, found, bool(places["article"] or places["main"]))
            if tag == "a":
                links += 1
            if tag in CONTAINERS and not out:
                classes = NUMBER.sub("0", ".".join(sorted(found.get("class", "").split())))
                path = f"{above[3]}/{tag}{'.' + classes if classes else ''}"
                if len(path) > LONGEST_PATH:
                    path = path[: LONGEST_PATH - 40] + "#" + blake2b(path.encode(), digest_size=16).hexdigest()
                self.paths.append(path)
                self.parents.append(above[1])
                self.tags.append(tag)
                push(tag, len(self.paths) - 1, out, path)
            else:
                push(tag, above[1], out, above[3])
        while stack:
            pop()
        flush()

    @staticmethod
    def _step(scan, moved: int | None):
        """The next tag, from ``moved`` on where the text before it was skipped."""
        try:
            return next(scan) if moved is None else scan.send(moved)
        except StopIteration:
            return None

    @staticmethod
    def _left_out(tag: str, found: dict, inside: bool) -> bool:
        if tag in LEFT_OUT:
            return True
        if not found:
            return tag == "header" and not inside
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return True
        if tag == "header" and not inside:
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        parts = {p.lower() for p in PART.findall(f"{found.get('class', '')} {found.get('id', '')}")}
        return bool(parts & NAMES) or (bool(parts & PAGE_PARTS) and not inside and not parts & OWN_PARTS)

    def best(self) -> tuple[int, float]:
        """The smallest container around the most running text that holds all of it, and its score."""
        scores = [0] * len(self.paths)
        for container, block, linked in self.blocks:
            scores[container] += max(0, len(block) - 2 * linked)
        at = max(range(len(scores)), key=lambda k: (scores[k], -k))
        heads = [0] * len(self.paths)
        for container in self.headlines:
            heads[container] += 1
        for k in range(len(scores) - 1, 0, -1):
            scores[self.parents[k]] += scores[k]
            heads[self.parents[k]] += heads[k]
        while scores[at] < scores[0]:
            if self.tags[at] in ("article", "main") and scores[at] >= NEARLY_ALL * scores[0] and heads[at] == heads[0]:
                break
            at = self.parents[at]
        return at, float(scores[at])

    def headed(self, inside: list[bool]) -> bool:
        """Whether no first headline stands outside."""
        return all(inside[k] for k in self.headlines)

    def text(self, inside: list[bool]) -> str:
        return "\n".join(block for container, block, _ in self.blocks if inside[container])

    def below(self, chosen) -> list[bool]:
        """For every container, whether it is chosen or stands in a chosen one."""
        inside: list[bool] = []
        for k, parent in enumerate(self.parents):
            inside.append(chosen(k) or (parent >= 0 and inside[parent]))
        return inside

    def extract(self, path: str | None) -> str:
        at, _ = self.best()
        mine = self.below(lambda k: k == at)
        own = self.text(mine)
        if path is None or self.paths[at] == path and self.paths.count(path) == 1:
            return own
        theirs = self.below(lambda k: self.paths[k] == path)
        agreed = self.text(theirs)
        part = all(m or not t for m, t in zip(mine, theirs, strict=True)) and len(agreed) < len(own)
        if part and (self.tags[at] not in ("", "html", "body") or not self.headed(theirs)):
            return own
        return agreed if 2 * len(agreed) >= len(own) else own


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, pages`` : the container path that most pages of a host vote for; written."""

    def vote(batches):
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                at, score = page.best()
                if score > 0:
                    hosts.append(host), paths.append(page.paths[at]), scores.append(int(score))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    votes = pages.filter("host <> ''").select("host", "html").mapInArrow(vote, "host string, path string, score long")
    counts = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("score"))
    best = counts.groupBy("host").agg(F.max(F.struct("pages", "score", "path")).alias("b"))
    return written(best.select("host", "b.path", "b.pages"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(html_col).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    winners = host_paths(rows).select(F.col("host").alias("voted"), "path")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    joined = rows.join(winners, F.col("host") == F.col("voted"), "left").select("page_id", "url", "html", "path")

    def extract(batches):
        for batch in batches:
            texts = [Page(s).extract(p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = dict(joined.dtypes)["page_id"]
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
