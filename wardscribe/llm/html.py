"""Main text of HTML pages: a suffix array over each host's token streams, with landmarks as protection.

A page becomes blocks of text in page order, in three zones: inside an article
or main landmark, outside of any, and in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments (scripts, styles and the head are
no text). The streams of all zones of a host's pages are concatenated; a suffix
array with common prefixes finds the token runs that distinct pages share. Of
these are boilerplate, and go:

- outside of landmarks, runs that another page has outside of its landmarks or
  in a menu, footer and so on;
- inside landmarks, runs that at least FREQUENT and more than half of the
  host's distinct articles have: what a template puts into every article.
  Quotations and lines that fewer articles share stay, and an article that
  would lose more than half of its words repeats whole, so it stays whole.

The main text is what is left inside the landmark; on pages without one, the
unique runs outside. Menus and the like are evidence only.

Hosts over SHARD pages or SHARD_BYTES are dealt into shards by a hash of the
page, each with a suffix array of its own; the result is that of one array over
the host. Shards tell each other the distinct RUN-token windows outside of
landmarks, as rows of 96-bit hashes, so that a run on two pages is found
wherever they fall. Each distinct article belongs to the first shard that has
it. What more than half of a host's articles have, more than half of some
shard's own articles have too: such windows alone are counted in all shards.
The pages are parsed and shuffled once, and each step reads that shuffle.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import U, Words, mix, slices, tidy

SHARD, SHARD_BYTES, RUN, FREQUENT = 2000, 16_000_000, 8, 5
#: Shard counts (hosts over SHARD pages) up to which the table is broadcast.
BROADCAST_HOSTS = 50_000
_SKIP = {"nav", "menu", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "select", "button", "dialog", "head"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
_SCOPE = {"article", "main", "section", "div", "table", "ul", "ol", "blockquote", "body", "nav", "aside", "footer", "header", "form"}
#: Words of a class or id that name boilerplate, and first words that turn one into a remark about the element.
_NAMED = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "newsletter", "subscribe", "comment", "comments", "replies", "reply", "disqus", "share", "sharing", "social", "related", "popup", "modal", "pagination", "widget"}
_REMARK = {"has", "no", "with", "without", "is", "not", "non", "hide", "show"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def _named(names: str) -> bool:
    for name in names.lower().split():
        parts = re.split("[-_]+", name)
        if parts[0] not in _REMARK and not _NAMED.isdisjoint(parts):
            return True
    return False


def _dropped(tag: str, attrs: str, marked: bool) -> int:
    """How sure an element is boilerplate: 0 not, 1 by its class or id, 2 by its tag, role or being hidden. A header inside a landmark holds its headline and stays."""
    if tag in _SKIP and not (marked and tag == "header"):
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    sure = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in _ROLES):
            return 2
        if name in ("class", "id") and not (marked and tag == "header") and _named(value):
            sure = 1
    return sure


INSIDE, RESCUED, OUTSIDE, DROPPED, MUTE = 0, 1, 2, 3, 4
#: Elements without text of the page.
_MUTE = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "select"}


class _Stack:
    """Open elements; where each tag and the last scope is open is known at once, so a closing tag never walks the stack in vain."""

    def __init__(self):
        self.items: list[tuple[str, int, int]] = []  # tag, sureness of boilerplate, zone
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, drop: int, zone: int) -> None:
        self.at.setdefault(tag, []).append(len(self.items))
        if tag in _SCOPE:
            self.scopes.append(len(self.items))
        self.items.append((tag, drop, zone))

    def last(self, tag: str, scoped: bool) -> int:
        """Where the tag was opened last (scoped: since the last scope began), -1 if nowhere."""
        k = self.at[tag][-1] if self.at.get(tag) else -1
        return -1 if scoped and self.scopes and k < self.scopes[-1] else k

    def cut(self, k: int) -> None:
        for tag, _, _ in self.items[k:]:
            self.at[tag].pop()
        del self.items[k:]
        while self.scopes and self.scopes[-1] >= k:
            self.scopes.pop()


def blocks(html: str | None) -> tuple[list[str], list[str], list[str], bool]:
    """Text blocks inside a landmark, outside of any and in boilerplate elements, and whether a landmark was seen.

    A landmark below an element that only its class or id calls boilerplate
    counts if the page has no other one: such an ancestor holds the page.
    """
    out: list[list[str]] = [[], [], [], []]
    stack, text, seen, at, html = _Stack(), [], [False, False], 0, html or ""

    def flush() -> None:
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                out[stack.items[-1][2] if stack.items else OUTSIDE].append(block)
            text.clear()

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at and not (stack.items and stack.items[-1][2] == MUTE):
            text.append(html[at : m.start()])
        at = m.end()
        close, tag, attrs, end = m.groups()
        if tag is None or end is None or (not end and m.end() == len(html)):
            continue
        tag = tag.lower()
        if tag in _BLOCK or tag in _SKIP:
            flush()
        if close:
            k = stack.last(tag, tag not in _SCOPE)
            if k >= 0:
                if any(t in _BLOCK for t, _, _ in stack.items[k:]):
                    flush()
                stack.cut(k)
            continue
        if tag in _CLOSES_P or tag == "li":
            k = max(stack.last("p", True), stack.last("li", True) if tag == "li" else -1)
            if k >= 0:
                flush()
                stack.cut(k)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        _, was, zone = stack.items[-1] if stack.items else ("", 0, OUTSIDE)
        own = _dropped(tag, attrs, zone in (INSIDE, RESCUED))
        new = zone
        if zone == MUTE or tag in _MUTE:
            new = MUTE
        elif own == 2:
            new = DROPPED
        elif tag in ("article", "main") and zone not in (INSIDE, RESCUED) and was < 2:
            new = RESCUED if own or was else INSIDE
            seen[new] = True
        elif own:
            new = DROPPED
        if new != zone:
            flush()
        stack.push(tag, max(was, own) if new in (DROPPED, MUTE) else 0, new)
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            end_at = stop.start() if stop else len(html)
            if new in (INSIDE, RESCUED, OUTSIDE) and tag not in ("title", "textarea"):
                text.append(html[at:end_at])
            at = end_at
    if at < len(html) and not (stack.items and stack.items[-1][2] == MUTE):
        text.append(html[at:])
    flush()
    if seen[INSIDE] or not seen[RESCUED]:
        return out[INSIDE], out[OUTSIDE], out[DROPPED] + out[RESCUED], seen[INSIDE]
    return out[RESCUED], out[OUTSIDE], out[DROPPED], True


class SuffixArray:
    """Suffixes of an integer sequence in order, and for each the tokens that it shares with the one before, up to `most`.

    Prefix doubling that sorts only what is still tied: a suffix that no other
    shares its first tokens with keeps its place.
    """

    def __init__(self, seq: np.ndarray, most: int | None = None):
        n = len(seq)
        self.order = np.argsort(seq, kind="stable")
        place = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = seq[self.order[1:]] != seq[self.order[:-1]]
        rank, step = np.empty(n, np.int64), 1
        rank[self.order] = np.maximum.accumulate(np.where(new, place, 0)) if n else place
        while True:
            alone = new & np.append(new[1:], True)
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            s = self.order[tied]
            nxt = np.where(s + step < n, rank[np.minimum(s + step, n - 1)], -1)
            key = np.lexsort((nxt, rank[s]))
            s, nxt, old = s[key], nxt[key], rank[s[key]]
            first = np.ones(len(s), bool)
            first[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
            self.order[tied] = s
            new[tied] = first
            rank[s] = tied[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]
            step *= 2
        self.shared = np.zeros(n, np.int64)
        at, a, b, k = np.arange(1, n), self.order[:-1], self.order[1:], 0
        while len(at) and (most is None or k < most):
            ok = np.maximum(a, b) + k < n
            at, a, b = at[ok], a[ok], b[ok]
            ok = seq[a + k] == seq[b + k]
            at, a, b, k = at[ok], a[ok], b[ok], k + 1
            self.shared[at] = k


_PARSED = ["host", "part", "page_id", "url", "hash", "shards", "inside", "outside", "dropped", "seen", "one", "two"]
#: Rows that shards tell each other: a window outside of landmarks, an article, a window inside, a shard's number of articles.
OUT, ARTICLE, IN, TOTAL = 0, 1, 2, 3
_TOLD = "host string, part long, shards long, kind int, one long, two long, n long"
Page = tuple[list[str], list[str], list[str]]


class Streams:
    """The token streams of pages (blocks inside, outside, dropped), concatenated.

    seq: the number of each token's word from 1, 0 at a block's edge, negative
    where a zone or page ends, which no run crosses. Of each token: page, zone
    (0, 1, 2). known: the words in order of their numbers. article: equal articles have
    one number.
    """

    def __init__(self, pages: list[Page]):
        self.pages = [[[b.split() for b in zone] for zone in p] for p in pages]
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for p in self.pages for z in p for b in z for w in b), np.int64)
        self.known = list(number)
        sizes, ends, page, zone = [], [], [], []
        for k, p in enumerate(self.pages):
            for z, blocks_ in enumerate(p):
                for b in blocks_:
                    sizes.append(len(b) + 1)
                    ends.append(False)
                sizes.append(1)
                ends.append(True)
                page.append(np.full(sum(map(len, blocks_)) + len(blocks_) + 1, k))
                zone.append(np.full(len(page[-1]), z))
        none = np.zeros(0, np.int64)
        self.page, self.zone = np.concatenate([none, *page]), np.concatenate([none, *zone])
        begin = np.cumsum([0, *sizes], dtype=np.int64)[:-1]
        edge = np.zeros(len(self.page), bool)
        edge[begin] = True
        self.seq = np.zeros(len(self.page), np.int64)
        self.seq[~edge] = ids + 1
        last = begin[np.array(ends, bool)] if ends else none
        self.seq[last] = -1 - np.arange(len(last))
        text: dict[str, int] = {}
        self.article = np.array([text.setdefault("\n".join(p[0]), len(text)) for p in pages], np.int64)
        self.n_articles = len(text.keys() - {""})

    def starts(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token its group of equal windows of `least` tokens; and of each group whether two pages have it outside of landmarks, and how many distinct articles have it."""
        sa = SuffixArray(self.seq, least)
        group = np.empty(len(self.seq), np.int64)
        group[sa.order] = np.cumsum(sa.shared < least) - 1
        n = int(group.max()) + 1
        low, high = np.full(n, len(self.pages)), np.full(n, -1)
        out = self.zone > 0
        np.minimum.at(low, group[out], self.page[out])
        np.maximum.at(high, group[out], self.page[out])
        pair = np.unique(group[~out] * (len(self.pages) + 1) + self.article[self.page[~out]])
        return group, low < high, np.bincount(pair // (len(self.pages) + 1), minlength=n)

    def windows(self, least: int) -> np.ndarray:
        """Starts of the windows that no zone's end cuts."""
        at = np.arange(max(len(self.seq) - least + 1, 0))
        last = np.concatenate(([0], np.cumsum(self.seq < 0)))
        return at[last[at + least] == last[at]]

    def hashes(self, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for each window, in two numbers."""
        w = Words(pa.array(self.known, pa.string()))
        h = np.concatenate((np.array([1], U), w.hashes))  # a word has no white space inside
        one, two = np.full(len(at), 2, U), np.full(len(at), 3, U)
        with np.errstate(over="ignore"):
            for k in range(least):
                x = h[self.seq[at + k]]
                one, two = mix(one * U(0xD6E8FEB86659FD93) + x), mix(two * U(0xA0761D6478BD642F) + x)
        return one.view(np.int64), (two >> U(32)).astype(np.int64)

    def kept(self, gone: np.ndarray) -> list[list[list[str]]]:
        """For each page, its blocks inside and outside without the tokens of the mask."""
        out, at = [], 0
        for p in self.pages:
            zones = []
            for z in p:
                some = []
                for b in z:
                    left = [w for w, g in zip(b, gone[at + 1 : at + 1 + len(b)]) if not g]
                    at += len(b) + 1
                    if left:
                        some.append(" ".join(left))
                at += 1
                zones.append(some)
            out.append(zones[:2])
        return out


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.rec.fromarrays([one, two], names="a,b")


def _article(blocks_: list[str]) -> tuple[int | None, int | None]:
    """128 bits of an article's text but for a sign, in two numbers: the second is negative, as no window's is. None without text."""
    if not blocks_:
        return None, None
    d = hashlib.blake2b("\n".join(blocks_).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little") // 2 - 2**63


def _article_windows(articles: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of different articles, and how many of the articles have each."""
    s = Streams([(a, [], []) for a in articles])
    at = s.windows(RUN)
    one, two = s.hashes(at, RUN)
    page = s.page[at]
    order = np.lexsort((page, two, one))
    one, two, page = one[order], two[order], page[order]
    new, again = np.ones(len(at), bool), np.zeros(len(at), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    again[1:] = ~new[1:] & (page[1:] == page[:-1])
    first = np.flatnonzero(new)
    n = np.add.reduceat((~again).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return _pairs(one[first], two[first]), n


def _covered(n: int, starts: np.ndarray, least: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + least, n), -1)
    return np.cumsum(step[:-1]) > 0


def unique_runs(pages: list[Page], least: int = RUN, told: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[list[str]]]:
    """For each page, its blocks inside and outside of a landmark without boilerplate runs of `least` tokens or more.

    told, where the pages are one shard of a host: the windows outside of
    landmarks that another shard has too, and the windows inside that go.
    """
    s = Streams(pages)
    if not len(s.seq):
        return [[list(p[0]), list(p[1])] for p in pages]
    group, twice, articles = s.starts(least)
    gone = twice[group] & (s.zone > 0)
    if told is None:
        gone |= (articles >= FREQUENT)[group] & (2 * articles > s.n_articles)[group] & (s.zone == 0)
    else:
        at = s.windows(least)
        own, out = _pairs(*s.hashes(at, least)), s.zone[at] > 0
        gone[at] |= np.where(out, np.isin(own, told[0]), np.isin(own, told[1]))
    gone = _covered(len(s.seq), np.flatnonzero(gone), least)
    word = s.seq > 0
    for k in np.unique(s.page[gone & word & (s.zone == 0)]):
        lo, hi = np.searchsorted(s.page, (k, k + 1))
        mine = word[lo:hi] & (s.zone[lo:hi] == 0)
        if 2 * (gone[lo:hi] & mine).sum() > mine.sum():  # the article repeats whole
            gone[lo:hi] &= s.zone[lo:hi] > 0
    return s.kept(gone)


def main_text(pages: DataFrame, shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The main text of each page.

    pages: page_id long, url string, html string; other columns are ignored.
    Returns a row for each row: page_id, url, text (empty if none), n_chars.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space. A null html is empty; pages whose url
    is null or has no host share nothing with others; an unfinished tag at the
    end is dropped. A header inside a landmark holds its headline and stays; a
    class or id is boilerplate by its whole words, not by has-, no- or with-.
    Repeated rows are one page to the suffix array if page_id, url and html are
    equal. An empty table gives an empty one.
    """
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    # the host is what follows the scheme up to a slash, question mark, number sign or port
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)", 1))
    hashed = x.withColumn("hash", F.xxhash64("page_id", "url", "html"))
    size = F.greatest(F.ceil(F.count("*") / shard), F.ceil(F.sum(F.octet_length("html")) / shard_bytes))
    many = x.groupBy(host.alias("h")).agg(size.alias("shards")).where("shards > 1")
    few = many.count() <= BROADCAST_HOSTS
    hashed = hashed.withColumn("host", host).join(F.broadcast(many) if few else many, F.col("host") == F.col("h"), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    hashed = hashed.select("host", F.pmod("hash", "shards").alias("part"), "page_id", "url", "html", "hash", "shards")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html"):
                ins, outs, drops, seen = zip(*map(blocks, part["html"].to_pylist()))
                one, two = zip(*map(_article, ins))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("host", "part", "page_id", "url", "hash", "shards")), *(pa.array(c, pa.list_(pa.string())) for c in (ins, outs, drops)), pa.array(seen, pa.bool_()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], _PARSED)

    dealt = hashed.mapInArrow(parse, "host string, part long, page_id long, url string, hash long, shards long, inside array<string>, outside array<string>, dropped array<string>, seen boolean, one long, two long").groupBy("host", "part")

    def told(t: pa.Table | None, kinds: list[tuple[int, np.ndarray, np.ndarray | None]]) -> pa.Table:
        """Rows of the shard t, of pairs of numbers and counts of each kind."""
        kinds = [(k, p, np.zeros(len(p), np.int64) if n is None else n) for k, p, n in kinds]
        n = sum(len(p) for _, p, _ in kinds)
        named = [pa.array([t[c][0].as_py() if n else None] * n, kind) for c, kind in (("host", pa.string()), ("part", pa.int64()), ("shards", pa.int64()))]
        join = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
        kind = pa.array(np.repeat([k for k, _, _ in kinds], [len(p) for _, p, _ in kinds]).astype(np.int32))
        return pa.table([*named, kind, join([p["a"] for _, p, _ in kinds]), join([p["b"] for _, p, _ in kinds]), join([c for _, _, c in kinds])], ["host", "part", "shards", "kind", "one", "two", "n"])

    def of(marks: pa.Table, kind: int) -> np.ndarray:
        rows = marks.filter(pc.equal(marks["kind"], kind))
        return _pairs(*(rows[c].to_numpy().astype(np.int64) for c in ("one", "two")))

    def sharded(t: pa.Table) -> bool:
        return t.num_rows > 0 and t["shards"][0].as_py() > 1 and t["host"][0].as_py() != ""

    def distinct(t: pa.Table) -> tuple[list[int], list[Page], list[int]]:
        """The hashes of the rows, the blocks of each row, and the first row of each page in order."""
        keys = t["hash"].to_pylist()
        first = {k: i for i, k in reversed(list(enumerate(keys)))}
        return keys, list(zip(t["inside"].to_pylist(), t["outside"].to_pylist(), t["dropped"].to_pylist())), sorted(first.values(), key=keys.__getitem__)

    def own_articles(t: pa.Table, marks: pa.Table) -> list[list[str]]:
        mine = set(of(marks, ARTICLE).tolist())
        row = {k: i for i, k in enumerate(zip(t["one"].to_pylist(), t["two"].to_pylist())) if k in mine}
        return t["inside"].take(pa.array(sorted(row.values()), pa.int64())).to_pylist()

    @tidy
    def tell(t: pa.Table) -> pa.Table:
        """What a shard has: its windows outside of landmarks and its articles."""
        if not sharded(t):
            return told(None, [])
        s = Streams([([], *p) for p in zip(t["outside"].to_pylist(), t["dropped"].to_pylist())])
        a = t.filter(t["one"].is_valid())
        return told(t, [(OUT, np.unique(_pairs(*s.hashes(s.windows(RUN), RUN))), None), (ARTICLE, np.unique(_pairs(a["one"].to_numpy(), a["two"].to_numpy())), None)])

    @tidy
    def common(t: pa.Table, marks: pa.Table) -> pa.Table:
        """The windows that more than half of the shard's own articles have."""
        articles = own_articles(t, marks) if sharded(t) else []
        if not articles:
            return told(None, [])
        windows, n = _article_windows(articles)
        return told(t, [(IN, windows[2 * n > len(articles)], None)])

    @tidy
    def tally(t: pa.Table, marks: pa.Table) -> pa.Table:
        """How many of the shard's own articles have each common window, and the number of articles."""
        articles = own_articles(t, marks) if sharded(t) else []
        if not articles:
            return told(None, [])
        out, asked = [(TOTAL, _pairs(np.zeros(1, np.int64), np.zeros(1, np.int64)), np.array([len(articles)]))], of(marks, IN)
        if len(asked):
            windows, n = _article_windows(articles)
            hit = np.isin(windows, asked)
            out.append((IN, windows[hit], n[hit]))
        return told(t, out)

    @tidy
    def finish(t: pa.Table, marks: pa.Table) -> pa.Table:
        keys, every, rows = distinct(t)
        mine, runs = [every[i] for i in rows], {}
        if t.num_rows and not t["host"][0].as_py():
            runs = {keys[i]: [list(every[i][0]), list(every[i][1])] for i in rows}
        else:
            runs = dict(zip((keys[i] for i in rows), unique_runs(mine, told=(of(marks, OUT), of(marks, IN)) if sharded(t) else None)))
        text = [" ".join(runs[k][0 if seen else 1]) for k, seen in zip(keys, t["seen"].to_pylist())]
        return pa.table({"page_id": t["page_id"], "url": t["url"], "text": pa.array(text, pa.string()), "n_chars": pa.array([len(s) for s in text], pa.int64())})

    # one plan, so that all steps read the one shuffle of the pages; kind is aggregated, not a key, so that no filter gets below it
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("part")
    sent = dealt.applyInArrow(tell, _TOLD).groupBy("host", "one", "two").agg(F.max("kind").alias("kind"), F.max("shards").alias("shards"), F.collect_set("part").alias("parts"))
    owned = sent.where(F.col("kind") == ARTICLE).select("host", F.array_min("parts").alias("part"), "kind", "one", "two")
    twice = sent.where((F.col("kind") == OUT) & (F.size("parts") > 1)).select("host", F.explode("parts").alias("part"), "kind", "one", "two")
    asked = dealt.cogroup(owned.groupBy("host", "part")).applyInArrow(common, _TOLD).groupBy("host", "one", "two").agg(F.max("kind").alias("kind"), F.max("shards").alias("shards")).select("host", every_part, "kind", "one", "two")
    counted = dealt.cogroup(owned.union(asked).groupBy("host", "part")).applyInArrow(tally, _TOLD).groupBy("host", "kind", "one", "two").agg(F.sum("n").alias("n"), F.max("shards").alias("shards"))
    total = F.max(F.when(F.col("kind") == TOTAL, F.col("n"))).over(Window.partitionBy("host"))
    often = counted.withColumn("total", total).where((F.col("kind") == IN) & (F.col("n") >= FREQUENT) & (2 * F.col("n") > F.col("total"))).select("host", every_part, "kind", "one", "two")
    return dealt.cogroup(twice.union(often).groupBy("host", "part")).applyInArrow(finish, "page_id long, url string, text string, n_chars long")
