"""Main text of HTML pages by differencing each page with its neighbour.

A page is a sequence of lines, one a block. Within a host, pages are ordered by URL path; a page's partner is the neighbour, before or
after, that shares the longer path. The lines of the two are aligned by a longest common subsequence and what they share is deleted: what
a site puts on its pages is not the article. Structure corrects the method where it cannot be right by itself:

- lines inside an article or main element are never deleted: articles quote each other, and copies of one article stand side by side;
- a neighbour with the same article (marked as one, or all plain lines of a page where none is) is a copy and no partner: a copy is told by a hash of it, not by a share;
- lines outside an article that no partner shares stay if they are plain; without a partner nothing is shared, and if a partner shares every plain line of a page
  without a marked article, they stay: it is its text, whoever repeats it;
- lines inside navigation, headers, footers, forms, asides, adverts, notices and comments go even if no partner has them, as on a host with one page. ``n_shared``
  tells how many lines went as a partner shares them, ``n_unshared`` how many went by this rule alone.

A page is scanned once from its beginning to its end, whatever its markup; lines that repeat very often are aligned as exactly as others, by bits (:func:`_by_bits`).

Only hashes of the lines that are up for deletion are sorted and compared; texts are shuffled once, to meet the verdict.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import isqrt
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written

#: Element names and words of class, id or role that mark what is not the article, and words that only say what kind of box it is.
CHROME = set("nav header footer aside form menu dialog button select fieldset".split())
CHROME_WORDS = set("ad ads advert adverts advertisement sponsored promo sidebar notice notices cookie cookies consent banner popup newsletter subscribe share social related recommended breadcrumb breadcrumbs menu navbar navigation nav header footer comment comments reply replies widget pagination masthead disclaimer alert disqus respond toolbar skip".split())
BOX_WORDS = set("area articles bar block body bottom box button buttons col column container content desktop fixed form global group inner item items left link links list mobile modal module outer overlay panel posts primary right row secondary section signup site slot sticky stories strip text thread top unit wrap wrapper zone".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
ARTICLE = {"article", "main"}
WHOLE = {"html", "body", "main"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul head option select textarea button".split())
#: Elements whose end tag HTML lets one leave out, and which the start of another block ends.
LOOSE = set("p li dt dd option tr td th h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())

#: Elements whose content is no markup.
RAW = set("script style noscript template svg iframe title textarea".split())
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
_QUOTE_OR_END = re.compile("[\"'>]")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_JOINT = re.compile(r"[-_\d]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Kinds of a line.
PLAIN, IN_ARTICLE, IN_CHROME = 0, 1, 2
#: Pairs of equal lines, for each line of the two pages, up to which they are gone through one by one; beyond, the same alignment is found by bits.
PAIRS_A_LINE = 32
#: Bytes of masks (where a line occurs) that are kept while two pages are aligned by bits.
MASK_BYTES = 32 << 20


def _is_chrome_token(token: str) -> bool:
    """Whether a class or id is a chrome word, alone or with others and words for boxes (cookie-notice, ad_2, comment-list, but not no-sidebar or post-header)."""
    words = [w for w in _JOINT.split(token) if w]
    return not CHROME_WORDS.isdisjoint(words) and all(w in CHROME_WORDS or w in BOX_WORDS for w in words)


def _is_chrome(name: str, attrs: str, in_article: bool) -> bool:
    """By name, or by the attributes class, id, role, hidden, aria-hidden and style, which on the page, its body and its article say nothing; an article inside another may be a comment."""
    if name in CHROME and not (name == "header" and in_article):
        return True
    if name in WHOLE or name == "article" and not in_article:
        return False
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        tokens = value.split()
        if key == "hidden" or key == "aria-hidden" and tokens == ["true"] or key == "style" and _NOT_SHOWN.search(value) or key == "role" and not ROLES.isdisjoint(tokens) or key in ("class", "id") and any(map(_is_chrome_token, tokens)):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, what, name, attributes) of each piece of markup: what is "open", "close", "raw" (an element and its content that is no markup) or "" (comments and the like).

    A tag ends at the first > outside quotes. Where quotes are not closed, so that no tag ends, they are ordinary signs from there on: each sign is looked at
    a few times at most.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        closes = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closes)
        if not name and not page.startswith(("<!", "<?"), start):
            at = start + 1
            continue
        end = start
        if quotes and name:
            at = name.end()
            while (m := _QUOTE_OR_END.search(page, at)) and m[0] != ">":
                closing = page.find(m[0], m.end())
                at = m.end() if closing < 0 else closing + 1  # a quote without another one is no quote
                if closing < 0 and page.find(">", at) < 0:
                    m = None
                    break
            quotes = m is not None
            end = m.start() if m else start
        if end == start:
            end = page.find(">", start)
            if end < 0:
                return
        at = end + 1
        if not name:
            yield start, at, "", "", ""
            continue
        low = name[0].lower()
        if low in RAW and not closes:
            m = _RAW_END[low].search(page, at)
            at = m.end() if m else len(page)
            yield start, at, "raw", low, ""
        else:
            yield start, at, "close" if closes else "open", low, page[name.end() : end]


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block of the whole page that has text, in page order."""
    found: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    kind, at = PLAIN, 0

    def end_block() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            found.append((line, kind))

    page = page or ""
    for start, end, what, name, attrs in _tags(page):
        text.append(page[at:start])
        at = end
        if what == "raw" or name == "br":
            text.append(" ")
            continue
        if not what:
            continue
        if name in BLOCK:
            end_block()
        if what == "close":
            if opened[name]:
                gone = ""
                while gone != name:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
        elif name not in VOID:
            if name in BLOCK:
                while stack and stack[-1][0] in LOOSE:
                    opened[stack.pop()[0]] -= 1
            outer = stack[-1][1] if stack else PLAIN
            own = IN_CHROME if outer == IN_CHROME or _is_chrome(name, attrs, outer == IN_ARTICLE) else IN_ARTICLE if name in ARTICLE else outer
            if name in BLOCK or own != outer:
                stack.append((name, own))
                opened[name] += 1
        kind_now = stack[-1][1] if stack else PLAIN
        if kind_now != kind:
            end_block()
            kind = kind_now
    text.append(page[at:])
    end_block()
    return found


def _by_pairs(left: list, right: list) -> list[int]:
    """A longest rising chain of the places in ``right`` where the lines of ``left`` occur (each line's places falling, so that a chain takes one at most): places in ``left``, last first."""
    places: dict = {}
    for k, x in enumerate(right):
        places.setdefault(x, []).append(k)
    tails: list[int] = []
    ends: list[tuple] = []
    for k, x in enumerate(left):
        for p in reversed(places.get(x, ())):
            at = bisect_left(tails, p)
            node = (k, ends[at - 1] if at else None)
            tails[at : at + 1], ends[at : at + 1] = [p], [node]
    chain, node = [], ends[-1] if ends else None
    while node:
        chain.append(node[0])
        node = node[1]
    return chain


def _by_bits(left: list, right: list) -> list[int]:
    """The chain that :func:`_by_pairs` finds, by one number a line of ``left``: its bit p is 0 where a line more of ``right``, up to p, makes the common subsequence with ``left`` up to there longer.

    These zeros are ``tails``. The chain is found from its end: of a link at p the line is the last one that equals right[p], and the link before it is the highest zero below p before that line. Numbers
    are kept for one line in about sqrt(lines), and the others are worked out again from these: pairs cost a 64th or so of a step each and no memory.
    """
    both = set(left) & set(right)
    kept = [k for k, x in enumerate(left) if x in both]
    right = [x for x in right if x in both]
    places: dict = {}
    for k, x in enumerate(right):
        places.setdefault(x, []).append(k)
    size = len(right) // 8 + 1

    @lru_cache(maxsize=MASK_BYTES // size + 1)
    def mask(x: int) -> int:
        bits = bytearray(size)
        for p in places[x]:
            bits[p >> 3] |= 1 << (p & 7)
        return int.from_bytes(bits, "little")

    full = (1 << len(right)) - 1
    stride = isqrt(len(kept)) + 1
    row, starts = full, []
    for n, k in enumerate(kept):
        if n % stride == 0:
            starts.append(row)
        hit = row & mask(left[k])
        row = ((row + hit) | (row ^ hit)) & full
    chain: list[int] = []
    p = (row ^ full).bit_length() - 1
    for block in reversed(range(len(starts))):
        row, rows = starts[block], []
        lines_of = kept[block * stride : (block + 1) * stride]
        for k in lines_of:
            rows.append(row)
            hit = row & mask(left[k])
            row = ((row + hit) | (row ^ hit)) & full
        for k, row in zip(reversed(lines_of), reversed(rows), strict=True):
            if p < 0:
                return chain
            if left[k] == right[p]:
                chain.append(k)
                p = (~row & ((1 << p) - 1)).bit_length() - 1
    return chain


def _common(a: list, b: list) -> set[int]:
    """Indices of ``a`` in a longest common subsequence of a and b, always the same one: by pairs of equal lines or, where these are more than PAIRS_A_LINE a line, by bits, which finds the same chain."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    end = len(a) - tail
    left, right = a[head:end], b[head : len(b) - tail]
    counts = Counter(right)
    many = sum(counts[x] for x in left) > PAIRS_A_LINE * (len(left) + len(right))
    return {*range(head), *range(end, len(a)), *(head + k for k in (_by_bits if many else _by_pairs)(left, right))}


def shared_lines(own: list[int], lengths: list[int], partner: list[int] | None, marked: bool) -> list[bool]:
    """Which of a page's lines outside an article (hashes, with their lengths, 0 for those in chrome) its partner shares. If those are all plain lines of a page without a marked article, they are its text."""
    common = _common(own, partner) if partner else set()
    if not marked and all(k in common for k, n in enumerate(lengths) if n):
        common = {k for k in common if not lengths[k]}
    return [k in common for k in range(len(own))]


_LINES = "texts array<string>, kinds array<tinyint>, places array<int>, hashes array<long>, lengths array<int>, article long, marked boolean"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _article(found: list[tuple[str, int]], marked: bool) -> int | None:
    """A hash of the lines inside an article element or, where none is marked, of the plain lines; null without any."""
    inside = [t for t, k in found if k == (IN_ARTICLE if marked else PLAIN)]
    return _hash("\n".join(inside)) if inside else None


def _places(found: list[tuple[str, int]]) -> list[int]:
    before = accumulate((k != IN_ARTICLE for _, k in found), initial=0)
    return [-1 if k == IN_ARTICLE else n for (_, k), n in zip(found, before, strict=False)]


def _lines_of(page: Column) -> Column:
    """struct of texts and kinds of all lines, the place of each among those outside an article element (inside: -1), hashes and lengths (0 in chrome) of those outside, a hash of the article, and whether one is marked."""

    @F.arrow_udf(_LINES)
    def taken(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [lines(x.as_py()) for x in batch]
            marked = [any(k == IN_ARTICLE for _, k in f) for f in found]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[k for _, k in f] for f in found], pa.list_(pa.int8())),
                    pa.array([_places(f) for f in found], pa.list_(pa.int32())),
                    pa.array([[_hash(t) for t, k in f if k != IN_ARTICLE] for f in found], pa.list_(pa.int64())),
                    pa.array([[len(t) if k == PLAIN else 0 for t, k in f if k != IN_ARTICLE] for f in found], pa.list_(pa.int32())),
                    pa.array([_article(f, m) for f, m in zip(found, marked, strict=True)], pa.int64()),
                    pa.array(marked, pa.bool_()),
                ],
                ["texts", "kinds", "places", "hashes", "lengths", "article", "marked"],
            )

    return taken(page)


def _host_and_path(url: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_replace(F.substring_index(bare, "/", 1), r"^.*@|:\d+$", ""))
    return host, F.regexp_replace(bare, r"^[^/]*", "")


def neighbours(pages: DataFrame) -> DataFrame:
    """(rid, host, path, hashes, article, ...) -> the same rows with before and after: (path, hashes, article) of the neighbours by path within the host.

    Rows are ordered by range, so a host of any size spreads over partitions; only the two ends of a host in each partition are stitched by
    host.
    """
    order = ["host", "path", "rid"]
    placed = written(pages.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "pages-in-order")
    one = F.struct("path", "hashes", "article")
    near = Window.partitionBy("part", "host").orderBy("path", "rid")
    rows = placed.withColumns({"before": F.lag(one).over(near), "after": F.lead(one).over(near)})
    inner = F.col("before").isNotNull() & F.col("after").isNotNull()
    far = Window.partitionBy("host").orderBy("path", "rid")
    ends = rows.where(~inner).withColumns({"b": F.lag(one).over(far), "a": F.lead(one).over(far)})
    ends = ends.withColumns({"before": F.coalesce("before", "b"), "after": F.coalesce("after", "a")}).drop("a", "b")
    return rows.where(inner).unionByName(ends)


def _partner(path: str, article: int | None, before: dict | None, after: dict | None) -> list[int] | None:
    """The hashes of the neighbour whose path has the longer beginning in common (of the one before, if both have). A neighbour with the same article is none."""
    near = [x for x in (before, after) if x and (article is None or x["article"] != article)]
    return max(near, key=lambda x: len(commonprefix([path, x["path"]])))["hashes"] if near else None


def _verdicts(pages: DataFrame) -> DataFrame:
    """rid and shared: which of the lines outside an article the partner shares."""

    @F.arrow_udf("array<boolean>")
    def compared(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            yield pa.array([shared_lines(own, lengths, _partner(path, article, before, after), marked) for path, own, lengths, article, marked, before, after in rows], pa.list_(pa.bool_()))

    return neighbours(pages).select("rid", compared("path", "hashes", "lengths", "article", "marked", "before", "after").alias("shared"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by one line end; empty if none), n_chars (code points), n_shared and n_unshared (lines that went, see above).

    Null and empty pages have an empty text. A null URL is a page of the nameless host. Pages with the same URL are neighbours; rows that repeat
    are pages of their own. An empty table gives an empty result; other columns are not looked at. ``pages`` must give its rows in the same
    order when read again, as tables do.
    """
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = numbered(given, "rid").select("rid", "id", "url", _lines_of(F.col("html")).alias("p"))
    host, path = _host_and_path(F.col("url"))
    narrow = rows.select("rid", host.alias("host"), path.alias("path"), "p.hashes", "p.lengths", "p.article", "p.marked")
    verdicts = _verdicts(written(narrow, "page-lines")).withColumnRenamed("rid", "verdict_of")
    joined = rows.select("rid", "id", "url", "p.texts", "p.kinds", "p.places").join(verdicts, F.col("rid") == F.col("verdict_of"), "left")
    zipped = F.transform(F.arrays_zip("texts", "kinds", "places"), lambda x: F.struct(x["texts"].alias("text"), x["kinds"].alias("kind"), ((x["kinds"] != IN_ARTICLE) & F.coalesce(F.get("shared", x["places"]), F.lit(False))).alias("shared")))
    judged = joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), zipped.alias("lines"))
    text = F.array_join(F.transform(F.filter("lines", lambda x: ~x["shared"] & (x["kind"] != IN_CHROME)), lambda x: x["text"]), "\n")
    count = lambda test: F.size(F.filter("lines", test)).cast("long")
    out = judged.select(id_col, url_col, text.alias("text"), count(lambda x: x["shared"]).alias("n_shared"), count(lambda x: ~x["shared"] & (x["kind"] == IN_CHROME)).alias("n_unshared"))
    return out.select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_unshared")
