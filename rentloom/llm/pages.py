"""Main text of web pages by nearest-URL page differencing.

Pages are cut into lines at block elements. Within each host they are sorted by URL path, and each is paired with the
nearby page whose path shares the longest prefix, copies of it left out. The lines of both are aligned by their longest common subsequence;
lines shared with most of a few unlike neighbours belong to the site and are deleted; inside the page's article element
all of them, two at least, must share a line, so that a title or sentence that one neighbour happens to have stays. Two things add to this:
where the article holds most of what is not shared, lines outside it go, and lines in elements that are marked as
navigation, advert, notice, form, comment or the like go even where no other page shares them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from rentloom.llm.common import Stages, bounded_batches, own_columns

# Element names and marks of HTML pages.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
SITE = set("nav footer aside form button select dialog menu head svg canvas object audio video label".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion"
    " related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " teaser toolbar widget widgets alert alerts".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ENDS_PARAGRAPH = BLOCKS - {"option", "caption", "legend"}

# Words that, behind one of the marks, name a container of such things.
CONTAINERS = set("area bar block box button buttons container form group inner item items list links panel posts row section slot unit wrap wrapper".split())
BARRIERS = ("article", "body", "main")
VOTES = 3  # unlike neighbours that decide

TOKEN = re.compile(
    r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>[^>]*)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
LONGEST_TAG = 1 << 16  # code points in which a tag with quoted attributes is looked for; a longer one ends at its first >
PLAIN, ARTICLE, SITE_LINE = 0, 1, 2
FIRM, LIKELY = 2, 1


def _named(value: str) -> int:
    """FIRM if a class or id is a mark, LIKELY if a compound one ends in a mark or names a container of such things."""
    found = 0
    for name in value.split():
        words = re.findall("[a-z0-9]+", name)
        if len(words) == 1 and words[0] in MARKS:
            return FIRM
        if len(words) > 1 and (words[-1] in MARKS or (words[0] in MARKS and words[-1] in CONTAINERS)):
            found = LIKELY
    return found


def _site(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element is marked as none of the page's main text: FIRM, LIKELY or 0."""
    if name in SITE or (name == "header" and not in_article):
        return FIRM
    if not attributes:
        return 0
    found = 0
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return FIRM
        if key == "role" and set(value.split()) & ROLES:
            return FIRM
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            found = max(found, _named(value), FIRM if value == "header" and not in_article else 0)
    return found


class Outline:
    """Lines of one page, and the open elements with where each name stands, so that no tag scans them all."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int]] = []  # text, kind, innermost likely mark around it
        self.parts: list[str] = []
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, in something of the site, in the article, innermost likely mark
        self.depths: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.outer: list[int] = []  # likely mark → the one around it, -1 for none

    def around(self) -> tuple[bool, bool, int]:
        return self.stack[-1][1:] if self.stack else (False, False, -1)

    def end_line(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                site, own, likely = self.around()
                self.lines.append((text, SITE_LINE if site else ARTICLE if own else PLAIN, likely))

    def open(self, name: str, mark: int, site: bool, own: bool, likely: int) -> None:
        if mark == LIKELY and not site:
            self.outer.append(likely)
            likely = len(self.outer) - 1
        self.depths.setdefault(name, []).append(len(self.stack))
        if name in BARRIERS:
            self.barriers.append(len(self.stack))
        self.stack.append((name, site or mark == FIRM, own, likely))

    def is_open(self, name: str) -> bool:
        return bool(self.depths.get(name))

    def close(self, name: str) -> None:
        if not self.is_open(name):
            return
        depth = self.depths[name][-1]
        if self.barriers and self.barriers[-1] > depth and name not in ("html", "body", "article", "main"):
            return
        self.end_line()
        self.cut(depth)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.depths[name].pop()
            if name in BARRIERS:
                self.barriers.pop()

    def judged(self) -> list[tuple[str, int]]:
        """Lines with their kinds. A likely mark around more than half of the text outside the site's elements is none."""
        weight, total = [0] * len(self.outer), 0
        for text, kind, likely in self.lines:
            if kind != SITE_LINE:
                total += len(text)
                if likely >= 0:
                    weight[likely] += len(text)
        for mark in range(len(self.outer) - 1, -1, -1):  # an outer mark has a smaller number
            if self.outer[mark] >= 0:
                weight[self.outer[mark]] += weight[mark]
        holds: list[bool] = []
        for mark, outer in enumerate(self.outer):
            holds.append(2 * weight[mark] <= total or (outer >= 0 and holds[outer]))
        return [(text, SITE_LINE if likely >= 0 and holds[likely] else kind) for text, kind, likely in self.lines]


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the page's lines in order: character references decoded, white space one space, trimmed, none empty.

    One pass; what closes a tag is looked for once, so tags that are never closed do not search the page again.
    """
    out = Outline()
    parts = out.parts
    at, bracket = 0, -1
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            parts.append(page[at:])
            break
        if start > at:
            parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if bracket < start:
            bracket = page.find(">", start)
            bracket = len(page) if bracket < 0 else bracket
        if page.startswith(("<!", "<?"), start):
            at = min(bracket + 1, len(page))
            continue
        token = None
        if bracket < len(page):
            token = TOKEN.match(page, start, min(start + LONGEST_TAG, len(page))) or LOOSE.match(page, start, bracket + 1)
        if not token:
            parts.append("<")
            at = start + 1
            continue
        at = token.end()
        name = token.group("name").lower()
        if token.group("close"):
            if name in BLOCKS:
                out.end_line()
            out.close(name)
            continue
        if name in BLOCKS:
            out.end_line()
        if name == "br":
            parts.append(" ")
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID or token.group("attributes").endswith("/"):
            continue
        if name in ENDS_PARAGRAPH and out.is_open("p"):
            out.close("p")
        if name in ("li", "option", "dt", "dd", "tr", "td", "th") and out.stack and out.stack[-1][0] == name:
            out.end_line()
            out.cut(len(out.stack) - 1)
        site, own, likely = out.around()
        own = own or name in ("article", "main")
        mark = _site(name, token.group("attributes"), own)
        if mark and not site:
            out.end_line()
        if name in BLOCKS or mark:
            out.open(name, mark, site, own, likely)
    out.end_line()
    return out.judged()


def common_places(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``; rows of the table are kept as bit vectors."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[int, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    rows = [full]
    for x in left:
        row = rows[-1]
        hit = row & where.get(x, 0)
        rows.append(((row + hit) | (row - hit)) & full)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    found, i, j = [], len(left), len(right)
    while i and j:
        if length(i - 1, j) == length(i, j):
            i -= 1
        elif length(i, j - 1) == length(i, j):
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(head + i)
    return [*range(head), *reversed(found), *range(len(a) - tail, len(a))]


def kept_places(lengths: list[int], kinds: bytes, codes: list[int], partners: list[list[int]]) -> list[int]:
    """Places of the lines that stay: those marked as the site's go, and those that the site's other pages share.

    Partners are other line lists, nearest first. One that shares at most half of the unmarked text is another page; the
    first VOTES of these decide. A line goes if two of them have it, or the only one there is; inside the article, if all
    of them and at least two have it. If there is no such page, partners that lack a tenth of the text or more decide together: what all
    of them have goes. A page that is within a tenth of all its partners is one of several copies, and all of it stays.
    The article decides over the lines outside it only where it holds most of the text that is not shared.
    """
    own = [i for i, kind in enumerate(kinds) if kind != SITE_LINE]
    weight = sum(lengths[i] for i in own)
    unlike: list[set[int]] = []
    alike: list[set[int]] = []
    for partner in partners:
        found = {i for i in common_places(codes, partner) if kinds[i] != SITE_LINE}
        held = sum(lengths[i] for i in found)
        if 2 * held <= weight:
            unlike.append(found)
            if len(unlike) == VOTES:
                break
        elif 10 * held <= 9 * weight:
            alike.append(found)
    if unlike:
        votes = Counter(i for found in unlike for i in found)
        shared = {i for i, n in votes.items() if n >= (max(2, len(unlike)) if kinds[i] == ARTICLE else min(2, len(unlike)))}
    else:
        shared = set.intersection(*alike) if alike else set()
    left = [i for i in own if i not in shared]
    article = [i for i in left if kinds[i] == ARTICLE]
    return article if 2 * sum(lengths[i] for i in article) > sum(lengths[i] for i in left) else left


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        place = urlsplit(url or "")
        return place.netloc.lower(), place.path.rstrip("/")
    except ValueError:
        return "", url


def with_key(pages: DataFrame) -> DataFrame:
    """page_id, url, html and a key of url and html: rows with the same key have the same text."""
    whole = F.concat(F.coalesce(F.concat(F.length("url").cast("string"), F.lit(":"), F.col("url")), F.lit("-")), F.lit(" "), F.coalesce("html", F.lit("")))
    return own_columns(pages, "page_id", "url", "html").withColumn("key", F.unhex(F.md5(whole.cast("binary"))))


OUTLINE = "key binary, host string, path string, list binary, codes array<bigint>, kinds binary, lengths array<int>"


def outlines(keyed: DataFrame) -> DataFrame:
    """One row per key: host, path and digest of the line list; hash, kind and length of each line, but no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                found = lines_of(page or "")
                codes = np.array([xxh3_64_intdigest(x) - (1 << 63) for x, _ in found], np.int64)
                own = codes[[kind != SITE_LINE for _, kind in found]] if found else codes
                rows.append((key, *host_and_path(url), xxh3_128_digest(own.tobytes()), codes.tolist(), bytes(k for _, k in found), [len(x) for x, _ in found]))
            columns = zip(*rows) if rows else [[]] * 7
            types = [pa.binary(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in OUTLINE.split(", ")])

    return keyed.select("key", "url", "html").mapInArrow(run, OUTLINE).dropDuplicates(["key"])


def prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


NEAR = 4  # partners before and after a page, each with another line list


def recent(held: dict, row: dict) -> None:
    """Note a row as the last of its line list in ``held``, which keeps the NEAR + 1 lists that came last, all of one host."""
    if held and next(iter(held.values()))["host"] != row["host"]:
        held.clear()
    held.pop(row["list"], None)
    held[row["list"]] = row
    if len(held) > NEAR + 1:
        del held[next(iter(held))]


def partners_of(rows: list[dict]) -> Iterator[tuple[dict, list[dict]]]:
    """Each row, in order of host and path, with its partners: up to NEAR on either side, nearest path first."""
    after: list[list[dict]] = []
    held: dict = {}
    for row in reversed(rows):
        recent(held, row)
        after.append([x for x in reversed(held.values()) if x["list"] != row["list"]][:NEAR])
    held = {}
    for row, later in zip(rows, reversed(after)):
        recent(held, row)
        before = [x for x in reversed(held.values()) if x["list"] != row["list"]][:NEAR]
        yield row, sorted({x["list"]: x for x in later + before}.values(), key=lambda x: -prefix(x["path"], row["path"]))


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    return ((part, list(rows)) for part, rows in groupby((row for batch in batches for row in batch.to_pylist()), itemgetter("part")))


def neighbours(sorted_outlines: DataFrame) -> DataFrame:
    """The outlines with those rows of other parts that are partners across an edge, marked by ``guest``.

    Only digests of the NEAR + 1 first and last line lists of each part go through the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            for side, ordered in enumerate((reversed(rows), rows)):
                held: dict = {}
                for row in ordered:
                    recent(held, row)
                found = [(part, side, rank, x["host"], x["list"], x["key"], len({rows[0]["host"], rows[-1]["host"]}) == 1) for rank, x in enumerate(reversed(held.values()))]
                types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["part", "side", "rank", "host", "list", "key", "one_host"])

    edges: dict[tuple[int, int], list] = {}
    kind = "part int, side int, rank int, host string, list binary, key binary, one_host boolean"
    light = sorted_outlines.select("part", "host", "path", "key", "list").repartitionByRange("part").sortWithinPartitions("part", "host", "path", "key")
    for row in sorted(light.mapInArrow(run, kind).collect(), key=lambda x: x["rank"]):
        edges.setdefault((row["part"], row["side"]), []).append(row)
    parts, guests = sorted({part for part, _ in edges}), []
    for at, part in enumerate(parts):
        for side, others in ((1, reversed(parts[:at])), (0, parts[at + 1 :])):
            host, lists = edges[part, 1 - side][-1]["host"], set()
            for other in others:
                rows = edges[other, side]
                if rows[0]["host"] != host:
                    break
                for row in rows:
                    if len(lists) <= NEAR and row["list"] not in lists:
                        lists.add(row["list"])
                        guests.append((bytes(row["key"]), part))
                if len(lists) > NEAR or not rows[0]["one_host"]:
                    break
    wanted = sorted_outlines.sparkSession.createDataFrame(guests, "key binary, target int")
    far = sorted_outlines.join(wanted, "key").withColumn("part", F.col("target")).drop("target").withColumn("guest", F.lit(True))
    return sorted_outlines.withColumn("guest", F.lit(False)).unionByName(far)


def decided(keyed: DataFrame) -> DataFrame:
    """(key, stay): the places of the lines that stay on the page."""
    stages = Stages(keyed.sparkSession, "pages")
    ranged = outlines(keyed).repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id())
    ranged = stages.write(ranged, "outlines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            keys, places = [], []
            for row, near in partners_of(rows):
                if not row["guest"]:
                    keys.append(row["key"])
                    places.append(kept_places(row["lengths"], row["kinds"], row["codes"], [x["codes"] for x in near]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], ["key", "stay"])

    together = neighbours(ranged).repartitionByRange("part").sortWithinPartitions("part", "host", "path", "key")
    return together.mapInArrow(run, "key binary, stay array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null html is empty, and so is the text of a page without main text. A null url is a page without host. Repeated
    rows come back each; an empty table gives an empty result; other columns are not read. Sorting by host and path deals
    a large host over many tasks; pages beyond the edge of a task are brought to it, so texts do not depend on the edges.
    """
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, stay in zip(batch.column("html").to_pylist(), batch.column("stay").to_pylist()):
                lines = lines_of(page or "") if stay else []
                found.append("\n".join(lines[i][0] for i in stay or []))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(np.array([len(x) for x in found], np.int64))],
                ["page_id", "url", "text", "n_chars"],
            )

    keyed = with_key(pages)
    return keyed.join(decided(keyed), "key", "left").select("page_id", "url", "html", "stay").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
