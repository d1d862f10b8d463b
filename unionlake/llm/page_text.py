"""HTML extraction: nearest-URL page differencing.

A page is cut into text lines at block tags.  Pages of a host are sorted by URL path; each page is paired with the neighbour
whose path has the longer common beginning, their lines are aligned by a longest common subsequence, and
shared lines are deleted: menus, footers and notices repeat from page to page.  Markup says the rest: lines inside elements
that are never content (menus, forms, adverts, comments) go even if no neighbour has them, and if a page has an article
only its lines are the text.  A mark on a wrapper outside the article, or on one that holds most of the page, decides nothing.  Inside an article a sentence may be quoted, so there a short line is deleted only if it is shared with both
neighbours at the same place of the article; paragraphs stay, and so does an article that is copied as a whole.
"""

from __future__ import annotations

import hashlib
import html
import os
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unionlake.llm.url_filter import host_of, path_of
from unionlake.session import materialize

#: Elements whose content is never text; elements that are never the article's own; elements that end a line (fixed values).
RAW = frozenset("script style template noscript iframe object svg canvas head title textarea select button math audio video".split())
ASIDE = frozenset("nav aside footer form dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text for people even if they are never closed (fixed values).
CODE = frozenset("script style".split())
#: Tokens of class, id or role that mark what is not the article, alone or joined (``ad-banner``) (fixed values).
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies disqus footer menu modal nav "
    "navbar navigation newsletter notice popup promo related replies reply respond search share sidebar social sponsor sponsored subscribe widget".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_JOINT = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")
ARTICLE, AWAY, MARKED = 1, 2, 4
#: Characters from which a line of an article is a paragraph, which is never deleted (fixed value).
PARAGRAPH = 200


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, flags) of the lines of a page, in order: white space made single, character references decoded, empty lines left
    out.  Flags: ARTICLE inside an article or main element, AWAY inside what is never content.

    A mark outside the article is dropped by an article inside, and if its wrapper holds more than half of the page's text."""
    out: list[tuple[str, int, int]] = []
    page = page or ""
    stack: list[tuple[str, int, int]] = []
    up: list[int] = [0]  # by number of a marked wrapper outside the article: the next such wrapper around it, 0 none
    flags, wrapper, at, held = 0, 0, 0, []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, flags, wrapper))

    for tag in _TAG.finditer(page):
        if tag.start() < at:
            continue
        if tag.start() > at:
            held.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if tag[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if place is not None:
                flush() if stack[place][1:] != (flags, wrapper) else None
                _, flags, wrapper = stack[place]
                del stack[place:]
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else (len(page) if name in CODE else at)
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        new, around = flags, wrapper
        marks = {w for m in _ATTR.finditer(tag[3]) for w in (m[2] or m[3] or m[4] or "").lower().split()} if tag[3] else set()
        marked = any(all(w in MARKS for w in _JOINT.split(t)) for t in marks)
        if name in ("article", "main") or ("main" in marks and "role" in tag[3].lower()):
            if not flags & ARTICLE and not marked:
                new, around = new & ~MARKED, 0
            new |= ARTICLE
        elif name in ASIDE and name != "form" or name == "header" and not flags & ARTICLE:
            new |= AWAY
        elif name == "form" or (marked and name not in ("html", "body")):
            new |= AWAY if flags & ARTICLE else MARKED
            if not flags & ARTICLE:
                up.append(wrapper)
                around = len(up) - 1
        if (new, around) != (flags, wrapper):
            flush()
        stack.append((name, flags, wrapper))
        flags, wrapper = new, around
    rest = page[at:]
    held.append(rest[: m.start()] if (m := re.search(r"<(?:/?[a-zA-Z]|!)[^>]*\Z", rest)) else rest)
    flush()
    inside, total = [0] * len(up), 0
    for text, f, w in out:
        if not f & AWAY:
            total += len(text)
            inside[w] += len(text)
    for w in range(len(up) - 1, 0, -1):  # a wrapper has a larger number than those around it
        inside[up[w]] += inside[w]
    drops = [False] * len(up)
    for w in range(1, len(up)):
        drops[w] = drops[up[w]] or 2 * inside[w] <= total
    return [(text, f & ARTICLE | (AWAY if f & AWAY or drops[w] else 0)) for text, f, w in out]


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared_places(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of the two: equal ends first, between them the longest increasing chain of
    matching places (time grows with the matches, not with the product)."""
    n, m, head, tail = len(a), len(b), 0, 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    where = defaultdict(list)
    for j in range(m - tail - 1, head - 1, -1):
        where[b[j]].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, n - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    middle, link = [], chains[-1] if chains else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(n - tail, n)]


def article_places(found: list[tuple[str, int]]) -> list[int]:
    """Places of the lines of the article."""
    return [i for i, (_, f) in enumerate(found) if f & ARTICLE and not f & AWAY]


def same_places(a: list[int], inside: list[int], b: list[int], other: list[int]) -> set[int]:
    """Places of article lines in ``a`` that are shared with ``b`` and stand as far from the start or the end of its article."""
    n, m, shared = len(inside), len(other), set(shared_places(a, b))
    alike = lambda k, at: 0 <= at < m and a[inside[k]] == b[other[at]]
    return {i for k, i in enumerate(inside) if i in shared and (alike(k, k) or alike(k, m - n + k))}


def main_text(found: list[tuple[str, int]], shared: set[int], repeated: set[int] = frozenset()) -> str:
    """The lines that stay, joined by a space.  shared: places of lines that the nearest neighbour has too; repeated: of
    article lines that both neighbours have at the same place."""
    article = article_places(found)
    if not article:
        return " ".join(t for i, (t, f) in enumerate(found) if not f & AWAY and i not in shared)
    chars = lambda places: sum(len(found[i][0]) for i in places)
    gone = {i for i in article if i in repeated and len(found[i][0]) < PARAGRAPH}
    if 2 * chars(i for i in article if i in repeated) >= chars(article):  # a copied article, not its template
        gone = set()
    return " ".join(found[i][0] for i in article if i not in gone)


def _neighbours(lined: DataFrame) -> DataFrame:
    """(host, path, other, other_inside, far, far_inside): for each URL the lines and article places of the neighbour in path order
    with the longer common beginning of the path, the one before if they are equal, and those of the neighbour on the other side.  Places in the order are numbered by range and by rank inside it, so no host is gathered in one task."""
    first = lined.groupBy("host", "path").agg(F.min(F.struct("page", "key"))["key"].alias("key"))
    urls = lined.join(first, ["host", "path", "key"]).dropDuplicates(["host", "path"]).select("host", "path", "hashes", "inside")
    ordered = urls.repartitionByRange("host", "path").sortWithinPartitions("host", "path").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"))
    ordered = materialize(ordered, "page-order")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n0"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.join(sizes.select("part", "n0", before.alias("before")), "part").select("host", "path", "hashes", "inside", (F.col("before") + F.col("n") - F.col("n0")).alias("place"))
    side = lambda d, s: placed.select(*[F.col(c).alias(f"{s}{c}") for c in ("host", "path", "hashes", "inside")], (F.col("place") + d).alias("place"))
    both = placed.join(side(1, "p"), "place", "left").join(side(-1, "n"), "place", "left")

    def choose(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                common = lambda s: len(os.path.commonprefix([r["path"], r[f"{s}path"]])) if r[f"{s}host"] == r["host"] else -1  # noqa: B023, E731
                p, n = common("p"), common("n")
                near, far = ("p", "n") if p >= max(n, 0) else ("n", "p")
                row = {"host": r["host"], "path": r["path"]}
                for name, s, there in (("other", near, max(p, n) >= 0), ("far", far, min(p, n) >= 0)):
                    row |= {name: r[f"{s}hashes"] if there else None, f"{name}_inside": r[f"{s}inside"] if there else None}
                rows.append(row)
            places, hashes = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("other", hashes), ("other_inside", places), ("far", hashes), ("far_inside", places)]))

    return both.drop("place").mapInArrow(choose, "host string, path string, other array<long>, other_inside array<int>, far array<long>, far_inside array<int>")


def extract(pages: DataFrame, content: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: its id, url and text.

    Null html counts as empty, its text is empty.  Pages of one URL stand at one place of the path order, where the
    smallest id speaks for them (a page is never compared with another of the same URL); a host with one URL has no neighbour, so nothing is shared; a null url is
    the empty URL.  Rows that repeat are extracted one by one."""
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), F.col(content).cast("string").alias("html"))
    keyed = rows.withColumn("key", F.xxhash64("page", "url", "html"))

    def line_up(batches):
        for batch in batches:
            cut = [lines(p) for p in batch.column("html").to_pylist()]
            hashes, inside = pa.array([[line_hash(t) for t, _ in c] for c in cut], pa.list_(pa.int64())), pa.array([article_places(c) for c in cut], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page", "key", "host", "path")), hashes, inside], names=["page", "key", "host", "path", "hashes", "inside"])

    page_type = pages.schema[page_id].dataType.simpleString()
    lined = keyed.select("page", "key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").mapInArrow(line_up, f"page {page_type}, key long, host string, path string, hashes array<long>, inside array<int>")
    lined = materialize(lined.dropDuplicates(["key"]), "page-lines")

    def align(batches):
        for batch in batches:
            shared, repeated = [], []
            for r in batch.drop_columns(["key"]).to_pylist():
                shared.append(shared_places(r["hashes"], r["other"] or []))
                both = r["inside"] and r["other_inside"] and r["far_inside"]
                sides = [same_places(r["hashes"], r["inside"], r[s], r[f"{s}_inside"]) for s in ("other", "far")] if both else [set()]
                repeated.append(sorted(set.intersection(*sides)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, pa.list_(pa.int32())) for x in (shared, repeated))], names=["key", "shared", "repeated"])

    beside = lined.join(_neighbours(lined), ["host", "path"], "left").select("key", "hashes", "inside", "other", "other_inside", "far", "far_inside")
    shared = materialize(beside.mapInArrow(align, "key long, shared array<int>, repeated array<int>"), "page-shared")

    def text(batches):
        for batch in batches:
            found = [main_text(lines(p), set(s or []), set(r or [])) for p, s, r in zip(*(batch.column(c).to_pylist() for c in ("html", "shared", "repeated")))]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(found, pa.string())], names=["page", "url", "text"])

    # always by a shuffle: a small table would be broadcast, a large one not, and the join should act alike at every size
    out = keyed.join(shared.hint("merge"), "key", "left").select("page", "url", "html", "shared", "repeated").mapInArrow(text, f"page {page_type}, url string, text string")
    return out.select(F.col("page").alias(page_id), F.col("url").alias(url), "text")
