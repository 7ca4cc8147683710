"""Main text of pages by wrappers that are inferred for each host.

The pages of a host are aligned into one union-free regular expression over elements and
text slots: a mismatch becomes an optional item, and repetition becomes a repeated item or
group. What an item means is decided once for the whole wrapper, from its element, its
markers, and what its slots held on all pages. Each page is then read through its host's
wrapper, and the text in its content slots is the result.

Wrappers are small and merge in any grouping: each task folds the pages it reads, then
partial wrappers of a host are folded in two steps, so a host with a third of all pages is
never gathered. Pages join their wrapper by host; the wrapper side is unique.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.llm.batches import pieces
from weektide.llm.common import ascii_lower, written
from weektide.llm.markup import BLOCK, DROPPED, Element, parse

OPTIONAL, REPEATED = 1, 2
# Longest repeated group that is looked for, and items of one element beyond which they become
# one repeated group of optional items. There are a few hundred different keys, so this bounds wrappers.
GROUP = 4
WIDE = 48
# Hosts that one task folds at once before it hands on partial wrappers, and the number of
# parts in which the partial wrappers of a host are folded first.
HOSTS = 2000
PARTS = 64

# A fixed text is frame if so many different pages share it, and more than half of the host's. Slots and
# hosts keep the smallest digests of so many different pages, so the half is exact up to that number of
# them and taken on a sample beyond.
SHARED = 3
DIGESTS = 32

# Markers of what surrounds the content.
FRAMES = {"-", "c", "h"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SPACE = re.compile(r"\s+")


class Item:
    """Part of a wrapper: an element, a text slot (key ``#``) or a group (key ``()``)."""

    __slots__ = ("key", "flags", "pages", "words", "links", "constant", "items", "seen", "role")

    def __init__(self, key: str, flags: int = 0, pages: int = 1, words: int = 0, links: int = 0, constant: int | None = None, items: list[Item] | None = None, seen: tuple[int, ...] = ()):
        self.key, self.flags, self.pages, self.words, self.links, self.constant = key, flags, pages, words, links, constant
        self.items = items if items is not None else []
        # Digests of the texts of different pages: of fixed slots and of the whole wrapper.
        self.seen = seen
        self.role = ""

    @property
    def name(self) -> str:
        return self.key.partition(":")[0]

    @property
    def mark(self) -> str:
        return self.key.partition(":")[2]

    def shape(self) -> str:
        return f"({' '.join(i.shape() for i in self.items)})" if self.key == "()" else self.key

    def plain(self) -> list:
        return [self.key, self.flags, self.pages, self.words, self.links, self.constant, [i.plain() for i in self.items], self.seen]


def item_of(data: list) -> Item:
    return Item(*data[:6], [item_of(x) for x in data[6]], tuple(data[7]))


def page_items(element: Element, linked: bool = False, seen: tuple[int, ...] = ()) -> list[Item]:
    """Items of one page's element, already folded."""
    items = []
    for child in element.children:
        if isinstance(child, str):
            text = SPACE.sub(" ", child).strip()
            if text:
                n = text.count(" ") + 1
                items.append(Item("#", words=n, links=n * linked, constant=zlib.crc32(text.encode("utf-8", "replace")), seen=seen))
        else:
            items.append(Item(child.key, items=page_items(child, linked or child.name == "a", seen)))
    return fold(items)


def merge(a: Item, b: Item, same_page: bool = False) -> Item:
    """What fits both; two occurrences on the same page count the page once."""
    constant = a.constant if a.constant == b.constant else None
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    seen = united(a.seen, b.seen) if constant is not None or a.key == "#page" else ()
    return Item(a.key, a.flags | b.flags, pages, a.words + b.words, a.links + b.links, constant, align(a.items, b.items, same_page), seen)


def united(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """The smallest digests of both, in order."""
    if a == b or not b or (len(a) == DIGESTS and b[0] > a[-1]):
        return a
    return tuple(sorted({*a, *b})[:DIGESTS])


def repeat(a: Item, b: Item) -> Item:
    out = merge(a, b, same_page=True)
    out.flags |= REPEATED
    return out


def shapes(items: list[Item]) -> list[str]:
    return [i.shape() for i in items]


def fold(items: list[Item]) -> list[Item]:
    """Equal neighbours become one repeated item, and repeated stretches of items one repeated group.

    Items are taken one by one, and only the tail of what is already folded can change.
    """
    out: list[Item] = []
    for item in items:
        out.append(item)
        while shorter(out):
            pass
    if len(out) > WIDE:
        members: dict[str, Item] = {}
        for item in flat(out):
            members[item.key] = repeat(members[item.key], item) if item.key in members else item
        for item in members.values():
            item.flags |= OPTIONAL
        out = [Item("()", REPEATED, items=list(members.values()))]
    return out


def shorter(out: list[Item]) -> bool:
    """Fold the tail once, if it repeats."""
    last = out[-1]
    if len(out) > 1 and out[-2].shape() == last.shape():
        out[-2:] = [repeat(out[-2], last)]
        return True
    if last.key == "()":
        n = len(last.items)
        if len(out) > n and shapes(out[-1 - n : -1]) == shapes(last.items):
            out[-1 - n :] = [repeat(Item("()", items=out[-1 - n : -1]), last)]
            return True
    for n in range(2, GROUP + 1):
        tail = out[-n:]
        if len(out) <= n or any(i.key == "()" for i in tail):
            break
        group = out[-n - 1]
        if group.key == "()" and len(group.items) == n and shapes(group.items) == shapes(tail):
            out[-n - 1 :] = [repeat(group, Item("()", items=tail))]
            return True
        if len(out) >= 2 * n and shapes(out[-2 * n : -n]) == shapes(tail):
            out[-2 * n :] = [repeat(Item("()", items=out[-2 * n : -n]), Item("()", items=tail))]
            return True
    return False


def flat(items: list[Item]) -> list[Item]:
    """Items with the members of groups in their place."""
    return [x for i in items for x in (flat(i.items) if i.key == "()" else [i])]


def align(a: list[Item], b: list[Item], same_page: bool = False) -> list[Item]:
    """One list that both fit: longest common subsequence by shape, the others optional."""
    left, right = [i.shape() for i in a], [i.shape() for i in b]
    if left == right:
        return [merge(x, y, same_page) for x, y in zip(a, b)]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(right) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if left[i] == right[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i] == right[j]:
            out.append(merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        else:
            first = j >= len(right) or (i < len(left) and best[i + 1][j] >= best[i][j + 1])
            item = a[i] if first else b[j]
            item.flags |= OPTIONAL
            out.append(item)
            i, j = (i + 1, j) if first else (i, j + 1)
    return fold(out)


# --- what the items mean ---------------------------------------------------------------


def decide(wrapper: Item) -> None:
    """Set the roles: ``root`` of the content, ``drop``, ``heading`` (only headings count), and
    ``frame`` or ``links`` for slots that belong to the page's frame where no root is known."""
    every: list[tuple[Item, bool, bool]] = []

    def walk(item: Item, framed: bool, commented: bool) -> None:
        framed = framed or item.mark in FRAMES or item.name in DROPPED
        commented = commented or item.mark == "c"
        every.append((item, framed, commented))
        for child in item.items:
            walk(child, framed, commented)

    walk(wrapper, False, False)
    tiers: list[Callable[[Item, bool, bool], bool]] = [
        lambda i, framed, commented: i.name == "article" and not framed,
        lambda i, framed, commented: i.name == "main" and not framed,
        lambda i, framed, commented: i.mark == "+" and i.name not in ("body", "a", "span") and not framed,
        lambda i, framed, commented: i.name in ("article", "main") and not commented and i.mark != "-",
    ]
    roots = next((found for tier in tiers if (found := {id(i) for i, f, c in every if tier(i, f, c)})), set())

    host = set(wrapper.seen)

    def holds_root(item: Item) -> bool:
        return id(item) in roots or any(holds_root(x) for x in item.items)

    def settle(item: Item, inside: bool, linked: bool, block: Item) -> None:
        mark, name = item.mark, item.name
        if name in BLOCK:
            block = item
        if id(item) in roots and not inside:
            item.role, inside = "root", True
        elif mark == "h":
            item.role = "heading" if inside else "" if holds_root(item) else "drop"
        elif (mark in FRAMES or name in DROPPED) and name not in ("html", "body") and not holds_root(item):
            item.role = "drop"
        elif item.key == "#" and not inside:
            total = max(1, sum_of(block, "words"))
            shared = len(item.seen) >= SHARED and 2 * len(host.intersection(item.seen)) > len(host)
            item.role = "links" if 2 * sum_of(block, "links") > total else "frame" if shared else ""
        for child in item.items:
            settle(child, inside, linked or name == "a", block)

    settle(wrapper, False, False, wrapper)


def sum_of(item: Item, what: str) -> int:
    return getattr(item, what) + sum(sum_of(x, what) for x in item.items)


def decided(wrapper: Item) -> str:
    """The wrapper with roles as compact text: ``[key, role, items]``, groups laid flat."""
    decide(wrapper)

    def plain(item: Item) -> list:
        return [item.key, item.role, [plain(x) for x in flat(item.items)]]

    return json.dumps(plain(wrapper), separators=(",", ":"))


# --- reading pages through a wrapper ----------------------------------------------------


class Page:
    """Text blocks of one page, read through its wrapper."""

    def __init__(self, wrapper: list, tree: Element):
        self.rooted: list[str] = []
        self.plain: list[str] = []
        self.whole: list[str] = []
        self.open: dict[str, list[str]] = {"rooted": [], "plain": [], "whole": []}
        self.linked = {"rooted": 0, "plain": 0, "whole": 0}
        self.read(wrapper, tree, inside=False, heading=False, linked=False)
        self.end()

    def end(self) -> None:
        """Close a block. Without a content root, a block that is mostly links is navigation."""
        for kind, parts in self.open.items():
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text and 2 * self.linked[kind] <= len(text):
                getattr(self, kind).append(text)
            parts.clear()
            self.linked[kind] = 0

    def read(self, wrapper: list, element: Element, inside: bool, heading: bool, linked: bool) -> None:
        """Children find their items in order; in a repeated part the search goes round again."""
        items, at = wrapper[2], 0
        for child in element.children:
            if isinstance(child, str):
                item = None
                if child.strip():
                    item, at = following(items, at, "#")
                self.add(child, inside and not heading, item[1] if item else "", linked)
                continue
            if child.name == "br":
                self.add(" ", inside, "", False)
                continue
            item, at = following(items, at, child.key)
            role = item[1] if item else ""
            block = child.name in BLOCK
            if block:
                self.end()
            if role != "drop":
                opens = heading and child.name in HEADINGS
                self.read(
                    item or [child.key, "", []],
                    child,
                    inside or role == "root",
                    (heading or role == "heading") and not opens,
                    linked or child.name == "a",
                )
            if block:
                self.end()

    def add(self, text: str, rooted: bool, role: str, linked: bool) -> None:
        if rooted:
            self.open["rooted"].append(text)
        for kind in ("plain", "whole"):
            if role == "" or (role == "frame" and kind == "whole"):
                self.open[kind].append(text)
                self.linked[kind] += linked * len(text.strip())

    def text(self) -> str:
        """The blocks under content roots; a page without one gives all that is not frame, and its
        fixed texts where nothing else is left."""
        return "\n".join(self.rooted or self.plain or self.whole)


def following(items: list, at: int, key: str) -> tuple[list | None, int]:
    for i in (*range(at, len(items)), *range(at)):
        if items[i][0] == key:
            return items[i], i
    return None, at


def main_text(page: str | None, wrapper: str | list) -> str:
    return Page(json.loads(wrapper) if isinstance(wrapper, str) else wrapper, parse(page)).text()


def page_wrapper(page: str | None) -> Item:
    tree = parse(page)
    words = " ".join(words_of(tree))
    # By their texts, so that pages with the same words are one page, whatever their markup.
    seen = (xxhash.xxh64_intdigest(words.encode("utf-8", "replace")),) if words else ()
    return Item("#page", items=page_items(tree, seen=seen), seen=seen)


def words_of(element: Element) -> Iterator[str]:
    for child in element.children:
        if isinstance(child, str):
            yield from child.split()
        elif child.name not in DROPPED:
            yield from words_of(child)


# --- on Spark --------------------------------------------------------------------------


def partial_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host among the pages that a task reads."""
    found: dict[str, Item] = {}

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array([json.dumps(w.plain()) for w in found.values()], pa.string())})
        found.clear()
        return made

    for batch in batches:
        for piece in pieces(batch, "html"):
            for host, page in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
                new = page_wrapper(page)
                found[host] = merge(found[host], new) if host in found else new
            if len(found) > HOSTS:
                yield out()
    yield out()


def folded(wrappers: DataFrame, keys: list[str], finish: bool) -> DataFrame:
    """Wrappers of equal keys folded into one, in a stream over sorted rows: a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_item, done = None, None, []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in done], pa.string()), "wrapper": pa.array([w for _, w in done], pa.string())})
            done.clear()
            return made

        def text(item: Item) -> str:
            return decided(item) if finish else json.dumps(item.plain())

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in keys), batch.column("wrapper").to_pylist())
            for *key, wrapper in rows:
                item = item_of(json.loads(wrapper))
                if key == open_key:
                    open_item = merge(open_item, item)
                    continue
                if open_item is not None:
                    done.append((open_key[0], text(open_item)))
                open_key, open_item = key, item
                if len(done) >= HOSTS:
                    yield out()
        if open_item is not None:
            done.append((open_key[0], text(open_item)))
        yield out()

    ordered = wrappers.repartition(*keys).sortWithinPartitions(*keys, "wrapper")
    return ordered.mapInArrow(run, "host string, wrapper string")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)``: one decided wrapper for each host of ``(host, html)``."""
    parts = pages.select("host", "html").mapInArrow(partial_wrappers, "host string, wrapper string")
    salted = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    return written(folded(folded(salted, ["host", "part"], finish=False), ["host"], finish=True), "wrappers")


def host_of(url):
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame, url: str = "url") -> DataFrame:
    """``(page_id, url, text)`` for every page.

    ``text`` has one line for each block of the content; it is empty for a missing or empty
    page and for one without content. Pages without a usable address share a wrapper.
    Repeated pages are each returned. Other columns play no part.
    """
    keyed = pages.select("page_id", F.col(url).alias("url"), "html", host_of(F.col(url)).alias("host"))
    wrappers = infer_wrappers(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wrapper = None, None
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = []
                for page, data in zip(piece.column("html").to_pylist(), piece.column("wrapper").to_pylist()):
                    if data != last:
                        last, wrapper = data, json.loads(data)
                    texts.append(main_text(page, wrapper))
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = keyed.join(wrappers, "host").select("page_id", "url", "html", "wrapper")
    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
