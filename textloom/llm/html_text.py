"""Main text of web pages: a host suffix array finds what pages repeat, structure says how much repeating it takes.

A page becomes blocks of text in page order, each with a role that its elements give it: furniture (menus, footers,
asides, scripts, hidden parts; inside an article also boxes whose class names one), content (in ``article`` or
``main``), marked (a class or id outside content names furniture), formed (in a form outside content), or open.
Inside content a class on a paragraph, heading, figure, list item or table never removes it.

All blocks but furniture are then held against what the host's pages repeat. Token streams of a host's pages are
concatenated and their suffixes sorted by prefix doubling over ranks; suffixes that share their first ``RUN`` tokens
are neighbours, and a longer repeated substring is a chain of such runs. A block of fewer tokens, outside content,
is a run of its own. A run is boilerplate if ``SHARE`` of the host's distinct pages, and ``LEAST`` of them,
hold it; in content that takes ``SHARE_KEPT`` and ``LEAST_KEPT``. Tokens in boilerplate go with
what stands between them; the unique rest of a block stays. Pages are distinct by the least runs of their content's
blocks (of all blocks, without content), so copies, and most near copies, count as one. Content of which boilerplate would cover more than half,
or pages without content of which it would cover over ``COPY``, are copies of other pages' and stay whole.

The text is the content that is left. Open blocks join it where they hold more than ``TEASER`` times as much (articles that are but
teasers) or there is no content, with formed ones if those hold more than they (pages wrapped in a form);
if nothing is left, marked blocks are the text.

A host's pages meet in one task up to ``PIECE`` bytes of html, more in as many pieces by page key.
A run on a share of a host's pages is on that share of some piece's pages, so each piece names candidates by its own
suffix array and those of all pieces are counted again over the host's pages: the result is that of one array.
Only runs of boilerplate, bounded by the length of pages, go back to the pages: broadcast while under ``SENT`` bytes, else joined by host.

Defined results: null or empty html gives an empty text; a null url is a host of its own kind;
repeated rows are extracted each; extra columns are ignored; very long and broken pages are read in one linear scan:
a quote that never closes ends at the next >, in the rest of that page too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import stash

RUN, LEAST, SHARE, LEAST_KEPT, SHARE_KEPT, COPY, TEASER = 8, 3, 0.25, 5, 0.5, 0.9, 3
#: Bytes of html of a host in one task at least (of a table of over PIECE * PIECES bytes more), hosts of several pieces at most, bytes broadcast.
PIECE, PIECES, SENT = 16 << 20, 1 << 20, 8 << 20
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
MARKED_BY = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose text isn't read; of these RAW ones go on to the end of the page if they don't end.
SKIPPED = frozenset("script style noscript template iframe svg textarea title select object".split())
RAW = frozenset(("script", "style"))
#: Elements that don't interrupt a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta meter output q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br track embed param area base col".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside menu dialog button head fieldset datalist".split())
CONTENT = frozenset(("article", "main"))
#: Elements of text: inside content their classes don't count.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 figure figcaption blockquote pre table caption thead tbody tfoot tr td th dl dt dd li address".split())
LEAVES = frozenset("p li dt dd tr td th option".split())
#: Parts of a class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer contentinfo sidebar aside complementary "
    "cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond discussion replies reply disqus widget toolbar search form dialog disclaimer gdpr".split()
)
#: Of these, what an article element can itself be.
ASIDE = frozenset("comment comments reply replies related sponsored promo".split())
#: These mark furniture outside content only.
TOP = frozenset(("header", "masthead", "topbar"))
FURNISHED, OPEN, KEPT, FORMED, MARKED = range(5)


@lru_cache(maxsize=65536)
def _role(name: str, attributes: str, outer: int) -> int:
    if outer == FURNISHED or name in FURNITURE or (name == "header" and outer != KEPT):
        return FURNISHED
    role = KEPT if name == "main" or (name == "article" and outer != MARKED) else outer
    if name == "form":
        role = {KEPT: FURNISHED, MARKED: MARKED}.get(outer, FORMED)
    for m in MARKED_BY.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if (key == "hidden" and value != "until-found") or (key == "aria-hidden" and value == "true"):
            return FURNISHED
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return FURNISHED
        elif key in ("class", "id", "role") and name not in ("body", "html", "form") and not (outer == KEPT and name in TEXTUAL):
            parts = set(re.split(r"[^a-z0-9]+", value))
            if parts & (ASIDE if name in CONTENT else MARKS) or (outer != KEPT and name not in CONTENT and parts & TOP):
                role = FURNISHED if outer == KEPT else MARKED
    return role


def elements(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of tags and of what isn't read (without a name), in one linear scan."""
    at, n, last, tag = 0, len(page), page.rfind(">"), TAG
    endless: set[str] = set()  # elements that end nowhere from here on
    while (at := page.find("<", at)) >= 0:
        if at > last:
            if page.startswith("<!--", at):
                yield at, n, "", False, ""
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
            at = end
            continue
        if not page[at + 1 : at + 2].isalpha() and page[at + 1 : at + 2] != "/":
            at += 1
            continue
        m = tag.match(page, at)
        if m is None and tag is TAG and BROKEN.match(page, at):
            tag = BROKEN
            m = tag.match(page, at)
        if m is None:
            at += 1
            continue
        name, end = m[2].lower(), m.end()
        if name in SKIPPED and not m[1] and not m[3].endswith("/"):
            close = None if name in endless else _closing(name).search(page, end)
            if close is not None or name in RAW:
                end = close.end() if close else n
                yield m.start(), end, "", False, name
                at = end
                continue
            endless.add(name)
        yield m.start(), end, name, bool(m[1]), m[3]
        at = end


@lru_cache(maxsize=None)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of the blocks of a page, in order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    inside: Counter[str] = Counter()
    held: list[str] = []
    role, at = OPEN, 0

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((role, text))
            held.clear()

    def push(name: str, new: int) -> None:
        nonlocal role
        stack.append((name, role))
        inside[name] += 1
        role = new

    for start, end, name, closing, attributes in elements(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not name:
            if attributes == "title":
                close()
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            if name in VOID or not (attributes or closing):
                continue
            # An inline element may hide what it holds.
            if not closing and role != FURNISHED and (new := _role(name, attributes, role)) != role:
                close()
                push(name, new)
            elif closing and stack and stack[-1][0] == name:
                close()
                inside[name] -= 1
                role = stack.pop()[1]
            continue
        close()
        if closing:
            if inside[name]:
                while True:
                    other, role = stack.pop()
                    inside[other] -= 1
                    if other == name:
                        break
        elif name == "body":
            role = OPEN
            stack, inside = [], Counter()
            push(name, OPEN)
        elif name not in VOID and name not in LEAVES and not attributes.endswith("/"):
            push(name, _role(name, attributes, role))
        elif name in LEAVES and attributes and role != FURNISHED and (new := _role(name, attributes, role)) != role:
            push(name, new)
    if at < len(page):
        held.append(page[at:])
    close()
    return out


class Stream:
    """Token streams of pages: all blocks but furniture, and their runs, bound to the host."""

    def __init__(self, pages: list[list[tuple[int, str]]], host: np.ndarray) -> None:
        """``pages``: blocks of each; ``host``: a number for each."""
        texts = [t for p in pages for r, t in p if r != FURNISHED]
        self.host = host.astype(np.int64).view(np.uint64)
        self.owner = np.repeat(np.arange(len(pages)), [sum(r != FURNISHED for r, _ in p) for p in pages])
        self.role = np.array([r for p in pages for r, _ in p if r != FURNISHED], np.int64)
        self.tokens, self.block = W.words(*W.raw(pa.array(texts, pa.string())))
        self.page = self.owner[self.block] if len(self.owner) else np.zeros(0, np.int64)
        self.length = np.bincount(self.block, minlength=len(texts))
        n = max(0, len(self.tokens) - RUN + 1)
        self.whole = np.flatnonzero(self.page[:n] == self.page[RUN - 1 : RUN - 1 + n])
        p, value = W.powers(W.ROLL, RUN), self.host[self.page[:n]]
        for j in range(RUN):
            value = value + self.tokens[j : n + j] * p[j]
        self.runs = W.mix(value[self.whole])
        # Blocks shorter than a run, outside content.
        self.short = np.flatnonzero((self.length > 0) & (self.length < RUN) & (self.role != KEPT))
        first = np.cumsum(self.length) - self.length
        own = np.zeros(len(texts), bool)
        own[self.short] = True
        at = np.flatnonzero(own[self.block]) if len(own) else np.zeros(0, np.int64)
        place = at - first[self.block[at]]
        head = np.cumsum(self.length[self.short]) - self.length[self.short]
        total = np.add.reduceat(self.tokens[at] * p[place], head) if len(head) else np.zeros(0, np.uint64)
        self.short_runs = W.mix(W.mix(total + self.length[self.short].astype(np.uint64)) + self.host[self.owner[self.short]])

    def keys(self) -> np.ndarray:
        """A number for each page from the least run of each block of its content, or else of all blocks: copies agree, near copies mostly."""
        n = len(self.host)
        out = W.mix(self.host)
        if not len(self.tokens):
            return out
        block, inside = self.block[self.whole], self.block[self.whole] == self.block[self.whole + RUN - 1]
        least = np.full(len(self.length), np.iinfo(np.uint64).max)
        np.minimum.at(least, block[inside], self.runs[inside])
        # A block without a run of its own counts by all its tokens.
        first = np.cumsum(self.length) - self.length
        place = np.minimum(np.arange(len(self.block)) - first[self.block], RUN)
        total = np.zeros(len(self.length), np.uint64)
        some = np.flatnonzero(self.length)
        total[some] = np.add.reduceat(self.tokens * W.powers(W.ROLL, RUN + 1)[place], first[some])
        value = W.mix(np.where(self.length >= RUN, least, W.mix(total + self.length.astype(np.uint64))))
        content = np.bincount(self.page, weights=self.role[self.block] == KEPT, minlength=n) >= RUN
        use = some[~content[self.owner[some]] | (self.role[some] == KEPT)]
        np.add.at(out, self.owner[use], value[use])
        return out

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array of the hosts' streams to a depth of RUN tokens: which of ``whole`` in the order of their suffixes, and the rank of each one's first RUN tokens."""
        page = self.page
        rank = np.unique(self.tokens ^ W.mix(self.host)[page], return_inverse=True)[1] if len(page) else np.zeros(0, np.int64)
        depth = 1
        while depth < RUN:
            # Rank pairs: a suffix's own rank and that of the one ``depth`` tokens on, none beyond its page.
            on = np.full(len(rank), -1, np.int64)
            same = np.flatnonzero(page[: len(page) - depth] == page[depth:]) if len(page) > depth else np.zeros(0, np.int64)
            on[same] = rank[same + depth]
            rank = np.unique(rank * (len(rank) + 1) + on + 1, return_inverse=True)[1]
            depth *= 2
        rank = rank[self.whole]
        return np.argsort(rank, kind="stable"), rank

    def repeats(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every distinct run: a page that holds it, the run, and on how many pages, distinct by ``key``, it is."""
        order, rank = self.suffixes()
        # Neighbours in the array with equal ranks share a run; short blocks are grouped after them.
        kinds, which = np.unique(self.short_runs, return_inverse=True)
        rank = np.r_[rank[order], (rank.max(initial=-1) + 1 + which)]
        run, page = np.r_[self.runs[order], self.short_runs], np.r_[self.page[self.whole][order], self.owner[self.short]]
        order = np.lexsort((key[page], rank))
        rank, run, page, own = rank[order], run[order], page[order], key[page[order]]
        head = np.flatnonzero(np.r_[len(rank) > 0, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
        fresh = np.r_[len(rank) > 0, (rank[1:] != rank[:-1]) | (own[1:] != own[:-1])] if len(rank) else np.zeros(0, bool)
        count = np.add.reduceat(fresh.astype(np.int64), head) if len(head) else head
        return page[head], run[head], count

    def covered(self, runs: np.ndarray, strict: np.ndarray) -> np.ndarray:
        """Tokens in boilerplate: in one of ``runs``, inside content of ``strict``, but not in pages that are copies."""

        def spread(which: np.ndarray) -> np.ndarray:
            step = np.zeros(len(self.tokens) + 1, np.int64)
            at = self.whole[np.isin(self.runs, which)]
            np.add.at(step, at, 1)
            np.add.at(step, at + RUN, -1)
            return np.cumsum(step[:-1]) > 0

        kept = self.role[self.block] == KEPT
        short = np.zeros(len(self.length), bool)
        short[self.short[np.isin(self.short_runs, runs)]] = True
        inside = spread(strict) & kept
        n = len(self.host)
        of = lambda which: np.bincount(self.page, weights=which, minlength=n)
        outside = ~kept & (spread(runs) | short[self.block])
        copy, whole = 2 * of(inside) > of(kept), (of(kept) == 0) & (of(outside) > COPY * of(~kept))
        return (inside & ~copy[self.page]) | (outside & ~whole[self.page])


def without(text: str, covered: np.ndarray) -> str:
    """``text`` without its ``covered`` words and what follows them up to the next word."""
    data = text.encode()
    start = W.runs(np.frombuffer(data, np.uint8), np.array([0, len(data)]), W.WORD, W.TABLE_LOWER)[2]
    ends = np.r_[start[1:], len(data)]
    start = np.r_[0, start[1:]] if covered[0] else start
    kept, at = [], 0
    for i in np.flatnonzero(covered):
        kept.append(data[at : start[i]])
        at = ends[i]
    return " ".join(b" ".join(x for x in [*kept, data[at:]] if x).decode().split())


def assembled(page: list[tuple[int, str]], left: dict[int, str]) -> str:
    """The text of a page from its blocks; ``left``: what remains of those that hold boilerplate."""
    rest = [(r, left.get(i, t)) for i, (r, t) in enumerate(page)]
    size = Counter()
    for r, t in rest:
        size[r] += len(t)
    use = {KEPT}
    if size[OPEN] + size[FORMED] > TEASER * size[KEPT]:
        use |= {OPEN, FORMED} if size[FORMED] > size[OPEN] else {OPEN}
    if not sum(size[r] for r in use):
        use = {MARKED}
    return "\n".join(t for r, t in rest if r in use and t)


def texts(pages: list[list[tuple[int, str]]], host: np.ndarray, runs: np.ndarray, strict: np.ndarray) -> list[str]:
    """The texts of pages, with the boilerplate runs of their hosts."""
    if not len(runs):
        return [assembled(p, {}) for p in pages]
    stream = Stream(pages, host)
    covered = stream.covered(runs, strict)
    begin = np.r_[0, np.cumsum(stream.length)]
    first = np.searchsorted(stream.owner, np.arange(len(pages)))
    hit: dict[int, list[int]] = {}
    for b in np.unique(stream.block[covered]).tolist():
        hit.setdefault(int(stream.owner[b]), []).append(b)
    out = []
    for i, page in enumerate(pages):
        left = {}
        if i in hit:
            free = [j for j, (r, _) in enumerate(page) if r != FURNISHED]
            for b in hit[i]:
                j = free[b - first[i]]
                left[j] = without(page[j][1], covered[begin[b] : begin[b + 1]])
        out.append(assembled(page, left))
    return out


def parsed(part: pa.RecordBatch) -> list[list[tuple[int, str]]]:
    return [blocks(h or "") for h in part.column("html").to_pylist()]


UNITS = "unit bigint, host bigint, pieces int, bytes bigint, pages binary"


def packed(pages: list[list[tuple[int, str]]], keys: np.ndarray) -> bytes:
    """Pages as compressed bytes, without furniture: keys, blocks a page, roles, texts."""
    free = [[(r, t) for r, t in p if r != FURNISHED] for p in pages]
    table = pa.table({"key": pa.array(keys.view(np.int64)), "role": pa.array([[r for r, _ in p] for p in free], pa.list_(pa.int8())), "text": pa.array([[t for _, t in p] for p in free], pa.list_(pa.string()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> tuple[list[list[tuple[int, str]]], np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return [list(zip(r, t, strict=True)) for r, t in zip(table.column("role").to_pylist(), table.column("text").to_pylist(), strict=True)], table.column("key").to_numpy().view(np.uint64)


def dealt(batches: Iterator[pa.RecordBatch], heavy: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Pages by host, or piece of a heavy host: one row for each of a slice."""
    for batch in batches:
        for part in W.slices(batch, "html"):
            pages, host = parsed(part), part.column("host").to_numpy()
            keys = Stream(pages, host).keys()
            many = np.array([heavy.get(h, 1) for h in host.tolist()], np.uint64)
            # One host and key, one unit.
            unit = W.mix(host.view(np.uint64) + W.mix(W.mix(keys + np.uint64(1)) % many))
            order = np.argsort(unit, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
                own = [pages[i] for i in group]
                size = sum(len(t) for p in own for _, t in p)
                at = group[0]
                row = [unit[at : at + 1].view(np.int64), host[at : at + 1], many[at : at + 1].astype(np.int32), [size]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)), pa.array([packed(own, keys[group])], pa.binary())], names=["unit", "host", "pieces", "bytes", "pages"])


def candidates(rows: list[dict]) -> pa.RecordBatch:
    """Of whole units: distinct pages, and the runs on a share of them with their counts."""
    pages, keys, host, unit, pieces = [], [], [], [], {}
    for r in rows:
        some, own = unpacked(r["pages"])
        pages += some
        keys.append(own)
        host += [r["host"]] * len(some)
        unit += [r["unit"]] * len(some)
        pieces[r["unit"]] = r["host"], r["pieces"]
    key, host, unit = np.concatenate(keys), np.array(host, np.int64), np.array(unit, np.int64)
    stream = Stream(pages, host)
    stream.host = unit.view(np.uint64)  # pieces of a host are sorted apart
    page, run, n = stream.repeats(key)
    units, which = np.unique(unit, return_inverse=True)
    both = np.unique(np.c_[which.astype(np.uint64), key], axis=0)
    distinct = np.bincount(both[:, 0].astype(np.int64), minlength=len(units))
    own = which[page]
    alone = np.array([pieces[u][1] == 1 for u in units.tolist()])
    ok = (n >= SHARE * distinct[own]) & (~alone[own] | (n >= LEAST))
    own, run, n = own[ok], run[ok], n[ok]
    order = np.argsort(own, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(own, minlength=len(units)))].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (run.view(np.int64), n)]
    held = [pieces[u] for u in units.tolist()]
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.int64()), pa.array([p for _, p in held], pa.int32()), pa.array(distinct), *lists], names=["host", "pieces", "pages", "runs", "counts"])


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of unit to candidates, some units' suffix array at a time."""
    held: list[dict] = []
    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held and size > W.BLOCK and row["unit"] != held[-1]["unit"]:
                yield candidates(held)
                held, size = [], 0
            held.append(row)
            size += row["bytes"]
    if held:
        yield candidates(held)


def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, run, key) of pages with the candidates of their host."""
    for batch in batches:
        for part in W.slices(batch, "html"):
            host, wanted = part.column("host").to_numpy(), part.column("runs").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            stream = Stream(parsed(part), host)
            keys = stream.keys()
            run, page = np.r_[stream.runs, stream.short_runs], np.r_[stream.page[stream.whole], stream.owner[stream.short]]
            ok = np.isin(run, wanted)
            both = np.unique(np.c_[host[page[ok]].view(np.uint64), run[ok], keys[page[ok]]], axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, c])) for c in range(3)], names=["host", "run", "key"])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "html"):
            runs, strict = (np.unique(part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64) for c in ("runs", "strict"))
            text = texts(parsed(part), part.column("host").to_numpy(), runs, strict)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def host(url: Column) -> Column:
    """A number for the host of ``url``; hosts that can't be read are one."""
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))))


def attached(pages: DataFrame, by_host: DataFrame, how: str) -> DataFrame:
    """``pages`` with the lists of their host; broadcast only while these are small."""
    size = by_host.agg(F.coalesce(F.sum(F.lit(64) + 16 * F.size("runs")), F.lit(0))).first()[0]
    return pages.join(F.broadcast(by_host) if size <= SENT else by_host, "host", how)


def boilerplate(pages: DataFrame, piece: int = PIECE) -> DataFrame:
    """host, runs and strict (those that count inside content) of hosts that have any; ``pages``: host, html."""
    bytes_of = pages.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"))
    total = bytes_of.agg(F.sum("bytes")).first()[0] or 0
    piece = max(piece, total // PIECES)
    # At most PIECES hosts have more than a piece.
    heavy = {r.host: -(-r.bytes // piece) for r in bytes_of.where(F.col("bytes") > piece).collect()}
    units = pages.mapInArrow(lambda it: dealt(it, heavy), UNITS).repartition("unit").sortWithinPartitions("unit")
    found = stash(units.mapInArrow(arrays, "host bigint, pieces int, pages bigint, runs array<bigint>, counts array<bigint>"))
    out = found.where("pieces = 1").select("host", "pages", F.arrays_zip(F.col("runs").alias("run"), F.col("counts").alias("n")).alias("found"))
    if heavy:
        many = stash(found.where("pieces > 1").groupBy("host").agg(F.sum("pages").alias("pages"), F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")))
        counted = attached(pages, many, "inner").mapInArrow(again, "host bigint, run bigint, key bigint").distinct().groupBy("host", "run").agg(F.count("*").alias("n"))
        counted = counted.groupBy("host").agg(F.collect_list(F.struct("run", "n")).alias("found"))
        out = out.unionByName(counted.join(many, "host").select("host", "pages", "found"))
    enough = lambda least, share: F.transform(F.filter("found", lambda x: (x["n"] >= least) & (x["n"] >= F.col("pages") * share)), lambda x: x["run"])
    return stash(out.select("host", enough(LEAST, SHARE).alias("runs"), enough(LEAST_KEPT, SHARE_KEPT).alias("strict")).where("size(runs) > 0"))


def main_text(pages: DataFrame, piece: int = PIECE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    held = attached(own, boilerplate(own.select("host", "html"), piece), "left")
    return held.select("page_id", "url", "html", "host", "runs", "strict").mapInArrow(extracted, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
