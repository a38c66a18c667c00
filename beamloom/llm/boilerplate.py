"""Main text of pages: what their host doesn't repeat, held against what the pages declare.

The method is a suffix array per host: the token streams of a host's pages (words and block borders) are laid one after the
other, their suffixes are sorted, and neighbours that share ``DEPTH`` tokens or more are substrings that repeat. What is
covered by substrings that occur on distinct pages is boilerplate; unique runs stay.

At scale the array is sparse and in two layers. Suffixes are kept at block starts and at the minima of token hashes within
every ``SPAN`` starts, so two equal stretches of DEPTH + SPAN - 1 tokens, or of DEPTH tokens from a block's start, always
keep a common suffix. A task sorts the suffixes of a bounded run of pages by host and tokens, and hands on one row per class
of equal suffixes; classes of all tasks meet by hash in one aggregate, which is combined before the shuffle, so a menu
that stands on a third of all pages is one row per run. A class with two distinct pages is repeated.

That alone can't give right results: a copied article is a repeated substring like any menu, and a host with one page
repeats nothing. So the array judges every block of every page, and an exact check by declarations (``markup``) follows: of a page that
declares its article (article, main) the text is that article, whole, repeated or not; chrome that a page declares is never text.

Defined cases: null or empty html has an empty text. A null URL is of the host ''. Pages with equal html are one page to the
array, so copies of a page don't remove its text; pages that differ only a little do lose what they share. A block with at least
half of its tokens covered is removed whole, any other is kept whole. Repeated rows give repeated results; an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamloom.llm.markup import blocks
from beamloom.llm.urlgraph import host_of
from beamloom.session import cut

DEPTH = 8
SPAN = 16
#: Characters of html whose suffixes are sorted at once.
RUN_CHARS = 8_000_000
#: Characters of html that are judged at once.
JUDGED_CHARS = 1_000_000
#: Repeated suffixes that are sent to all tasks, at most (8 bytes each).
BROADCAST_HASHES = 2_000_000
BORDER = "\n"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(found: Iterable[tuple[str, str]]) -> list[str]:
    """Tokens of a page: the words of its blocks, a border after each, and borders at the end for the last suffixes."""
    out: list[str] = []
    for text, _ in found:
        out += text.split(" ")
        out.append(BORDER)
    return out + [BORDER] * (DEPTH - 1) if out else out


class Run:
    """Token streams of some pages, one after the other, and their kept suffixes."""

    def __init__(self, streams: list[list[str]], hosts: list[str]):
        import xxhash

        sizes = np.array([len(s) for s in streams], np.int64)
        self.page = np.repeat(np.arange(len(streams)), sizes)
        self.first = np.cumsum(sizes) - sizes
        coded = pa.array([t for s in streams for t in s], pa.string()).dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        names = np.array([xxhash.xxh64_intdigest(t) for t in coded.dictionary.to_pylist()], np.uint64)
        self.token = names[self.code] if len(names) else np.empty(0, np.uint64)
        known = {h: xxhash.xxh64_intdigest("host " + h) for h in set(hosts)}
        order = {h: i for i, h in enumerate(sorted(known))}
        self.host = np.array([order[h] for h in hosts], np.int64)
        self.host_hash = np.array([known[h] for h in hosts], np.uint64)
        self.border = next((i for i, t in enumerate(coded.dictionary.to_pylist()) if t == BORDER), -1)
        self.ahead = self.token
        self.starts = self._kept(sizes)

    def _kept(self, sizes: np.ndarray) -> np.ndarray:
        """Starts of the kept suffixes: block starts, and the leftmost minima of every SPAN starts of a page."""
        n = len(self.code)
        if not n:
            return np.empty(0, np.int64)
        left = np.repeat(self.first + sizes, sizes) - np.arange(n)  # tokens of the page from here on
        whole = left >= DEPTH
        ahead = np.zeros(n, np.uint64)
        for k in range(DEPTH):
            ahead[: n - k] = ahead[: n - k] * _MUL + self.token[k:] if k else self.token
        self.ahead = _mix(ahead)
        # the least hash of each SPAN starts, ties to the left; starts without DEPTH tokens never win
        score = np.where(whole, self.ahead >> np.uint64(1), np.uint64(2**63))
        marks = np.zeros(n, bool)
        if n >= SPAN:
            seen = np.lib.stride_tricks.sliding_window_view(score, SPAN)
            for lo in range(0, len(seen), 1 << 20):
                part = seen[lo : lo + (1 << 20)]
                own = np.arange(lo, lo + len(part))
                own = own[self.page[own] == self.page[own + SPAN - 1]]  # no stretch spans two pages
                marks[part[own - lo].argmin(1) + own] = True
        block = np.ones(n, bool)
        block[1:] = (self.code[:-1] == self.border) & (self.code[1:] != self.border)
        block[self.first[sizes > 0]] = True
        return np.flatnonzero((marks | block) & whole)

    def array(self) -> tuple[np.ndarray, np.ndarray]:
        """The kept suffixes in order of host and tokens, and the class of each: neighbours that share DEPTH tokens."""
        s = self.starts
        at = [self.code[s + k] for k in range(DEPTH)]
        bits = max(1, int(self.code.max()).bit_length()) if len(s) else 1
        per = max(1, 62 // bits)
        keys = [self.host[self.page[s]]]
        for lo in range(0, DEPTH, per):
            key = at[lo]
            for k in range(lo + 1, min(lo + per, DEPTH)):
                key = (key << bits) | at[k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(s), bool)
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        return s[order], np.cumsum(new)

    def hash_of(self, starts: np.ndarray) -> np.ndarray:
        return _mix(self.ahead[starts] ^ self.host_hash[self.page[starts]]).view(np.int64)


def classes(keys: list[int], streams: list[list[str]], hosts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, least and greatest page key of every class of equal suffixes of a run."""
    run = Run(streams, hosts)
    starts, cls = run.array()
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    heads = np.flatnonzero(np.diff(cls, prepend=-1))
    page = np.array(keys, np.int64)[run.page[starts]]
    return run.hash_of(starts[heads]), np.minimum.reduceat(page, heads), np.maximum.reduceat(page, heads)


def _runs(parts: Iterator[pa.RecordBatch], limit: int = RUN_CHARS) -> Iterator[tuple[list[int], list[str], list[tuple[list, bool]]]]:
    """Keys, hosts and blocks of pages, in runs of about ``limit`` characters of html (one page may be more)."""
    keys, hosts, found, size = [], [], [], 0
    for b in parts:
        for key, host, html in zip(*(b.column(c) for c in ("key", "host", "html"))):
            text = html.as_py()
            keys.append(key.as_py())
            hosts.append(host.as_py())
            found.append(blocks(text))
            size += len(text)
            if size >= limit:
                yield keys, hosts, found
                keys, hosts, found, size = [], [], [], 0
    if keys:
        yield keys, hosts, found


CLASS = "h long, lo long, hi long"


def repeated(pages: DataFrame, run_chars: int = RUN_CHARS) -> DataFrame:
    """h: hashes of suffixes that occur on distinct pages of a host. ``pages`` has key, host and html."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, hosts, found in _runs(parts, run_chars):
            h, lo, hi = classes(keys, [stream(f) for f, _ in found], hosts)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(lo), pa.array(hi)], names=["h", "lo", "hi"])

    met = pages.select("key", "host", "html").mapInArrow(run, CLASS)
    return met.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("h")


def with_suffixes(pages: DataFrame) -> DataFrame:
    """The pages, all columns, with ``suffixes``, the hashes of their kept suffixes in reading order."""
    names = pages.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            hashes = []
            for host, html in zip(b.column(names.index("host")), b.column(names.index("html"))):
                r = Run([stream(blocks(html.as_py())[0])], [host.as_py()])
                hashes.append(r.hash_of(r.starts))
            lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(h) for h in hashes]).astype(np.int32), pa.array(np.concatenate(hashes or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*names, "suffixes"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("suffixes", T.ArrayType(T.LongType()))]))


def unique_blocks(found: list[list[tuple[str, str]]], hosts: list[str], hits: np.ndarray) -> list[list[bool]]:
    """Of every block of some pages, whether repeats (sorted hashes ``hits``) cover less than half of its tokens."""
    r = Run([stream(f) for f in found], hosts)
    h, start = r.hash_of(r.starts), r.starts
    again = hits[np.minimum(np.searchsorted(hits, h), len(hits) - 1)] == h if len(hits) else np.zeros(len(h), bool)
    stop = start + DEPTH
    # two repeated suffixes of a page with none between them, at most SPAN apart, are one run
    one = again[:-1] & again[1:] & (start[1:] <= start[:-1] + DEPTH + SPAN) & (r.page[start[1:]] == r.page[start[:-1]])
    stop[:-1] = np.where(one, np.maximum(stop[:-1], start[1:]), stop[:-1])
    cover = np.bincount(start[again], minlength=len(r.code) + 1) - np.bincount(stop[again], minlength=len(r.code) + 1)
    covered = np.append(0, np.cumsum(np.cumsum(cover) > 0))
    out = []
    for at, blocks_of in zip(r.first, found):
        out.append([])
        for text, _ in blocks_of:
            size = text.count(" ") + 1
            out[-1].append(2 * int(covered[at + size] - covered[at]) < size)
            at += size + 1
    return out


def main_texts(htmls: list[str], hosts: list[str], hits: np.ndarray) -> list[str]:
    """Main text of pages: the blocks outside chrome that the array finds unique, held against what the page declares.

    The check is exact: of a page that declares its article, blocks of the article that the array takes for repeats are put
    back, and unique ones beside it are taken out.
    """
    pages = [blocks(h) for h in htmls]
    out = []
    for (found, declared), unique in zip(pages, unique_blocks([f for f, _ in pages], hosts, hits)):
        out.append("\n".join(t for (t, region), own in zip(found, unique) if (region == "content" if declared else own and region != "chrome")))
    return out


def _judged(pages: DataFrame, known: Broadcast | None) -> DataFrame:
    """Columns of ``pages`` but host, key, html and hits, and ``text``. Repeats are those known, or each page's own ``hits``."""
    names = pages.columns
    kept = [c for c in names if c not in ("host", "key", "html", "hits")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            htmls, hosts, texts, at = b.column(names.index("html")).to_pylist(), b.column(names.index("host")).to_pylist(), [], 0
            while at < len(htmls):
                size, end = len(htmls[at]), at + 1
                while end < len(htmls) and size + len(htmls[end]) <= JUDGED_CHARS:
                    size, end = size + len(htmls[end]), end + 1
                # a hash names the host too, so the pages' hits can be looked up together
                hits = known.value if known else np.unique(np.array([h for x in b.column(names.index("hits")).slice(at, end - at).to_pylist() for h in x or ()], np.int64))
                texts += main_texts(htmls[at:end], hosts[at:end], hits)
                at = end
            yield pa.RecordBatch.from_arrays([*b.select(kept).columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.mapInArrow(run, T.StructType([*[f for f in pages.schema.fields if f.name in kept], T.StructField("text", T.StringType())]))


def article_text(html: str, host: str = "", hits: set[int] = frozenset()) -> str | None:
    """The declared article of a page, or nothing if it declares none."""
    found, declared = blocks(html)
    return "\n".join(t for t, region in found if region == "content") if declared else None


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", run_chars: int = RUN_CHARS, broadcast: int = BROADCAST_HASHES) -> DataFrame:
    """id, url, text of every page, each judged by the array of its host.

    Up to ``broadcast`` repeated suffixes are sent to all tasks, and pages are never shuffled. Beyond that, pages are written with the
    hashes of their suffixes, which are looked up among the repeated ones.
    """
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    host = F.coalesce(host_of(F.col(f"`{url}`")), F.lit(""))
    p = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), host.alias("host"), F.xxhash64(body).alias("key"), body.alias("html"))
    again = cut(repeated(p, run_chars), "repeated-suffixes")
    if again.count() <= broadcast:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(again.toPandas()["h"].to_numpy(np.int64)))
        decided = _judged(p, known)
    else:
        marked = cut(with_suffixes(p), "page-suffixes")
        wanted = marked.select("host", "key", F.explode("suffixes").alias("h")).distinct()
        hits = wanted.join(again, "h").groupBy("host", "key").agg(F.collect_list("h").alias("hits"))
        decided = _judged(marked.drop("suffixes").join(hits, ["host", "key"], "left"), None)
    return decided.select(F.col("id").alias(id), F.col("url").alias(url), "text")
