"""Main text of web pages: markup roles, and a suffix array per host for what its pages repeat."""

from __future__ import annotations

import re
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays, exchange
from tickerloom.session import durable_table

# fixed values: elements and attribute words by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of an article.
APART = frozenset(
    "head script style template noscript nav footer aside form button select textarea option iframe object svg canvas video audio dialog menu".split()
)
MAIN = frozenset(["article", "main"])
#: Words of class, id and role that tell of a part which is no article text.
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus login menu modal nav navbar navigation newsletter notice notices pagination pager popup promo "
    "promotion related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Tokens of a repeated run, and pages that must have it.
RUN, PAGES = 12, 3
#: An article of a page whose own text beside it has more than this many times its words is a teaser.
TEASER = 3
#: Pages and characters of a share, whose runs one suffix array brings together; the counts of all shares of a host are added.
SHARE_PAGES, SHARE_CHARS = 400, 4_000_000
#: Runs that a task counts before it sends them on.
COUNTED = 2_000_000


class _Blocks(HTMLParser):
    """Text blocks of a page, each with whether it lies in its article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # element, apart, article
        self.apart = self.main = 0
        self.text: list[str] = []
        self.blocks: list[tuple[str, bool]] = []

    def end_block(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append((text, self.main > 0))
        self.text = []

    def shut(self, at: int):
        for _, apart, main in self.open[at:]:
            self.apart -= apart
            self.main -= main
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_block()
            # a paragraph ends where the next block begins
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self.shut(at)
                    break
                if self.open[at][0] in BLOCKS:
                    break
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "body":
            self.shut(0)  # an unclosed head ends here
        if tag in MAIN and not self.main and self.apart and not self._hinted(attrs):
            # an article inside a part that was never closed
            self.shut(next(i for i, x in enumerate(self.open) if x[1]))
        apart = tag in APART or (tag == "header" and not self.main) or (tag not in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6") and self._hinted(attrs))
        main = tag in MAIN and not apart
        self.open.append((tag, apart, main))
        self.apart += apart
        self.main += main

    @staticmethod
    def _hinted(attrs) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value and not HINTS.isdisjoint(_WORD.findall(value.lower())):
                return True
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_block()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.shut(at)
                break

    def handle_data(self, data):
        if not self.apart:
            self.text.append(data)


def blocks_of(html: str) -> list[tuple[str, bool]]:
    """(text, in the article) of the blocks outside parts that markup sets apart, in page order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser.blocks


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first ``depth`` tokens at least, and each suffix's rank by its first 1, 2, 4, ... tokens.

    By prefix doubling: the rank by 2k tokens sorts pairs of ranks by k tokens, k apart.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while step < depth and rank.max(initial=-1) < n - 1:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else []
        pair = rank * (n + 1) + after + 1
        order = np.argsort(pair, kind="stable")
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        step *= 2
    return order, ranks


def common_prefix(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Tokens that each suffix has in common with the one before it in ``order``, as far as the ranks tell."""
    n = len(order)
    common = np.zeros(n, np.int64)
    if n < 2:
        return common
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        # a rank stands for 2**level tokens only where the suffixes are that long
        same &= (a + (1 << level) <= n) & (b + (1 << level) <= n)
        step = same * (1 << level)
        common[1:] += step
        a, b = a + step, b + step
    return common


def equal_runs(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, ...]:
    """The runs of ``run`` tokens inside streams: their starts in all streams laid end to end, a number that equal runs share, and their streams."""
    sizes = np.array([len(s) for s in streams], np.int64)
    if sizes.sum() < run:
        return (np.zeros(0, np.int64),) * 3
    # a token of its own after each stream, so that no run goes on into the next page
    top = max(int(s.max(initial=0)) for s in streams) + 1
    joined = np.concatenate([np.append(s, top + i) for i, s in enumerate(streams)])
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    end = np.cumsum(sizes + 1) - 1
    order, ranks = suffix_array(joined, run)
    group = np.cumsum(common_prefix(order, ranks) < run)
    inside = order + run <= end[page[order]]
    return order[inside], group[inside], page[order[inside]]


def held_by(group: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run its place among the distinct ones, and for each distinct one the number of pages that have it."""
    _, at = np.unique(group, return_inverse=True)
    width = page.max(initial=0) + 1
    pairs = np.unique(at * width + page) // width
    return at, np.bincount(pairs, minlength=at.max(initial=-1) + 1)


def covered_by(starts: np.ndarray, streams: list[np.ndarray], run: int) -> list[np.ndarray]:
    """Per stream which tokens lie in one of the runs that start at ``starts``."""
    sizes = np.array([len(s) for s in streams], np.int64)
    edge = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    edge[starts] += 1
    edge[starts + run] -= 1
    # starts are distinct, their ends too
    covered = np.cumsum(edge[:-1]) > 0
    first = np.cumsum(sizes + 1) - sizes - 1
    return [covered[a : a + n] for a, n in zip(first, sizes, strict=True)]


def repeated_tokens(streams: list[np.ndarray], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """Per stream which tokens lie in a run of at least ``run`` tokens that ``pages`` (two or more) different streams have."""
    starts, group, page = equal_runs(streams, run)
    at, held = held_by(group, page)
    return covered_by(starts[held[at] >= pages], streams, run)


def streams_of(pages: list[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Per page the numbers of its tokens (a line end, then the words, of each block), and the tokens by number."""
    number: dict[str, int] = {}
    streams = [np.array([number.setdefault(w, len(number)) for block in page for w in ("\n", *block.split(" "))], np.int64) for page in pages]
    return streams, list(number)


def apart_by_host(streams: list[np.ndarray], hosts: list[str]) -> list[np.ndarray]:
    """The streams with numbers that only pages of one host share."""
    number: dict[str, int] = {}
    own = [number.setdefault(h, len(number)) for h in hosts]
    return [s * len(number) + k for s, k in zip(streams, own, strict=True)]


def kept_text(blocks: list[str], hit: np.ndarray) -> str:
    """The blocks without the tokens that are hit; a block of which nothing is left goes."""
    at, kept = 0, []
    for text in blocks:
        block = text.split(" ")
        here = hit[at + 1 : at + 1 + len(block)]
        at += 1 + len(block)
        if not here.all():
            kept.append(" ".join([w for w, gone in zip(block, here.tolist(), strict=True) if not gone]) if here.any() else text)
    return "\n".join(kept)


def article_of(blocks: list[tuple[str, bool]]) -> str | None:
    """The text of a page all of whose text lies in its article, or has none; None of one whose host decides."""
    if not all(main for _, main in blocks):
        return None
    return "\n".join([text for text, _ in blocks])


def judged_text(blocks: list[str], mains: list[bool], hit: np.ndarray) -> str:
    """The text of a page with blocks beside its article: ``hit`` tells what its host repeats.

    The article, as long as it holds a fair share of the words that are the
    page's own. One that does not, or none, is a teaser: the page's text is all
    that its host does not repeat.
    """
    at, inside, beside = 0, 0, 0
    for text, main in zip(blocks, mains, strict=True):
        words = text.count(" ") + 1
        if main:
            inside += words
        else:
            beside += words - int(hit[at + 1 : at + 1 + words].sum())
        at += 1 + words
    if inside and beside <= TEASER * inside:
        return "\n".join([text for text, main in zip(blocks, mains, strict=True) if main])
    return kept_text(blocks, hit)


def main_texts(htmls: list[str | None], run: int = RUN, pages: int = PAGES) -> list[str]:
    """The main text of pages of one host.

    An article is kept whole. A page without one, or with a teaser for one, keeps
    of all its blocks the words that are not in a run repeated over the host's pages.
    """
    parsed = [blocks_of(h or "") for h in htmls]
    texts = [[text for text, _ in p] for p in parsed]
    covered = repeated_tokens(streams_of(texts)[0], run, pages)
    return [judged_text(own, [main for _, main in p], hit) if (article := article_of(p)) is None else article for p, own, hit in zip(parsed, texts, covered, strict=True)]


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def run_names(streams: list[np.ndarray], tokens: list[str], hosts: list[str], run: int = RUN) -> np.ndarray:
    """For each place of all streams laid end to end (one place between two) a 64-bit name of the host and the run that starts there."""
    h = np.array([_hash(t) for t in tokens] + [0], np.uint64)
    line = np.concatenate([np.append(h[s], np.uint64(0)) for s in streams])
    salt = {host: _hash(host) for host in set(hosts)}
    out = np.repeat(np.array([salt[host] for host in hosts], np.uint64), [len(s) + 1 for s in streams])
    for k in range(run):
        out[: max(len(line) - k, 0)] += arrays.mix(line[k:] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
    return arrays.mix(out)


def _extract(batches):
    """Pages -> their blocks, share by share."""
    share: list[tuple] = []
    chars = 0
    task = TaskContext.get()
    name = (task.partitionId() if task else 0) << 32

    def done():
        parsed = [blocks_of(r[3] or "") for r in share]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(share), pa.int64()), pa.array([r[0] for r in share], pa.string()),
                pa.array([r[1] for r in share], pa.int64()), pa.array([r[2] for r in share], pa.string()),
                pa.array([not all(main for _, main in p) for p in parsed], pa.bool_()), pa.array(["\n".join([t for t, _ in p]) for p in parsed], pa.string()),
                pa.array(["".join(["1" if main else "0" for _, main in p]) for p in parsed], pa.string()),
            ],
            ["share", "host", "page_id", "url", "bare", "blocks", "mains"],
        )

    for batch in arrays.pieces(batches, "html"):
        for row in zip(*(batch[c].to_pylist() for c in ("host", "page_id", "url", "html")), strict=True):
            if share and (len(share) >= SHARE_PAGES or chars >= SHARE_CHARS):
                yield done()
                share, chars, name = [], 0, name + 1
            share.append(row)
            chars += len(row[3] or "")
    if share:
        yield done()


_SHARES = "share long, host string, page_id long, url string, bare boolean, blocks string, mains string"
_PACKED = "bucket int, share long, held int, name binary"

#: Inside a bucket runs that no page asks for go by 40 bits of their names.
_SHORT = np.uint64(2**40 - 1)


def _packed(short: np.ndarray) -> bytes:
    """Distinct 40-bit names, in order: what each adds to the one before, byte by byte, so that the leading zeros of all stand together."""
    more = np.diff(np.sort(short), prepend=np.uint64(0))
    return np.ascontiguousarray(more.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    more = np.zeros((len(blob) // 5, 8), np.uint8)
    more[:, :5] = np.frombuffer(blob, np.uint8).reshape(5, -1).T
    return np.cumsum(more.view(np.uint64).ravel(), dtype=np.uint64)


def _tally(buckets: int):
    """Shares -> packed rows: the names of their runs, by how many pages have them (PAGES or more are one number).

    Runs of pages with text beside an article go with their share, whole; all
    others are only counted, so a task adds up those of its shares first.
    """

    def rows_of(share, name, held, pack):
        for k in range(1, PAGES + 1):
            some = name[held == k]
            for bucket, (n,) in exchange.cut(exchange.bucket_of(some, buckets), some):
                yield bucket, share, k, pack(n)

    def packed(rows):
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "share", "held", "name"])

    def counted(names, helds):
        name, at = np.unique(np.concatenate(names), return_inverse=True)
        held = np.minimum(np.bincount(at, np.concatenate(helds)), PAGES).astype(np.int64)
        return packed(rows_of(None, name, held, lambda n: _packed(n & _SHORT)))

    def tally(batches):
        names, helds, number = [], [], 0
        for batch in arrays.pieces(batches, "blocks"):
            share, bare = (batch[c].to_numpy(zero_copy_only=False) for c in ("share", "bare"))
            host, blocks = batch["host"].to_pylist(), batch["blocks"].to_pylist()
            edge = np.flatnonzero(np.diff(share, prepend=share[0] - 1))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(share)], strict=True):
                streams, tokens = streams_of([t.split("\n") if t else [] for t in blocks[a:b]])
                starts, group, page = equal_runs(apart_by_host(streams, host[a:b]))
                if not len(starts):
                    continue
                at, held = held_by(group, page)
                name = np.zeros(len(held), np.uint64)
                name[at] = run_names(streams, tokens, host[a:b])[starts]
                held = np.minimum(held, PAGES)
                need = np.zeros(len(held), bool)
                need[at[bare[a:b][page]]] = True
                if need.any():
                    yield packed(rows_of(int(share[a]), name[need], held[need], np.ndarray.tobytes))
                names.append(name[~need])
                helds.append(held[~need])
                number += len(names[-1])
                if number > COUNTED:
                    yield counted(names, helds)
                    names, helds, number = [], [], 0
        if number:
            yield counted(names, helds)

    return tally


def _common(table: pa.Table) -> pa.Table:
    """A bucket -> per share the names of its runs that PAGES pages of the host have."""
    share, held, blobs = (table[c].to_pylist() for c in ("share", "held", "name"))
    asked = [i for i, s in enumerate(share) if s is not None]
    name = exchange.joined([blobs[i] for i in asked], np.uint64)
    size = [len(blobs[i]) // 8 for i in asked]
    short, which = np.unique(name & _SHORT, return_inverse=True)
    total = np.bincount(which, np.repeat([held[i] for i in asked], size), len(short))
    if len(short):
        for i in set(range(len(share))).difference(asked):
            others = _unpacked(blobs[i])
            place = np.minimum(np.searchsorted(short, others), len(short) - 1)
            total += held[i] * np.bincount(place[short[place] == others], minlength=len(short))
    hit = total[which] >= PAGES
    at, name = np.repeat(np.array([share[i] for i in asked], np.int64), size)[hit], name[hit]
    order = np.argsort(at, kind="stable")
    at, name = at[order], name[order]
    edge = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))
    return pa.table({
        "share": pa.array(at[edge], pa.int64()),
        "name": pa.array([name[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(at)), strict=True)] if len(at) else [], pa.binary()),
    })


def _texts(pages, gone) -> pa.Array:
    """The texts of pages by what their hosts repeat: ``gone`` has the names of those runs."""
    blocks = [t.split("\n") if t else [] for t in pages["blocks"].to_pylist()]
    mains = [[m == "1" for m in marks] for marks in pages["mains"].to_pylist()]
    if len(gone):
        streams, tokens = streams_of(blocks)
        sizes = np.array([len(s) for s in streams], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        starts = arrays.spans(first, np.maximum(sizes - RUN + 1, 0))
        hits = covered_by(starts[np.isin(run_names(streams, tokens, pages["host"].to_pylist())[starts], gone)], streams, RUN)
    else:
        hits = [np.zeros(sum(b.count(" ") + 2 for b in own), bool) for own in blocks]
    return pa.array([judged_text(own, main, hit) for own, main, hit in zip(blocks, mains, hits, strict=True)], pa.string())


def _without(pages: pa.Table, common: pa.Table) -> pa.Table:
    """Pages of a share, and the names of the runs that their hosts repeat -> their texts."""
    texts = _texts(pages, exchange.joined(common["name"].to_pylist(), np.uint64)) if len(pages) else pa.array([], pa.string())
    return pa.table({"page_id": pages["page_id"], "url": pages["url"], "text": texts})


def _judged(batches):
    """Pages beside whose article no run is repeated -> their texts."""
    for batch in arrays.pieces(batches, "blocks"):
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], _texts(batch, ())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page: its article's blocks, one per line.

    Markup tells menus, headers, footers, sidebars, notices, adverts, forms and
    comments apart, by element and by words of class, id and role. Character
    references are decoded, white space inside a block becomes one space. Runs of
    RUN tokens that PAGES pages of a host repeat are not a page's own text. They
    judge every page that has text outside a marked article: the article is its
    main text as long as the page's own words beside it are at most TEASER times
    as many; else, and where none is marked, all text but those runs. An article
    that is kept is kept whole.

    All pages go through this. They are cut into shares of bounded size, in which
    the token streams are concatenated, and a suffix array brings together the
    equal runs of a host; each goes once, with the number of its pages, to the
    bucket of its name, where the numbers of all shares are added. What a whole
    host repeats comes back to the shares whose pages have it beside an article, or
    without one, so where shares are cut makes no difference. Runs of different
    shares are told apart by a 64-bit hash of host and tokens, of which a bucket
    compares 40 bits besides its own.

    Null or empty html: empty text. Null url, or one without a host: the host is
    empty. Rows that repeat are each returned, and count as pages. Empty table:
    empty result. Other columns play no part.
    """
    spark = pages.sparkSession
    arrays.bounded_batches(spark)
    buckets = exchange.bucket_count(spark)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
    )
    # read again, and as long as the pages' text: packed more tightly than a table that is soon gone
    shares = durable_table(rows.mapInArrow(_extract, _SHARES), compression="zstd")
    common = shares.select("share", "host", "bare", "blocks").mapInArrow(_tally(buckets), _PACKED).groupBy("bucket").applyInArrow(_common, "share long, name binary")
    common = durable_table(common)
    told = "page_id long, url string, text string"
    if common.isEmpty():
        texts = shares.mapInArrow(_judged, told)
    else:
        # pages that a run may change meet the names of these runs; all others have none beside their article
        there = F.broadcast(common.select("share").distinct())
        asked = shares.where("bare").join(there, "share", "left_semi").groupBy("share").cogroup(common.groupBy("share")).applyInArrow(_without, told)
        rest = shares.where("NOT bare").unionByName(shares.where("bare").join(there, "share", "left_anti"))
        texts = asked.union(rest.mapInArrow(_judged, told))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op6_extract(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
