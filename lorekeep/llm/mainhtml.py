"""Main text of web pages: structure, and for pages without an article the template of their host.

A page is a list of blocks. Markup tells the furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments, by tag, role or class) and the article element, whose text is the page's but for the template:
the element keeps passages that few pages share, but not a block with half of its words in runs that recur in at least
half of the host's distinct articles, and in five. A page of which no block lies in an article element is judged by repetition: the token streams (tags and words) of all pages of its host are
cut into runs of ``run`` tokens. A run is template if it recurs on at least ``share`` of the host's distinct streams, and
on two. A passage that a few pages quote stays therefore, however large the host grows. A block with half of
its words in template runs is boilerplate. Equal streams are one page, so a mirrored page does not erase itself.

The distinct streams of a host are dealt out in shards of bounded size. Of each shard's concatenated streams a suffix array
with common prefix lengths is built: an interval of suffixes that share ``run`` tokens is a run, and the streams in
it are counted. Counts of one host's shards are added up, longer repeats are unions of runs.

Null or empty html gives an empty text. Repeated rows give the same text each. A null page_id is kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import append_columns, checkpoint, parts_of, written
from lorekeep.llm.runs import Suffixes

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
RAW = frozenset("script style noscript template textarea title iframe svg math object select option canvas audio video".split())
FURNITURE = frozenset("head nav header footer aside form button menu dialog fieldset label datalist".split())
MAIN = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|nav\w*|menu|breadcrumbs?|"
    r"sidebar|side|footer|comments?|replies|respond|disqus|share|social|related|recommend\w*|newsletter|subscribe|login|search|pagination|toolbar)(?:$|[\s_-])",
    re.I,
)
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|menu|alert|dialog)", re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|display\s*:\s*none", re.I)
PIECE, REST, DROPPED = "main", "rest", "drop"


def blocks_of(page: str | None, until: str | None = None) -> list[tuple[str, str, str]]:
    """(kind, tags before it, text) of every block with text, in page order; up to the first of kind ``until``."""
    if not page:
        return []
    out, text, tags, stack, at, kind = [], [], [], [], 0, REST

    def close():
        words = " ".join(entities.unescape("".join(text)).split())
        if words:
            out.append((kind, " ".join(tags), words))
            tags.clear()
        text.clear()

    size = len(page)
    while at < size and not (until and out and out[-1][0] == until):
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag closes up to its start tag
            if name not in INLINE:
                close()
                tags.append("/" + name)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    kind = stack[depth][1]
                    del stack[depth:]
                    break
            continue
        if name not in INLINE:
            close()
            tags.append(name)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at) if not m[3].endswith("/") else None
            if end:
                at = page.find(">", end.start()) + 1 or size
            elif not m[3].endswith("/"):
                at = size
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        inner = kind
        if name in ("p", "li", "td", "th", "tr", "dt", "dd"):  # may stay open; they never set a kind
            continue
        marks = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(m[3])) if m[3] else ""
        if name in FURNITURE and not (name == "header" and kind == PIECE) or m[3] and (HINTS.search(marks) or ROLES.search(m[3]) or HIDDEN.search(m[3])) and name not in ("html", "body"):
            inner = DROPPED
        elif name in MAIN and kind == REST:
            inner = PIECE
        if name not in INLINE:
            stack.append((name, kind))
            kind = inner
    close()
    return out


def stream_of(blocks: list[tuple[str, str, str]], article: bool = False) -> list[tuple[int, int, str]]:
    """(block, word, token) of the tokens outside, or inside, the article: tags, then words; tags have word -1."""
    out = []
    for number, (kind, tags, words) in enumerate(blocks):
        if (kind == PIECE) == article:
            out.extend((number, -1, f"<{t}>") for t in tags.split())
            out.extend((number, k, w) for k, w in enumerate(words.split(" ")))
    return out


def article_stream(blocks: list[tuple[str, str, str]]) -> str:
    """The tokens inside the article, joined by blanks; no token holds one."""
    return " ".join(" ".join([f"<{t}>" for t in tags.split()] + [words]) for kind, tags, words in blocks if kind == PIECE)


def suffixes_of(stream: list[tuple[int, int, str]], run: int) -> list[int]:
    """Hash of the first ``run`` tokens of each suffix that has as many."""
    import xxhash

    tokens = [t for _, _, t in stream]
    return [xxhash.xxh64_intdigest("\x00".join(tokens[k : k + run])) - (1 << 63) for k in range(len(tokens) - run + 1)]


def uncovered(blocks: list[tuple[str, str, str]], repeated: set[int], run: int, article: bool = False) -> str:
    """The blocks outside furniture, or of the article, of which repeated runs cover less than half of the words."""
    stream = stream_of(blocks, article)
    covered = bytearray(len(stream))
    for k, h in enumerate(suffixes_of(stream, run)):
        if h in repeated:
            covered[k : k + run] = b"\x01" * run
    total, hit = Counter(), Counter()
    for (block, word, _), c in zip(stream, covered, strict=True):
        if word >= 0:
            total[block] += 1
            hit[block] += c
    return " ".join(t for n, (kind, _, t) in enumerate(blocks) if kind == (PIECE if article else REST) and 2 * hit[n] < total[n])


def article_text(blocks: list[tuple[str, str, str]], repeated: set[int], run: int) -> str | None:
    """The article without blocks of the template; if nothing else is in it, the whole. None without an article."""
    own = [t for kind, _, t in blocks if kind == PIECE]
    if not own:
        return None
    return repeated and uncovered(blocks, repeated, run, article=True) or " ".join(own)


def may_have_article(page: str) -> Column:
    """A page without these letters has no article element; of the others the parsed blocks decide."""
    return F.coalesce(F.col(page).rlike(r"(?i)<(article|main)([\s>/]|$)"), F.lit(False))


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _stream_hash(stream: list[tuple[int, int, str]]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x00".join(t for _, _, t in stream)) - (1 << 63)


def repeated_runs(streams: list[list[str]], run: int, least: int = 1) -> tuple[list[int], np.ndarray]:
    """Hash of every run of ``run`` tokens on at least ``least`` of the streams, and the number of these."""
    import xxhash

    number: dict[str, int] = {}
    size = np.array([len(tokens) + 1 for tokens in streams])
    values = np.fromiter(
        (v for k, tokens in enumerate(streams) for v in (*[number.setdefault(t, len(number)) for t in tokens], -1 - k)), np.int64, size.sum()
    )  # each stream ends in a number of its own, which no common prefix holds
    owner = np.repeat(np.arange(len(streams)), size)
    left = np.cumsum(size)[owner] - 1 - np.arange(len(values))
    suffixes = Suffixes(values)
    order = suffixes.array
    lcp = suffixes.extend(order[:-1], order[1:])
    interval = np.cumsum(np.concatenate(([True], lcp < run))) - 1
    whole = left[order] >= run
    met = np.unique(interval[whole] * len(streams) + owner[order[whole]]) // len(streams)
    at, n = np.unique(met, return_counts=True)
    at, n = at[n >= least], n[n >= least]
    first = order[np.searchsorted(interval, at)]
    begin = np.cumsum(size) - size
    hashes = []
    for k, x in zip((first - begin[owner[first]]).tolist(), owner[first].tolist(), strict=True):
        hashes.append(xxhash.xxh64_intdigest("\x00".join(streams[x][k : k + run])) - (1 << 63))
    return hashes, n


def template_runs(pages: DataFrame, *, url: str = "url", page: str = "html", run: int = 6, share: float = 0.1, shard: int = 300_000) -> DataFrame:
    """host, h: the runs of ``run`` tokens outside articles on at least ``share`` of the host's distinct streams, and on two.

    Of a host with more than ``shard`` tokens several tasks take a part of the streams.
    """

    def told(batches):
        for b in batches:
            streams = [stream_of(blocks_of(value)) for value in b.column(0).to_pylist()]
            columns = [
                b.column(1), pa.array([_stream_hash(x) for x in streams], pa.int64()), pa.array([len(x) for x in streams], pa.int64()),
                pa.array([[t for _, _, t in x] for x in streams], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["host", "stream", "size", "tokens"])

    listed = pages.select(F.make_valid_utf8(page), host_of(url).alias("host"))
    listed = listed.mapInArrow(told, "host string, stream long, size long, tokens array<string>")
    listed = written(listed.groupBy("host", "stream").agg(F.max("size").alias("size"), F.first("tokens").alias("tokens")))
    every = listed.groupBy("host").agg(
        F.count(F.lit(1)).alias("streams"), F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(shard))).cast("int").alias("shards")
    )
    every = written(every)

    def suffixes(batches):
        key, held = None, []

        def settle():
            hashes, n = repeated_runs(held, run, 2 if key[2] == 1 else 1)  # a run of one stream may be on other shards
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(n), pa.string()), pa.array(hashes, pa.int64()), pa.array(n, pa.int64())], ["host", "h", "n"])

        for b in batches:
            for *own, tokens in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                if own != key:
                    if held:
                        yield from settle()
                    key, held = own, []
                held.append(tokens)
        if held:
            yield from settle()

    dealt = listed.join(every, "host").select("host", F.pmod(F.xxhash64("stream"), F.col("shards")).cast("int").alias("part"), "shards", "tokens")
    dealt = dealt.repartition(parts_of(listed), "host", "part").sortWithinPartitions("host", "part")
    counted = dealt.mapInArrow(suffixes, "host string, h long, n long").groupBy("host", "h").agg(F.sum("n").alias("n")).where("n > 1")
    return counted.join(every, "host").where(F.col("n") >= F.col("streams") * F.lit(share)).select("host", "h")


def article_runs(
    pages: DataFrame, *, url: str = "url", page: str = "html", run: int = 6, share: float = 0.5, few: int = 5, shard: int = 300_000
) -> DataFrame:
    """host, runs: the runs of ``run`` tokens in articles on at least ``share`` of the host's distinct articles, and on ``few``.

    Articles are shuffled once, as text, to the shards of their host, of about ``shard`` tokens. A run on a share of all of a
    host's articles is on that share of at least one shard's, so the suffix arrays of the shards tell all candidates; of hosts
    with several shards these are counted again where the pages lie.
    """
    listed = pages.where(may_have_article(page)).select(F.make_valid_utf8(page).alias("html"), host_of(url).alias("host"))
    size = F.ceil(F.sum(F.octet_length(page)) / F.lit(7 * shard))  # about seven letters a token
    sized = written(pages.groupBy(host_of(url).alias("host")).agg(F.greatest(F.lit(1), F.coalesce(size, F.lit(1))).cast("int").alias("shards")))

    def told(batches):
        for b in batches:
            streams = pa.array([article_stream(blocks_of(value)) for value in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(1), streams], ["host", "tokens"])

    dealt = listed.mapInArrow(told, "host string, tokens string").where("tokens <> ''").join(sized, "host")
    dealt = dealt.select("host", F.pmod(F.xxhash64("tokens"), F.col("shards")).cast("int").alias("part"), "shards", "tokens")
    dealt = dealt.repartition(parts_of(pages), "host", "part").sortWithinPartitions("host", "part")

    def suffixes(batches):
        key, held = None, set()

        def settle():
            host, _, shards = key
            least = max(1 if shards > 1 else few, int(np.ceil(share * len(held) - 1e-9)))
            hashes, n = repeated_runs([x.split(" ") for x in sorted(held)], run, least) if least <= len(held) else ([], [])
            rows = pa.array([host] * (len(hashes) + 1), pa.string()), pa.array([shards] * (len(hashes) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([*rows, pa.array([None, *hashes], pa.int64()), pa.array([len(held), *n], pa.int64())], ["host", "shards", "h", "n"])

        for b in batches:
            for *own, tokens in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                if own != key:
                    if held:
                        yield from settle()
                    key, held = own, set()
                held.add(tokens)
        if held:
            yield from settle()

    found = written(dealt.mapInArrow(suffixes, "host string, shards int, h long, n long"))
    every = found.where("h is null").groupBy("host").agg(F.sum("n").alias("articles"))
    counted = found.where("h is not null and shards = 1").select("host", "h", "n")
    several = found.where("h is not null and shards > 1")
    if not several.isEmpty():
        asked = written(several.groupBy("host").agg(F.collect_set("h").alias("asked")))

        def again(batches):
            held = {}
            for b in batches:
                out = [], [], []
                for value, host, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if host not in held:
                        held = {host: set(runs.as_py())}
                    stream = stream_of(blocks_of(value), article=True)
                    met = held[host].intersection(suffixes_of(stream, run))
                    if met:
                        for column, x in zip(out, (host, _stream_hash(stream), list(met)), strict=True):
                            column.append(x)
                kinds = pa.string(), pa.int64(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["host", "stream", "met"])

        met = listed.join(asked, "host").select("html", "host", "asked").mapInArrow(again, "host string, stream long, met array<bigint>")
        met = met.groupBy("host", "stream").agg(F.first("met").alias("met"))  # equal articles are one
        total = met.select("host", F.explode("met").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.unionByName(total)
    kept = counted.join(every, "host").where((F.col("n") >= F.col("articles") * F.lit(share)) & (F.col("n") >= few))
    return kept.groupBy("host").agg(F.collect_list("h").alias("runs"))


def main_text(pages: DataFrame, *, url: str = "url", page: str = "html", run: int = 6, share: float = 0.1, most: float = 0.5) -> DataFrame:
    """``pages`` with text and n_chars; ``run`` tokens on ``share`` of a host's distinct pages are its template, in
    articles those on ``most`` of its distinct articles."""
    maybe = may_have_article(page)
    nothing = F.coalesce(F.col(page), F.lit("")) == ""

    def article():
        return lambda values: [[article_text(blocks_of(v["html"]), set(v["runs"] or ()), run) for v in values]]

    def has_article():
        return lambda values: [[any(k == PIECE for k, _, _ in blocks_of(v, PIECE)) for v in values]]

    runs = written(article_runs(pages, url=url, page=page, run=run, share=most))
    paired = pages.where(maybe).withColumn("__host", host_of(url)).join(runs.withColumnRenamed("host", "__host"), "__host", "left")
    paired = paired.select(*pages.columns, F.struct(F.make_valid_utf8(page).alias("html"), "runs").alias("__pair"))
    told = append_columns(paired, "__pair", article, "text string").drop("__pair").where("text is not null")
    empty = pages.where(nothing).withColumn("text", F.lit("")).select(*told.columns)

    # pages without an article: what is not their host's template
    unlike = append_columns(pages.where(maybe), page, has_article, "__own boolean").where("not __own").drop("__own")
    untold = unlike.unionByName(pages.where(~maybe & ~nothing)).withColumn("__host", host_of(url))
    untold = checkpoint(untold)
    out = told.unionByName(empty)
    if not untold.isEmpty():
        hosts = untold.select(F.col("__host").alias("host")).distinct()
        near = pages.withColumn("host", host_of(url)).join(hosts, "host", "left_semi").select(*pages.columns)

        def streams():
            def of(value):
                stream = stream_of(blocks_of(value))
                return _stream_hash(stream), list(set(suffixes_of(stream, run)))

            return lambda values: [list(x) for x in zip(*map(of, values), strict=True)] if values else [[], []]

        marked = append_columns(untold, page, streams, "__stream long, __h array<bigint>")
        keys = marked.select(F.col("__host").alias("host"), F.col("__stream").alias("stream"), F.explode("__h").alias("h")).distinct()
        cover = keys.join(template_runs(near, url=url, page=page, run=run, share=share), ["host", "h"])
        cover = cover.groupBy("host", "stream").agg(F.collect_set("h").alias("__covered"))  # at most one stream's suffixes
        joined = marked.drop("__h").join(
            cover.withColumnsRenamed({"host": "__host", "stream": "__stream"}), ["__host", "__stream"], "left"
        )
        paired = joined.withColumn("__pair", F.struct(F.col(page).alias("html"), "__covered"))

        def unique():
            return lambda values: [[uncovered(blocks_of(v["html"]), set(v["__covered"] or ()), run) for v in values]]

        out = out.unionByName(append_columns(paired, "__pair", unique, "text string").select(*told.columns))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
