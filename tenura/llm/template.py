"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: tags and text segments. Tokens with the same occurrence vector over the pages of a host
(as often on every page) form an equivalence class. A class of several tokens on most pages comes from the
template, not from the articles. The class of tokens that stand once on a page is the template's frame; classes
that repeat lie nested in one of its slots. The content region is the narrowest element of the frame that holds nearly all
text of the host's pages that is not the template's; what is not the template's in it is the page's own text.

A text that a host repeats on most of its pages has the occurrence vector of a template too. Two rules keep it. Words belong to the
template only in a class that holds tags as well. And on a page whose region consists of such words for the most part they
are taken for what they are, a repeated article: pages that are copies of one another, near copies and repeated
rows keep their text.
"""

from __future__ import annotations

import hashlib
import html as html_
import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import bounded_batches, keep, mixed, table, whole_ids

LEAST_PAGES = 4
SUPPORT = 0.5
REPEATED_SHARE = 0.5
LEAST_TOKENS = 3
BROADCAST_HOSTS = 20_000

#: The rest of a tag; a quoted value may hold ">", a quote that is never closed ends nothing.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select|title)\b"
    rf"{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?/]?[a-zA-Z]{_ATTRIBUTES}(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text, and words in class, id or role that say the same.
ASIDE = frozenset("nav footer aside form head button dialog menu datalist fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent notice popup modal overlay newsletter subscribe signup share "
    "sharing social related recommended comment comments reply replies disqus respond complementary contentinfo".split()
)
CONTENT = frozenset(["article", "main"])
CONTENT_WORDS = frozenset("article main content post entry story".split())
#: Elements that can be the content region, and the share of the host's own text that one must hold.
CONTAINERS = frozenset("article center div main section table tbody td tr".split())
REGION_SHARE, CONTENT_SHARE = 0.9, 0.5


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, value): `open` and `close` tags with name and class words, `text` with its raw text, `skip`."""
    out = []
    for m in TOKENS.finditer(page):
        value = m[0]
        if value[0] != "<" or value == "<":
            out.append(("text", "", value))
        elif m[1] or value.startswith(("<!", "<?")):
            out.append(("skip", (m[1] or "!").lower(), ""))
        elif t := TAG.match(value):
            if t[1]:
                out.append(("close", t[2].lower(), ""))
            else:
                marks = " ".join(x[1] or x[2] or x[3] for x in MARK.findall(value)) if "=" in value else ""
                words = " ".join(sorted(set(re.findall(r"[a-z]+", marks.lower()))))
                out.append(("open", t[2].lower(), words))
        else:
            out.append(("text", "", value))
    return out


def token_keys(parts: list[tuple[str, str, str]]) -> list[str]:
    """What makes tokens equal: a tag's name and class words, a segment's text up to white space. Empty text: ''."""
    out = []
    for kind, name, value in parts:
        if kind == "text":
            text = " ".join(value.split())
            out.append("#" + text if text else "")
        else:
            out.append(("/" if kind == "close" else "<") + name + ("." + value if value else ""))
    return out


def hashed(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little", signed=True)


def host_of(url):
    """Lower-cased host of a URL; pages without one share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, name, n, total, v1, v2, place): per batch and host, what its pages add to a token's occurrence vector.

    `n` counts pages, `total` occurrences. `v1` and `v2` sum the halves of a hash of (page, count): equal sums mean equal
    vectors. `place` sums the position of the first occurrence on the page, in millionths. The name '' stands
    on every page once and counts the host's pages. Text segments have no name, only a hash.
    """

    def run(frames):
        for frame in frames:
            found: dict[tuple[str, str], list[int]] = {}
            for host, page, text in zip(frame["host"], frame["page"].tolist(), frame["html"]):
                keys = token_keys(tokens(text if isinstance(text, str) else ""))
                count: dict[str, int] = {"": 1}
                first: dict[str, int] = {"": 0}
                for at, key in enumerate(keys):
                    if key:
                        count[key] = count.get(key, 0) + 1
                        first.setdefault(key, at)
                spread = np.fromiter(count.values(), np.uint64, len(count)) * np.uint64(0x9E3779B97F4A7C15)
                marks = mixed(spread ^ np.uint64(page & 0xFFFFFFFFFFFFFFFF)).tolist()
                for (key, c), mark in zip(count.items(), marks):
                    row = found.setdefault((host, key), [0, 0, 0, 0, 0])
                    row[0] += 1
                    row[1] += c
                    row[2] += mark >> 32
                    row[3] += mark & 0xFFFFFFFF
                    row[4] += first[key] * 1_000_000 // max(1, len(keys))
            values = np.array(list(found.values()), np.int64).reshape(-1, 5)
            out = pd.DataFrame(values, columns=["n", "total", "v1", "v2", "place"])
            out["host"] = [host for host, _ in found]
            out["token"] = np.array([hashed(key) for _, key in found], np.int64)
            out["name"] = pd.Series([k if k[:1] != "#" else None for _, k in found], dtype=object)
            yield out

    page = F.xxhash64("page_id", "url").alias("page")
    slim = pages.select(host_of(F.col("url")).alias("host"), page, "html")
    shape = "n long, total long, v1 long, v2 long, place long, host string, token long, name string"
    return slim.mapInPandas(run, shape)


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, frame, nested, words, fixed) of every host with enough pages.

    A class is a set of `LEAST_TOKENS` tokens or more with equal occurrence vectors on at least `support` of the pages. `frame`:
    the tags of the class that stands once on a page and covers most pages, in page order. `nested`: the tags of the
    other classes, one list each; `words`: their text segments' hashes, a list for each of them. `fixed`: hashes of the
    text segments of all classes with tags, the template's own words.
    """
    sums = ["n", "total", "v1", "v2", "place"]
    every = occurrences(pages).groupBy("host", "token").agg(F.max("name").alias("name"), *[F.sum(c).alias(c) for c in sums])
    every = keep(every.where(F.col("n") >= least_pages), "page-tokens")
    hosts = every.where("name = ''").select("host", F.col("n").alias("pages"))
    often = every.where("name is null or name <> ''").join(hosts, "host").where(F.col("n") >= support * F.col("pages"))
    member = F.struct((F.col("place") / F.col("n")).alias("place"), "name", "token")
    classes = often.groupBy("host", "n", "v1", "v2").agg(
        F.sort_array(F.collect_list(member)).alias("members"),
        F.count("*").alias("size"),
        (F.max(F.col("total") - F.col("n")) == 0).alias("once"),
    )
    classes = classes.where(F.col("size") >= LEAST_TOKENS)
    tags = F.transform(F.filter("members", lambda m: m["name"].isNotNull()), lambda m: m["name"])
    texts = F.transform(F.filter("members", lambda m: m["name"].isNull()), lambda m: m["token"])
    classes = classes.select("host", "n", "size", "once", tags.alias("tags"), texts.alias("texts"))
    best = F.max(F.when(F.col("once"), F.struct("n", "size", "tags")))
    whole = classes.groupBy("host").agg(
        best.alias("best"),
        F.collect_list(F.when(F.size("tags") > 0, F.struct("tags", "texts"))).alias("all"),
        F.flatten(F.collect_list(F.when(F.size("tags") > 0, F.col("texts")))).alias("fixed"),
    )
    none = F.array().cast("array<string>")
    frame = F.coalesce("best.tags", none)
    whole = whole.withColumn("all", F.filter("all", lambda c: c["tags"] != frame))
    return whole.select("host", frame.alias("frame"), F.col("all.tags").alias("nested"), F.col("all.texts").alias("words"), "fixed")


def frame_places(keys: list[str], frame: list[str]) -> list[int] | None:
    """Where the frame's tags stand on a page; None unless each stands there once and all in the template's order."""
    wanted = set(frame)
    found = [(key, at) for at, key in enumerate(keys) if key in wanted]
    if [key for key, _ in found] != list(frame):
        return None
    return [at for _, at in found]


def _is_aside(name: str, words: str, inside: bool) -> bool:
    if name in VOID or name in ("html", "body", "main"):
        return False
    own = set(words.split())
    if name == "article":  # a comment or a teaser may be marked as an article too
        return not ASIDE_WORDS.isdisjoint(own) and CONTENT_WORDS.isdisjoint(own)
    return name in ASIDE or name == "header" and not inside or not ASIDE_WORDS.isdisjoint(own)


def _is_content(kind: str, name: str, words: str) -> bool:
    return kind == "open" and name in CONTENT and not _is_aside(name, words, False)


def element_end(parts, at: int) -> int:
    """Where the element opened at a position is closed, by depth; an element left open ends with the page."""
    depth = 0
    for i in range(at, len(parts)):
        if parts[i][1] == parts[at][1] and parts[i][0] != "skip":
            depth += 1 if parts[i][0] == "open" else -1
            if depth == 0:
                return i
    return len(parts)


def content_range(parts, keys, region: str | None) -> tuple[int, int] | None:
    """The inside of the element with this key, or None unless it stands on the page once."""
    if not region or keys.count(region) != 1:
        return None
    at = keys.index(region)
    return at + 1, element_end(parts, at)


def misplaced(keys: list[str], places: list[int], nested: list[list[str]]) -> list[int]:
    """Which classes do not lie in one slot of the frame on this page: such a class is not nested, and void."""
    cuts = np.array(places)
    out: list[int] = []
    at: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        at.setdefault(key, []).append(i)
    for k, tags in enumerate(nested):
        found = [i for t in tags for i in at.get(t, [])]
        if len(set(np.searchsorted(cuts, found).tolist())) > 1:
            out.append(k)
    return out


def page_words(keys: list[str], frame: list[str], nested: list[list[str]], words: list[list[int]], fixed: list[int]) -> frozenset[int]:
    """The template's words on this page: all fixed segments but those of classes that are void here."""
    places = frame_places(keys, frame) if frame and nested else None
    if not places:
        return frozenset(fixed)
    return frozenset(fixed).difference(*[words[k] for k in misplaced(keys, places, nested)])


def own_text(parts, keys, start: int, end: int, fixed: frozenset[int], region: bool, gated: bool):
    """(position, raw text) of segments that are the page's own, (position, '') where a block ends, in page order.

    Elements that are not article text are passed over; an element left open ends with the range, with `body` or before the
    article. Gated, only what is inside of article or main elements counts.
    """
    skipped, depth, inside = "", 0, 0
    for at in range(start, end):
        kind, name, value = parts[at]
        if kind == "text":
            if not skipped and (inside or not gated) and not (fixed and keys[at] and hashed(keys[at]) in fixed):
                yield at, value
            continue
        if kind == "skip":
            continue
        content = name in CONTENT and skipped not in CONTENT and not (kind == "open" and not _is_content(kind, name, value))
        if content and not region:
            inside = max(0, inside + (1 if kind == "open" else -1))
            if kind == "open" and inside == 1:
                skipped = ""  # an element left open before the article
        if name == "body":
            skipped = ""
        if skipped:
            if name == skipped:
                depth += 1 if kind == "open" else -1
                if depth == 0:
                    skipped = ""
        elif kind == "open" and _is_aside(name, value, bool(region or inside)):
            yield at, ""
            skipped, depth = name, 1
        if name == "br":
            yield at, " "
        elif name not in INLINE:
            yield at, ""


def extract(page: str | None, region: str | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """The page's own text: that of the content region, less the template's words.

    If the host has no region, or it does not stand on the page once, the page's own article or main elements bound the text,
    and if it has none, all of the body counts. Template words stay where they are `REPEATED_SHARE` of the bounded text or
    more, or all of the body's.
    """
    parts = tokens(page or "")
    keys = token_keys(parts)
    found = content_range(parts, keys, region)
    start, end = found or (0, len(parts))
    gated = not found and any(_is_content(*part) for part in parts)
    segments = list(own_text(parts, keys, start, end, frozenset(), bool(found), gated))
    if fixed:
        sizes = {at: len(keys[at]) - 1 for at, value in segments if value and keys[at]}
        theirs = {at for at in sizes if hashed(keys[at]) in fixed}
        share = sum(sizes[at] for at in theirs) / max(1, sum(sizes.values()))
        if share < (REPEATED_SHARE if found or gated else 1.0):
            segments = [x for x in segments if x[0] not in theirs]
    blocks: list[str] = []
    buffer: list[str] = []
    for _, value in itertools.chain(segments, [(end, "")]):
        if value:
            buffer.append(html_.unescape(value))
        elif buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append(text)
            buffer.clear()
    return " ".join(blocks)


def region_text(parts, keys, frame: list[str], fixed: frozenset[int]) -> dict[int, int]:
    """Characters of own text in the frame's containers, by place in the frame; -1 is the whole page.

    What lies inside an article or main element of the frame is no region of its own.
    """
    places = frame_places(keys, frame) if frame else None
    if not places:
        return {}
    size = np.zeros(len(parts) + 1, np.int64)
    for at, value in own_text(parts, keys, 0, len(parts), fixed, False, False):
        size[at + 1] = len(" ".join(value.split()))
    upto = np.cumsum(size)
    out, covered = {-1: int(upto[-1])}, 0
    for k, at in enumerate(places):
        if parts[at][0] == "open" and parts[at][1] in CONTAINERS and at >= covered:
            end = element_end(parts, at)
            out[k] = int(upto[end] - upto[at])
            if _is_content(*parts[at]):
                covered = end
    return out


def regions(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, region): the key of the frame's container that holds the content of the host's pages.

    The article or main element that holds most own text, if that is `CONTENT_SHARE` of all; else the narrowest element with
    `REGION_SHARE` of all. Hosts without such an element are left out.
    """

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("host", "html", "frame", "nested", "words", "fixed")]
            sums: dict[tuple[str, int, str], int] = {}
            for host, page, frame, nested, words, fixed in zip(*columns):
                parts = tokens(page or "")
                keys = token_keys(parts)
                for k, n in region_text(parts, keys, frame, page_words(keys, frame, nested, words, fixed)).items():
                    row = host, k, "" if k < 0 else frame[k]
                    sums[row] = sums.get(row, 0) + n
            rows = [pa.array([x[i] for x in sums], kind) for i, kind in enumerate([pa.string(), pa.int32(), pa.string()])]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(list(sums.values()), pa.int64())], ["host", "k", "region", "n"])

    both = pages.select("html", host_of(F.col("url")).alias("host")).join(found, "host")
    both = both.select("host", "html", "frame", "nested", "words", "fixed")
    sums = both.mapInArrow(run, "host string, k int, region string, n long").groupBy("host", "k", "region").agg(F.sum("n").alias("n"))
    whole = F.max(F.when(F.col("k") < 0, F.col("n"))).over(Window.partitionBy("host"))
    tag = F.regexp_extract("region", r"^<([^.]*)", 1)
    marked = tag.isin(*CONTENT) & (F.col("n") >= CONTENT_SHARE * F.col("whole"))
    fine = sums.withColumn("whole", whole).where("k >= 0 and n > 0").withColumn("marked", marked)
    fine = fine.where(F.col("marked") | (F.col("n") >= REGION_SHARE * F.col("whole")))
    most = F.when(F.col("marked"), -F.col("n")).otherwise(F.col("n"))
    place = F.when(F.col("marked"), F.col("k")).otherwise(-F.col("k"))
    best = F.struct((~F.col("marked")).alias("a"), most.alias("b"), place.alias("c"))
    return fine.groupBy("host").agg(F.min_by("region", best).alias("region"))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, support: float = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; empty text for null or empty html.

    Hosts of fewer than `least_pages` pages have no template; there the elements alone decide. Repeated rows and equal pages get equal
    texts. Very long pages are worked on whole; of regions that tie the first in the page is taken. Other columns are not read.
    Pages are read three times: for the template, for the region of its content, for the text. The template table has one row per host. It is broadcast only while it has few hosts, each a bounded row (the tokens
    of one page); beyond that it meets the pages by a join on the host.
    """
    bounded_batches(pages.sparkSession)
    found = keep(templates(pages, least_pages, support), "page-templates")
    few = found.count() <= BROADCAST_HOSTS
    found = F.broadcast(found) if few else found
    found = found.join(keep(regions(pages, found), "page-regions"), "host", "left")
    slim = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    both = slim.join(F.broadcast(found) if few else found, "host", "left").select(
        *whole_ids("page_id"), "url", "html", "frame", "nested", "words", "fixed", "region"
    )

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("html", "frame", "nested", "words", "fixed", "region")]
            texts = []
            for page, frame, nested, words, fixed, region in zip(*columns):
                if frame and nested and fixed:
                    fixed = page_words(token_keys(tokens(page or "")), frame, nested, words, fixed)
                texts.append(extract(page, region, frozenset(fixed or ())))
            n = pa.array([len(t) for t in texts], pa.int64())
            own = [batch.column(c) for c in ("page_id", "null_id", "url")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), n], ["page_id", "null_id", "url", "text", "n_chars"])

    out = both.mapInArrow(run, "page_id long, null_id boolean, url string, text string, n_chars long")
    return out.withColumn("page_id", F.when(~F.col("null_id"), F.col("page_id"))).drop("null_id")


def query(spark, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))
