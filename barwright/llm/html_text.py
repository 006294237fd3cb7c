"""Main text of web pages by differencing with the page of the nearest URL.

Within a host, each page is paired with the page whose URL path is nearest (its
neighbour in path order with the longer common beginning).  The text lines of
every page are aligned with its pair's by longest common subsequence; shared
lines are template lines, to be deleted.

Differencing alone cannot give the text asked for: menus, adverts and footers
here differ from page to page, so they are not shared, and articles share
passages (copies, licence lines), which must stay.  So a check by the markup
follows: a line lies in a main element, in an element that is a menu, header,
footer, advert, form, notice or reader comment by its tag, class or id, or in
neither.  Lines of the second kind go, shared or not.  On a page that marks no
main element the lines that are not shared stay.  On one that does, lines
outside go, and of the articles those whose every line is shared go too (lists
of teasers); what is shared inside an article that has lines of its own comes
back, as do all articles where each is shared whole (a copy of a page).

Scale: lines leave the parser as 64-bit hashes for pairing and alignment, so
the page text is not shuffled for it.  Distinct paths are sorted by range, not
by host, so a host with very many pages is spread; neighbours across range
borders come from the borders' first and last paths (a row for each range).
Pages of one path all meet one pair: beyond ``TOGETHER`` it is given to several shares of them.
Only pages with shared lines enter the last join.

Defined cases: null html is empty (text ''); a null url is its own host with an
empty path; pages of equal path are not each other's pair; rows are kept one by
one, repeated or not; unclosed or cut-off markup ends with the page.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

OUT, OPEN, MAIN, ARTICLE = 0, 1, 2, 3  # from ARTICLE on: the articles of a page by number
TOGETHER = 20_000  # pages of one path that meet their pair in one place

# Element names and the words in class or id that mark a role.
SKIPPED = frozenset("script style noscript template title head svg math iframe object textarea select button".split())
OUT_TAGS = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted "
    "recommended related replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
MAIN_WORDS = frozenset(("main", "maincontent"))  # may hold several articles, as the main element does
ARTICLE_WORDS = frozenset("article articlebody postbody postcontent entrycontent".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ROLE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)


def _kind(name: str, attributes: str) -> int | None:
    """OUT, MAIN or ARTICLE if the element says so, else None."""
    if name in OUT_TAGS:
        return OUT
    words = set()
    for _, a, b, c in _ROLE.findall(attributes):
        for value in (a or b or c).lower().split():
            words.add(re.sub(r"[-_]", "", value))
            words.update(re.split(r"[-_]+", value))
    if words & OUT_WORDS:
        return OUT
    if name == "article" or words & ARTICLE_WORDS:
        return ARTICLE
    return MAIN if name == "main" or words & MAIN_WORDS else None


def lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block of a page, in order; white space is one space, references are decoded."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # (name, zone) of open block elements
    articles = 0

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][1] if stack else OPEN))
            parts.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name in SKIPPED:
            if not m.group(1) and not (m.group(3) or "").endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end if name != "head" else at
            continue
        if name in INLINE:
            continue
        flush()
        if m.group(1):
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                del stack[depth:]
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end an open one of their own
                if stack and stack[-1][0] == name:
                    stack.pop()
            zone = stack[-1][1] if stack else OPEN
            if zone != OUT and name not in ("html", "body"):
                said = _kind(name, m.group(3) or "")
                if said == ARTICLE and zone < ARTICLE:
                    zone, articles = ARTICLE + articles, articles + 1
                elif said == OUT or said == MAIN and zone == OPEN:
                    zone = said
            stack.append((name, zone))
    flush()
    return out


def _row_above(line, b: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences from each position of ``b`` on, with one more line before."""
    hit = np.where(b == line, below[1:] + 1, 0)
    row = np.zeros_like(below)
    row[:-1] = np.maximum.accumulate(np.maximum(below[:-1], hit)[::-1])[::-1]
    return row


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of ``a`` on a longest common subsequence with ``b``.

    Of the table only every ``step``-th row is kept, about as many as a block has
    rows, and the walk makes each block's rows once more.
    """
    place = np.flatnonzero(np.isin(a, b))  # lines that ``b`` has not are on none
    a, step = a[place], max(1, math.isqrt(len(place)))
    row = np.zeros(len(b) + 1, np.int32)
    kept = {len(a): row}
    for i in range(len(a) - 1, -1, -1):
        row = _row_above(a[i], b, row)
        if i % step == 0:
            kept[i] = row
    out, i, j, rows = [], 0, 0, {}
    while i < len(a) and j < len(b):
        if i + 1 not in rows:
            end = min(i - i % step + step, len(a))
            rows = {end: kept[end]}
            for x in range(end - 1, i - 1, -1):
                rows[x] = _row_above(a[x], b, rows[x + 1])
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return place[np.array(out, np.int64)]


def _line_rows(batches):
    for batch in batches:
        hashes = [[xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _ in lines(page or "")] for page in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "hashes"])


def _shared_rows(batches):
    """Numbers of the lines that a page shares with its pair."""
    for batch in batches:
        keys, gone = [], []
        for key, own, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = shared(np.array(own, np.int64), np.array(other, np.int64))
            if len(found):
                keys.append(key)
                gone.append(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])


def stays(zones: list[int], gone: set[int]) -> list[bool]:
    """Of each line whether it is main text, from the shared lines and, as a check on them, the markup."""
    if not any(z >= MAIN for z in zones):
        return [z == OPEN and i not in gone for i, z in enumerate(zones)]
    own = {z for i, z in enumerate(zones) if i not in gone and z >= ARTICLE}  # articles with a line that is not shared
    return [z == MAIN or z >= ARTICLE and (z in own or not own) for z in zones]


def _text_rows(batches, id_type):
    for batch in batches:
        texts = []
        for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found = lines(page or "")
            texts.append(" ".join(t for (t, _), kept in zip(found, stays([z for _, z in found], set(gone or ()))) if kept))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["id", "url", "text", "n_chars"])


def nearest_paths(paths: DataFrame) -> DataFrame:
    """(host, path, rep) -> the rep of the nearest other path of the host, as (rep, partner)."""
    ranged = C.written(
        paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("part", F.spark_partition_id()), "paths")
    here = F.struct("host", "path", "rep")
    w = Window.partitionBy("part").orderBy("host", "path")
    both = ranged.withColumns({"before": F.lag(here).over(w), "after": F.lead(here).over(w)})
    borders = ranged.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    order = Window.orderBy("part")  # one row for each range of the sort
    borders = borders.select("part", F.lag("last").over(order).alias("prev_last"), F.lead("first").over(order).alias("next_first"))
    both = both.join(F.broadcast(borders), "part").select(
        "host", "path", "rep", F.coalesce("before", "prev_last").alias("before"), F.coalesce("after", "next_first").alias("after"))

    def common(side: str):
        # common beginning, from the share of path segments that agree; -1 on another host
        segments = F.split("path", "/")
        agree = F.aggregate(
            F.zip_with(segments, F.split(F.col(f"{side}.path"), "/"), lambda x, y: x.eqNullSafe(y)),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda acc, same: F.struct((acc["n"] + F.when(acc["on"] & same, 1).otherwise(0)).alias("n"), (acc["on"] & same).alias("on")),
            lambda acc: acc["n"])
        return F.when(F.col(f"{side}.host").eqNullSafe(F.col("host")), agree).otherwise(-1)

    near = both.withColumns({"b": F.coalesce(common("before"), F.lit(-1)), "a": F.coalesce(common("after"), F.lit(-1))})
    return near.where("greatest(a, b) >= 0").select(
        "rep", F.when(F.col("b") >= F.col("a"), F.col("before.rep")).otherwise(F.col("after.rep")).alias("partner"))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = C.pick(pages, id=id_col, url=url_col, html=html_col)
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"\.html?$", ""), r"/+$", "")
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col("id").cast("string"), F.lit("\x01")), url, F.coalesce("html", F.lit("\x01"))))
    named = src.select("id", "url", "html", host.alias("host"), path.alias("path"), key.alias("key"))
    parsed = C.written(
        named.select("key", "html").mapInArrow(_line_rows, "key string, hashes array<long>").dropDuplicates(["key"]), "page-lines")
    keys = C.written(named.select("host", "path", "key").distinct(), "page-keys")
    paths = keys.groupBy("host", "path").agg(F.min("key").alias("rep"), F.ceil(F.count("*") / TOGETHER).alias("shares"))
    paired = C.written(paths.join(nearest_paths(paths), "rep"), "page-pairs")
    pairs = keys.join(paired, ["host", "path"]).select("key", "rep", F.pmod(F.xxhash64("key"), "shares").alias("share"))
    others = (paired.select("rep", "partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
              .join(parsed.select(F.col("key").alias("partner"), F.col("hashes").alias("other")), "partner").select("rep", "share", "other"))
    aligned = pairs.join(parsed, "key").join(others, ["rep", "share"]).select("key", "hashes", "other")
    gone = aligned.mapInArrow(_shared_rows, "key string, gone array<int>")
    kind = C.column_type(src, "id")
    schema = T.StructType([T.StructField("id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    id_type = to_arrow_type(kind)
    return (named.join(C.written(gone, "shared-lines"), "key", "left").select("id", "url", "html", "gone")
            .mapInArrow(lambda b: _text_rows(b, id_type), schema).withColumnsRenamed({"id": id_col, "url": url_col}))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(C.table(spark, sf_dir, "pages"))
