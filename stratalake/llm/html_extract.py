"""Main text of web pages by differencing each page with its nearest neighbours by URL.

1. Pages are cut into lines (``html_blocks``), and the hashes of a page's lines are written.
   Pages of a host with equal lines are one for what follows.
2. These are sorted by host and URL path over all tasks and numbered. The nearest URL is
   always the one before or after, so pages meet their neighbours by number: no group of a
   host is ever gathered, and no number is more frequent than another.
3. The lines of a page and its nearer neighbour are aligned by a longest common subsequence.
   Shared lines belong to the site's template and are deleted, but for those inside an
   ``article`` element. A neighbour that shares nearly all text is a copy and proves nothing;
   then the farther one is asked.
4. Pages are read again and give their lines without the deleted ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.exchange import LAST_ID, stored
from stratalake.llm.html_blocks import ARTICLE, MAIN, PLAIN, Page
from stratalake.llm.ordering import ordered, place

#: A neighbour that shares more of the longer page's text than this is a copy of the page.
COPY = 0.8
#: Cells of an alignment table; longer texts are halved first.
CELLS = 4 << 20

LINE_SCHEMA = "_d bigint, _t bigint, host string, path string, same binary, chars bigint, lines binary, sizes binary, zones binary"
LINE_ARROW = pa.schema([("_d", pa.int64()), ("_t", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("same", pa.binary()),
                        ("chars", pa.int64()), *((c, pa.binary()) for c in ("lines", "sizes", "zones"))])
GONE_SCHEMA = "host string, same binary, gone binary"
TEXT_SCHEMA = "page_id bigint, url string, text string"


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host in lower case, and path with query; what is no URL has the empty host."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.netloc.rpartition("@")[2].lower(), parts.path + ("?" + parts.query if parts.query else ""))
    except ValueError:
        return "", url or ""


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, t, url, html in zip(*(batch.column(c).to_pylist() for c in ("_d", "_t", "url", "html")), strict=True):
            page = Page(html)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in page.lines), np.uint64, len(page.lines))
            zones, sizes = bytes(page.zones), np.fromiter(map(len, page.lines), np.uint32, len(page.lines))
            same = xxhash.xxh3_128_digest(hashes.tobytes() + zones)
            rows.append((d, t, *host_and_path(url), same, int(sizes.sum()), hashes.tobytes(), sizes.tobytes(), zones))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINE_ARROW, strict=True)], schema=LINE_ARROW)


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row i: length of the longest common subsequence of a[:i] and each b[:j]."""
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        out[i + 1, 1:] = np.maximum.accumulate(np.where(b == x, out[i, :-1] + 1, out[i, 1:]))
    return out


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))
    return row


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` are on a longest common subsequence with ``b``."""
    found = np.zeros(len(a), bool)
    work = [(np.arange(len(a)), b)]
    while work:
        own, other = work.pop()
        mine = a[own]
        n = min(len(mine), len(other))
        differ = np.flatnonzero(mine[:n] != other[:n])
        head = int(differ[0]) if len(differ) else n
        found[own[:head]] = True
        own, other = own[head:], other[head:]
        mine, n = a[own], min(len(own), len(other))
        differ = np.flatnonzero(mine[::-1][:n] != other[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        found[own[len(own) - tail:]] = True
        own, other = own[: len(own) - tail], other[: len(other) - tail]
        # A line that the other page lacks is on no common subsequence.
        own = own[np.isin(a[own], other)]
        mine = a[own]
        other = other[np.isin(other, mine)]
        if not len(own) or not len(other):
            continue
        if (len(own) + 1) * (len(other) + 1) <= CELLS or len(own) == 1:
            table, i, j = _table(mine, other), len(mine), len(other)
            while i and j:
                if mine[i - 1] == other[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
                    found[own[i - 1]] = True
                    i, j = i - 1, j - 1
                elif table[i - 1, j] >= table[i, j - 1]:
                    i -= 1
                else:
                    j -= 1
        else:
            half = len(own) // 2
            cut = int(np.argmax(_last_row(mine[:half], other) + _last_row(mine[half:][::-1], other[::-1])[::-1]))
            work += [(own[:half], other[:cut]), (own[half:], other[cut:])]
    return found


def _common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the lines to delete, of pages that have any."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            lines, sizes = np.frombuffer(r["lines"], np.uint64), np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
            zones = np.frombuffer(r["zones"], np.uint8)
            near = [r[side] for side in ("before", "after") if r[side] is not None]
            for other in sorted(near, key=lambda x: -_common_start(r["path"], x["path"])):
                shared = common_lines(lines, np.frombuffer(other["lines"], np.uint64))
                if sizes[shared].sum() <= COPY * max(r["chars"], other["chars"]):
                    gone = np.flatnonzero(shared & (zones < ARTICLE)).astype(np.uint32)
                    if len(gone):
                        rows.append((r["host"], r["same"], gone.tobytes()))
                    break
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "same", "gone"])


def template_lines(pages: DataFrame) -> DataFrame:
    """_d, _t and ``gone`` (line numbers) of the pages of which lines are shared with a neighbour."""
    read = stored(pages.mapInArrow(_lines, LINE_SCHEMA), "page_lines")
    # The least path stands for the pages of a host with equal lines.
    least = F.min(F.struct("path", "chars", "lines", "sizes", "zones")).alias("p")
    unlike = read.groupBy("host", "same").agg(least).select("host", "p.path", "same", "p.chars", "p.lines", "p.sizes", "p.zones")
    in_order = ordered(unlike, ["host", "path", "same"], "ordered_pages")
    own = in_order.withColumn("place", place(in_order)).drop("part", "at")
    rows = own
    for side, step in (("before", 1), ("after", -1)):
        other = own.select((F.col("place") + step).alias("place"), F.struct("host", "path", "chars", "lines").alias(side))
        rows = rows.join(other, "place", "left").withColumn(side, F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)))
    gone = stored(rows.drop("place").mapInArrow(_differences, GONE_SCHEMA), "shared_lines")
    return stored(read.select("_d", "_t", "host", "same").distinct().join(gone, ["host", "same"]).select("_d", "_t", "gone"), "template_lines")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            page = Page(html)
            least = ARTICLE if ARTICLE in page.zones else MAIN if MAIN in page.zones else PLAIN
            held = set(np.frombuffer(gone or b"", np.uint32).tolist())
            texts.append("\n".join(x for i, (z, x) in enumerate(zip(page.zones, page.lines, strict=True)) if z >= least and i not in held))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text (main text, a line per block) of every page.

    Where a page has ``article`` elements, their lines are the main text; else those of the
    elements named as main or content; else all. Lines of menus, headers, footers, sidebars,
    notices, adverts, forms and comments are no main text anywhere, nor are lines outside
    an article that are shared with the nearest page of the host. References are decoded, white
    space is one space. A null html is empty and gives an empty text, as does a page without
    main text; a null url has the empty host. Repeated rows give repeated results. Other
    columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"),
                        F.coalesce(F.col("page_id").cast("long"), F.lit(LAST_ID)).alias("_d"), F.xxhash64("url", "html").alias("_t"))
    gone = template_lines(rows.select("_d", "_t", "url", "html"))
    return rows.join(gone, ["_d", "_t"], "left").select("page_id", "url", "html", "gone").mapInArrow(_texts, TEXT_SCHEMA)
