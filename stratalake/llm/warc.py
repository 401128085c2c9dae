"""WARC derivatives: linked metadata and plain-text conversion records from responses."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "\r\n"
VERSION = "WARC/1.1"
#: The named entities of HTML 4; the ampersand is decoded last, so that nothing is decoded twice.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items()) if name != "amp"} | {"apos": "'"}
UNSEEN = "<(?is:!--.*?-->|script[^>]*>.*?</script[^>]*>|style[^>]*>.*?</style[^>]*>)"
BLOCK_TAGS = "</?(?i:address|article|aside|blockquote|body|br|div|dd|dl|dt|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|title|tr|ul)(?:[ \\t\\n\\r/][^>]*)?>"


def record_id(*parts: Column) -> Column:
    """A name-based urn:uuid (version 3 layout) of the parts; equal parts give equal ids."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3),
                    F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def plain_text(html: Column) -> Column:
    """Visible text: block tags break lines, references are decoded once.

    A tag begins with ``<`` and a letter, ``/``, ``!`` or ``?``; any other ``<`` is text. Numbered
    references, decimal or hexadecimal, to what is no character become U+FFFD; unknown names stay.
    """
    text = F.regexp_replace(html, UNSEEN, "")
    text = F.regexp_replace(text, BLOCK_TAGS, "\n")
    text = F.regexp_replace(text, "<[A-Za-z/!?][^>]*>", "")
    text = _once(_once(text, _named), _numbered)
    text = F.regexp_replace(text, "&(?:amp|#0*38|#[xX]0*26);", "&")
    # Runs of white space become one space; a single space is not touched.
    text = F.regexp_replace(text, " *[\\t\\x0B\\f\\r\\x{A0}][ \\t\\x0B\\f\\r\\x{A0}]*| {2,}", " ")
    return F.trim(F.regexp_replace(text, " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def _once(value: Column, change: Callable[[Column], Column]) -> Column:
    """``change(value)`` with the value worked out once, however often ``change`` names it."""
    return F.transform(F.array(value), change)[0]


def _named(text: Column) -> Column:
    known = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z]+[0-9]*);"), 1))
    return F.aggregate(names, text, lambda acc, n: F.coalesce(
        F.replace(acc, F.concat(F.lit("&"), n, F.lit(";")), F.try_element_at(known, n)), acc))


def _numbered(text: Column) -> Column:
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(0*[1-9][0-9]{0,6}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{0,5});"), 1))
    return F.aggregate(numbers, text, lambda acc, n: F.when(_code(n) == 38, acc).otherwise(
        F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), _sign(_code(n)))))


def _code(number: Column) -> Column:
    """The code point of a number as written, decimal or with an x before hexadecimal digits."""
    hexadecimal = F.lower(F.substring(number, 1, 1)) == "x"
    return F.when(hexadecimal, F.conv(F.substring(number, 2, 99), 16, 10)).otherwise(number).cast("long")


def _sign(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    none = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(none, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: record_id, target_uri, date, block (HTTP head and body).

    A null url or html is empty. Repeated pages give repeated records with one id.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
                    F.octet_length(html).cast("string"), F.lit(BREAK * 2))
    return pages.select("page_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
                        url.alias("target_uri"), F.lit(date).alias("date"), F.concat(head, html).alias("block"))


def _record(kind: str, own: Column, refers_to: Column, uri: Column, date: Column, content_type: str, block: Column, more: list[tuple[str, Column]]) -> Column:
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", own), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri),
              ("WARC-Date", date), *more, ("WARC-Block-Digest", digest(block)), ("Content-Type", F.lit(content_type)),
              ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat(F.lit(VERSION + BREAK), *(F.concat(F.lit(f"{n}: "), v, F.lit(BREAK)) for n, v in fields), F.lit(BREAK))
    return F.struct(F.lit(kind).alias("warc_type"), own.alias("record_id"), refers_to.alias("refers_to"), uri.alias("target_uri"),
                    digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"),
                    block.alias("block"), F.concat(head, block, F.lit(BREAK * 2)).alias("record"))


def derivatives(responses: DataFrame) -> DataFrame:
    """A metadata record and, for 2xx HTML or text, a conversion record of each response.

    Both refer to the response's id. The metadata block keeps the HTTP status and headers
    and the digests of the source block and payload; the conversion block is the plain
    text. A null block is empty: its status and headers are missing, nothing is converted.
    Other columns are carried along, but lose to the record's own names.
    """
    block = F.coalesce("block", F.lit(""))
    cut = F.instr(block, BREAK * 2)
    own = ["record_id", "target_uri", "date"]
    other = [c for c in responses.columns if c not in (*own, "block", "warc_type", "refers_to", "block_digest", "content_length", "record")]
    rows = responses.select(*other, *(F.coalesce(c, F.lit("")).alias(f"_{c}") for c in own), block.alias("_block"),
                            F.when(cut > 0, F.substring(block, F.lit(1), cut - 1)).otherwise("").alias("_head"),
                            F.when(cut > 0, block.substr(cut + 4, F.length(block))).otherwise("").alias("_body"))
    status = F.regexp_extract("_head", "^HTTP/[0-9.]+ ([0-9]{3})", 1)
    kind = F.lower(F.regexp_extract("_head", "(?i)\\nContent-Type: *([a-z/+.-]+)", 1))
    good = status.startswith("2") & kind.isin("text/html", "application/xhtml+xml", "text/plain")
    rows = rows.withColumns({"_status": status, "_text": F.when(good, F.when(kind == "text/plain", F.col("_body")).otherwise(plain_text(F.col("_body")))),
                             "_payload": digest(F.col("_body")), "_source": digest(F.col("_block"))})
    fields = F.concat(F.lit("source-status: "), "_status", F.lit(f"{BREAK}source-block-digest: "), "_source",
                      F.lit(f"{BREAK}source-payload-digest: "), "_payload", F.lit(BREAK),
                      F.regexp_replace(F.regexp_replace("_head", "^[^\\r\\n]*\\r?\\n?", ""), "(?m)^(?=.)", "source-header-"), F.lit(BREAK))
    rows = rows.withColumn("_fields", fields)
    args = [F.col(f"_{c}") for c in own]
    payload = [("WARC-Source-Payload-Digest", F.col("_payload"))]
    records = F.array(
        _record("metadata", record_id(F.lit("metadata"), args[0]), *args, "application/warc-fields", F.col("_fields"), []),
        F.when(F.col("_text").isNotNull(), _record("conversion", record_id(F.lit("conversion"), args[0]), *args, "text/plain; charset=utf-8", F.col("_text"), payload)))
    return rows.select(*other, F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select(*other, "r.*")
