"""WARC derivatives: each response gets a linked metadata record and a plain-text conversion record.

All three records of a page come from one narrow pass of built-in functions. A derived record names its response in
``refers_to``, keeps its target URI, date and payload digest, and has digests of its own. Identifiers are name-based, so a
repeated run gives the same ones; rows that agree in page id, URL and body give the same records again.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.storage import table

DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
#: (pattern, replacement) in order: what a browser does not show goes, block elements end lines, other tags vanish.
CLEANING = [
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
    (r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|article|section|nav|header|footer|main|aside|blockquote|pre|form|title|body|html)\b[^>]*>", "\n"),
    (r"<[a-zA-Z/!][^>]*>", ""),
]
#: A character reference behind its ampersand; after numbers and some old names the semicolon may be missing.
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: What the HTML standard's names stand for; a space that does not break counts as a space.
NAMES = {name: " " if text == "\xa0" else text for name, text in html5.items()}
#: The names that need no semicolon, longer ones first.
OLD_NAMES = "^&(?:" + "|".join(sorted((n for n in NAMES if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
#: Numbers from 128 on that the standard reads as Windows-1252.
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
SPACING = [
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LINK = r"(?i)<a\s[^>]*href="
LANG = r"(?i)<html\b[^>]*\blang=[\"']?([a-zA-Z-]+)"


def _number(reference: Column) -> Column:
    digits = lambda pattern: F.ltrim(F.regexp_extract(reference, pattern, 1), F.lit("0"))
    ten, sixteen = digits("^&#([0-9]+)"), digits("^&#[xX]([0-9a-fA-F]+)")
    # Seven digits hold every character, and no longer number is converted.
    code = F.when(F.greatest(F.length(ten), F.length(sixteen)) > 7, 0).otherwise(F.coalesce(F.conv(F.when(ten != "", ten), 10, 10), F.conv(F.when(sixteen != "", sixteen), 16, 10), F.lit("0")).cast("int"))

    def char(n: Column) -> Column:
        outside = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        given = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(outside, "\ufffd").when(n.between(0x80, 0x9F), F.substring(F.lit(WINDOWS), n - 0x7F, F.lit(1))).when(n == 0xA0, " ").otherwise(given)

    return F.get(F.transform(F.array(code), char), F.lit(0))


def decoded(text: Column) -> Column:
    """``text`` with its character references read once, so that what an ampersand's reference leaves is no reference."""
    letters = range(ord("A"), ord("z") + 1)
    by_letter = ["\x02".join(f"{n}\x01{v}" for n, v in NAMES.items() if ord(n[0]) == c) for c in letters]
    maps = F.array(*(F.str_to_map(F.lit(m), F.lit("\x02"), F.lit("\x01")) for m in by_letter))  # folded to a constant

    def known(reference: Column) -> Column:
        return F.element_at(F.get(maps, F.ascii(F.substring(reference, 2, 1)) - letters[0]), F.substring(reference, F.lit(2), F.length(reference)))

    def one(reference: Column) -> Column:
        old = F.regexp_extract(reference, OLD_NAMES, 0)
        begun = F.when(old != "", F.concat(known(old), F.substring(reference, F.length(old) + 1, F.length(reference))))
        return F.when(reference.startswith("&#"), _number(reference)).otherwise(F.coalesce(known(reference), begun, reference))

    def after(piece: Column) -> Column:
        whole = F.array(F.concat(F.lit("&"), F.regexp_extract(piece, REFERENCE, 0)))
        read = F.transform(whole, lambda r: F.when(r == "&", F.concat(r, piece)).otherwise(F.concat(one(r), F.substring(piece, F.length(r), F.length(piece)))))
        return F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece)))).otherwise(F.get(read, F.lit(0)))

    def joined(pieces: Column) -> Column:
        return F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), after)), "")

    return F.get(F.transform(F.array(F.split(text, "&", -1)), joined), F.lit(0))  # the text is worked out once


def plain_text(html: Column) -> Column:
    for pattern, by in CLEANING:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(by))
    html = decoded(html)
    for pattern, by in SPACING:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(by))
    return html


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _identifier(*parts: Column) -> Column:
    name = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _header_lines(headers: Column) -> Column:
    return F.filter(F.split(headers, r"\r?\n"), lambda x: F.trim(x) != "")


def derivatives(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", headers_col: str | None = None, date_col: str | None = None) -> DataFrame:
    """Three records a page: response, metadata, conversion.

    ``headers_col`` names the status and header lines that the server sent: a response then holds them before the body, as
    HTTP does, and its metadata keeps each of them. A page without any is recorded by its body alone. ``date_col`` names
    the dates of capture; ``date`` stands where it is null or not given.

    A null URL or body counts as empty; a page of no text gives a conversion record of length 0; repeated rows give their
    records again; a null page id stays null. Other columns are not read.
    """
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    headers = _header_lines(F.coalesce(F.col(headers_col), F.lit(""))) if headers_col else F.array().cast("array<string>")
    captured = F.coalesce(F.col(date_col).cast("string"), F.lit(date)) if date_col else F.lit(date)
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), html.alias("html"), headers.alias("headers"), captured.alias("warc_date"))
    base = base.withColumns({"text": plain_text(F.col("html")), "payload": _digest(F.col("html"))})
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    base = base.withColumn("response_id", _identifier(F.lit("response"), key, F.col("url"), F.col("payload")))
    fields = F.concat(
        F.lit("title: "), F.trim(F.regexp_replace(F.regexp_extract("html", TITLE, 1), r"\s+", " ")), F.lit(END),
        F.lit("language: "), F.regexp_extract("html", LANG, 1), F.lit(END),
        F.lit("outlinks: "), F.regexp_count("html", F.lit(LINK)).cast("string"), F.lit(END),
        F.lit("source-payload-digest: "), F.col("payload"), F.lit(END),
        F.lit("source-content-length: "), F.octet_length("html").cast("string"), F.lit(END),
        F.array_join(F.transform("headers", lambda x: F.concat(F.when(x.contains(":"), "source-header-").otherwise("source-status: "), x, F.lit(END))), ""),
    )
    http = F.size("headers") > 0
    response = F.when(http, F.concat(F.array_join("headers", END), F.lit(END + END), F.col("html"))).otherwise(F.col("html"))

    def record(kind: str, content_type: Column, block: Column) -> Column:
        own = F.col("response_id") if kind == "response" else _identifier(F.lit(kind), F.col("response_id"))
        return F.struct(
            F.lit(kind).alias("warc_type"), own.alias("record_id"),
            (F.lit("") if kind == "response" else F.col("response_id")).alias("refers_to"),
            content_type.alias("content_type"), block.alias("block"),
        )

    records = F.array(
        record("response", F.when(http, "application/http; msgtype=response").otherwise("text/html"), response),
        record("metadata", F.lit("application/warc-fields"), fields),
        record("conversion", F.lit("text/plain"), F.col("text")),
    )
    rows = base.select("page_id", "warc_date", F.col("url").alias("target_uri"), F.col("payload").alias("source_payload_digest"), F.explode(records).alias("r"))
    return rows.select(
        "page_id", "r.warc_type", "r.record_id", "r.refers_to", "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"), "source_payload_digest", "r.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """One string a record: header lines, an empty line and the block. Line ends within a value are percent-encoded."""
    header = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    one_line = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{name}: "), one_line(c), F.lit(END))).otherwise("") for name, c in header]
    return records.select(F.concat(F.lit("WARC/1.1" + END), *lines, F.lit(END), "block").alias("value"))


def write_warc(records: DataFrame, folder: str) -> None:
    """WARC 1.1 files, one a partition, gzipped; the writer's line end is the empty lines that close a record."""
    serialised(records).write.option("lineSep", END + END).option("compression", "gzip").text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Header lines as a map and the block of every record; records whose block isn't of the stated length come with ``whole`` false."""
    text = spark.read.option("lineSep", END + END + "WARC/1.1" + END).text(folder)
    record = text.select(F.regexp_replace("value", r"^WARC/1\.1\r\n", "").alias("v"))
    cut = record.select(F.split("v", END + END, 2).alias("p"))
    lines = F.filter(F.split(F.col("p")[0], END), lambda x: x.contains(": "))
    pair = F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.regexp_replace(x, r"^[^:]*: ", "").alias("value")))
    parsed = cut.select(F.map_from_entries(pair).alias("headers"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("block"))
    # The last record of a file keeps the empty lines that close it.
    size = F.col("headers")["Content-Length"].cast("long")
    block = F.when((F.octet_length("block") == size + 4) & F.col("block").endswith(END + END), F.expr("left(block, length(block) - 4)")).otherwise(F.col("block"))
    return parsed.withColumn("block", block).withColumn("whole", F.octet_length("block") == size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))


def _decoded_sql(text: str, quote: Callable[[str], str]) -> str:
    """The rule of HTML for character references, said in SQL for pieces that follow an ampersand."""
    names = f"MAP([{', '.join(map(quote, NAMES))}], [{', '.join(map(quote, NAMES.values()))}])"
    ten, sixteen = (f"ltrim(regexp_extract(r, {quote(p)}, 1), '0')" for p in ("^#([0-9]+)", "^#[xX]([0-9a-fA-F]+)"))
    code = f"CASE WHEN greatest(length({ten}), length({sixteen})) > 7 THEN 0 WHEN {ten} <> '' THEN {ten}::int WHEN {sixteen} <> '' THEN ('0x' || {sixteen})::int ELSE 0 END"
    char = f"CASE WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN substr({quote(WINDOWS)}, n - 127, 1) WHEN n = 160 THEN ' ' ELSE chr(n) END"
    old = f"regexp_extract(r, {quote(OLD_NAMES.replace('&', '', 1))}, 0)"
    named = f"CASE WHEN r = '' THEN '&' ELSE coalesce(names[r], names[{old}] || substr(r, length({old}) + 1), '&' || r) END"
    one = f"CASE WHEN r[1] = '#' THEN list_transform([{code}], lambda n: {char})[1] ELSE {named.replace('names', names)} END || substr(p, length(r) + 1)"
    piece = f"list_transform([regexp_extract(p, {quote(REFERENCE)}, 0)], lambda r: {one})[1]"
    pieces = f"string_split({text}, '&')"
    return f"array_to_string(list_concat({pieces}[1:1], list_transform({pieces}[2:], lambda p: {piece})), '')"


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "html"
    replaced = lambda text, pattern, by: f"regexp_replace({text}, {quote(pattern)}, {'chr(10)' if by == chr(10) else quote(by)}, 'g')"
    for pattern, by in CLEANING:
        text = replaced(text, pattern, by)
    cleaned, text = text, "text"
    for pattern, by in SPACING:
        text = replaced(text, pattern, by)
    uuid = lambda m: f"'<urn:uuid:' || substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-' || substr({m}, 13, 4) || '-' || substr({m}, 17, 4) || '-' || substr({m}, 21, 12) || '>'"
    end = "chr(13) || chr(10)"
    fields = " || ".join(
        [
            "'title: '", f"trim(regexp_replace(regexp_extract(html, {quote(TITLE)}, 1), '\\s+', ' ', 'g'))", end,
            "'language: '", f"regexp_extract(html, {quote(LANG)}, 1)", end,
            "'outlinks: '", f"len(regexp_extract_all(html, {quote(LINK)}))::varchar", end,
            "'source-payload-digest: '", "payload", end,
            "'source-content-length: '", "octet_length(encode(html))::varchar", end,
        ]
    )
    part = lambda kind, own, refers, content, block: f"SELECT page_id, '{kind}' AS warc_type, {own} AS record_id, {refers} AS refers_to, url AS target_uri, '{content}' AS content_type, {block} AS block, payload FROM named"
    derived = lambda kind: uuid(f"md5('{kind}' || chr(10) || response_id)")
    return f"""
WITH base AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
shown AS (SELECT *, {cleaned} AS shown FROM base),
decoded AS (SELECT * EXCLUDE (shown), {_decoded_sql("shown", quote)} AS text FROM shown),
cleaned AS (SELECT * REPLACE ({text} AS text), 'sha256:' || sha256(html) AS payload FROM decoded),
hashed AS (SELECT *, md5('response' || chr(10) || coalesce(page_id::varchar, '') || chr(10) || url || chr(10) || payload) AS name FROM cleaned),
named AS (SELECT *, {uuid("name")} AS response_id FROM hashed),
records AS ({part("response", "response_id", "''", "text/html", "html")}
UNION ALL {part("metadata", derived("metadata"), "response_id", "application/warc-fields", fields)}
UNION ALL {part("conversion", derived("conversion"), "response_id", "text/plain", "text")})
SELECT page_id, warc_type, record_id, refers_to, target_uri, '{DATE}' AS warc_date, content_type,
  octet_length(encode(block))::bigint AS content_length, 'sha256:' || sha256(block) AS block_digest,
  payload AS source_payload_digest, block
FROM records"""


ORACLE_SQL = _oracle()
