"""WARC derivatives: metadata and plain-text conversion records of HTTP responses.

Each response (record id, target URI, date, HTTP header block, payload) gives two
records that refer to it: ``metadata`` (source headers and digests as fields) and
``conversion`` (the payload's plain text). Ids are URNs derived from the response's id,
so reruns agree. Blocks and payloads have SHA-256 digests. ``read_responses`` reads
responses of WARC files, ``write`` writes records into such files.

Text: comments, scripts, styles and the head go (a comment, script or style without its
end reaches to the end of the page, so each is looked at once); block ends and breaks
become line feeds, other tags blanks, where a tag is a ``<`` before a letter, ``/``, ``!``
or ``?``; character references become their characters; blanks collapse and blank lines
go. References are decoded once and must end with a semicolon: the 252 names of HTML 4
and decimal or hexadecimal numbers of characters. Others stay as they are. A no-break
space is a blank.

Defined cases: a null payload is empty, a null URI, id or date is left out of the header;
repeated rows give repeated records; other columns are ignored; an empty table gives an
empty result. No shuffle: a record is made from its response's row alone. In files a
record is what lies between two lines ``WARC/1.1``, so a payload that holds such a line is cut
there; payloads are read as UTF-8.
"""

from __future__ import annotations

from html.entities import name2codepoint
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh

NAMESPACE = "millrace"
#: (pattern, replacement) in order; RE2 and Java read them alike.
STEPS = [
    (r"(?is)<(?:!--.*?(?:-->|\z)|script[^>]*>.*?(?:</script[^>]*>|\z)|style[^>]*>.*?(?:</style[^>]*>|\z)|head(?:\s[^>]*)?>.*?(?:</head\s*>|<body[^>]*>))", " "),
    (r"(?i)</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|caption|article|section|nav|header|footer|main|aside|figure|figcaption|form|fieldset|address|details|summary|pre|blockquote|hr|br)(?:/|[ \t\r\n][^>]*)?>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", " "),
]
TIDY = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n")]
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
NAMES = {name: chr(code) for name, code in sorted(name2codepoint.items())}
#: Replaced first, as none of their characters can be part of a reference; what is then left but ``&amp;`` is rare.
COMMON = ["nbsp", "lt", "gt", "quot", "copy", "middot"]
RARE = "&(#[0-9xX]|(?!amp;)[A-Za-z][A-Za-z0-9]{1,9};)"


def _character(code: Column) -> Column:
    """The character of a code point; null for what is none."""
    fits = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decoded(text: Column) -> Column:
    """Character references as their characters."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(NAMES.items())])

    def piece(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(p, REFERENCE, 1)
        code = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7)).try_cast("long")
        char = F.when(F.substring(ref, 1, 1) == "#", _character(code)).otherwise(names[ref])
        after = F.substring(p, F.length(ref) + 2, F.length(p))
        return F.when(i == 0, p).when((ref != "") & char.isNotNull(), F.concat(char, after)).otherwise(F.concat(F.lit("&"), p))

    for name in COMMON:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(NAMES[name]))
    text = F.replace(text, F.lit("&#39;"), F.lit("'"))
    whole = F.array_join(F.transform(F.split(text, "&", -1), piece), "")
    return F.when(F.regexp_like(text, F.lit(RARE)), whole).otherwise(F.replace(text, F.lit("&amp;"), F.lit("&")))


def stripped(html: Column) -> Column:
    """The page without its tags."""
    out = F.coalesce(html, F.lit(""))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def tidied(text: Column) -> Column:
    out = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    for pattern, to in TIDY:
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out, F.lit(" \n"))


def with_text(rows: DataFrame, html: str, name: str = "text") -> DataFrame:
    """Adds the plain text of a column. Each step is a column of its own, so that none is evaluated again where the next one refers to it twice."""
    (step,) = fresh([*rows.columns, name], "step")
    return rows.withColumn(step, stripped(F.col(html))).withColumn(step, decoded(F.col(step))).withColumn(name, tidied(F.col(step))).drop(step)


def urn(*parts: Column) -> Column:
    """A stable URN of the parts."""
    h = F.sha2(F.concat_ws("|", F.lit(NAMESPACE), *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html) of pages fetched with status 200."""
    payload = F.coalesce("html", F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), payload.alias("payload"))


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def record(kind: str, content_type: str) -> Column:
    """A whole record of the columns record_id, refers_to, target_uri, date and block."""
    head = [_field("WARC-Type", F.lit(kind)), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Refers-To", F.col("refers_to")), _field("WARC-Target-URI", F.col("target_uri")), _field("WARC-Date", F.col("date")), _field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("block_digest"))), _field("Content-Type", F.lit(content_type)), _field("Content-Length", F.octet_length("block").cast("string"))]
    return F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"))


def derivatives(resp: DataFrame) -> DataFrame:
    """(page_id, type, record_id, refers_to, target_uri, block_digest, block, record): two rows a response."""
    source = with_text(resp.select("page_id", "record_id", "target_uri", "date", "http_header", "payload"), "payload").withColumn("meta_id", urn(F.lit("metadata"), F.col("record_id"))).withColumn("conv_id", urn(F.lit("conversion"), F.col("record_id")))
    meta = F.concat(
        _field("source-payload-digest", F.concat(F.lit("sha256:"), F.sha2("payload", 256))),
        _field("source-payload-bytes", F.octet_length("payload").cast("string")),
        _field("conversion-record", F.col("conv_id")),
        _field("conversion-digest", F.concat(F.lit("sha256:"), F.sha2("text", 256))),
        F.lit("source-http-headers:\r\n"), F.col("http_header"),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("type"), F.col("meta_id").alias("record_id"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.col("conv_id").alias("record_id"), F.col("text").alias("block")),
    )
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.explode(both).alias("r")).select("page_id", "refers_to", "target_uri", "date", "r.*")
    rows = rows.withColumn("block_digest", F.sha2("block", 256))
    whole = F.when(F.col("type") == "metadata", record("metadata", "application/warc-fields")).otherwise(record("conversion", "text/plain; charset=utf-8"))
    return rows.withColumn("record", whole)


def read_responses(spark: SparkSession, path: str, version: str = "1.1") -> DataFrame:
    """Response records (record_id, target_uri, date, http_header, payload) of uncompressed WARC files of a version, read split by split. Other records go."""
    rows = spark.read.option("lineSep", f"WARC/{version}\r\n").text(path).where("value <> ''")
    cut = F.instr("value", "\r\n\r\n")
    head, body = F.expr("substring(value, 1, instr(value, '\\r\\n\\r\\n') + 1)"), F.substring(F.col("value"), cut + 4, F.length("value"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    told = rows.select(head.alias("head"), F.regexp_replace(body, r"\r\n\r\n\z", "").alias("block")).where(F.lower(field("WARC-Type")) == "response")
    split = F.instr("block", "\r\n\r\n")
    return told.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"),
        F.when(split > 0, F.substring(F.col("block"), F.lit(1), split + 3)).otherwise(F.col("block")).alias("http_header"),
        F.when(split > 0, F.substring(F.col("block"), split + 4, F.length("block"))).otherwise("").alias("payload"),
    )


def write(records: DataFrame, path: str, column: str = "record") -> None:
    """Records into uncompressed WARC files, one after another."""
    records.select(F.regexp_replace(column, r"\r\n\z", "").alias("value")).write.option("lineSep", "\r\n").text(path)


def digests(pages: DataFrame) -> DataFrame:
    """The records of all pages with their digests and lengths in place of their bodies."""
    return derivatives(responses(pages)).select("page_id", "type", "record_id", "refers_to", "target_uri", F.length("block").cast("long").alias("block_chars"), "block_digest", F.sha2("record", 256).alias("record_sha256"))


def digests_sql() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "coalesce(html, '')"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
    names = "MAP {" + ", ".join(f"{quote(n)}: chr({ord(c)})" for n, c in NAMES.items()) + "}"
    code = "CASE WHEN lower(r[2]) = 'x' THEN CAST('0x' || r[3:] AS BIGINT) ELSE CAST(r[2:] AS BIGINT) END"
    char = f"CASE WHEN r[1] <> '#' THEN (SELECT m FROM names)[r] WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INTEGER)) END"
    decode = f"(SELECT string_agg(CASE WHEN i = 1 THEN p WHEN r <> '' AND c IS NOT NULL THEN c || p[length(r) + 2:] ELSE '&' || p END, '' ORDER BY i) FROM (SELECT i, p, r, {char} AS c FROM (SELECT i, p, regexp_extract(p, {quote(REFERENCE)}, 1) AS r FROM (SELECT unnest(s) AS p, unnest(range(1, len(s) + 1)) AS i))))"
    tidy = "replace(d, chr(160), ' ')"
    for pattern, to in TIDY:
        tidy = f"regexp_replace({tidy}, {quote(pattern)}, {quote(to)}, 'g')"
    tidy = f"trim({tidy}, ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"

    def urn_(*parts):
        h = f"sha256(concat_ws('|', '{NAMESPACE}', {', '.join(parts)}))"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    def field(name, value):
        return f"coalesce('{name}: ' || {value} || {crlf}, '')"

    return f"""
WITH names AS (
  SELECT {names} AS m
), cut AS (
  SELECT *, string_split({text}, '&') AS s FROM pages
), told AS (
  SELECT page_id, url, html, {decode} AS d FROM cut
), resp AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, {urn_("'response'", "CAST(page_id AS VARCHAR)", "url")} AS record_id, url AS target_uri, '2024-01-01T00:00:00Z' AS date,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf} AS http_header,
         coalesce(html, '') AS payload, {tidy} AS text
  FROM told
), named AS (
  SELECT *, {urn_("'metadata'", "record_id")} AS meta_id, {urn_("'conversion'", "record_id")} AS conv_id FROM resp
), rows AS (
  SELECT page_id, 'metadata' AS type, meta_id AS record_id, record_id AS refers_to, target_uri, date,
         {field("source-payload-digest", "'sha256:' || sha256(payload)")} || {field("source-payload-bytes", "strlen(payload)")} || {field("conversion-record", "conv_id")} || {field("conversion-digest", "'sha256:' || sha256(text)")} || 'source-http-headers:' || {crlf} || http_header AS block,
         'application/warc-fields' AS content_type FROM named
  UNION ALL
  SELECT page_id, 'conversion', conv_id, record_id, target_uri, date, text, 'text/plain; charset=utf-8' FROM named
)
SELECT page_id, type, record_id, refers_to, target_uri, CAST(length(block) AS BIGINT) AS block_chars, sha256(block) AS block_digest,
       sha256('WARC/1.1' || {crlf} || {field("WARC-Type", "type")} || {field("WARC-Record-ID", "record_id")} || {field("WARC-Refers-To", "refers_to")} || {field("WARC-Target-URI", "target_uri")} || {field("WARC-Date", "date")} || {field("WARC-Block-Digest", "'sha256:' || sha256(block)")} || {field("Content-Type", "content_type")} || {field("Content-Length", "strlen(block)")} || {crlf} || block || {crlf} || {crlf}) AS record_sha256
FROM rows"""
