"""WARC derivative builder (DataFrame functions only).

Response records become a metadata record and a plain-text conversion record that
refer to them: ``WARC-Refers-To`` is the response's record id, the target URI, date
and the response's payload digest are carried over, and the metadata block keeps
the HTTP status, the server's headers and the response's digests.

Defined results: a record without a URI or block derives with empty values; a
response whose block has no blank line has headers only and an empty payload;
repeated rows derive records with the same ids; extra columns are not read.  A payload
of another type than HTML, or of none, is carried over as it is.  Character references
decode as in ``html.unescape``, but one for a no-break space gives a space.
"""
from __future__ import annotations

import json
from collections import defaultdict
from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .registry import register

CRLF = "\r\n"
#: fixed values: tags that end a line of text, and what is hidden
LINE_TAGS = r"(?i)</?(?:p|br|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title|body|html|head|blockquote|pre)\b[^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
CONTENT_TYPE = r"(?im)^content-type[ \t]*:(?:[ \t]|\r\n[ \t])*([^;,\s]*)"
HTML_TYPES = ("text/html", "application/xhtml+xml")
#: names that count without a semicolon too, the longest first, and the text of references to 0x80 to 0x9F
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
C1_TEXT = [unescape(f"&#{n};") for n in range(0x80, 0xA0)]
FETCH_DATE = "2024-01-01T00:00:00Z"


def record_id(*parts: Column) -> Column:
    """A record id that depends on the parts only, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def _names() -> Column:
    """All names of HTML by their first letter, as one constant."""
    by_letter = defaultdict(dict)
    for name, text in html5.items():
        by_letter[name[0]][name] = text
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def _code_point(s: Column) -> Column:
    """The number of a reference that starts ``#``; what is over 0x10FFFF is 0x110000."""
    dec, hexa = (F.ltrim(F.regexp_extract(s, p, 1), F.lit("0")) for p in (r"^#([0-9]+)", r"^#[xX]([0-9a-fA-F]+)"))
    over = F.lit(0x110000).cast("long")
    number = F.when(F.length(dec) + F.length(hexa) > 7, over).when(dec != "", dec.try_cast("long")) \
        .when(hexa != "", F.conv(hexa, 16, 10).try_cast("long")).otherwise(F.lit(0).cast("long"))
    return F.least(number, over)


def _code_text(n: Column) -> Column:
    """The character ``n``; numbers that are none give the replacement character or nothing."""
    bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(n)
    return F.when(n.between(0x80, 0x9F), F.get(F.array(*map(F.lit, C1_TEXT)), (n - 0x80).cast("int"))).when(none & ~bad, F.lit("")) \
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))


def _reference(s: Column, number: Column, closed: Column, opened: Column) -> Column:
    """What stands for ``s``, the text after an ``&`` up to the next one, by what it starts with."""
    names = _names()
    found = lambda name: F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    decoded = lambda text, name: F.concat(F.translate(text, "\u00a0", " "), s.substr(F.length(name) + 1, F.length(s)))
    return F.coalesce(F.when(number != "", decoded(_code_text(_code_point(number)), number)), F.when(closed != "", decoded(found(closed), closed)),
                      F.when(opened != "", decoded(found(opened), opened)), F.concat(F.lit("&"), s))


def decode_references(text: Column) -> Column:
    """All named and numeric character references of ``text``, each decoded once."""
    # higher-order functions share no common parts: ``text`` and each pattern stand here once
    starts = F.transform(F.split(text, "&"), lambda s, i: F.struct(
        s.alias("s"), (i == 0).alias("head"), F.regexp_extract(s, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0).alias("number"),
        F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9]*;", 0).alias("closed"), F.regexp_extract(s, f"^(?:{'|'.join(OPEN_NAMES)})", 0).alias("opened")))
    return F.array_join(F.transform(starts, lambda x: F.when(x["head"], x["s"]).otherwise(
        _reference(x["s"], x["number"], x["closed"], x["opened"]))), "")


def plain_text(html: Column) -> Column:
    """Visible text: comments, scripts and styles go, block tags end lines, other
    tags vanish, runs of white space become one space, references are decoded,
    blank lines go."""
    t = F.regexp_replace(html, HIDDEN, "")
    t = F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " ")
    t = F.regexp_replace(t, LINE_TAGS, "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = decode_references(t)
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return F.btrim(t, F.lit(" \n"))


def responses_from_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Response records of stored pages: ``(key, record_id, target_uri, date, block)``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    html = F.coalesce(F.col("html"), F.lit(""))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                     F.octet_length(html).cast("string"), F.lit(CRLF * 2), html)
    return pages.select(F.col(key), record_id(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), url).alias("record_id"),
                        url.alias("target_uri"), F.lit(FETCH_DATE).alias("date"), block.alias("block"))


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records per response: ``(key, record_type, record_id, refers_to, target_uri,
    date, content_type, payload_digest, block_digest, content_length, block)``."""
    block = F.coalesce(F.col("block"), F.lit(""))
    end = F.instr(block, CRLF * 2)
    r = responses.select(
        F.col(key), F.coalesce("record_id", F.lit("")).alias("rid"), F.coalesce("target_uri", F.lit("")).alias("uri"),
        F.coalesce("date", F.lit("")).alias("date"), block.alias("b"),
        F.when(end > 0, F.expr(f"substring(coalesce(block, ''), 1, instr(coalesce(block, ''), '\\r\\n\\r\\n') - 1)")).otherwise(block).alias("head"),
        F.when(end > 0, F.expr(f"substring(coalesce(block, ''), instr(coalesce(block, ''), '\\r\\n\\r\\n') + 4)")).otherwise("").alias("payload"))
    r = r.select("*", digest(F.col("b")).alias("source_digest"), digest(F.col("payload")).alias("payload_digest"))
    is_html = F.lower(F.regexp_extract("head", CONTENT_TYPE, 1)).isin(*HTML_TYPES)
    text = F.when(is_html, plain_text(F.col("payload"))).otherwise(F.col("payload"))
    lines = F.split("head", CRLF)
    fields = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("http-header: "), x))
    meta = F.concat_ws(CRLF, F.concat(F.lit("http-status: "), F.get(lines, 0)), fields,
                       F.concat(F.lit("response-block-digest: "), F.col("source_digest")),
                       F.concat(F.lit("response-payload-digest: "), F.col("payload_digest")), F.lit(""))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), text.alias("block")))
    d = r.select(key, "rid", "uri", "date", "payload_digest", F.explode(kinds).alias("k"))
    return d.select(key, F.col("k.record_type").alias("record_type"), record_id(F.col("k.record_type"), F.col("rid")).alias("record_id"),
                    F.col("rid").alias("refers_to"), F.col("uri").alias("target_uri"), "date", F.col("k.content_type").alias("content_type"),
                    "payload_digest", digest(F.col("k.block")).alias("block_digest"),
                    F.octet_length("k.block").cast("long").alias("content_length"), F.col("k.block").alias("block"))


def record_text(derived: DataFrame) -> DataFrame:
    """One column ``value``: each record as it stands in a WARC file, but for its last
    CRLF, which the writer of lines adds."""
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "date"), ("WARC-Refers-To-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"),
             ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in names))
    return derived.select(F.concat(head, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF)).alias("value"))


def write_warc(derived: DataFrame, path: str) -> None:
    """One WARC file per partition, as plain text: a compressed one would need a gzip
    member for each record, and Spark writes one for each file."""
    record_text(derived).write.option("lineSep", CRLF).option("compression", "none").text(path)


_SQL_ID = "'<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>'"
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_SQL_NAMES = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in html5.items())
_SQL_LATIN = ", ".join(f"({0x80 + i}, {_quoted(t)})" for i, t in enumerate(C1_TEXT))
SQL = rf"""
WITH names(name, txt) AS (VALUES {_SQL_NAMES}),
     latin(code, txt) AS (VALUES {_SQL_LATIN}),
     src AS (SELECT row_number() OVER () AS rn, page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html,
                    md5('response|' || page_id || '|' || coalesce(url, '')) AS m FROM pages),
     r AS (SELECT rn, page_id, uri, html, {_SQL_ID} AS rid, strlen(html) AS n FROM src),
     b AS (SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) ||
                  'Content-Length: ' || n || chr(13) || chr(10) || chr(13) || chr(10) || html AS blk, 'sha256:' || sha256(html) AS pd FROM r),
     t1 AS (SELECT *, regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g') AS t FROM b),
     t2 AS (SELECT * REPLACE (regexp_replace(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'),
            '{LINE_TAGS}', chr(10), 'g') AS t) FROM t1),
     t3 AS (SELECT * REPLACE (regexp_replace(t, '<[^>]*>', '', 'g') AS t) FROM t2),
     amp AS (SELECT rn, i, p[i] AS s FROM (SELECT rn, string_split(t, '&') AS p FROM t3) q, generate_series(1, len(p)) g(i)),
     ref AS (SELECT *, regexp_extract(s, '^#([0-9]+|[xX][0-9a-fA-F]+);?') AS num, regexp_extract(s, '^[A-Za-z][A-Za-z0-9]*;') AS closed FROM amp),
     point AS (SELECT *, CASE WHEN num = '' THEN NULL
                              WHEN num[2:2] IN ('x', 'X') THEN coalesce(try_cast('0x0' || trim(num[3:], ';') AS HUGEINT), 1114112)
                              ELSE coalesce(try_cast(trim(num[2:], ';') AS HUGEINT), 1114112) END AS cp FROM ref),
     opened AS (SELECT rn, i, max_by(n.name, length(n.name)) AS name FROM ref JOIN names n ON NOT ends_with(n.name, ';') AND starts_with(ref.s, n.name)
                GROUP BY rn, i),
     said AS (SELECT p.rn, p.i, p.s,
                     CASE WHEN p.num <> '' THEN p.num WHEN c.name IS NOT NULL THEN c.name ELSE o.name END AS used,
                     CASE WHEN p.num <> '' THEN
                          CASE WHEN cp BETWEEN 128 AND 159 THEN l.txt
                               WHEN cp = 0 OR cp BETWEEN 55296 AND 57343 OR cp > 1114111 THEN chr(65533)
                               WHEN cp BETWEEN 1 AND 8 OR cp = 11 OR cp BETWEEN 14 AND 31 OR cp = 127 OR cp BETWEEN 64976 AND 65007
                                    OR cp % 65536 IN (65534, 65535) THEN ''
                               ELSE chr(cp::INTEGER) END
                          WHEN c.name IS NOT NULL THEN c.txt ELSE n.txt END AS txt
              FROM point p LEFT JOIN names c ON c.name = p.closed LEFT JOIN opened o ON o.rn = p.rn AND o.i = p.i
                           LEFT JOIN names n ON n.name = o.name LEFT JOIN latin l ON l.code = p.cp),
     whole AS (SELECT rn, string_agg(CASE WHEN i = 1 THEN s WHEN used IS NULL THEN '&' || s
                                          ELSE replace(txt, chr(160), ' ') || s[length(used) + 1:] END, '' ORDER BY i) AS t FROM said GROUP BY rn),
     t5 AS (SELECT t3.* REPLACE (whole.t AS t) FROM t3 JOIN whole USING (rn)),
     t4 AS (SELECT * REPLACE (trim(regexp_replace(t, ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS t) FROM t5),
     k AS (SELECT page_id, rid, uri, pd, 'conversion' AS record_type, 'text/plain' AS content_type, t AS block FROM t4
           UNION ALL
           SELECT page_id, rid, uri, pd, 'metadata', 'application/warc-fields',
                  'http-status: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'http-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) ||
                  'http-header: Content-Length: ' || n || chr(13) || chr(10) || 'response-block-digest: sha256:' || sha256(blk) || chr(13) || chr(10) ||
                  'response-payload-digest: ' || pd || chr(13) || chr(10) FROM t4),
     i AS (SELECT *, md5(record_type || '|' || rid) AS m FROM k)
SELECT page_id, record_type, {_SQL_ID} AS record_id, rid AS refers_to, uri AS target_uri, '{FETCH_DATE}' AS date, content_type,
       pd AS payload_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block
FROM i
"""


@register("op6_warc_derivatives", SQL)
def op6_warc_derivatives(spark, sf_dir):
    return derive(responses_from_pages(read_table(spark, sf_dir, "pages")))
