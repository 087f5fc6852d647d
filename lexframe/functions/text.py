"""Text expressions: stripping, tags, entities, casing, slugs, tokens.

All of them are built-in Spark functions (codegen'd, JVM side).  Where
Python's ``str`` semantics are the target, ``(?U)`` makes Java's regex
classes Unicode aware.
"""
from __future__ import annotations

import json
from collections import defaultdict
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ENTITIES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()``: Unicode white space off both ends.

    The regex only runs when the first or last character is white space
    (checked on one character), so clean text costs two substrings.
    """
    c = _c(col)
    edge = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(r"(?U)\s")
    return F.when(edge, F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def is_blank(col) -> Column:
    """True when the text is NULL or only white space."""
    c = _c(col)
    return c.isNull() | ~c.rlike(r"(?U)\S")


def decode_entities(col) -> Column:
    """Decode the handful of named entities pages use; ``&amp;`` last."""
    c = _c(col)
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


#: names that count without a semicolon too, the longest first, and the text of references to 0x80 to 0x9F
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_C1_TEXT = [unescape(f"&#{n};") for n in range(0x80, 0xA0)]


def _entity_names() -> Column:
    """All character names of HTML by their first letter, as one constant."""
    by_letter = defaultdict(dict)
    for name, text in html5.items():
        by_letter[name[0]][name] = text
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def _code_point(ref: Column) -> Column:
    """The number of a reference that starts ``#``; beyond 0x10FFFF it is 0x110000."""
    dec, hexa = (F.ltrim(F.regexp_extract(ref, p, 1), F.lit("0")) for p in (r"^#([0-9]+)", r"^#[xX]([0-9a-fA-F]+)"))
    over = F.lit(0x110000).cast("long")
    number = (F.when(F.length(dec) + F.length(hexa) > 7, over).when(dec != "", dec.try_cast("long"))
              .when(hexa != "", F.conv(hexa, 16, 10).try_cast("long")).otherwise(F.lit(0).cast("long")))
    return F.least(number, over)


def _code_text(n: Column) -> Column:
    """The character ``n``; numbers that are none give the replacement character or nothing."""
    bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
            | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(n)
    c1 = F.get(F.array(*map(F.lit, _C1_TEXT)), (n - 0x80).cast("int"))
    return (F.when(n.between(0x80, 0x9F), c1).when(none & ~bad, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")))


def decode_references(col) -> Column:
    """Every named and numeric character reference, decoded once, as
    ``html.unescape`` does.  Text without ``&`` is passed through."""
    c = _c(col)
    parts = F.transform(F.split(c, "&"), lambda s, i: F.struct(
        s.alias("s"), (i == 0).alias("head"), F.regexp_extract(s, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0).alias("number"),
        F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9]*;", 0).alias("closed"),
        F.regexp_extract(s, f"^(?:{'|'.join(_OPEN_NAMES)})", 0).alias("opened")))

    def decoded(x):
        s, names = x["s"], _entity_names()
        found = lambda n: F.try_element_at(F.try_element_at(names, F.substring(n, 1, 1)), n)
        rest = lambda n: s.substr(F.length(n) + 1, F.length(s))
        return F.coalesce(F.when(x["head"], s),
                          F.when(x["number"] != "", F.concat(_code_text(_code_point(x["number"])), rest(x["number"]))),
                          F.when(x["closed"] != "", F.concat(found(x["closed"]), rest(x["closed"]))),
                          F.when(x["opened"] != "", F.concat(found(x["opened"]), rest(x["opened"]))), F.concat(F.lit("&"), s))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def strip_tags(col) -> Column:
    """Drop tags, keep the text between them (entities decoded)."""
    return decode_entities(F.regexp_replace(_c(col), r"<[^>]*>", ""))


def text_pieces(col) -> Column:
    """The stripped, non-empty text nodes of an HTML fragment, in order."""
    pieces = F.split(_c(col), r"<[^>]*>")
    return F.filter(F.transform(pieces, lambda x: strip_ws(decode_entities(x))),
                    lambda x: x != "")


def cell_text(col, sep: str = " ") -> Column:
    """``get_text(separator=sep, strip=True)`` of a cell."""
    return F.array_join(text_pieces(col), sep)


def is_upper(col) -> Column:
    """Python ``str.isupper()``: has a cased letter and no lower-case one."""
    c = _c(col)
    return (c == F.upper(c)) & (c != F.lower(c))


def title_case(col) -> Column:
    """Python ``str.title()``: each letter run starts upper, rest lower.

    ``initcap`` splits on white space only (``(amendment)`` stays lower),
    so runs of letters and of non-letters are cased one by one.
    """
    runs = F.regexp_extract_all(_c(col), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                             F.lower(F.substring(r, 2, 1 << 30)))),
        "")


def slug(col) -> Column:
    """File-name slug: runs of non-word characters become ``_``, lower case."""
    return F.lower(F.regexp_replace(_c(col), r"(?U)\W+", "_"))


def token_array(col) -> Column:
    """Word and punctuation tokens (``\\w+`` or one non-space symbol)."""
    return F.regexp_extract_all(_c(col), F.lit(r"(?U)(\w+|[^\w\s])"), 1)


def token_count(col) -> Column:
    """Number of word/punctuation tokens; NULL text counts 0."""
    return F.coalesce(F.size(token_array(col)).cast("bigint"), F.lit(0).cast("bigint"))
