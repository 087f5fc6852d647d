"""The plain text of WARC conversion records: every character reference, and HTML only."""
import html
import random
from html.entities import html5

import pytest

from lexframe.llm import warc

RESPONSE = "record_id string, target_uri string, date string, block string, page_id long"


def converted(spark, blocks):
    r = spark.createDataFrame([(f"r{i}", "u", "d", b, i) for i, b in enumerate(blocks)], RESPONSE)
    got = {x.page_id: x for x in warc.derive(r).filter("record_type = 'conversion'").collect()}
    return [got[i] for i in range(len(blocks))]


def test_every_reference_decodes_like_html_unescape(spark):
    rng = random.Random(8)
    names = sorted(html5)
    texts = [f"x&{n}y z &{n} w" for n in names] + [f"a&amp;{n}b" for n in names[::50]]
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F642, 0x1FFFE, 0x10FFFF,
               0x110000, 10 ** 9, 10 ** 40, *(rng.randrange(0x110000) for _ in range(300))]
    texts += [f"a&#{n};b&#0{n} c&#x{n:x};d&#X{n:04X}-" for n in numbers]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg;", "& lt", "&unknown; &copyright; &notit; &LT", "&amp;amp;lt;", "R&D &#38;copy; &#", "no reference"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    got = {r.i: r.d for r in df.select("i", warc.decode_references(df.t).alias("d")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == html.unescape(t).replace("\xa0", " "), t


def test_footer_of_a_page_is_wholly_plain_text(spark):
    page = "HTTP/1.1 200 OK\r\ncontent-type:  Text/HTML; charset=utf-8\r\n\r\n<p>&copy; 2024 A &middot; B &#8212; C&#x1F642; &eacute;t&eacute; &lt;b&gt; R&amp;D&nbsp;x</p>"
    row, = converted(spark, [page])
    assert row.block == "© 2024 A · B — C🙂 été <b> R&D x"
    assert row.content_length == len(row.block.encode())


@pytest.mark.parametrize("kind", ["text/plain", "application/json; charset=utf-8", "text/htmlx"])
def test_text_of_other_types_is_kept_whole(spark, kind):
    text = 'if a <b and c> d:\n\n  &lt; {"k": "<p>"}'
    row, = converted(spark, [f"HTTP/1.1 200 OK\r\nServer: text/html\r\nContent-Type: {kind}\r\n\r\n{text}"])
    assert row.block == text


def test_html_by_its_other_type(spark):
    row, = converted(spark, ["HTTP/1.1 200 OK\r\nContent-Type: application/xhtml+xml\r\n\r\n<p>a</p><p>b</p>"])
    assert row.block == "a\nb"


def records(data):
    """The records of a WARC file, stepping by ``Content-Length``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *fields = data[at:end].decode().split("\r\n")
        fields = dict(f.split(": ", 1) for f in fields)
        assert first == "WARC/1.1"
        stop = end + 4 + int(fields["Content-Length"])
        assert data[stop:stop + 4] == b"\r\n\r\n"
        yield fields, data[end + 4:stop]
        at = stop + 4


def test_written_files_hold_whole_records(spark, tmp_path):
    bodies = ["", "<p>a</p>\n\n<p>\u00e9</p>", "x" * 300_000, "one\r\n\r\ntwo", "WARC/1.1\r\n"]
    r = spark.createDataFrame([(f"r{i}", "u", "d", f"HTTP/1.1 200 OK\r\nContent-Type: text/{'html' if i < 3 else 'plain'}\r\n\r\n{b}", i, "x", "y")
                               for i, b in enumerate(bodies)], RESPONSE + ", block_digest string, k string").repartition(2)
    derived = warc.derive(r)
    warc.write_warc(derived, str(tmp_path / "out"))
    got = sorted((f["WARC-Record-ID"], f["WARC-Refers-To"], f["WARC-Type"], b.decode())
                 for p in (tmp_path / "out").glob("part-*") for f, b in records(p.read_bytes()))
    assert got == sorted((x.record_id, x.refers_to, x.record_type, x.block) for x in derived.collect())
    assert len(got) == 10


def test_no_responses(spark):
    empty = spark.createDataFrame([], RESPONSE)
    assert warc.derive(empty).count() == 0 and warc.record_text(warc.derive(empty)).count() == 0


def test_sql_decodes_like_html_unescape():
    import duckdb
    texts = [f"x&{n}y z &{n} w" for n in sorted(html5)] + [f"a&#{n};b&#0{n} &#x{n:x};-" for n in [*range(0, 300), 0xD800, 0xFDD0, 0xFFFE, 0x1F642, 0x110000, 10 ** 50]]
    texts += ["&", "&&;", "&#;", "&#xg; &notit; &copyright", "&amp;amp;lt; R&D"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, '', ?)", [(i, t) for i, t in enumerate(texts)])
    got = dict(con.sql(f"SELECT page_id, block FROM ({warc.SQL}) WHERE record_type = 'conversion'").fetchall())
    tidy = lambda t: "\n".join(x for x in (line.strip(" ") for line in t.split("\n")) if x)
    for i, t in enumerate(texts):
        if "\r" not in html.unescape(t):
            assert tidy(got[i]) == tidy(html.unescape(t).replace("\xa0", " ")), t
