"""JSON lines (tolerant / strict), raw act tree, text files, year seed, URL keys."""
from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lexframe.functions import urls
from lexframe.sources.files import read_act_pages, read_text_files
from lexframe.sources.jsonl import keyed_items, read_jsonl
from lexframe.sources.seed import year_seed


def _item(**kw):
    base = {"name": "A", "year": "2004", "url": "https://s.example/eli/2004/act/11/enacted/en/print.html",
            "full_text": "<html/>", "plain_text": None}
    base.update(kw)
    return json.dumps(base)


def test_jsonl_tolerant_statuses(spark):
    d = tempfile.mkdtemp(prefix="lexframe-jsonl-")
    lines = [_item(), "", "{broken", _item(url=""), _item(full_text=""), _item(url="https://s.example/other"),
             _item(name="Again")]
    path = os.path.join(d, "laws.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    items = keyed_items(read_jsonl(spark, path))
    got = sorted(r.status for r in items.collect())
    assert got == sorted(["ok", "error:json", "error:empty", "error:empty", "error:no_key", "ok"])
    with pytest.raises(Exception):
        read_jsonl(spark, path, strict=True).collect()


def test_act_tree_and_text_files(spark):
    root = tempfile.mkdtemp(prefix="lexframe-raw-")
    for rel, body in [("2004/act_11.html", "<html>a</html>"), ("2013/act_46.html", "<html>b</html>"),
                      ("2013/notes.html", "<html>c</html>")]:
        os.makedirs(os.path.join(root, os.path.dirname(rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(body)
    got = {(r.year, r.act_number, r.status) for r in read_act_pages(spark, root).collect()}
    assert got == {(2004, 11, "ok"), (2013, 46, "ok"), (None, None, "error:path")}
    txt = tempfile.mkdtemp(prefix="lexframe-txt-")
    os.makedirs(os.path.join(txt, "sub"))
    for rel in ["a.txt", "sub/b.txt", "c.md"]:
        with open(os.path.join(txt, rel), "w") as f:
            f.write(rel)
    assert sorted(os.path.basename(r.doc_id) for r in read_text_files(spark, txt).collect()) == ["a.txt", "b.txt"]


def test_url_keys_and_seed(spark):
    df = spark.createDataFrame([("https://s.example/eli/2000/act/42/enacted/en/print.html",),
                                ("https://s.example/2004/act/",), ("/x/007/index.html",)], "u string")
    r = df.select(urls.url_year("u").alias("y"), urls.url_act_number("u").alias("n"),
                  urls.url_path_year("u").alias("p"),
                  urls.link_transform(F.col("u"), F.lit(2001), "https://s.example").alias("l")).collect()
    assert (r[0].y, r[0].n, r[0].p) == (2000, 42, "enacted") and r[1].y is None
    assert r[2].l == "https://s.example/eli/2001/act/7/enacted/en/print.html" and r[0].l is None
    seed = year_seed(spark, 2000, 2003, "https://s.example").collect()
    assert [s.url for s in seed] == [f"https://s.example/eli/{y}/act/" for y in (2000, 2001, 2002)]
    p = spark.createDataFrame([("raw/2004/act_11.html",), ("raw\\2013\\act_46.html",), ("raw/04/act_1.html",)], "p string")
    assert [(x.y, x.n) for x in p.select(urls.path_year("p").alias("y"), urls.path_act_number("p").alias("n")).collect()] \
        == [(2004, 11), (2013, 46), (None, None)]
