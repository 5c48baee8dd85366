"""The page scan against html.parser, against hostile pages, and WARC files read back."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessella.llm.warc import derivatives, derive, parse_records, plain_text, read_warc, response, responses, scan, write_warc


@pytest.mark.parametrize(("page", "url"), [
    ('<a class=x href="y">', "y"), ('<a  href="y">', "y"), ('<a\n   href="y">', "y"), ('<script async src="a.js"></script>', "a.js"), ('<img alt src="x.png">', "x.png"),
    ('<a target=_blank href="z">', "z"), ("<link rel=stylesheet href=/a.css>", "/a.css"), ('<a class="x"  href="y">', "y"), ("<A HREF = 'q' >", "q"), ('<a title="a > b" href=r>', "r"),
    ("<img src=a/b.png/>", "a/b.png/"), ("<a title=it's href=s>", "s"), ('<a href="1" href="2">', "1"),
])
def test_links_are_found(page, url):
    assert [x[2] for x in scan(page + " text")[1]] == [url]


class Brute(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links = []

    def handle_starttag(self, tag, attrs):
        seen = set()
        for k, v in attrs:
            if tag in ("a", "area", "link", "img", "script", "iframe") and k in ("href", "src") and k not in seen:
                seen.add(k)
                self.links.append((tag, k, v or ""))


def test_links_equal_a_parser():
    rng = random.Random(3)
    blank = lambda: rng.choice([" ", "  ", "\n ", "\t"])
    for _ in range(300):
        page = []
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(["a", "A", "img", "link", "p", "div", "iframe", "area", "b"])
            attrs = []
            for _ in range(rng.randint(0, 4)):
                name, quote = rng.choice(["href", "src", "class", "data-x", "HREF", "alt", "disabled"]), rng.choice(['"', "'", "", None])
                value = "".join(rng.choice("abc/.:?=1 >" if quote else "abc/.:1") for _ in range(rng.randint(1, 8)))
                attrs.append(name if quote is None else f"{name}={quote}{value}{quote}" if rng.random() < 0.8 or not quote else f"{name} = {quote}{value}{quote}")
            page.append(f"<{tag}{''.join(blank() + x for x in attrs)}{rng.choice(['', ' ', ' /' if not attrs or attrs[-1][-1:] in chr(34) + chr(39) else ''])}>{rng.choice(['', 'text', ' x < y ', '<!-- <a href=no> -->', '</p>', '<script>var x = 1 < 2;</script>'])}")
        page = "".join(page)
        brute = Brute()
        brute.feed(page)
        assert [(t, k, v) for t, k, v in scan(page)[1]] == brute.links, page


@pytest.mark.parametrize("unit", ["<a ", "<title>", "<p ", "<", "<!--", '<a href="', "<a x='", "</", "<script>", "<a href=x>", "<!", "<a b=c ", "<title>x</title>", "\n ", "&lt;"])
def test_hostile_pages_take_linear_time(unit):
    page, began = unit * (1_000_000 // len(unit)), time.process_time()
    scan(page)
    plain_text(page)
    assert time.process_time() - began < 12


def test_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<title>T</title><p>one<p>two é"), (2, None, None), (None, "x\r\ny", "<a href=q>" * 50), (1, "http://a", "<title>T</title><p>one<p>two é")], "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("date", F.lit(3))
    made = responses(pages)
    out = derivatives(made)
    rows = made.unionByName(out.select("page_id", F.col("metadata").alias("record"))).unionByName(out.select("page_id", F.col("conversion").alias("record")))
    write_warc(rows, f"{tmp_path}/w", per_file=2)
    got = read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted(bytes(r["record"]) for r in got) == sorted(bytes(r["record"]) for r in rows.collect())
    assert sorted(r["type"] for r in got) == ["conversion"] * 4 + ["metadata"] * 4 + ["response"] * 4
    assert derivatives(made.limit(0)).count() == 0


def test_derivatives_name_their_source():
    source = response(7, "http://a", '<title>A &amp; B</title><a\nhref="x&amp;y">z</a><script>no</script><p>p', "2020-01-01T00:00:00Z")
    metadata, conversion = derive(next(parse_records(source.to_bytes())))
    assert conversion.block.decode() == "A & B\nz\np" and metadata.headers["WARC-Refers-To"] == conversion.headers["WARC-Refers-To"] == source.headers["WARC-Record-ID"]
    assert b'"url": "x&y"' in metadata.block and b'"title": "A & B"' in metadata.block
