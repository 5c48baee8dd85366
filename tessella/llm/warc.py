"""WARC derivatives: response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VERSION = b"WARC/1.1"
#: A whole tag without oddities; what it can't match goes to _walk.
_PLAIN = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:\s++[^\s/>="'<]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s>"'=<`]++))?+)*+)\s*+/?+>""")
_PAIR = re.compile(r"""([^\s/>="'<]++)(?:=(?:"([^"]*+)"|'([^']*+)'|([^\s>"'=<`]++)))?+""")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*+"), re.compile(r"=?+[^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
#: Elements whose content is no text, those that link, and the attributes that hold the link.
_HIDDEN = {k: re.compile(f"</{k}(?=[\\s/>])", re.I) for k in ("script", "style", "template", "noscript")}
_TITLE_END = re.compile(r"</title(?=[\s/>])", re.I)
_LINKING, _TARGETS = frozenset(["a", "area", "link", "img", "script", "iframe"]), ("href", "src")
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")
#: Elements that end a line of plain text.
_BLOCK = frozenset(["address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"])


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return _VERSION + b"\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file's bytes; a broken one is a ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(next((v for k, v in headers.items() if k.lower() == "content-length"), -1))
        block = data[end + 4 : end + 4 + size]
        if size < 0 or len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} is cut short")
        yield Record(headers, block)
        at = end + 8 + size


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {source}'.encode()).digest()[:16], version=5)}>"


def response(page_id: int | None, url: str | None, body: str | None, date: str) -> Record:
    """The response record of a stored page. Line breaks in a url would end its header; they become %0D and %0A."""
    payload = (body or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").strip()
    block = http + payload
    return Record({
        "WARC-Type": "response", "WARC-Record-ID": _urn("response", f"{page_id} {uri}"), "WARC-Date": date, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}, block)


def _walk(source: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of a tag from behind its name, and where the tag ends; len(source) + 1 if it never does."""
    pairs = []
    while True:
        at = _GAP.match(source, at).end()
        if at >= len(source):
            return pairs, len(source) + 1
        if source[at] == ">":
            return pairs, at + 1
        name = _NAME.match(source, at)
        value, at = "", name.end()
        if equals := _EQUALS.match(source, at):
            at = equals.end()
            if source[at : at + 1] in ('"', "'"):
                end = source.find(source[at], at + 1)
                if end < 0:
                    return pairs, len(source) + 1
                value, at = source[at + 1 : end], end + 1
            else:
                bare = _BARE.match(source, at)
                value, at = bare[0], bare.end()
        pairs.append((name[0].lower(), value))


def scan(source: str) -> tuple[list[str], list[tuple[str, str, str]], str | None]:
    """Text pieces, links (element, attribute, target as written) and title of a page, in one pass whose time is linear in the page.

    A tag's attributes are read as browsers do: quotes count only behind an
    equals sign, the first of several alike attributes holds, white space
    and line breaks may stand between them. A tag or comment that never ends hides the rest.
    """
    out, links, title, at, n = [], [], None, 0, len(source)
    ends: dict[str, bool] = {}
    while True:
        i = source.find("<", at)
        if i < 0:
            out.append(source[at:].replace("\n", " "))
            return out, links, title
        nxt = source[i + 1 : i + 2]
        if not (nxt.isascii() and nxt.isalpha()) and nxt not in ("/", "!", "?"):
            out.append(source[at : i + 1].replace("\n", " "))
            at = i + 1
            continue
        out.append(source[at:i].replace("\n", " "))
        if m := _PLAIN.match(source, i):
            name, at, pairs = m[1].lower(), m.end(), None
        elif m := _TAG_NAME.match(source, i):
            name = m[1].lower()
            pairs, at = _walk(source, m.end())
        else:
            close = "-->" if source.startswith("<!--", i) else ">"
            end = source.find(close, i + 4 if len(close) == 3 else i + 2)
            if end < 0:
                return out, links, title
            at = end + len(close)
            continue
        if at > n:
            return out, links, title
        if name in _BLOCK:
            out.append("\n")
        if nxt == "/":
            continue
        if name in _LINKING:
            if pairs is None:
                pairs = [(k.lower(), v or w or x) for k, v, w, x in _PAIR.findall(m[2])] if m[2] else []
            seen = set()
            for k, v in pairs:
                if k in _TARGETS and k not in seen:
                    seen.add(k)
                    links.append((name, k, v))
        if name in _HIDDEN:
            # an end that was not found once is not there further on
            end = _HIDDEN[name].search(source, at) if ends.get(name, True) else None
            ends[name] = end is not None
            if end is None:
                return out, links, title
            at = end.start()
        elif name == "title" and title is None and ends.get(name, True):
            end = _TITLE_END.search(source, at)
            ends[name] = end is not None
            if end is not None:
                title = source[at : end.start()]
                out.append(title.replace("\n", " "))
                at = end.start()


def _lines(pieces: list[str]) -> str:
    # references are resolved last, so that an escaped bracket is never taken for mark-up
    return html.unescape(_LINES.sub("\n", _BLANKS.sub(" ", "".join(pieces))).strip())


def plain_text(source: str) -> str:
    """Text without mark-up: a line per block element, blanks collapsed, character references resolved; comments, scripts and styles go."""
    return _lines(scan(source)[0])


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response record.

    Both name it in WARC-Refers-To, keep its target and date, and carry
    their own block digests; the metadata record names the conversion, and its JSON holds all of its WARC and
    HTTP headers, its digests as stored and as found, title and links.
    """
    head, _, payload = source.block.partition(b"\r\n\r\n")
    text = payload.decode("utf-8", "replace")
    status, *fields = head.decode("latin-1").split("\r\n")
    origin = source.headers["WARC-Record-ID"]
    found = digest(payload)
    pieces, found_links, title = scan(text)
    links = [{"path": f"{name}@{attribute}", "url": html.unescape(url).strip()} for name, attribute, url in found_links]
    body = _lines(pieces).encode("utf-8", "replace")
    kept = {k: source.headers[k] for k in ("WARC-Date", "WARC-Target-URI") if k in source.headers}
    conversion = Record({"WARC-Type": "conversion", "WARC-Record-ID": _urn("conversion", origin), "WARC-Refers-To": origin, **kept, "WARC-Block-Digest": digest(body), "Content-Type": "text/plain; charset=utf-8", "Content-Length": str(len(body))}, body)
    meta = json.dumps({
        "warc-headers": source.headers, "http-status": status, "http-headers": dict(x.split(": ", 1) for x in fields if ": " in x),
        "payload-digest": found, "payload-digest-matches": source.headers.get("WARC-Payload-Digest") in (None, found), "conversion": conversion.headers["WARC-Record-ID"],
        "title": html.unescape(_BLANKS.sub(" ", title).strip()) if title is not None else None, "links": links}, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    metadata = Record({"WARC-Type": "metadata", "WARC-Record-ID": _urn("metadata", origin), "WARC-Refers-To": origin, "WARC-Concurrent-To": conversion.headers["WARC-Record-ID"], **kept, "WARC-Block-Digest": digest(meta), "Content-Type": "application/json", "Content-Length": str(len(meta))}, meta)
    return metadata, conversion


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): each page as the bytes of a response record, dated alike unless pages has a column date, which is taken as text.

    Null urls and pages are empty; repeated rows give a record each; an
    empty table gives an empty one; other columns are ignored.
    """
    dated = pages.select("page_id", "url", "html", F.coalesce(F.col("date").cast("string"), F.lit(date)).alias("date") if "date" in pages.columns else F.lit(date).alias("date"))

    def work(batches):
        for b in batches:
            rows = [response(i, u, h, d).to_bytes() for i, u, h, d in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], ["page_id", "record"])

    return dated.mapInArrow(work, "page_id long, record binary")


def derivatives(records: DataFrame, digests: bool = False) -> DataFrame:
    """Metadata and conversion records of records(page_id, record), where record holds the bytes of WARC records.

    Other records than responses have no derivatives; a null or broken
    record gives none either, but a row with its error. Returns page_id,
    source_id (record id of the response), source_digest (its payload
    digest), metadata_id, conversion_id, n_links, title, n_text, error and
    the two records' bytes, or with digests their SHA-256. Every record is
    worked on alone: repeated rows give repeated rows, with the same ids. The
    time a page takes is linear in its length, whatever it holds, and a task
    holds one batch of records; an empty table gives an empty one, further columns are ignored.
    """
    kind = "string" if digests else "binary"
    schema = f"page_id long, source_id string, source_digest string, metadata_id string, conversion_id string, n_links long, title string, n_text long, error string, metadata {kind}, conversion {kind}"

    def rows(page, raw):
        try:
            for source in parse_records(raw if raw is not None else b"\0"):
                if source.headers.get("WARC-Type") != "response":
                    continue
                metadata, conversion = derive(source)
                said = json.loads(metadata.block)
                out = [metadata.to_bytes(), conversion.to_bytes()]
                yield (page, source.headers["WARC-Record-ID"], said["payload-digest"], metadata.headers["WARC-Record-ID"], conversion.headers["WARC-Record-ID"], len(said["links"]), said["title"], len(conversion.block.decode()), None, *[hashlib.sha256(x).hexdigest() if digests else x for x in out])
        except (ValueError, KeyError) as e:
            yield (page, *[None] * 7, f"{type(e).__name__}: {e}", None, None)

    def work(batches):
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.string() if digests else pa.binary()] * 2]
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for b in batches:
            made = [r for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(p, raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names)

    return records.select("page_id", "record").mapInArrow(work, schema)


def write_warc(records: DataFrame, path: str, column: str = "record", per_file: int = 50_000) -> None:
    """Write a column of whole WARC records as gzipped .warc files in a folder of any file system that Spark writes to, at most per_file records each. Null records are left out."""
    tail = "\r\n\r\n"  # every record ends so; the writer puts it behind each row
    body = F.col(column)
    cut = records.where(body.isNotNull()).select(F.expr(f"cast(substring({column}, 1, octet_length({column}) - {len(tail)}) as string)").alias("value"))
    cut.write.option("lineSep", tail).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(file, at, type, record): the records of a folder of gzipped WARC files, in the order of each file."""
    import gzip

    def work(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(parse_records(gzip.decompress(raw)))
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(found), pa.string()), "at": pa.array(range(len(found)), pa.int64()), "type": pa.array([r.headers.get("WARC-Type") for r in found], pa.string()), "record": pa.array([r.to_bytes() for r in found], pa.binary())})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(work, "file string, at long, type string, record binary")
