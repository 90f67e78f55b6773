"""WARC archives of pages: a writer of one gzip member a record and a sequential reader.

A file begins with a warcinfo record. Each page is a response record, whose block is an HTTP response with the page's
HTML in UTF-8, or a revisit record, whose block is the HTTP head alone and which names the response with the same
payload. Both carry the SHA-256 of the full payload and of their own block.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, fresh, written
from .tokens import in_batches

#: Payloads from here on are stored once and revisited by their equals.
REVISIT_BYTES = 100
#: A task starts another file once this many compressed bytes are in one.
FILE_BYTES = 1 << 30
#: Bytes read and decompressed at a time.
_STEP = 1 << 16
_LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()),
     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("damage", pa.string())]
)


class Damaged(ValueError):
    """A record that isn't as its fields say. ended: nothing after it in the file can be read."""

    def __init__(self, what: str, ended: bool = False):
        super().__init__(what)
        self.ended = ended


def _member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as one gzip member; fields without a value are left out."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def _page(row: dict, date: str) -> bytes:
    """The record of a row (page_id, url, html, payload_digest, payload_bytes, record_id, refers_to_record)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    seen = row["refers_to_record"] is not None
    block = head if seen else head + row["html"].encode()
    url = None if row["url"] is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), row["url"])
    return _member(
        [
            ("WARC-Type", "revisit" if seen else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("X-Page-ID", None if row["page_id"] is None else str(row["page_id"])), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Block-Digest", _digest(block)),
            ("WARC-Profile", _PROFILE if seen else None), ("WARC-Refers-To", f"<{row['refers_to_record']}>" if seen else None), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def _members(source) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a file, its bytes as they are decompressed; what isn't taken of a member is passed over."""
    left, ended = b"", False
    while not ended:
        left = left or source.read(_STEP)
        if not left:
            return

        def parts() -> Iterator[bytes]:
            nonlocal left, ended
            unpacker = zlib.decompressobj(31)
            while not unpacker.eof:
                data = unpacker.unconsumed_tail or left or source.read(_STEP)
                left = b""
                try:
                    part = unpacker.decompress(data, _STEP)
                except zlib.error as e:
                    ended = True
                    raise Damaged(f"gzip: {e}", ended=True) from e
                if not (data or part or unpacker.eof):
                    ended = True
                    raise Damaged("the file ends within a gzip member", ended=True)
                yield part
            left = unpacker.unused_data

        member = parts()
        yield member
        for _ in member:
            pass


class _Stream:
    """Bytes of a member, taken up to a mark or by number."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def _more(self) -> bool:
        for part in self.parts:
            if part:
                self.held += part
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (end := self.held.find(mark, max(0, at - len(mark) + 1))) < 0:
            at = len(self.held)
            if not self._more():
                raise Damaged("a head without its empty line")
        out, self.held = self.held[:end], self.held[end + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes in parts."""
        while n:
            if not self.held and not self._more():
                raise Damaged(f"{n} bytes short of Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def rest(self) -> bytes:
        """What is left, as far as it is needed to tell it from a record's end."""
        while len(self.held) <= 4 and self._more():
            pass
        return self.held


def _head(raw: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields of a head, names in lower case."""
    first, *lines = raw.decode().split("\r\n")
    parts = [line.partition(":") for line in lines]
    if any(not colon for _, colon, _ in parts):
        raise Damaged("a field without a colon")
    return first, {k.strip().lower(): v.strip() for k, _, v in parts}


def _length(fields: dict[str, str]) -> int:
    if not re.fullmatch("[0-9]+", n := fields.get("content-length", "")):
        raise Damaged("no Content-Length")
    return int(n)


def _record(parts: Iterator[bytes]) -> dict | None:
    """One page's record, its digests verified; None for a record of another type."""
    stream = _Stream(parts)
    first, fields = _head(stream.until(b"\r\n\r\n"))
    if not re.fullmatch(r"WARC/1\.[01]", first):
        raise Damaged("no WARC version")
    kind = fields.get("warc-type")
    whole, payload, body = hashlib.sha256(), hashlib.sha256(), bytearray()
    page = kind in ("response", "revisit")
    for part in stream.take(_length(fields)):
        whole.update(part)
        if page:
            body += part
    if stream.rest() != b"\r\n\r\n":
        raise Damaged("a record that doesn't end after its block")
    if fields.get("warc-block-digest", f"sha256:{whole.hexdigest()}") != f"sha256:{whole.hexdigest()}":
        raise Damaged("block digest")
    if not page:
        return None
    at = body.find(b"\r\n\r\n") + 4
    if at < 4:
        raise Damaged("an HTTP head without its empty line")
    _, http = _head(bytes(body[: at - 4]))
    del body[:at]
    payload.update(body)
    told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (told != payload.hexdigest() or _length(http) != len(body)):
        raise Damaged("payload digest or length")
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "url": fields.get("warc-target-uri"), "record_id": bare("warc-record-id"), "record_type": kind,
        "refers_to_record": bare("warc-refers-to"), "payload_digest": told, "payload_bytes": _length(http), "payload": bytes(body) if kind == "response" else None, "damage": None,
    }


def records_of(source, strict: bool = True) -> Iterator[dict]:
    """The page records of an open file, one after the other. A damaged record raises Damaged, or, if not strict, gives
    a row with its damage and nothing else; after broken compression nothing more of the file can be read."""
    for number, parts in enumerate(_members(source)):
        try:
            found = _record(parts)
            for _ in parts:  # to the member's end, whose checksum counts too
                pass
        except Damaged as e:
            if strict:
                raise Damaged(f"record {number}: {e}") from e
            yield dict.fromkeys(_RECORDS.names) | {"damage": f"record {number}: {e}"}
            if e.ended:
                return
        else:
            if found is not None:
                yield found


def _record_id(page_id: Column, digest: Column, kind: str) -> Column:
    """A name that follows from the page and its payload, so that a revisit can be written before its response."""
    h = F.md5(F.concat_ws(":", F.lit(kind), page_id.cast("string"), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes a record for each page to files under path, a shared folder; returns their manifest (path, records, bytes).

    Of pages with equal payloads of at least revisit_bytes bytes, those with the smallest page_id are responses, the
    others revisit that page. Smaller payloads are all responses. Groups are found by digest, from counts that tasks
    make of their own rows first; where few pages are repeated, their table is broadcast, so that payloads stay where
    they are. A task writes its own rows, under new names each time it is run.

    A null HTML is an empty payload. A row without page_id revisits an equal page that has one and is else a response;
    rows that repeat the smallest page_id are all responses. White space in an address is written as %20 and the like,
    a null address not at all. An empty table has no files; other columns are ignored.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    groups = rows.filter(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    repeated = written(groups.filter("n > 1 and first_id is not null").drop("n"), "warc-repeated")
    seen = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    digest = F.col("payload_digest")
    named = rows.join(few(repeated), "payload_digest", "left").select(
        "page_id", "url", F.when(~seen, F.col("html")).alias("html"), "payload_digest", "payload_bytes",
        F.when(seen, _record_id(F.col("page_id"), digest, "revisit")).otherwise(_record_id(F.col("page_id"), digest, "response")).alias("record_id"),
        F.when(seen, _record_id(F.col("first_id"), digest, "response")).alias("refers_to_record"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, name, n, size = None, [], "", 0, 0
        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    name, n, size = f"{path}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, at = fs.FileSystem.from_uri(name)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                    about = b"format: WARC File Format 1.1\r\n"
                    size += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Block-Digest", _digest(about)), ("Content-Type", "application/warc-fields")], about))
                size += out.write(_page({c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}, date))
                n += 1
                if size >= file_bytes:
                    out.close()
                    out, done = None, [*done, (name, n, size)]
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield from in_batches(iter(done), _MANIFEST)

    return written(named.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, strict: bool = True) -> DataFrame:
    """(page_id, url, record_id, record_type, refers_to_record, payload_digest, payload_bytes, payload, damage): the page
    records of the files in a manifest.

    One task reads one file from its first byte on, a step at a time: a gzip member is decompressed as it is read, the
    head ends at an empty line, the block after Content-Length bytes; the block's digest and, of a response, the
    payload's are verified. At most one record is held. payload is null for a revisit; the length is then what its HTTP
    head says. Damage raises an error, or is told in a row of its own where strict is false.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for name in b.column(0).to_pylist():
                    system, at = fs.FileSystem.from_uri(name)
                    with system.open_input_stream(at, compression=None) as source:
                        for r in records_of(source, strict):
                            yield tuple(r[c] for c in _RECORDS.names)

        yield from in_batches(rows(), _RECORDS)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in _RECORDS)
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """records with refers_to, the page_id of the response that a revisit names, and `found`: whether that response is
    there with the revisit's digest and length (null for a response).

    The names that revisits hold are made distinct first; the responses of those names are joined, broadcast where they
    are few enough.
    """
    spare = {c: fresh(records, f"_{c}") for c in ("name", "digest", "bytes")}
    names = records.filter("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id")).distinct()
    there = records.filter("record_type = 'response'").join(names, "record_id", "left_semi").groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("payload_digest").alias(spare["digest"]), F.first("payload_bytes").alias(spare["bytes"]))
    there = written(there.withColumnRenamed("record_id", spare["name"]), "warc-referred")
    same = (F.col("payload_digest") == F.col(spare["digest"])) & (F.col("payload_bytes") == F.col(spare["bytes"]))
    found = F.when(F.col("record_type") == "revisit", F.coalesce(same, F.lit(False)))
    return records.join(few(there), F.col("refers_to_record") == F.col(spare["name"]), "left").withColumn("found", found).drop(*spare.values())
