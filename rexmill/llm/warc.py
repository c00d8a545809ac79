"""WARC records in ZIP packages: writer, and a reader that never extracts.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip
member per record), ``indexes/index.cdxj`` (offset and length of every record)
and ``datapackage.json``. The reader parses the central directory, ZIP64 parts
included, locates the members and reads ranges of records. It takes packages of
other writers as well: any record ids and headers, records of other types beside
the pages (skipped), plain or gzipped archives and indexes, and archives without
an index, which are read as a stream.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_dir, slices, stash, to_batch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Stored bytes after which a task begins another package.
PACKAGE_BYTES = 16 << 20
#: Records of at least this many payload bytes are deduplicated (fixed by the contract).
MIN_REVISIT = 100
#: Stored bytes that one range holds, about, and that one read fetches.
RANGE_BYTES = 1 << 20
#: Types of records that are pages; others (warcinfo, request, metadata, ...) are skipped.
PAGES = ("response", "revisit", "resource")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def package(records: list[bytes], keys: list[dict]) -> bytes:
    """A ZIP package of gzipped records; keys are the index lines' other fields."""
    out, at, lines = io.BytesIO(), 0, []
    for r, k in zip(records, keys):
        lines.append(json.dumps(k | {"offset": at, "length": len(r), "filename": "data.warc.gz"}))
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA, b"".join(records)), (INDEX, "\n".join(lines).encode()), ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
    store, base = open_fs(folder)
    store.create_dir(base, recursive=True)
    ctx = TaskContext.get()
    part, held, keys, size, seq = ctx.partitionId() if ctx else 0, [], [], 0, 0

    def flush():
        nonlocal held, keys, size, seq
        data, name = package(held, keys), f"part-{part:06d}-{seq:05d}.wacz"
        temp = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as f:
            f.write(data)
        store.move(temp, f"{base}/{name}")  # a task that runs again replaces its file by an equal one
        row = to_batch(schema, [f"{folder}/{name}"], [len(held)], [len(data)])
        held, keys, size, seq = [], [], 0, seq + 1
        return row

    for batch in slices(batches, "html", 4 << 20):
        for r in batch.to_pylist():
            rec = _gzip(record_bytes(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["n"], r["kind"], r["refers_to"]))
            held.append(rec)
            keys.append({"page": r["page_id"], "digest": r["digest"]})
            size += len(rec)
            if size >= PACKAGE_BYTES:
                yield flush()
    if held:
        yield flush()


def write_packages(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) and return the packages' paths.

    Of rows with equal payloads of at least ``min_revisit`` bytes, those with the
    smallest page_id are responses and the others revisits (a null id counts as
    larger; rows that tie at the smallest id are all responses). A null html is an
    empty payload. The table of paths is written to the shared folder.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    given = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    first = given.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = given.join(first, "digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    rows = rows.select("page_id", "url", F.when(again, "").otherwise(F.col("html")).alias("html"), "digest", "n", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))
    return stash(rows.mapInArrow(functools.partial(_write, folder), "path string, n_records long, n_bytes long"), "warc-packages")


def central_directory(f: pa.NativeFile, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, stored size, size, offset of the local header) of every member."""
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        where = tail_at + end - 20
        locator = f.read_at(20, where) if where >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            record = f.read_at(56, struct.unpack("<Q", locator[8:16])[0])
            if record[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end of central directory")
            count, length, at = struct.unpack("<QQQ", record[32:56])
    data, out, p = f.read_at(length, at), [], 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", data[p + 8 : p + 12])
        stored, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[p + 20 : p + 34])
        offset = struct.unpack("<I", data[p + 42 : p + 46])[0]
        name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[e : e + 4])
            if tag == 1:  # 64-bit values of the fields that are full, in this order
                wide, q = extra[e + 4 : e + 4 + n], 0
                if plain == 0xFFFFFFFF:
                    plain, q = struct.unpack("<Q", wide[q : q + 8])[0], q + 8
                if stored == 0xFFFFFFFF:
                    stored, q = struct.unpack("<Q", wide[q : q + 8])[0], q + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack("<Q", wide[q : q + 8])[0]
            e += 4 + n
        out.append((name, method, stored, plain, offset))
        p += 46 + n_name + n_extra + n_comment
    return out


def data_offset(f: pa.NativeFile, header_at: int) -> int:
    head = f.read_at(30, header_at)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return header_at + 30 + sum(struct.unpack("<HH", head[26:30]))


def _inflated(chunks: Iterator[bytes], wbits: int) -> Iterator[bytes]:
    """The content of one deflated stream (wbits < 0) or of gzip members one after the other."""
    z, rest = zlib.decompressobj(wbits), b""
    for chunk in chunks:
        rest = chunk
        while rest:
            got = z.decompress(rest, 4 << 20)
            if got:
                yield got
            rest = z.unconsumed_tail
            if z.eof:
                rest = z.unused_data
                if wbits < 0:
                    return
                z = zlib.decompressobj(wbits)
    if (tail := z.flush()) or (wbits < 0 and not z.eof):
        if not tail:
            raise ValueError("an archive ends in the middle of a member")
        yield tail


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks of a gzip file's content, or the chunks as they are."""
    first = b""
    while len(first) < 2 and (got := next(chunks, None)) is not None:
        first += got
    whole = (c for part in ((first,), chunks) for c in part)
    return _inflated(whole, 31) if first[:2] == b"\x1f\x8b" else whole


def _chunks(f: pa.NativeFile, at: int, size: int, method: int = 0) -> Iterator[bytes]:
    """A member's (or range's) bytes in reads of RANGE_BYTES, inflated if its method says so."""
    raw = (f.read_at(min(RANGE_BYTES, at + size - p), p) for p in range(at, at + size, RANGE_BYTES))
    return _inflated(raw, -15) if method == 8 else raw


def _index_lines(f: pa.NativeFile, at: int, size: int, method: int) -> Iterator[str]:
    rest = b""
    for chunk in _unpacked(_chunks(f, at, size, method)):
        *lines, rest = (rest + chunk).split(b"\n")
        yield from (line.decode("utf-8", "replace") for line in lines)
    yield rest.decode("utf-8", "replace")


def record_ranges(f: pa.NativeFile, size: int, most: int = RANGE_BYTES) -> list[tuple[int, int, int]]:
    """(offset, size, method) of byte ranges of the package that hold whole records, of about ``most`` bytes.

    Stored archives with an index are cut by it; without one, or deflated, an
    archive is one range, which is read as a stream.
    """
    members = {m[0]: m for m in central_directory(f, size)}
    listed: dict[str, list[tuple[int, int]]] = {}
    for name, method, stored, _, at in members.values():
        if name.startswith("indexes/") and name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            for line in _index_lines(f, data_offset(f, at), stored, method):
                if "{" in line:
                    k = json.loads(line[line.index("{") :])
                    if {"filename", "offset", "length"} <= k.keys():
                        listed.setdefault(f"archive/{k['filename'].rpartition('/')[2]}", []).append((int(k["offset"]), int(k["length"])))
    out = []
    for name, method, stored, _, at in members.values():
        if not name.startswith("archive/") or name.endswith("/"):
            continue
        if method not in (0, 8):
            raise ValueError(f"{name} is compressed by method {method}")
        base = data_offset(f, at)
        if method or name not in listed:
            out.append((base, stored, method))
            continue
        lo = hi = None
        for o, n in sorted(set(listed[name])):
            if lo is not None and (o != hi or hi - lo + n > most):
                out.append((base + lo, hi - lo, 0))
                lo = None
            lo, hi = (o if lo is None else lo), o + n
        if lo is not None:
            out.append((base + lo, hi - lo, 0))
    return [r for r in out if r[1] > 0]


def headers(head: bytes) -> dict[str, str]:
    """Names in lower case and values; folded lines are joined, lines without a colon ignored."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name is not None:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive that comes in chunks, gzipped or plain; one record is held at a time."""
    buffer, source = bytearray(), _unpacked(iter(chunks))

    def more() -> bool:
        got = next(source, None)
        if got is not None:
            buffer.extend(got)
        return got is not None

    while True:
        skip = seen = 0
        while True:
            while skip < len(buffer) and buffer[skip] in b"\r\n":
                skip += 1
            if skip < len(buffer) or not more():
                break
        if skip == len(buffer):
            return
        del buffer[:skip]
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not more():
                raise ValueError("broken record")
        fields = headers(bytes(buffer[:end]).partition(b"\r\n")[2])
        n = int(fields.get("content-length", 0))
        while len(buffer) < end + 4 + n:
            if not more():
                raise ValueError("broken record")
        yield fields, bytes(buffer[end + 4 : end + 4 + n])
        del buffer[: end + 4 + n]


def _page(value: str | None) -> int | None:
    """The page_id of a record id that this module wrote, else null."""
    text = (value or "").strip("<>").removeprefix("urn:page:")
    return int(text) if text.removeprefix("-").isdecimal() else None


def _dechunked(payload: bytes) -> bytes:
    """The content of a chunked transfer; what isn't one stays as it is."""
    out, p = [], 0
    while True:
        line, sep, _ = payload[p : p + 80].partition(b"\r\n")
        try:
            n = int(line.partition(b";")[0], 16)
        except ValueError:
            return payload
        p += len(line) + 2
        if not sep or p + n > len(payload):
            return payload
        if not n:
            return b"".join(out)
        out.append(payload[p : p + n])
        p += n + 2


def _matches(declared: str, payload: bytes) -> bool:
    """Does a declared digest (name:value, hex or base 32) hold? Unknown names count as true."""
    name, _, value = declared.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(name, payload)
    return value.lower() == digest.hexdigest() or value.upper().rstrip("=") == base64.b32encode(digest.digest()).decode().rstrip("=")


def page_of(head: dict[str, str], block: bytes) -> tuple | None:
    """The row of a record that is a page, else None."""
    kind = head.get("warc-type", "").lower()
    if kind not in PAGES:
        return None
    http, payload = b"", block
    if kind == "revisit" or block[:5] == b"HTTP/":
        http, _, payload = block.partition(b"\r\n\r\n")
    fields, declared, record = headers(http.partition(b"\n")[2]), head.get("warc-payload-digest"), head.get("warc-record-id")
    if kind == "revisit":
        size = fields.get("content-length", "")
        n, digest, payload = int(size) if size.isdecimal() else None, (declared or "").removeprefix("sha256:") or None, None
    else:
        plain = _dechunked(payload) if fields.get("transfer-encoding", "").lower() == "chunked" else payload
        if declared and not _matches(declared, payload) and not _matches(declared, plain):
            raise ValueError(f"damaged record {record}")
        payload, n, digest = plain, len(plain), hashlib.sha256(plain).hexdigest()
    refers = head.get("warc-refers-to")
    return _page(record), head.get("warc-target-uri"), n, digest, kind, _page(refers), payload, record, refers


def _list(batches):
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("method", pa.int32())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name = open_fs(path)
            with store.open_input_file(name) as f:
                ranges = record_ranges(f, f.size())
            if ranges:
                yield to_batch(schema, [path] * len(ranges), *map(list, zip(*ranges)))


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])
    for batch in batches:
        for path, at, size, method in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size", "method"))):
            store, name = open_fs(path)
            rows, held = [], 0
            with store.open_input_file(name) as f:
                for head, block in parse_records(_chunks(f, at, size, method)):
                    row = page_of(head, block)
                    if row is None:
                        continue
                    rows.append(row)
                    held += len(block)
                    if held >= 4 * RANGE_BYTES:
                        yield to_batch(schema, *map(list, zip(*rows)))
                        rows, held = [], 0
            if rows:
                yield to_batch(schema, *map(list, zip(*rows)))


def read_packages(packages: DataFrame) -> DataFrame:
    """Every page of the packages at ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, record_id, refers_to_id.

    Directories and indexes are read first, then ranges of records, dealt out
    evenly; a range is read in pieces, and one record is held at a time. The
    payload of a response or resource is what HTTP carries (chunks are joined),
    its digest the SHA-256; a declared digest that doesn't hold is an error. A
    revisit has a null payload, the size its HTTP header tells and the digest
    it declares. page_id and refers_to are null for ids of other writers. An
    empty table of packages gives no rows.
    """
    ranges = packages.select("path").mapInArrow(_list, "path string, at long, size long, method int")
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a set number isn't coalesced by bytes
    return ranges.repartition(tasks, "path", "at").mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string")
