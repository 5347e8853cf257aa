"""Web archives in ZIP packages: records are written once per payload and read back by ranges.

A package is a ZIP file whose members are stored, never deflated: ``archive/data-0000.warc.gz`` and so on, in which
every record is a gzip member of its own, and ``indexes/index.cdxj`` with one line per record (key, date, JSON with
member, offset and length).  So every record lies at a known range of the package, and the reader extracts nothing:

1. the tail of each package, its ZIP64 records if any and its central directory give the members;
2. plain index members are read in blocks of lines, compressed ones whole; archive members that stand in a package
   without an index are walked record by record;
3. the ranges are dealt over the cluster by place, neighbours are read at once, and each record is unpacked alone.

Tasks write packages under names of their own and return the names; only named packages are read, so what a lost or
repeated attempt left behind is never seen.

Odd inputs: a null payload is an empty one; a null url is left out of the record and comes back null; control
characters, spaces and non-characters of a url are percent-encoded.  Payloads of equal bytes and at least
``dedupe_from`` bytes are stored once, with the largest id; rows that share the largest id are all stored, rows without
an id come before every other and are stored if the whole group has none.  An empty table gives no package and no
record.  Other columns are ignored.  A package that breaks off, or a payload that does not fit its digest, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.llm import zipread
from marklens.llm.tables import materialise, parallel, small_batches
from marklens.operators.order import lookup
from marklens.session import scratch_dir

#: Bytes after which a task starts the next archive member, and the next package.
MEMBER_BYTES = 8 << 20
PACKAGE_BYTES = 64 << 20
#: Bytes of an index that one task reads, bytes that one task reads of archives, and of one range request.
INDEX_BLOCK = 8 << 20
TASK_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Neighbouring ranges are read together when no more than this lies between them.
GAP = 64 << 10
#: Bytes of payload in one Arrow batch.
BATCH_BYTES = 8 << 20

ID_PREFIX = "urn:page:"
_ROOT, _ARCHIVE = "indexes/", "archive/"


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system that a task reaches the path by."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _clean(url: str) -> str:
    return re.sub("[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url)


def sort_key(url: str) -> str:
    """Host labels from the last to the first, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    return f"{','.join(reversed(host.split('.')))}){parts.path}{'?' + parts.query if parts.query else ''}" if host else url


# ---- writing --------------------------------------------------------------------------------------------------------


def _headers(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, record_id: str, url: str | None, date: str, block: bytes, more: list[tuple[str, str | None]] = ()) -> bytes:
    """One WARC record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url), *more, ("Content-Length", str(len(block)))]
    return _gzip(_headers("WARC/1.1", head) + block + b"\r\n\r\n")


class _Package:
    def __init__(self, folder: str, date: str, zip64: bool, member_bytes: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, path = _open(self.path)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.date, self.zip64, self.member_bytes = date, zip64, member_bytes
        self.lines, self.member, self.members, self.bytes = [], bytearray(), 0, 0

    def _store(self, name: str, data: bytes) -> None:
        with self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64) as out:
            out.write(data)
        self.bytes += len(data)

    def name(self) -> str:
        return f"data-{self.members:04d}.warc.gz"

    def add(self, url: str | None, kind: str, digest: str, packed: bytes) -> None:
        if not self.member:
            self.member += record("warcinfo", f"urn:uuid:{uuid.uuid4()}", None, self.date, b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])
        told = {"url": url, "digest": digest, "record": kind, "filename": self.name(), "offset": str(len(self.member)), "length": str(len(packed))}
        self.lines.append(f"{sort_key(url or '-')} {re.sub('[^0-9]', '', self.date)} {json.dumps(told)}\n")
        self.member += packed
        if len(self.member) >= self.member_bytes:
            self.flush()

    def flush(self) -> None:
        if self.member:
            self._store(_ARCHIVE + self.name(), bytes(self.member))
            self.member, self.members = bytearray(), self.members + 1

    def close(self, index: bool) -> tuple[str, int, int]:
        self.flush()
        if index:
            self._store(_ROOT + "index.cdxj", "".join(sorted(self.lines)).encode())
        self._store("datapackage.json", json.dumps({"profile": "data-package", "resources": []}).encode())
        self.zip.close()
        self.sink.close()
        return self.path, self.bytes, len(self.lines)


def _write(folder: str, date: str, zip64: bool, index: bool, member_bytes: int, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, keeper, keeper_url = (batch.column(k)[row].as_py() for k in range(6))
                package = package or _Package(folder, date, zip64, member_bytes)
                url = None if url is None else _clean(url)
                kind = "response" if keeper is None else "revisit"
                coded = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                block = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
                more = [("WARC-Payload-Digest", coded), ("Content-Type", "application/http; msgtype=response")]
                if kind == "revisit":
                    more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{ID_PREFIX}{keeper}>")]
                    more += [("WARC-Refers-To-Target-URI", None if keeper_url is None else _clean(keeper_url)), ("WARC-Refers-To-Date", date)]
                else:
                    block += payload
                package.add(url, kind, coded, record(kind, f"{ID_PREFIX}{'' if page is None else page}", url, date, block, more))
                if package.bytes >= package_bytes:
                    done.append(package.close(index))
                    package = None
        if package:
            done.append(package.close(index))
        path, size, n = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["package", "bytes", "records"])

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedupe_from: int = 1000,
          date: str = "2024-01-01T00:00:00Z", zip64: bool = False, index: bool = True) -> DataFrame:
    """Write one record per row into packages below ``folder``; returns the written list (package, bytes, records).

    ``zip64`` writes ZIP64 fields even where sizes do not ask for them.  Equal payloads meet by length and SHA-1; a
    payload shared by a third of all rows is one row of the looked-up table.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("link"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= dedupe_from)
    copies = large.groupBy("digest").agg(F.max(F.struct("page", "link")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first.page is not null")
    copies = materialise(copies.select("digest", F.col("first.page").alias("keeper"), F.col("first.link").alias("keeper_link")), "copies")
    rows = lookup(rows, copies, "digest", ["page", "link"])
    again = F.col("keeper").isNotNull() & (F.col("page").isNull() | (F.col("page") < F.col("keeper")))
    told = rows.select("page", "link", "payload", "digest", F.when(again, F.col("keeper")), F.when(again, F.col("keeper_link")))
    return materialise(told.mapInArrow(_write(folder, date, zip64, index, MEMBER_BYTES, PACKAGE_BYTES), "package string, bytes long, records long"), "packages")


# ---- reading --------------------------------------------------------------------------------------------------------

_MEMBER = "package string, member string, method int, packed long, size long, start long"
_PLACE = "package string, member string, offset long, length long"


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rows_out(schema: str, rows: Iterator[tuple], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield _batch(schema, [list(c) for c in zip(*held)])
            held = []
    if held:
        yield _batch(schema, [list(c) for c in zip(*held)])


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for r in _records_of(batches):
            files, path = _open(r["package"])
            with files.open_input_file(path) as f:
                for m in zipread.members(f, f.size()):
                    if m.name.startswith((_ARCHIVE, _ROOT)) and not m.name.endswith("/"):
                        yield r["package"], m.name, m.method, m.packed, m.size, zipread.data_start(f, m)

    yield from _rows_out(_MEMBER, rows())


def _lines(r: dict) -> Iterator[bytes]:
    """Lines of an index that start in the given block; a line belongs to the block of its first byte."""
    files, path = _open(r["package"])
    with files.open_input_file(path) as f:
        if r["method"] == 8 or r["member"].endswith(".gz"):
            inner = zlib.decompressobj(-15) if r["method"] == 8 else None
            outer = zlib.decompressobj(31) if r["member"].endswith(".gz") else None
            f.seek(r["start"])
            left, held = r["packed"], b""
            while left:
                data = bytes(f.read(min(left, RANGE_BYTES)))
                if not data:
                    raise ValueError(f"{r['package']} breaks off in {r['member']}")
                left -= len(data)
                data = inner.decompress(data) if inner else data
                text = b""
                while outer and data:
                    text += outer.decompress(data)
                    data = outer.unused_data
                    outer = zlib.decompressobj(31) if outer.eof else outer
                *whole, held = (held + (text if r["member"].endswith(".gz") else data)).split(b"\n")
                yield from whole
            yield held
            return
        at, end, stop = r["start"] + r["block"], r["start"] + r["packed"], r["start"] + min(r["packed"], r["block"] + r["span"])
        skip = r["block"] > 0
        f.seek(at - skip)
        at -= skip
        held = b""
        while at < end:
            data = bytes(f.read(min(end - at, RANGE_BYTES)))
            if not data:
                raise ValueError(f"{r['package']} breaks off in {r['member']}")
            first = at - len(held)
            at += len(data)
            *whole, held = (held + data).split(b"\n")
            for line in whole:
                if first >= stop:
                    return
                if not skip:
                    yield line
                skip = False
                first += len(line) + 1
            if first >= stop:
                return
        if held and not skip:
            yield held


def _read_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for r in _records_of(batches):
            for line in _lines(r):
                at = line.find(b"{")
                if at > 0:
                    told = json.loads(line[at:])
                    yield r["package"], _ARCHIVE + told["filename"], int(told["offset"]), int(told["length"])

    yield from _rows_out(_PLACE, rows())


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the records of archive members that no index tells."""

    def rows():
        for r in _records_of(batches):
            files, path = _open(r["package"])
            with files.open_input_file(path) as f:
                at = 0
                while at < r["packed"]:
                    length = _length(f, r["start"] + at, r["packed"] - at)
                    yield r["package"], r["member"], at, length
                    at += length

    yield from _rows_out(_PLACE, rows())


def _length(f, start: int, most: int) -> int:
    """Bytes of the record at ``start``: of its gzip member, or of headers, block and end of a plain one."""
    f.seek(start)
    if bytes(f.read(2)) == b"\x1f\x8b":
        z, read = zlib.decompressobj(31), 0
        f.seek(start)
        while not z.eof:
            data = bytes(f.read(min(RANGE_BYTES, most - read)))
            if not data:
                raise ValueError("archive breaks off inside a record")
            read += len(data)
            rest = data
            while rest and not z.eof:
                z.decompress(rest, RANGE_BYTES)
                rest = z.unconsumed_tail
        return read - len(z.unused_data)
    f.seek(start)
    head = b""
    while b"\r\n\r\n" not in head:
        data = bytes(f.read(min(8192, most - len(head))))
        if not data:
            raise ValueError("archive breaks off inside a record")
        head += data
    head = head.partition(b"\r\n\r\n")[0]
    return len(head) + 4 + int(_fields(head)[1]["content-length"]) + 4


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (x.partition(":") for x in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(raw: bytes) -> dict | None:
    """The parts of one record; None for records that are neither a response nor a revisit."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, warc = _fields(head)
    if not mark or not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    if warc["warc-type"] not in ("response", "revisit"):
        return None
    size = int(warc["content-length"])
    if len(rest) < size:
        raise ValueError(f"record {warc['warc-record-id']} breaks off")
    block = rest[:size]
    body = block.partition(b"\r\n\r\n")[2] if "application/http" in warc.get("content-type", "") else block
    digest = warc.get("warc-payload-digest", "")
    told = base64.b32decode(digest[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", digest) else digest.removeprefix("sha1:").lower() or None
    out = {"id": warc["warc-record-id"].strip("<>"), "kind": warc["warc-type"], "url": warc.get("warc-target-uri"), "date": warc["warc-date"], "refers_to": warc.get("warc-refers-to", "").strip("<>") or None, "digest": told, "payload": None}
    if out["kind"] == "response":
        sha1 = hashlib.sha1(body).hexdigest()
        if told and len(told) == 40 and told != sha1:
            raise ValueError(f"payload of {out['id']} does not fit its digest")
        out |= {"payload": body, "digest": sha1}
    return out


_RECORD = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, package string, member string, offset long, length long"


def _read(payload: bool):
    def ranges(batches):
        """Neighbouring places of one package, up to RANGE_BYTES or one record."""
        run, end = [], 0
        for r in _records_of(batches):
            if run and (r["package"] != run[0]["package"] or r["at"] < run[-1]["at"] or r["at"] > end + GAP or max(end, r["at"] + r["length"]) - run[0]["at"] > RANGE_BYTES):
                yield run, end
                run, end = [], 0
            run.append(r)
            end = max(end, r["at"] + r["length"])
        if run:
            yield run, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name, file = [], 0, None, None
        try:
            for places, end in ranges(batches):
                if places[0]["package"] != name:
                    if file:
                        file.close()
                    name = places[0]["package"]
                    files, path = _open(name)
                    file = files.open_input_file(path)
                start = places[0]["at"]
                file.seek(start)
                data = bytes(file.read(end - start))
                if len(data) < end - start:
                    raise ValueError(f"{name} breaks off at {start + len(data)}")
                for r in places:
                    got = parse(data[r["at"] - start : r["at"] - start + r["length"]])
                    if got is None:
                        continue
                    body = got["payload"]
                    held.append((got["id"], got["kind"], got["url"], got["date"], got["refers_to"], got["digest"], None if body is None else len(body), body if payload else None, r["package"], r["member"], r["offset"], r["length"]))
                    size += 500 + (len(body) if payload and body else 0)
                    if size >= BATCH_BYTES:
                        yield _batch(_RECORD, [list(c) for c in zip(*held)])
                        held, size = [], 0
        finally:
            if file:
                file.close()
        if held:
            yield _batch(_RECORD, [list(c) for c in zip(*held)])

    return run


def members(packages: DataFrame) -> DataFrame:
    """Archive and index members of every package in column ``package``: method, sizes and where their bytes start."""
    spark = packages.sparkSession
    listed = packages.select("package").repartition(parallel(spark), "package")
    return materialise(listed.mapInArrow(_list_members, _MEMBER), "members")


def places(found: DataFrame) -> DataFrame:
    """Package, member, offset and length of every record, from the indexes or, where a package has none, by walking."""
    archives = found.where(F.col("member").startswith(_ARCHIVE))
    indexes = found.where(F.col("member").startswith(_ROOT) & F.col("member").rlike(r"\.cdxj?(\.gz)?$"))
    whole = (F.col("method") == 8) | F.col("member").endswith(".gz")
    last = F.when(whole | (F.col("packed") == 0), F.lit(0).cast("long")).otherwise(F.floor((F.col("packed") - 1) / INDEX_BLOCK) * INDEX_BLOCK)
    blocks = indexes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(INDEX_BLOCK).cast("long")))).withColumn("span", F.lit(INDEX_BLOCK).cast("long"))
    told = blocks.repartition(parallel(found.sparkSession), "package", "block").mapInArrow(_read_index, _PLACE)
    bare = archives.join(indexes.select("package").distinct(), "package", "left_anti").where("packed > 0")
    return told.union(bare.repartition(parallel(found.sparkSession), "package", "member").mapInArrow(_walk, _PLACE))


def records(packages: DataFrame, payload: bool = True) -> DataFrame:
    """Every response and revisit of the packages named in column ``package``.

    Columns: record_id, record_type, target_uri, date, refers_to (a record id), payload_digest (lower-case hex; of the
    payload itself where it is stored), payload_bytes and payload (null for revisits; payload also without
    ``payload``), package, member, offset, length.  Only stored archive members can be read by ranges; a deflated one
    is an error.
    """
    spark = packages.sparkSession
    small_batches(spark)
    found = members(packages)
    archives = found.where(F.col("member").startswith(_ARCHIVE))
    if archives.where("method <> 0").limit(1).count():
        raise ValueError("an archive member is deflated; only stored ones can be read by ranges")
    key = F.concat_ws("!", "package", "member").alias("key")
    placed = lookup(places(found).select("*", key), archives.select(key, "start"), "key", ["offset"])
    placed = materialise(placed.select("package", "member", "offset", "length", (F.col("start") + F.col("offset")).alias("at")), "places")
    bytes_, lost = placed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("at").isNull())).first()
    if lost:
        raise ValueError(f"{lost} index lines name an archive member that the package does not have")
    tasks = max(parallel(spark), -(-int(bytes_) // TASK_BYTES))
    dealt = placed.repartitionByRange(tasks, "package", "at").sortWithinPartitions("package", "at")
    return dealt.mapInArrow(_read(payload), _RECORD)


def page_table(found: DataFrame) -> DataFrame:
    """Per page: id, size and SHA-1 of the full payload, record type and the page a revisit refers to.

    A revisit's size is that of the stored payload it refers to, found by that record's id and the digest.
    """
    number = lambda c: F.when(F.col(c) != ID_PREFIX, F.expr(f"cast(substring({c}, {len(ID_PREFIX) + 1}) as bigint)"))
    rows = found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
    rows = materialise(rows, "pages")
    again, stored = rows.where("record_type = 'revisit'"), rows.where("record_type = 'response'")
    wanted = again.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    target = F.concat_ws(":", "page_id", "payload_digest").alias("target")
    sizes = stored.join(wanted, ["page_id", "payload_digest"], "left_semi").groupBy(target).agg(F.max("payload_bytes").alias("full"))
    resolved = lookup(again.withColumn("target", F.concat_ws(":", "refers_to", "payload_digest")), materialise(sizes, "targets"), "target", ["page_id"])
    return stored.unionByName(resolved.withColumn("payload_bytes", F.col("full")).select(stored.columns))


def archive_pages(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` into packages below the session's shared folder and return the page table read back from them."""
    packages = write(pages, f"{scratch_dir(spark)}/marklens-archive-{uuid.uuid4().hex}", **options)
    return page_table(records(packages, payload=False))
