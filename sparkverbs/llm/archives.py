"""WARC records in ZIP packages: writer, and a reader that range-reads records without extracting the packages.

A package holds WARC files as stored members below ``archive/`` and one index for each below ``indexes/``. A WARC file is a
row of gzip members, one for each record, and an index line tells where a record starts and how long it is. The reader
takes the end record of a package (the ZIP64 one where there is one), the central directory, and the local header of each
member it needs, all by range reads; then the index; then only the bytes of records. Index lines are put together into
stretches of about ``STRETCH`` bytes, which Spark deals out, so a large package is read by many tasks.

Of equal payloads of at least ``LEAST`` bytes the one with the largest id is kept as a response; the others become revisits
that name it and carry no payload. Equality is equality of SHA-1 and length.

Nulls: a null payload is empty; a null id or url is written as an empty header and read as null. Empty payloads are
responses. Rows repeated in full with the largest id are all responses, because a revisit of the same id would say nothing.
Empty tables give no rows and no package. Further columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored

LEAST = 1000
#: Bytes of archive in one package, and of records that a task reads in one stretch.
PACKAGE = 64 << 20
STRETCH = 4 << 20

END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def file_system(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


# ------------------------------------------------------------------ writing

def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Target-URI", "" if url is None else "".join(url.split("\r\n")).replace("\n", "")), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Package:
    """A package while it is written: the archive goes to the file as it comes, the index follows at the end."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.index, self.at = [], 0

    def add(self, data: bytes) -> None:
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        got = packed.compress(data) + packed.flush()
        self.member.write(got)
        self.index.append(f"{self.at} {len(got)}\n")
        self.at += len(got)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr("indexes/data.cdx", "".join(self.index))
        self.zip.writestr("datapackage.json", '{"profile": "data-package", "wacz_version": "1.1.1"}')
        self.zip.close()
        self.sink.close()


def decided(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) for every row. Counts are taken on digests; only those that occur twice
    meet the pages again."""
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("url"),
                        F.encode(F.coalesce(pages[payload], F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    twice = rows.where(F.col("n") >= LEAST).groupBy("digest", "n").agg(
        F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("c")).where("c > 1")
    twice = stored(twice.select(F.col("digest").alias("__d"), F.col("n").alias("__n"), "kept"), "twice")
    joined = rows.join(twice, (F.col("digest") == F.col("__d")) & (F.col("n") == F.col("__n")), "left")
    return joined.select("page_id", "url", "payload", "digest",
                         F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write packages below ``folder``; (path, size) of those that count. A task that runs twice leaves a package that no
    row names, so readers go by the rows."""

    def run(batches):
        fs, root = file_system(folder)
        package, name = None, ""
        for batch in batches:
            for page, link, data, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if package is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.wacz"
                    package = Package(fs, f"{root}/{name}")
                package.add(record(page, link, data, digest, refers))
                if package.at >= PACKAGE:
                    package.close()
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}"}])
                    package = None
        if package is not None:
            package.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}"}])

    return stored(decided(pages, key, url, payload).mapInArrow(run, "path string"), "packages")


# ------------------------------------------------------------------ reading

def read_range(source, at: int, size: int) -> bytes:
    source.seek(at)
    return source.read(size)


def central_directory(source, size: int) -> tuple[int, int, int]:
    """Where the central directory of a package lies, its bytes and its number of entries."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = read_range(source, tail_at, size - tail_at)
    k = tail.rfind(END)
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):  # a comment may hold the mark
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no end of a central directory")
    entries, length, at = struct.unpack_from("<HII", tail, k + 10)
    if k >= 20 and tail[k - 20:k - 16] == LOCATOR64 and (entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF):
        where = struct.unpack_from("<Q", tail, k - 12)[0]
        head = read_range(source, where, 56)
        if head[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        entries, length, at = struct.unpack_from("<QQQ", head, 32)
    return at, length, entries


def members(source, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, start of the data, stored bytes) of every member."""
    at, length, entries = central_directory(source, size)
    directory, k = read_range(source, at, length), 0
    for _ in range(entries):
        if directory[k:k + 4] != ENTRY:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, k + 10)[0]
        packed, plain = struct.unpack_from("<II", directory, k + 20)
        names, extras, comments = struct.unpack_from("<HHH", directory, k + 28)
        local = struct.unpack_from("<I", directory, k + 42)[0]
        name = directory[k + 46:k + 46 + names].decode("utf-8", "replace")
        extra, e = directory[k + 46 + names:k + 46 + names + extras], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # only the fields that overflow, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            e += 4 + n
        head = read_range(source, local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        yield name, method, local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed
        k += 46 + names + extras + comments


def stretches(source, size: int) -> Iterator[tuple[int, int]]:
    """(start, bytes) of runs of whole records in a package."""
    found = list(members(source, size))
    for name, method, start, length in found:
        if not name.startswith("archive/"):
            continue
        if method:
            raise ValueError(f"{name} is compressed as a member; records can't be range-read")
        index = [m for m in found if m[0] == "indexes/" + name[8:].split(".")[0] + ".cdx"]
        if not index:
            yield start, length
            continue
        lines = read_range(source, index[0][2], index[0][3])
        if index[0][1]:
            lines = zlib.decompress(lines, -15)
        begin = upto = 0
        for line in lines.splitlines():
            at, n = map(int, line.split()[:2])
            if upto > begin and at + n - begin > STRETCH:
                yield start + begin, upto - begin
                begin = at
            upto = at + n
        if upto > begin:
            yield start + begin, upto - begin


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records in a row of gzip members."""
    while data:
        member = zlib.decompressobj(31)
        got = member.decompress(data) + member.flush()
        data = member.unused_data
        head, _, rest = got.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def _id(urn: str | None) -> str | None:
    return None if urn is None or urn == "<urn:page:>" else urn[len("<urn:page:"):-1]


def read(packages: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload) of every record; ids as text, digest as hex, the
    payload of a revisit null."""

    def locate(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_file(at) as source:
                    rows = [{"path": path, "start": a, "size": n} for a, n in stretches(source, source.size())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    def fetch(batches):
        for batch in batches:
            for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size"))):
                fs, at = file_system(path)
                with fs.open_input_file(at) as source:
                    data = read_range(source, start, size)
                rows = []
                for head, block in records(data):
                    digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                    kind = head["WARC-Type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {head['WARC-Record-ID']} in {path} doesn't match its payload")
                    rows.append({"page_id": _id(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"] or None, "record_type": kind,
                                 "refers_to": _id(head.get("WARC-Refers-To")), "payload_digest": digest, "payload": payload})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(c, pa.string()) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest")] + [("payload", pa.binary())])
    spark = packages.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = packages.repartition(spread).mapInArrow(locate, "path string, start bigint, size bigint").repartition(spread)
    return found.mapInArrow(fetch, "page_id string, url string, record_type string, refers_to string, payload_digest string, payload binary")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    The size of a revisit's payload is that of the response that it names, whose digest must agree.
    """
    spark = pages.sparkSession
    packages = write(pages, scratch_path(spark, "llm-wacz"), key, url, payload)
    kind = pages.schema[key].dataType.simpleString()
    rows = stored(read(packages).select(
        F.col("page_id").cast(kind).alias(key), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to")), "records")
    kept = rows.where("record_type = 'response'").join(
        rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("__r")).distinct(), F.col(key) == F.col("__r"), "left_semi")
    kept = kept.groupBy(F.col(key).alias("__id"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes").join(
        kept, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    columns = [key, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*columns).unionByName(
        revisits.withColumnRenamed("__bytes", "payload_bytes").select(*columns))


SQL = f"""
with p as (select page_id, coalesce(html, '') as t, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as d from pages),
k as (select *, max(page_id) over (partition by d, n) as kept from p)
select page_id, n as payload_bytes, d as payload_digest,
        case when n >= {LEAST} and page_id is distinct from kept then 'revisit' else 'response' end as record_type,
        case when n >= {LEAST} and page_id is distinct from kept then kept end as refers_to
from k
"""
