"""WARC archives of pages: a deterministic sharded writer and a reader.

Method: records are range-sorted by id over splitters that don't depend on how the rows are dealt; a shard's
records roll into files by compressed size; headers, digests and record ids are made anew from the content alone. Files
are written under temporary names, which a stored list of the tasks that succeeded renames; a manifest, written last,
says what belongs to the archive.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.plans.durable import durable, evenly

#: Compressed bytes at which a file ends; shards at most; sampled ids for each, which the driver sorts.
ROLL, SHARDS, SAMPLED = 256 * 2**20, 4096, 8
#: Payload bytes of a shard on average.
SHARD_BYTES = 2**30
LEVEL = 6
#: Pages have no time of capture of their own: all records carry this one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, key: bytes, copy: int) -> str:
    """A record id from what the record holds: the page's id, its payload's SHA-256, and which of its equal rows it is."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{key.hex()}|{copy}'.encode()).digest()[:16], version=4)}>"


def uri_of(url: str | None, page_id: int | None) -> str:
    """A target URI that can't end its header: blanks and control characters are percent-encoded; null gives a URN."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member without a time or name, so equal data give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def http_head(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def _common(kind: str, urn: str, page_id: int | None, url: str | None, digest: str) -> list[tuple[str, str]]:
    own = [("X-Page-Id", str(page_id))] if page_id is not None else []
    return [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", DATE), ("WARC-Target-URI", uri_of(url, page_id)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), *own]


def response(page_id: int | None, url: str | None, key: bytes, payload: bytes, copy: int = 0) -> bytes:
    return record(_common("response", record_urn(page_id, key, copy), page_id, url, sha1_base32(payload)), http_head(len(payload)) + payload)


def revisit(page_id: int | None, url: str | None, key: bytes, digest: str, n_bytes: int, copy: int, first_id: int | None, first_url: str | None) -> bytes:
    """A record without a payload that names the response with an equal one; its HTTP header keeps the payload's length."""
    refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(first_id, key, 0)), ("WARC-Refers-To-Target-URI", uri_of(first_url, first_id)), ("WARC-Refers-To-Date", DATE)]
    refers += [("X-Refers-To-Page-Id", str(first_id))] if first_id is not None else []
    return record(_common("revisit", record_urn(page_id, key, copy), page_id, url, digest) + refers, http_head(n_bytes))


def warcinfo(name: str) -> bytes:
    urn = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4)}>"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: loamgrid\r\nformat: WARC File Format 1.1\r\n")


def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder, and the folder in it: a URI of any kind pyarrow knows, or a path."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", folder))


# --- writing -----------------------------------------------------------------------------------------------------------


def _made(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Each page's payload as the gzip member of its response record, so only compressed bytes are shuffled."""
    for b in batches:
        member, digest, sizes = [], [], []
        for page, url, key, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "key", "payload")), strict=True):
            member.append(gzip_member(response(page, url, key, html), level))
            digest.append(sha1_base32(html))
            sizes.append(len(html))
        made = [pa.array(sizes, pa.int64()), pa.array(digest, pa.string()), pa.array(member, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "key")), *made], ["page_id", "url", "key", "n_bytes", "digest", "member"])


def chosen_splitters(pages: DataFrame, shards: int, sampled: int = SAMPLED) -> list[int]:
    """Up to ``shards`` - 1 ids that part the pages evenly, from the ``shards`` x ``sampled`` ids with the least hashes: the same however rows are dealt."""
    if shards < 2:
        return []
    ids = pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(shards * sampled)
    keys = sorted({r["page_id"] for r in ids.collect()})
    return [keys[k * len(keys) // shards] for k in range(1, shards)] if len(keys) >= shards else keys[1:]


def _dealt(batches: Iterator[pa.RecordBatch], splitters: list[int]) -> Iterator[pa.RecordBatch]:
    """The shard of each row: by the range of its id, or of its payload's hash where it has none."""
    for b in batches:
        keys = zip(b.column("page_id").to_pylist(), b.column("key").to_pylist(), strict=True)
        shard = [bisect_right(splitters, page) if page is not None else int.from_bytes(key[:8], "big") % (len(splitters) + 1) for page, key in keys]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])


STAGED_SCHEMA = "file string, temporary string, shard int, part int, records long, bytes long, sha256 string"
STAGED = pa.schema([("file", pa.string()), ("temporary", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


class _Writer:
    """Files of one task: rows come sorted by (shard, id, key, url); each shard rolls into parts by compressed size."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.folder = store(folder)
        self.roll, self.attempt = roll, uuid.uuid4().hex
        self.shard, self.part, self.out, self.staged = None, 0, None, []

    def _begin(self) -> None:
        self.name = f"shard-{self.shard:05d}-{self.part:05d}.warc.gz"
        self.temporary = f"{self.name}.{self.attempt}.tmp"
        self.out = self.fs.open_output_stream(posixpath.join(self.folder, self.temporary), compression=None)
        self.records, self.bytes, self.hash = 0, 0, hashlib.sha256()
        self._put(gzip_member(warcinfo(self.name)))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.records += 1
        self.bytes += len(member)

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.staged.append((self.name, self.temporary, self.shard, self.part, self.records, self.bytes, self.hash.hexdigest()))
            self.out = None

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self.end()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.bytes + len(member) > self.roll and self.records > 1:
            self.end()
            self.part += 1
        if self.out is None:
            self._begin()
        self._put(member)


def _written(batches: Iterator[pa.RecordBatch], folder: str, roll: int, level: int) -> Iterator[pa.RecordBatch]:
    writer, last, copy, first = _Writer(folder, roll), None, -1, None
    names = ("shard", "page_id", "url", "key", "n_bytes", "digest", "member", "first_id", "first_url")
    for b in batches:
        for shard, page, url, key, n_bytes, digest, member, first_id, first_url in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if (shard, page, key) != last:
                last, copy, first = (shard, page, key), -1, None
            if member is None:  # what is known of the copies of this payload comes before the page
                first = (first_id, first_url)
                continue
            copy += 1
            if first is not None and (page != first[0] or copy):
                member = gzip_member(revisit(page, url, key, digest, n_bytes, copy, *first), level)
            writer.add(shard, member)
    writer.end()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*writer.staged, strict=True), STAGED.types, strict=True)] if writer.staged else [pa.array([], t) for t in STAGED.types], schema=STAGED)


def _renamed(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Temporary names become final ones. Doing it twice is safe: equal rows make equal bytes, and what is renamed already is left."""
    fs, root = store(folder)
    for b in batches:
        for temporary, name, size in zip(*(b.column(c).to_pylist() for c in ("temporary", "file", "bytes")), strict=True):
            source, target = posixpath.join(root, temporary), posixpath.join(root, name)
            if fs.get_file_info(source).type == pyarrow.fs.FileType.File:
                fs.move(source, target)
            if (there := fs.get_file_info(target)).type != pyarrow.fs.FileType.File or there.size != size:
                raise OSError(f"{name} isn't whole: {there.size} bytes of {size}")
        yield b.select(["file", "shard", "part", "records", "bytes", "sha256"])


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shards: int | None = None, roll: int = ROLL, level: int = LEVEL, least_bytes: int = 0) -> DataFrame:
    """Writes a WARC record for each row below ``folder`` (shared, new) and returns the manifest: file, shard, part, records, bytes, sha256.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is a response and the
    others revisit it. Ids, URLs and SHA-256 values of payloads are stored first. Equal ones meet in a count with partial
    sums and in a join whose exchange is plain on both sides, so that a payload that a third of all pages share is split
    there. Payloads are compressed before they move, and move once: what the join found about a page is sorted
    in before it. Records are range-sorted by id into ``shards`` (payload bytes / SHARD_BYTES by default, at least
    as many as there are shuffle partitions, SHARDS at most); each rolls into files of about ``roll`` compressed bytes.
    The same rows give the same files with the same bytes, however they were dealt, since splitters come from
    the ids alone. A task that is done again writes under a new temporary name; only names in the stored list
    of tasks that succeeded are renamed, and readers take the manifest, which comes last.

    Defined cases: null html is an empty payload; a null URL becomes a URN of the id; rows with a null id are dealt by
    their payload's hash and are a response only if no equal payload has an id; of rows with equal id and payload one is
    the response and the others revisit it; an empty table gives an archive without files; other columns are ignored.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    known = durable(rows.select("page_id", "url", "key", F.octet_length("payload").cast("long").alias("n_bytes")))
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    large = known.where(F.col("n_bytes") >= least_bytes)
    same = large.groupBy("key").agg(F.count("*").alias("n"), F.min(rank).alias("f")).where("n > 1")
    same = evenly(same.select("key", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url")), "key")
    if shards is None:
        size = known.agg(F.sum("n_bytes")).first()[0] or 0
        shards = min(SHARDS, max(parts, -(-size // SHARD_BYTES)))
    splitters = chosen_splitters(known, shards)

    made = rows.mapInArrow(lambda it: _made(it, level), "page_id long, url string, key binary, n_bytes long, digest string, member binary")
    fields = "page_id long, url string, key binary, n_bytes long, digest string, member binary, first_id long, first_url string"
    copies = large.select("page_id", "key").join(same, "key")
    both = made.unionByName(copies, allowMissingColumns=True).select([c.split()[0] for c in fields.split(", ")])
    dealt = both.mapInArrow(lambda it: _dealt(it, splitters), f"shard int, {fields}")
    order = ("shard", F.col("page_id").asc_nulls_last(), "key", F.col("member").isNotNull(), F.col("url").asc_nulls_last())
    in_order = dealt.repartitionById(max(parts, shards), "shard").sortWithinPartitions(*order)
    staged = posixpath.join(folder, "staged")
    in_order.mapInArrow(lambda it: _written(it, folder, roll, level), STAGED_SCHEMA).write.parquet(staged)
    done = spark.read.parquet(staged).repartition(parts, "file").mapInArrow(lambda it: _renamed(it, folder), "file string, shard int, part int, records long, bytes long, sha256 string")
    done.write.parquet(posixpath.join(folder, "manifest"))
    return read_manifest(spark, folder)


# --- reading -----------------------------------------------------------------------------------------------------------


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(folder, "manifest"))


def members(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other."""
    z, out = zlib.decompressobj(31), []
    for piece in stream:
        while piece:
            out.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the last member is cut")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; a wrong length or block digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(headers["content-length"])
    block = rest[:n]
    if not version.startswith("WARC/1.") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    if headers.get("warc-block-digest", "").removeprefix("sha1:") not in ("", sha1_base32(block)):
        raise ValueError(f"block digest of {headers.get('warc-record-id')}")
    return headers, block


def page_row(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, payload) of a record; a revisit has no payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)^content-length:\s*(\d+)", http, re.MULTILINE)[1])
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']}")
    number = lambda k: int(headers[k]) if k in headers else None
    return number("x-page-id"), headers["warc-target-uri"], kind, length, digest, number("x-refers-to-page-id"), headers["warc-record-id"], payload if kind == "response" else None


PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())])
PAGE_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary"


def _chunks(stream: pa.NativeFile, digest: hashlib._Hash, size: int = 2**20) -> Iterator[bytes]:
    while piece := stream.read(size):
        digest.update(piece)
        yield piece


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, root = store(folder)
    for b in batches:
        for name, sha256, records in zip(*(b.column(c).to_pylist() for c in ("file", "sha256", "records")), strict=True):
            rows, held, seen, digest = [], 0, 0, hashlib.sha256()

            def batch(rows: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PAGE.types, strict=True)], schema=PAGE)

            with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                for data in members(_chunks(stream, digest)):
                    headers, block = parsed(data)
                    seen += 1
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    row = page_row(headers, block)
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(block) * payloads + 500
                    if held > 16 * 2**20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)
            if seen != records or digest.hexdigest() != sha256:
                raise ValueError(f"{name} isn't what the manifest says")


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files in the manifest: PAGE_SCHEMA. Files are streamed; lengths, digests and counts are checked."""
    files = read_manifest(spark, folder).select("file", "sha256", "records")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "file").mapInArrow(lambda it: _read(it, folder, payloads), PAGE_SCHEMA)
