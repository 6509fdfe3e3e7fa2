"""WARC archives with a two-level capture index.

Records are compressed one by one. The index holds one line a record, sorted by
the URL with its host reversed, in compressed blocks; a sparse directory names each
block's first key and place. A look-up searches the directory, then one block,
and reads the record's range of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import itemgetter
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.common import scratch, staged, table

FILE_BYTES = 256 << 20
BLOCK_LINES = 3000
DATE = "2020-01-01T00:00:00Z"
#: Gaps up to so many bytes are read over rather than sought.
NEAR = 256 << 10
LINES = "key string, page_id long, file string, position long, size long"
#: A page of the directory: the first and last keys of consecutive blocks of one index file, in order, and where they are.
DIRECTORY = "first_key string, last_key string, file string, first_keys array<string>, last_keys array<string>, positions array<long>, sizes array<long>"
PAGE_BLOCKS = 4096
CAPTURES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def host_reversed(url: str | None) -> str:
    """``http://a.example.com:80/x?q`` as ``com,example,a)/x?q``; what is no URL stays as it is."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as tasks can open it: without a scheme it lies in Spark's default file system, not on a task's own disk."""
    if "://" not in folder and not folder.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        folder = f"{default.rstrip('/') if default != 'file:///' else 'file://'}{folder if folder.startswith('/') else '/' + folder}"
    scheme = folder.partition(":")[0]
    known = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
    if scheme not in known:
        raise ValueError(f"tasks cannot open {scheme}: folders; name one of {', '.join(known)}")
    return known[scheme] + folder[len(scheme) :]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:foldcast:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or one that revisits another's payload and leaves it out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "" if url is None else f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}\r\n"
    revisit = "" if refers_to is None else f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {record_id(refers_to)}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: {record_id(page_id)}\r\n"
        f"WARC-Date: {DATE}\r\n{target}WARC-Payload-Digest: sha1:{digest}\r\n{revisit}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(3, wbits=31)
    return z.compress(data) + z.flush()


def unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, wbits=31)


def _page(name: str) -> int | None:
    number = name.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def parsed(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), found) != (length, digest):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return (
        _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind,
        _page(refers) if refers else None, payload if kind == "response" else None,
    )


def write_archives(pages: DataFrame, out: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files under ``out``; returns the lines of the index.

    Of pages with equal payloads (compared by SHA-256) those with the
    largest ``page_id`` are responses, the others revisit that id; a page without id
    is a response only if no equal page has one. A null html is an empty payload, a null
    URL is left out; other columns are not read. File names are new in each attempt of a
    task, and only those of attempts that succeeded get into the index.
    """
    out = qualified(pages.sparkSession, out)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("same", F.sha2("html", 256))
    firsts = rows.groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = staged(firsts.select("same", "first"), "warc-repeated")
    joined = rows.join(repeated, "same", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(out)
        files.create_dir(place, recursive=True)
        stream, name, size = None, "", 0
        for batch in batches:
            lines = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None or size >= file_bytes:
                    if stream:
                        stream.close()
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = files.open_output_stream(f"{place}/{name}", compression=None)
                digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
                member = packed(record(page_id, url, html, digest, refers_to))
                stream.write(member)
                lines.append((host_reversed(url), page_id, name, size, len(member)))
                size += len(member)
            columns = [pa.array(c, t) for c, t in zip(zip(*lines), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            if lines:
                yield pa.record_batch(columns, names=["key", "page_id", "file", "position", "size"])
        if stream:
            stream.close()

    return staged(joined.select("page_id", "url", "html", "refers_to").mapInArrow(write, LINES), "warc-lines")


def write_index(lines: DataFrame, out: str, block_lines: int = BLOCK_LINES, page_blocks: int = PAGE_BLOCKS) -> DataFrame:
    """Sort the lines by key into compressed blocks under ``out``; returns the sparse directory, one row a page of blocks."""
    out = qualified(lines.sparkSession, out)
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = lines.repartitionByRange(n, "key", "page_id", "file", "position").sortWithinPartitions("key", "page_id", "file", "position")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(out)
        files.create_dir(place, recursive=True)
        stream, name, size, held, page = None, f"{uuid.uuid4().hex}.cdx.gz", 0, [], []

        def block() -> None:
            nonlocal stream, size
            stream = stream or files.open_output_stream(f"{place}/{name}", compression=None)
            member = packed("".join(json.dumps(x) + "\n" for x in held).encode())
            stream.write(member)
            page.append((held[0][0], held[-1][0], size, len(member)))
            size += len(member)
            held.clear()

        def full_page() -> pa.RecordBatch:
            lists = [pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*page), (pa.string(), pa.string(), pa.int64(), pa.int64()))]
            ends = [pa.array([v], pa.string()) for v in (page[0][0], page[-1][1], name)]
            page.clear()
            return pa.record_batch([*ends, *lists], names=["first_key", "last_key", "file", "first_keys", "last_keys", "positions", "sizes"])

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(line)
                if len(held) == block_lines:
                    block()
                if len(page) == page_blocks:
                    yield full_page()
        if held:
            block()
        if page:
            yield full_page()
        if stream:
            stream.close()

    directory = ordered.select("key", "page_id", "file", "position", "size").mapInArrow(write, DIRECTORY)
    return staged(directory, "warc-directory")


def ranges(place: str, files: fs.FileSystem, wanted: list[tuple[int, int]], name: str) -> Iterator[bytes]:
    """The byte ranges of one file, in ascending order, near ones in one read."""
    with files.open_input_file(f"{place}/{name}") as f:
        k = 0
        while k < len(wanted):
            start, end, last = wanted[k][0], sum(wanted[k]), k
            while last + 1 < len(wanted) and wanted[last + 1][0] <= end + NEAR and sum(wanted[last + 1]) - start < 8 * NEAR:
                last += 1
                end = max(end, sum(wanted[last]))
            f.seek(start)
            data = f.read(end - start)
            for at, size in wanted[k : last + 1]:
                yield data[at - start : at - start + size]
            k = last + 1


def index_blocks(directory: DataFrame, key: str | None = None) -> DataFrame:
    """``file``, ``position``, ``size`` of all blocks, or of those that can hold a key.

    Spark's Parquet reader skips files of the directory whose pages lie beside the key; in a page that can hold it the
    blocks are found by binary search.
    """
    if key is not None:
        directory = directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, firsts, lasts, positions, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                here = slice(None) if key is None else slice(bisect_left(lasts, key), bisect_right(firsts, key))
                found = positions[here], sizes[here]
                columns = [pa.array([name] * len(found[0]), pa.string()), *(pa.array(c, pa.int64()) for c in found)]
                yield pa.record_batch(columns, names=["file", "position", "size"])

    pages = directory.select("file", "first_keys", "last_keys", "positions", "sizes")
    return pages.mapInArrow(read, "file string, position long, size long")


def index_lines(directory: DataFrame, out: str, key: str | None = None) -> DataFrame:
    """All lines of the index, or those of one key, searched in the directory and then in each block."""
    out = qualified(directory.sparkSession, out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(out)
        for batch in batches:
            for name, position, size in zip(*(c.to_pylist() for c in batch.columns)):
                (raw,) = ranges(place, files, [(position, size)], name)
                rows = [json.loads(x) for x in unpacked(raw).decode().splitlines()]
                if key is not None:
                    rows = rows[bisect_left(rows, key, key=itemgetter(0)) : bisect_right(rows, key, key=itemgetter(0))]
                if not rows:
                    continue
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "page_id", "file", "position", "size"]
                )

    return index_blocks(directory, key).mapInArrow(read, LINES)


def read_archives(lines: DataFrame, out: str, payloads: bool = True) -> DataFrame:
    """Read and check the records that the lines name, each file's in order of position."""
    out = qualified(lines.sparkSession, out)
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = lines.select("file", "position", "size").repartitionByRange(n, "file", "position").sortWithinPartitions("file", "position")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _filesystem(out)
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, position, size in zip(*(c.to_pylist() for c in batch.columns)):
                by_file.setdefault(name, []).append((position, size))
            for name, wanted in by_file.items():
                for k in range(0, len(wanted), 500):
                    rows = [parsed(unpacked(x)) for x in ranges(place, files, wanted[k : k + 500], name)]
                    rows = rows if payloads else [(*r[:-1], None) for r in rows]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return ordered.mapInArrow(read, CAPTURES)


def lookup(spark: SparkSession, directory: DataFrame, index: str, archives: str, url: str) -> DataFrame:
    """Captures of one URL: a search of the directory, one of each block that can hold its key, and range reads."""
    return read_archives(index_lines(directory, index, host_reversed(url)), archives)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, index = scratch(spark, "warc"), scratch(spark, "cdx")
    lines = write_archives(table(spark, sf_dir, "pages"), archives)
    directory = write_index(lines, index)
    return read_archives(index_lines(directory, index), archives, payloads=False).drop("url", "payload")
