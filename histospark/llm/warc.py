"""WARC archives with a two-level capture index.

Each task writes one archive, a gzip member for each record, into a shared folder and returns where
its records lie. The index sorts the captures by their URL with the host's labels reversed, packs
runs of them into compressed blocks, and keeps a sparse directory of the blocks' first keys. A
lookup finds a key's block by binary search in the directory, the capture by binary search in the
block, and reads the record's byte range alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histospark.llm.common import fresh_path, written

#: Captures in a block at least, and blocks at most: the directory stays small enough to broadcast.
BLOCK_LINES, MOST_BLOCKS = 2000, 1 << 17
#: Fixed value: every record's date, so that archives don't depend on when they were written.
DATE = "2024-01-01T00:00:00Z"
#: Stands for a null page_id, as the least of all; a page of this very id comes back as null.
NO_PAGE = -(2**63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
POINTERS = "key string, page_id long, file string, offset long, length long"


def reversed_host_key(url: str | None) -> str:
    """'http://a.example.com/x?y' is 'com,example,a)/x?y'; what isn't a URL stands as it is after ')'."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "") + (f":{parts.port}" if parts.port else "")
    except ValueError:
        return f"){url}"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def visible(text: str) -> str:
    """Spaces and control characters as %XX, so that a line of the index is one capture and a header is one line."""
    return "".join(c if c > " " and c not in "\x7f\x85\u2028\u2029" else f"%{ord(c):02X}" for c in text)


def capture_key(url: str | None, page_id: int) -> str:
    """The sort key of a capture: the URL's key, then the page in twenty digits."""
    return f"{visible(reversed_host_key(url))} {page_id + (1 << 63):020d}"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, and its path there; the names that Hadoop has for S3 are understood."""
    return fs.FileSystem.from_uri("s3://" + folder.partition("://")[2] if folder.startswith(("s3a://", "s3n://")) else folder)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}')}>"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the payload's digest and length alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {visible(url or '')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Page-ID: {page_id}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """What a record says: page, type, payload's length and digest, and what a revisit refers to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    http, _, payload = block.partition(b"\r\n\r\n")
    assert end == b"\r\n\r\n", "a record ends with two line ends"
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        assert len(payload) == size and base32_sha1(payload) == digest, "the payload isn't what its headers say"
    other, page = fields.get("X-Refers-To-Page-ID"), int(fields["X-Page-ID"])
    return {"page_id": None if page == NO_PAGE else page, "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": None if other is None else int(other), "payload": payload}


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads of at least least_bytes, the largest page_id is
    kept and the others refer to it. Only digests and ids are grouped; each page is then shuffled at
    most once, by its id. Repeated rows of that page are responses each."""
    pages = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    light = pages.where(F.octet_length("html") >= least_bytes).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha"))
    kept = light.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("refers_to > least")
    revisits = light.join(kept, "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    return pages.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).join(revisits, ["page_id", "sha"], "left").drop("sha")


def write_archives(marked: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes the archives and returns key, page_id, file, offset and length of each record.

    An archive's name is new for each attempt of a task, and the pointers, written to the shared
    folder, name only the archives of attempts that Spark kept; what a lost attempt wrote is never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        store.create_dir(path, recursive=True)
        file = f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        for batch in batches:
            rows = []
            for page, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                member = gzip.compress(record(page, url, html.encode("utf-8", "surrogatepass"), refers_to), level, mtime=0)
                out = out or store.open_output_stream(file, compression=None)
                out.write(member)
                rows.append((capture_key(url, page), page, file, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"]).astype({"key": object, "file": object, "page_id": "int64", "offset": "int64", "length": "int64"}), schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]), preserve_index=False)
        if out:
            out.close()

    return written(marked.select("page_id", "url", "html", "refers_to").mapInArrow(write, POINTERS), "pointers")


class CaptureIndex:
    """Compressed blocks of sorted captures, and the directory of their first keys."""

    def __init__(self, blocks: DataFrame, first_keys: list[str]):
        self.blocks, self.first_keys = blocks, first_keys

    @classmethod
    def build(cls, pointers: DataFrame) -> CaptureIndex:
        """Sorts the pointers by key over many tasks; each packs runs of at least BLOCK_LINES."""
        n = pointers.count()
        lines = max(BLOCK_LINES, -(-n // MOST_BLOCKS))

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[str] = []

            def block(rows: list[str]) -> dict:
                return {"first_key": rows[0].partition("\t")[0], "n": len(rows), "block": zlib.compress("\n".join(rows).encode("utf-8", "surrogatepass"))}

            for batch in batches:
                held += [f"{k}\t{f}\t{o}\t{m}" for k, f, o, m in zip(batch["key"], batch["file"], batch["offset"], batch["length"], strict=True)]
                full = [block(held[k : k + lines]) for k in range(0, len(held) - lines + 1, lines)]
                held = held[len(full) * lines :]
                if full:
                    yield pd.DataFrame(full, dtype=object)
            if held:
                yield pd.DataFrame([block(held)], dtype=object)

        # no more ranges than blocks, so that the last block of each range adds few to their number
        ranges = max(1, min(int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // lines))
        ordered = pointers.repartitionByRange(ranges, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        blocks = written(ordered.mapInPandas(pack, "first_key string, n long, block binary"), "blocks")
        return cls(blocks, sorted(r["first_key"] for r in blocks.select("first_key").toLocalIterator()))

    def blocks_of(self, key: Column) -> Column:
        """The first keys of the blocks that may hold a key, by binary search in the directory."""
        held = self.blocks.sparkSession.sparkContext.broadcast(self.first_keys)

        @F.pandas_udf("array<string>")
        def find(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in keys:
                yield pd.Series([first_keys_for(held.value, k) for k in batch], dtype=object)

        return find(key)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key, file, offset and length of the captures with the given keys (a column ``key``), each capture once.

        A key that repeats may run over the end of a block: all blocks that begin with it are
        searched, and the one before them.
        """
        wanted = keys.select("key").distinct().withColumn("first_key", F.explode(self.blocks_of(F.col("key"))))
        asked = wanted.groupBy("first_key").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most a block's keys
        tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else a few megabytes of blocks make one task

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for block, keys in zip(batch["block"], batch["keys"], strict=True):
                    lines = zlib.decompress(block).decode("utf-8", "surrogatepass").split("\n")
                    found = []
                    for key in keys:
                        at = bisect_left(lines, key + "\t")
                        while at < len(lines) and lines[at].startswith(key + "\t"):
                            found.append(lines[at].split("\t"))
                            at += 1
                    yield pd.DataFrame({"key": [x[0] for x in found], "file": [x[1] for x in found], "offset": [int(x[2]) for x in found], "length": [int(x[3]) for x in found]}, dtype=object)

        return self.blocks.join(asked, "first_key").select("block", "keys").repartition(tasks).mapInPandas(search, "key string, file string, offset long, length long")


def first_keys_for(first_keys: list[str], key: str) -> list[str]:
    """The last first key below the key, and the key itself if a block begins with it."""
    at = bisect_left(first_keys, key)
    return first_keys[max(at - 1, 0) : at] + ([key] if at < len(first_keys) and first_keys[at] == key else [])


def read_records(pointers: DataFrame, folder: str) -> DataFrame:
    """Reads each pointer's byte range and parses the record; a task reads an archive's ranges in order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = store_of(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if file != name:
                    name, source = file, store.open_input_file(file)
                source.seek(int(offset))
                rows.append(parsed(gzip.decompress(source.read(int(length)))))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"], dtype=object)

    tasks = int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pointers are small, what they point at isn't
    dealt = pointers.select("file", "offset", "length").repartition(tasks, "file").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def keys_of(pages: DataFrame) -> DataFrame:
    """The capture key of each page."""

    @F.pandas_udf("string")
    def key(urls: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, int(p)) for u, p in zip(urls, pages, strict=True)], dtype=object)

    return pages.select(key(F.col("url"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE))).alias("key"))


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages as WARC records, indexes them, looks every page up and reads its record back.

    A null html is an empty payload, a null url an empty one; a null page_id is the least and comes
    back as null. Repeated rows come back as often as they are there. Control characters of URLs
    stand as %XX in keys and headers.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    index = CaptureIndex.build(write_archives(mark_revisits(pages, least_bytes), folder))
    return read_records(index.lookup(keys_of(pages)), folder)
