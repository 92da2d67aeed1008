"""Dictionary-compressed WARC archives (``.warc.zst``).

Pages are written as WARC/1.1 records. Every archive starts with a skippable frame
(magic 0x184D2A5D) that holds a zstandard dictionary, trained on the records that
the archive's writer sees first; then each record is a zstandard frame of its own,
compressed with that dictionary. A reader takes the dictionary from the file's
start and can decompress any record alone, given its offset.

Of pages with equal payloads (by SHA-1 and length) of ``REVISIT_BYTES`` or more,
the one with the largest page id is archived as ``response``, the others as
``revisit`` records that name it and carry no payload. Digests are aggregated
first, in every task; a payload with most pages costs a row a task there, and the
join back splits it.

Each partition writes archives of at most ``ARCHIVE_BYTES`` of records; a file
appears only when complete, and the manifest of files is written as a table.

Defined results: payloads have no length limit; other columns, whatever their names, are not read; a null html is an
empty payload; a null url leaves the target URI out; null page ids never lead a group unless all are null, and then
all of the group are responses; repeated rows with the largest page id of their group are all responses; an empty
table writes nothing and returns no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm.common import bounded_batches, shared_folder, staged
from fraudlens.llm.files import new_file, open_file, partition_id

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64_000_000
#: Records' bytes that a dictionary is trained on, and its size.
SAMPLE_BYTES = 2_000_000
DICTIONARY_BYTES = 32_768
LEVEL = 6
DATE = "2025-01-01T00:00:00Z"
# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEAD = struct.Struct("<II")
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:fraudlens:warc")


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name a record of another file."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` not None makes it a revisit."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                   ("Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the sampled records; their last bytes where they are too
    few to train on; None without samples."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """One archive: the dictionary frame, then a frame for each record."""

    def __init__(self, out, dictionary: zstandard.ZstdCompressionDict | None):
        self._out = out
        self.offset = self.size = 0
        if dictionary is not None:
            self._write(_HEAD.pack(DICTIONARY_FRAME, len(dictionary.as_bytes())) + dictionary.as_bytes())
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)

    def _write(self, data: bytes) -> int:
        self._out.write(data)
        self.offset += len(data)
        return len(data)

    def add(self, rec: bytes) -> tuple[int, int]:
        """(offset, length) of the record's frame."""
        at = self.offset
        self.size += len(rec)
        return at, self._write(self._zstd.compress(rec))


def dictionary_of(f) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary at the start of an open archive, and where the records begin."""
    f.seek(0)
    head = f.read(_HEAD.size)
    if len(head) == _HEAD.size:
        magic, size = _HEAD.unpack(head)
        if magic == DICTIONARY_FRAME:
            return zstandard.ZstdCompressionDict(f.read(size)), _HEAD.size + size
    return None, 0


def record_at(f, offset: int, length: int) -> bytes:
    """One record, decompressed alone."""
    dictionary, _ = dictionary_of(f)
    f.seek(offset)
    return zstandard.ZstdDecompressor(dict_data=dictionary).decompress(f.read(length))


def records_of(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record, one at a time."""
    dictionary, start = dictionary_of(f)
    f.seek(start)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(
        f, read_across_frames=True, closefd=False), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield fields, block


def with_leaders(pages: DataFrame, id_col: str, html_col: str, url_col: str | None) -> DataFrame:
    """(page_id, url, html, digest, refers_to), ids as text: refers_to is the largest page id of a group of equal
    payloads of REVISIT_BYTES or more for the other pages of it, null elsewhere. (As text, ids of any size pass Python
    unchanged where others of their batch are null.)"""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"),
                        html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                        F.octet_length(html).alias("bytes"))
    leaders = staged(rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "leaders")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return rows.join(leaders, ["digest", "bytes"], "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest",
        F.when(revisit, F.col("leader").cast("string")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url",
                   html_col: str = "html", index: bool = False) -> DataFrame:
    """Write ``pages`` to ``folder``; return the manifest (file, n_records, bytes)
    or, with ``index``, one row a record (file, page_id, offset, length)."""
    bounded_batches(pages.sparkSession)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, bytes]]:
        for b in batches:
            for page_id, url, html, digest, other in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"]):
                yield page_id, record(_number(page_id), url, html.encode("utf-8", "replace"), digest, _number(other))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = rows_of(batches)
        part, number = partition_id(), 0
        held: list[tuple[str | None, bytes]] = []
        more = True
        while more:
            size = 0
            for row in rows:  # the sample; the records themselves are written next
                held.append(row)
                size += len(row[1])
                if size >= SAMPLE_BYTES:
                    break
            if not held:
                return
            file = f"{folder}/pages-{part:06d}-{number:03d}.warc.zst"
            found = []
            with new_file(file) as out:
                archive = ArchiveWriter(out, train_dictionary([r[:1 << 17] for _, r in held]))
                for page_id, rec in held:
                    found.append((file, page_id, *archive.add(rec)))
                held, more = [], False
                for page_id, rec in rows:
                    found.append((file, page_id, *archive.add(rec)))
                    if archive.size >= ARCHIVE_BYTES:
                        more = True
                        break
            number += 1
            if index:
                yield pd.DataFrame(found, columns=["file", "page_id", "offset", "length"])
            else:
                yield pd.DataFrame({"file": [file], "n_records": [len(found)], "bytes": [archive.offset]})

    schema = "file string, page_id string, offset long, length long" if index \
        else "file string, n_records long, bytes long"
    written = with_leaders(pages, id_col, html_col, url_col).mapInPandas(write, schema)
    return staged(written.withColumn("page_id", F.col("page_id").cast("long")) if index else written, "archives")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to; digests of stored payloads are computed again and checked."""
    files = manifest.select("file").distinct()
    n = max(1, files.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"].tolist():
                rows = []
                with open_file(file) as f:
                    for fields, block in records_of(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        kind = fields["warc-type"]
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{file}: payload does not match its digest")
                        rows.append((fields.get("page-id"), size, digest, kind, fields.get("refers-to-page-id")))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    found = files.repartition(n, "file").mapInPandas(
        read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


def _number(value: str | None) -> int | None:
    return None if pd.isna(value) else int(value)


def report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages.select("page_id", "url", "html"), shared_folder(spark, "warc")))


#: The rows of :func:`report` over ``pages``, in DuckDB's SQL.
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND count(*) OVER w > 1 THEN max(page_id) OVER w END AS leader
      FROM p WINDOW w AS (PARTITION BY payload_digest, payload_bytes))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN leader IS NOT NULL AND page_id IS DISTINCT FROM leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM g
"""
