"""Token files: independent zstandard frames, a seek table and checksums.

A file holds the token ids of consecutive documents (ascending doc_id over all
files, in file order), as little-endian unsigned 32-bit integers:

* one zstandard frame a document, its ids and the end id;
* a skippable frame (magic 0x184D2A50) with the documents' ids, compressed;
* the seek table of the public zstandard seekable format: a skippable frame
  (magic 0x184D2A5E) of one entry a frame, (compressed size, decompressed size,
  checksum: low 32 bits of the XXH64 of the content), and a footer of the number
  of frames, a descriptor byte with the checksum flag, and magic 0x8F92EAB1.

Any zstandard decoder reads a file as one stream; a reader that wants some
documents reads the end of the file, seeks, and decompresses their frames only.

Documents are range-partitioned by (doc_id, hash) and sorted, and every
partition writes one file; a file appears only when complete. The manifest
(file, documents, tokens) is written as a table; its running sum, one row a
file, gives each file's first token number.

Defined results: texts have no length limit; null and empty texts are a document of the end id alone; null doc_ids
come last; repeated doc_ids stand next to each other, ordered by text hash; an empty table gives no rows. The text
column alone is encoded; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudlens.llm.common import bounded_batches, shared_folder, staged
from fraudlens.llm.files import new_file, open_file, partition_id
from fraudlens.llm.tokenize import shared_encoder, tokenizer_path

END_ID = 1
LEVEL = 3
# Fixed values of the file format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_HEAD = struct.Struct("<II")


class FrameWriter:
    """Writes frames to a stream, then the id index and the seek table."""

    def __init__(self, out, level: int = LEVEL):
        self._out = out
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._entries: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self._zstd.compress(content)
        self._out.write(frame)
        self._entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self._ids.append(doc_id)

    def close(self) -> None:
        known = np.array([i is not None for i in self._ids], np.uint8)
        ids = np.array([i or 0 for i in self._ids], "<i8")
        index = self._zstd.compress(ids.tobytes() + known.tobytes())
        self._out.write(_HEAD.pack(SKIPPABLE_IDS, len(index)) + index)
        entries = [*self._entries, (_HEAD.size + len(index), 0, 0)]
        table = np.array(entries, _ENTRY).tobytes() + _FOOTER.pack(len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._out.write(_HEAD.pack(SKIPPABLE_TABLE, len(table)) + table)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, f):
        self._f = f
        size = f.size()
        f.seek(size - _FOOTER.size)
        n, flags, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a seekable zstandard file with checksums")
        f.seek(size - _FOOTER.size - n * _ENTRY.itemsize)
        entries = np.frombuffer(f.read(n * _ENTRY.itemsize), _ENTRY)
        starts = np.concatenate(([0], np.cumsum(entries["compressed"], dtype=np.int64)))
        self.entries, self.starts = entries[:-1], starts[:-1]
        self._zstd = zstandard.ZstdDecompressor()
        f.seek(int(starts[-2]))
        magic, length = _HEAD.unpack(f.read(_HEAD.size))
        if magic != SKIPPABLE_IDS:
            raise ValueError("no document index")
        index = self._zstd.decompress(f.read(length))
        n -= 1
        known = np.frombuffer(index[8 * n:], np.uint8)
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(index[:8 * n], "<i8").tolist(), known.tolist())]

    def __len__(self) -> int:
        return len(self.entries)

    def content(self, i: int) -> bytes:
        """The i-th document's bytes; only its frame is read and decompressed."""
        self._f.seek(int(self.starts[i]))
        e = self.entries[i]
        data = self._zstd.decompress(self._f.read(int(e["compressed"])), max_output_size=int(e["size"]))
        if len(data) != e["size"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != e["checksum"]:
            raise ValueError(f"frame {i}: checksum mismatch")
        return data


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files to ``folder``; return the manifest
    (part, file, n_docs, n_tokens, start), start being the tokens before the file."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    end = struct.pack("<I", end_id)
    # The hash and the random number spread a doc_id that many rows share; equal rows may stand in any order.
    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
               .withColumn("h", F.xxhash64("text")).withColumn("r", F.rand(7))
               .repartitionByRange(F.col("id").asc_nulls_last(), "h", "r")
               .sortWithinPartitions(F.col("id").asc_nulls_last(), "h")
               # as text, so that ids of any size pass Python unchanged where others of their batch are null
               .select(F.col("id").cast("string").alias("id"), "text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        part = partition_id()
        file = f"{folder}/tokens-{part:06d}.zst"
        encoder, n_docs, n_tokens = shared_encoder(path), 0, 0
        with new_file(file) as out:
            frames = FrameWriter(out)
            while first is not None:
                for doc_id, text in zip(first["id"].tolist(), first["text"].tolist()):
                    content = encoder.encode(text) + end
                    frames.add(None if doc_id is None else int(doc_id), content)
                    n_docs += 1
                    n_tokens += len(content) // 4
                first = next(batches, None)
            frames.close()
        yield pd.DataFrame({"part": [part], "file": [file], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    manifest = staged(ordered.mapInPandas(write, "part int, file string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, read back and checked."""
    n = manifest.count()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, start in zip(b["file"].tolist(), b["start"].tolist()):
                with open_file(file) as f:
                    reader = FrameReader(f)
                    rows = []
                    for i, doc_id in enumerate(reader.doc_ids):
                        data = reader.content(i)
                        rows.append((None if doc_id is None else str(doc_id), start, len(data) // 4, zlib.crc32(data)))
                        start += len(data) // 4
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = manifest.select("file", "start").repartition(max(1, n), "file").mapInPandas(
        read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def documents_in(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents: only their frames are decompressed."""
    ids = set(wanted)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"].tolist():
                with open_file(file) as f:
                    reader = FrameReader(f)
                    rows = [(d, np.frombuffer(reader.content(i), "<u4").astype(np.int64))
                            for i, d in enumerate(reader.doc_ids) if d in ids]
                    yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return manifest.select("file").mapInPandas(read, "doc_id long, ids array<long>")


def report(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read the files back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, folder, **options))
