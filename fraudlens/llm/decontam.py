"""Benchmark decontamination by Wu-Manber multi-pattern search.

A *window* is ``window`` consecutive words of a benchmark item; an item with
fewer words, but not none, is one window. Words are runs of ASCII letters and
digits and of all non-ASCII characters, lower-cased in A-Z only.

The search runs over words, not characters. All windows of one length share a
table set: the *shift table* says, for a block of two words (one word where
the windows are that short), how far the search may jump because no window can
end sooner; a shift of zero selects the *suffix bucket* of the windows that end
in this block; those of the bucket that may be equal are compared with the text.
A document of n words without benchmark text costs about n / (window - 1)
table look-ups. A worker process builds a step's tables once and keeps them.

Defined results: texts have no length limit; null and empty texts have no words and no hits; items without words (null
included) occur nowhere; repeated items count once per item id; repeated documents each get their row; a null item id
is written as an empty string; an empty benchmark leaves every document clean. Columns the operator adds live in one
struct column, so clashing names of other columns do no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.llm.common import bounded_batches, free_name, shared_folder

WINDOW = 13
#: Bytes of item text that one scan's tables are built from; a larger benchmark takes more scan steps.
STEP_BYTES = 8_000_000
#: Texts with hits of earlier steps up to which their table is broadcast; beyond, the planner decides.
MAX_BROADCAST_HITS = 100_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])

#: Hits of a text, by its hash.
_HITS = T.StructType([
    T.StructField("key", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])),
    *_RESULT.fields[1:],
])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words. On UTF-8 bytes: ``bytes.lower`` changes A-Z only, and
    every byte of a non-ASCII character is 0x80 or above."""
    return _WORDS.findall(_normal(text))


def _normal(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


class WuManber:
    """Shift table, suffix buckets and windows of equal length, over the words of items.

    The items' words lie in one byte string with a space after each; a window is the number of
    its first word, so tables take some tens of bytes a word. Hashes only choose the shift, the
    bucket and the place in it: occurrences are confirmed by comparing bytes. Equal windows are
    one entry with the items that hold it."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], length: int):
        self.length = length
        self.block = min(2, length)
        self.names: list[str] = []
        held, counts, word_bytes, suffixes = [], [], array("q"), array("q")
        for name, words in items:
            self.names.append(name)
            held.append(b" ".join(words) + b" ")
            counts.append(len(words))
            word_bytes.extend(map(len, words))
            # one suffix hash a word; the first word of a longer block ends none
            suffixes.extend([0] * (self.block - 1))
            suffixes.extend(hash(tuple(words[e - self.block:e])) for e in range(self.block, len(words) + 1))
        self.text = b"".join(held)
        del held
        stops = np.cumsum(np.frombuffer(word_bytes, np.int64) + 1) - 1
        begins = stops - np.frombuffer(word_bytes, np.int64)
        self.mask = (1 << max(8, (2 * len(stops)).bit_length())) - 1
        buckets = np.frombuffer(suffixes, np.int64) & self.mask
        sizes = np.array(counts, np.int64)
        # place of each word in its item: a block there ends a window, or could after so many more words
        place = np.arange(len(stops)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        shift = np.full(self.mask + 1, min(255, length - self.block + 1), np.uint8)
        ends_block = place >= self.block - 1
        np.minimum.at(shift, buckets[ends_block], np.minimum(255, np.maximum(0, length - 1 - place[ends_block])).astype(np.uint8))
        self.shift = shift.tobytes()
        self._windows(begins, stops, buckets, np.flatnonzero(place >= length - 1), np.repeat(np.arange(len(sizes)), sizes))

    def _windows(self, begins, stops, buckets, last, item) -> None:
        """Sort windows (given by their last words) by bucket and hash, and fold equal ones."""
        text, first = self.text, last - self.length + 1
        at, to = begins[first], stops[last]
        hashes = np.fromiter((hash(text[i:j]) for i, j in zip(at.tolist(), to.tolist())), np.int64, len(at))
        order = np.lexsort((at, hashes, buckets[last]))
        at, to, hashes, bucket, item = at[order], to[order], hashes[order], buckets[last][order], item[last][order]
        new = np.ones(len(at), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
        for k in np.flatnonzero(~new).tolist():  # equal hashes: the texts decide
            new[k] = text[at[k]:to[k]] != text[at[k - 1]:to[k - 1]]
        one = np.flatnonzero(new)
        self.at, self.to, self.hashes = (array("q", x[one].tobytes()) for x in (at, to, hashes))
        self.items, self.items_from = array("q", item.tobytes()), array("q", np.append(one, len(at)).astype(np.int64).tobytes())
        starts = np.zeros(self.mask + 2, np.int32)
        np.cumsum(np.bincount(bucket[one], minlength=self.mask + 1), out=starts[1:])
        self.starts = array("i", starts.tobytes())

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, window number) of every occurrence."""
        m, b, n = self.length, self.block, len(words)
        shift, mask = self.shift, self.mask
        end = m
        while end <= n:
            bucket = hash(tuple(words[end - b:end])) & mask
            jump = shift[bucket]
            if jump:
                end += jump
                continue
            here, stop = self.starts[bucket], self.starts[bucket + 1]
            if here < stop:
                text = b" ".join(words[end - m:end])
                wanted = hash(text)
                k = bisect_left(self.hashes, wanted, here, stop)
                while k < stop and self.hashes[k] == wanted:
                    if self.text[self.at[k]:self.to[k]] == text:
                        yield end - m, k
                        break
                    k += 1
            end += 1

    def items_of(self, window: int) -> set[str]:
        return {self.names[i] for i in self.items[self.items_from[window]:self.items_from[window + 1]]}


def build_tables(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One search table for each window length that the items have."""
    lengths = [min(window, sum(1 for _ in _WORDS.finditer(_normal(text)))) for _, text in items]
    return [WuManber(((name, words_of(text)) for (name, text), n in zip(items, lengths) if n == m), m)
            for m in sorted(set(lengths) - {0})]


#: The tables that this worker process searched with last, by the name of their step.
_KEPT: dict[str, list[WuManber]] = {}


def _tables_of(step: str, items_broadcast, window: int) -> list[WuManber]:
    if step not in _KEPT:
        _KEPT.clear()
        _KEPT[step] = build_tables(items_broadcast.value, window)
    return _KEPT[step]


def find(text: str | None, tables: list[WuManber]) -> tuple[int, list[int], set[str]]:
    """(words, flat [start, end) intervals of hit words in order, items found)."""
    words = words_of(text)
    spans, found = [], set()
    for table in tables:
        windows = set()
        for start, window in table.search(words):
            spans.append((start, start + table.length))
            windows.add(window)
        found.update(*map(table.items_of, windows))
    return len(words), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan_udf(items_broadcast, window: int):
    """UDF (text, hits so far, items so far) -> result with this step's items added."""

    step = uuid.uuid4().hex

    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tables = _tables_of(step, items_broadcast, window)
        for texts, hits, seen in batches:
            rows = []
            for text, before, names in zip(texts, hits, seen):
                n, spans, found = find(text, tables)
                if before is not None and len(before):
                    old = list(map(int, before))
                    spans = merged([*zip(old[::2], old[1::2]), *zip(spans[::2], spans[1::2])])
                rows.append((n, spans, sorted(found.union(names if names is not None else ()))))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return scan.asNondeterministic()  # so that no filter makes the planner search a text twice


def pieces(text: str | None, size: int, window: int = WINDOW) -> Iterator[str | None]:
    """``text``, or where it is longer than ``size`` bytes its pieces of about that size. Neighbours
    share ``window - 1`` words, so each window lies in one of them, and no piece has fewer words."""
    if len(text or "") * 4 <= size or len(data := _normal(text)) <= size:
        yield text
        return
    begins: deque[int] = deque(maxlen=window)  # of the last words
    begin = end = n = 0  # of the piece, and its words
    whole = True
    for m in _WORDS.finditer(data):
        if n >= window and m.end() - begin > size:
            yield data[begin:end].decode("utf-8", "surrogatepass")
            whole, n = False, window - 1
            begin = begins[1] if window > 1 else m.start()
        begins.append(m.start())
        n, end = n + 1, m.end()
    yield text if whole else data[begin:end].decode("utf-8", "surrogatepass")


def steps_of(benchmark: DataFrame, id_col: str, text_col: str, step_bytes: int,
             window: int = WINDOW) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in lists of at most about ``step_bytes``; longer items in pieces."""
    held: list[tuple[str, str | None]] = []
    size = 0
    # one partition's rows at a time reach the driver; only the current step is kept
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        for piece in pieces(r["t"], step_bytes, window):
            more = len(_normal(piece)) + 64
            if held and size + more > step_bytes:
                yield held
                held, size = [], 0
            held.append((r["i"] or "", piece))
            size += more
    yield held


def search_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                     item_text: str = "text", window: int = WINDOW, step_bytes: int = STEP_BYTES,
                     result: str = "found") -> DataFrame:
    """``docs`` with a struct column ``result``: n_words, hits (flat word
    intervals [start, end, start, end, ...]) and items (sorted ids).

    The benchmark goes to the executors in steps of bounded size. The hits of every
    step but the last are written to the shared folder, and its broadcast is destroyed,
    before the next one; the last step is a projection that adds them by the text's
    hash. So no task holds more than one step's tables, and with one step nothing moves.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    steps = steps_of(benchmark, item_id, item_text, step_bytes, window)
    items, path = next(steps), None
    for following in steps:
        path = path or f"{shared_folder(spark, 'hits')}/table"
        _write_hits(docs, text_col, items, window, path)
        items = following
    out, hits = docs, (F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<string>"))
    key, before = free_name(docs, "text_key"), free_name(docs, "earlier_hits")
    if path:
        earlier = spark.read.schema(_HITS).parquet(path).groupBy(F.col("key").alias(key)).agg(F.struct(
            F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")).alias(before))
        if earlier.limit(MAX_BROADCAST_HITS + 1).count() <= MAX_BROADCAST_HITS:
            earlier = F.broadcast(earlier)
        out = docs.withColumn(key, _text_key(text_col)).join(earlier, key, "left")
        hits = F.col(before)["hits"], F.col(before)["items"]
    scan = _scan_udf(spark.sparkContext.broadcast(items), window)
    return out.withColumn(result, scan(F.col(text_col), *hits)).drop(key, before)


def _text_key(text_col: str) -> Column:
    return F.struct(F.xxhash64(F.lit(1), text_col).alias("a"), F.xxhash64(F.lit(2), text_col).alias("b"))


def _write_hits(docs: DataFrame, text_col: str, items: list[tuple[str, str | None]], window: int, path: str) -> None:
    """Append (key, hits, items) of the texts that one step's items occur in; equal texts have one row."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    scan = _scan_udf(sent, window)
    found = docs.select(_text_key(text_col).alias("key"), scan(
        F.col(text_col), F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<string>")).alias("r"))
    found.filter(F.size("r.hits") > 0).select("key", "r.hits", "r.items").dropDuplicates(["key"]) \
        .write.mode("append").parquet(path)
    sent.destroy()


def n_hit(found: Column) -> Column:
    """Number of hit words: the summed lengths of the intervals."""
    h = found["hits"]
    return F.aggregate(F.transform(h, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(found: Column) -> Column:
    """At least one hit word, and hit words make up a twentieth of all or more."""
    return (n_hit(found) > 0) & (F.lit(20) * n_hit(found) >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    name = free_name(docs, "found")
    found = search_benchmark(docs, benchmark, text_col, result=name, **options)
    return found.filter(~contaminated(F.col(name))).drop(name)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    name = free_name(docs, "found")
    f = F.col(name)
    return search_benchmark(docs.select("doc_id", "text"), benchmark, result=name).select(
        "doc_id", f["n_words"].alias("n_words"), n_hit(f).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), contaminated(f).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple:
    """The row of :func:`report` without doc_id, by trying every window at every
    place. For tests on small inputs."""
    words = words_of(text)
    hit, found = set(), set()
    for name, t in items:
        w = words_of(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for k in range(len(words) - m + 1):
                if words[k:k + m] == w[i:i + m]:
                    hit.update(range(k, k + m))
                    found.add(name)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)
