"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

1. *Words.* Runs of letters of each whole text; a few lose a letter by a checksum rule. A task counts
   its words before the shuffle.
2. *Blocks.* One edit changes a word's letter counts by a squared distance of 1 (a letter more or less)
   or 2 (another letter). So it changes the length by one at most, and in the counts of letter classes either one
   by one (with the length) or one up and another down. A block holds the words of one length and
   one count of each coarse class; it is compared with itself and the adjacent blocks.
   Blocks above TILE_WORDS are dealt into tiles by hash, and a group is a pair of tiles.
3. *Gram matrices.* Inside a group, fine classes cut both tiles again in the same way. NumPy products of the
   count matrices of adjacent pieces give all squared distances, |a|^2 + |b|^2 - 2 ab.
4. *Edits.* Pairs at squared distance 1 (lengths differ) or 2 (lengths equal) are checked letter by letter.
   Each group sends one row a word: how many near words it has there and which has the largest n.
5. *Forms.* A word's form is its near word of largest n, if that is at least twice its own; following forms
   (pointer jumping, as each step at least doubles n) gives the root.

Defined results: a null or empty text has no words; a null doc_id counts as the empty string in the
checksum; texts and words have no length limit; repeated rows count each time; ties go to the word smallest in
code-point order; an empty table gives no rows. Other columns of the table are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import bounded_batches, staged

MIN_LETTERS = 5
MIN_COUNT = 3
DROP_EVERY = 97
MIN_RATIO = 2
#: Words of a tile, and distinct words that a task holds before it passes its counts on.
TILE_WORDS = 32768
HELD_WORDS = 200_000
#: Letters of the coarse classes (what is in none is a class of its own) and of the fine ones, each of similar frequency.
COARSE = ("aeiou", "lnrst")
FINE = ("a", "e", "i", "o", "u", "n", "r", "t", "s", "ld", "cm", "gph")

RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters that a word can hold: a-z after lower-casing, and U+00C0 to U+00FF.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_COLUMN = np.zeros(0x100, np.int64)
_COLUMN[LETTERS] = np.arange(len(LETTERS))


# ---- words ----------------------------------------------------------------------------------------------------

def lowered(text: str) -> str:
    """A-Z in lower case, nothing else changed (``bytes.lower`` is for ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def with_deletion(run: str, doc_id: int | None, every: int = DROP_EVERY) -> str:
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
          min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    bounded_batches(docs.sparkSession)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                           pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for run, k in Counter(m.group() for m in RUN.finditer(lowered(text.as_py() or ""))).items():
                    word = with_deletion(run, doc_id)
                    if len(word) >= min_letters:
                        held[word] += k
                if len(held) >= HELD_WORDS:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- blocks ---------------------------------------------------------------------------------------------------

def letters_in(word: Column, letters: str) -> Column:
    return F.char_length(word) - F.char_length(F.translate(word, letters, ""))


def class_counts(counts: np.ndarray, classes: tuple[str, ...]) -> np.ndarray:
    """(words, classes) from letter counts."""
    return np.stack([counts[:, _COLUMN[[ord(x) for x in letters]]].sum(axis=1) for letters in classes], axis=1) \
        if classes else np.zeros((len(counts), 0), np.int64)


def steps(classes: int) -> list[tuple[int, ...]]:
    """Half of the ways in which one edit changes (length, class counts): none, and what stands behind it in
    lexical order; the other half are the same pairs from the other side."""
    unit = [tuple(int(i == j) for j in range(classes)) for i in range(classes)]
    zero = (0,) * classes
    kept = {zero, *unit, *(tuple(-x for x in u) for u in unit)}  # a letter of no class takes the other side
    kept |= {tuple(x - y for x, y in zip(u, v)) for u in unit for v in unit}
    return [(0, *s) for s in sorted(kept) if s >= zero] + [(1, *s) for s in [zero, *unit]]


def tile_pairs(vocabulary: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """(pair columns, side, word, n): each word once for every pair of tiles to compare it in; side 0 and 1, or 2 for a
    tile compared with itself."""
    names = ["len", *(f"c{i}" for i in range(len(COARSE)))]
    blocked = vocabulary.select("word", "n", F.char_length("word").alias("len"),
                                *[letters_in(F.col("word"), c).alias(f"c{i}") for i, c in enumerate(COARSE)])
    blocked = staged(blocked, "words")
    # a row for each length and coarse counts
    sizes = staged(blocked.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / tile_words).cast("int").alias("tiles")), "blocks")
    # adjacent occupied blocks: (block, step) -> the other block
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps(len(COARSE))])).alias("step")
    ahead = sizes.select(*names, F.col("tiles").alias("tiles_a"), step).select(
        *[F.col(x).alias(f"{x}_a") for x in names], "tiles_a", "step",
        *[(F.col(x) + F.col("step")[i]).alias(x) for i, x in enumerate(names)])
    both = ahead.join(sizes, names).select(
        *[F.col(f"{x}_a") for x in names], *[F.col(x).alias(f"{x}_b") for x in names], "tiles_a", "tiles")
    same = F.lit(True)
    for x in names:
        same = same & (F.col(f"{x}_a") == F.col(f"{x}_b"))
    tiles = both.select("*", same.alias("same"), F.explode(F.sequence(F.lit(0), F.col("tiles_a") - 1)).alias("ta")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tb")) \
        .filter("not same or ta <= tb")
    tiles = staged(tiles.withColumn("pair", F.monotonically_increasing_id()), "tile-pairs")
    side_a = tiles.select(*[F.col(f"{x}_a").alias(x) for x in names], F.col("ta").alias("tile"), "pair",
                          F.when(F.col("same") & (F.col("ta") == F.col("tb")), 2).otherwise(0).alias("side"))
    side_b = tiles.filter("not (same and ta = tb)").select(
        *[F.col(f"{x}_b").alias(x) for x in names], F.col("tb").alias("tile"), "pair", F.lit(1).alias("side"))
    dealt = blocked.join(sizes, names).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    return dealt.join(side_a.union(side_b), [*names, "tile"]).select("pair", "side", "word", "n")


# ---- pairs inside a group -------------------------------------------------------------------------------------

class Words:
    """Words of one length as code points, letter counts and fine pieces."""

    def __init__(self, ws: list[str]):
        length = len(ws[0]) if ws else 0
        self.codes = np.array(ws, f"<U{max(1, length)}").view(np.uint32).reshape(len(ws), -1).astype(np.uint8)
        self.counts = np.zeros((len(ws), len(LETTERS)), np.float32)
        at = np.arange(len(ws))
        for column in self.codes.T if ws else ():
            self.counts[at, _COLUMN[column]] += 1
        self.square = (self.counts * self.counts).sum(axis=1)
        key = class_counts(self.counts.astype(np.int64), FINE)
        order = np.lexsort(key.T[::-1]) if len(ws) else at
        self.pieces: dict[tuple, np.ndarray] = {}
        if len(ws):
            cuts = np.flatnonzero((np.diff(key[order], axis=0) != 0).any(axis=1)) + 1
            self.pieces = {tuple(key[p[0]].tolist()): p for p in np.split(order, cuts)}


def _edits(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b, of equal length or b's one longer, are one edit apart."""
    x, y = a.codes[i], b.codes[j]
    length = x.shape[1]
    if y.shape[1] == length:
        return (x != y).sum(axis=1) == 1
    head = np.cumprod(x == y[:, :length], axis=1, dtype=np.int32).sum(axis=1)
    tail = np.cumprod(x[:, ::-1] == y[:, 1:][:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
    return head + tail >= length


def near_pairs(a: Words, b: Words, same: bool, step: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of words one edit apart, b's of equal length or one letter longer; with ``same``, a and b
    are one tile and each pair comes once."""
    if not a.pieces or not b.pieces:
        return
    longer = b.codes.shape[1] > a.codes.shape[1]
    ways = [s[1:] for s in steps(len(FINE)) if s[0] == longer]
    if not longer and not same:  # both directions
        ways = sorted({*ways, *(tuple(-x for x in s) for s in ways)})
    apart = 1 if longer else 2
    for key, rows in a.pieces.items():
        others = [b.pieces[k] for s in ways if (k := tuple(x + y for x, y in zip(key, s))) in b.pieces]
        if not others:
            continue
        near = np.concatenate(others)
        for lo in range(0, len(rows), max(1, step // len(near))):
            part = rows[lo:lo + max(1, step // len(near))]
            gram = a.counts[part] @ b.counts[near].T
            i, j = np.nonzero(gram * 2 == a.square[part, None] + b.square[near][None, :] - apart)
            i, j = part[i], near[j]
            keep = _edits(a, b, i, j)
            if same:  # the piece itself gives its pairs in both directions
                keep &= (i < j) | ~_in_piece(j, rows)
            if keep.any():
                yield i[keep], j[keep]


def _in_piece(j: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.isin(j, rows)


def compare(g: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words of a pair of tiles that have near words in it."""
    g = g.combine_chunks()
    side, ws, n = g.column("side").to_numpy(), g.column("word").to_pylist(), g.column("n").to_numpy()
    same = bool((side == 2).any())
    left = np.flatnonzero(side != 1)
    right = left if same else np.flatnonzero(side == 1)
    a = Words([ws[i] for i in left])
    b = a if same else Words([ws[i] for i in right])
    found = list(near_pairs(a, b, same))
    i = left[np.concatenate([x for x, _ in found])] if found else np.empty(0, np.int64)
    j = right[np.concatenate([y for _, y in found])] if found else np.empty(0, np.int64)
    of, other = np.concatenate([i, j]), np.concatenate([j, i])
    place = np.empty(len(ws), np.int64)
    place[sorted(range(len(ws)), key=ws.__getitem__)] = np.arange(len(ws))
    order = np.lexsort((place[other], -n[other], of)) if len(of) else np.empty(0, np.int64)
    of, other = of[order], other[order]
    start = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.empty(0, np.int64)
    counts = np.diff(np.append(start, len(of)))
    return pa.table({"word": pa.array([ws[x] for x in of[start]], pa.string()), "n_near": pa.array(counts, pa.int64()),
                     "best_n": pa.array(n[other[start]], pa.int64()),
                     "best": pa.array([ws[x] for x in other[start]], pa.string())})


# ---- forms ----------------------------------------------------------------------------------------------------

def variants(vocabulary: DataFrame, tile_words: int = TILE_WORDS, ratio: int = MIN_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``vocabulary`` (word, n)."""
    vocabulary = staged(vocabulary.select("word", "n"), "vocabulary")
    near = tile_pairs(vocabulary, tile_words).groupBy("pair").applyInArrow(
        compare, "word string, n_near long, best_n long, best string")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))).alias("b"))
    enough = -F.col("b.k") >= ratio * F.col("n")
    rows = staged(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("b.w")).alias("form"),
        F.when(enough, -F.col("b.k")).alias("form_n")), "forms")
    # Pointer jumping: each round doubles the steps that ``to`` is ahead of its word.
    links = rows.filter("form is not null").select("word", F.col("form").alias("to"))
    while True:
        links = staged(links, "links")
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if not links.join(ahead, "to", "left_semi").limit(1).count():
            break
        links = links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"))
    return rows.join(links, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    return variants(words(docs)).select("word", "form", "root", "n", "n_near", "form_n")


def brute_force(rows: list[tuple], min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                every: int = DROP_EVERY, ratio: int = MIN_RATIO) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n) from all pairs of words; rows are (doc_id, text). For small inputs."""
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= min_letters and k >= min_count}

    def one_edit(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}
