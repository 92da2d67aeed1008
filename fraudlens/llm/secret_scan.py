"""Secret scan: patterns, and novelty under a dictionary-primed zstandard.

The *base* patterns find assignments to password-like names, access keys and
long hexadecimal strings. The *method* looks at every other string of 16 or more
characters of ``[A-Za-z0-9+/_.=-]`` that stands in a sensitive context (a
credential word within the 48 characters before it): its marginal cost is what it
adds to the output of a zstandard compressor that is primed with a dictionary of
common identifiers and with the text around the string. Names, paths, version numbers
and words repeat what the dictionary or the surroundings hold and cost little;
keys do not compress. A string that costs ``MIN_NOVELTY`` of its length or more
and mixes letters and digits is reported as kind ``novel``.

Random text over a small alphabet costs less than its length once a Huffman table
pays off, so this alone would lose long keys, hexadecimal ones most of all. Other
strings are judged in pieces of ``PIECE`` characters against what random strings of
the same length and alphabet cost; one piece that costs as much makes the string
``novel``. Pieces need no digits, but no piece counts whose letter pairs are likelier
in words, which are too short to compress by themselves, than in random letters. How
often pairs follow each other in words is counted over all texts, whatever their
languages, and over the identifiers.

Defined results: null and empty texts have no spans; spans of one kind never
overlap; what base spans cover of a string is not reported again, and what they leave
of it, in stretches of 16 characters or more, is judged like a string; repeated
documents each get their row. Offsets are code points, ends exclusive. Texts
are scanned whole, one at a time, and not moved; without any text the identifiers alone say what words are.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Runs are maximal, so asking for the length in the pattern drops what a later filter would.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

CANDIDATE_LEN = 16
CONTEXT = 48
SURROUND = 256
MIN_NOVELTY = 0.95
#: Characters judged at once, and random strings whose cheapest is their reference.
PIECE = 32
REFERENCES = 32
#: Neighbouring letters from which a piece tells whether it is made of words.
LEAST_PAIRS = 4
_LETTERS = len(string.ascii_lowercase)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE_LEN)
# Words that make a context sensitive.
_SENSITIVE = re.compile(
    r"password|passwd|passphrase|pwd|secret|token|api.?key|private.?key|access.?key|credential|bearer|"
    r"authorization|client.?id|signature|connection.?string", re.I | re.A)
# Identifiers and words that code and configuration around secrets repeat.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key client_id "
    "client_secret credentials authorization bearer basic signature connection_string username user host "
    "localhost port database config configuration environment variable default example application service "
    "account session request response header content-type application/json charset=utf-8 function return "
    "import from class self const static public private string integer boolean true false null none value "
    "index length number array object error message version release update install package module library "
    "https:// http:// www. .com .org .net .html .json .yaml .properties /usr/local/bin /etc/ /home/ /var/log/ "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2024-01-01 00:00:00 127.0.0.1").encode()

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each base pattern that are long enough."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def alphabet_of(own: str) -> str:
    """The characters a string of this kind draws from: whole groups of digits, hexadecimal or
    all letters of a case, and the marks that it holds."""
    out = string.digits if any(c.isdigit() for c in own) else ""
    letters = {c for c in own if c.isalpha()}
    hexadecimal = bool(out) and letters <= set("abcdefABCDEF")
    for all_of, first in ((string.ascii_uppercase, "ABCDEF"), (string.ascii_lowercase, "abcdef")):
        if letters & set(all_of):
            out += first if hexadecimal else all_of
    return out + "".join(sorted({c for c in own if not c.isalnum()}))


def letter_pairs(data: bytes) -> np.ndarray:
    """Counts of neighbouring ASCII letters, either case, at 26 * first + second. Runs as long as a
    candidate do not count: they may be keys."""
    codes = np.frombuffer(data.lower(), np.uint8).astype(np.int64) - ord("a")
    inside = (codes >= 0) & (codes < _LETTERS)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    for a, b in edges.reshape(-1, 2)[np.diff(edges)[::2] >= CANDIDATE_LEN]:
        inside[a:b] = False
    pairs = inside[:-1] & inside[1:]
    return np.bincount(codes[:-1][pairs] * _LETTERS + codes[1:][pairs], minlength=_LETTERS ** 2)


def corpus_pairs(docs: DataFrame, text_col: str = "text") -> list[int]:
    """:func:`letter_pairs` over all texts: one row a task and pair is shuffled, and 676 sums reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_LETTERS ** 2, np.int64)
        for b in batches:
            for text in b["text"]:
                if text:
                    total += letter_pairs(text.encode("utf-8", "replace"))
        yield pd.DataFrame({"pair": np.arange(len(total)), "n": total})

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "pair int, n long") \
        .groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = [0] * _LETTERS ** 2
    for r in found:
        out[r["pair"]] = r["n"]
    return out


def pair_bits(identifiers: bytes, corpus: Sequence[int] | None = None) -> list[float]:
    """For each pair of letters, how many bits likelier it is in words than in random letters. Words
    are half those of the identifiers and half the corpus's."""
    shares = []
    for counts in (letter_pairs(identifiers), np.array(corpus if corpus is not None else [0])):
        if counts.sum():
            n = counts + 0.5
            shares.append(n / n.sum())
    return np.log2(np.mean(shares, axis=0) * _LETTERS ** 2).tolist()


class Novelty:
    """Marginal compressed size under identifiers and surroundings."""

    def __init__(self, identifiers: bytes = IDENTIFIERS, corpus: Sequence[int] | None = None):
        self._identifiers = identifiers
        self._bits = pair_bits(identifiers, corpus)
        self._frame = len(self._compress(b"", b""))
        self._references: dict[tuple[str, int], float] = {}

    def _compress(self, surroundings: bytes, own: bytes) -> bytes:
        primer = zstandard.ZstdCompressionDict(self._identifiers + b"\n" + surroundings,
                                               dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False, write_checksum=False,
                                        write_dict_id=False).compress(own)

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to a compressor that has seen what
        surrounds it, per byte of it."""
        around = text[max(0, start - SURROUND):start] + "\n" + text[end:end + SURROUND]
        own = text[start:end].encode()
        return (len(self._compress(around.encode("utf-8", "replace"), own)) - self._frame) / len(own)

    def reference(self, alphabet: str, n: int) -> float:
        """The least that random strings of ``n`` characters of the alphabet cost per byte."""
        key = alphabet, n
        if key not in self._references:
            rng = random.Random(f"{alphabet} {n}")
            keys = ("".join(rng.choices(alphabet, k=n)) for _ in range(REFERENCES))
            self._references[key] = min(self.of(k, 0, n) for k in keys)
        return self._references[key]

    def wordy(self, own: str) -> bool:
        """Its neighbouring letters are likelier in words than in random letters; hexadecimal strings hold no words."""
        low = own.lower()
        if not set(low) - set("0123456789abcdef"):
            return False
        pairs = [(ord(x) - 97) * _LETTERS + ord(y) - 97 for x, y in zip(low, low[1:]) if x.isalpha() and y.isalpha()]
        return len(pairs) >= LEAST_PAIRS and sum(self._bits[p] for p in pairs) > 0

    def random_like(self, text: str, start: int, end: int) -> bool:
        """A piece of text[start:end] that is not made of words costs what a random string does."""
        n = min(PIECE, end - start)
        for a in [*range(start, end - n, n), end - n]:  # the last piece is whole too
            own = text[a:a + n]
            if len(set(own)) > n // 6 and 2 * sum(map(str.isalnum, own)) >= n and not self.wordy(own) and \
                    self.of(text, a, a + n) >= MIN_NOVELTY * self.reference(alphabet_of(own), n):
                return True
        return False


def stretches(start: int, end: int, taken: list[tuple[int, int]], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What sorted spans leave of [start, end), where it is long enough; ``ends``: their running greatest ends."""
    for i in range(bisect_right(ends, start), len(taken)):
        a, b = taken[i]
        if a >= end:
            break
        if a - start >= CANDIDATE_LEN:
            yield start, a
        start = max(start, b)
    if end - start >= CANDIDATE_LEN:
        yield start, end


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int]]:
    """Incompressible strings in a sensitive context, without what base spans cover."""
    out = []
    if not _SENSITIVE.search(text):
        return out
    base = sorted((a, b) for _, a, b in taken)
    ends = list(accumulate((b for _, b in base), max))
    for m in _CANDIDATE.finditer(text):
        if not _SENSITIVE.search(text, max(0, m.start() - CONTEXT), m.start()):
            continue
        for s, e in stretches(*m.span(), base, ends):
            own = text[s:e]
            mixed = any(c.isdigit() for c in own) and any(c.isalpha() for c in own)
            if mixed and novelty.of(text, s, e) >= MIN_NOVELTY or novelty.random_like(text, s, e):
                out.append(("novel", s, e))
    return out


def scan_text(text: str | None, novelty: Novelty) -> list[tuple[str, int, int]]:
    """All spans, ordered by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    spans = base_spans(text)
    spans += novel_spans(text, spans, novelty)
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan_udf(corpus: list[int]):
    @F.pandas_udf(_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty(corpus=corpus)
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end"), x)) for x in scan_text(t, novelty)] for t in texts],
                            dtype=object)

    return run


def scan(docs: DataFrame, text_col: str = "text", result: str = "secrets") -> DataFrame:
    """``docs`` with a column ``result``: array of (kind, start, end). The texts are read twice, first for
    their letter pairs."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(result, _scan_udf(corpus_pairs(docs, text_col))(F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    s = F.col("secrets")

    def line(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")

    return scan(docs.select("doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(line(F.filter(s, lambda x: x["kind"] != "novel")), 256).alias("base_sha256"),
        line(s).alias("spans"), count("novel").alias("n_novel"))
