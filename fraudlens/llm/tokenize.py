"""Word-cached encoding with a public tokenizer.

``word_bpe_49k.json`` lower-cases, drops white space and encodes runs of letters,
single digits and runs of other characters on their own, so a text's ids are its
pieces' ids in order. Encoding each distinct piece once and joining gives the
same ids as encoding the text, several times faster. Pieces are cut only where
the tokenizer certainly cuts: at ASCII white space, and between a letter of
ASCII or Latin-1 and an ASCII punctuation mark other than the apostrophe. Texts
with the marks of special tokens are cut at white space only, in their own case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
#: Entries of each of the cache's two generations, and the longest that is kept: the bound of a worker's memory.
CACHE_ENTRIES = 400_000
CACHE_BYTES_AN_ENTRY = 48
#: Bytes of unknown pieces that are encoded in one call.
CHUNK = 1 << 16

_LETTER = rb"(?:(?<=[a-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))"
_LETTER_THEN_MARK = re.compile(_LETTER + rb"(?=[!-&(-/:-@\[-`{-~])")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this process: a Python worker runs many tasks, and the
    pieces that one has met serve the next."""
    return WordEncoder(path)


def _ends_in_letter(word: bytes) -> bool:
    """Whether a lower-cased word ends in a letter of ASCII or Latin-1."""
    last = word[-1]
    return 97 <= last <= 122 or len(word) > 1 and word[-2] == 0xC3 and 0x80 <= last <= 0xBF \
        and last != 0x97 and last != 0xB7


class WordEncoder:
    """text -> ids as little-endian unsigned 32-bit integers.

    The cache has two generations: when the younger is full it becomes the older
    one, whose entries come back as they are asked for."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._marks = {44: self._ids(","), 46: self._ids(".")}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        special = b"<|" in raw
        words = (raw if special else raw.lower()).split()
        get, marks = self._young.get, self._marks
        got = list(map(get, words))
        if None in got:
            unknown: dict[bytes, list[int]] = {}
            for i, x in enumerate(got):
                if x is None:
                    w = words[i]
                    if w[-1] in marks and len(w) > 1 and not special and _ends_in_letter(w[:-1]):
                        x = get(w[:-1])
                        if x is not None:
                            got[i] = x + marks[w[-1]]
                            continue
                    unknown.setdefault(w, []).append(i)
            for w, x in self._unknown(unknown, special):
                for i in unknown[w]:
                    got[i] = x
        return b"".join(got)

    def _unknown(self, words: Iterable[bytes], special: bool) -> Iterator[tuple[bytes, bytes]]:
        known: dict[bytes, bytes] = {}
        cut: dict[bytes, list[bytes]] = {}
        ask = set()
        for w in words:
            cut[w] = [w] if special or w.isalpha() else _LETTER_THEN_MARK.sub(b" ", w).split(b" ")
            for p in cut[w]:
                if p not in known:
                    x = self._young.get(p)
                    if x is None and (x := self._old.get(p)) is None:
                        ask.add(p)
                    else:
                        known[p] = x
        known.update(self._encode_pieces(ask))
        for p, x in known.items():
            if len(p) <= CACHE_BYTES_AN_ENTRY and not special:
                self._young[p] = x
        if len(self._young) >= CACHE_ENTRIES:
            self._old, self._young = self._young, {}
        for w, parts in cut.items():
            yield w, known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def _encode_pieces(self, pieces: set[bytes]) -> list[tuple[bytes, bytes]]:
        out, plain, size = [], [], 0
        for p in pieces:
            if len(p) > CACHE_BYTES_AN_ENTRY or b"<|" in p or not p.isascii() and max(p.decode()) >= "̀":
                out.append((p, self._ids(p.decode())))
                continue
            plain.append(p)
            size += len(p) + 1
            if size >= CHUNK:
                out += self._encode_plain(plain)
                plain, size = [], 0
        return out + self._encode_plain(plain)

    def _ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_plain(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Pieces without combining characters, in one call; the ids' offsets tell whose they are."""
        if not pieces:
            return []
        texts = [p.decode() for p in pieces]
        e = self._tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        ids = np.array(e.ids, "<u4")
        first = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
        cuts = [*np.searchsorted(first, begins).tolist(), len(ids)]
        joined = ids.tobytes()
        return [(p, joined[4 * a:4 * b]) for p, a, b in zip(pieces, cuts, cuts[1:])]
