import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from llm_data import awkward_rows, clashing, docs
from tokenizers import Tokenizer

from fraudlens.llm import files, token_output
from fraudlens.llm.common import shared_folder
from fraudlens.llm.tokenize import tokenizer_path


def encoded():
    own = Tokenizer.from_file(tokenizer_path())
    return [(r[0], np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in awkward_rows()]


def test_round_trip_in_the_order_of_ids(spark):
    got = sorted(token_output.report(clashing(docs(spark)).repartition(5)).collect(), key=lambda r: r.start)
    want = encoded()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    ids = [float("inf") if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_output.report(docs(spark, [])).collect() == []


def test_files_are_plain_zstandard_with_a_seek_table(spark):
    folder = shared_folder(spark, "tokens-test")
    manifest = token_output.write_token_files(docs(spark), folder).orderBy("part").collect()
    assert sum(r.n_docs for r in manifest) == len(awkward_rows())
    total = 0
    for r in manifest:
        with files.open_file(r.file) as f:
            data = f.read()
            reader = token_output.FrameReader(f)
            assert len(reader) == r.n_docs
            whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
            assert len(whole) == 4 * r.n_tokens and r.start == total
            assert b"".join(reader.content(i) for i in range(len(reader))) == whole
            first = reader.content(0)
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        assert (n, flags, magic) == (r.n_docs + 1, 0x80, 0x8F92EAB1)
        assert reader.entries[0]["checksum"] == xxhash.xxh64_intdigest(first) & 0xFFFFFFFF
        total += r.n_tokens


def test_only_requested_documents_are_decompressed(spark, monkeypatch):
    folder = shared_folder(spark, "tokens-test")
    manifest = token_output.write_token_files(docs(spark), folder)
    got = {r.doc_id: r.ids for r in token_output.documents_in(manifest, [3, 305, 999]).collect()}
    want = {i: x.tolist() for i, x in encoded()}
    assert got == {3: want[3], 305: want[305]}


def test_a_changed_frame_is_noticed(tmp_path):
    path = str(tmp_path / "t.zst")
    with files.new_file(path) as out:
        w = token_output.FrameWriter(out)
        w.add(1, b"\1\0\0\0" * 10)
        w.add(None, b"")
        w.close()
    data = bytearray(open(path, "rb").read())
    with files.open_file(path) as f:
        r = token_output.FrameReader(f)
        assert r.doc_ids == [1, None] and r.content(1) == b""
        r.entries = r.entries.copy()
        r.entries["checksum"][0] ^= 1
        with pytest.raises(ValueError):
            r.content(0)
    with pytest.raises(ValueError):
        bad = str(tmp_path / "bad.zst")
        open(bad, "wb").write(data[:-1] + b"\0")
        with files.open_file(bad) as f:
            token_output.FrameReader(f)


def test_files_appear_only_when_complete(tmp_path):
    path = str(tmp_path / "x")
    with pytest.raises(RuntimeError):
        with files.new_file(path) as out:
            out.write(b"half")
            raise RuntimeError
    assert list(tmp_path.iterdir()) == []


def test_large_ids_beside_null_ids(spark):
    ids = [2 ** 53 + 1, 2 ** 53 - 1, 2 ** 63 - 1, -2 ** 63, None, None, 5, 2 ** 62 + 1]
    rows = [(i, f"text number {k}", None, None, None) for k, i in enumerate(ids)]
    own = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()))
                   for i, t, *_ in rows)
    for parts in (1, 4):
        got = token_output.report(docs(spark, rows).repartition(parts)).collect()
        assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    manifest = token_output.write_token_files(docs(spark, rows).coalesce(1), shared_folder(spark, "tokens-test"))
    assert {r.doc_id for r in token_output.documents_in(manifest, [2 ** 53 + 1, 2 ** 63 - 1]).collect()} == {
        2 ** 53 + 1, 2 ** 63 - 1}
