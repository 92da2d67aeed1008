import hashlib
import random

import pytest
import zstandard
from llm_data import sentence

from fraudlens.llm import files, warc
from fraudlens.llm.common import shared_folder

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(2)
    big = [f"<html><body><p>{sentence(rng, 200)}</p></body></html>" for _ in range(30)]
    rows = [(i, f"https://h{i % 3}.example.org/p/{i}", big[i]) for i in range(30)]
    rows += [(100 + i, "https://copy.example.org/a b\r\nX: y", big[0]) for i in range(25)]  # a large group of copies
    rows += [(200 + i, None, "<p>short</p>") for i in range(5)]
    rows += [(300, "u", None), (301, "u", ""), (None, "u", big[1]), (None, None, "z" * 2000), (None, None, "z" * 2000),
             (400, "u", "é" * 500), (401, "u", "é" * 500), (402, "u", "x" * 999), (403, "u", "x" * 999),
             (500, "long", sentence(rng, 60_000)), (100, "https://repeated.example.org", big[0]),
             (124, "https://tie.example.org", big[0])]
    # ids that a double cannot hold, beside null ids
    rows += [(2 ** 53 + 1, "u", big[2]), (2 ** 53 - 1, "u", big[2]), (2 ** 63 - 1, "u", big[3]), (2 ** 63 - 2, "u", big[3]),
             (-2 ** 63, "u", big[3]), (2 ** 63 - 3, "u", "alone" * 300)]
    return rows


def expected(rows):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [i for i in groups[data] if i is not None]
        leader = max(ids) if ids and len(groups[data]) > 1 and len(data) >= 1000 else None
        revisit = leader is not None and page_id != leader
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                    leader if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.report(df).collect()), key=str) == expected(pages())
    assert warc.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_roll_and_every_record_is_read_alone(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 8_000)
    folder = shared_folder(spark, "warc-test")
    df = spark.createDataFrame(pages(), SCHEMA).repartition(1)
    index = warc.write_archives(df, folder, index=True).collect()
    assert len(index) == len(pages()) and len({r.file for r in index}) > 3
    for r in index:
        with files.open_file(r.file) as f:
            rec = warc.record_at(f, r.offset, r.length)
            assert rec.startswith(b"WARC/1.1\r\n") and rec.endswith(b"\r\n\r\n")
            assert (f"Page-ID: {r.page_id}\r\n".encode() in rec) == (r.page_id is not None)


def test_the_dictionary_leads_the_file_and_is_needed(spark):
    folder = shared_folder(spark, "warc-test")
    rng = random.Random(8)
    rows = [(i, f"https://a.example.org/{i}", f"<html><nav>menu of the site</nav><p>{sentence(rng, 60)}</p></html>")
            for i in range(400)]
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, index=True).collect()
    (file,) = {r.file for r in index}
    with files.open_file(file) as f:
        dictionary, start = warc.dictionary_of(f)
        assert dictionary is not None and start == min(r.offset for r in index)
        f.seek(index[0].offset)
        frame = f.read(index[0].length)
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(frame)
    alone = sum(len(zstandard.compress(warc.record(*r[:2], r[2].encode(), hashlib.sha1(r[2].encode()).hexdigest(), None)))
                for r in rows)
    assert sum(r.length for r in index) < 0.8 * alone


def test_dictionary_without_enough_samples():
    assert warc.train_dictionary([]) is None
    assert warc.train_dictionary([b"abc"]).as_bytes() == b"abc"


def test_urls_cannot_break_headers():
    rec = warc.record(1, "http://x/\r\nWARC-Type: evil y", b"p", "d", None)
    assert b"WARC-Target-URI: http://x/%0D%0AWARC-Type:%20evil%20y\r\n" in rec


def test_large_ids_equal_the_sql(spark):
    import duckdb
    df = spark.createDataFrame(pages(), SCHEMA).repartition(2)
    got = sorted(map(tuple, warc.report(df).collect()), key=str)
    frame = __import__("pandas").DataFrame({"page_id": [None if r[0] is None else str(r[0]) for r in pages()],
                                            "html": [r[2] for r in pages()]})
    con = duckdb.connect()
    con.register("raw", frame)
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, html FROM raw")
    assert sorted(con.execute(warc.ORACLE).fetchall(), key=str) == got


def test_clashing_columns(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(pages(), SCHEMA)
    for name in ("digest", "leader", "bytes", "n", "refers_to"):
        df = df.withColumn(name, F.lit(name))
    assert sorted(map(tuple, warc.report(df).collect()), key=str) == expected(pages())
