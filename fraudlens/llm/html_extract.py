"""Main text by differencing each page with the page of the nearest URL.

1. Pages become lines with zones (``html_lines``): inside an article, inside
   elements that are not the article, undecided.
2. Pages of a host with equal lines and zones are one page, under their first path,
   and get one verdict. Pages are sorted by host and URL path and numbered by range
   partitions and running totals, so a host with most pages is spread like any other.
   Only line hashes move.
3. Neighbours by number that share ``COPY_SHARE`` of the characters of both are copies,
   which tell nothing about templates; they form runs. A page is aligned with the page
   before its run and the one after it by the longest common subsequence of their lines.
   The nearer one (longer common path prefix, the earlier one on ties) of which the page
   shares less than ``COPY_SHARE`` of itself decides. A short page may share more with
   every other one: then what it shares with both decides. If neither says anything and
   one is a copy after all, the page beyond that one's run is taken, and so on.
4. Shared lines are template lines and are deleted, unless the markup places them
   in an article: articles of one host quote and repeat each other. What neighbours
   do not share but the markup places in menus, footers, adverts etc. goes as well.

Defined results: pages have no length limit; a null or empty html has the empty text; pages without a host (null urls
included) have no neighbour, and pages without lines are none; a host of copies only keeps its undecided lines; equal
rows are one page for the pairing and each get a row; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.llm.common import bounded_batches, staged
from fraudlens.llm.html_lines import ARTICLE, UNDECIDED, lines

#: Share of characters in shared lines from which two pages are copies, each of the other.
COPY_SHARE = 0.8
#: Cells of an alignment table that is kept whole; larger ones are halved first.
TABLE_CELLS = 1 << 28

_LINES = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())),
                       T.StructField("chars", T.ArrayType(T.IntegerType())),
                       T.StructField("open", T.ArrayType(T.IntegerType()))])
_VERDICT = T.StructType([T.StructField("template", T.ArrayType(T.IntegerType())),
                         T.StructField("on_before", T.BooleanType()), T.StructField("on_after", T.BooleanType())])


# ---- alignment ------------------------------------------------------------------------------------------------

def _bit_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each element of ``a``: bits, one for each element of ``b``; the zero
    bits up to j count the common subsequence with b[:j+1]."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(row: int, n: int) -> list[int]:
    """Common-subsequence lengths with b[:0], b[:1], ..., b[:n]."""
    out, k = [0], 0
    for c in reversed(bin(row)[2:].zfill(n)) if n else ():
        k += c == "0"
        out.append(k)
    return out


def common_subsequence(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are cut off, and elements that only one side has; bit rows give
    the table, and a large table is halved (Hirschberg), so memory is bounded."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    in_a, in_b = set(a[lo:len(a) - hi]), set(b[lo:len(b) - hi])
    at = [i for i in range(lo, len(a) - hi) if a[i] in in_b]
    inner = _align([a[i] for i in at], [y for y in b[lo:len(b) - hi] if y in in_a])
    return [*range(lo), *[at[i] for i in inner], *range(len(a) - hi, len(a))]


def _align(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > TABLE_CELLS:
        half = len(a) // 2
        *_, row = _bit_rows(a[:half], b)
        *_, back = _bit_rows(a[half:][::-1], b[::-1])
        left, right = _lengths(row, len(b)), _lengths(back, len(b))[::-1]
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[j])
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    rows = list(_bit_rows(a, b))
    out, j = [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # the common subsequence grows at the last zero bit up to j; this row made it if the row before did not
        mask = (2 << j) - 1 if j >= 0 else 0
        zeros = ~rows[i] & mask
        if not zeros:
            break
        before = ~rows[i - 1] & mask if i else 0
        if before.bit_count() < zeros.bit_count():
            j = zeros.bit_length() - 1
            while b[j] != a[i]:
                j -= 1
            out.append(i)
            j -= 1
    return out[::-1]


# ---- steps on Spark -------------------------------------------------------------------------------------------

def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@F.pandas_udf(_LINES)
def _line_hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for html in pages:
            found = lines(html)
            rows.append(([line_hash(t) for t, _ in found], [len(t) for t, _ in found],
                         [i for i, (_, z) in enumerate(found) if z != ARTICLE]))
        yield pd.DataFrame(rows, columns=_LINES.fieldNames())


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def is_copy(own: list[int], chars: list[int], other: list[int], other_chars: int) -> bool:
    """The lines that both pages have, in order, make up most of each."""
    least = COPY_SHARE * max(sum(chars), other_chars)
    there = set(other)
    if sum(c for h, c in zip(own, chars) if h in there) < least:
        return False
    return sum(chars[i] for i in common_subsequence(own, other)) >= least


def template_lines(own: list[int], chars: list[int], path: str,
                   neighbours: list[tuple[str, list[int], int] | None]) -> tuple[list[int], list[bool]]:
    """Positions of template lines, and for each neighbour whether to look on beyond it;
    ``neighbours``: (path, line hashes, characters) or nothing, the earlier one first."""
    size = sum(chars)
    there = [i for i, x in enumerate(neighbours) if x is not None]
    on, most = [False] * len(neighbours), []
    for i in sorted(there, key=lambda i: -common_prefix(path, neighbours[i][0])):
        _, other, other_chars = neighbours[i]
        shared = common_subsequence(own, other)
        n = sum(chars[k] for k in shared)
        if n < COPY_SHARE * size:
            return shared, [False] * len(neighbours)
        on[i] = n >= COPY_SHARE * max(size, other_chars)
        most.append(shared)
    if any(on) or len(there) < 2:
        return [], on
    return sorted(set(most[0]).intersection(*most[1:])), on


@F.pandas_udf(T.BooleanType())
def _is_copy(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for own, chars, other, other_chars in batches:
        yield pd.Series([x is not None and is_copy(list(h), list(c), list(x), int(n))
                         for h, c, x, n in zip(own, chars, other, other_chars)], dtype=bool)


@F.pandas_udf(_VERDICT)
def _template(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for own, chars, open_, path, *near in batches:
        out = []
        for h, c, u, p, *x in zip(own, chars, open_, path, *near):
            sides = [None if lines_ is None else (q, list(lines_), int(n)) for q, lines_, n in (x[:3], x[3:])]
            open_lines = set(u)
            found, on = template_lines(list(h), list(c), p, sides) if open_lines else ([], [False, False])
            out.append(([int(i) for i in found if i in open_lines], *on))
        yield pd.DataFrame(out, columns=_VERDICT.fieldNames())


def main_text(html: str | None, template: list[int]) -> str:
    """Article lines, and undecided lines that are not in ``template``, joined by one space."""
    drop = set(template)
    return " ".join(t for i, (t, z) in enumerate(lines(html))
                    if z == ARTICLE or z == UNDECIDED and i not in drop)


@F.pandas_udf(T.StringType())
def _main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, templates in batches:
        yield pd.Series([main_text(h, t if t is not None else ()) for h, t in zip(pages, templates)], dtype=object)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path): without scheme, user, query, fragment and trailing slashes."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    found = F.regexp_extract(rest, r"^//([^/?#]*)([^?#]*)", 1)
    host = F.nullif(F.lower(F.regexp_replace(found, r"^.*@", "")), F.lit(""))
    return host, F.regexp_replace(F.regexp_extract(rest, r"^//([^/?#]*)([^?#]*)", 2), r"/+$", "")


def runs(ranked: DataFrame) -> DataFrame:
    """(rank, before, after): the ranks before and after the run of copies that a rank is in.

    Runs end where a page and the one before it are no copies; running extremes inside
    the range partitions, and over one row a partition, carry the ends."""
    pair = ranked.join(_beside(ranked, "before").withColumn("rank", F.col("before") + 1), "rank", "left")
    known = F.col("before_host") == F.col("host")
    starts = staged(pair.select("part", "rank", (~_is_copy(
        "hashes", "chars", F.when(known, F.col("before_hashes")),
        F.when(known, F.col("before_size")).otherwise(0))).alias("first")), "runs")
    first = F.when(F.col("first"), F.col("rank"))
    # frames that grow row by row, backwards too: Spark computes frames up to the end anew for every row
    ahead = (Window.unboundedPreceding, -1)
    # one row a partition: at most spark.sql.shuffle.partitions
    carried = starts.groupBy("part").agg(F.min(first).alias("low"), F.max(first).alias("high")).select(
        "part", F.max("high").over(Window.orderBy("part").rowsBetween(*ahead)).alias("start"),
        F.min("low").over(Window.orderBy(F.desc("part")).rowsBetween(*ahead)).alias("next"))
    inside = Window.partitionBy("part")
    own = starts.withColumn("s", F.max(first).over(inside.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("n", F.min(first).over(inside.orderBy(F.desc("rank")).rowsBetween(*ahead)))
    return own.join(F.broadcast(carried), "part").select(
        "rank", (F.coalesce("s", "start") - 1).alias("before"), F.coalesce("n", "next").alias("after"))


def _beside(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.select(F.col("rank").alias(name), F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"),
                         F.col("hashes").alias(f"{name}_hashes"), F.col("size").alias(f"{name}_size"))


def verdicts(ranked: DataFrame) -> DataFrame:
    """(c1, c2, template) of the pages of ``ranked``, in as many passes as copies beyond
    a run make necessary; passes after the first only read the undecided pages' rows."""
    ends = staged(runs(ranked), "run-ends")
    before, after = _beside(ranked, "before"), _beside(ranked, "after")

    def same_host(name: str, what: str) -> Column:
        return F.when(F.col(f"{name}_host") == F.col("host"), F.col(f"{name}_{what}"))

    out, todo = None, ends
    while True:
        near = ranked.join(todo, "rank").join(before, "before", "left").join(after, "after", "left")
        judged = staged(near.select("c1", "c2", "rank", "before", "after", _template(
            "hashes", "chars", "open", "path", *[same_host(n, w) for n in ("before", "after")
                                                 for w in ("path", "hashes", "size")]).alias("v"))
            .select("c1", "c2", "rank", "before", "after", "v.*"), "verdicts")
        look_on = F.col("on_before") | F.col("on_after")
        done = judged.filter(~look_on).select("c1", "c2", "template")
        out = done if out is None else out.union(done)
        rest = judged.filter(look_on)
        if not rest.limit(1).count():
            return out
        further = [ends.select(F.col("rank").alias(n), F.col(n).alias(f"next_{n}")) for n in ("before", "after")]
        todo = rest.join(further[0], "before", "left").join(further[1], "after", "left").select(
            "rank", *[F.when(F.col(f"on_{n}"), F.col(f"next_{n}")).otherwise(F.col(n)).alias(n)
                      for n in ("before", "after")])


def templates(pages: DataFrame, page_key: list[str]) -> DataFrame:
    """(k1, k2, template) of the pages (host, path, html, and the key) with template lines to delete."""
    content = [F.col("host"), F.col("l.hashes"), F.col("l.open")]
    slim = staged(pages.filter("host IS NOT NULL").select("host", "path", *page_key, _line_hashes("html").alias("l"))
                  .filter(F.size("l.hashes") > 0)
                  .withColumn("c1", F.xxhash64(F.lit(1), *content)).withColumn("c2", F.xxhash64(F.lit(2), *content))
                  .select("host", "path", *page_key, "c1", "c2", "l.*"), "pages-lines")
    one = slim.groupBy("c1", "c2").agg(F.min("path").alias("path"),
                                       *[F.first(c).alias(c) for c in ("host", "hashes", "chars", "open")])
    parts = staged(one.repartitionByRange("host", "path", "c1", "c2")
                   .withColumn("part", F.spark_partition_id()), "pages-by-url")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("offset"))
    inside = Window.partitionBy("part").orderBy("host", "path", "c1", "c2")
    # one row a partition: at most spark.sql.shuffle.partitions
    size = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    ranked = parts.withColumn("k", F.row_number().over(inside)).join(F.broadcast(offsets), "part") \
        .withColumn("rank", F.col("offset") + F.col("k")).withColumn("size", size).drop("k", "offset")
    found = verdicts(staged(ranked, "pages-ranked")).filter(F.size("template") > 0)
    return slim.select(*page_key, "c1", "c2").distinct().join(found, ["c1", "c2"]).select(*page_key, "template")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_template), n_template being the lines deleted because a
    neighbour shares them. Pages are parsed twice; their markup moves once, to meet
    the template lines, unless these are few enough to broadcast."""
    bounded_batches(pages.sparkSession)
    host, path = url_parts(F.col(url_col))
    key = ["k1", "k2"]
    own = [F.col(id_col), F.col(id_col).isNull(), F.col(url_col), F.col(url_col).isNull(), F.col(html_col)]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host.alias("host"), path.alias("path"),
                        F.xxhash64(F.lit(1), *own).alias("k1"), F.xxhash64(F.lit(2), *own).alias("k2"))
    drop = staged(templates(rows, key), "templates")
    return rows.join(drop, key, "left").select(
        "page_id", "url", _main_text("html", "template").alias("text"),
        F.coalesce(F.size("template"), F.lit(0)).alias("n_template"))


def report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_template."""
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
