"""Quality rules of documents and of their hosts.

Every document is measured and judged by hard rules (``base_failed``) and by
soft rules, each a share or a mean with a limit. Soft failures are aggregated by
host; the host's failure rate is shrunk towards the corpus by a beta prior that is
fitted to all hosts (method of moments), so that a host with few documents is not
condemned by one of them.

The shrunk rate p sets how far past a limit the host's documents may be: by a factor
of ``1 + headroom * (1 - p)``. In a host where everything fails no excess is
tolerated; in a host without failures a document may be twice past a rule
(``headroom`` 1), and what is further past it goes in any host. A document without
failures is kept whatever its host.

Defined results: texts have no length limit; null and empty texts have no words and fail (``n_words < 10``); a null
host is a host of its own; a document just at its host's factor stays; repeated rows count as often as they occur; an
empty table gives an empty result. What the operator adds is one struct column under a free name, so other columns
may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.llm.common import WORD, bounded_batches, free_name, staged

#: How far past a limit, as a part of it, a document of a host without any failure may be.
HEADROOM = 1.0
#: Bounds of the prior's weight in documents: at least one, and at most what hosts without any spread give.
PRIOR_WEIGHT = (1.0, 1000.0)
#: Hosts up to which their table is broadcast; beyond, the planner shuffles both sides.
MAX_BROADCAST_HOSTS = 100_000
SHINGLE = 5

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_METRICS = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def metrics_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, their code points, symbols, lines with a word, of these equal to
    an earlier line, words inside 5-word windows that occur more than once)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines),
            len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[str], n: int = SHINGLE) -> int:
    grams = list(zip(*(words[i:] for i in range(n))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered = last = 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + n - max(i, last)
            last = i + n
    return covered


@F.pandas_udf(_METRICS)
def _measure_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([metrics_of(t) for t in texts], columns=_METRICS.fieldNames())


#: Declared so, the planner does not measure a text again to filter early by a part of the result.
_measure = _measure_texts.asNondeterministic()


def base_failed(m: Column) -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def past_rules(m: Column, factor: Column | float = 1.0) -> Column:
    """Further past a rule than ``factor`` times its limit: many symbols (a tenth of the words' characters), many
    repeated lines (three tenths), words of an implausible mean length (under 2, over 20)."""
    f = F.lit(factor) if isinstance(factor, float) else factor
    return ((100 * m["n_symbols"] > f * (10 * m["word_chars"])) | (100 * m["n_dup_lines"] > f * (30 * m["n_lines"]))
            | (2 * m["n_words"] > f * m["word_chars"]) | (m["word_chars"] > f * (20 * m["n_words"])))


def soft_failed(m: Column) -> Column:
    """Base failures, and texts past a soft rule."""
    return base_failed(m) | past_rules(m)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) from a table (n, failed) of hosts by the method of moments.

    The spread between hosts is the weighted variance of their rates less what
    sampling alone gives. One row reaches the driver."""
    r = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("failed").alias("f"),
                  F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff")).first()
    if not r["n"]:
        return 0.5, 0.5
    mean = r["f"] / r["n"]
    noise = mean * (1 - mean)
    between = r["ff"] / r["n"] - mean * mean - noise * r["h"] / r["n"]
    least, most = PRIOR_WEIGHT
    weight = min(most, max(least, noise / between - 1)) if between > 0 else most
    return mean * weight, (1 - mean) * weight


def host_verdicts(judged: DataFrame, host: str, failed: str, headroom: float = HEADROOM) -> DataFrame:
    """Per host: documents, failures, shrunk rate and the factor that its documents may be past a limit. Counts are
    pre-aggregated in every task, so a host with most rows costs a row a task."""
    hosts = staged(judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("factor", 1 + headroom * (1 - F.col("rate")))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", headroom: float = HEADROOM,
          result: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``result``: the metrics, base_failed,
    soft_failed, host_rejected and kept. Texts are read twice (once for the hosts)
    and never shuffled."""
    bounded_batches(docs.sparkSession)

    def measured(df: DataFrame) -> DataFrame:
        return df.withColumn(result, _measure(F.col(text_col)))

    slim = measured(docs.select(text_col, host_col) if text_col != host_col else docs.select(text_col))
    hosts = host_verdicts(slim.select(F.col(host_col).alias("host"), soft_failed(F.col(result)).alias("failed")),
                          "host", "failed", headroom)
    return _with_verdicts(measured(docs), hosts, host_col, result)


def _with_verdicts(measured: DataFrame, hosts: DataFrame, host_col: str, result: str) -> DataFrame:
    mark = free_name(measured, "host_verdict")
    verdicts = hosts.select(F.struct(F.struct("host").alias("key"), "factor").alias(mark))
    if hosts.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    m = F.col(result)
    # the host inside a struct: a null host is a value like any other
    joined = measured.join(verdicts, F.struct(F.col(host_col).alias("host")) == F.col(mark)["key"], "left")
    rejected = ~base_failed(m) & past_rules(m, F.col(mark)["factor"])
    return joined.withColumn(result, F.struct(
        *[m[n].alias(n) for n in _METRICS.fieldNames()], base_failed(m).alias("base_failed"),
        soft_failed(m).alias("soft_failed"), rejected.alias("host_rejected"),
        (~base_failed(m) & ~rejected).alias("kept"))).drop(mark)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    name = free_name(docs, "quality")
    judged = judge(docs, result=name, **options)
    return judged.filter(F.col(name)["kept"]).drop(name)


def report(docs: DataFrame) -> DataFrame:
    """Per document of (doc_id, text, source): its metrics and verdicts. Texts
    are read once: the measured rows, without texts, are written and joined."""
    bounded_batches(docs.sparkSession)
    measured = staged(docs.select("doc_id", "source", _measure(F.col("text")).alias("quality")), "quality")
    hosts = host_verdicts(measured.select("source", soft_failed(F.col("quality")).alias("failed")), "source", "failed")
    q = _with_verdicts(measured, hosts, "source", "quality")
    return q.select("doc_id", *[F.col("quality")[n].alias(n) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "soft_failed", "host_rejected")])


#: The rows of :func:`report` over ``documents``, in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^ 	-
]+') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
c AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l
      WHERE regexp_matches(line, '[^ 	-
]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words,
             len(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN p USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
s AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
             OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS soft_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(soft_failed::INT)::DOUBLE AS f FROM s GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS mean, sum(f) / sum(n) * (1 - sum(f) / sum(n)) AS noise,
             sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n))
             - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS between_hosts FROM h),
k AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(1000.0, greatest(1.0, noise / between_hosts - 1))
                        ELSE 1000.0 END AS weight FROM a),
v AS (SELECT source, 1 + 1.0::DOUBLE * (1 - (f + mean * weight) / (n + weight)) AS factor FROM h, k),
j AS (SELECT s.*, NOT base_failed AND (100 * n_symbols > factor * (10 * word_chars)
             OR 100 * n_dup_lines > factor * (30 * n_lines) OR 2 * n_words > factor * word_chars
             OR word_chars > factor * (20 * n_words)) AS host_rejected
      FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rejected AS kept, n_lines, soft_failed, host_rejected
FROM j
"""
