"""Mixing sources to target weights, in fixed-length blocks of words.

DataFrame functions only; no Python runs on the executors.

1. *Targets.* Sources, ordered by name (code points, null last), have weights;
   they share ``share`` times all words by weight, but none gets more than
   ``epochs`` times its own words, and what it cannot take the others share.
2. *Packing.* The documents of a source form one stream of words, cut into blocks
   of ``block`` words; the last block of a source may be shorter. A document's
   place in its stream comes from sums per (source, hash bucket) and a running
   sum inside a bucket; there are about as many buckets as rows in one, the square
   root of the rows, so a source that holds most rows is in no task whole. Equal rows
   of a scan task count as one entry up to here and are unfolded, spread by entry,
   once their places are known: a row that makes up half the table fills no bucket.
3. *Drawing.* A source gets as many slots as its target needs. Every output shard
   of ``shard_blocks`` slots draws its source counts: each slot draws a source with
   probability proportional to its slots (a multinomial draw per shard). What a
   source draws beyond its slots is cut from its last shards, and what it draws
   short of them is dealt to shards by hash, so each source gets its target exactly.
4. *Order.* Slot k of a source takes block perm(k mod blocks) of it: perm is a
   swap-or-not shuffle keyed by the source, a pseudorandom permutation of any
   domain computed from k alone. Each epoch therefore takes every block once.
5. *Join.* Slots meet blocks on (source, block index). The last slot of a source is
   cut where its target is reached.

Everything follows from hashes of the data and the seed; reruns agree.

Defined results: texts have no length limit; null and empty texts have size zero and take nothing; a null source is a
source; a source without words has target zero; rows with the same doc_id are different rows; an empty table gives no
rows; columns other than the named ones are carried along by :func:`mixed_documents`, whatever their names.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm.common import WORD, free_name, row_hash, staged, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK = 64
SHARD_BLOCKS = 4096
SEED = 17
#: Slots that one task unfolds, about.
SLOTS_A_TASK = 200_000
#: Rounds of the swap-or-not shuffle.
ROUNDS = 24
#: Equal cells of [0, 1) that a drawn number is looked up by.
CELLS = 1024


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


# ---- 1. targets -----------------------------------------------------------------------------------------------

def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size), one row a source.

    A source is full when its limit is at most what its weight earns it of what
    sources that fill up sooner leave. Sources in the order of limit / weight fill
    up one after the other, so running sums in this order tell which are full."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("rank")).rowsBetween(
        Window.unboundedPreceding, -1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    t = (sizes.withColumn("rank", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.get(table, F.col("rank") % len(weights)))
         .withColumn("limit", F.col("source_size") * float(epochs))
         .withColumn("total", F.sum("source_size").over(everything) * float(share))
         .withColumn("weights", F.sum("weight").over(everything)))
    sooner_limit, sooner_weight = (F.coalesce(F.sum(c).over(fill), F.lit(0.0)) for c in ("limit", "weight"))
    t = t.withColumn("level", (F.col("total") - sooner_limit) / (F.col("weights") - sooner_weight)) \
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    # the level of the sources that are not full: what the full ones leave, by weight
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    heavy = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    return t.select("source", "source_size", "rank", F.when(F.col("full"), F.col("limit")).otherwise(
        F.col("weight") * left / F.greatest(heavy, F.lit(1e-300))).alias("target"))


# ---- 2. packing -----------------------------------------------------------------------------------------------

def bucketed(rows: DataFrame, n_rows: int) -> DataFrame:
    """Entries with their bucket. It follows from the row and the number of rows alone, not from the scan's tasks."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(max(1, isqrt(n_rows)))).cast("int"))


def placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """Entries (rank, doc, row, part, size, copies, ...) as one row a copy, with ``copy``, its number in the entry, and
    ``start``, the words before it in its source. Entries of equal rows stand together, so which of them a
    copy belongs to changes nothing."""
    rows, words = bucketed(rows, n_rows), F.col("size") * F.col("copies")
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rank", "bucket").agg(F.sum(words).alias("words")).select(
        "rank", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0).cast("long")).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("doc", "row", "part").rowsBetween(
        Window.unboundedPreceding, -1)
    entries = rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0).cast("long"))) \
        .join(sums, ["rank", "bucket"]).withColumn("start", F.col("offset") + F.col("inside")) \
        .drop("bucket", "offset", "inside")
    # an entry has at most the rows of one scan task; spread before they are unfolded
    return entries.repartition("row", "part") \
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))) \
        .withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copies")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every part of a document in a block: block, [low, high) of the
    block's words, and ``at``, the document's first word in it. Documents without
    words keep one row with a null block."""
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    b = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return b.withColumn("low", low).withColumn("high", high) \
        .withColumn("at", F.greatest(F.col("block") * block - F.col("start"), F.lit(0)))


# ---- 3. and 4. slots ------------------------------------------------------------------------------------------

def shuffled(k: Column, n: Column, key: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """Swap-or-not shuffle: a permutation of 0..n-1 for every key, as an expression.

    Each round pairs x with (K - x) mod n and swaps the pair or not by a hash of
    its larger member; a round is its own inverse."""
    def step(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        swap = F.xxhash64(key, i, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    order = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, k.cast("long"), step)


def quotas(t: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Targets with: blocks of the source, slots its target needs, and the words
    that the last slot takes.

    Whole epochs come first. In the last one, slots hold ``block`` words each,
    except the slot that the short last block falls to."""
    n, size, want = F.col("blocks"), F.col("source_size"), F.col("want")
    # The optimizer may move the filter behind what follows: a source without words must not divide by zero there.
    t = t.filter("source_size > 0").withColumn("source_size", F.greatest("source_size", F.lit(1).cast("long"))) \
        .withColumn("want", F.round("target").cast("long")) \
        .withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")) \
        .withColumn("key", F.xxhash64(F.lit(seed), F.col("source"), F.col("source").isNull())) \
        .withColumn("whole", F.expr("want div source_size")) \
        .withColumn("rest", want - F.col("whole") * size) \
        .withColumn("short_at", shuffled(n - 1, n, F.col("key"), inverse=True)) \
        .withColumn("missing", n * block - size)
    rest = F.col("rest")
    beyond = rest > F.col("short_at") * block + block - F.col("missing")
    after = F.expr(f"(rest + missing + {block - 1}) div {block}")
    upto = F.expr(f"(rest + {block - 1}) div {block}")
    slots = F.when(beyond, after).otherwise(upto)
    taken = F.when(beyond, F.col("rest") + F.col("missing")).otherwise(F.col("rest")) - (slots - 1) * block
    return t.withColumn("last_words", F.when(rest > 0, taken).otherwise(F.lit(block)).cast("long")) \
        .withColumn("slots", (F.col("whole") * n + F.when(rest > 0, slots).otherwise(0)).cast("long")) \
        .filter("slots > 0").select("source", "rank", "key", "blocks", "slots", "last_words")


def drawn(q: DataFrame, total: int, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
          cells: int = CELLS) -> DataFrame:
    """(rank, shard, n): how many slots of each source an output shard draws.

    A slot's hash gives a number u in [0, 1); the source whose part of the line
    it falls into is found by the equal cell that u lies in (an equality join)
    and the part's bounds in it."""
    line = Window.orderBy("rank")
    parts = q.select("rank", (F.sum("slots").over(line) - F.col("slots")).alias("a"), F.sum("slots").over(line).alias("b"))
    parts = parts.select("rank", "a", "b", F.explode(F.sequence(
        F.floor(F.col("a") * cells / F.lit(total)), F.floor((F.col("b") - 1) * cells / F.lit(total)))).alias("cell"))
    slots = q.sparkSession.range(total).select(
        F.expr(f"id div {shard_blocks}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(total)).alias("u")) \
        .withColumn("cell", F.floor(F.col("u") * cells / F.lit(total)))
    return slots.join(parts, "cell").filter((F.col("u") >= F.col("a")) & (F.col("u") < F.col("b"))) \
        .groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))


def slots(q: DataFrame, total: int, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """One row a slot: source, rank, shard, slot, block (index in the source),
    epoch, and words, how many of the block's first words it takes."""
    shards = -(-total // shard_blocks)
    counts = staged(drawn(q, total, shard_blocks, seed), "drawn")
    ahead = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))) \
        .repartition(-(-total // SLOTS_A_TASK), "rank", "shard").join(q, "rank")  # a row here is many slots
    kept = F.least(F.col("first") + F.col("n"), F.col("slots")) - F.col("first")
    cut = runs.withColumn("n", kept).filter("n > 0").withColumn(
        "slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).drop("first", "n")
    # what is short: in runs of bounded length, so that one source's shortfall is not one row's array
    short = q.join(counts.groupBy("rank").agg(F.sum("n").alias("got")), "rank", "left") \
        .withColumn("got", F.least(F.coalesce("got", F.lit(0)), "slots"))
    step = F.explode(F.sequence(F.col("got"), F.col("slots") - 1, F.lit(shard_blocks).cast("long"))).alias("from")
    dealt = short.filter("got < slots").select("*", step).withColumn("slot", F.explode(F.sequence(
        F.col("from"), F.least(F.col("from") + shard_blocks, "slots") - 1))) \
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("short"), "rank", "slot"), F.lit(shards)))
    cols = ["source", "rank", "key", "blocks", "slots", "last_words", "shard", "slot"]
    return cut.select(*cols).union(dealt.select(*cols)).select(
        "source", "rank", "shard", "slot",
        shuffled(F.pmod("slot", "blocks"), F.col("blocks"), F.col("key")).alias("block"),
        F.expr("slot div blocks").alias("epoch"),
        F.when(F.col("slot") == F.col("slots") - 1, F.col("last_words")).otherwise(F.lit(block)).alias("words"))


# ---- 5. the mix -----------------------------------------------------------------------------------------------

def sizes(docs: DataFrame, text_col: str, source_col: str, id_col: str) -> DataFrame:
    """Entries (source, doc, size, row, part, copies): a row's hash, the scan task that read it and how many
    equal rows that task read, written once."""
    return staged(docs.select(
        F.col(source_col).alias("source"), F.col(id_col).alias("doc"), word_count(text_col).alias("size"),
        row_hash(docs.columns).alias("row"), F.spark_partition_id().alias("part"))
        .groupBy("source", "doc", "size", "row", "part").agg(F.count(F.lit(1)).alias("copies")), "sizes")


def mix(rows: DataFrame, block: int = BLOCK, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS,
        **options) -> tuple[DataFrame, DataFrame]:
    """(pieces, slots) of a table of :func:`sizes`: what each block holds, with the
    source's size and target, and which blocks the mix takes, where. They meet on
    (rank, block)."""
    per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    t = staged(targets(per_source, **options), "targets")
    q = staged(quotas(t, block, seed), "quotas")
    total = q.agg(F.sum("slots").alias("n")).first()["n"] or 0
    of = t.select(F.struct("source").alias("s"), "rank", "source_size", "target")
    named = rows.withColumn("s", F.struct("source")).join(of, "s").drop("s", "source")
    held = pieces(placed(named, n_rows(rows)), block)
    if total == 0:
        return held, q.limit(0).select("rank", *[F.lit(0).cast("long").alias(c) for c in (
            "shard", "slot", "block", "epoch", "words")])
    return held, slots(q, total, block, shard_blocks, seed)


def n_rows(entries: DataFrame) -> int:
    return entries.agg(F.sum("copies").alias("n")).first()["n"] or 0


def overlap(words: Column) -> Column:
    """Words of a piece that a slot of so many words takes."""
    return F.greatest(F.least(F.col("high"), words) - F.col("low"), F.lit(0).cast("long"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    held, drawn_slots = mix(sizes(docs.select("doc_id", "text", "source"), "text", "source", "doc_id"))
    # the uses of a block: at most EPOCHS of them
    uses = drawn_slots.groupBy("rank", "block").agg(F.collect_list("words").alias("uses"))
    zero = F.lit(0).cast("long")
    taken = F.coalesce(F.aggregate("uses", zero, lambda a, w: a + overlap(w)), zero)
    return held.join(uses, ["rank", "block"], "left").withColumn("taken", taken) \
        .groupBy("row", "part", "copy", "doc", "size", "source_size", "target").agg(F.sum("taken").alias("taken")) \
        .select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
                    **options) -> DataFrame:
    """The mix as documents: a row for each document and epoch that takes words of
    it, with the words taken (in order, with the white space after each) as its
    text, ``n_chars`` their length where there is such a column, and its other columns.

    Only numbers are shuffled up to the last join, which moves the texts once."""
    cols = docs.columns
    key, spans = free_name(docs, "mix_key"), free_name(docs, "mix_spans")
    rows = sizes(docs, text_col, source_col, id_col)
    held, drawn_slots = mix(rows, **options)
    n = overlap(F.col("words"))
    takes = staged(held.filter("block IS NOT NULL").join(drawn_slots, ["rank", "block"])
                   .select("row", "part", "copy", "epoch", "at", n.alias("n")).filter("n > 0")
                   .groupBy("row", "part", "copy", "epoch").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias(spans))
                   .select(F.col("row").alias(key), spans), "takes")
    texts = docs.withColumn(key, row_hash(cols))
    if n_rows(rows) > rows.select("row").distinct().count():
        texts = texts.dropDuplicates([key])  # equal rows: one text, a row of ``takes`` for each
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    # the words as a lambda's argument: split once a text, not once a span
    cut = F.transform(F.array(words), lambda ws: F.array_join(F.flatten(F.transform(
        F.col(spans), lambda s: F.slice(ws, (s["at"] + 1).cast("int"), s["n"].cast("int")))), ""))[0]
    out = texts.join(takes, key).withColumn(text_col, cut)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)
