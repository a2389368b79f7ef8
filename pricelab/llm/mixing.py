"""Mixing sources to target weights by weighted fair queueing.

Every source has a target number of words: its weight's share of ``budget``
times all words, at most ``repeats`` times its own size, what is over being
shared again by weight among the others (water-filling on the table of
sources). Documents of a source are queued in a shuffled order (md5 of seed and
doc_id), as often over as the target needs. A copy's virtual finish time is the
source's running word count, up to the copy's middle, divided by the source's target; all queues
are served in the order of that time, and the mix is cut where its running
count, to the middle again, reaches the budget. (Counted to their ends, copies across the border
would all stay out, and the sources of short documents would get what those leave.)

Both running counts are sums over ranges of the order key, then over the rows of
one range, so neither a hot source nor the whole table is ever one task's. The
number of ranges follows the number of rows (``range_rows`` a range).

A document of size 0 is never taken. Null texts count as empty, null sources are
a source of their own (last), null doc_ids sort first. Repeated rows are mixed
each by itself; which of two equal rows is taken is not defined, how many are is.
An empty table gives an empty mix. A document is taken ``copies`` times in full;
copies that finish at the same time as the last one served are served too.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

CYCLE = (5, 2, 1)


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shares(sizes: list[tuple], budget: float = 1.5, repeats: int = 2, weights: tuple = CYCLE) -> list[tuple]:
    """(source, source_size, target) by water-filling; ``sizes``: (source, size), weighted in the given order."""
    rows = [(s, n, weights[k % len(weights)]) for k, (s, n) in enumerate(sizes)]
    left, open_ = budget * sum(n for _, n, _ in rows), list(rows)
    target = {}
    while open_:
        total = sum(w for *_, w in open_)
        full = [r for r in open_ if left * r[2] / total > repeats * r[1]]
        for s, n, w in full or open_:
            target[s] = float(repeats * n) if full else left * w / total
        left -= sum(target[s] for s, *_ in full)
        open_ = [r for r in open_ if r[0] not in target]
    return [(s, n, target[s]) for s, n, _ in rows]


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, ranges: int, slot: Column) -> DataFrame:
    """Running sum of ``value`` in the order, within ``keys``; ``slot`` maps the order to 0..ranges-1 without changing it."""
    r, before = fresh("r"), fresh("b")
    df = df.withColumn(r, F.least(F.lit(ranges - 1), slot).cast("long"))
    sums = df.groupBy(*keys, r).agg(F.sum(value).alias(out))
    upto = Window.partitionBy(*keys).orderBy(r).rowsBetween(Window.unboundedPreceding, -1) if keys else None
    if keys:
        base = sums.withColumn(before, F.coalesce(F.sum(out).over(upto), F.lit(0))).drop(out)
    else:  # a row for each range: the ranges before it, by a sum over groups of ranges
        g = fresh("g")
        sums = sums.withColumn(g, F.expr(f"{r} div {max(1, int(ranges ** 0.5))}"))
        tops = sums.groupBy(g).agg(F.sum(out).alias(before))
        tops = tops.withColumn(before, F.coalesce(F.sum(before).over(Window.orderBy(g).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inner = Window.partitionBy(g).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
        base = sums.withColumn(out, F.coalesce(F.sum(out).over(inner), F.lit(0))).join(tops, g).select(r, (F.col(out) + F.col(before)).alias(before))
    here = Window.partitionBy(*keys, r).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    k2 = {k: fresh("k") for k in keys}
    base = base.select(*[F.col(k).alias(v) for k, v in k2.items()], F.col(r).alias(r + "_"), before)
    on = F.col(r) == F.col(r + "_")
    for k, v in k2.items():
        on = on & F.col(k).eqNullSafe(F.col(v))
    df = df.withColumn(out, F.sum(value).over(here)).join(base, on, "left")
    return df.withColumn(out, F.col(out) + F.coalesce(F.col(before), F.lit(0))).drop(r, r + "_", before, *k2.values())


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", budget: float = 1.5, repeats: int = 2,
        weights: tuple = CYCLE, seed: int = 0, range_rows: int = 20_000) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    spark = docs.sparkSession
    rows = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size")), "sizes")
    # One row a source: the table of sources, not of documents.
    sizes = [(r["source"], r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]
    sizes.sort(key=lambda r: (r[0] is None, r[0] or ""))
    n, total = sum(r[2] for r in sizes), float(budget * sum(r[1] for r in sizes))
    ranges = max(1, ceil(n / range_rows))
    table = spark.createDataFrame(shares([r[:2] for r in sizes], budget, repeats, weights), "s string, source_size long, target double")
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # 52 bits of the md5: the same number in any engine, exact in a double.
    text_id = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("shuffle", F.conv(F.substring(F.md5(text_id), 1, 13), 16, 10).cast("long"))
    rows = running(rows, ["source"], ["shuffle", "doc_id", "size"], "size", "upto", ranges, F.floor(F.col("shuffle") / float(1 << 52) * ranges))
    rows = stored(rows.drop("shuffle"), "queues")

    def finish(turn: Column) -> Column:
        return F.try_divide(F.col("upto") + turn * F.col("source_size") - F.col("size") / 2, F.col("target"))

    turns = rows.where(F.col("size") > 0).select("source", "doc_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), finish)).alias("finish"))
    # A source's target is at most ``repeats`` times its size, so its last copy finishes by ``repeats`` times the longest time.
    last = turns.agg(F.max("finish").alias("f")).collect()[0]["f"] or 1.0
    served = running(turns, [], ["finish", "source", "doc_id"], "size", "served", repeats * ranges, F.floor(F.col("finish") / last * repeats * ranges))
    cut = served.where(F.col("served") - F.col("size") / 2 <= total).agg(F.max("finish").alias("f")).collect()[0]["f"] or 0.0
    copies = sum(((F.col("size") > 0) & F.coalesce(finish(F.lit(k)) <= cut, F.lit(False))).cast("int") for k in range(repeats))
    out = rows.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows alike in (doc_id, source, size) share what the plan takes of them: the total is dealt evenly, what is over
    one each in the order of a hash of their texts.
    """
    d, s, z, n, c, r = map(fresh, "dszncr")
    text, source, doc_id = how.get("text", "text"), how.get("source", "source"), how.get("doc_id", "doc_id")
    plan = mix(docs, **how).groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z)).agg(F.sum("copies").alias(c), F.count("*").alias(n))
    plan = stored(plan.where(F.col(c) > 0), "copies")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(d)) & F.col(source).cast("string").eqNullSafe(F.col(s)) & (size_of(F.col(text)) == F.col(z))
    repeated = plan.where(F.col(n) > 1)
    out = docs.join(plan.where(F.col(n) == 1), same).select(*docs.columns, c)
    if not repeated.isEmpty():
        place = F.row_number().over(Window.partitionBy(d, s, z).orderBy(F.xxhash64(text)))
        share = F.expr(f"{c} div {n}") + (place <= F.expr(f"{c} % {n}")).cast("long")
        out = out.union(docs.join(repeated, same).select(*docs.columns, share.alias(c)))
    turns = F.when(F.col(c) > 0, F.sequence(F.lit(1).cast("long"), F.col(c)))
    return out.withColumn(r, F.explode(turns)).select(docs.columns)
