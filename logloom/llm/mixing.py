"""Mixing sources to target weights by weighted fair queueing (native).

Each source is a queue: its documents in shuffled order (a hash of the id),
then the same documents once more in another order, since a target may reach
``max_epochs`` = 2 times the source's size.  An entry's virtual finish time is
its source's cumulative words divided by the source's target; all entries are
sorted by finish time over all sources and the mix is the prefix that fits the
total budget.  Entries are taken whole, so every source ends within about one
document of its target and the total never exceeds the budget.

Both running sums (inside a source, and over all entries) are two-level scans
over slices of about ``SLICE`` entries, cut by hash range or finish time, so a
source that holds a third of all rows is spread over many tasks.

Targets: weights times the budget, but at most twice the source's size; the
excess is reshared by weight until no source is above (each round fixes the
sources above their cap and shares the rest anew).

Defined cases: a null text has 0 words; null source is a source of its own,
last in the order; a document of 0 words costs nothing, is queued once and
``taken`` is 0; rows that repeat an id are queued each for itself; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import SPACE, boxed, id_text, written
from logloom.operators.scan import running_agg

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
SLICE = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("bigint")


def shuffle_key(epoch: Column, doc_id: Column, row: Column) -> Column:
    """60 bits of md5, the same on every run and in other engines.  Rows without
    an id go by their row number, so that they are spread over the slices too."""
    name = F.when(doc_id.isNull(), F.concat(F.lit("row "), row.cast("string"))).otherwise(id_text(doc_id))
    hexed = F.md5(F.concat(epoch.cast("string"), F.lit(":"), name).cast("binary"))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("bigint")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   share: float = BUDGET_SHARE) -> tuple[DataFrame, float]:
    """(source, source_size, n_rows, rank, target) and the total budget.

    ``rank`` is the place in code-point order, null last, counted over range
    partitions so that no task ranks all sources."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    parted = written(sources.repartitionByRange(F.col("source").asc_nulls_last())
                     .withColumn("part", F.spark_partition_id()), "sources")
    ranked = running_agg(parted, [], [F.col("source").asc_nulls_last()], F.lit(1).cast("bigint"),
                         F.col("part"), out="rank").withColumn("rank", F.col("rank") - 1).drop("part")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", turn), "source-ranks")

    cap = MAX_EPOCHS * F.col("source_size")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget, level, fixed = share * total, 0.0, None
    while True:  # every round fixes at least one more source, or ends
        above = F.col("weight") * level > cap
        r = ranked.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("capped"),
                       F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
                       F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == fixed:
            break
        fixed, level = r["n"], (budget - r["capped"]) / r["open"] if r["open"] else level
    target = F.when(F.col("weight") * level > cap, cap.cast("double")).otherwise(F.col("weight") * level)
    return ranked.withColumn("target", target), budget


def fair_queue(rows: DataFrame, targets: DataFrame, budget: float) -> DataFrame:
    """Entries (row, epoch, size, finish) that the mix takes.

    ``rows``: (__row, doc_id, source, size)."""
    queued = (rows.join(targets.select("source", "rank", "n_rows", "target"),
                        rows.source.eqNullSafe(targets.source)).drop("source")
              .withColumn("epoch", F.explode(F.when(F.col("size") == 0, F.array(F.lit(0)))
                                             .otherwise(F.array(*[F.lit(k) for k in range(MAX_EPOCHS)]))))
              .withColumn("key", shuffle_key(F.col("epoch"), F.col("doc_id"), F.col("__row"))))
    slices = F.ceil(F.col("n_rows") / SLICE)
    cell = F.col("epoch") * slices + F.floor(F.col("key") / F.lit(float(1 << 60)) * slices)
    summed = running_agg(queued, ["rank"], ["epoch", "key", "size", "doc_id"], "size", cell, out="cumulative")
    # a source without words costs nothing at any time: its rows are spread over times that surely fit
    timed = summed.withColumn("finish", F.when(F.col("target") > 0, F.col("cumulative") / F.col("target"))
                              .otherwise(F.col("key") / F.lit(float(1 << 61))))
    # times above 1 are squeezed into (1, 2): the slices stay in order and bounded in number
    n = rows.count()
    squeezed = F.when(F.col("finish") <= 1, F.col("finish")).otherwise(2 - 1 / F.col("finish"))
    order = ["finish", "rank", "epoch", "key", "size", "doc_id"]
    taken = running_agg(timed.drop("n_rows", "cumulative"), [], order, "size",
                        F.floor(squeezed * (1 + n // SLICE)), out="spent")
    return taken.filter(F.col("spent") <= F.lit(budget)).select("__row", "epoch", "size", "finish")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, entries taken); ``rows`` has __row, doc_id, source, size."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "source",
                               word_count(F.col("text")).alias("size")), "sizes")
    targets, budget = source_targets(rows)
    targets = written(targets, "targets")
    return rows, targets, fair_queue(rows, targets, budget)


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    rows, targets, taken = mix(docs)
    per_row = taken.groupBy("__row").agg(F.sum("size").alias("taken"))
    per_source = targets.select(F.col("source").alias("src"), "source_size", "target")
    return (rows.join(per_source, rows.source.eqNullSafe(F.col("src"))).join(per_row, "__row", "left")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken (0, 1 or 2)."""
    ided = written(boxed(docs), "mix-in")
    rows = written(ided.select("__row", "__doc.doc_id", "__doc.source", word_count(F.col("__doc.text")).alias("size")), "sizes")
    targets, budget = source_targets(rows)
    taken = fair_queue(rows, written(targets, "targets"), budget)
    times = taken.groupBy("__row").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    return (ided.join(times, "__row")
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select("__doc.*"))


SQL = r"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                     coalesce(CAST(doc_id AS VARCHAR), '') AS id
              FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM r),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM s),
-- sources by how soon they reach their cap; the level with all earlier ones at their caps
c AS (SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS capped_before, sum(weight) OVER u AS open_from,
             row_number() OVER (ORDER BY 2 * source_size / weight, rank) AS k
      FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    u AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT ((SELECT budget FROM b) - capped_before::DOUBLE) / open_from AS level, k FROM c
       WHERE ((SELECT budget FROM b) - capped_before::DOUBLE) / open_from * weight <= 2 * source_size
       ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, rank,
             CASE WHEN weight * (SELECT level FROM lv) > 2 * source_size THEN (2 * source_size)::DOUBLE
                  ELSE weight * (SELECT level FROM lv) END AS target FROM w),
e AS (SELECT rows.doc_id, rows.size, t.rank, t.target, ep.epoch,
             ('0x' || substr(md5(ep.epoch || ':' || rows.id), 1, 15))::BIGINT AS key
      FROM rows JOIN t ON rows.source IS NOT DISTINCT FROM t.source,
           (SELECT unnest([0, 1]) AS epoch) ep WHERE ep.epoch = 0 OR rows.size > 0),
f AS (SELECT *, CASE WHEN target > 0 THEN (sum(size) OVER (PARTITION BY rank ORDER BY epoch, key, size, doc_id
             ROWS UNBOUNDED PRECEDING))::DOUBLE / target ELSE 0 END AS finish FROM e),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, key, size, doc_id ROWS UNBOUNDED PRECEDING) AS spent
      FROM f),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE spent::DOUBLE <= (SELECT budget FROM b) GROUP BY doc_id)
SELECT rows.doc_id, rows.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM rows JOIN t ON rows.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.doc_id = rows.doc_id
"""
