"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that depends on
the identifiers alone, run through as often as the repeat limit allows. A
turn's virtual finish time is the words its queue has given up to its end
divided by the source's target. Turns are served in order of finish time
over all sources, until the total budget is spent; the turn in which it runs
out is cut. At virtual time 1 all queues are at their targets, so the cut falls
there, and each source is off its target by part of a document.

Running sums are taken in two levels: over hash ranges of each source and
then within a range, so that a source with a third of all rows is spread
over all tasks; and over ranges of finish time, of which only the one that
holds the cut is looked at more closely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, fresh, stored

#: Hash ranges of a source: its queue is summed in so many parts.
PARTS = 4096
#: Turns around the cut that one task sorts; ranges of finish time are narrowed down to so many.
CUT = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share_percent: int, repeats: int) -> DataFrame:
    """For (source, source_size): target. Sources in order of code points, null last, weigh weights in turn and share share_percent % of all sizes; none gets over repeats times its size, and what that leaves is shared out by weight again until none is above."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumns({"w": weigh, "cap": F.col("source_size") * repeats})
    # sources fill up in order of cap / w; a source is capped if the level, with all before it and itself capped, would pass its cap
    filling = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(W.unboundedPreceding, 0)
    budget = F.floor(F.sum("source_size").over(W.partitionBy()) * share_percent / F.lit(100)).cast("long")
    s = s.withColumns({"left": budget - (F.sum("cap").over(upto) - F.col("cap")), "rest": F.sum("w").over(W.partitionBy()) - (F.sum("w").over(upto) - F.col("w"))})
    s = s.withColumn("full", F.col("cap") * F.col("rest") <= F.col("left") * F.col("w"))
    s = s.withColumn("full", F.min("full").over(upto))
    level = W.partitionBy()
    s = s.withColumns({"num": F.max(F.when(~F.col("full"), F.col("left"))).over(level), "den": F.max(F.when(~F.col("full"), F.col("rest"))).over(level)})
    return s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("num").cast("double") * F.col("w") / F.col("den"))).select("source", "source_size", "target")


def queued(df: DataFrame, weights: tuple[int, ...], share_percent: int, repeats: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, int]:
    """(id, source, size, source_size, target, start) of each row of df, start being the words its queue gives before it; and the total budget."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256).alias("turn"))
    rows = stored(rows.withColumn("part", F.conv(F.substring("turn", 1, 3), 16, 10).cast("int")), "sizes")
    parts = stored(rows.groupBy("source", "part").agg(F.sum("size").alias("n")), "parts")  # PARTS rows a source at most
    targets = source_targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share_percent, repeats)
    parts = parts.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n"))
    words = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(F.col("p.source").alias("source2"), F.col("part").alias("part2"), "before", "source_size", "target")
    run = F.sum("size").over(W.partitionBy("source", "part").orderBy("turn", "size", "id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("run", run).join(parts, F.col("source").eqNullSafe(F.col("source2")) & (F.col("part") == F.col("part2")))
    rows = rows.select("id", "source", "size", "source_size", "target", (F.col("before") + F.col("run") - F.col("size")).alias("start"))
    return stored(rows, "queue"), words * share_percent // 100


def finish(k: int) -> Column:
    """Virtual finish time of a row's turn k; null without words."""
    return F.when(F.col("size") > 0, (F.col("start") + F.col("size") + F.col("source_size") * k) / F.col("target"))


def budget_cut(turns: DataFrame, budget: int, most: int = CUT) -> tuple[float, float, int]:
    """(low, high, words): turns that finish up to low are served whole and give so many words; those that finish after high aren't served; at most most turns lie between, or their finish times are equal."""
    low, high, words = -1.0, turns.agg(F.coalesce(F.max("finish"), F.lit(0.0))).first()[0], 0
    while True:
        cell = F.least(F.floor((F.col("finish") - low) * (PARTS / (high - low))), F.lit(PARTS - 1)).alias("cell")
        sums = turns.filter(F.col("finish").between(low, high) & (F.col("finish") > low)).groupBy(cell).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b")).collect() if high > low else []
        for r in sorted(sums, key=lambda r: r.cell):  # PARTS rows at most
            if words + r.s > budget:
                high = r.b
                break
            low, words = r.b, words + r.s
        else:
            return low, low, words
        if r.n <= most or r.a == r.b:
            return low, high, words


def fair_mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = CUT) -> DataFrame:
    """One row for each row of df: id, source, size, source_size, target, taken, turns (array of finish, given: the row's turns that are served, with their virtual finish times and the words they give).

    size is the number of words, 0 for a null or blank text; such rows are
    never served. Rows of a null source form a source of their own, the
    last. Turns that finish together are served by source, then in the order of
    the queue. Rows with equal ids follow one another in the queue by their size,
    so repeated rows each count. An empty table gives no rows.
    """
    rows, budget = queued(df, weights, share_percent, repeats, id_col, text_col, source_col)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), finish(k).alias("finish")) for k in range(repeats)))).alias("turn")
    turns = rows.filter("size > 0").select("source", "start", "size", each).select("source", "start", "size", "turn.*")
    low, high, words = budget_cut(turns, budget, most)
    run = F.sum("size").over(W.orderBy("finish", F.col("source").asc_nulls_last(), "start", "k").rowsBetween(W.unboundedPreceding, 0))
    edge = turns.filter((F.col("finish") > low) & (F.col("finish") <= high)).withColumn("given", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget - words) - run + F.col("size"))).cast("long"))
    edge = edge.groupBy(F.col("source").alias("source2"), F.col("start").alias("start2")).agg(*(F.max(F.when(F.col("k") == k, F.col("given"))).alias(f"given{k}") for k in range(repeats)))
    rows = rows.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("source2")) & (F.col("start") == F.col("start2")) & (F.col("size") > 0), "left")
    given = [F.when(finish(k) <= low, F.col("size")).otherwise(F.coalesce(f"given{k}", F.lit(0))).cast("long") for k in range(repeats)]
    served = F.filter(F.array(*(F.struct(finish(k).alias("finish"), g.alias("given")) for k, g in enumerate(given))), lambda x: x["given"] > 0)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", sum(given[1:], given[0]).alias("taken"), served.alias("turns"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of df, each as often as it is served, sorted by virtual finish time over all partitions.

    The turn that the budget cuts counts if at least half of the document is
    served. Rows alike in id and number of words each get the turns of the
    first of them; rows without words are never served.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    id_, size_, turns_, turn_ = fresh(df.columns, "_id", "_size", "_turns", "_turn")
    queue = fair_mix(df, **options).filter("taken > 0").groupBy(F.col(id_col).alias(id_), F.col("size").alias(size_)).agg(F.min("turns").alias(turns_))
    queue = queue.select(id_, size_, F.explode(F.filter(turns_, lambda x: x["given"] * 2 >= F.col(size_))).alias(turn_))
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0))
    return df.join(queue, F.col(id_col).eqNullSafe(F.col(id_)) & (size == F.col(size_))).orderBy(f"{turn_}.finish", id_col).select(df.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, sha256(CAST(doc_id AS VARCHAR)) AS turn,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2 AS cap,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
f AS (SELECT *,
             (SELECT floor(sum(source_size) * 150 / 100)::BIGINT FROM s) - (sum(cap) OVER o - cap)::BIGINT AS left_over,
             ((SELECT sum(w) FROM w) - (sum(w) OVER o - w))::BIGINT AS rest
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, bool_and(cap * rest <= left_over * w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS is_full FROM f),
t AS (SELECT source, source_size,
             CASE WHEN is_full THEN cap::DOUBLE
                  ELSE (max(CASE WHEN NOT is_full THEN left_over END) OVER ())::DOUBLE * w
                       / (max(CASE WHEN NOT is_full THEN rest END) OVER ()) END AS target
      FROM g),
q AS (SELECT d.rid, d.doc_id, d.source, d.size, t.source_size, t.target,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.size, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT rid, source, size, start, k, (start + size + source_size * k) / target AS finish FROM q, (VALUES (0), (1)) v(k) WHERE size > 0),
r AS (SELECT rid, size, (sum(size) OVER (ORDER BY finish, source NULLS LAST, start, k ROWS UNBOUNDED PRECEDING))::BIGINT - size AS given_before FROM e),
n AS (SELECT rid, sum(greatest(0, least(size, (SELECT floor(sum(source_size) * 150 / 100)::BIGINT FROM s) - given_before)))::BIGINT AS taken FROM r GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN n USING (rid)
"""
