"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a (source, shuffle bucket) and items of a slice of virtual time that one window task orders, about.
GROUP, SLICE = 256, 4096
#: Buckets, or slices, that stand in one group of the level above.
FAN = 4096


def targets(sizes: DataFrame, share: float, most: float, cycle: tuple[int, ...]) -> DataFrame:
    """source, source_size, target, of rows (source, size).

    Sources by code point, null last, weigh as `cycle` repeats. `share` of all sizes is dealt by weight; a target stops at `most`
    times its source's size and the excess is dealt again by weight until none is above: sources fill in order of room per weight,
    so the level at which the rest shares is one division over running sums. One row a source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weigh = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    s = s.withColumn("weight", weigh).withColumn("room", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size") * F.lit(share)).over(everything) - F.coalesce(F.sum("room").over(done), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(done), F.lit(0))
    s = s.withColumn("left", left).withColumn("heavy", heavy)
    # the first source that doesn't fill up fixes the level of all after it
    level = F.min(F.when(F.col("room") / F.col("weight") > F.col("left") / F.col("heavy"), F.struct(F.col("room") / F.col("weight"), (F.col("left") / F.col("heavy")).alias("level")))).over(everything)["level"]
    return s.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("weight") * F.col("level"))).alias("target"))


def _before(sums: DataFrame) -> DataFrame:
    """source, bucket, before: the words of a source in all smaller buckets. No window spans more than FAN buckets, or the groups of FAN."""
    wide = F.floor(F.col("bucket") / FAN)
    groups = sums.groupBy("source", wide.alias("wide")).agg(F.sum("words").alias("words"))
    groups = groups.select("source", "wide", (F.sum("words").over(Window.partitionBy("source").orderBy("wide")) - F.col("words")).alias("ahead"))
    inside = F.sum("words").over(Window.partitionBy("source", "wide").orderBy("bucket")) - F.col("words")
    fine = sums.withColumn("wide", wide).select("source", "wide", "bucket", inside.alias("inside"))
    both = fine.alias("f").join(groups.alias("g"), F.col("f.source").eqNullSafe(F.col("g.source")) & (F.col("f.wide") == F.col("g.wide")))
    return both.select("f.source", "f.bucket", (F.col("f.inside") + F.col("g.ahead")).alias("before"))


def _ends(parts: DataFrame, start: int, budget: int):
    """The first of parts(slice, words) at whose end the words from `start` on exceed the budget, with that sum as upto; None if none does."""
    total = parts.select("slice", "words", (F.sum("words").over(Window.orderBy("slice")) + F.lit(start)).alias("upto"))
    return total.where(F.col("upto") > budget).orderBy("slice").limit(1).first()


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = (5, 2, 1), seed: str = "mix", keep: tuple[str, ...] = ()) -> tuple[DataFrame, Tables]:
    """doc_id, size, source_size, target, taken of every row of docs(doc_id, text, source), and the tables that hold what is between.

    Each source's documents stand in a shuffled order (md5 of seed and id), passed through twice at most; a copy's virtual finish
    time is the words of its source up to its end over the source's target. All copies are cut in order of that time where the next
    one would exceed `share` of all words. So a source is served near its target, within a document's size.
    Null texts have size 0 and take nothing; repeated rows are documents of their own; a null source is a source; an empty table
    gives none. Columns beyond these play no part, and `keep` names some that pass through.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "mix")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))).alias("shuffle"), *keep)
    rows = tables.write(rows, "sizes")  # ids, sizes and hashes: the texts are read once
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = int(share * words)
    goals = tables.write(targets(rows, share, most, cycle), "targets")
    spread = max(1, n // GROUP)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("shuffle", 1, 12), 16, 10).cast("long") * spread / (1 << 48)))
    before = _before(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    inner = Window.partitionBy("source", "bucket").orderBy("shuffle", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("run", F.sum("size").over(inner))
    placed = placed.alias("p").join(before.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket"))).join(F.broadcast(goals).alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))  # a row a source
    end = F.col("b.before") + F.col("p.run")
    time = lambda words: F.when(F.col("g.target") > 0, words / F.col("g.target")).otherwise(F.lit(0.0))
    placed = placed.select("p.doc_id", "p.source", "p.size", "p.shuffle", "g.source_size", "g.target", time(end).alias("first"), time(end + F.col("g.source_size")).alias("second"), *[f"p.{c}" for c in keep])
    placed = tables.write(placed, "placed")
    # the range sort: equal slices of virtual time hold about equal words, as every source is served at its target's rate
    slices = max(1, 2 * n // SLICE)
    copies = placed.where("size > 0").select("size", "shuffle", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.explode(F.array("first", "second")).alias("time"))
    copies = copies.withColumn("slice", F.floor(F.least(F.col("time"), F.lit(1e6)) * slices))
    by_slice = tables.write(copies.groupBy("slice").agg(F.sum("size").alias("words")), "slices")
    full = _ends(by_slice.groupBy(F.floor(F.col("slice") / FAN).alias("slice")).agg(F.sum("words").alias("words")), 0, budget)
    if full is not None:  # the slice in which the budget ends: one row, found in one group of FAN
        full = _ends(by_slice.where(F.floor(F.col("slice") / FAN) == full.slice), full.upto - full.words, budget)
    if full is None:
        taken = lambda t: F.lit(1)
    else:
        order = ["time", "shuffle", "doc_id", "size"]
        last = copies.where(F.col("slice") == full.slice).withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + (full.upto - full.words))
        stop = last.where(F.col("upto") > budget).orderBy(*order).limit(1).first()
        key = F.struct(*[F.lit(stop[c]).alias(c) for c in order])
        taken = lambda t: (F.struct(F.col(t).alias("time"), F.col("shuffle"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.col("size")) < key).cast("int")
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * (taken("first") + taken("second"))).cast("long").alias("taken"), *keep), tables


def take(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it; documents without words are not taken.

    Rows that repeat a doc_id are each taken as often as the one of them that is taken most. Rows with a null doc_id are not taken.
    """
    mixed, _ = mix(docs, **how)
    often = mixed.where("taken > 0").groupBy("doc_id").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("often_")).withColumnRenamed("doc_id", "doc_id_")
    out = docs.join(often, docs["doc_id"].cast("long") == often["doc_id_"])
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("often_")))).select(*[docs[c] for c in docs.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(cast(doc_id AS varchar), '')) AS shuffle,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size FROM documents),
named AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, [5, 2, 1][k % 3 + 1] AS weight, 2.0e0 * source_size AS room FROM named),
filling AS (
  SELECT *, sum(source_size * 1.5e0) OVER () - coalesce(sum(room) OVER f, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS heavy FROM weighed
  WINDOW f AS (ORDER BY room / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT min_by(left_over / heavy, room / weight) AS level FROM filling WHERE room / weight > left_over / heavy),
goals AS (SELECT source, source_size, CASE WHEN level IS NULL THEN room ELSE least(room, weight * level) END AS target FROM filling, lv),
placed AS (
  SELECT d.doc_id, d.size, d.shuffle, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER () AS id
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT id, doc_id, size, shuffle, CASE WHEN target > 0 THEN upto / target ELSE 0 END AS time FROM placed
  UNION ALL SELECT id, doc_id, size, shuffle, CASE WHEN target > 0 THEN (upto + source_size) / target ELSE 0 END FROM placed),
queue AS (SELECT id, size, sum(size) OVER (ORDER BY time, shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM copies WHERE size > 0),
cut AS (SELECT id, sum(size) AS taken FROM queue WHERE total <= (SELECT floor(1.5e0 * sum(size)) FROM sized) GROUP BY id)
SELECT p.doc_id, p.size, p.source_size, p.target, cast(coalesce(c.taken, 0) AS bigint) AS taken FROM placed p LEFT JOIN cut c USING (id)
"""
