"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import Tables, cut, small, unused

#: A source's weight by its place among the sources in code point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all sizes that the mix takes, and how often a document may be taken.
SHARE, REPEATS = 1.5, 2
#: Sources up to which their facts are broadcast; more are joined by a shuffle.
SMALL_ROWS = 100_000


def n_words(column: str = "text"):
    """Number of runs of other than the six ASCII white-space characters; null has none."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def shuffle_hash(seed: int, doc_id, text):
    """60 bits that deal documents out: from seed, id and text, so that rows without an id are dealt out too."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def oracle(weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17) -> str:
    """DuckDB SQL for the rows of ``mix`` over ``documents``."""
    level = f"({share} * (SELECT sum(size) FROM d) - coalesce(sum(full_) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
              CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ({list(weights)})[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS INTEGER)] AS w0 FROM d GROUP BY source),
        f AS (SELECT *, CAST(w0 AS DOUBLE) AS w, CAST({repeats} AS DOUBLE) * source_size AS full_ FROM s),
        l AS (SELECT *, {level} AS level FROM f WINDOW o AS (ORDER BY full_ / w, source NULLS LAST)),
        t AS (SELECT source, source_size, w, least(full_, coalesce(w * (SELECT arg_min(level, (full_ / w, source IS NULL, source)) FROM l WHERE full_ > w * level), full_)) AS target FROM l),
        c AS (SELECT d.*, source_size, w, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT r, h, size, (cum + k * source_size) / w AS e FROM c, range({repeats}) x(k)),
        q AS (SELECT *, sum(size) OVER (ORDER BY e, h, size ROWS UNBOUNDED PRECEDING) AS run FROM p),
        cut AS (SELECT max(e) AS e FROM q WHERE run <= {share} * (SELECT sum(size) FROM d))
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
               CAST(size * (SELECT count(*) FROM range({repeats}) x(k) WHERE (cum + k * source_size) / w <= (SELECT e FROM cut)) AS BIGINT) AS taken FROM c"""


def targets(sources: DataFrame, *, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size to source, source_size, weight, target: ``share`` of all sizes dealt by weight, none above ``repeats`` times its size.

    The level L with sum(min(repeats * size, weight * L)) = budget is found in one pass over the sources in the order
    of size / weight, where those that are full come first.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(repeats))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    known = sources.select(*sources.columns, weight.alias("weight"), full.alias("full"), (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).alias("budget"))
    levels = known.withColumn("level", (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that its level does not fill, and all after it, stop at that level
    open_ = F.when(F.col("full") > F.col("weight") * F.col("level"), F.col("level"))
    stop = F.first(open_, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select(*sources.columns, "weight", F.least("full", F.coalesce(F.col("weight") * stop, F.col("full"))).alias("target"))


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the columns named in ``carry``.

    Each source's documents are shuffled by a hash. A document's pass ends at the virtual time (words of its source up
    to it) / weight, and its k-th repeat a whole source later. All passes are sorted by that time over the cluster and
    the mix takes them in order up to ``share`` of all words. Prefix sums run over buckets of the hash, and of the
    range-sorted passes, so no source, however large, goes to one task. Documents are taken whole; of equal rows each
    counts. A null or empty text has size 0 and is never taken; a null source is a source, the last; equal runs agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    sized = cut(docs.select(*carry, "doc_id", "source", key.alias("key"), n_words().alias("size"), shuffle_hash(seed, F.col("doc_id"), text).alias("h")))
    sources = cut(targets(sized.groupBy("source", "key").agg(F.sum("size").alias("source_size")), weights=weights, share=share, repeats=repeats))
    rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = max(1, math.isqrt(rows))

    # words of the source up to a document: those of lower buckets of the hash, and those before it in its own
    sized = sized.withColumn("bucket", F.shiftright(F.shiftright("h", 30) * n_buckets, 30))  # in the order of the hash
    lower = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("key", "bucket").agg(F.sum("size").alias("words")).select("key", "bucket", F.coalesce(F.sum("words").over(lower), F.lit(0)).alias("low"))
    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    timed = sized.withColumn("inside", inside).join(sums, ["key", "bucket"])
    facts = sources.select("key", "source_size", "weight", "target")
    timed = timed.join(F.broadcast(facts) if facts.count() <= SMALL_ROWS else facts, "key")
    first = (F.col("low") + F.col("inside")).cast("double")
    ends = F.array(*[(first + F.lit(k) * F.col("source_size")) / F.col("weight") for k in range(repeats)])
    timed = cut(timed.select(*carry, "doc_id", "size", "h", "source_size", "target", ends.alias("ends")))

    last = cutoff(timed.select(F.explode("ends").alias("end"), "h", "size"), share * total)
    taken = F.size(F.filter("ends", lambda e: e <= F.lit(last))).cast("long") * F.col("size")
    return timed.select(*carry, "doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"))


def taken(docs: DataFrame, name: str = "times", **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each with how often in a column ``name`` (with underscores before it while it is a name of ``docs``).

    Rows are told by a key of their own, with which the texts are written once: rows that share an id, or lack one, are each
    judged by themselves.
    """
    name, row, other = unused(docs, name, "__row", "__taken")
    keyed = Tables(docs.sparkSession).write("keyed", docs.withColumn(row, F.monotonically_increasing_id()))
    found = mix(keyed, carry=(row,), **settings).filter(F.col("taken") > 0)
    found = small(found.select(F.col(row).alias(other), (F.col("taken") / F.col("size")).cast("int").alias(name)))
    return keyed.join(found, keyed[row] == found[other]).drop(row, other)


def cutoff(passes: DataFrame, budget: float) -> float:
    """The last virtual time up to which passes (end, h, size), sorted by range over the cluster, fit the budget."""
    spark = passes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(passes.repartitionByRange(n, "end", "h").select("end", "h", "size", F.spark_partition_id().alias("part")))
    before = 0
    parts = sorted(ranged.groupBy("part").agg(F.sum("size").alias("words"), F.max("end").alias("end")).collect())
    last = -1.0
    for part, words, end in parts:  # a row for each partition
        if before + words > budget:
            run = F.sum("size").over(Window.partitionBy("part").orderBy("end", "h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            found = ranged.filter(F.col("part") == part).select("end", run.alias("run")).filter(F.col("run") + before <= budget).agg(F.max("end")).first()[0]
            return last if found is None else found
        before, last = before + words, end
    return last
