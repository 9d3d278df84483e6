"""Mixing sources to target weights with Efraimidis-Spirakis sampling (JVM only).

Every source has a share of the budget by its weight, but at most ``cap`` times
its own size; what is above goes to the other sources by weight until none is
above.  That fixed point is ``target = min(cap * size, level * weight)`` with one
level for all, found by sorting sources by ``size / weight``.

Within a source a document has the key ``-ln(u) / weight`` with u from a hash
of its id, so that a smaller key is likelier for a better document.  Whole epochs
``floor(target / size)`` come first; the rest of the budget goes to the smallest
keys, and the document on the edge is taken in part, so that the source's words
add up to its target exactly (rounded down).

Keys are cut into ``BUCKETS`` fixed ranges.  Sums per source and range (a bounded
table) give the range where the budget ends, and only that range's documents are
sorted: no source, however large, meets in one task.

Nulls and edge cases: null text has size 0; null is a source of its own, last;
a null or non-positive weight counts as the smallest weight; a null id takes the
text in its place for the key; repeated rows are taken one by one; sources of size 0 have target 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
BUCKETS = 4096
LEAST_WEIGHT = 1e-3
SYMBOLS = "#*$%&|<>"


def sizes(text: Column) -> Column:
    """Number of words of a text."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less the more symbols a text has."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    return 1.0 / (1.0 + 20.0 * (n - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1)))


def sampling_key(key: Column, weight: Column, seed: int = 0) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(LEAST_WEIGHT))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size`` (one row a source) to the same with ``target``, ``epochs`` and ``rest``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source, sums only
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level).withColumn("free", F.col("ratio") > F.col("level"))
    common = F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.when(F.col("ratio") > common, common * F.col("weight")).otherwise(F.col("limit"))
    out = found.withColumn("target", F.coalesce(target, F.col("limit")))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = F.greatest(F.floor(F.col("target") + 1e-6).cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0))
    return out.withColumn("rest", rest.cast("long")).select("source", "source_size", "target", "epochs", "rest")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 0,
    row: Column | None = None,
) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, source, copies``, and ``row`` if one is given.

    ``taken`` are words, repeats counted; ``copies`` counts whole documents, the
    one on the edge when at least half of it is taken.
    """
    w = quality_weight(F.col(text)) if weight is None else weight
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(source).alias("source"),
        sizes(F.col(text)).alias("size"),
        sampling_key(F.coalesce(F.col(key).cast("string"), F.col(text)), w, seed).alias("key"),
        *([] if row is None else [row.alias("row")]),
    ).withColumn("part", F.least(F.lit(BUCKETS - 1), F.floor(BUCKETS * (1 - F.exp(-F.col("key"))))).cast("int"))
    rows = C.stage(rows, "mix")
    sums = C.stage(rows.groupBy("source", "part").agg(F.sum("size").alias("n")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    # the range of keys in which each source's rest ends
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("upto", F.sum("n").over(up_to))
    edge = (
        plan.alias("p")
        .join(running.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")))
        .filter("upto > rest")
        .groupBy("p.source")
        .agg(F.min(F.struct("part", F.expr("upto - n").alias("before"))).alias("e"))
        .select("source", F.col("e.part").alias("edge"), F.col("e.before").alias("before"))
    )
    full = plan.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    full = C.stage(full.select("p.*", F.coalesce("edge", F.lit(BUCKETS)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")), "mix-plan")
    many = full.count()
    joined = rows.alias("d").join(C.small(full, 200, many).alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")))
    joined = joined.select("d.*", "source_size", "target", "epochs", "rest", "edge", "before")
    outside = joined.filter("part != edge").withColumn("extra", F.when(F.col("part") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    ahead = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(ahead), F.lit(0))
    on_edge = joined.filter("part = edge").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    both = outside.unionByName(on_edge)
    half = F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    return both.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        "source",
        (F.col("epochs") + half).cast("long").alias("copies"),
        *([] if row is None else ["row"]),
    )


def _times(rows: DataFrame, copies: str) -> DataFrame:
    """Rows as often as ``copies`` says; long runs are made in two steps of bounded arrays."""
    some = rows.filter(f"{copies} > 0").withColumn("__thousand", F.explode(F.expr(f"sequence(0L, ({copies} - 1) div 1000)")))
    return some.withColumn("__one", F.explode(F.expr(f"sequence(1L, least(1000L, {copies} - 1000 * __thousand))")))


def materialize(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: rows of ``docs`` as often as they are taken.

    A row is known by a hash of all its columns, so null and repeated ids do no
    harm.  Rows alike in all columns share what is taken of them.
    """
    taken = mix(docs, row=C.row_hash(docs), **options).groupBy("row").agg(F.sum("copies").alias("c"), F.count("*").alias("n"))
    taken = C.stage(taken.filter("c > 0").select(F.col("row").alias("__hash"), F.expr("c div n").alias("__each"), F.expr("c % n").alias("__over")), "mix-rows")
    marked = docs.select(C.row_hash(docs).alias("__own"), F.struct("*").alias("__row"))
    joined = marked.join(taken, F.col("__own") == F.col("__hash"))
    out = _times(joined, "__each")
    if taken.filter("__over > 0").limit(1).count():
        out = out.unionByName(_times(joined.filter("__over > 0").dropDuplicates(["__own"]), "__over"))
    return out.select("__row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         -ln((CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / greatest(1.0 / (1.0 + 20.0 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))
             / greatest(length(coalesce(text, '')), 1)), 0.001) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
t AS (SELECT l.source, source_size, CASE WHEN ratio > c.level THEN c.level * weight ELSE lim END AS target FROM l LEFT JOIN c ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
q AS (SELECT *, greatest(CAST(floor(target + 1e-6) AS BIGINT) - epochs * source_size, 0) AS rest FROM e),
p AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.epochs, q.rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 3) AS target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM p
"""
