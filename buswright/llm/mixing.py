"""Mixing sources to target weights along a time-varying curriculum.

Each source has a base weight, which fixes how many words the mix takes from it,
and a slope, which says when in training. Its weight schedule is
``1 + slope * (2 t - 1)`` over training time ``t`` in [0, 1]: integrated over all
of training it is 1, so the slope moves words in time and leaves the target
alone. A source's documents follow each other in a fixed pseudo-random order and
are taken until the target is met, again from the start where it is larger than
the source. The cumulative demand at which a document is taken, as a share of
the target, is put through the inverse of the integrated schedule, which gives
its training position; a range sort by position gives the training order.

The running sum within a source is made in two levels, over buckets of the
pseudo-random order and within a bucket, so that a source with a third of all
rows is spread over all tasks. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from buswright.llm.common import WORD_PATTERN, materialise, table, text_or_empty, without

#: Base weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Slopes that belong to them: heavy sources come early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEATS = 3
#: Documents of one source that one task sorts at a time, about.
BUCKET_ROWS = 2_000
#: Sources whose targets are sent to all tasks, some 10 MB; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _cycled(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def _told_apart(column: Column, kind: DataType) -> Column:
    """A value in a form whose hash depends on all of it: hashes leave nulls and the ends of nested arrays out and don't take maps."""
    if isinstance(kind, MapType):
        entry = StructType().add("key", kind.keyType).add("value", kind.valueType)
        return _told_apart(F.map_entries(column), ArrayType(entry))
    if isinstance(kind, ArrayType):
        return F.struct(F.coalesce(F.array_size(column), F.lit(-1)).alias("n"), F.transform(column, lambda x: _told_apart(x, kind.elementType)).alias("x"))
    if isinstance(kind, StructType):
        return F.struct(column.isNull().alias("none"), *[_told_apart(column[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])
    return F.struct(column.isNull().alias("none"), column.alias("x"))


def _row_hash(docs: DataFrame) -> Column:
    """Tells rows apart that share a doc_id, by all their columns; equal rows are interchangeable."""
    return F.xxhash64(*[_told_apart(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields])


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: source, source_size, n_docs, target, slope.

    All targets add up to the sum of all sizes. A target stops at ``max_repeats``
    times its source's size and the rest is shared out again by weight. The level
    at which that comes out even is the largest of ``(total - caps of the first k)
    / (weights of the others)`` over the sources in order of cap to weight. The
    windows run over one row a source, of which there are few.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("__rank", rank)
    per = per.withColumn("__weight", _cycled(weights, F.col("__rank"))).withColumn("slope", _cycled(slopes, F.col("__rank")).cast("double"))
    cap = F.col("source_size") * F.lit(max_repeats)
    order = Window.orderBy(cap.cast("double") / F.col("__weight"), "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    open_weight = F.sum("__weight").over(Window.partitionBy()) - F.coalesce(F.sum("__weight").over(before), F.lit(0))
    per = per.withColumn("__level", rest.cast("double") / open_weight.cast("double"))
    level = F.max("__level").over(Window.partitionBy())
    per = per.withColumn("target", F.least(F.col("__weight") * level, cap.cast("double")))
    return per.select("source", "source_size", "n_docs", "target", "slope")


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, position.

    ``size`` counts words (null and empty texts: 0), ``taken`` the words that the
    mix takes, repeats counted: never more than ``max_repeats`` times the size. The
    document at which the demand of its source ends is taken in part, so a
    source's taken words differ from its target by less than one. ``position`` in
    [0, 1] is when the document is first taken, null where it is not taken. A null
    source is a source like any other and comes last. The order within a source is
    that of md5(doc_id), so reruns agree; rows that repeat a doc_id, or have none,
    are documents of their own, in the order of their sizes and then of a hash of
    the row (``row``). An empty table gives an empty result.
    """
    sizes = materialise(
        docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("ord"), _row_hash(docs).alias("row")),
        "mix-sizes",
    )
    targets = materialise(source_targets(sizes, weights, slopes, max_repeats).coalesce(1), "mix-targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    digits = 2
    while 16**digits * BUCKET_ROWS < largest and digits < 7:
        digits += 1

    sizes = sizes.withColumn("bucket", F.substring("ord", 1, digits))
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("ord", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("__start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # source tables have one row a source; bucket sums up to 16**digits rows a source
    left, right = placed.alias("a"), sums.alias("b")
    placed = left.join(right, F.expr("a.source <=> b.source AND a.bucket = b.bucket")).select("a.*", (F.col("a.__start") + F.col("b.__offset")).alias("start"))
    few = targets.count() <= BROADCAST_SOURCES
    left, right = placed.alias("a"), (F.broadcast(targets) if few else targets).alias("t")
    placed = left.join(right, F.expr("a.source <=> t.source")).select("a.*", "t.source_size", "t.target", "t.slope")

    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left_over = F.round(F.col("target") - rounds * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left_over - F.col("start")))
    placed = placed.withColumn("taken", (F.col("size") * rounds + part).cast("long"))
    # the demand is met after target words: the share met before this document, and its inverse
    share = F.least(F.lit(1.0), F.col("start") / F.col("target"))
    early = F.lit(1.0) - F.col("slope")
    inverse = F.when(F.col("slope") == 0, share).otherwise((F.sqrt(early * early + 4.0 * F.col("slope") * share) - early) / (2.0 * F.col("slope")))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, F.round(F.abs(inverse), 6)))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "start", "slope", "ord", "row")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, in training order: columns of ``docs`` and ``mix_position``.

    A document comes once for each time that the mix begins to take it, so up to
    ``max_repeats`` times, and whole each time: the part in which the demand of a
    source ends is a matter of counting, not of cutting a text. Documents that are
    not taken are left out, among them those without words. Rows without doc_id and
    rows that repeat one are documents like any others; equal rows are taken as
    often as the plan has it for all of them, and reruns agree. A column of ``docs``
    named mix_position is replaced, all others stay, whatever their names: rows
    travel as one structure. Columns may be of any type, maps and nested ones too. The
    words of a very long text are counted by the task that reads it, which holds no more
    than that row. The result is range sorted by position, then doc_id;
    an empty table gives an empty one.
    """
    plan = mix_plan(docs, **options)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    at = F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size")) / F.col("target")))
    shares = F.when(F.col("taken") > 0, at)
    plan = materialise(plan.select(F.col("doc_id").alias("id"), "row", "slope", shares.alias("shares")), "mix-plan")

    kept = without(docs, "mix_position")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("doc"), F.col("doc_id").alias("doc_key"), _row_hash(docs).alias("doc_row"))
    same = F.expr("doc_row = row AND doc_key <=> id")
    # of equal rows one stands for all, since each has a row of the plan
    equal = materialise(plan.groupBy("row", "id").count().where("count > 1").select("row", "id"), "mix-equal")
    if equal.limit(1).count():
        one = rows.join(equal, same, "left_semi").dropDuplicates(["doc_row", "doc_key"])
        rows = rows.join(equal, same, "left_anti").unionByName(one)
    taken = rows.join(plan.where("shares IS NOT NULL"), same).withColumn("share", F.explode("shares"))
    early = F.lit(1.0) - F.col("slope")
    when = F.when(F.col("slope") == 0, F.col("share")).otherwise((F.sqrt(early * early + 4.0 * F.col("slope") * F.col("share")) - early) / (2.0 * F.col("slope")))
    taken = taken.withColumn("mix_position", when).orderBy("mix_position", "doc_key", "doc_row")
    return taken.select("doc.*", "mix_position")


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS ord
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rnk
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CASE (rnk - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS lev
  FROM w WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, slope,
         least(weight * (SELECT max(lev) FROM l), CAST(3 * source_size AS DOUBLE)) AS target
  FROM l
), p AS (
  SELECT d.*, t.source_size, t.target, t.slope,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM p
), r AS (
  SELECT *, CAST(size * rounds + greatest(0, least(size, CAST(round(target - rounds * source_size) AS BIGINT) - start)) AS BIGINT) AS taken,
         least(1.0::DOUBLE, start / target) AS share
  FROM q
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(abs(CASE WHEN slope = 0 THEN share
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END), 6) END AS position
FROM r
"""
