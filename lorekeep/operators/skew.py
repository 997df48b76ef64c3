"""Running numbers over groups of any size.

A window partitioned by a key puts the whole group in one task. One key may hold a third of
the rows, so running values are computed in two levels instead: inside ``(key, bucket)``,
where ``bucket`` is a coarse non-decreasing function of the order, and over one summary row per
bucket. The carry of the earlier buckets is joined back. The result equals the single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from lorekeep.session import written

_BUCKET = "__bucket"
BUCKET_ROWS = 500_000
_SAMPLE = 16


def _direction(name: str) -> tuple[str, bool]:
    return (name[1:], True) if name.startswith("-") else (name, False)


def _not_after(split: Column, names: list[str]) -> Column:
    """Whether a splitter stands at or before the row in the order ``names``; nulls first, or last if descending."""
    at_or_before = F.lit(True)
    for name in reversed(names):
        column, down = _direction(name)
        a, b = split[column], F.col(column)
        less = lambda x, y: (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))
        at_or_before = (less(b, a) if down else less(a, b)) | (a.eqNullSafe(b) & at_or_before)
    return at_or_before


def order_bucket(df: DataFrame, names: list[str], rows: int = BUCKET_ROWS) -> Column:
    """A number that does not decrease along the order ``names`` ("-" before a name: descending) and cuts ``df``
    into ranges of about ``rows`` rows.

    The cuts are rows of a sample drawn by a hash of the order columns, 16 a range, which is enlarged
    until no range holds four times its share. The last names should tell ties apart: rows that are
    equal in all of them cannot be cut. The driver holds the sample; a row is compared with two lists
    of about the square root of the number of ranges.
    """
    columns = [_direction(n)[0] for n in names]
    total = df.count()
    ranges = -(-total // rows)
    if ranges <= 1:
        return F.lit(0)
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in map(_direction, names)]
    wanted, last = _SAMPLE * ranges, -1
    while True:
        draw = F.pmod(F.xxhash64(*columns), F.lit(max(1, total // wanted))) == 0
        drawn = df.where(draw).select(*columns).distinct().orderBy(*order).collect()
        step = max(1, len(drawn) // ranges)
        bucket = _place(df, names, drawn[step::step])
        largest = df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0]
        if largest <= 4 * rows or wanted >= total or len(drawn) == last:
            return bucket
        wanted, last = 4 * wanted, len(drawn)


def _place(df: DataFrame, names: list[str], splits: list) -> Column:
    """How many of the ordered ``splits`` stand at or before the row: groups of them first, then one group."""
    if not splits:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    literal = lambda r: F.struct(*[_literal(r[c], types[c]).alias(c) for c in r.asDict()])
    width = max(1, round(len(splits) ** 0.5))
    groups = [splits[k : k + width] for k in range(0, len(splits), width)]
    before = lambda s: _not_after(s, names)
    group = F.size(F.filter(F.array(*[literal(g[0]) for g in groups]), before))
    inside = F.get(F.array(*[F.array(*map(literal, g)) for g in groups]), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * width + F.size(F.filter(inside, before)))


def _literal(value, kind: DataType) -> Column:
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    *,
    number: str | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lead: dict[str, str] | None = None,
) -> DataFrame:
    """Add row numbers, running sums, running maxima and next values per key.

    ``bucket`` must not decrease along ``order`` and must keep each bucket small enough for one
    task. ``lead`` maps a new column to the column whose value on the next row it takes.
    """
    sums, maxes, lead = sums or {}, maxes or {}, lead or {}
    inner = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(_BUCKET)

    # a cache-free plan: the summary rescans only keys, bucket and values, and combines them early
    base = df.withColumn(_BUCKET, bucket)
    parts, totals, carries, final = {}, [], {}, {}
    if number:
        parts[f"__n_{number}"] = F.row_number().over(inner)
        totals.append(F.count(F.lit(1)).alias(f"__t_{number}"))
        carries[f"__c_{number}"] = F.sum(f"__t_{number}").over(before)
        final[number] = F.col(f"__n_{number}") + F.coalesce(f"__c_{number}", F.lit(0))
    for name, value in sums.items():
        parts[f"__n_{name}"] = F.sum(value).over(upto)
        totals.append(F.sum(value).alias(f"__t_{name}"))
        carries[f"__c_{name}"] = F.sum(f"__t_{name}").over(before)
        final[name] = F.col(f"__n_{name}") + F.coalesce(f"__c_{name}", F.lit(0))
    for name, value in maxes.items():
        parts[f"__n_{name}"] = F.max(value).over(upto)
        totals.append(F.max(value).alias(f"__t_{name}"))
        carries[f"__c_{name}"] = F.max(f"__t_{name}").over(before)
        final[name] = F.greatest(f"__n_{name}", f"__c_{name}")
    for name, source in lead.items():
        # the last row of a bucket takes the first value of the next bucket
        parts[f"__n_{name}"] = F.lead(F.struct(source)).over(inner)
        parts["__first"] = F.row_number().over(inner)
        head = F.when(F.col("__first") == 1, F.struct(source))
        totals.append(F.first(head, ignorenulls=True).alias(f"__t_{name}"))
        carries[f"__c_{name}"] = F.lead(f"__t_{name}").over(after)
        final[name] = F.coalesce(f"__n_{name}", f"__c_{name}")[source]

    local = base.withColumns(parts)
    carry = (
        (local if lead else base).groupBy(*keys, _BUCKET).agg(*totals).withColumns(carries).select(*keys, _BUCKET, *carries)
    )
    joined = local.join(carry, [*keys, _BUCKET], "left").withColumns(final)
    return joined.drop(_BUCKET, *parts, *carries)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``.

    A max_by aggregate combines before the shuffle, so a hot key sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
        .select(*keys, *[F.col("__last")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order``, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
        .select(*keys, *[F.col("__first")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def product(left: DataFrame, right: DataFrame, key: str, side: int = 1024, across: int | None = None) -> DataFrame:
    """The join of two tables on a key that repeats in both.

    The pairs of a hot key are cut into tiles of about ``side`` rows of ``left`` by ``across`` (as many) of ``right``: each
    row lies in one row of tiles or one column of them, so no task makes all pairs of a key. A row is copied once for every
    tile it lies in, so the side with wide rows takes the smaller number. A task makes the pairs of hot keys first, and
    a row of ``left`` meets its rows of ``right`` one after the other: what is written repeats few values for long.
    """
    across = across or side
    count = lambda rows, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    hot = count(left, "__l").join(count(right, "__r"), key).where(F.col("__l") * F.col("__r") > side * across)
    cuts = written(hot.select(key, *[F.ceil(F.col(c) / n).cast("int").alias(c) for c, n in (("__l", side), ("__r", across))]))
    # the count is given: the pairs are far more than the bytes that are dealt out
    parts, tiles = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["__cold", key, "__l_at", "__r_at"]

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        cut = rows.join(cuts, key, "left")
        lies = F.coalesce(F.pmod(F.xxhash64(*rows.columns), own), F.lit(0)).cast("int")
        wide = F.coalesce(F.sequence(F.lit(0), F.col(other) - 1), F.array(F.lit(0)))
        at = F.col(own).isNull().alias("__cold"), lies.alias(f"{own}_at"), F.explode(wide).alias(f"{other}_at")
        return cut.select(*rows.columns, *at).repartition(parts, *tiles)

    pairs = placed(left, "__l", "__r").join(placed(right, "__r", "__l").hint("merge"), tiles)
    return pairs.drop("__cold", "__l_at", "__r_at")
