"""Mixing sources to target weights: iterative proportional fitting, calibrated Bernoulli sampling.

Token weights of the (source, language, topic) cells are raked until their sums meet all three target
marginals. A cell's factor says how much of it the mix wants; one multiplier turns the factors into
inclusion probabilities, at most 1, that spend the token budget in expectation. A document is drawn if a hash of its id
and text falls below its cell's probability: no shuffle of texts, and the same draw on every run.

The raking works on the cells, one row per combination that occurs, as windows in one plan. A null source or
language is a value of its own. Empty and null texts have no tokens: they get their cell's probability, 0 in a
cell without tokens. Repeated rows are drawn together. Columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import checkpoint, written

# fixed values: topics by the first pattern that occurs in the text
TOPICS = {
    "legal": r"(?i)licen[cs]ed? under|copyright|all rights reserved",
    "secrets": r"(?i)(password|token|api_?key)\s*=",
    "web": r"https?://|www\.|\b[\w.]+@[\w.]+\.\w+",
    "tables": r"\|[^|]+\|[^|]+\|",
    "loud": r"!!",
}
OTHER = "prose"
DRAW = 1 << 52


def topic_of(text: Column, topics: dict[str, str] | None = None) -> Column:
    """The first topic whose pattern occurs in the text, else ``prose``."""
    out = F.lit(OTHER)
    for name, pattern in reversed((topics or TOPICS).items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """White-space separated tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from an MD5 of seed, id and text."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 13), 16, 10).cast("double") / F.lit(float(DRAW))


def rake(cells: DataFrame, margins: list[str], weight: str, tempers: list[float], rounds: int) -> DataFrame:
    """``cells`` with fitted: weights whose marginals are the tempered shares of the total.

    The target of a marginal's value is its share of the weight to the power of its temper (1 keeps the mix, 0 is
    equal parts), scaled to the whole. Cells without weight keep 0.
    """
    whole = Window.partitionBy()
    out = cells.withColumn("fitted", F.col(weight).cast("double"))
    for name, temper in zip(margins, tempers, strict=True):
        own = Window.partitionBy(name)
        # each cell carries its share of the value's power, so that sums over cells count each value once
        sums = F.sum(weight).over(own).cast("double")
        out = out.withColumn("__sum", sums).withColumn(
            f"__t_{name}", F.when(F.col("__sum") > 0, F.pow("__sum", F.lit(float(temper)))).otherwise(F.lit(0.0))
        )
        out = out.withColumn("__n", F.count(F.lit(1)).over(own))
        scale = F.sum(F.col(f"__t_{name}") / F.col("__n")).over(whole)
        out = out.withColumn("__scale", scale).withColumn(f"__t_{name}", F.col(f"__t_{name}") / F.col("__scale"))
    out = out.withColumn("__total", F.sum(weight).over(whole).cast("double")).drop("__sum", "__n", "__scale")
    for _ in range(rounds):
        for name in margins:
            own = F.sum("fitted").over(Window.partitionBy(name))
            out = out.withColumn("__own", own).withColumn(
                "fitted",
                F.when(F.col("__own") > 0, F.col("fitted") * F.col(f"__t_{name}") * F.col("__total") / F.col("__own")).otherwise(F.lit(0.0)),
            )
    return out.drop("__own", "__total", *[f"__t_{m}" for m in margins])


def calibrate(cells: DataFrame, weight: str, share: float, rounds: int = 8) -> DataFrame:
    """``cells`` with probability: min(1, c x fitted / weight), c such that ``share`` of the weight is expected.

    Each round holds the cells that reach 1 and spreads the rest of the budget over the others.
    """
    whole = Window.partitionBy()
    factor = F.when(F.col(weight) > 0, F.col("fitted") / F.col(weight)).otherwise(F.lit(0.0))
    out = cells.withColumn("__f", factor).withColumn("__budget", F.sum(weight).over(whole) * F.lit(float(share)))
    out = out.withColumn("probability", F.lit(0.0))
    for _ in range(rounds):
        full = F.sum(F.when(F.col("probability") >= 1, F.col(weight)).otherwise(0)).over(whole)
        free = F.sum(F.when(F.col("probability") < 1, F.col("fitted")).otherwise(0.0)).over(whole)
        out = out.withColumn("__full", full).withColumn("__free", free)
        raised = F.when(F.col("__free") > 0, F.col("__f") * (F.col("__budget") - F.col("__full")) / F.col("__free")).otherwise(F.lit(0.0))
        out = out.withColumn(
            "probability", F.when(F.col("probability") >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raised)))
        )
    return out.drop("__f", "__budget", "__full", "__free")


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    share: float = 0.5,
    tempers: tuple[float, float, float] = (0.5, 0.7, 0.5),
    topics: dict[str, str] | None = None,
    rounds: int = 12,
    seed: int = 11,
    columns: list[str] | None = None,
) -> DataFrame:
    """``docs``, or its ``columns``, with topic, n_tokens, probability and drawn.

    ``share`` of all tokens is the budget; ``tempers`` set the targets of source, language and topic. Cells,
    one row per combination that occurs, are broadcast by Spark's own size check.
    """
    kept = docs.columns if columns is None else list(columns)
    kept = [c for c in kept if c not in ("topic", "n_tokens", "probability", "drawn")]
    cell = {"__s": F.coalesce(F.col(source).cast("string"), F.lit("\\N")), "__l": F.coalesce(F.col(lang).cast("string"), F.lit("\\N"))}
    # texts are searched once: what they say is written beside the columns to return
    marked = written(docs.select(
        *kept,
        *[value.alias(name) for name, value in cell.items()],
        F.coalesce(topic_of(F.col(text), topics), F.lit(OTHER)).alias("topic"),
        tokens_of(F.col(text)).alias("n_tokens"),
        uniform(F.col(key), F.col(text), seed).alias("__u"),
    ))
    cells = marked.groupBy("__s", "__l", "topic").agg(F.sum("n_tokens").alias("tokens"))
    fitted = rake(checkpoint(cells), ["__s", "__l", "topic"], "tokens", list(tempers), rounds)
    # a written table has a known size: Spark broadcasts the cells if they are few, and joins by shuffle beyond that
    plan = written(calibrate(fitted, "tokens", share).select("__s", "__l", "topic", "probability").coalesce(1))
    joined = marked.join(plan, ["__s", "__l", "topic"], "left")
    chance = F.coalesce("probability", F.lit(0.0))
    out = joined.withColumn("probability", chance).withColumn("drawn", F.col("__u") < F.col("probability"))
    return out.select("topic", *kept, "n_tokens", "probability", "drawn")
