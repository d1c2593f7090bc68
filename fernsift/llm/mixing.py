"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight, which gives it a share of the words of the mix. A source is read whole as often as its target
allows; what is left is a weighted sample without replacement: each document has an exponential key, a hash of its id
scaled by its quality, documents are sorted by key within their source, and their sizes are summed up to the rest of the budget.

Only the place of the cut is needed, not the order, so no source is sorted: sizes are summed in buckets of the key, sums
run over the buckets, and only the bucket that holds the cut is put in order. A source with a third of all
documents costs its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernsift.llm.shared import ranked, store

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST = 2.0
BUCKETS = 4096
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Between 0 and 1: the fewer of the characters are neither letters nor white space, the higher."""
    odd = F.coalesce(F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")), F.lit(0))
    return F.lit(1.0) / (1 + 10 * odd / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)))


def sampling_key(key: Column, quality: Column, seed: int = SEED) -> Column:
    """-ln(u) / quality with u in (0, 1) from a hash; the smallest keys are taken first."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size)``: shares by weight, the weights given to the sources in order of
    code points (null last) and repeating; no target above ``most`` times the source, the excess shared again by weight.
    """
    order = [F.col("source").asc_nulls_last()]
    placed = ranked(sources, order, "nth", "sources")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("nth") % len(weights)).cast("int")]
    placed = store(placed.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "weighted-sources")
    words = placed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0  # words per unit of weight; rises until no source is above its cap
    while level != before:
        before = level
        full = F.lit(level) * F.col("weight") > F.col("cap")
        row = placed.agg(F.sum(F.when(full, F.col("cap"))).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["open"]:
            level = (total * words - (row["given"] or 0.0)) / row["open"]
    return placed.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("cap"))).select("source", "source_size", "target")


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """From ``sized(id, source, size, e)``: per source its size, target, whole epochs, and where the sample ends.

    The sample is of the keys in buckets below ``cut_bucket`` and in it up to ``(cut_e, cut_id)``. A document belongs to it if its
    middle lies within the rest of the budget, so the words taken differ from the target by half of one document at most.
    Rows with the same id and key are taken together.
    """
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    binned = sized.filter("size > 0").withColumn("bucket", _bucket(F.col("e")))
    sums = binned.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    cut = (
        running.alias("r")
        .join(sources.alias("s"), same("r", "s"))
        .filter("s.rest > 0 and r.upto >= s.rest and r.upto - r.words < s.rest")
        .select("s.source", "s.rest", "r.bucket", (F.col("r.upto") - F.col("r.words")).alias("before"))
    )
    cut = store(cut, "cuts")
    units = (
        binned.alias("b")
        .join(cut.alias("c"), same("b", "c") & (F.col("b.bucket") == F.col("c.bucket")))
        .groupBy("c.source", "c.rest", "c.before", "b.e", "b.id")
        .agg(F.sum("b.size").alias("words"))
    )
    order = Window.partitionBy("source").orderBy("e", "id")
    taken = units.withColumn("upto", F.col("before") + F.sum("words").over(order)).filter("2 * upto - words <= 2 * rest")
    last = taken.groupBy("source").agg(F.max(F.struct("e", "id")).alias("last"))
    both = cut.alias("c").join(last.alias("l"), same("c", "l"), "left").select("c.source", "c.bucket", "l.last")
    return store(
        sources.alias("s")
        .join(both.alias("c"), same("s", "c"), "left")
        .select(
            "s.source",
            "s.source_size",
            "s.target",
            "s.epochs",
            F.col("c.bucket").alias("cut_bucket"),
            F.col("c.last.e").alias("cut_e"),
            F.col("c.last.id").alias("cut_id"),
        ),
        "mix-plan",
    )


def _bucket(e: Column) -> Column:
    return F.least(F.floor((1 - F.exp(-e)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    seed: int = SEED,
    into: str = "mixed",
) -> DataFrame:
    """``docs`` with a struct ``into`` of ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` words.

    ``quality`` is a positive weight per row, by default from the text. A null text has no words and is taken in whole epochs only, as
    is any without words; null sources are one source, the last; rows with a null id go by their texts, so equal ones are taken together. Runs with the same
    seed agree. Only one row per source moves between the two readings of ``docs``; ``into`` replaces a column of that name.
    """
    size = word_count(F.col(text))
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    e = sampling_key(named, text_quality(F.col(text)) if quality is None else quality, seed)
    who = F.coalesce(F.col(key).cast("long"), F.xxhash64(text))
    sized = docs.select(who.alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"), e.alias("e"))
    return taken(docs, plan(store(sized, "sizes"), weights, total, most), who, size, e, F.col(source).cast("string"), into)


def taken(docs: DataFrame, of_source: DataFrame, who: Column, size: Column, e: Column, source: Column, into: str) -> DataFrame:
    """Apply a plan to rows; sources are few or many, so how they are joined is left to their size."""
    names = [c for c in docs.columns if c != into]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.struct(source.alias("source"), who.alias("id"), size.alias("size"), e.alias("e")).alias("_own"))
    of_source = of_source.select(F.struct(*of_source.columns).alias("_plan"))
    both = rows.join(of_source, F.col("_own.source").eqNullSafe(F.col("_plan.source")))
    bucket = _bucket(F.col("_own.e"))
    first = (F.col("_own.e") < F.col("_plan.cut_e")) | ((F.col("_own.e") == F.col("_plan.cut_e")) & (F.col("_own.id") <= F.col("_plan.cut_id")))
    inside = (bucket < F.col("_plan.cut_bucket")) | ((bucket == F.col("_plan.cut_bucket")) & F.coalesce(first, F.lit(False)))
    sampled = F.coalesce(inside, F.lit(False)) & (F.col("_own.size") > 0)
    copies = F.col("_plan.epochs") + sampled.cast("int")
    mixed = F.struct(
        F.col("_own.size").alias("size"),
        F.col("_plan.source_size").alias("source_size"),
        F.col("_plan.target").alias("target"),
        copies.alias("copies"),
        (F.col("_own.size") * copies).alias("taken"),
    )
    return both.select(*[F.col(f"`{c}`") for c in names], mixed.alias(into))


def draw(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns only."""
    repeated = mix(docs, into="_mixed", **how).filter("_mixed.copies > 0")
    repeated = repeated.withColumn("_mixed", F.explode(F.sequence(F.lit(1), F.col("_mixed.copies"))))
    return repeated.drop("_mixed")
