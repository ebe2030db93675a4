"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. A source's documents are range-partitioned by that key: by its first hexadecimal
digits, as many as leave about RANGE_ROWS documents a range. Prefix sums over the ranges are taken by levels: a node of a
level has at most 256 children, so no window holds more sums, however many ranges or documents a source has. The levels lead to the one range in which the source's budget ends; only that range is sorted, and its running sum gives the
exact cut. What goes to a shuffle is one partial sum per source, range and task, and the documents of the cut ranges;
texts are never shuffled, and a source with a third of all rows is spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import WORD_PATTERN, cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents that a key range holds on average, at most; the range of a source's cut is sorted in one task.
RANGE_ROWS = 64
#: Hexadecimal digits of a key, and those that a level of the prefix sums adds: a node has at most 16**LEVEL_DIGITS children.
KEY_DIGITS, LEVEL_DIGITS = 32, 2
#: A table of sources up to this many rows is broadcast, so that documents needn't be shuffled to meet it.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The random key of a row, by id and text: rows that share an id, or have none, still have places of their own."""
    none = F.lit("null")
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), none), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), none)))


def ranked(sources: DataFrame) -> DataFrame:
    """The table with ``rank``: 0, 1, ... by code point of ``source``, null last. Sources are range-sorted over the
    cluster; ranks count within a range, after the sizes of the ranges before (one row a range)."""
    by_name = (F.col("source").isNull(), F.col("source"))
    dealt = cut(sources.repartitionByRange(*by_name).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("__part").alias("__of")).agg(F.count("*").alias("__rows"))
    earlier = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__of", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*by_name)) - 1
    return dealt.withColumn("__within", within).join(F.broadcast(before), F.col("__part") == F.col("__of")).withColumn("rank", F.col("__before") + F.col("__within")).drop("__part", "__of", "__before", "__within")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources from a table (source, source_size) with a row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target above its cap
    (max_epochs times the source's size) is set to it and the rest reshared by weight, until none is above. A round is
    one aggregate over the sources; the share per unit of weight only grows from round to round, so it is all that the
    next one needs to know.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked(sizes).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    weighed = cut(weighed.withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double")))
    level, capped = -1.0, -1
    while True:
        over = F.col("ratio") < level
        total = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("capped")).first()
        if total["weight"] is None or total["capped"] == capped:
            break
        level, capped = float(total["all"] - (total["cap"] or 0)) / float(total["weight"]), total["capped"]
    cap = F.col("cap").cast("double")
    share = F.least(cap, F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", F.when(F.col("ratio") < level, cap).otherwise(share).alias("target"))


def _ends(ranges: DataFrame, budgets: DataFrame, digits: int, met) -> DataFrame:
    """(b_source, node, before, rest): the range in which each source's rest ends, and the sum of the ranges before it."""
    path = budgets.where("rest > 0").select(F.col("source").alias("b_source"), F.lit("").alias("node"), F.lit(0).cast("long").alias("before"), "rest")
    for above in range(0, digits, LEVEL_DIGITS):
        inside = ranges.join(met(path), F.col("source").eqNullSafe(F.col("b_source")) & (F.substring("range", 1, above) == F.col("node")))
        children = inside.groupBy("b_source", "node", "before", "rest", F.substring("range", 1, above + LEVEL_DIGITS).alias("child")).agg(F.sum("range_size").alias("child_size"))
        siblings = Window.partitionBy("b_source", "node").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
        summed = children.withColumn("before", F.col("before") + F.coalesce(F.sum("child_size").over(siblings), F.lit(0)))
        path = summed.where("before < rest AND rest <= before + child_size").select("b_source", F.col("child").alias("node"), "before", "rest")
    return path


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Sizes (doc_id, source, size, key) of all documents, and one row a source with its target and its cut.

    A source takes ``epochs`` whole passes and, in one more, all documents before the cut key, and ``cut_words`` of each
    that stands at it (one, unless rows repeat an id and its text).
    """
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hash_key(F.col(doc_id), F.col(text), seed).alias("key")))
    rows, digits = sized.count(), 1
    while digits < KEY_DIGITS and rows > RANGE_ROWS * 16**digits:
        digits += 1
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    ranges = cut(ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    budgets = (
        targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    met = F.broadcast if budgets.count() <= FEW_SOURCES else lambda df: df
    inside = ranged.join(met(_ends(ranges, budgets, digits, met)), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("node")))
    inside = inside.groupBy("source", "before", "rest", "key").agg(F.sum("size").alias("tied_size"), F.sum((F.col("size") > 0).cast("long")).alias("tied"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        inside.withColumn("sum", F.col("before") + F.coalesce(F.sum("tied_size").over(running), F.lit(0)))
        .where((F.col("sum") < F.col("rest")) & (F.col("rest") <= F.col("sum") + F.col("tied_size")))
        .select(F.col("source").alias("c_source"), F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("sum")) / F.col("tied")).cast("long").alias("cut_words"))
    )
    decided = budgets.join(met(cuts), F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    return sized, cut(decided.select(F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut_key", "cut_words"))


def _met(budgets: DataFrame) -> DataFrame:
    return F.broadcast(budgets) if budgets.count() <= FEW_SOURCES else budgets


def taken(size: Column, key: Column) -> Column:
    """Words that the mix takes of a document, joined with its source's row of plan()."""
    extra = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), F.least(size, F.col("cut_words"))).otherwise(0)
    return (F.col("epochs") * size + extra).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken.

    Size is the number of words (null text: 0). A null source is a source of its own, after all others. A source
    without words has target 0. Places in the order are random by id and text, so rows that share an id, or have none,
    stand apart. Ties: rows equal in id and text share a place, and the words left at the cut in equal whole parts. An empty table gives no rows. Other columns of ``docs``, whatever their names, are not read.
    """
    sized, budgets = plan(docs, **options)
    return sized.join(_met(budgets), F.col("source").eqNullSafe(F.col("mix_source"))).select("doc_id", "source", "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"))


def materialize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: each as often as the mix takes it.

    Documents stay whole: the one at the cut is taken if at least half of it fits, so a source's total is within
    half a document of its budget (half of all rows equal to it in id and text, since equal rows stay or go together). Documents without words go when they stand behind the cut.
    """
    _, budgets = plan(docs, doc_id, text, source, seed=seed, **options)
    budgets = _met(budgets).select(*(F.col(c).alias(f"__mix_{c}") for c in budgets.columns))
    key = hash_key(F.col(doc_id), F.col(text), seed)
    fits = F.when(F.col("__mix_cut_key").isNull(), False).otherwise((key < F.col("__mix_cut_key")) | ((key == F.col("__mix_cut_key")) & (2 * F.col("__mix_cut_words") >= word_count(F.col(text)))))
    copies = (F.col("__mix_epochs") + fits.cast("long")).cast("int")
    joined = docs.join(budgets, F.col(source).eqNullSafe(F.col("__mix_mix_source"))).withColumn("__mix_copies", copies).where(F.col("__mix_copies") > 0)
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
