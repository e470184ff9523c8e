"""Mixing sources to target weights by Pareto order sampling.

A source's target is dealt out over its documents as expected copies that fall with the document's size, so that short documents
are not crowded out: a document of twice the words is expected EVEN times as often. Whole copies are certain; the fraction
left over is the document's own inclusion probability p of one copy more. Documents are ranked by the odds of a random
number over the odds of p, and the first of them are taken until the source has its fixed size, measured in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegrain.llm.common import WORD, cut, running

#: Expected copies of a document over those of one with half as many words.
EVEN = 0.9
#: Slices of the ranks of a source; only the slice in which the cut falls is ordered document by document.
SLICES = 1 << 16
#: A plan of so many rows at most is broadcast: a row for each source and size class, each of some 200 bytes.
PLAN_ROWS = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def class_of(size: Column) -> Column:
    """Size class: documents of one class have from 2^k words to under 2^(k + 1), and one inclusion probability."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)) + F.lit(0.5))).cast("int")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """sizes (source, source_size) with each source's target, in words.

    Sources by code point, null last, take the weights in turn and share `share` times all words; a target stops at
    `most` times its source's size, and the excess goes to the others by weight until none is above. In closed form:
    sorted by cap over weight, a first few stop at their caps, and the others get one common amount for each weight. Both
    orders are taken range by range, so no task holds all sources.
    """
    w = running(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"n": "one"})
    w = w.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("n") % len(weights) + 1).cast("int")))
    w = cut(w.select("source", "source_size", "n", "weight", (most * F.col("source_size")).alias("cap")), "mix-caps")
    total = w.agg(F.sum("source_size"), F.sum("weight")).first()
    words, heavy = float(total[0] or 0) * share, float(total[1] or 0)
    order = running(w, [F.col("cap") / F.col("weight"), F.col("n")], {"caps": "cap", "weights": "weight"})
    level = (F.lit(words) - F.col("caps")) / (F.lit(heavy) - F.col("weights"))
    # the first source, by cap over weight, that need not stop: the level holds for it and all after it
    found = order.where(level * F.col("weight") <= F.col("cap")).agg(F.min_by(level, F.struct(F.col("cap") / F.col("weight"), "n")).alias("level")).first()["level"]
    capped = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found) * F.col("weight"))
    return w.select("source", "source_size", capped.alias("target"))


def expected(classes: DataFrame, share: float, most: float) -> DataFrame:
    """The plan: a row for each source and size class: its_source, its_class, source_size, target, certain, p, left. classes: source, class, words.

    A document of class k is expected min(most, c * EVEN^k) times, with the source's c such that its words come to its target.
    The classes that stop at `most` are a source's first ones, since smaller documents are expected more often.
    """
    size = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = classes.join(targets(size, share, most).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    own, rising = Window.partitionBy("source"), Window.partitionBy("source").orderBy("class")
    plan = plan.withColumn("even", F.pow(F.lit(EVEN), F.col("class")))
    before = F.coalesce(F.sum("words").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("even") * F.col("words")).over(rising.rowsBetween(0, Window.unboundedFollowing))
    c = F.when(rest > 0, (F.col("target") - most * before) / rest)
    plan = plan.withColumn("c", c).withColumn("c", F.min_by(F.when(F.col("c") * F.col("even") <= most, F.col("c")), F.when(F.col("c") * F.col("even") <= most, F.col("class"))).over(own))
    copies = F.coalesce(F.least(F.lit(float(most)), F.greatest(F.col("c") * F.col("even"), F.lit(0.0))), F.lit(float(most)))
    # sums of doubles a hair under a whole number are that number
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, copies).otherwise(0.0)).withColumn("certain", F.floor(F.col("ratio") + 1e-9))
    plan = plan.withColumn("p", F.greatest(F.col("ratio") - F.col("certain"), F.lit(0.0))).withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    left = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(own)
    return plan.select(F.col("source").alias("its_source"), F.col("class").alias("its_class"), "source_size", "target", "certain", "p", left.alias("left"))


def ranked(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """sized (id, mark, source, size, ...) with its plan and its rank: odds of a random number over odds of p, brought back to (0, 1)."""
    plan = F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan
    d = sized.join(plan, F.col("source").eqNullSafe(F.col("its_source")) & (class_of(F.col("size")) == F.col("its_class")))
    # 52 bits of a hash make a number within (0, 1)
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "mark"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return d.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds))).withColumn("slice", F.floor(F.col("rank") * SLICES))


def mix_table(sized: DataFrame, share: float, most: float, seed: int) -> DataFrame:
    """The plan with each source's last rank taken (last; null if none is), a small table. sized: id, mark, source, size."""
    classes = sized.groupBy("source", class_of(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    plan = cut(expected(cut(classes, "mix-classes"), share, most), "mix-plan")
    open_ = ranked(sized, plan, seed).where("rank is not null").select("its_source", "rank", "slice", "size", "left")
    running_ = Window.partitionBy("its_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = open_.groupBy("its_source", "slice").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(running_), F.lit(0)))
    edge = slices.where("before < left and before + words >= left").select(F.col("its_source").alias("edge_source"), F.col("slice").alias("edge_slice"), "before", "left")
    # where all that is open is less than what is left, rounding aside, the last of all ranks is the end
    edge = cut(edge, "mix-edge")
    same = F.col("its_source").eqNullSafe(F.col("edge_source")) & (F.col("slice") == F.col("edge_slice"))
    near = open_.drop("left").join(edge, same).groupBy("its_source", "edge_slice", "rank").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("left").alias("left"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("its_source").orderBy("rank"))
    near = near.withColumn("off", F.abs(upto - F.col("left"))).withColumn("none", F.abs(F.col("before") - F.col("left")))
    # the cut after which the words are nearest to what is left; before the slice's first rank if that is nearer
    ends = near.groupBy("its_source").agg(F.min_by("rank", F.struct("off", "rank")).alias("last"), F.min("off").alias("off"), F.first("none").alias("none"), (F.first("edge_slice") / SLICES).alias("slice_at"))
    ends = ends.select(F.col("its_source").alias("end_source"), F.when(F.col("off") <= F.col("none"), F.col("last")).otherwise(-1.0).alias("last"), "slice_at")
    whole = slices.groupBy("its_source").agg(F.sum("words").alias("words"), F.first("left").alias("left")).where("words < left").select(F.col("its_source").alias("end_source"), F.lit(1.0).alias("last"), F.lit(0.0).alias("slice_at"))
    ends = ends.unionByName(whole)
    out = plan.join(ends, F.col("its_source").eqNullSafe(F.col("end_source")), "left").drop("end_source", "left")
    return cut(out, "mix-table")


def with_copies(sized: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """sized with source_size, target and copies; every other column is kept. Where the cut is before its slice's first rank (last = -1), only the
    slices below it are in."""
    d = ranked(sized, table, seed)
    more = F.coalesce((F.col("rank") <= F.col("last")) | (F.col("slice") < F.col("slice_at") * SLICES), F.lit(False))
    return d.withColumn("copies", (F.col("certain") + more.cast("long")).cast("int")).drop("its_source", "its_class", "certain", "p", "rank", "slice", "last", "slice_at")


def key_of(text: str = "text", source: str = "source") -> Column:
    return F.xxhash64(text, source)


def mix_plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken.

    taken is size times the copies the mix takes, 0 to `most`. Texts are read once, into a table of numbers. A null text
    has size 0; a null source is a source of its own, the last; rows that agree in doc_id, text and source share a rank
    and are taken or left together; a source without words has target 0; an empty table gives an empty result; texts
    of any length count whole; other columns are not read. The same rows give the same result on every run, however partitioned.
    """
    sized = cut(docs.select(F.col("doc_id").alias("id"), key_of().alias("mark"), "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    d = with_copies(sized, mix_table(sized, share, most, seed), seed)
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The mix itself: docs with every row as often as the plan takes it, in docs' columns. Rows as in mix_plan(); texts are not shuffled while
    the plan is small enough to broadcast."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), key_of().alias("mark"), "source", size_of(F.col("text")).alias("size"))
    sized = cut(own.drop("row"), "mix-sizes")
    both = with_copies(own, mix_table(sized, share, most, seed), seed)
    # a left out document has 0 copies, an empty sequence
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
