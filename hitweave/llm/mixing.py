"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is to be taken ``r = target / size`` times on average. The whole part of ``r`` is certain:
so many copies of each document are allocated. The rest ``f`` is an inclusion chance: documents are ranked by
``(u / (1 - u)) / (f / (1 - f))`` with a uniform ``u`` that a hash of the document fixes, and the sample is the
beginning of that order whose words come nearest to what the source still lacks. Long documents are drawn before
short ones, so that the short ones, whose chances follow from what is left, even out the error.

A source's order is never sorted in one task: words are first summed in ``BINS`` equal bins of ``q / (1 + q)``, and
only the bin in which the target lies is ranked by row. The result of the search is one threshold for each source and
class, so texts are not shuffled and taking a document is a comparison in its own row.

Repeated rows (same id, text and source) would have equal ranks and be taken or left together. Groups that hold more than a
``HEAVY``-th of their source's words are numbered, so that each row has a rank of its own: within tasks first, then by the
rows that the tasks before have, so no group meets in one task. Only rows of such groups are shuffled for that.

Defined cases: null texts have no words and are taken whole copies only; a null source is a source of its own, last in
order; of repeated rows of a heavy group as many are taken as the mix needs, of lighter groups all or none; sources
without words have target 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.columns import unused_prefix
from hitweave.session import write_table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
LONG = 0.02
BINS = 4096
HEAVY = 200


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def allot(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources: ``source, source_size, target``. ``sizes`` has one row for each source.

    ``share`` of all words is dealt by weight; what exceeds ``most`` times a source's size is dealt again among the
    others. That ends with ``target = min(cap, level * weight)``: in the order of ``cap / weight`` the level follows from
    running sums. One row for each source is sorted in one task, however many documents there are.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(rank) - 1) % len(weights) + 1)
    s = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("_level", level)
    # the first source that the level leaves below its cap sets the level; if there is none, all are full
    fits = F.when(F.col("_level") * F.col("w") <= F.col("cap"), F.col("_level"))
    at = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(at.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), at * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def group_of(key: str, text: str, seed: int) -> Column:
    """Hash of what makes rows equal for the mix."""
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col("source"))


def chance(group: Column, copy: Column) -> Column:
    """A uniform number in (0, 1) that depends on the row's group and its number there alone."""
    h = F.xxhash64(group, copy)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def heavy_groups(small: DataFrame, sizes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``group`` of the repeated rows that hold more than a ``heavy``-th of their source's words: ``heavy`` for a source at most."""
    groups = small.groupBy("source", "group").agg(F.count("*").alias("n"), F.sum("size").alias("words")).where("n > 1")
    return _match(groups, sizes).where(F.col("words") * heavy > F.col("source_size")).select("group")


def number_copies(rows: DataFrame, group: str, part: str, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2... for the rows of each group. ``part`` tells in which task a row lies."""
    x = unused_prefix(rows)
    here = rows.withColumn(f"{x}r", F.row_number().over(Window.partitionBy(group, part).orderBy(F.lit(0))) - 1)
    tasks = rows.groupBy(group, part).agg(F.count("*").alias(f"{x}n"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    tasks = tasks.select(group, part, F.coalesce(F.sum(f"{x}n").over(before), F.lit(0)).alias(f"{x}before"))
    both = here.join(tasks, [group, part])
    return both.withColumn(out, (F.col(f"{x}r") + F.col(f"{x}before")).cast("long")).drop(f"{x}r", f"{x}before")


def with_copies(rows: DataFrame, heavy: DataFrame, group: str, part: str, out: str) -> DataFrame:
    """Add ``out``: the number of a row in its group if that is heavy, else 0. ``heavy`` is stored."""
    if heavy.isEmpty():
        return rows.withColumn(out, F.lit(0).cast("long"))
    many = heavy.select(F.col("group").alias(group))
    light = rows.join(many, group, "left_anti").withColumn(out, F.lit(0).cast("long"))
    return light.unionByName(number_copies(rows.join(many, group, "left_semi"), group, part, out))


def pareto_rank(u: Column, f: Column) -> Column:
    """Random odds over inclusion odds, as ``q / (1 + q)``; 1 where nothing is to be drawn."""
    q = u / (1 - u) * (1 - f) / f
    return F.when(f >= 1, 0.0).when(f > 0, q / (1 + q)).otherwise(1.0)


def _match(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by ``source``, where null equals null."""
    name = unused_prefix(left) + "_right"
    r = right.withColumnRenamed("source", name)
    return left.join(r, F.col("source").eqNullSafe(F.col(name)), how).drop(name)


def _cut(d: DataFrame, want: DataFrame, bins: int) -> DataFrame:
    """For each source the rank up to which documents are taken, and their words: ``source, cut, got``.

    ``d`` has ``source, size, q`` and ``want`` ``source, lack``. Taken is the beginning of the order whose words are
    nearest to ``lack``.
    """
    b = F.least(F.floor(F.col("q") * bins), F.lit(bins - 1)).cast("int")
    hist = d.groupBy("source", b.alias("b")).agg(F.sum("size").alias("s"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    hist = _match(hist.withColumn("upto", F.sum("s").over(run)), want)
    below = F.col("upto") <= F.col("lack")
    at = hist.groupBy("source").agg(
        F.first("lack").alias("lack"),
        F.coalesce(F.max(F.when(below, F.col("upto"))), F.lit(0)).alias("before"),
        F.min(F.when(~below, F.col("b"))).alias("bin"),
    )
    edge = _match(d, at).where(b == F.col("bin"))
    # equal ranks are taken or left together
    order = Window.partitionBy("source").orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(order))
    off = F.abs(F.col("upto") - F.col("lack"))
    better = edge.where(off < F.abs(F.col("before") - F.col("lack")))
    best = better.groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "upto")).alias("m"))
    # where no row of the bin helps, the order ends with the bin before
    cut = F.coalesce("m.q", F.when(F.col("bin").isNull(), 2.0).otherwise(F.col("bin") / bins - 1e-15))
    return _match(at, best, "left").select("source", cut.alias("cut"), F.coalesce("m.upto", "before").alias("got"))


def plan(small: DataFrame, targets: DataFrame, long: float = LONG, bins: int = BINS) -> DataFrame:
    """Thresholds of all sources: whole copies, the bound of long documents, chances and cuts of both classes.

    ``small`` has ``source, size, u``.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.withColumn("copies", F.floor(ratio).cast("int")).withColumn("bound", F.col("target") * long)
    t = t.withColumn("f", ratio - F.col("copies"))
    is_long = F.col("size") > F.col("bound")
    big = _match(small, t.select("source", "bound", "f")).where(is_long)
    big = big.select("source", "size", pareto_rank(F.col("u"), F.col("f")).alias("q"))
    t = _match(t, big.groupBy("source").agg(F.sum("size").alias("big_size")), "left")
    t = t.withColumn("big_size", F.coalesce("big_size", F.lit(0)))
    cut = _cut(big, t.select("source", (F.col("f") * F.col("big_size")).alias("lack")), bins)
    t = _match(t, cut.withColumnsRenamed({"cut": "big_cut", "got": "big_got"}), "left")
    lack = F.col("f") * F.col("source_size") - F.coalesce("big_got", F.lit(0))
    rest = F.col("source_size") - F.col("big_size")
    t = t.withColumn("lack", F.greatest(lack, F.lit(0.0)))
    t = t.withColumn("f2", F.when(rest > 0, F.least(F.col("lack") / rest, F.lit(1.0))).otherwise(0.0))
    t = write_table(t, "mix-long")
    few = _match(small, t.select("source", "bound", "f2")).where(~is_long)
    few = few.select("source", "size", pareto_rank(F.col("u"), F.col("f2")).alias("q"))
    cut = _cut(few, t.select("source", "lack"), bins).select("source", F.col("cut").alias("small_cut"))
    return _match(t, cut, "left").select(
        "source", "source_size", "target", "copies", "bound", "f", "f2", "big_cut", "small_cut"
    )


def mix_plan(
    docs: DataFrame, seed: int = 5, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, long: float = LONG
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Small columns of the documents, the thresholds, and the heavy groups."""
    size = word_count("text").alias("size")
    small = docs.select("doc_id", "source", size, group_of("doc_id", "text", seed).alias("group"), F.spark_partition_id().alias("part"))
    small = write_table(small, "mix-sizes")
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = write_table(allot(sizes, share, most, weights), "mix-targets")
    heavy = write_table(heavy_groups(small, targets), "mix-heavy")
    small = with_copies(small, heavy, "group", "part", "copy")
    small = small.select("doc_id", "source", "size", chance(F.col("group"), F.col("copy")).alias("u"))
    if not heavy.isEmpty():
        small = write_table(small, "mix-numbered")
    return small, write_table(plan(small, targets, long), "mix-plan"), heavy


def copies_taken(p: str = "") -> Column:
    """Copies of a document that the mix takes, from the columns of a plan and ``size, u``, all with a prefix."""
    is_long = F.col(f"{p}size") > F.col(f"{p}bound")
    f = F.when(is_long, F.col(f"{p}f")).otherwise(F.col(f"{p}f2"))
    cut = F.when(is_long, F.col(f"{p}big_cut")).otherwise(F.col(f"{p}small_cut"))
    drawn = (f > 0) & (pareto_rank(F.col(f"{p}u"), f) <= cut)
    return F.col(f"{p}copies") + F.coalesce(drawn.cast("int"), F.lit(0))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every document."""
    small, p, _ = mix_plan(docs, **options)
    d = _match(small, p).withColumn("copies", copies_taken())
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mix_documents(docs: DataFrame, seed: int = 5, **options) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken."""
    _, p, heavy = mix_plan(docs, seed=seed, **options)
    x = unused_prefix(docs)
    d = docs.withColumn(f"{x}group", group_of("doc_id", "text", seed)).withColumn(f"{x}part", F.spark_partition_id())
    d = with_copies(d, heavy, f"{x}group", f"{x}part", f"{x}of")
    d = _match(d, p.select("source", *[F.col(c).alias(x + c) for c in p.columns if c != "source"]))
    d = d.withColumn(f"{x}size", word_count("text")).withColumn(f"{x}u", chance(F.col(f"{x}group"), F.col(f"{x}of")))
    d = d.withColumn(f"{x}n", copies_taken(x)).where(F.col(f"{x}n") > 0)
    return d.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(f"{x}n"))).alias(f"{x}copy")).drop(f"{x}copy")
