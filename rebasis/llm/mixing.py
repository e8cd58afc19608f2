"""Mixing sources to target weights.

1. The words of each source are laid end to end, documents in a pseudorandom order,
   and cut into blocks of ``block`` words; the rest is the tail block.
2. Targets: a share of all words, split over the sources by weight; a source gives
   at most ``limit`` times its size, what is over goes to the others by weight.
3. Output shards of ``shard`` slots draw their source counts from the multinomial of
   the target shares. Draws miss the targets by chance, so the slots a source has too
   many of, spread evenly over its shards, go to sources that have too few.
4. Slot ``k`` of a source is place ``k mod n`` of epoch ``k div n``, and a keyed
   permutation of each epoch names the block there. The tail block comes last in
   its epoch and the last slot is cut, so the words taken equal the target.
5. Slots and documents meet by an equi-join on (source, block).

Every step is arithmetic and MD5, so reruns and SQL agree. The offsets in a
source come from sums of hash ranges of about 20,000 documents, not from one sort of a
source, and a block holds at most ``block`` documents with words: a hot source is many
small keys. Tables by source, and by (source, range), go through one window per source.

Null and empty texts have size 0 and are taken 0 times; a null source is the last source.
Repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebasis.llm.common import let, long_of, small, stored, text_words

ROUNDS = 12
RANGE_DOCS = 20_000
CELLS = 1024
TOP = 1 << 60


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    limit: float = 2.0
    block: int = 256
    shard: int = 1024
    seed: str = "mix"


def hashed(spec: Mix, tag: str, *parts: Column) -> Column:
    """A number below 2^60 from the parts."""
    words = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return long_of(F.md5(F.concat_ws(":", F.lit(f"{spec.seed}:{tag}"), *words)))


def source_targets(units: DataFrame, spec: Mix) -> DataFrame:
    """Per source: number by code point, size, weight and target. One row per source in one window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, spec.weights)), (F.col("source_no") % len(spec.weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight.cast("double"))
    # the level rises until the sources that fill up first are full
    order = Window.orderBy(F.col("source_size") * spec.limit / F.col("weight"), "source_no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * spec.share
    full = F.coalesce(F.sum(F.col("source_size") * spec.limit).over(before), F.lit(0.0))
    rows = rows.withColumn("level", (total - full) / F.sum("weight").over(after))
    free = F.col("source_size") * spec.limit / F.col("weight") > F.col("level")
    rows = rows.withColumn("free", free)
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(whole)
    cap = F.col("source_size") * spec.limit
    target = F.least(cap, F.coalesce(level * F.col("weight"), cap))
    return rows.select("source", "source_no", F.col("source_size").cast("long").alias("source_size"), "weight",
                       target.cast("double").alias("target"))


def slot_plan(targets: DataFrame, spec: Mix) -> DataFrame:
    """Per source with words to take: words, blocks, slots, and its part [lo, hi) of all slots."""
    b = spec.block
    words = F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("source_size") * spec.limit)).cast("long")
    plan = targets.where(F.col("source_size") > 0).withColumn("words", words)
    plan = plan.withColumn("full", F.expr(f"source_size div {b}")).withColumn(
        "blocks", F.expr(f"(source_size + {b - 1}) div {b}"))
    slots = F.expr(f"(words div source_size) * blocks + ((words % source_size) + {b - 1}) div {b}")
    up_to = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    return plan.withColumn("slots", slots).withColumn("hi", F.sum("slots").over(up_to)).withColumn(
        "lo", F.col("hi") - F.col("slots"))


def shard_counts(plan: DataFrame, n_slots: int, spec: Mix) -> DataFrame:
    """(shard, source_no, n): the multinomial draw of every shard."""
    spark = plan.sparkSession
    slots = spark.range(n_slots).select(
        F.expr(f"id div {spec.shard}").alias("shard"),
        F.floor(hashed(spec, "draw", F.col("id")) / F.lit(float(TOP)) * n_slots).cast("long").alias("u"),
    ).withColumn("u", F.least("u", F.lit(n_slots - 1))).withColumn(
        "cell", F.floor(F.col("u") * CELLS / n_slots).cast("long"))
    edge = lambda c: F.floor(c * CELLS / n_slots).cast("long")
    cells = plan.where("slots > 0").select(
        "source_no", "lo", "hi", F.explode(F.sequence(edge(F.col("lo")), edge(F.col("hi") - 1))).alias("cell"))
    return (
        slots.join(F.broadcast(cells) if cells.count() < 200_000 else cells, "cell")
        .where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        .groupBy("shard", "source_no").agg(F.count("*").alias("n"))
    )


def settled_slots(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """(shard, source_no, k): the slots of all shards, k from 0 to the slots of the source - 1."""
    by_shard = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    drawn = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    sides = plan.select("source_no", "slots").join(drawn, "source_no", "left").select(
        "source_no", F.coalesce("drawn", F.lit(0)).alias("drawn"),
        F.greatest(F.coalesce("drawn", F.lit(0)) - F.col("slots"), F.lit(0)).alias("over"),
        F.greatest(F.col("slots") - F.coalesce("drawn", F.lit(0)), F.lit(0)).alias("short"),
    )
    up_to = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    sides = sides.withColumn("over_from", F.sum("over").over(up_to) - F.col("over")).withColumn(
        "short_from", F.sum("short").over(up_to) - F.col("short"))
    # a long row of slots is cut into pieces of one shard, so no row explodes to more than a shard's slots
    ranked = counts.withColumn("end", F.sum("n").over(by_shard)).join(F.broadcast(sides), "source_no")
    slots = ranked.select("*", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("i"))
    given = F.expr("(i * over) div drawn")
    slots = slots.withColumn("given", given).withColumn("gone", F.expr("((i + 1) * over) div drawn") > F.col("given"))
    kept = slots.where(~F.col("gone")).select("shard", "source_no", (F.col("i") - F.col("given")).alias("k"))
    freed = slots.where("gone").select("shard", (F.col("given") + F.col("over_from")).alias("g"))
    wanted = sides.where("short > 0").select(
        "source_no", (F.col("drawn") - F.col("short_from")).alias("shift"),
        F.explode(F.sequence(F.col("short_from"), F.col("short_from") + F.col("short") - 1)).alias("g"))
    filled = freed.join(wanted, "g").select("shard", "source_no", (F.col("g") + F.col("shift")).alias("k"))
    return kept.unionByName(filled)


def permuted(spec: Mix, source_no: Column, epoch: Column, place: Column, n: Column) -> Column:
    """Swap-or-not: a keyed permutation of 0..n-1 for any n, one key and one bit per round."""

    def step(x: Column, r: Column) -> Column:
        key = hashed(spec, "key", source_no, epoch, r) % n
        return let(
            (key + n - x) % n,
            lambda other: F.when(
                hashed(spec, "bit", source_no, epoch, r, F.greatest(x, other)) % 2 == 1, other).otherwise(x),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), place, step)


def takes(slots: DataFrame, plan: DataFrame, spec: Mix) -> DataFrame:
    """(shard, source_no, epoch, block, take): the block of every slot and how many of its words it gives."""
    b = spec.block
    rows = slots.join(F.broadcast(plan.select("source_no", "source_size", "words", "full", "blocks")), "source_no")
    rows = rows.withColumn("epoch", F.expr("k div blocks")).withColumn("place", F.expr("k % blocks"))
    before = F.col("epoch") * F.col("source_size") + F.least(F.col("place") * b, F.col("source_size"))
    length = F.when(F.col("place") < F.col("full"), F.lit(b)).otherwise(F.col("source_size") - F.col("full") * b)
    block = F.when(
        F.col("place") < F.col("full"),
        permuted(spec, F.col("source_no"), F.col("epoch"), F.col("place"), F.col("full")),
    ).otherwise(F.col("full"))
    return rows.select(
        "shard", "source_no", "epoch", block.alias("block"),
        F.least(length.cast("long"), F.col("words") - before).alias("take"), length.cast("long").alias("length"))


def placed(units: DataFrame, targets: DataFrame, spec: Mix, n_units: int) -> DataFrame:
    """Units with ``start``, the words of their source before them in its pseudorandom order."""
    ranges = max(1, -(-n_units // RANGE_DOCS))
    rows = units.join(F.broadcast(targets.select(F.col("source").alias("name"), "source_no")),
                      F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("order", hashed(spec, "order", F.col("doc_id")))
    rows = rows.withColumn("part", F.floor(F.col("order") / F.lit(float(TOP)) * ranges).cast("long"))
    ties = [c for c in ("version",) if c in units.columns]
    inside = Window.partitionBy("source_no", "part").orderBy("order", "doc_id", "size", *ties).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.withColumn("in_part", F.sum("size").over(inside) - F.col("size"))
    along = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("source_no", "part").agg(F.sum("size").alias("words")).select(
        "source_no", "part", (F.sum("words").over(along) - F.col("words")).alias("base"))
    return rows.join(parts, ["source_no", "part"]).withColumn("start", F.col("base") + F.col("in_part")).drop(
        "part", "order", "in_part", "base")


@dataclass(frozen=True)
class Mixed:
    """The plan of a mix: targets by source, units with their place, and the blocks of all slots."""

    targets: DataFrame
    units: DataFrame
    slots: DataFrame
    spec: Mix

    def pieces(self) -> DataFrame:
        """(unit columns, shard, epoch, lo, hi): what each slot takes of each document, in words of its source."""
        b = self.spec.block
        cut = self.units.where("size > 0").select(
            "*", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
        met = cut.join(self.slots, ["source_no", "block"])
        return met.withColumn("lo", F.greatest(F.col("start"), F.col("block") * b)).withColumn(
            "hi", F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("take"))).where("hi > lo")


def mix(units: DataFrame, spec: Mix = Mix()) -> Mixed:
    """Plan a mix of units (doc_id, source, size, and ``version`` if ids repeat); its small tables are stored."""
    units = stored(units, "mix-units")
    targets = stored(source_targets(units, spec), "mix-targets")
    plan = stored(slot_plan(targets, spec), "mix-plan")
    n_slots = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).cast("long")).first()[0]
    counts = stored(shard_counts(plan, n_slots, spec) if n_slots else
                    plan.where("false").select(F.lit(0).cast("long").alias("shard"), "source_no",
                                               F.lit(0).cast("long").alias("n")), "mix-counts")
    slots = takes(settled_slots(counts, plan), plan, spec)
    return Mixed(targets, stored(placed(units, targets, spec, units.count()), "mix-places"), slots, spec)


def doc_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(text_words("text")).cast("long").alias("size"))


def taken_words(mixed: Mixed) -> DataFrame:
    """Per unit: source size, target, and the words taken, repeats counted."""
    took = mixed.pieces().groupBy("source_no", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")).select(
        F.col("source_no").alias("of_no"), F.col("start").alias("of_start"), "taken")
    same = (F.col("source_no") == F.col("of_no")) & (F.col("start") == F.col("of_start")) & (F.col("size") > 0)
    return (
        mixed.units.join(took, same, "left")
        .join(F.broadcast(mixed.targets.select("source_no", "source_size", "target")), "source_no")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, spec: Mix = Mix()) -> DataFrame:
    """The mix as documents: a row per unbroken run of words that an epoch takes of a document.

    A document taken whole keeps its text as it is; a part is its words with one
    space between. Rows equal in id, source and text are copies of one document.
    """
    keyed = docs.withColumn("__version", F.xxhash64("text"))
    units = keyed.select("doc_id", "source", F.col("__version").alias("version"), F.size(text_words("text")).cast("long").alias("size"))
    mixed = mix(units, spec)
    of_unit = Window.partitionBy("source_no", "start", "epoch").orderBy("lo")
    runs = mixed.pieces().withColumn("new", F.when(
        F.col("lo") == F.lag("hi").over(of_unit), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(of_unit.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "source", "version", "source_no", "start", "size", "epoch", "run").agg(
        F.min(F.col("lo") - F.col("start")).cast("int").alias("lo"), F.max(F.col("hi") - F.col("start")).cast("int").alias("hi"))
    lists = runs.groupBy("doc_id", "source", "version", "source_no", "start", "size").agg(
        F.collect_list(F.struct("epoch", "lo", "hi")).alias("__runs"))  # at most two runs per block of one document
    left = lists.select(F.col("doc_id").alias("__ui"), F.col("source").alias("__us"),
                        F.col("version").alias("__uv"), F.col("size").alias("__un"), "__runs")
    texts = keyed.dropDuplicates(["doc_id", "source", "__version"])
    met = texts.join(left, F.col("doc_id").eqNullSafe(F.col("__ui")) & F.col("source").eqNullSafe(F.col("__us"))
                     & F.col("__version").eqNullSafe(F.col("__uv")))
    cut = met.withColumn("__words", text_words("text")).withColumn("__run", F.explode("__runs"))
    whole = (F.col("__run.lo") == 0) & (F.col("__run.hi") == F.col("__un"))
    part = F.array_join(F.slice("__words", F.col("__run.lo") + 1, F.col("__run.hi") - F.col("__run.lo")), " ")
    out = cut.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
