"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a fixed pseudo-random order (by the MD5 of their
id) and cut into blocks of `block` documents. Weights are whole units of a period, exactly: fractions of denominators up to a million (8,
6, 4, 4, 1 and 2 units for the weights 4, 3, 2, 2, 0.5 and 1) on their common denominator.
A source of weight w releases its i-th block at floor((i - 1) / w) and must have run
it by ceil(i / w); each slot runs the released block of the earliest deadline, ties
to the first source by name. So at any slot each source has had its weight's share
of the slots to within less than one block. Deadlines repeat with the period, so one
period's schedule serves any number of blocks, and each block finds its slot by a
join on (source, place in the period): no step runs over all blocks one by one.

Weights are the caller's: a number for each source, `default` for those not named. A
weight of 0 (or less, or no number) means none: rows of such a source are returned with
null block, slot and place, and `mixed` leaves them out. Without any weights the targets are
the sources' numbers of rows to the power `temper`, rounded to parts of `slots`, one at least.

The mix holds to the target as long as every source has blocks left: up to the slot
`balanced` says. A source whose blocks are used up leaves its slots empty, and the
others go on in order, so no row is repeated or lost. Null sources are one source, named
'' in the weights. Rows that share an id follow one another. Numbers within a source are
counted within 16^digits parts by the first digits of the hash, so a source with a third
of all rows is spread over many tasks.

Making a period takes time in proportion to its slots times sources and looks at no
document. Given weights that only fit a period of more than LONGEST slots are rounded to parts
of LONGEST, which is less than a block in LONGEST slots; the rounded ones are the targets then.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import kept

#: Slots of a period, and of a slice of it.
LONGEST, SLICE = 200_000, 1000
#: Columns that are added; those of the input that have such a name are kept out of the way.
ADDED = ("block", "slot", "place")


def whole(weights: dict[str, float], default: float) -> tuple[dict[str, int], int]:
    """The weights and the default as whole numbers of the same proportions; 0 for none."""
    exact = {k: Fraction(str(float(w))).limit_denominator(1_000_000) if 0 < w < math.inf else Fraction(0) for k, w in [*weights.items(), (None, default)]}
    unit = math.lcm(*[x.denominator for x in exact.values()])
    parts = {k: int(x * unit) for k, x in exact.items()}
    # beyond 2^40 all are rounded later on
    shared = max(math.gcd(*parts.values()), -(-max(parts.values()) >> 40), 1)
    return {k: max(1, round(n / shared)) if n else 0 for k, n in parts.items() if k is not None}, max(1, round(parts[None] / shared)) if parts[None] else 0


def units(docs: DataFrame, weights: dict[str, float] | None, slots: int, temper: float, source_col: str, default: float = 1.0) -> DataFrame:
    """source and units: its whole share of the period, one at least; sources of no weight are left out."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        power, longest = F.round(F.pow(F.col("n").cast("double"), F.lit(temper)), 9), slots
    else:
        parts, rest = whole(weights, default)
        given = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if parts else F.lit(None).cast("map<string,long>")
        power, longest = F.coalesce(F.try_element_at(given, F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(rest).cast("long")), LONGEST
    weighed = sizes.withColumn("power", power).where("power > 0").withColumn("total", F.sum("power").over(Window.partitionBy()))
    rounded = F.greatest(F.lit(1), F.round(F.col("power") * longest / F.col("total")).cast("int"))
    exact = F.lit(weights is not None) & (F.col("total") <= longest)
    return weighed.select("source", F.when(exact, F.col("power").cast("int")).otherwise(rounded).alias("units"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def schedule(parts: DataFrame) -> DataFrame:
    """One period: source, turn (of the source's blocks in the period), start (slot), units, period."""
    one = parts.agg(F.sort_array(F.collect_list(F.struct("source", "units"))).alias("s"))
    one = one.select("s", F.aggregate("s", F.lit(0), lambda n, x: n + x["units"]).alias("period"))
    none, last = F.array().cast("array<int>"), F.col("period") - 1

    def step(state, slot):
        def job(x, k):
            done = F.get(state["done"], k).cast("long")
            released = F.floor(done * F.col("period") / x["units"]) <= slot
            return F.when(released, F.struct(F.ceil((done + 1) * F.col("period") / x["units"]).alias("deadline"), k.alias("k")))

        def ran(first):
            return F.struct(F.transform(state["done"], lambda n, k: F.when(k == first["k"], n + 1).otherwise(n)).alias("done"), F.concat(state["ran"], F.array(first["k"])).alias("ran"))

        return _let(F.array_min(F.transform("s", job)), ran)

    def slice_(state, j):
        begin = F.struct(state["done"].alias("done"), none.alias("ran"))
        ran = F.aggregate(F.sequence(j * SLICE, F.least((j + 1) * SLICE - 1, last)), begin, step)
        return _let(ran, lambda r: F.struct(r["done"].alias("done"), F.concat(state["ran"], F.array(r["ran"])).alias("ran")))

    # slice after slice, so that what has run isn't copied for each slot
    start = F.struct(F.transform("s", lambda _: F.lit(0)).alias("done"), F.array().cast("array<array<int>>").alias("ran"))
    ran = F.when(F.col("period") > 0, F.aggregate(F.sequence(F.lit(0), F.floor(F.greatest(last, F.lit(0)) / SLICE).cast("int")), start, slice_, lambda x: F.flatten(x["ran"])))
    slots = one.select("s", "period", F.posexplode(ran).alias("start", "k"))
    turn = F.row_number().over(Window.partitionBy("k").orderBy("start")) - 1
    return slots.select(F.get("s", F.col("k"))["source"].alias("source"), turn.alias("turn"), "start", F.get("s", F.col("k"))["units"].alias("units"), "period")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 32, slots: int = 1000, temper: float = 0.7, id_col: str = "doc_id", source_col: str = "source", default: float = 1.0) -> DataFrame:
    """All rows with all columns in `row`, and source, block, slot and place (within the block), all counted from 0; null for sources of no weight."""
    total = docs.count()
    digits = max(1, math.ceil(math.log(max(total, 1) / 2000, 16)))
    parts = units(docs, weights, slots, temper, source_col, default)
    table = kept(schedule(parts))
    few = table.count() <= 2 * LONGEST
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    # a key that is never null, so that numbering and joining share one partitioning of the rows
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), named(F.col(source_col)).alias("key"), h.alias("h")).withColumn("part", F.substring("h", 1, digits))
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("h", F.col(f"row.`{id_col}`"))) - 1
    rows = rows.withColumn("number", number)
    sizes = docs.select(named(F.col(source_col)).alias("key"), F.substring(h, 1, digits).alias("part")).groupBy("key", "part").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n"))
    table = table.withColumn("key", named(F.col("source")))
    per = table.groupBy("key").agg(F.first("units").alias("units"), F.first("period").alias("period"))
    sizes = sizes.join(per, "key", "left").select("key", "part", "before", "units", "period")
    rows = rows.join(sizes, ["key", "part"]).withColumn("number", F.col("number") + F.col("before"))
    rows = rows.withColumn("block", F.floor(F.col("number") / block)).withColumn("place", F.col("number") % block)
    rows = rows.withColumn("turn", (F.col("block") % F.col("units")).cast("int")).withColumn("round", F.floor(F.col("block") / F.col("units")))
    weighed = F.col("start").isNotNull()
    starts = table.select("key", "turn", "start")
    return rows.join(F.broadcast(starts) if few else starts, ["key", "turn"], "left").select("row", "source", *[F.when(weighed, c).alias(n) for n, c in (("block", F.col("block")), ("slot", F.col("round") * F.col("period") + F.col("start")), ("place", F.col("place")))])


def balanced(placed: DataFrame) -> DataFrame:
    """until: the slot of the last block of the first source that runs out; the mix of the slots up to there has the target weights."""
    ends = placed.where("slot IS NOT NULL").groupBy("source").agg(F.max("slot").alias("slot"))
    return ends.agg(F.min("slot").alias("until"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, unchanged, in the order of the mix; sources of no weight are left out."""
    return mix(docs, **options).where("slot IS NOT NULL").orderBy("slot", "place").select("row.*")
