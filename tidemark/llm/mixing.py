"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal size (in characters). A source of weight w releases its block k (from 0) at slot floor(k / w)
and must run it before slot ceil((k + 1) / w); in each slot the released block with the earliest deadline runs. With weights that sum
to one every deadline is met, so in each prefix a source is less than one block off its target. When a source has no block left, the
others go on with their weights scaled up, as a new phase.

The schedule repeats with a period of as many slots as there are tickets (weights are whole tickets), so one period for each phase
is all that is computed outside Spark: it depends on the number of sources, never on their rows. Documents find their block by running
sums, which are split by salts, so one source may hold any share of the rows.
"""

import heapq
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import salted_running_sum, session

BLOCK_UNITS, DEFAULT_TICKETS = 65_536, 1
#: Weights of the query, in tickets; sources not named get ``DEFAULT_TICKETS``.
TICKETS = {"src0": 4, "src1": 3, "src2": 2}
#: Numbers of the schedule up to which it is broadcast (8 MB); a larger one is joined by shuffle.
PLAN_NUMBERS = 1 << 20
_NULL = "-"


def period(tickets: dict[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks; ties by name."""
    total = sum(tickets.values())
    waiting = [(0, -(-total // t), name, 0) for name, t in tickets.items()]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, deadline, name, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, name, k))
        _, name, k = heapq.heappop(ready)
        out.append(name)
        t = tickets[name]
        heapq.heappush(waiting, ((k + 1) * total // t, -(-(k + 2) * total // t), name, k + 1))
    return out


def phases(blocks: dict[str, int], tickets: dict[str, int]) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """(source, phase, first block, first slot of the phase, slots of a period, tickets, places in the period), a row for each source
    and phase in which it runs."""
    left, start, out, number = {s: n for s, n in blocks.items() if n > 0}, 0, [], 0
    done = dict.fromkeys(blocks, 0)
    while left:
        active = {s: tickets[s] for s in sorted(left)}
        slots = period(active)
        places: dict[str, list[int]] = {s: [] for s in active}
        for i, s in enumerate(slots):
            places[s].append(i)
        size = len(slots)
        ends = {s: (left[s] - 1) // active[s] * size + places[s][(left[s] - 1) % active[s]] + 1 for s in active}
        length = min(ends.values())
        for s in active:
            ran = length // size * active[s] + sum(p < length % size for p in places[s])
            if ran:
                out.append((s, number, done[s], start, size, active[s], places[s]))
            done[s] += ran
            left[s] -= ran
        left = {s: n for s, n in left.items() if n > 0}
        start, number = start + length, number + 1
    return out


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(_NULL))


def mix(docs: DataFrame, tickets: dict | None = None, default_tickets: int = DEFAULT_TICKETS, block_units: int = BLOCK_UNITS, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", units_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` and one struct ``__mix``: block, phase, release, deadline, slot and place.

    ``slot`` and then ``place`` (characters of the source before the row) give the mixed order; release and deadline are slots as well.
    Sizes are characters of the text and one more, or ``units_col``. No row is dropped or repeated. A null source is a source of its own, with the default tickets. Null and empty texts
    (and null or negative sizes) count as one character. Within a source the order is that of a hash of the id, then id and text; repeated rows lie side by side. An empty table
    gives an empty result; a column named ``__mix`` in the input is refused, all others may have any name.
    """
    spark = session(docs.sparkSession)
    if "__mix" in docs.columns:
        raise ValueError("the input has a column __mix already")
    rows = docs.select(F.struct("*").alias("row"))
    at = lambda c: F.col("row").getField(c)
    units = F.coalesce(F.length(at(text_col)), F.lit(0)) + 1 if units_col is None else F.greatest(F.coalesce(at(units_col), F.lit(1)), F.lit(1))
    rows = rows.select("row", _source_key(at(source_col)).alias("key"), units.cast("bigint").alias("units"),
                       F.xxhash64(at(id_col)).alias("hash"), at(id_col).alias("id"), F.xxhash64(at(units_col or text_col)).alias("same"))
    sizes = rows.groupBy("key").agg(F.sum("units").alias("units"), F.count("*").alias("n")).collect()  # one row for each source
    named = {"=" + str(s): t for s, t in (tickets or {}).items()}
    share = {r.key: max(1, int(named.get(r.key, default_tickets))) for r in sizes}
    plan = phases({r.key: -(-r.units // block_units) for r in sizes}, share)
    runs: dict[str, list] = {}
    for name, *entry in plan:
        runs.setdefault(name, []).append(entry)
    table = spark.createDataFrame(list(runs.items()), "p_key string, phases array<struct<phase: int, first: bigint, start: bigint, size: bigint, tickets: bigint, places: array<bigint>>>")
    if sum(5 + len(places) for *_, places in plan) <= PLAN_NUMBERS:
        table = F.broadcast(table)
    salts = isqrt(max((r.n for r in sizes), default=1)) + 1
    placed = salted_running_sum(rows, "key", F.col("units"), [F.col("hash"), F.col("id"), F.col("same")], F.pmod("hash", F.lit(salts)), "place")
    block = F.floor(F.col("place") / block_units).cast("bigint")
    joined = placed.withColumn("block", block).join(table, placed["key"] == table["p_key"])
    joined = joined.withColumn("p", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("block")), -1))
    k, size, t = F.col("block") - F.col("p.first"), F.col("p.size"), F.col("p.tickets")
    slot = F.col("p.start") + F.expr("(block - p.first) div p.tickets") * size + F.element_at("p.places", (k % t + 1).cast("int"))
    release = F.col("p.start") + F.expr("((block - p.first) * p.size) div p.tickets")
    deadline = F.col("p.start") + F.expr("((block - p.first + 1) * p.size + p.tickets - 1) div p.tickets")
    return joined.select("row.*", F.struct("block", F.col("p.phase").alias("phase"), release.alias("release"), deadline.alias("deadline"), slot.alias("slot"),
                                           "place").alias("__mix"))


def in_mixed_order(docs: DataFrame, tickets: dict | None = None, **options) -> DataFrame:
    """``docs`` with its own columns, in the mixed order: partitions are ranges of slots, sorted within.

    Null sources, sizes, ties, repeated rows, long texts and empty tables are those of ``mix``. A document lies where its first character
    does, so what is written may run past the end of a block by the rest of one document.
    """
    own = "__mix"
    while own in docs.columns:
        own += "_"
    mixed = mix(docs.withColumnRenamed("__mix", own), tickets, **options)
    slot, place = F.col("__mix.slot"), F.col("__mix.place")
    return mixed.repartitionByRange(slot, place).sortWithinPartitions(slot, place).drop("__mix").withColumnRenamed(own, "__mix")
