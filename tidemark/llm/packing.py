"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the packing is decided on the histogram of lengths: at most ``capacity`` rows on
the driver, at any size of the input. The plan is a list of intervals "the pieces of length l with ranks a to b lie in the sequences
s, s+1, ... at offset o"; pieces find their place by their rank within their length. Ranks are running counts, split by salts, so
that one very common length is no single task.
"""

import bisect
import zlib
from collections import defaultdict
from math import isqrt

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import map_rows, salted_running_sum
from tidemark.session import materialise

CAPACITY, END_ID = 2048, 0
#: Documents of a stored order that are counted in one run.
RUN = 65_536
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


class _Plan:
    """Counts of unplaced pieces by length, and the intervals placed so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used, self.rank = capacity, dict(counts), 0, defaultdict(int)
        self.lengths = sorted(n for n, k in counts.items() if k)
        self.intervals: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset

    def take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.intervals.append((length, self.rank[length], sequence, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def open(self, n: int) -> int:
        self.used += n
        return self.used - n

    def fix(self, members: tuple[int, ...], n: int) -> None:
        """``n`` sequences that hold exactly these lengths."""
        at, offset = self.open(n), 0
        for length in members:
            self.take(length, n, at, offset)
            offset += length

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``most`` of which a piece is left besides ``without``."""
        i = bisect.bisect_right(self.lengths, most) - 1
        while i >= 0 and self.left[self.lengths[i]] <= without.count(self.lengths[i]):
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def smallest(self, n: int, without: int) -> list[int]:
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n - len(out), self.left[length] - (length == without))
            if len(out) == n:
                break
        return out


def _dominating(plan: _Plan, j: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates every other set with ``j``, of one to three pieces; None if none is proven."""
    room = plan.capacity - j
    k = plan.largest(room, (j,))
    if k is None:
        return (j,)  # nothing fits beside it
    if k == room:
        return (j, k)  # fills the sequence: whatever else would lie beside j fits into the place of k
    least = plan.smallest(3, j)
    if len(least) < 2 or least[0] + least[1] > room:
        return (j, k)  # only one piece fits beside it, and k is the largest
    if len(least) < 3 or sum(least) > room:  # at most two fit: is one pair at least as large in both places as all others?
        a = plan.largest(room - least[0], (j,))
        if a is None or a < k:
            return None
        b = plan.largest(min(a, room - a), (j, a))
        most = plan.largest(room // 2, (j,))  # the smaller one of any pair is no larger than this
        if b is not None and most is not None and b >= most:
            return (j, a, b)
    return None


def reduce_by_dominance(plan: _Plan) -> int:
    """Fix dominating sets from the largest length down, until a pass fixes none. Returns the sequences fixed."""
    before, moved = plan.used, True
    while moved:
        moved = False
        for j in sorted(plan.lengths, reverse=True):
            while plan.left.get(j, 0) and (members := _dominating(plan, j)):
                # a set that fills the sequence or stands alone stays dominating while pieces last; others are proven anew each time
                n = min(plan.left[m] // members.count(m) for m in members)
                full = sum(members) == plan.capacity or len(members) == 1
                plan.fix(members, n if full else max(1, n - 1))
                moved = True
    return plan.used - before


def best_fit(plan: _Plan) -> None:
    """Longest first, each piece into the fullest sequence it fits; equal sequences are handled together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, at: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((at, n))

    while plan.lengths:
        length = plan.lengths[-1]
        i = bisect.bisect_left(rooms, length)
        if i == len(rooms):
            deep = min(plan.capacity // length, plan.left[length])
            n = plan.left[length] // deep
            at = plan.open(n)
            for layer in range(deep):
                plan.take(length, n, at, layer * length)
            put(plan.capacity - deep * length, at, n)
            continue
        room = rooms[i]
        at, n = groups[room].pop()
        used = min(n, plan.left[length])
        if used < n:
            groups[room].append((at + used, n - used))
        if not groups[room]:
            del groups[room]
            rooms.pop(i)
        plan.take(length, used, at, plan.capacity - room)
        put(room - length, at, used)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """(intervals, sequences fixed by dominance, sequences in all) for a histogram of lengths."""
    plan = _Plan({n: k for n, k in counts.items() if k}, capacity)
    fixed = reduce_by_dominance(plan)
    best_fit(plan)
    return sorted(plan.intervals), fixed, plan.used


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only longer ones are cut, the first piece may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks: str = RANKS,
                 vocabulary: str = VOCABULARY, end_id: int = END_ID, order: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row for each piece of each tokenised document, its end id included.

    With ``order`` also ``at0``, ``at1``: these two numbers of the document.
    """
    at = [f"at{i}" for i in range(len(order))]

    def cut(rows):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *at)}
        for doc_id, text, *placed in zip(rows["doc_id"], rows["text"], *(rows[a] for a in at), strict=True):
            ids = np.append(bpe.encode_ids(text, ranks, vocabulary), np.uint32(end_id)).astype("<u4", copy=False)
            for i, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                for k, v in zip(out, (doc_id, i, start, n, zlib.crc32(ids[start:start + n].tobytes()), *placed), strict=True):
                    out[k].append(v)
        return out

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[o.cast("bigint").alias(a) for o, a in zip(order, at, strict=True)])
    return map_rows(rows, cut, ", ".join([PIECE, *[f"{a} bigint" for a in at]]))


def stored_order(docs: DataFrame) -> tuple[Column, ...]:
    """Where a row stands in the stored table ``docs`` was read from: number of its part file, row in it. Empty for rows not read from files."""
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file["file_name"], file["row_index"])
    except AnalysisException:
        return ()
    part = F.nullif(F.regexp_extract(file["file_name"], "^part-([0-9]+)", 1), F.lit(""))
    return F.coalesce(part.cast("bigint"), F.lit(0)), file["row_index"]


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, order: tuple[Column, ...] = (), **tokens) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: gapless from 0 within a sequence, no sequence longer than ``capacity``.

    A null or empty text is a document of the end id alone. Repeated rows are packed as often as they occur, ties in length are
    ordered by id, piece and checksum; null ids are packed like others. An empty table gives an empty result. Columns beside id and
    text are ignored whatever their names.

    ``order`` is a place of each document as two whole numbers, such as ``stored_order``. With it pieces of a length are dealt to the
    sequences in that order, and sequences are numbered by the place of the first document in them, so reading them one after the
    other keeps the order as far as the packing allows. How many sequences there are and how full they are does not depend on it.
    """
    pieces = materialise(token_pieces(docs, capacity=capacity, order=order, **tokens), "pieces")
    placed = [F.col(f"at{i}") for i in range(len(order))]
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    intervals, _, _ = plan_packing(counts, capacity)
    table = np.array(intervals or [(0, 0, 0, 0)], dtype=np.int64)
    shared = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]))
    salts = isqrt(max(counts.values(), default=1)) + 1
    ties = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    # the rows of a length, split: in runs of the order, or by hashes
    salt = F.struct(placed[0], F.floor(placed[1] / RUN)) if order else F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))
    ranked = salted_running_sum(pieces, "length", F.lit(1), [*placed, *ties], salt, "rank")

    def place(rows):
        keys, first, sequence, offset = shared.value
        ranks = np.array(rows["rank"], np.int64)
        i = np.searchsorted(keys, np.array(rows["length"], np.int64) << 44 | ranks, side="right") - 1
        rows.pop("rank")
        return rows | {"sequence_id": (sequence[i] + ranks - first[i]).tolist(), "offset": offset[i].tolist()}

    out = map_rows(ranked, place, ", ".join([PIECE, *[f"at{i} bigint" for i in range(len(order))], "sequence_id bigint, offset bigint"]))
    return _numbered(materialise(out, "placed")) if order else out


def _numbered(out: DataFrame) -> DataFrame:
    """Sequences numbered from 0 by the place of the first document in them; one document's whole sequences by their old numbers."""
    first = out.groupBy("sequence_id").agg(F.min(F.struct("at0", "at1")).alias("at")).select(
        F.col("sequence_id").alias("old"), F.lit(0).alias("all"), "at.at0", "at.at1")
    run = F.struct("at0", F.floor(F.col("at1") / RUN))
    number = salted_running_sum(first, "all", F.lit(1), [F.col("at0"), F.col("at1"), F.col("old")], run, "number").select("old", "number")
    return out.join(number, out["sequence_id"] == number["old"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("number").alias("sequence_id"), "offset")
