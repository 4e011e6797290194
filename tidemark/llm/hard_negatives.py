"""Hard negatives by a vertical scan (BOND): branch and bound over columns of vectors.

Vectors are held in blocks, one array for each dimension, with the least and largest value of every dimension. For an anchor the
dimensions are read in descending order of its own magnitude. After each stretch of dimensions a candidate's score lies between what
it has so far plus the least, and plus the largest, that the block's remaining dimensions could add; candidates that these bounds rule
out leave the bitmap. Two scans: the closest rows of the anchor's label (its positives), then the closest rows of other labels inside
the score window of each positive.

Every block of anchors meets every block of rows, as the query set is stated; each meeting is one row of a join on a slot number, so the
work of a task is bounded by the sizes of two blocks, whatever label or vector is frequent. Scores are whole numbers and exact.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import session
from tidemark.session import materialise

#: Rows and anchors of a block; dimensions read before the first look at the bounds, and between two looks.
BLOCK, ANCHORS, FIRST, STEP = 4096, 256, 16, 8
#: A row without an id can be chosen, after all others of the same score.
_NO_ID = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, vec_col: str, scale: float) -> tuple[DataFrame, int]:
    """``vectors`` with ``__q``, the components floor(scale x), and the number of dimensions; rows that take no part are left out."""
    sized = vectors.agg(F.max(F.size(vec_col))).first()[0]
    dims = max(sized or 0, 0)
    most = (2.0 ** 52 / max(dims, 1)) ** 0.5  # sums of products stay exact in a double
    x = F.col(vec_col).cast("array<double>")
    fits = F.coalesce(F.forall(x, lambda v: F.coalesce(F.abs(v * scale) < most, F.lit(False))), F.lit(False))
    q = F.transform(x, lambda v: F.floor(v * scale).cast("int"))
    return vectors.where(fits).withColumn("__q", F.concat(q, F.array_repeat(F.lit(0), F.lit(dims) - F.size(vec_col)))), dims


def _matrix(column: pa.Array, n: int, dims: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, dims).T)


_BLOCKS = "n int, row binary, id binary, label binary, x binary, low binary, high binary"


def pack_rows(dims: int, size: int):
    """Rows (row, id, label, q) of a partition, as blocks of up to ``size`` sorted by label and id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches, size):
            row, label = t["row"].to_numpy(), t["label"].to_numpy()
            ids = t["id"].fill_null(_NO_ID).to_numpy()
            order = np.lexsort((row, ids, label))
            x = _matrix(t["q"], len(row), dims)[:, order]
            values = [len(row), row[order].tobytes(), ids[order].tobytes(), label[order].tobytes(), x.tobytes(), x.min(1).tobytes(), x.max(1).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) if i else pa.array([v], pa.int32()) for i, v in enumerate(values)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    return run


def _stretches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[dict]:
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield _columns(held)
                held, n = [], 0
    if n:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> dict:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return {name: whole[name].combine_chunks() if whole[name].num_chunks != 1 else whole[name].chunk(0) for name in whole.column_names}


class Block:
    """Columns of a block of rows."""

    def __init__(self, n: int, row: bytes, ids: bytes, label: bytes, x: bytes, low: bytes, high: bytes):
        self.n, self.row, self.id, self.label = n, *(np.frombuffer(b, "<i8") for b in (row, ids, label))
        self.x = np.frombuffer(x, "<i4").reshape(-1, n).astype(np.float64)
        self.low, self.high = np.frombuffer(low, "<i4").astype(np.float64), np.frombuffer(high, "<i4").astype(np.float64)

    def labelled(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))


def scan(block: Block, q: np.ndarray, live: np.ndarray, rule_out, first: int = FIRST, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, exact scores) that ``rule_out(scores so far, least to come, most to come)`` leaves of ``live``."""
    order = np.argsort(-np.abs(q), kind="stable")
    q = q[order]
    a, b = q * block.low[order], q * block.high[order]
    least = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0.0)
    most = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0.0)
    score, at, stop = np.zeros(len(live)), 0, min(first, len(q))
    while at < len(q) and len(live):
        part = block.x[order[at:stop]]
        score = score + q[at:stop] @ (part if len(live) == block.n else part[:, live])
        at, stop = stop, min(stop + step, len(q))
        keep = rule_out(score, least[at], most[at])
        if not keep.all():
            live, score = live[keep], score[keep]
    return live, score


def closest(block: Block, q: np.ndarray, label: int, row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows of ``label`` that score highest, the anchor's own row left out; ties by id."""
    live = np.arange(*block.labelled(label))
    live = live[block.row[live] != row]

    def rule_out(score, least, most):
        if len(score) <= k:
            return np.ones(len(score), bool)
        return score + most >= np.partition(score, len(score) - k)[len(score) - k] + least

    live, score = scan(block, q, live, rule_out)
    best = np.lexsort((block.row[live], block.id[live], -score))[:k]
    return live[best], score[best]


def in_windows(block: Block, q: np.ndarray, label: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each window (number, low to high) the ``k`` rows of other labels that score highest in it; ties by id."""
    a, b = block.labelled(label)
    live = np.concatenate([np.arange(a), np.arange(b, block.n)])

    def rule_out(score, least, most):
        keep = np.zeros(len(score), bool)
        for bottom, top in zip(low, high, strict=True):
            sure = score[(score + least >= bottom) & (score + most <= top)]
            floor = max(bottom, np.partition(sure, len(sure) - k)[len(sure) - k] + least) if len(sure) >= k else bottom
            keep |= (score + most >= floor) & (score + least <= top)
        return keep

    live, score = scan(block, q, live, rule_out)
    out = []
    for w, (bottom, top) in enumerate(zip(low, high, strict=True)):
        inside = np.flatnonzero((score >= bottom) & (score <= top))
        best = inside[np.lexsort((block.row[live[inside]], block.id[live[inside]], -score[inside]))[:k]]
        if len(best):
            out.append((w, live[best], score[best]))
    return out


def _meet(blocks: DataFrame, anchors: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """One row for each block of rows and block of anchors. Anchors, the smaller side, are copied to the slots of the row blocks."""
    n = max(blocks.count(), 1)
    anchors = anchors.mapInArrow(_pack_anchors(size, columns), "anchors array<struct<" + ", ".join(f"{c}: {_ANCHOR_TYPES[c]}" for c in columns) + ">>")
    slots = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")).repartition(n, "slot")
    copies = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return slots.hint("merge").join(copies, "slot")


_ANCHOR_TYPES = {"row": "bigint", "label": "bigint", "q": "array<int>", "low": "array<bigint>", "high": "array<bigint>"}


def _pack_anchors(size: int, columns: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches, size):
            made = pa.StructArray.from_arrays([t[c] for c in columns], names=columns)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made)], names=["anchors"])

    return run


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Block, list[dict], np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            packed = [batch.column(c)[r].as_py() for c in ("n", "row", "id", "label", "x", "low", "high")]
            anchors = batch.column("anchors")[r].values
            n = len(anchors)
            q = anchors.field("q").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
            rest = [c for c in anchors.type.names if c != "q"] if hasattr(anchors.type, "names") else [f.name for f in anchors.type if f.name != "q"]
            yield Block(*packed), [dict(zip(rest, v, strict=True)) for v in zip(*(anchors.field(c).to_pylist() for c in rest), strict=True)], q


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best of each group over all blocks, each of which has named its own best already."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "found")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: float = 256.0,
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Rows with a null label, a null vector, or a component that is null, not finite, or so large that sums would not be exact take no part.
    Shorter vectors count as zero where they end. A null id is no anchor unless ``is_anchor`` says so, and comes last among equal scores. Repeated rows are rows of their own: a copy
    of the anchor is one of its positives. Anchors without a positive, and windows without a negative (always so where the positive's
    score is below zero), give no rows; an empty table gives none. Other columns are ignored whatever their names.
    """
    spark = session(vectors.sparkSession)
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).alias("v"),
                           F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where("label is not null and v is not null")
    clean, dims = whole_vectors(named, "v", scale)
    rows = materialise(clean.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.col("__q").alias("q"), "anchor"), "vectors")
    blocks = rows.select("row", "id", "label", "q").mapInArrow(pack_rows(dims, block), _BLOCKS)
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    chosen = rows.where("anchor")

    def near(batches):
        for held, asked, q in _meetings(batches):
            out = [(a["row"], *closest(held, q[i], a["label"], a["row"], positives)) for i, a in enumerate(asked)]
            yield _found(held, [(r, 0, live, score) for r, live, score in out])

    def inside(batches):
        for held, asked, q in _meetings(batches):
            out = []
            for i, a in enumerate(asked):
                out += [(a["row"], w, live, score) for w, live, score in in_windows(held, q[i], a["label"], np.array(a["low"], float), np.array(a["high"], float), negatives)]
            yield _found(held, out)

    top = _best(_meet(blocks, chosen.select("row", "label", "q"), anchors, ["row", "label", "q"]).mapInArrow(near, _FOUND), ["row"], positives)
    top = top.select("row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole numbers n with low * p <= 100 n <= high * p; none for a p below zero
    bottom, ceiling = F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"(positive_score * {high}) div 100")
    some = F.col("positive_score") >= 0
    top = materialise(top.withColumns({"low": F.when(some, bottom).otherwise(1), "high": F.when(some, ceiling).otherwise(0)}), "positives")
    windows = top.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))  # at most ``positives``
    asking = chosen.join(windows, "row").select("row", "label", "q", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = _meet(blocks, asking, anchors, ["row", "label", "q", "low", "high"]).mapInArrow(inside, _FOUND)
    ranked = _best(found.withColumn("place_of", F.col("window") + 1), ["row", "place_of"], negatives)
    ranked = ranked.select("row", F.col("place_of"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select("row", F.col("id").alias("anchor_id"))
    joined = ranked.join(top.select("row", F.col("place").alias("place_of"), "positive_id", "positive_score"), ["row", "place_of"]).join(named, "row")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


_FOUND = "row bigint, window int, found bigint, id bigint, score bigint"


def _found(block: Block, parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Chosen rows of a block: the anchor's row, the window, and the row, id and score found."""
    sizes = [len(p[2]) for p in parts]
    live = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, int)
    score = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0)
    ids = block.id[live]
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.array([p[0] for p in parts], np.int64), sizes), pa.int64()), pa.array(np.repeat(np.array([p[1] for p in parts], np.int32), sizes), pa.int32()),
        pa.array(block.row[live], pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(score.astype(np.int64), pa.int64())],
        names=["row", "window", "found", "id", "score"])
