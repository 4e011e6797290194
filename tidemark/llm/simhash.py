"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint of 64 bits is split into segments. Two fingerprints within the radius agree, in at least one segment, up to that
segment's share of the radius; so small Hamming balls are enumerated within each segment, matches are fetched from the table of that
segment, and the complete distance is verified. With two segments and radius 2 these are 33 probes and 1 probe.

A segment value that very many fingerprints share (large groups of near copies) would turn into all pairs. Such buckets are answered
exactly in another way: every fingerprint concerned enumerates its whole ball of half the radius, and those that meet in a value are
tied to the smallest one there. Two fingerprints within distance 2 always meet, and no value meets more than 65 of them.
"""

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import connected_components, map_rows, session
from tidemark.session import materialise

BITS, RADIUS, SEGMENTS, SHINGLE, SEED = 64, 2, 2, 3, 42
#: Fingerprints that share a segment value, above which a bucket is answered by whole balls.
DENSE = 16
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as a signed 64-bit number; texts without a word have 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(s), seed) for s in shingles], dtype=">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``carry`` for every row; null and empty texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__t"), *carry)
    schema = "doc_id bigint, fp bigint" + "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return map_rows(rows, lambda r: {c: r[c] for c in ("doc_id", *carry)} | {"fp": [fingerprint(t, width, seed) for t in r["__t"]]}, schema)


def segment_radii(segments: int, radius: int) -> list[int]:
    """The radius to search in each segment: -1 where none is needed."""
    share, more = divmod(radius, segments)
    return [share if i <= more else share - 1 for i in range(segments)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` ones in ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _key(fp: Column, i: int, segments: int) -> tuple[Column, int]:
    """Segment ``i`` as a number that also names the segment, and its width."""
    width = BITS // segments
    value = F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))
    return value.bitwiseOR(F.lit(i << width)) if segments > 1 else value, width


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _moved(value: Column, masks: list[int]) -> Column:
    """``value`` with each mask's bits flipped."""
    return F.transform(F.array(*(F.lit(_signed(m)) for m in masks)), lambda m: value.bitwiseXOR(m))


def near_pairs(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``radius`` whose components are those of all such pairs. ``fps``: distinct fp.

    Pairs of a bucket with up to ``dense`` fingerprints come out themselves; pairs of larger buckets come out as stars.
    """
    fp = F.col("fp")
    keys = [_key(fp, i, segments) for i in range(segments)]
    radii = segment_radii(segments, radius)
    entries = fps.select("fp", F.explode(F.array(*(k for (k, _), r in zip(keys, radii, strict=True) if r >= 0))).alias("key"))
    probes = fps.select("fp", F.explode(F.concat(*(_moved(k, ball(w, r)) for (k, w), r in zip(keys, radii, strict=True) if r >= 0))).alias("key"))
    crowded = materialise(entries.groupBy("key").count().where(F.col("count") > dense).select("key"), "crowded")
    table = entries.join(crowded, "key", "left_anti").select("key", fp.alias("other"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    sparse = probes.join(table, "key").where((F.col("fp") > F.col("other")) & (distance <= radius)).select(fp.alias("a"), F.col("other").alias("b"))
    # a probe and its match differ by at most the segment's radius, so both lie in what touches the crowded value
    met = probes.join(crowded, "key", "left_semi").select("fp").distinct()
    meeting = met.select("fp", F.explode(_moved(fp, ball(BITS, radius // 2))).alias("point"))
    stars = (meeting.withColumn("b", F.min("fp").over(Window.partitionBy("point")))  # at most one row for each member of the ball
             .where((F.col("fp") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius)).select(fp.alias("a"), "b"))
    return sparse.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED,
                    radius: int = RADIUS, segments: int = SEGMENTS, dense: int = DENSE,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root) and the columns ``carry`` for every row: the smallest id and the smallest fingerprint reachable
    over fingerprints within ``radius`` bits of each other.

    Equal fingerprints are one class, so copies of any number are one node and make no pairs. Null and empty texts share fingerprint
    0 and are linked like any other. Null ids never name a component unless it has no other. Repeated rows stay; an empty table gives
    an empty result; other columns are ignored whatever their names. An odd
    ``radius`` is refused: no two whole balls meet exactly there.
    """
    if radius % 2:
        raise ValueError("radius must be an even number of bits")
    session(docs.sparkSession)
    rows = materialise(fingerprints(docs, id_col, text_col, width, seed, carry), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    parts = connected_components(near_pairs(classes.select("fp"), radius, segments, dense))
    linked = parts.join(classes, parts["node"] == classes["fp"]).select("node", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(names, "root").select(F.col("node").alias("fp"), "component_id", "root")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.join(materialise(named, "named"), "fp").select("doc_id", "fp", "component_id", "root", *carry)
