"""Alignment of two tokenizers over the same texts by lockstep merging.

A batch of documents is one state: arrays of the pointers into the A tokens and the B tokens of all its lanes. Each step compares the
byte ends under all pointers at once, advances the smaller side of every lane (both sides where the ends agree), emits the agreeing
pairs as links and cuts, and drops the lanes that are finished. A document is a lane; a document of more than ``LANE`` A tokens is
several, each starting where the merge must stand at that token, so that one long document does not hold up a batch.

Counts of linked id pairs over the corpus come back in two tiers: the ``FREQUENT`` most frequent pairs are broadcast (a fixed number of
rows at any input), so each pair beyond them holds at most one part in ``FREQUENT`` of all links and is joined by shuffle.
"""

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import session
from tidemark.session import materialise

RANKS, JSON, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
LANE, FREQUENT = 128, 200_000
#: Texts of a batch are tokenised and merged together up to so many characters.
STRETCH = 1 << 20


@functools.lru_cache(2)
def _a(ranks: str) -> tuple:
    """Encoder and bytes of each id of the byte-level vocabulary."""
    encoder = bpe.ranks_encoder(ranks)
    table = [b""] * encoder.n_vocab
    for token, rank in encoder._mergeable_ranks.items():
        table[rank] = token
    return encoder, table, np.fromiter(map(len, table), np.int64)


@functools.lru_cache(2)
def _b(model: str) -> tuple:
    """Encoder and bytes of each piece: U+2581 stands for a space, <0xHH> for a byte."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path(model))
    table = []
    for i in range(encoder.get_piece_size()):
        piece = encoder.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if encoder.is_byte(i) else piece.replace("▁", " ").encode())
    return encoder, table, np.fromiter(map(len, table), np.int64)


def _ids_a(text: str, ranks: str, exact: str) -> np.ndarray:
    """Ids of a text in which special strings are plain text."""
    try:
        return _a(ranks)[0].encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    except (BaseException,) as error:  # the pattern engine panics on some texts, which is no Exception
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        encoder = _plain_json(exact)
        return np.array(encoder.encode(text, add_special_tokens=False).ids, np.int64)


@functools.lru_cache(2)
def _plain_json(name: str):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(bpe.vocabulary_path(name))
    encoder.encode_special_tokens = True
    return encoder


def tokens_of(text: str | None, ranks: str = RANKS, exact: str = JSON, model: str = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """(A ids of space and text, B ids of text); both empty where the bytes of either differ from space and text."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    want = (" " + text).encode()
    a, b = _ids_a(" " + text, ranks, exact), np.array(_b(model)[0].encode(text), np.int64)
    if b"".join(map(_b(model)[1].__getitem__, b.tolist())) != want or b"".join(map(_a(ranks)[1].__getitem__, a.tolist())) != want:
        return none, none
    return a, b


def lockstep(end_a: np.ndarray, end_b: np.ndarray, stops: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(positions in A, positions in B) of the tokens that end together, in order.

    ``end_a`` and ``end_b`` are the byte ends of the tokens of all documents of a batch, one document after the other; ``stops`` holds
    the number of A tokens up to the end of each document.
    """
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    starts = np.concatenate([np.zeros(1, np.int64), stops[:-1]]) if len(stops) else stops
    lanes = -(-(stops - starts) // lane)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(lanes)[:-1]]) * lane if len(stops) else stops, lanes) + np.arange(lanes.sum()) * lane
    stop = np.minimum(first + lane, np.repeat(stops, lanes))
    i = first.copy()
    j = np.searchsorted(end_b, np.where(i > 0, end_a[np.maximum(i, 1) - 1], 0), side="right") if len(i) else i
    while len(i):
        a, b = end_a[i], end_b[j]
        both = a == b
        cut_a[i[both]], cut_b[j[both]] = True, True  # links and cuts of this step
        i, j = i + (a <= b), j + (b <= a)
        more = i < stop
        if not more.all():  # finished lanes leave
            i, j, stop = i[more], j[more], stop[more]
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)


class Aligned:
    """The tokens of a batch of documents and where they end together."""

    def __init__(self, texts: list[str | None], ranks: str = RANKS, exact: str = JSON, model: str = PIECES, lane: int = LANE):
        pairs = [tokens_of(t, ranks, exact, model) for t in texts]
        none = [np.zeros(0, np.int64)]
        self.a, self.b = (np.concatenate([p[k] for p in pairs] or none) for k in (0, 1))
        self.n_a, self.n_b = (np.fromiter((len(p[k]) for p in pairs), np.int64, len(pairs)) for k in (0, 1))
        self.to_a, self.to_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        # documents with tokens end in both at once, so byte ends may run on over the batch
        self.cut_a, self.cut_b = lockstep(np.cumsum(_a(ranks)[2][self.a]), np.cumsum(_b(model)[2][self.b]), self.to_a[self.n_a > 0], lane)
        self.to_group = np.searchsorted(self.cut_a, self.to_a - 1, side="right")
        self.doc = np.repeat(np.arange(len(pairs)), np.diff(self.to_group, prepend=0))

    def groups(self, labels: tuple[list[str], list[str]]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document. ``labels``: each id followed by a comma, by a bar, by a semicolon, three in a row."""
        group_a = np.searchsorted(self.cut_a, np.arange(len(self.a)), side="left")
        group_b = np.searchsorted(self.cut_b, np.arange(len(self.b)), side="left")
        b_before = np.concatenate([[0], self.cut_b + 1])[group_a]  # B tokens of earlier groups
        a_before = (self.cut_a + 1)[group_b] if len(self.cut_a) else group_b  # A tokens up to this group
        out = np.empty(len(self.a) + len(self.b), object)
        sign_a, sign_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sign_a[self.cut_a], sign_b[self.cut_b] = 1, 2
        out[np.arange(len(self.a)) + b_before] = labels[0][self.a * 3 + sign_a]
        out[np.arange(len(self.b)) + a_before] = labels[1][self.b * 3 + sign_b]
        ends = self.to_a + self.to_b
        return ["".join(out[s:e])[:-1] for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]

    def links(self, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id * base + B id, how often) of the distinct linked id pairs of each document."""
        code = self.a[self.cut_a] * base + self.b[self.cut_b]
        order = np.lexsort((code, self.doc))
        code, doc = code[order], self.doc[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return doc[at], code[at], np.diff(np.append(at, len(code)))


@functools.lru_cache(2)
def _labels(n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([f"{i}{s}" for i in range(n) for s in (",", "|", ";")], object) for n in (n_a, n_b))


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most ``STRETCH`` characters, or of one row."""
    for batch in batches:
        sizes = np.array([len(t or "") for t in batch.column("text").to_pylist()], np.int64)
        at = 0
        while at < batch.num_rows:
            take = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), STRETCH, side="right")))
            yield batch.slice(at, take)
            at += take


def _list(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, exact: str = JSON, model: str = PIECES) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts) for every row: the tokens, and the positions of those that end together.

    The k-th cut of A and the k-th cut of B end group k and are linked. Null and empty texts, and texts whose tokens do not give their
    bytes back, have empty arrays. Null ids and repeated rows stay; an empty table gives none; other columns are ignored.
    """
    session(docs.sparkSession)

    def run(batches):
        for batch in _stretches(batches):
            x = Aligned(batch.column("text").to_pylist(), ranks, exact, model)
            groups = np.diff(x.to_group, prepend=0)
            start_a, start_b = np.repeat(x.to_a - x.n_a, groups), np.repeat(x.to_b - x.n_b, groups)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _list(x.a, x.n_a, pa.int32()), _list(x.b, x.n_b, pa.int32()),
                                              _list(x.cut_a - start_a, groups, pa.int32()), _list(x.cut_b - start_b, groups, pa.int32())],
                                             names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def _digests(docs: DataFrame, id_col: str, text_col: str, ranks: str, exact: str, model: str) -> DataFrame:
    """One row for each document: sizes, the hash of its groups, its distinct linked pairs and how often each stands in it."""

    def run(batches):
        for batch in _stretches(batches):
            x = Aligned(batch.column("text").to_pylist(), ranks, exact, model)
            base = len(_b(model)[1])
            doc, code, times = x.links(base)
            hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups(_labels(len(_a(ranks)[1]), base))]
            n = pa.array(np.diff(x.to_group, prepend=0), pa.int64())
            kinds = np.bincount(doc, minlength=len(x.n_a)) if len(doc) else np.zeros(len(x.n_a), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x.n_a, pa.int64()), pa.array(x.n_b, pa.int64()), n, n, pa.array(hashes, pa.string()),
                                              _list(code, kinds, pa.int64()), _list(times, kinds, pa.int32())],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(linked: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): links of each id pair over all rows of ``linked`` (pairs, times), and whether its B id has no pair of more."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % base)  # at most one row for each A id
    return each.withColumn("best", F.col("n") == F.max("n").over(of_b))


def align(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, exact: str = JSON, model: str = PIECES,
          frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row, from its whole text.

    Null and empty texts, and texts whose tokens do not give their bytes back, have zeros and an empty hash. Null ids and repeated rows
    stay (each repeat counts); an empty table gives none; other columns are ignored whatever their names. A very long text is many lanes.
    """
    session(spark)
    base = len(_b(model)[1])
    made = _digests(docs, id_col, text_col, ranks, exact, model)
    made = materialise(made.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(made, base), "pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")  # a fixed number of rows
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def look_up(batches):
        pairs, n, best = shared.value
        for batch in batches:
            code, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            hit = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
            add = lambda mask, values: np.bincount(doc[mask], values.astype(float), batch.num_rows).astype(np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, doc[hit], times[hit] * n[at[hit]])
            rest = np.bincount(doc[~hit], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
                                              pa.array(add(hit, times[hit] * best[at[hit]]) if len(pairs) else total, pa.int64()), pa.array(total, pa.int64()),
                                              _list(code[~hit], rest, pa.int64()), _list(times[~hit], rest, pa.int32())],
                                             names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "best_0", "sum_0", "pairs", "times"])

    order = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    first = materialise(made.select(order).mapInArrow(look_up, "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                                                               "best_0 bigint, sum_0 bigint, pairs array<bigint>, times array<int>"), "first-tier")
    missed = first.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = missed.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_1"), F.sum(F.col("times") * F.col("n")).alias("sum_1"))
    none = F.lit(0).cast("bigint")
    return first.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best_0") + F.coalesce("best_1", none)).alias("n_best"),
                                                  (F.col("sum_0") + F.coalesce("sum_1", none)).alias("count_sum"), "groups_sha256")
