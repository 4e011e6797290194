"""Near-duplicate collapse and novelty of articles.

Identical texts are folded into one *story* per (ticker, n-gram set) first, so a story republished a million times is
compared once. Stories meet only inside time buckets at least as wide as the window, and what a bucket needs to know of a story is
its first and last appearance. Whole bodies are compared, in tiles of two blocks of stories; texts are shuffled, n-grams are not.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks, text
from tidemark.session import materialise


def _compared(title="title", body="body", body_chars: int | None = None) -> Column:
    """What is compared of an article, before ``text.normalised``."""
    part = F.col(body) if body_chars is None else F.substring(body, 1, body_chars)
    return F.lower(F.concat(F.col(title), F.lit(" "), part))


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of the last column, a text: the hash of the set of its n-grams and their number, null for a null."""
    for batch in batches:
        story, size = [], []
        for value in batch.column(batch.num_columns - 1):
            value = value.as_py()
            grams = None if value is None else _gram_keys(text.normalised(value))
            story.append(None if grams is None else int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True))
            size.append(None if grams is None else len(grams))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(story, pa.int64()), pa.array(size, pa.int64())],
                                         names=[*batch.schema.names[:-1], "_story", "_n"])


def _occurrences(numbered: DataFrame, hours: float, id_col: str, body_chars: int | None) -> DataFrame:
    """(number, id, ticker, at in seconds, characters, bucket, story, n-grams). The n-grams themselves are many times the text and are not stored."""
    at = F.unix_micros(S.AVAILABLE_AT) / F.lit(1e6)
    size = F.length("title") + F.length("body")
    given = numbered.select("_number", F.col(id_col).alias("_id"), S.TICKER, at.alias("_at"), F.coalesce(size, F.lit(0)).cast("long").alias("_chars"),
                            F.floor(at / F.lit(hours * 3600.0)).cast("long").alias("_bucket"), _compared(body_chars=body_chars).alias("_text"))
    schema = given.drop("_text").withColumns({"_story": F.lit(None).cast("long"), "_n": F.lit(None).cast("long")}).schema
    return materialise(given.mapInArrow(_signatures, schema), "signatures")  # costly to compute and read several times below


def _stories(occ: DataFrame) -> DataFrame:
    """One row per (ticker, bucket, story): an article that has its text, its size and n-grams, first and last appearance."""
    return occ.filter("_n > 0").groupBy(S.TICKER, "_bucket", "_story").agg(
        F.min("_number").alias("_text_of"), F.max("_chars").alias("_chars"), F.max("_n").alias("_n"), F.min(F.struct("_at", "_id")).alias("_first"), F.max("_at").alias("_last"))


#: Size of a block of stories, in characters, and what a story counts besides its text: where all overlaps are held, and where few are.
BLOCK_CHARS, STORY_CHARS, THIN_CHARS = 10_000_000, 5_000, 1_500


def _tiles(numbered: DataFrame, stories: DataFrame, body_chars: int | None, story_chars: int = STORY_CHARS, next_from: Column | None = None) -> DataFrame:
    """The stories of each bucket and of the one before it with their text, in tiles (ticker, bucket, u, v) of two blocks or one.

    Two stories of which one lies in the bucket meet in one tile: in (u, u) those of a block, in (u, v) those of different blocks. Blocks
    are as many as their size asks for, so a bucket with few stories is one tile and holds each text once. Stories that were last seen
    before ``next_from``, in seconds, are out of reach of the bucket after theirs.
    """
    both = stories.select(S.TICKER, F.explode(F.array(
        F.struct(F.col("_bucket").alias("_bucket"), F.lit(True).alias("_same")),
        F.struct((F.col("_bucket") + 1).alias("_bucket"), F.lit(False).alias("_same")))).alias("x"),
        "_story", "_text_of", "_chars", "_n", "_first", "_last").select(S.TICKER, "x.*", "_story", "_text_of", "_chars", "_n", "_first", "_last")
    if next_from is not None:
        both = both.filter(F.col("_same") | (F.col("_last") >= next_from))
    blocks = both.groupBy(S.TICKER, "_bucket").agg(
        F.ceil(F.sum(F.col("_chars") + story_chars) / F.lit(float(BLOCK_CHARS))).alias("_blocks"), F.max("_same").alias("_any"))
    dealt = both.join(blocks.filter("_any").drop("_any"), [S.TICKER, "_bucket"]).withColumn("_block", F.pmod("_story", "_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = dealt.withColumn("_w", other).withColumns({"_u": F.least("_block", "_w"), "_v": F.greatest("_block", "_w")})
    thin = dealt.select(S.TICKER, "_bucket", "_u", "_v", "_block", "_same", "_story", "_text_of", "_n", "_first._at", "_first._id", "_last")
    texts = numbered.select(F.col("_number").alias("_text_of"), _compared(body_chars=body_chars).alias("_text"))
    return thin.join(texts, "_text_of").drop("_text_of")


def _all_keys(value: str) -> np.ndarray:
    """64-bit keys of the character 5-grams of a text, one for each place; a shorter text is its own only gram."""
    chars = np.frombuffer(value.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = min(5, len(chars))
    keys = np.zeros(len(chars) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys += chars[k:len(chars) - n + 1 + k]
        keys += np.uint64(n)
    return keys


def _gram_keys(value: str) -> np.ndarray:
    """Distinct 64-bit keys of the character 5-grams of a text."""
    keys = np.sort(_all_keys(value))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _overlaps(texts: list[str]) -> np.ndarray:
    """Overlap (intersection by union) of the n-gram sets of each two texts of a tile; exact counts."""
    grams = [_gram_keys(t) for t in texts]
    sizes, n = np.array([len(g) for g in grams], np.float64), len(grams)
    _, key = np.unique(np.concatenate(grams), return_inverse=True)
    order = np.argsort(key, kind="stable")
    rows, uses = np.repeat(np.arange(n), sizes.astype(np.int64))[order], np.bincount(key)
    start = np.cumsum(uses) - uses
    shared = np.zeros((n, n), np.float32)
    for few in range(2, min(16, n) + 1):  # grams of few texts: their pairs are counted
        at = start[uses == few]
        i, j = np.triu_indices(few, 1)
        for part in range(0, len(at), 1 << 14):
            held = rows[at[part:part + (1 << 14), None] + np.arange(few)]
            shared += np.bincount((held[:, i] * n + held[:, j]).ravel(), minlength=n * n).reshape(n, n).astype(np.float32)
    shared += shared.T
    many = np.flatnonzero(uses > 16)
    for part in range(0, len(many), 4096):  # grams of many texts: as columns of a matrix of ones
        chosen = many[part:part + 4096]
        column = np.repeat(np.arange(len(chosen)), uses[chosen])
        first = np.repeat(start[chosen], uses[chosen]) + np.arange(len(column)) - np.repeat(np.cumsum(uses[chosen]) - uses[chosen], uses[chosen])
        held = np.zeros((n, len(chosen)), np.float32)
        held[rows[first], column] = 1.0
        shared += held @ held.T
    counted = shared.astype(np.float64)
    counted /= sizes[:, None] + sizes[None, :] - counted
    return counted


def _gram_bits(value: str, level: int) -> np.ndarray:
    """A bit for each of 2^level buckets of hashes (level 6 at least): whether a 5-gram of the text falls into it."""
    keys = _all_keys(value)
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    keys >>= np.uint64(64 - level)
    held = np.zeros(1 << level, np.bool_)
    held[keys.astype(np.int64)] = True
    return np.packbits(held).view(np.uint64)


def _folded(bits: np.ndarray, times: int) -> np.ndarray:
    """The bits of a text with half as many buckets, so many times."""
    held = np.unpackbits(bits.view(np.uint8))
    for _ in range(times):
        held = held[0::2] | held[1::2]
    return np.packbits(held).view(np.uint64)


def _similar(texts: list[str], sizes: np.ndarray, meet, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), one way, of texts whose n-gram sets overlap by ``threshold`` (above 0) or more, of those that ``meet(i, others)`` lets meet.

    Sets of a and b n-grams that overlap so much differ by (1 - threshold) / (1 + threshold) * (a + b) n-grams at most. Of each bucket of hashes
    that one text has and the other has not, one n-gram at least is in one set only: pairs with more of those are out, as are sets of
    too different size. What is left, few pairs where coverage is not alike, is counted exactly.
    """
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order].astype(np.float64)
    share, slack = (1.0 - threshold) / (1.0 + threshold), 1.0 + 1e-9
    end = np.searchsorted(ranked, ranked / threshold * slack, side="right")
    level = np.maximum(10, np.ceil(np.log2(4.0 * ranked)).astype(np.int64))
    made = [_gram_bits(texts[i], int(lv)) for i, lv in zip(order, level, strict=True)]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lv in np.unique(level):  # rows of one level lie together
        low, high = np.searchsorted(level, [lv, lv + 1])
        bits = np.stack([made[k] if level[k] == lv else _folded(made[k], int(level[k] - lv)) for k in range(low, end[high - 1])])
        for at in range(low, high):
            others = order[at + 1:end[at]]
            apart = np.bitwise_count(bits[at - low] ^ bits[at - low + 1:end[at] - low]).sum(axis=1, dtype=np.int64)
            others = others[(apart <= share * (ranked[at] + ranked[at + 1:end[at]]) * slack) & meet(order[at], others)]
            left.append(np.full(len(others), order[at]))
            right.append(others)
    return _exactly(texts, np.concatenate(left), np.concatenate(right), threshold)


def _exactly(texts: list[str], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose overlap is ``threshold`` or more; pairs with the same left place lie together."""
    if not len(left):
        return left, right
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    grams = [_gram_keys(texts[i]) for i in used]
    sizes = np.array([len(g) for g in grams], np.int64)
    values, code = np.unique(np.concatenate(grams), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    of = lambda i: code[start[i]:start[i] + sizes[i]]
    left_place, right_place = place[:len(left)], place[len(left):]
    held, near = np.zeros(len(values), np.bool_), np.zeros(len(left), np.bool_)
    cuts = np.flatnonzero(np.concatenate([[True], left_place[1:] != left_place[:-1], [True]]))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        a = left_place[low]
        held[of(a)] = True
        for pair in range(low, high):
            b = right_place[pair]
            shared = float(np.count_nonzero(held[of(b)]))
            near[pair] = shared / (float(sizes[a]) + float(sizes[b]) - shared) >= threshold
        held[of(a)] = False
    return left[near], right[near]


def _meeting(tile) -> np.ndarray:
    """Which rows of a tile meet which: two stories, of different blocks unless the tile is one block."""
    story, block = tile["_story"].to_numpy(), tile["_block"].to_numpy()
    apart = story[:, None] != story[None, :]
    return apart if tile["_u"].iloc[0] == tile["_v"].iloc[0] else apart & (block[:, None] != block[None, :])


def novelty_scores(articles: DataFrame, *, lookback_days: float = 7.0, id_col: str = "content_hash", body_chars: int | None = None) -> DataFrame:
    """(id, ticker, available_at, novelty): 1 less the largest overlap with the ticker's earlier coverage.

    An article whose story already appeared inside the look-back scores 0 without a comparison; only the first of a run of copies is
    compared with other stories. In a bucket that is the story's first appearance. The largest overlap is exact: every story in reach is
    compared, in tiles of bounded size, so work grows with the square of a ticker's stories in one look-back and in proportion otherwise.
    """
    span = lookback_days * 86400.0
    numbered = materialise(articles.withColumn("_number", F.monotonically_increasing_id()), "numbered")  # fixed once written
    occ = _occurrences(numbered, lookback_days * 24.0, id_col, body_chars)
    stories = materialise(_stories(occ), "stories")
    me = F.struct("_at", "_id")
    key = ["_id", S.TICKER, "_at"]
    same = stories.select(S.TICKER, "_bucket", "_story", F.col("_first").alias("_first2"))
    prior = stories.select(S.TICKER, (F.col("_bucket") + 1).alias("_bucket"), "_story", F.col("_last").alias("_last2"))
    seen = occ.join(same, [S.TICKER, "_bucket", "_story"], "left").join(prior, [S.TICKER, "_bucket", "_story"], "left")
    again = F.coalesce(F.col("_first2") < me, F.lit(False)) | F.coalesce(F.col("_last2") >= F.col("_at") - span, F.lit(False))
    seen = seen.withColumn("_again", again)

    def closest(tile):
        tile = tile.reset_index(drop=True)
        overlap = np.where(_meeting(tile), _overlaps([text.normalised(t) for t in tile["_text"]]), 0.0)
        rank = np.empty(len(tile), np.int64)
        ordered = sorted(range(len(tile)), key=lambda i: (tile["_at"][i], tile["_id"][i]))
        for place, i in enumerate(ordered):
            tie = place and (tile["_at"][i], tile["_id"][i]) == (tile["_at"][ordered[place - 1]], tile["_id"][ordered[place - 1]])
            rank[i] = rank[ordered[place - 1]] if tie else place
        own = tile["_same"].to_numpy()
        earlier = np.where(own[None, :], rank[None, :] < rank[:, None], tile["_last"].to_numpy()[None, :] >= tile["_at"].to_numpy()[:, None] - span)
        best = np.where(earlier, overlap, 0.0).max(axis=1)
        return tile.loc[own, [S.TICKER, "_bucket", "_story"]].assign(_best=best[own])

    tile_key = [S.TICKER, "_bucket", "_u", "_v"]
    types = {f.name: f.dataType.simpleString() for f in stories.schema.fields}
    found = _tiles(numbered, stories, body_chars).groupBy(*tile_key).applyInPandas(
        closest, f"{S.TICKER} {types[S.TICKER]}, _bucket bigint, _story bigint, _best double")
    best = found.groupBy(S.TICKER, "_bucket", "_story").agg(F.max("_best").alias("_best"))
    scored = seen.join(best, [S.TICKER, "_bucket", "_story"], "left")
    share = F.when(F.col("_again") & (F.col("_n") > 0), 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return scored.select(F.col("_id").alias(id_col), S.TICKER, F.timestamp_micros(
        F.round(F.col("_at") * 1e6).cast("long")).alias(S.AVAILABLE_AT), F.greatest(F.lit(0.0), 1.0 - share).alias("novelty"))


#: Windows in a bucket of the near-duplicate search: the more, the fewer texts lie in reach of two buckets.
BUCKET_WINDOWS = 4


def similar_stories(numbered: DataFrame, occ: DataFrame, threshold: float, window_hours: float, body_chars: int | None = None) -> DataFrame:
    """(ticker, story, story2), both ways, for distinct stories that come within reach of each other and overlap enough.

    ``occ`` has buckets of ``BUCKET_WINDOWS`` windows.
    """
    span = window_hours * 3600.0 + 1.0  # a second more, since sums of instants are rounded; the ordered pass compares the instants themselves
    start = F.col("_bucket") * F.lit(window_hours * BUCKET_WINDOWS * 3600.0)
    tiles = _tiles(numbered, _stories(occ), body_chars, THIN_CHARS, start - span)

    def pairs(tile):
        own, story, block, first, last = (tile[c].to_numpy() for c in ("_same", "_story", "_block", "_at", "_last"))
        within = tile["_u"].iloc[0] == tile["_v"].iloc[0]
        meet = lambda i, others: ((own[i] | own[others]) & (story[i] != story[others]) & (within | (block[i] != block[others]))
                                  & (first[others] - last[i] <= span) & (first[i] - last[others] <= span))
        i, j = _similar([text.normalised(t) for t in tile["_text"]], tile["_n"].to_numpy(), meet, threshold)
        return pd.DataFrame({S.TICKER: tile[S.TICKER].iloc[0], "_story": np.concatenate([story[i], story[j]]), "_story2": np.concatenate([story[j], story[i]])})

    kind = numbered.schema[S.TICKER].dataType.simpleString()
    return tiles.groupBy(S.TICKER, "_bucket", "_u", "_v").applyInPandas(pairs, f"{S.TICKER} {kind}, _story bigint, _story2 bigint").distinct()


def deduplicate(articles: DataFrame, *, threshold: float = 0.60, window_hours: float = 72.0,
                id_col: str = "content_hash", body_chars: int | None = None) -> DataFrame:
    """Keep the earliest of near-duplicates: an article goes if an earlier *kept* one is close in time and text.

    Rows are told apart by a number of their own, so of rows with the same id, ticker and instant the first stays. Articles without a
    ticker, a text or an instant stay.

    Only articles with a similar neighbour need the ordered pass. It takes them in runs of bounded size, all at once: a run decides what does not
    depend on articles of runs before it. Rounds repeat this for what is left, and are no more than the runs of a ticker.
    """
    numbered = materialise(articles.withColumn("_number", F.monotonically_increasing_id()), "numbered")  # fixed once written
    occ = _occurrences(numbered, window_hours * BUCKET_WINDOWS, id_col, body_chars)
    edges = materialise(similar_stories(numbered, occ, threshold, window_hours, body_chars), "similar")
    copies = occ.groupBy(S.TICKER, "_story").agg(F.count("*").alias("_copies"), F.max("_n").alias("_size"))
    linked = edges.groupBy(S.TICKER, "_story").agg(F.count("*").alias("_linked"))
    involved = (
        occ.filter("_at is not null").select(S.TICKER, "_story", F.struct("_at", "_id", "_number").alias("_c"))
        .join(copies, [S.TICKER, "_story"]).join(linked, [S.TICKER, "_story"], "left")
        .filter("_size > 0 and (_copies > 1 or _linked > 0)").select(S.TICKER, "_story", "_c", (F.lit(1) + F.coalesce("_linked", F.lit(0))).alias("_weight"))
    )
    involved = materialise(involved, "involved")
    kept = _kept_in_runs(involved, edges, window_hours * 3600.0)
    dropped = involved.select(F.col("_c._number").alias("_gone")).join(kept, F.col("_gone") == F.col("_kept"), "left_anti")
    return numbered.join(dropped, numbered["_number"] == dropped["_gone"], "left_anti").drop("_number")


#: Articles and similar pairs of their stories in a run, and parts of the window at which a run may end.
RUN_WEIGHT, RUN_CUTS = 500_000, 256


def _kept_in_runs(involved: DataFrame, edges: DataFrame, span: float) -> DataFrame:
    """(_kept): numbers of the articles that the ordered pass keeps. ``edges`` holds similar stories both ways."""
    ticker, story, run = S.TICKER, [S.TICKER, "_story"], [S.TICKER, "_run"]
    # of copies at one instant all but the first go, whatever becomes of it
    open_ = involved.groupBy(*story, F.col("_c._at").alias("_at")).agg(F.min("_c").alias("_c"), F.first("_weight").alias("_weight"))
    open_ = materialise(open_.withColumn("_cut", F.floor(F.col("_at") / F.lit(span / RUN_CUTS)).cast("long")), "open")
    edges = edges.select(ticker, "_story", "_story2")
    id_type = involved.schema["_c"].dataType["_id"].dataType
    parts = []
    while True:
        cuts = open_.groupBy(ticker, "_cut").agg(F.sum("_weight").alias("_w"), F.min("_at").alias("_start"), F.max("_at").alias("_end"))
        before = F.sum("_w").over(Window.partitionBy(ticker).orderBy("_cut")) - F.col("_w")  # a row for each part of a window: bounded by the calendar
        cuts = materialise(cuts.withColumn("_run", F.floor(before / F.lit(RUN_WEIGHT)).cast("long")), "cuts")
        rows = open_.join(cuts.select(ticker, "_cut", "_run"), [ticker, "_cut"]).drop("_cut", "_weight")
        runs = cuts.groupBy(*run).agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))
        later = runs.select(ticker, F.col("_run").alias("_run2"), F.col("_start").alias("_start2"))
        reach = runs.join(later, ticker).filter((F.col("_run2") > F.col("_run")) & (F.col("_start2") <= F.col("_end") + span + 1.0)).select(*run, "_run2", "_start2")
        last = rows.groupBy(*run, "_story").agg(F.max("_at").alias("_at"))
        waiting = last.join(reach, run).filter(F.col("_at") >= F.col("_start2") - span - 1.0).groupBy(ticker, F.col("_run2").alias("_run"), "_story").agg(F.max("_at").alias("_at"))
        beside = rows.select(*run, "_story").distinct().join(edges, story)
        null = lambda kind: F.lit(None).cast(kind)
        given = rows.select(*run, F.lit(0).alias("_kind"), "_story", "_at", F.col("_c._id").alias("_id"), F.col("_c._number").alias("_other")).union(
            waiting.select(*run, F.lit(1), "_story", "_at", null(id_type), null("long"))).union(
            beside.select(*run, F.lit(2), "_story", null("double"), null(id_type), F.col("_story2")))
        told = materialise(given.groupBy(*run).applyInArrow(_decider(span), "_number bigint, _kept boolean"), "told")
        parts.append(told.filter("_kept").select(F.col("_number").alias("_kept")))
        if not told.filter("_kept is null").limit(1).count():
            return _union(parts)
        of = lambda state: open_.join(told.filter(state), F.col("_c._number") == F.col("_number"), "left_semi")
        open_ = materialise(_uncovered(of("_kept is null"), of("_kept"), edges, span), "open")
        if len(parts) >= 16:  # keep the plan of the union short
            parts = [materialise(_union(parts), "kept")]


def _decider(span: float):
    """The ordered pass over a run: which articles are kept (true) or undecided (null); those that go are left out.

    Rows by ``_kind``: 0 an article, 1 the last undecided article of a story before the run, 2 two similar stories.
    """
    def decide(given: pa.Table) -> pa.Table:
        of = lambda kind: given.filter(pc.equal(given["_kind"], kind))
        rows, waiting, beside = of(0), of(1), of(2)
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("_at", "_id", "_other")], null_placement="at_start"))
        number, at = rows["_other"].to_numpy(), rows["_at"].to_numpy()
        known = np.unique(np.concatenate([rows["_story"].to_numpy(), waiting["_story"].to_numpy()]))
        story = np.searchsorted(known, rows["_story"].to_numpy())
        a, b = (beside[c].to_numpy().astype(np.int64) for c in ("_story", "_other"))
        met = np.isin(b, known)
        a, b = np.searchsorted(known, a[met]), np.searchsorted(known, b[met])
        order = np.argsort(a, kind="stable")
        b, first = b[order], np.searchsorted(a[order], np.arange(len(known) + 1))
        kept, open_ = np.full(len(known), -np.inf), np.full(len(known), -np.inf)
        open_[np.searchsorted(known, waiting["_story"].to_numpy())] = waiting["_at"].to_numpy()
        told = []
        for k, own in enumerate(story.tolist()):
            now, near = at[k], b[first[own]:first[own + 1]]
            within = lambda last: now - last[own] <= span or (len(near) and now - last[near].max() <= span)
            if within(kept):
                continue
            state = None if within(open_) else True
            (kept if state else open_)[own] = at[k]
            told.append((number[k], state))
        return pa.table({"_number": pa.array([n for n, _ in told], pa.int64()), "_kept": pa.array([s for _, s in told], pa.bool_())})

    return decide


def _uncovered(open_: DataFrame, kept: DataFrame, edges: DataFrame, span: float) -> DataFrame:
    """The open articles that no kept one of the same or a similar story covers. They meet by windows, the earlier one's or the next."""
    bucket = F.floor(F.col("_at") / F.lit(span + 1.0)).cast("long")
    near = open_.select(S.TICKER, "_story").distinct()
    near = near.join(edges, [S.TICKER, "_story"]).union(near.withColumn("_story2", F.col("_story")))
    places = open_.select(S.TICKER, "_story", "_c", bucket.alias("_bucket")).join(near, [S.TICKER, "_story"])
    covers = kept.select(S.TICKER, F.col("_story").alias("_story2"), F.col("_c").alias("_from"), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    gone = places.join(covers, [S.TICKER, "_story2", "_bucket"]).filter(
        (F.col("_c") > F.col("_from")) & (F.col("_c._at") - F.col("_from._at") <= span)).select(F.col("_c._number").alias("_gone"))
    return open_.join(gone, F.col("_c._number") == F.col("_gone"), "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def coverage_summary(articles: DataFrame) -> DataFrame:
    """Articles, tickers, articles per ticker, median body length, share of headline-only articles.

    The median comes from counts of lengths, so no task sees all rows.
    """
    length = F.length("body")
    lengths = articles.select(F.lit(0).alias("_all"), length.cast("double").alias("_l"))
    middle = ranks.quantiles(lengths, ["_all"], "_l", [0.5]).agg(F.max(F.col("q")[0]).alias("median_body_chars"))  # one row
    out = articles.agg(
        F.count("*").alias("n_articles"), F.count_distinct(S.TICKER).alias("n_tickers"),
        F.round(F.count("*") / F.greatest(F.count_distinct(S.TICKER), F.lit(1)), 2).alias("articles_per_ticker"),
        F.avg((length < 50).cast("double")).alias("headline_only_frac"))
    return out.crossJoin(F.broadcast(middle)).select("n_articles", "n_tickers", "articles_per_ticker", "median_body_chars", "headline_only_frac")  # one row each
