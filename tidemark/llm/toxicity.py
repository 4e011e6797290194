"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one of what toxic texts have more of, one of ordinary text. A window is compressed with either;
the bytes it saves under the toxic dictionary are its distance. Windows are framed words: the frame (an anchor that both dictionaries
hold, and separators) makes every window compressible, so that the length shows the match of the word itself. How many windows of a
text reach which distance is turned into a score by a logistic threshold, calibrated on labelled rows that the dictionaries have not seen.

Training reads a bounded sample of labelled rows (``SAMPLE_ROWS``, smallest hash first); scoring covers every row and its whole text.
"""

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, session
from tidemark.session import materialise

SAMPLE_ROWS, TOXIC_WORDS, ORDINARY_WORDS, LEVEL, CACHE_ENTRIES = 40_000, 4_000, 2_000, 9, 300_000
FOLDS, HELD_OUT = 5, 0
_ANCHOR, _EDGE = b"\x01the common anchor of every compressed window\x02", b"\x03\x03"
_SIGNS = b".,;:!?#*$%&|<>\"'()[]{}"
#: Distances from which windows are counted.
STEPS = (6, 7, 8, 9)


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo ``FOLDS``; a null id is held out."""
    return HELD_OUT if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def words_of(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_SIGNS) for x in (text or "").lower().encode().split()) if w]


def dictionary(words: list[bytes]) -> bytes:
    """Raw dictionary content: framed words, the weightiest last, and the anchor."""
    return _EDGE + _EDGE.join(words) + _EDGE + _ANCHOR


class Distances(dict):
    """Word to distance: bytes that the window takes more under the ordinary dictionary than under the toxic one. Bounded."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int = LEVEL, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.limit, (self.toxic, self.ordinary) = limit, (self._compressor(c, level) for c in (toxic, ordinary))

    @staticmethod
    def _compressor(content: bytes, level: int):
        import zstandard

        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        window = _ANCHOR + _EDGE + word + _EDGE
        out = self[word] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return out


def features(text: str | None, distances: Distances) -> list[float]:
    """1, the logarithms of the counts of windows from each step on, and of all windows."""
    found = np.fromiter(map(distances.__getitem__, words_of(text)), np.int32)
    return [1.0, *(float(np.log1p((found >= s).sum())) for s in STEPS), float(np.log1p(len(found)))]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


_loaded: dict[int, Distances] = {}


def _distances(model: Model) -> Distances:
    key = zlib.crc32(model.toxic + model.ordinary)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Distances(model.toxic, model.ordinary)
    return _loaded[key]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton steps; the constant is not penalised."""
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(counts: DataFrame, t: str, o: str, n_toxic: int, n_other: int) -> tuple[bytes, bytes]:
    """Dictionaries from counts of the texts of either kind that hold a word; both are bounded, whatever the counts."""
    t, o = F.col(t), F.col(o)
    # the least count follows the sample and bounds lie two deviations off, so that chance finds no more words in a larger sample
    low, high = (t - 2 * F.sqrt(t)) / n_toxic, (o + 2 * F.sqrt(o) + 1) / n_other
    toxic = counts.where((t >= max(3, n_toxic / 500)) & ((t / n_toxic > 8 * (o + 0.5) / n_other) | (low > 4 * high)))
    ordinary = counts.where((o >= 3) & (o / n_other > 0.2 * t / n_toxic))
    best = lambda rows, by, n: [bytes(r.word) for r in rows.orderBy(by.desc(), "word").limit(n).collect()][::-1]
    return dictionary(best(toxic, t, TOXIC_WORDS)), dictionary(best(ordinary, o, ORDINARY_WORDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries and threshold from at most ``sample_rows`` labelled rows of the training folds; labels of other rows are not read.

    Three fifths of the sample make dictionaries by which the rest calibrates; the whole sample then makes those that score. Without labelled rows of both kinds every score is 0.5 or
    the share of toxic labels.
    """
    spark = session(docs.sparkSession)
    ids = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    ids = ids.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = ids.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)))

    def bag(r):
        found = [(w, t, p) for text, t, p in zip(r["text"], r["toxic"], r["part"], strict=True) for w in set(words_of(text))]
        return {"word": [f[0] for f in found], "toxic": [f[1] for f in found], "part": [f[2] for f in found]}

    bags = map_rows(rows.select("text", "toxic", "part"), bag, "word binary, toxic int, part bigint")
    is_toxic, first = F.col("toxic") > 0, F.col("part") < 3
    tell = lambda on: F.sum(F.when(on, 1).otherwise(0))
    counts = materialise(bags.groupBy("word").agg(tell(is_toxic & first).alias("t0"), tell(~is_toxic & first).alias("o0"), tell(is_toxic).alias("t1"),
                                                  tell(~is_toxic).alias("o1")), "words")
    sizes = rows.agg(tell(is_toxic & first), tell(~is_toxic & first), tell(is_toxic), tell(~is_toxic)).first()
    sizes = [max(n or 0, 1) for n in sizes]
    model = Model(*_dictionaries(counts, "t0", "o0", *sizes[:2]), ())
    shared = spark.sparkContext.broadcast(model)

    def measure(r):
        return {"x": [features(t, _distances(shared.value)) for t in r["text"]], "toxic": r["toxic"]}

    seen = map_rows(rows.where("part >= 3").select("text", "toxic"), measure, "x array<double>, toxic int").collect()  # bounded by sample_rows
    if not seen:
        return Model(model.toxic, model.ordinary, (0.0,) * (len(STEPS) + 2))
    weights = fit_logistic(np.array([r.x for r in seen]), np.array([float(r.toxic > 0) for r in seen]))
    return Model(*_dictionaries(counts, "t1", "o1", *sizes[2:]), tuple(map(float, weights)))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, over its whole text.

    Null and empty texts have no window: their score is that of no evidence. A null id counts as held out. Repeated rows stay; an empty
    table gives an empty result; columns beside id and text are ignored whatever their names. One map without a shuffle; a very long
    text is one list of words in one worker.
    """
    shared = session(docs.sparkSession).sparkContext.broadcast(model)

    def score(r):
        distances, weights = _distances(shared.value), np.array(shared.value.weights)
        z = [float(np.clip(np.dot(features(t, distances), weights), -30, 30)) for t in r["text"]]
        p = [float(1 / (1 + np.exp(-v))) for v in z]
        return {"doc_id": r["doc_id"], "held_out": [fold(i) == HELD_OUT for i in r["doc_id"]], "score": p, "predicted": [int(v >= 0.5) for v in p]}

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, score, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows and score all rows."""
    return score_texts(docs, train(docs, labels, **options))
