"""Quality rules by tokeniser fertility.

Public vocabularies measure each text: characters per token, the share of tokens that are broken characters (byte fallback), and the
entropy of the tokens against what so many tokens allow. A language (or, where it has no band of its own, a script) has a band for each
vocabulary; a text outside any of them is rejected. Beside them stand plain counts of words, symbols, repeated lines and repeated windows.
"""

import functools
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import SPACE, map_rows, session

VOCABULARIES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5

#: Lowest and highest characters per token, highest byte-fallback share, lowest share of the possible entropy. Round figures set by hand, wide
#: enough that a text must be clearly odd to be rejected; ``fit_bands`` measures those of a corpus, to be given as ``bands``.
_SCRIPT_BANDS = {
    "latin": (1.4, 9.0, 0.30, 0.50), "cyrillic": (0.9, 8.0, 0.60, 0.45), "greek": (0.7, 8.0, 0.70, 0.45), "arabic": (0.7, 8.0, 0.70, 0.45),
    "cjk": (0.3, 4.0, 0.98, 0.40), "other": (0.2, 9.0, 1.0, 0.35),
}
BANDS = {
    VOCABULARIES[0]: _SCRIPT_BANDS | {"en": (2.2, 8.0, 0.10, 0.60), "de": (2.2, 8.0, 0.15, 0.60), "fr": (2.0, 8.0, 0.15, 0.60), "es": (2.0, 8.0, 0.15, 0.60)},
    # most of its tokens are English: other scripts fall into bytes
    VOCABULARIES[1]: _SCRIPT_BANDS | {"en": (2.2, 8.0, 0.10, 0.60), "de": (1.9, 8.0, 0.20, 0.60), "fr": (1.8, 8.0, 0.30, 0.60), "es": (1.7, 8.0, 0.30, 0.60),
                                      "cyrillic": (0.4, 8.0, 0.98, 0.40), "greek": (0.3, 8.0, 0.98, 0.40), "arabic": (0.3, 8.0, 0.98, 0.40), "cjk": (0.2, 4.0, 1.0, 0.35)},
}
#: Upper ends of code point ranges and the script that each range counts for.
_SCRIPTS = ((0x250, "latin"), (0x370, "other"), (0x400, "greek"), (0x530, "cyrillic"), (0x600, "other"), (0x780, "arabic"), (0x2E80, "other"), (0xA000, "cjk"),
            (0xAC00, "other"), (0xD7B0, "cjk"), (0x110000, "other"))
#: Tokens that a text's own measure is weighed against: short texts are drawn to the middle of their band.
PRIOR_TOKENS, ENTROPY_TOKENS = 64, 1024


@functools.lru_cache(4)
def _broken(vocabulary: str) -> np.ndarray:
    """1 for each token whose bytes are no whole characters."""
    encoder = bpe.ranks_encoder(vocabulary)
    out = np.zeros(encoder.n_vocab + 1, np.uint8)
    for token, rank in encoder._mergeable_ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            out[rank] = 1
    return out


def script_of(text: str) -> str:
    """The script of most letters; "other" for a text without any."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    counts: Counter = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            counts[next(name for end, name in _SCRIPTS if ord(char) < end)] += n
    return max(counts, key=lambda k: (counts[k], k)) if counts else "other"


def fertility(text: str, vocabulary: str = VOCABULARIES[0]) -> tuple[int, float, float, float]:
    """(tokens, characters per token, byte-fallback share, share of the possible entropy)."""
    ids = bpe.encode_ids(text, vocabulary, "byte_bpe_50k.json")
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids) if n > 8192 else np.unique(ids, return_counts=True)[1]
    p = counts[counts > 0] / n
    possible = log2(min(n, ENTROPY_TOKENS)) or 1.0
    return n, len(text) / n, float(_broken(vocabulary)[ids].mean()), float(-(p * np.log2(p)).sum() / possible)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode().split()  # of bytes: exactly the six ASCII spaces
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), len(text) - sum(map(text.count, SPACE)), symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    return int((np.convolve(starts, np.ones(width, int)) > 0).sum())


def verdict(measures: tuple[int, float, float, float], band: tuple[float, float, float, float]) -> bool:
    """Whether a text lies in its band, its own measure weighed against the band's middle by its tokens."""
    n, per_token, broken, entropy = measures
    if not n:
        return True
    low, high, most_broken, least_entropy = band
    weight = n / (n + PRIOR_TOKENS)
    middle = (low * high) ** 0.5
    return (low <= weight * per_token + (1 - weight) * middle <= high and weight * broken <= most_broken
            and weight * entropy + (1 - weight) * (1 + least_entropy) / 2 >= least_entropy)


def judge(text: str | None, lang: str | None, bands: dict = BANDS) -> dict:
    """All measures of one text, ``base_failed`` and ``kept``; ``bands`` names the vocabularies. Measures of the second vocabulary end in _2."""
    text = text or ""
    n_words, word_chars, symbols, dup_lines, repeated = base_counts(text)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n_words
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated, "base_failed": failed,
           "kept": not failed}
    script = None
    for k, (vocabulary, of) in enumerate(bands.items(), 1):
        band = of.get(lang) if lang is not None else None
        if band is None:
            script = script or script_of(text)
            band = of.get(script, of["other"])
        measures = fertility(text, vocabulary)
        out["kept"] &= verdict(measures, band)
        out |= dict(zip((c + (f"_{k}" if k > 1 else "") for c in MEASURES), measures, strict=True))
    return out


MEASURES = ("n_tokens", "chars_per_token", "byte_share", "entropy_share")
_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict = BANDS) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept`` and the measures for every row, over its whole text.

    Null or empty text: no words, so ``base_failed``. A null or unknown language is judged by the band of the script of most letters.
    Null ids and repeated rows stay; an empty table gives an empty result; other columns are ignored whatever their names. One map
    over the rows without a shuffle; every verdict depends on its own row alone.
    """
    lang = F.col(lang_col) if lang_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang"))
    ends = ["" if k == 1 else f"_{k}" for k in range(1, len(bands) + 1)]
    schema = ", ".join(["doc_id bigint", _COUNTS, *(f"{c}{e} {'bigint' if c == 'n_tokens' else 'double'}" for e in ends for c in MEASURES)])

    def run(r):
        judged = [judge(t, g, bands) for t, g in zip(r["text"], r["lang"], strict=True)]
        return {"doc_id": r["doc_id"]} | {k: [j[k] for j in judged] for k in (judged[0] if judged else ())}

    return map_rows(rows, run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bands: dict = BANDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, whatever their names.

    A null, empty or very short text goes (too few words); a null or unknown language is judged by its script; null ids and repeated rows
    are judged like any other. A very long text is one list of tokens in one worker process. An empty table gives an empty one.
    """
    session(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, langs = batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()
            yield batch.filter(pa.array([judge(t, g, bands)["kept"] for t, g in zip(texts, langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_bands(measured: DataFrame, by: str = "lang", width: float = 8.0, end: str = "") -> DataFrame:
    """(by, low, high, most_broken, least_entropy): medians, widened by ``width`` median deviations, from all rows of ``measured``.

    ``measured`` has the columns of ``quality_rules`` and ``by``; ``end`` picks the vocabulary ("_2" for the second). Medians come from counts of values in steps of 0.01, which combine
    before the shuffle, so a language that holds most rows is no single task.
    """
    out = None
    for name in ("chars_per_token", "byte_share", "entropy_share"):
        counts = measured.where(F.col("n_tokens" + end) > 0).groupBy(by, F.round(F.col(name + end), 2).alias("v")).agg(F.count("*").alias("n"))
        middle = counts.groupBy(by).agg(F.expr("percentile(v, 0.5, n)").alias("m"))
        off = counts.join(middle, by).groupBy(by, "m").agg(F.expr("percentile(abs(v - m), 0.5, n)").alias("d"))
        step = F.greatest(F.col("d"), F.lit(0.01)) * width
        wanted = {"chars_per_token": [(F.col("m") - step).alias("low"), (F.col("m") + step).alias("high")],
                  "byte_share": [(F.col("m") + step).alias("most_broken")], "entropy_share": [(F.col("m") - step).alias("least_entropy")]}[name]
        part = off.select(by, *wanted)
        out = part if out is None else out.join(part, by)
    return out
