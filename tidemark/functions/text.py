"""Text normalisation, shingles and hashes."""

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import col

# Wire markers removed, in this order, during normalisation.
WIRE_MARKERS = (
    "(reuters)", "(bloomberg)", "(pti)", "(ani)", "(ians)", "- reuters", "click here",
    "read more", "also read", "advertisement", "subscribe to",
)


def collapse(c) -> Column:
    """Runs of white space (Unicode included) as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def normalise_text(c) -> Column:
    text = collapse(F.lower(col(c)))
    text = reduce(lambda acc, m: F.replace(acc, F.lit(m), F.lit(" ")), WIRE_MARKERS, text)
    return collapse(text)


def normalised(lowered: str) -> str:
    """What ``normalise_text`` makes of a text that is in lower case already; for texts that go through Python anyway, where it takes a fraction of the time."""
    out = " ".join(lowered.split())  # the same white space as in collapse
    if not any(marker in out for marker in WIRE_MARKERS):
        return out
    for marker in WIRE_MARKERS:
        out = out.replace(marker, " ")
    return " ".join(out.split())


def char_ngrams(normalised, n: int = 5) -> Column:
    """Distinct character n-grams of already normalised text; text shorter than ``n`` is its own only gram.

    The text enters as a one-element array of its characters, so it is evaluated and cut up once per row; taking
    substrings of the text itself would cost time quadratic in its length.
    """

    def grams(chars):
        joined = lambda i: F.concat(*[F.element_at(chars, (i + k).cast("int")) for k in range(n)])
        cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), joined))
        short = F.when(F.size(chars) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(chars, "")))
        return F.when(F.size(chars) < n, short).otherwise(cut)

    chars = F.filter(F.split(col(normalised), ""), lambda ch: ch != "")
    return F.element_at(F.transform(F.array(chars), grams), 1)


def jaccard(a, b) -> Column:
    """Overlap of two distinct-element arrays; 0 when either is empty."""
    a, b = col(a), col(b)
    share = lambda n: F.when(n == 0, 0.0).otherwise(n / (F.size(a) + F.size(b) - n))
    return F.element_at(F.transform(F.array(F.size(F.array_intersect(a, b))), share), 1)


def _gram_numbers(a: str, b: str, n: int) -> list[np.ndarray]:
    """The distinct n-grams of two texts as numbers that mean the same gram in both; a shorter text is its own only gram."""
    codes = [np.frombuffer(v.encode("utf-32-le", "surrogatepass"), "<u4") for v in (a, b)]
    _, code = np.unique(np.concatenate(codes), return_inverse=True)
    code = code.astype(np.int64) + 1
    base = int(code.max(initial=0)) + 1
    sides = [np.pad(c, (0, max(0, n - len(c)))) for c in np.split(code, [len(codes[0])])]  # 0 stands after the end of a short text
    grams, size = [c[:len(c) - n + 1] for c in sides], base
    for k in range(1, n):
        if size * base >= 1 << 62:  # too many different characters for one number: the grams so far are numbered anew
            _, place = np.unique(np.concatenate(grams), return_inverse=True)
            grams, size = np.split(place.astype(np.int64), [len(grams[0])]), len(place) + 1
        grams, size = [g * base + c[k:len(c) - n + 1 + k] for g, c in zip(grams, sides, strict=True)], size * base
    return [np.unique(g) for g in grams]


def pair_overlaps(pairs: DataFrame, a: str, b: str, n: int = 5, output: str = "overlap") -> DataFrame:
    """``pairs`` with the overlap of the n-gram sets of two columns of normalised text, null where either is null or empty.

    Texts travel, n-grams are made where two texts meet and leave no trace: as arrays of strings they are many times the text.
    """
    schema = pairs.drop(a, b).withColumn(output, F.lit(None).cast("double")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(a), batch.column(b), strict=True):
                x, y, share = x.as_py(), y.as_py(), None
                if x and y:
                    one, other = _gram_numbers(x, y, n)
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    share = both / (len(one) + len(other) - both)
                found.append(share)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(found, pa.float64())], names=schema.names)

    return pairs.mapInArrow(run, schema)


def words(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def token_overlap(a, b) -> Column:
    return jaccard(words(a), words(b))


def article_text(title="title", body="body") -> Column:
    return F.regexp_replace(F.concat(col(title), F.lit("\n\n"), col(body)), r"(?U)^\s+|\s+$", "")


def article_hash(title="title", body="body") -> Column:
    """Identity of an article: hash of its normalised text."""
    return F.sha2(normalise_text(article_text(title, body)), 256)


def content_hash(c) -> Column:
    """Hash used by the analysis table: white space and case folded, markers kept."""
    return F.sha2(F.lower(collapse(c)), 256)


def cache_key(hash_col, backend: str, model_id: str, prompt_version: str, schema_version: str = "1") -> Column:
    parts = [col(hash_col), *(F.lit(v) for v in (backend, model_id, prompt_version, schema_version))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
