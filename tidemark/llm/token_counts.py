"""Token counts by a two-tier lookup on the map side.

Tier one is broadcast: the most frequent pre-tokens of a sample of ``SAMPLE_ROWS`` of the documents themselves, with their lengths in
tokens. It holds at most ``FREQUENT`` strings of at most ``LONGEST`` bytes (some megabytes) at any input. Tier two is a cache in each
worker process, bounded by ``CACHE_ENTRIES``: a pre-token met for the first time is encoded by the tokenizer and remembered. The sample
only decides what is looked up quickly; every count is exact. No pre-token of the documents is shuffled: beyond the sample, the operator
is one map over the rows.
"""

import functools
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import map_rows

VOCABULARY, LIMIT, CACHE_ENTRIES = "byte_bpe_50k.json", 1024, 400_000
#: Bounds of the first tier: documents it is made from, pre-tokens it holds, bytes of a pre-token.
SAMPLE_ROWS, FREQUENT, LONGEST = 10_000, 120_000, 64

#: Letters and numbers of the first Unicode blocks; texts beyond these and the listed signs go through the full pattern.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[^\x09-\x0d\x20-\x7e\xa1-ʯ‐-‧‰-⁞]")
_SHORT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


@functools.lru_cache(1)
def _full():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class _Lengths(dict):
    """Pre-token to tokens: starts as the broadcast tier, grows by misses, falls back to the broadcast tier when full."""

    def __init__(self, frequent: dict[str, int], vocabulary: str, limit: int):
        super().__init__(frequent)
        self.frequent, self.vocabulary, self.limit = frequent, vocabulary, limit + len(frequent)

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        n = self[token] = len(bpe.json_encoder(self.vocabulary).encode(token, add_special_tokens=False))
        return n


_caches: dict[tuple, _Lengths] = {}


def pre_tokens(text: str) -> list[str]:
    return (_full() if _PLAIN.search(text) else _SHORT).findall(text)


def frequent_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, rows: int = SAMPLE_ROWS, entries: int = FREQUENT) -> bytes:
    """The broadcast tier, packed: each line a length byte and a pre-token. Ties of frequency go by the pre-token itself."""

    def count(r):
        seen: dict[str, int] = {}
        for text in r["text"]:
            for token in pre_tokens(text or ""):
                seen[token] = seen.get(token, 0) + 1
        kept = [(t, n) for t, n in seen.items() if "\n" not in t and len(t.encode()) <= LONGEST]
        return {"token": [t for t, _ in kept], "n": [n for _, n in kept]}

    sample = docs.select(F.col(text_col).alias("text")).limit(rows)
    counts = map_rows(sample, count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    best = [r.token for r in counts.orderBy(F.desc("n"), "token").limit(entries).collect()]  # a fixed number of short strings
    made = bpe.json_encoder(vocabulary).encode_batch(best, add_special_tokens=False)
    return b"\n".join(bytes([len(e.ids)]) + t.encode() for t, e in zip(best, made, strict=True) if len(e.ids) != 10)


def _lengths(packed: bytes, vocabulary: str, limit: int) -> _Lengths:
    key = (vocabulary, limit, zlib.crc32(packed))
    if key not in _caches:
        _caches.clear()
        _caches[key] = _Lengths({line[1:].decode(): line[0] for line in packed.split(b"\n") if line}, vocabulary, limit)
    return _caches[key]


def count_text(text: str | None, lengths: _Lengths) -> int:
    if not text:
        return 0
    if "<|" in text and any(t.content in text for t in bpe.json_encoder(lengths.vocabulary).get_added_tokens_decoder().values()):
        return len(bpe.json_encoder(lengths.vocabulary).encode(text, add_special_tokens=False))
    return sum(map(lengths.__getitem__, pre_tokens(text)))


def count_tokens(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = LIMIT, cache_entries: int = CACHE_ENTRIES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; whole texts, no special tokens added, special strings as the library has them.

    Null or empty text: 0 bytes, 0 tokens, not over the limit. A null id stays null. Repeated rows give repeated rows, an empty table
    gives none; other columns are ignored whatever their names. A very long text is one string in one worker, never cut.
    ``vocabulary`` must use the public byte-level pre-token pattern.
    """
    packed = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, vocabulary, sample_rows))

    def count(rows):
        lengths = _lengths(packed.value, vocabulary, cache_entries)
        tokens = [count_text(t, lengths) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return map_rows(rows, count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
