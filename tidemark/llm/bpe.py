"""The public byte-level BPE vocabularies, loaded once in each worker process."""

import base64
import functools


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; ``name`` may also be a path of one's own."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def ranks_encoder(name: str, pattern: str | None = None):
    """The vocabulary as ranks, with the end-of-text string as the one special token after the ranks."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@functools.lru_cache(4)
def json_encoder(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def encode_ids(text: str, ranks: str, exact: str):
    """Ids of a whole text as little-endian unsigned 32-bit numbers.

    Merging by rank gives the ids of the JSON vocabulary several times faster (a test holds one against the other, every code point
    included); a text its pattern engine gives up on goes to the JSON vocabulary itself.
    """
    import numpy as np

    try:
        return ranks_encoder(ranks).encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)
    except (BaseException,) as error:  # the engine panics, which is no Exception
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return np.array(json_encoder(exact).encode(text, add_special_tokens=False).ids, "<u4")
