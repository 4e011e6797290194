"""Secret scans: three base patterns, and spans that zstandard finds novel where the context is sensitive.

A candidate's marginal size is what it adds to its surroundings when both are compressed behind a dictionary of code words, identifiers
and prose. Names, paths and words shrink to a few references; keys do not. A candidate is reported when its context is sensitive and
it stays incompressible. The context is sensitive where a telling word stands in the two lines before the candidate's own or in its line,
where the candidate goes on a reported one (the lines of a private key), or where its own name tells. Strings of letters alone need the
telling word close by; what is written in words is never one, so a passphrase of words is not found.
"""

import bisect
import functools
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_VALUE = r"A-Za-z0-9+/_=\-"
_SENSITIVE = re.compile(r"(?:passw|passphrase|pwd|secret|token|credential|private|bearer|authori[sz]ation|api.?key|access.?key|signing|signature|session|cookie|license.?key)", re.I)
_SENSITIVE_WORDS = ("pass", "pwd", "secret", "token", "credential", "private", "bearer", "authori", "key", "sign", "session", "cookie")

#: Words that code, configuration and identifiers share; more may be given for a corpus.
IDENTIFIERS = (
    "abstract and array assert async await boolean break case catch class const continue def default delete do double elif else enum "
    "except export extends false final finally float for from function global if implements import in int interface is lambda let long "
    "namespace new None not null object or package pass private protected public raise return self static string struct super switch "
    "this throw throws true True try typeof union unsigned using var virtual void volatile while with yield "
    "application/json authorization bearer callback client_id client_secret config connection content-type controller cookie "
    "credentials database endpoint environment example.com exception factory getElementById handler header host hostname http https "
    "identifier index initialize instance iterator length listener localhost logger manager message method module name number "
    "onclick option output parameter parent password path placeholder port private_key process production property provider "
    "public_key query request response result schema secret_key self.assertEqual sequence server service session session_id "
    "settings signature source staging status stream string_value subprocess target template test_token timeout timestamp "
    "token_type tokenizer transaction update upload url username utf-8 uuid validate value variable version www.example.org "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 ffffffffffffffff deadbeef xxxxxxxxxxxxxxxx"
)
#: Frequent words of prose in the languages of the corpus.
PROSE = (
    "the and that with this from have which would there their been were into only other about than them could because these "
    "der die und nicht sich auch eine einen werden oder nach wird sind wenn aber noch durch zwischen "
    "les des une dans pour que qui est avec sur pas par plus sont mais comme leur tout aussi "
    "los las del una para con por como pero sus este entre cuando sobre tambien hasta hay donde"
)

#: Characters around a candidate that it is compressed with; characters, and lines, before it in which a telling word counts; shortest candidate;
#: least marginal bytes for each of its bytes. The last is calibrated on planted secrets of six kinds and on clean code and prose (tests).
CONTEXT, BEFORE, LINES, LEAST, NOVELTY = 512, 240, 2, 16, 0.62
#: A telling word directly before, but for separators and at most two short words: ``secret key is``, ``"token": "``.
_CLOSE = re.compile(rf"(?:{_SENSITIVE.pattern[3:-1]})\w*[\"'`]?(?:\W{{1,4}}\w{{1,8}}){{0,2}}\W{{0,5}}$", re.I)


@functools.lru_cache(4)
def _compressor(words: str, level: int):
    import zstandard

    primed = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, surroundings: str, words: str = f"{PROSE} {IDENTIFIERS}", level: int = 9) -> float:
    """Bytes that the candidate adds to its compressed surroundings, for each of its own bytes."""
    squeeze = _compressor(words, level).compress
    return (len(squeeze((surroundings + candidate).encode())) - len(squeeze(surroundings.encode()))) / len(candidate.encode())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within each kind, in the order of the text."""
    found = []
    if ("=" in text or ":" in text) and any(w in (low := text.lower()) for w in _ASSIGN_WORDS):
        found += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


@functools.lru_cache(4)
def _candidates(least: int):
    return re.compile(rf"(?<![{_VALUE}])[{_VALUE}]{{{least},}}")


_RUN = re.compile(r"[A-Z]?[a-z]{3,}")


def written(value: str) -> bool:
    """Whether most of a string is words: runs of small letters (a capital before them) with vowels enough and no endless consonants.

    Names in camel or snake case, paths and long words are written; drawn strings are not.
    """
    covered = 0
    for m in _RUN.finditer(value):
        run = m[0].lower()
        vowels = sum(run.count(v) for v in "aeiouy")
        if 5 * vowels >= len(run) and not re.search("[bcdfghjklmnpqrstvwxz]{8}", run):
            covered += len(run)
    return 2 * covered > len(value)


def novel_spans(text: str, taken: list[tuple[int, int, str]], words: str = f"{PROSE} {IDENTIFIERS}", context: int = CONTEXT, before: int = BEFORE,
                lines: int = LINES, least: int = LEAST, threshold: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Incompressible strings in a sensitive context, besides those that ``taken`` spans touch already."""
    low, found = text.lower(), []
    if not any(w in low for w in _SENSITIVE_WORDS):
        return found
    held = sorted((a, b) for a, b, _ in taken)
    starts, reach = [a for a, _ in held], []
    for _, b in held:  # the furthest end so far: spans of different kinds may overlap
        reach.append(max(b, reach[-1]) if reach else b)
    last = None
    for m in _candidates(least).finditer(text):
        start, end, value = m.start(), m.end(), m[0]
        at = bisect.bisect_left(starts, end)
        if at and reach[at - 1] > start:
            continue
        name, _, own = value.rpartition("=") if "=" in value.rstrip("=") else ("", "", value)  # NAME=value is one run of these characters
        digits, letters = any(c.isdigit() for c in own), any(c.isalpha() for c in own)
        if not letters or written(own):
            continue
        line = start
        for _ in range(lines + 1):
            line = text.rfind("\n", 0, max(line, 0))
            if line < 0:
                break
        far = max(line + 1, start - before)
        goes_on = last is not None and start - last <= 2 and text[last:start].isspace()
        if digits:
            telling = goes_on or _SENSITIVE.search(text, far, start) or name and _SENSITIVE.search(name)
        else:
            telling = (goes_on or _CLOSE.search(text[far:start]) or name and _SENSITIVE.search(name))
        if telling and novelty(value, text[end:end + context] + text[max(0, start - context):start], words) >= threshold:
            found.append((start, end, KINDS[3]))
            last = end
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: str = f"{PROSE} {IDENTIFIERS}", **limits) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) for every row, over its whole text.

    Positions count code points, ends are exclusive. Null text counts as empty: no spans, the hash of an empty string. Null ids and
    repeated rows stay as they are; an empty table gives an empty result; columns beside id and text are ignored whatever their names.
    One map over the rows: nothing is shuffled, and a very long text only widens the scan.
    """

    def scan(rows):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
        for text in rows["text"]:
            base = base_spans(text or "")
            more = novel_spans(text, base, words, **limits) if text else []
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
            out["n_novel"].append(len(more))
        return {"doc_id": rows["doc_id"]} | out

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel int")
