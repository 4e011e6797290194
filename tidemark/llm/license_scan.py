"""License scans by a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A file's words are streamed through it; after each word it knows the longest
run ending there that any template holds (the matching statistic) and, through its state, where in which templates. Runs that grow no
further and are long enough, or that reach from end to end of a template, are chained per template in the order of both texts; a chain
that covers enough of its template is a span. Base phrases are templates too: a phrase ends at a word when its state lies on the suffix
links of the current one.
"""

import functools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows
from tidemark.llm.license_texts import PHRASES, TEXTS

#: Words of a run to count as long; words that two chained runs may lie apart in the file, and in the template; share of a template to be covered;
#: covered words at which a span is half certain.
LONG, APART, SKIPPED, COVERED, HALF = 5, 24, 40, 0.5, 4
#: By bytes of UTF-8 with A-Z lowered: digits, letters and all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """Suffix automaton of several sequences of word numbers, with the places where each state's longest run ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, list[int]]] = [{}]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = self._extend(last, w, ends)
                ends[last].setdefault(t, []).append(i + 1)
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):  # longer runs end where their suffixes end
            if self.link[v] > 0:
                into = ends[self.link[v]]
                for t, at in ends[v].items():
                    into[t] = sorted({*into.get(t, ()), *at})
        self.ends = ends

    def _extend(self, last: int, w: int, ends: list) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, w, known, ends)
        made = self._state(self.length[last] + 1, {}, -1, ends)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p == -1:
            self.link[made] = 0
        else:
            q = self.next[p][w]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q, ends)
        return made

    def _clone(self, p: int, w: int, q: int, ends: list) -> int:
        made = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = made
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = made
            p = self.link[p]
        return made

    def _state(self, length: int, then: dict[int, int], link: int, ends: list) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        ends.append({})
        return len(self.length) - 1


@dataclass(frozen=True)
class Templates:
    automaton: Automaton
    numbers: dict[bytes, int]
    labels: tuple[str, ...]
    sizes: tuple[int, ...]
    whole: tuple[tuple[tuple[int, int], ...], ...]  # of each state: (template, words) of the whole templates that end there
    n_phrases: int


@functools.lru_cache(4)
def templates(texts: tuple[tuple[str, str], ...] = TEXTS, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Templates:
    """The automaton over ``phrases`` and ``texts``; the first templates are the phrases."""
    numbers: dict[bytes, int] = {}
    every = [(label, words_of(text)) for label, text in (*phrases, *texts)]
    sequences = [[numbers.setdefault(w, len(numbers)) for w in words] for _, words in every]
    made = Automaton(sequences)
    ending: list[tuple] = [()] * len(made.length)
    for k, sequence in enumerate(sequences):
        v = 0
        for w in sequence:
            v = made.next[v][w]
        ending[v] = (*ending[v], (k, len(sequence)))
    for v in sorted(range(1, len(made.length)), key=lambda v: made.length[v]):
        ending[v] = (*ending[v], *ending[made.link[v]])
    return Templates(made, numbers, tuple(label for label, _ in every), tuple(len(s) for s in sequences), tuple(ending), len(phrases))


def matches(words: list[bytes], of: Templates, least: int = LONG) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(places, whole, runs): (phrase, first word) of every phrase, (template, first word) of every other whole template, and (end, length,
    state) of the runs of ``least`` words or more that grow no further.
    """
    step, link, length, number = of.automaton.next, of.automaton.link, of.automaton.length, of.numbers.get
    places, whole, runs, v, n = [], [], [], 0, 0
    for i, word in enumerate(words):
        w = number(word)
        if n and (w is None or w not in step[v]):
            if n >= least:
                runs.append((i, n, v))
            if w is None:
                v = n = 0
                continue
            while v and w not in step[v]:
                v = link[v]
                n = length[v]
        elif w is None:
            continue
        v = step[v].get(w, 0)
        n = n + 1 if v else 0
        for t, size in of.whole[v]:
            if size <= n:
                (places if t < of.n_phrases else whole).append((t, i + 1 - size))
    if n >= least:
        runs.append((len(words), n, v))
    return places, whole, runs


@dataclass
class _Chain:
    start: int
    end: int
    at: int  # words of the template up to the end of the last run
    covered: int


def spans(runs: list[tuple[int, int, int]], of: Templates, apart: int = APART, skipped: int = SKIPPED, enough: float = COVERED) -> list[tuple[int, int, int, int]]:
    """(template, first word, end, covered words) of the chains that cover enough of their template, by start and template.

    Runs are taken in the order of the file, one open chain for each template, so the work grows with their number. A run continues a
    chain where it stands further on in the template, not too far in either text; otherwise the chain ends and another begins.
    """
    out, chains = [], {}

    def close(t: int) -> None:
        c = chains.pop(t)
        if c.covered >= enough * of.sizes[t]:
            out.append((t, c.start, c.end, c.covered))

    for end, n, v in runs:
        for t, ends in of.automaton.ends[v].items():
            if t < of.n_phrases:
                continue
            c = chains.get(t)
            if c is not None:
                # runs may overlap in the file by what they share; only new words count
                fresh = min(n, end - c.end)
                on = [at for at in ends if c.at < at <= c.at + skipped + n and at - c.at >= fresh]
                if fresh > 0 and end - n - c.end <= apart and on:
                    c.end, c.at, c.covered = end, on[0], c.covered + fresh
                    continue
                close(t)
            chains[t] = _Chain(end - n, end, ends[0], n)
    for t in list(chains):
        close(t)
    return sorted(out, key=lambda s: (s[1], s[0]))


def scan_words(words: list[bytes], of: Templates, half: int = HALF, **limits) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]], float]:
    """(places, spans, score). The score is that of the best evidence: its share of the template, less for few words."""
    places, whole, runs = matches(words, of)
    found = sorted({*spans(runs, of, **limits), *((t, at, at + of.sizes[t], of.sizes[t]) for t, at in whole)}, key=lambda s: (s[1], s[0], s[2]))
    evidence = {covered / of.sizes[t] * covered / (covered + half) for t, _, _, covered in found} | {of.sizes[p] / (of.sizes[p] + half) for p in {p for p, _ in places}}
    return places, found, max(evidence, default=0.0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts=TEXTS, phrases=PHRASES, **limits) -> DataFrame:
    """(doc_id, n_words, places, spans, score) for every row, over its whole text.

    ``places``: (label, word) of every base phrase; ``spans``: (label, first_word, end_word, covered, template_words) of the chains, words from
    0, ends exclusive. A null text counts as empty: no words, no places, score 0. Null ids and repeated rows stay; an empty table gives an
    empty result; other columns are ignored whatever their names. One map without a shuffle; the work grows with the words of a text.
    """
    place, span = "array<struct<label: string, word: bigint>>", "array<struct<label: string, first_word: bigint, end_word: bigint, covered: bigint, template_words: bigint>>"

    def scan(rows):
        of = templates(texts, phrases)
        out = {"doc_id": rows["doc_id"], "n_words": [], "places": [], "spans": [], "score": []}
        for text in rows["text"]:
            words = words_of(text)
            places, found, score = scan_words(words, of, **limits)
            out["n_words"].append(len(words))
            out["places"].append([{"label": of.labels[p], "word": at} for p, at in places])
            out["spans"].append([{"label": of.labels[t], "first_word": a, "end_word": b, "covered": c, "template_words": of.sizes[t]} for t, a, b, c in found])
            out["score"].append(score)
        return out

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, scan, f"doc_id bigint, n_words bigint, places {place}, spans {span}, score double")
