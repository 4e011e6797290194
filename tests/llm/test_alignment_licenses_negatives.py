"""Token alignment, licence scan and hard negatives against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, hard_negatives, license_scan
from tidemark.llm.license_texts import TEXTS

rng = random.Random(11)
WORDS = "the of and ouement réeux naïve 12 3456 ### straße Σίσυφος 中文 it's  <s> <|endoftext|> ▁x ́a \x00".split(" ")


def _text(n):
    return "".join(rng.choice(WORDS) + rng.choice(["", " ", "  ", "\n", "\t"]) for _ in range(n))


DOCS = [(1, None), (2, ""), (3, " "), (4, "A"), (4, "A"), (None, "x y"), (None, None), (5, "\n\n  a"), (6, "<|endoftext|><s>▁"), (7, "▁▁ a"), (8, "é é"),
        (9, _text(9_000)), (10, "ab" * 20_000), *((20 + i, _text(rng.randint(1, 40)).replace("▁", rng.choice(["", "_"]))) for i in range(40))]
CLASH = "doc_id bigint, text string, row bigint, pairs string, times int, n_a int, pair int, n int, best int, places int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "p", 2, 3, 4, 5, 6, 7, "s") for i, t in DOCS], CLASH).repartition(3)


def _brute_alignment(texts):
    """(n_a, n_b, groups, links) of each text, by its definition and the JSON vocabulary."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    out = []
    for text in texts:
        none = (0, 0, "", [])
        if not text:
            out.append(none)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        pieces = [b.id_to_piece(i) for i in ib]
        tb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        want = (" " + text).encode()
        if b"".join(ta) != want or b"".join(tb) != want:
            out.append(none)
            continue
        ends = [{}, {}]
        for side, tokens in enumerate((ta, tb)):
            at = 0
            for k, t in enumerate(tokens):
                at += len(t)
                ends[side][at] = k
        groups, links, pa, pb = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            ka, kb = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ia[pa:ka])) + "|" + ",".join(map(str, ib[pb:kb])))
            links.append((ia[ka - 1], ib[kb - 1]))
            pa, pb = ka, kb
        out.append((len(ia), len(ib), ";".join(groups), links))
    return out


@pytest.mark.parametrize("frequent", [0, 7, alignment.FREQUENT])
def test_alignment_against_its_definition(spark, docs, frequent):
    made = _brute_alignment([t for _, t in DOCS])
    counts = Counter(p for m in made for p in m[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter((i, na, nb, len(ls), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for (i, _), (na, nb, g, ls) in zip(DOCS, made, strict=True))
    assert sum(n == 0 for n, *_ in made) > 5 < sum(n > 0 for n, *_ in made)
    assert Counter(tuple(r) for r in alignment.align(spark, docs, frequent=frequent).collect()) == want
    assert alignment.align(spark, docs.limit(0)).count() == 0


def test_alignments_give_the_groups(docs):
    made = Counter((i, *m[:3]) for (i, _), m in zip(DOCS, _brute_alignment([t for _, t in DOCS]), strict=True))
    got = Counter()
    for r in alignment.alignments(docs).collect():
        pa = pb = 0
        groups = []
        for ca, cb in zip(r.a_cuts, r.b_cuts, strict=True):
            groups.append(",".join(map(str, r.a_ids[pa:ca + 1])) + "|" + ",".join(map(str, r.b_ids[pb:cb + 1])))
            pa, pb = ca + 1, cb + 1
        got[(r.doc_id, len(r.a_ids), len(r.b_ids), ";".join(groups))] += 1
    assert got == made


def test_lanes_do_not_change_the_merge():
    for _ in range(50):
        stops, ea, eb, at, n = [], [], [], 0, 0
        for _ in range(rng.randint(0, 5)):
            size = rng.randint(1, 60)
            a, b = ({size, *rng.sample(range(1, size + 1), rng.randint(0, size - 1))} for _ in range(2))
            ea += [at + x for x in sorted(a)]
            eb += [at + x for x in sorted(b)]
            at, n = at + size, n + len(a)
            stops.append(n)
        want = sorted(set(ea) & set(eb))
        for lane in (1, 3, 128):
            ca, cb = alignment.lockstep(np.array(ea, np.int64), np.array(eb, np.int64), np.array(stops, np.int64), lane)
            assert [ea[i] for i in ca] == want == [eb[i] for i in cb]


def test_matching_statistics_are_the_longest_runs():
    texts = (("x", "a b a b c"), ("y", "b c a b"), ("z", "a a b c d"))
    of = license_scan.templates(texts, (("p", "a b"),))
    every = {tuple(w[i:j]) for w in ([b"a", b"b"], *(t.encode().split() for _, t in texts)) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rng.randint(0, 30))]
        longest = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n:i + 1]) in every), default=0) for i in range(len(words))]
        want = [(i + 1, n) for i, n in enumerate(longest) if n >= 2 and (i + 1 == len(words) or longest[i + 1] <= n)]
        places, whole, runs = license_scan.matches(words, of, least=2)
        assert [(e, n) for e, n, _ in runs] == want
        assert places == [(0, i) for i in range(len(words) - 1) if words[i:i + 2] == [b"a", b"b"]]
        assert sorted(whole) == sorted((k + 1, i) for k, (_, t) in enumerate(texts) for i in range(len(words)) if words[i:i + len(t.split())] == t.encode().split())
        for e, n, v in runs:
            for t, ends in of.automaton.ends[v].items():
                source = (("p", "a b"), *texts)[t][1].encode().split()
                assert ends == [j for j in range(n, len(source) + 1) if source[j - n:j] == words[e - n:e]]


def test_license_scan(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    mit, words = TEXTS[0][1], "ouement réeux of the software and is not for a to in naïve".split()
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    gone = mit.split()
    del gone[50:53]
    rows = [(1, None), (2, ""), (2, ""), (None, "MIT  License"), (3, "the mit LICENSE, mit license. Apache-License"), (4, noise(40) + " " + mit + " " + noise(40)),
            (5, noise(10) + " ".join(gone)), (6, noise(5000)), (7, "It is released under the MIT License; ÉmIT license"), (8, (mit + "\n") * 200), (9, "GENERAL public\nlicense"),
            (10, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.")]
    table = spark.createDataFrame([(i, t, 1, "p", 2, 3, 4, 5, 6, 7, "s") for i, t in rows], CLASH)
    got = {(r.doc_id, i): r for i, r in enumerate(license_scan.scan_licenses(table).collect())}
    of = {k: [(s.label, s.covered) for s in r.spans] for (k, _), r in got.items()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert of[1] == of[2] == of[6] == of[9] == [] and ("mit", 163) in of[4] and len(of[8]) == 200
    assert [label for label, _ in of[5]] == ["mit"] and of[5][0][1] >= 155 and ("mit", 5) in of[7] and ("bsd", 20) in of[10]
    by = {k: r for (k, _), r in got.items()}
    assert [(p.label, p.word) for p in by[3].places] == [("mit", 1), ("mit", 3), ("apache", 5)] and by[3].n_words == 7
    assert [p.word for p in by[7].places] == [5] and [p.label for p in by[9].places] == ["gpl"] and by[1].score == 0 and by[4].score > 0.9 > by[9].score
    assert license_scan.scan_licenses(table.limit(0)).count() == 0
    folder = str(tmp_path)
    table.select("doc_id", "text").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    row = {r.doc_id: r for r in QUERIES["op12_license_scan"](spark, folder).collect()}
    assert (row[3].n_base, row[3].first_word, row[3].last_word, row[3].base_labels, row[3].labels) == (3, 1, 5, "apache,mit", "apache,mit")
    assert (row[1].n_base, row[1].first_word, row[1].last_word, row[1].base_labels, row[1].labels) == (0, None, None, "", "")
    assert (row[4].base_labels, row[4].labels, row[10].labels) == ("", "mit", "bsd")


def test_planted_licences_are_found_and_clean_texts_left_alone():
    of = license_scan.templates()
    words = sorted({w for _, t in TEXTS for w in license_scan.words_of(t)}) + [b"ouement", b"thndon"] * 200
    for label, text in (t for t in TEXTS if len(t[1].split()) > 80):  # whole texts with one word in twelve changed
        broken = [w if rng.random() > 1 / 12 else b"zzz" for w in license_scan.words_of(text)]
        around = [rng.choice(words) for _ in range(100)]
        assert label in {of.labels[t] for t, *_ in license_scan.scan_words(around + broken + around, of)[1]}, label
    assert not any(license_scan.scan_words([rng.choice(words) for _ in range(2000)], of)[1] for _ in range(20))


def _brute_negatives(rows, scale=256.0):
    """Rows (id, label, vector) to the result, by definition."""
    ok = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, label, [math.floor(scale * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = Counter()
    for k, (i, label, q) in enumerate(ok):
        if i is None or i % 50:
            continue
        scored = [(dot(q, w), j, g) for m, (j, g, w) in enumerate(ok) if m != k]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            for rank, (n, o, _) in enumerate(sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=key)[:3], 1):
                out[(i, j, rank, o, p, n)] += 1
    return out


@pytest.mark.parametrize(("block", "anchors"), [(7, 2), (64, 3), (4096, 256)])
def test_hard_negatives_against_brute_force(spark, block, anchors):
    r = random.Random(3)
    rows = [(i, r.choice([0, 0, 0, 1, 2, -5]), [r.gauss(0.2, 1) for _ in range(20)]) for i in range(260)]
    rows += rows[:3] * 2 + [(400, None, [1.0] * 20), (450, 1, None), (500, 1, [None] + [1.0] * 19), (550, 1, [float("nan")] * 20), (600, 0, [float("inf")] + [0.0] * 19), (650, 1, []),
                            (700, 2, [0.0] * 20), (None, 0, [1.0] * 20), (None, 1, [2.0] * 20), (750, 0, [0.5] * 12), (800, 99, [1.0] * 20), (850, 99, [-1.0] * 20)]
    rows += [(1000 + i, 0, [0.25] * 20) for i in range(60)]  # one vector many times
    made = spark.createDataFrame([(i, g, v, 1, 2, 3, "x") for i, g, v in rows], "vec_id bigint, label int, embedding array<float>, row int, score int, id int, slot string").repartition(3)
    got = hard_negatives.hard_negatives(made, F.col("vec_id") % 50 == 0, block=block, anchors=anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _brute_negatives(rows)
    assert Counter(tuple(x) for x in got.collect()) == want and len(want) > 40
    assert hard_negatives.hard_negatives(made.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_leave_fewer_candidates():
    """The scan drops rows before their last dimension, and never one that counts."""
    r = np.random.default_rng(1)
    x = r.integers(-60, 60, (32, 500)).astype("<i4")
    x[:2] *= 20
    b = hard_negatives.Block(500, *(np.arange(500).astype("<i8").tobytes(),) * 2, np.zeros(500, "<i8").tobytes(), x.tobytes(), x.min(1).tobytes(), x.max(1).tobytes())
    read = []

    def watch(score, least, most):
        read.append(len(score))
        return score + most >= np.partition(score, len(score) - 5)[len(score) - 5] + least if len(score) > 5 else np.ones(len(score), bool)

    q = x[:, 7].astype(float)
    hard_negatives.scan(b, q, np.arange(500), watch)
    assert read[-1] < 100 < read[0] and set(hard_negatives.closest(b, q, 0, -1, 5)[0]) == set(np.argsort(-(q @ x), kind="stable")[:5])
