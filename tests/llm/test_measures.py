"""Measures and verdicts of the quality rules, and scores of the toxicity model, against plain re-computation."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import fertility, toxicity

TEXTS = ["", "a", "The same words again and again, the same words again and again, the same words.", "Ein längerer Satz über Größe und Straße, der weitergeht und endet.", "中文 字符 测试 文本 很多 字 一 二 三 四 五",
         "x" * 400, "привет мир это текст на русском языке для проверки правил", "asdkjh qwlekj zxcmnb qpwoei alskdj zmxncb qowiue alskdjf zxmcnvb qpwoeiru", "words " * 300, "\x00\x01 \x02 é ñ ü 🙂 🙂 🙂"]


@pytest.mark.parametrize("vocabulary", fertility.VOCABULARIES)
def test_fertility_measures_and_verdict(vocabulary):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(vocabulary), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    token = {v: k for k, v in ranks.items()}

    def broken(i):
        try:
            token[i].decode()
        except UnicodeDecodeError:
            return True
        return False

    for text in TEXTS:
        ids = plain.encode_ordinary(text)
        n = len(ids)
        got = fertility.fertility(text, vocabulary)
        if not n:
            assert got == (0, 0.0, 0.0, 0.0)
            continue
        p = [c / n for c in Counter(ids).values()]
        possible = math.log2(min(n, fertility.ENTROPY_TOKENS)) or 1.0
        want = (n, len(text) / n, sum(map(broken, ids)) / n, -sum(q * math.log2(q) for q in p) / possible)
        assert got == pytest.approx(want, rel=1e-12, abs=1e-12)
        for band in fertility.BANDS[vocabulary].values():
            low, high, most, least = band
            k = n / (n + fertility.PRIOR_TOKENS)
            inside = low <= k * want[1] + (1 - k) * math.sqrt(low * high) <= high and k * want[2] <= most and k * want[3] + (1 - k) * (1 + least) / 2 >= least
            assert fertility.verdict(got, band) == inside


def test_judge_rejects_outside_any_band():
    for text in TEXTS:
        got = fertility.judge(text, "en")
        words = text.encode().split()
        five = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        seen = Counter(five)
        covered = {i + j for i, w in enumerate(five) if seen[w] > 1 for j in range(5)}
        assert (got["n_words"], got["n_repeat_words"]) == (len(words), len(covered))
        assert got["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        bands = [fertility.verdict(fertility.fertility(text, v), fertility.BANDS[v]["en"]) for v in fertility.VOCABULARIES]
        assert got["kept"] == (not got["base_failed"] and all(bands))


def test_scores_are_the_logistic_of_compressed_lengths(spark):
    import zstandard

    bad, good = [b"idiot", b"moron", b"worthless"], [b"garden", b"window", b"thndon", b"the", b"of"]
    model = toxicity.Model(toxicity.dictionary(bad), toxicity.dictionary(good), (-2.0, 1.5, 0.5, 0.25, 0.1, -0.2))
    texts = [None, "", "the idiot of the garden", "window window garden", "moron, worthless idiot! " * 5, "Ouement réeux"]

    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    want = []
    for t in texts:
        words = [w for w in (x.strip(b".,;:!?#*$%&|<>\"'()[]{}") for x in (t or "").lower().encode().split()) if w]
        away = [size(toxicity._ANCHOR + toxicity._EDGE + w + toxicity._EDGE, model.ordinary) - size(toxicity._ANCHOR + toxicity._EDGE + w + toxicity._EDGE, model.toxic) for w in words]
        x = [1.0, *(math.log1p(sum(a >= s for a in away)) for s in toxicity.STEPS), math.log1p(len(away))]
        want.append(1 / (1 + math.exp(-float(np.dot(x, model.weights)))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.score_texts(df, model).collect()}
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-12)
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (toxicity.fold(i) == 0) for i, r in got.items())
