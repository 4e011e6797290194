"""The pipeline's stages against brute force, and that the rest stands without this package."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_training_operators import _components, _fingerprint
from tidemark.llm import fertility
from tidemark.llm.bpe import encode_ids


def test_stages_on_a_small_table(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, "A text, without id, of more than ten words, that is clean and reads on well.", "en", None, 5), (10 ** 6, None, None, "a", None),
                                   (10 ** 6 + 1, "", "en", "a", 0)], given.schema)
    one = given.orderBy("doc_id").limit(1)
    given.union(extra).union(one).union(one).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps, now = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        steps.append([tuple(r) for r in now.collect()])
        if i < 4:
            assert now.columns == docs.columns
    rules, exact, near, mixed, packed = steps
    assert Counter(rules) == Counter(tuple(r) for r in docs.collect() if fertility.judge(r.text, r.lang)["kept"])
    best = {}
    for r in rules:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    assert Counter(exact) == Counter(best.values())
    comp = _components({_fingerprint(r[1]) for r in exact}, 2)
    groups = defaultdict(list)
    for r in exact:
        groups[comp[_fingerprint(r[1])]].append(r)
    assert Counter(near) == Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    assert Counter(mixed) == Counter(near)
    tokens = Counter({r[0]: len(encode_ids(r[1] or "", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json")) + 1 for r in near})
    got = Counter()
    for r in packed:
        got[r[0]] += r[3]
    assert got == tokens
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_stages_with_clashing_names_long_texts_and_no_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = given.where("lang = 'en' and n_chars > 500").orderBy("doc_id").limit(40).agg(F.concat_ws(" ", F.sort_array(F.collect_list("text")))).first()[0]
    long = spark.createDataFrame([(10 ** 7, words * 30, "en", None, 0)], given.schema)
    docs = given.orderBy("doc_id").limit(60).union(long)
    docs.coalesce(2).write.parquet(f"{tmp_path}/plain/documents.parquet")
    named = docs.withColumns({c: F.lit(i) for i, c in enumerate(("__text_hash", "__mix", "__id", "__hash", "row", "fp", "key", "root", "units", "recipe", "length"))})
    named.coalesce(2).write.parquet(f"{tmp_path}/named/documents.parquet")
    plain, more, nothing = (spark.read.parquet(f"{tmp_path}/{x}/documents.parquet") for x in ("plain", "named", "named"))
    nothing = nothing.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for name, at in (("plain", plain), ("named", more), ("nothing", nothing)):
            stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{i}")
        plain, more, nothing = (spark.read.parquet(f"{tmp_path}/{x}{i}") for x in ("plain", "named", "nothing"))
        assert nothing.count() == 0
        if i < 4:
            assert more.columns == named.columns and more.select("__text_hash", "__mix", "__id", "__hash").distinct().count() == 1
            assert Counter(map(tuple, more.select(docs.columns).collect())) == Counter(map(tuple, plain.collect()))
    assert Counter(r.doc_id for r in more.collect()) == Counter(r.doc_id for r in plain.collect())


def test_the_rest_does_not_import_this_package():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (root / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
