"""The pipeline's sequences follow the order that the mixing stage has given the documents."""

from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import mixing, packing


def _first_places(rows, place):
    first = defaultdict(lambda: 10 ** 9)
    for r in rows:
        first[r.sequence_id] = min(first[r.sequence_id], place[r.doc_id])
    return [first[s] for s in sorted(first)], sorted(first)


def test_sequences_follow_the_mixed_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus_pipeline.mix(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    schedule = mixing.mix(docs, mixing.TICKETS).select("doc_id", "__mix.slot", "__mix.place").collect()
    place = {r.doc_id: i for i, r in enumerate(sorted(schedule, key=lambda r: (r.slot, r.place)))}
    got = corpus_pipeline.pack(spark, mixed, "").collect()
    firsts, numbers = _first_places(got, place)
    assert firsts == sorted(firsts) and numbers == list(range(len(numbers))) and len(numbers) > 20
    plain = packing.pack(spark, docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in plain)
    assert len({r.sequence_id for r in plain}) == len(numbers)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_another_schedule_gives_other_sequences(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for i, tickets in enumerate((mixing.TICKETS, {"src4": 9})):
        mixing.in_mixed_order(docs, tickets).write.parquet(f"{tmp_path}/{i}")
        rows = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/{i}"), "").collect()
        found.append({(r.doc_id, r.piece): r.sequence_id for r in rows})
    assert found[0].keys() == found[1].keys() and found[0] != found[1]


def test_rows_without_a_stored_order(spark):
    rows = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    assert packing.stored_order(rows) == ()
    assert packing.pack(spark, rows).count() == 30
