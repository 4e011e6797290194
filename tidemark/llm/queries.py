"""The registered queries of this package, one for each operator and one for the pipeline."""

from tidemark.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op10_token_counts")
def _op10(spark, sf_dir):
    """Tokens of every document by the two-tier lookup."""
    from tidemark.llm.token_counts import count_tokens

    return count_tokens(spark, table(spark, sf_dir, "documents"))


@query("op7_pack_documents")
def _op7(spark, sf_dir):
    """Every document in sequences of at most 2048 tokens."""
    from tidemark.llm.packing import pack

    return pack(spark, table(spark, sf_dir, "documents"))


@query("op2_near_duplicates")
def _op2(spark, sf_dir):
    """The component of every document over fingerprints at two or fewer differing bits."""
    from pyspark.sql import functions as F

    from tidemark.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_exact_duplicates", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)""")
def _op9(spark, sf_dir):
    """The row that stays for every document's text."""
    from tidemark.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_quality_rules")
def _op3(spark, sf_dir):
    """Counts, measures and verdict of every document."""
    from tidemark.llm.fertility import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def _op4(spark, sf_dir):
    """Base and novel secret spans of every document."""
    from tidemark.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op1_url_filter")
def _op1(spark, sf_dir):
    """Rule and verdict of every page's url."""
    from tidemark.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


@query("op8_toxicity")
def _op8(spark, sf_dir):
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    from tidemark.llm.toxicity import toxicity

    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_main_text")
def _op5(spark, sf_dir):
    """Main text of every page."""
    from tidemark.llm.html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query("op6_mix_sources")
def _op6(spark, sf_dir):
    """Block, window and slot of every document in the source schedule."""
    from pyspark.sql import functions as F

    from tidemark.llm.mixing import TICKETS, mix

    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", (F.coalesce(F.length("text"), F.lit(0)) + 1).alias("units"))
    return mix(sizes, TICKETS, units_col="units").select("doc_id", "source", "units", "__mix.*")


@query("op11_token_alignment")
def _op11(spark, sf_dir):
    """Groups, links and linked pairs of two tokenizers over every document."""
    from tidemark.llm.alignment import align

    return align(spark, table(spark, sf_dir, "documents"))


@query("op12_license_scan")
def _op12(spark, sf_dir):
    """Places of the base phrases, licence labels and score of every document."""
    from pyspark.sql import functions as F

    from tidemark.llm.license_scan import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents"))
    at, base, more = F.col("places.word"), F.col("places.label"), F.col("spans.label")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                      listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"), "score", F.size("spans").alias("n_spans"))


@query("op13_hard_negatives", """
WITH raw AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
             FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT *, row_number() OVER () AS r FROM raw),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, anchor_id, br, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id, br) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other_id, n.br)::INTEGER AS rank, n.other_id AS negative_id,
       positive_score, n.score AS negative_score
FROM p JOIN s n ON p.ar = n.ar AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other_id, n.br) <= 3""")
def _op13(spark, sf_dir):
    """Hard negatives of every anchor and positive; some labels are first moved on by one."""
    from pyspark.sql import functions as F

    from tidemark.llm.hard_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


@query("pipeline")
def _pipeline(spark, sf_dir):
    """The pieces of the corpus that the pipeline makes of ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
