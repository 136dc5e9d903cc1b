"""The registered queries op1 to op13: each applies its operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import mixing, prefix_trie, secret_scan, url_filter
from wayfarer.llm.common import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    from wayfarer.llm.secret_scan import secret_spans

    return secret_spans(_table(spark, sf_dir, "documents")).drop("found")


def op2_benchmark_decontamination(spark, sf_dir):
    from wayfarer.llm import decontaminate as D

    found = D.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = D.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op3_media_columns(spark, sf_dir):
    from wayfarer.llm.media import read_back, text_images

    return read_back(text_images(_table(spark, sf_dir, "documents"))).drop("media")


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    from wayfarer.llm.token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark, sf_dir):
    from wayfarer.llm import langid

    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_quality_classifier(spark, sf_dir):
    from wayfarer.llm import quality

    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(quality.training_rows(docs, quality.grades_of(_table(spark, sf_dir, "labels")), 3), 3)
    found = quality.score(docs, model)
    tail = lambda k: F.element_at("tails", k)
    return found.select("doc_id", "expected_grade", tail(1).alias("p_not_toxic"), tail(2).alias("p_good"), (tail(1) >= 0.9).alias("keep"))


def op7_url_filter(spark, sf_dir):
    from wayfarer.llm import url_filter as U

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", U.capture_day("page_id").alias("fetched"))
    return U.evaluate(pages, cut(U.validity(U.sample_entries(pages)))).select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "host", "n_active", "lists", "blocked")


def op8_ngram_jaccard_join(spark, sf_dir):
    from wayfarer.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark, sf_dir):
    from wayfarer.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark, sf_dir):
    from wayfarer.llm.html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op11_conversation_prefix_trie(spark, sf_dir):
    from wayfarer.llm.prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_embedding_near_dedup(spark, sf_dir):
    from wayfarer.llm.vector_join import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_cross_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    from wayfarer.llm.token_align import alignment

    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_benchmark_decontamination, op3_media_columns, op4_token_counts, op5_language_id, op6_quality_classifier, op7_url_filter, op8_ngram_jaccard_join, op9_source_mixing, op10_html_extraction, op11_conversation_prefix_trie, op12_embedding_near_dedup, op13_cross_tokenizer_alignment)}

#: Lower-cased (A-Z only) text and its words, as the decontamination contract has them.
_OP2_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op1_secret_scan": secret_scan.oracle(),
    "op7_url_filter": url_filter.oracle(),
    "op9_source_mixing": mixing.oracle(),
    "op11_conversation_prefix_trie": prefix_trie.oracle(),
    "op8_ngram_jaccard_join": """
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
        p AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM g a JOIN g b ON a.k = b.k AND a.r <> b.r GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
        c(r, root) USING KEY (r) AS (
            SELECT r, r FROM d
            UNION
            SELECT l.b, min(c.root) FROM c JOIN l ON l.a = c.r JOIN recurring.c o ON o.r = l.b WHERE c.root < o.root GROUP BY l.b),
        m AS (SELECT c.r, min(d2.doc_id) OVER (PARTITION BY c.root) AS component_id FROM c JOIN d d2 ON d2.r = c.r)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        f AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1),
        c(r, root) USING KEY (r) AS (
            SELECT r, r FROM v
            UNION
            SELECT l.b, min(c.root) FROM c JOIN l ON l.a = c.r JOIN recurring.c o ON o.r = l.b WHERE c.root < o.root GROUP BY l.b),
        m AS (SELECT c.r, min(v2.vec_id) OVER (PARTITION BY c.root) AS component_id FROM c JOIN v v2 ON v2.r = c.r)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op2_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP2_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_OP2_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        occ AS (SELECT d.r, p.i, s.n, array_to_string(d.w[p.i:p.i + s.n - 1], ' ') AS k
                FROM (SELECT DISTINCT n FROM win) s, d, LATERAL (SELECT unnest(range(1, len(d.w) - s.n + 2)) AS i) p),
        hit AS (SELECT occ.r, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.n = win.n AND occ.k = win.k),
        cov AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)""",
}
