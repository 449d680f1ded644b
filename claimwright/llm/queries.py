"""One query for each operator, over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import bpe, chat, language, mixing, near, oracles, pii, quality, sharding, spelling, substring, topk, trie, winnow
from claimwright.llm.common import read

#: The hot source is held back, the others share the rest equally.
MIX_WEIGHTS = {"src0": 2.0}
MIN_POSTERIOR = 0.5


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"), width=35)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = language.identify(language.document_view(read(spark, sf_dir, "documents")), min_posterior=MIN_POSTERIOR)
    return judged.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "n_trigrams", "kept")


def llm_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = language.identify(language.page_view(read(spark, sf_dir, "pages")), key="page_id", min_posterior=MIN_POSTERIOR)
    return judged.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "n_trigrams", "kept")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.format_conversations(read(spark, sf_dir, "conversations"))
    return turns.withColumn("rendered_sha256", F.sha2(F.col("rendered").cast("binary"), 256))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edits(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), vocabulary())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    rounded = [F.round(c, 6).alias(c) for c in ("text_score", "meta_score", "quality")]
    return quality.score(docs, model).select("doc_id", *rounded, "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.conversation_trie(read(spark, sf_dir, "conversations"), shared_openings=True)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(read(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version", "next_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_winnowing": op6_winnowing,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_source_mixing": op10_source_mixing,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sharding": op13_sharding,
    "llm_language_id_pages": llm_language_id_pages,
}

ORACLE_SQL: dict[str, str] = {
    "op11_spelling": oracles.OP11,
    "op12_prefix_trie": oracles.OP12,
    "op13_sharding": oracles.OP13,
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
        m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN m USING (h)),
        x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(g.j) AS n_removed,
               sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.j) FILTER (WHERE g.j IS NULL), '')) AS kept_sha256
        FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id AND g.j = x.j
        GROUP BY d.doc_id, len(d.w)
    """,
    "op3_near_dedup": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
          FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT a.doc_id AS x, c.doc_id AS y, count(*) AS i FROM s a JOIN s c ON a.sh = c.sh AND a.doc_id < c.doc_id GROUP BY 1, 2),
        l AS (
          SELECT x, y FROM b JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
        u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.to_id),
        c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """,
    "op4_exact_top_k": """
        WITH v AS (
          SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
          FROM embeddings
          WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
        SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
    """,
    "op10_source_mixing": """
        WITH RECURSIVE n AS (
          SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END AS w FROM documents GROUP BY source),
        t AS (SELECT sum(w) AS mass, sum(n) AS total FROM n),
        m AS (
          SELECT source, CAST(w AS DOUBLE) / CAST(mass AS DOUBLE) * CAST(total AS DOUBLE) / n AS mean FROM n, t),
        d AS (SELECT source, mean, CAST(greatest(1, ceil(mean / 32)) AS INTEGER) AS draws FROM m),
        c(source, draws, mean, k, p, cdf) AS (
          SELECT source, draws, mean / draws, 0, exp(-mean / draws), exp(-mean / draws) FROM d
          UNION ALL
          SELECT source, draws, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < 159),
        u AS (
          SELECT doc_id, source, lang, text, n_chars, number, draw,
                 CAST(('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || CASE WHEN number > 0 THEN '|' || number ELSE '' END || '|' || draw), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
          FROM (SELECT x.*, unnest(range(1, d.draws + 1)) AS draw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text) - 1 AS number FROM documents) x JOIN d ON d.source IS NOT DISTINCT FROM x.source)),
        k AS (
          SELECT u.doc_id, u.number, u.draw, u.text, any_value(u.source) AS source, any_value(u.lang) AS lang,
                 any_value(u.n_chars) AS n_chars, count(*) FILTER (WHERE c.cdf <= u.u) AS times
          FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source GROUP BY u.doc_id, u.text, u.number, u.draw)
        SELECT doc_id, text, lang, source, n_chars, CAST((draw - 1) * 160 + i AS INTEGER) AS copy
        FROM (SELECT *, unnest(range(1, times + 1)) AS i FROM k)
    """,
}
