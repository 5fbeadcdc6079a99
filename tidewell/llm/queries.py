"""The queries of this package's operators: what they return, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import bpe_trie, chat_collapse, decontaminate, language_id, lattice_links, near_copies, token_pack, toxicity, url_ratio, warc_zstd
from tidewell.llm.shared import work_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_pack.write_packed(table(spark, sf_dir, "documents"), work_dir(spark, "op1"), VOCABULARY, END_ID)
    return token_pack.read_packed(files)


@query
def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_decode(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.read_warc(warc_zstd.write_warc(table(spark, sf_dir, "pages"), work_dir(spark, "op3")))


ORACLE_SQL["op3_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5))::BIGINT >> (5 * (3 - i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


@query
def op6_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.format_chats(table(spark, sf_dir, "conversations"), work_dir(spark, "op6"))


ORACLE_SQL["op6_chat_collapse"] = """
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
             count(*) OVER (PARTITION BY conv_id) AS size FROM r),
p AS (SELECT conv_id, place, size, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM o),
w AS (SELECT size, prefix, min(conv_id) AS conv_id FROM p WHERE place = size GROUP BY size, prefix),
k AS (SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.size AND p.place = w.size AND p.prefix = w.prefix))
SELECT conv_id, (place - 1) // 256 AS part, max(size) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM o JOIN k USING (conv_id) GROUP BY conv_id, (place - 1) // 256
"""


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), work_dir(spark, "op10")))
    return scored.select("doc_id", (toxicity.fold("doc_id") == 1).alias("held_out"), "score", "predicted")


@query
def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"), work_dir(spark, "op9"))


ORACLE_SQL["op9_near_copies"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS MATERIALIZED (SELECT doc_id, hash(unnest(g)) AS h FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 75 * (len(sa.g) + len(sb.g) - n)),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id
"""


@query
def op2_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_links.lattice_links(table(spark, sf_dir, "embeddings"), work_dir(spark, "op2"))


ORACLE_SQL["op2_lattice_links"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op5_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_ratio.judge(pages, URL_RULES, url_ratio.train(pages))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(table(spark, sf_dir, "documents"))
    return language_id.identify_pages(table(spark, sf_dir, "pages"), model, work_dir(spark, "op8"))
