"""The queries of this subpackage: opN_<name>, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digests
from .common import documents, prepare
from .exact import exact_dedup
from .jaccard import jaccard_join
from .lengths import encoded_lengths, histogram
from .packing import pack
from .pii import pii_spans
from .quality import fertility_quality
from .secrets import secret_spans
from .suffixes import suffix_dedup
from .urls import OP7_SQL, page_captures, page_entries, temporal_filter

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(op: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return op(documents(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {
        "op1_fertility_quality": _on_documents(fertility_quality),
        "op2_prefix_bpe": _on_documents(bpe_digests),
        "op3_tree_dedup": _on_documents(exact_dedup),
        "op4_pii_transducer": _on_documents(pii_spans),
        "op5_length_histogram": _on_documents(lambda docs: histogram(encoded_lengths(docs))),
        "op6_suffix_dedup": _on_documents(suffix_dedup),
        "op7_temporal_url_filter": lambda spark, sf_dir: temporal_filter(page_captures(spark, sf_dir), page_entries(spark, sf_dir)),
        "op8_trie_jaccard": _on_documents(jaccard_join),
        "op9_recursive_secrets": _on_documents(secret_spans),
        "op10_config_lp_packing": _on_documents(pack),
    }


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), b AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS group_size, first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM b
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m WHERE 100 * i >= 90 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS comp FROM e UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.comp, s.doc_id) AS component_id, coalesce(d.n, 0) AS n_links
FROM s LEFT JOIN c ON c.node = s.doc_id LEFT JOIN d ON d.a = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_tree_dedup": OP3_SQL, "op7_temporal_url_filter": OP7_SQL, "op8_trie_jaccard": OP8_SQL}
