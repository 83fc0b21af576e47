"""The queries of this subpackage, by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_learned_partitions
from .classify import op2_compression_quality, op3_compression_toxicity
from .mixing import op8_systematic
from .neardup import op7_superminhash
from .packing import op5_large_item_matching
from .prefix import op6_prefix_counts
from .repair import op1_repair
from .sharding import op10_sampled_splitters
from .topk import op9_threshold


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_repair, op2_compression_quality, op3_compression_toxicity, op4_learned_partitions, op5_large_item_matching, op6_prefix_counts, op7_superminhash, op8_systematic, op9_threshold, op10_sampled_splitters]
    return {f.__name__: f for f in found}


#: Words of a text; their distinct shingles of three, links by counting common ones, and all that links reach.
OP7 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.c, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""

OP8 = """WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, (CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w, 2.0::DOUBLE * source_size AS bound FROM s),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY bound / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM w),
t AS (SELECT source, source_size, coalesce(least(bound, (SELECT l FROM r WHERE l * w <= bound ORDER BY bound / w, k LIMIT 1) * w), bound) AS target,
('0x' || substr(sha256(coalesce('17:' || source, '17')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM r),
p AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) - 1 AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor((i + 1) * rate + u) - floor(i * rate + u)) * size)::BIGINT AS taken, (floor((i + 1) * rate + u) - floor(i * rate + u))::BIGINT AS copies FROM p"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """The other queries learn, tokenize or compress; tests hold them against plain versions."""
    return {"op7_superminhash": OP7, "op8_systematic": OP8, "op9_threshold": OP9}
