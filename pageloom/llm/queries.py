"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.secrets import findings

    return findings(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.pages import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.mixing import pareto_mix

    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.infilling import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.prefixtrie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k == "pipeline" or k.startswith("op") and k[2:3].isdigit()}


#: By unit lists of each text: prefix, middle and suffix are slices of the list.
_FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM s),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

#: Prefixes as joined texts; a subtree's nodes are those whose smallest member has the top on its path.
_PREFIX_TRIE = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS own,
 xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda r, b: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(r, b)), CAST(4294967295 AS BIGINT))) % 9 AS h FROM t GROUP BY conv_id),
l AS (SELECT c.*, least(c.h, coalesce(o.own, 0)) AS lead FROM c LEFT JOIN c o ON o.conv_id = c.base),
r AS (SELECT l.conv_id, t.i + 1 AS depth, role, text FROM l JOIN t ON t.conv_id = l.base AND t.i < l.h UNION ALL SELECT l.conv_id, l.lead + t.i - l.h + 1, role, text FROM l JOIN t ON t.conv_id = l.conv_id AND t.i >= l.h),
p AS (SELECT conv_id, depth, md5(string_agg(sha256(role) || sha256(text), '' ) OVER w) AS node, strlen(text) AS bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
m AS (SELECT conv_id, depth, node, bytes FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, max(depth) AS length FROM m GROUP BY 1),
g AS (SELECT node, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, string_agg(CASE WHEN depth = length THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id) AS ends FROM m JOIN e USING (conv_id) GROUP BY node, depth),
k AS (SELECT g.*, q.node AS up, q.conv_id AS parent_conv_id FROM g LEFT JOIN (SELECT m.conv_id AS who, m.depth AS d, g.node, g.conv_id FROM m JOIN g ON g.node = m.node AND g.depth = m.depth) q ON q.who = g.conv_id AND q.d = g.depth - 1),
n AS (SELECT k.*, coalesce(s.n, 0) AS n_children FROM k LEFT JOIN (SELECT up, depth - 1 AS d, count(*) AS n FROM k WHERE depth > 0 GROUP BY ALL) s ON s.up = k.node AND s.d = k.depth),
b AS (SELECT a.node, a.depth, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM n JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM n JOIN b ON b.node = n.node AND b.depth = n.depth"""

_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, x.vec_id, sum(q.c * x.c) AS score FROM x q JOIN x ON q.d = x.d WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s)
SELECT * FROM r WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": _FILL_IN_MIDDLE, "op12_prefix_trie": _PREFIX_TRIE, "op13_top_k": _TOP_K}
