"""The thin ``opN_`` queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U
from . import conversation_trie, html_text, jaccard_join, maxent_lm, media_jpeg, pfair_mix, pii, piece_bpe, sort_means, token_orc, topk_mips, toxicity, url_trust

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == 0


def op1_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_mips.top_k(U.table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(U.table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(U.table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = U.table(spark, sf_dir, "documents").withColumn("held_out", _fold(10))
    return maxent_lm.fit_and_score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(U.table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.media_digests(media_jpeg.stored_media(U.table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = U.table(spark, sf_dir, "documents")
    labels = U.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~_fold(5))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", _fold(5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = U.stored_path(spark, "token-orc")
    token_orc.write_token_orc(U.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return token_orc.ids_crc(token_orc.read_token_orc(spark, path))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mixed(U.table(spark, sf_dir, "documents"))


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(U.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(U.table(spark, sf_dir, "conversations"), family=20, heads=4)


def op12_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(U.table(spark, sf_dir, "pages"), URL_RULES)


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster(U.table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators whose whole result SQL can state at acceptable cost."""
    return {"op1_topk_inner_product": OP1_SQL, "op11_conversation_trie": OP11_SQL, "op12_url_trust": url_trust_sql(), "op13_sort_means": sort_means_sql()}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

_CRC_BIT = "CASE WHEN {a} & 1 = 1 THEN xor({a} >> 1, 3988292384) ELSE {a} >> 1 END"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda a, i: {_CRC_BIT.format(a="a")})))"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, max(pos) AS n FROM own GROUP BY conv_id
), heads AS (
  SELECT s.conv_id, s.n, h, s.conv_id - s.conv_id % 20 AS base, least(h, coalesce(b.n, 0)) AS k
  FROM (SELECT *, {_CRC} % 4 AS h FROM sizes) s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 20
), told AS (
  SELECT h.conv_id, o.pos AS depth, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.base AND o.pos <= h.k
  UNION ALL
  SELECT h.conv_id, o.pos - h.h + h.k, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h
), steps AS (
  SELECT conv_id, depth, text, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM told
  UNION ALL
  SELECT conv_id, 0, '', CAST([] AS VARCHAR[]) FROM sizes
), ends AS (
  SELECT conv_id, max(depth) AS length FROM steps GROUP BY conv_id
), nodes AS (
  SELECT s.path, min(s.depth) AS depth, min(s.conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * len(regexp_extract_all(min(s.text), '[^\\x20\\x09-\\x0D]+')) AS own,
    coalesce(string_agg(CAST(CASE WHEN e.length = s.depth THEN s.conv_id END AS VARCHAR), ',' ORDER BY s.conv_id), '') AS ends
  FROM steps s JOIN ends e USING (conv_id) GROUP BY s.path
), kids AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), under AS (
  SELECT n.path[1:i] AS path, sum(n.own) AS saved, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves
  FROM (SELECT path, own, unnest(range(depth + 1)) AS i FROM nodes) n LEFT JOIN kids k ON k.path = n.path GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256,
  row_number() OVER (ORDER BY n.path) AS rank, CAST(row_number() OVER (ORDER BY n.path) + (SELECT count(*) FROM nodes m WHERE m.depth > n.depth AND m.path[1:n.depth] = n.path) AS BIGINT) AS "end"
FROM nodes n JOIN under u ON u.path = n.path LEFT JOIN kids k ON k.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


def url_trust_sql() -> str:
    """Verdicts with the scores' rounds written out; all numbers are whole, so both engines agree to the last."""
    hit = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in hit) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{a}'" for a, r in hit) + " END"
    t = url_trust.TRAVELS
    rounds = "".join(
        f""", s{i} AS MATERIALIZED (
  SELECT way, src, CAST(sum(part) AS BIGINT) AS score FROM (
    SELECT e.way, e.dst AS src, s.score * {t} // (100 * d.n) AS part FROM links e JOIN s{i - 1} s ON s.way = e.way AND s.src = e.src JOIN degree d ON d.way = e.way AND d.src = e.src
    UNION ALL SELECT way, src, score * {100 - t} // 100 FROM s0
    UNION ALL SELECT s.way, s.src, s.score * {t} // 100 FROM s{i - 1} s LEFT JOIN degree d ON d.way = s.way AND d.src = s.src WHERE d.n IS NULL
  ) GROUP BY way, src
)"""
        for i in range(1, url_trust.ROUNDS + 1)
    )
    link = url_trust._LINK.replace("'", "''")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT *, {action} AS action FROM (SELECT page_id, host, path, {rule} AS rule FROM p)
), links0 AS (
  SELECT DISTINCT host AS src, {lower.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM p WHERE host <> ''
), links AS MATERIALIZED (
  SELECT 'trust' AS way, src, dst FROM links0 WHERE src <> dst UNION ALL SELECT 'distrust', dst, src FROM links0 WHERE src <> dst
), degree AS MATERIALIZED (
  SELECT way, src, count(*) AS n FROM links GROUP BY way, src
), s0 AS MATERIALIZED (
  SELECT CASE action WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS way, host AS src, count(*) * {url_trust.UNIT} AS score FROM j WHERE action IS NOT NULL AND host <> '' GROUP BY 1, 2
){rounds}, hosts AS (
  SELECT host, count(*) AS n FROM j GROUP BY host
), known AS (
  SELECT h.host, h.n, CAST(coalesce(t.score, 0) AS BIGINT) AS trust, CAST(coalesce(d.score, 0) AS BIGINT) AS distrust FROM hosts h
  LEFT JOIN s{url_trust.ROUNDS} t ON t.way = 'trust' AND t.src = h.host LEFT JOIN s{url_trust.ROUNDS} d ON d.way = 'distrust' AND d.src = h.host
)
SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN distrust - trust > n * {url_trust.UNIT // 2} THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
FROM j JOIN known k ON k.host = j.host
"""


def sort_means_sql() -> str:
    """Full scans with the rounds written out."""
    step = ""
    for i in range(4):
        step += f""", a{i} AS MATERIALIZED (
  SELECT rid, vec_id, x, n AS cluster, d FROM (
    SELECT v.rid, v.vec_id, v.x, c.n, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{i} c
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, n) = 1
)"""
        if i < 3:
            step += f""", m{i} AS (
  SELECT cluster, list(m ORDER BY ord) AS x FROM (
    SELECT cluster, ord, CAST((s - ((s % k) + k) % k) // k AS BIGINT) AS m FROM (
      SELECT cluster, ord, sum(CAST(y AS HUGEINT)) AS s, count(*) AS k FROM (SELECT cluster, unnest(x) AS y, unnest(range(1, 65)) AS ord FROM a{i}) GROUP BY cluster, ord
    )
  ) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.n
)"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * 64) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS n, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 16)
){step}
SELECT a.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS VARCHAR)), ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.n = a.cluster
"""
