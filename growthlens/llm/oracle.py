"""SQL twins of this package's queries, for DuckDB on the same tables."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept
  FROM norm WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM ranked
"""

WORDS = r"[^\x20\x09-\x0D]+"


def _level(name: str, children: str, parents: str, child: str) -> str:
    """One level of the budget tree: ``children`` has budget, weight and cap."""
    return f"""
{name}_1 AS (
  SELECT *, budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         row_number() OVER w AS place
  FROM ({children}) WINDOW w AS (PARTITION BY {parents} ORDER BY cap::DOUBLE / weight, {child})
),
{name}_2 AS (
  SELECT *, cap::HUGEINT * weights > remaining::HUGEINT * weight AS is_open FROM {name}_1
),
{name}_3 AS (
  SELECT *, min(place) FILTER (is_open) OVER p AS opens,
         max(remaining) FILTER (is_open) OVER p AS rest, max(weights) FILTER (is_open) OVER p AS everything
  FROM {name}_2 WINDOW p AS (PARTITION BY {parents})
),
{name} AS (
  SELECT *, CASE WHEN opens IS NULL OR place < opens THEN cap
    ELSE (rest::HUGEINT * (everything - weights + weight)::HUGEINT) // everything::HUGEINT
       - (rest::HUGEINT * (everything - weights)::HUGEINT) // everything::HUGEINT END::BIGINT AS share
  FROM {name}_3
)"""


MIX = (
    r"""
WITH numbered AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source,
         try_cast(regexp_extract(source, '^src([0-9]{1,9})$', 1) AS BIGINT) AS number,
         len(regexp_extract_all(coalesce(text, ''), '"""
    + WORDS
    + r"""')) AS n_tokens
  FROM documents
),
leaf_rows AS (
  SELECT doc_id, lang, source, n_tokens::BIGINT AS n_tokens,
         CASE WHEN number < 7 THEN 'web' WHEN number < 14 THEN 'forum' WHEN number < 20 THEN 'reference' ELSE 'other' END AS domain
  FROM numbered
),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap,
    CASE domain WHEN 'web' THEN 60 WHEN 'forum' THEN 25 WHEN 'reference' THEN 15 ELSE 5 END AS w_domain,
    CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 5 END AS w_lang,
    CASE source WHEN 'src0' THEN 3 ELSE 1 END AS w_source
  FROM leaf_rows GROUP BY domain, lang, source HAVING sum(n_tokens) > 0
),
wanted AS (SELECT least(sum(n_tokens)::BIGINT // 2, (SELECT sum(cap) FROM leaves)::BIGINT) AS budget FROM leaf_rows),"""
    + _level(
        "domains",
        "SELECT domain, max(w_domain) AS weight, sum(cap)::BIGINT AS cap, (SELECT budget FROM wanted) AS budget, 0 AS root FROM leaves GROUP BY domain",
        "root",
        "domain",
    )
    + ","
    + _level(
        "langs",
        "SELECT l.domain, l.lang, max(w_lang) AS weight, sum(l.cap)::BIGINT AS cap, any_value(d.share) AS budget "
        "FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang",
        "domain",
        "lang",
    )
    + ","
    + _level(
        "sources",
        "SELECT l.domain, l.lang, l.source, l.tokens, l.w_source AS weight, l.cap, g.share AS budget "
        "FROM leaves l JOIN langs g USING (domain, lang)",
        "domain, lang",
        "source",
    )
    + r""",
placed AS (
  SELECT r.*, s.share // s.tokens AS epochs, s.share % s.tokens AS left_over,
         md5('mix-1:' || (s.share // s.tokens)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM leaf_rows r JOIN sources s USING (domain, lang, source)
),
running AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key)
            - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS before
  FROM placed
),
taken AS (
  SELECT *, CASE WHEN before < left_over THEN least(n_tokens, left_over - before) ELSE 0 END AS last_part,
         epochs + CASE WHEN before < left_over THEN 1 ELSE 0 END AS copies
  FROM running
)
SELECT doc_id, domain, lang, source, n_tokens, copies::BIGINT AS copies,
       (epochs * n_tokens + last_part)::BIGINT AS tokens_taken
FROM taken WHERE copies > 0
"""
)

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
replies AS (
  SELECT conv_id, list(place ORDER BY place) AS places, max(place) AS last, arg_max(text, place) AS reply
  FROM turns WHERE role = 'assistant' GROUP BY conv_id
),
pairs AS (
  SELECT conv_id AS pair_id, last, coalesce(lead(reply) OVER o, first_value(reply) OVER o) AS other,
         places[1 + ((conv_id % len(places)) + len(places)) % len(places)] AS swapped
  FROM replies WINDOW o AS (ORDER BY conv_id)
),
sides AS (
  SELECT pair_id, place, role, text AS chosen, CASE WHEN place = swapped THEN other ELSE text END AS rejected, last
  FROM pairs JOIN turns ON conv_id = pair_id AND place <= last
),
cut AS (
  SELECT pair_id, coalesce(min(place) FILTER (chosen <> rejected) - 1, any_value(last)) AS n_common FROM sides GROUP BY pair_id
),
rendered AS (
  SELECT s.*, n_common, replace(role, '<|im_', '< |im_') AS r, replace(chosen, '<|im_', '< |im_') AS c,
         replace(rejected, '<|im_', '< |im_') AS j
  FROM sides s JOIN cut USING (pair_id)
),
parts AS (
  SELECT *, '<|im_start|>' || r || chr(10) AS head FROM rendered
),
texts AS (
  SELECT pair_id, place, n_common, head || c || '<|im_end|>' || chr(10) AS ct, head || j || '<|im_end|>' || chr(10) AS rt,
    CASE WHEN role = 'assistant' THEN '0x' || length(head) || ' 1x' || (length(c) + 10) || ' 0x1'
         ELSE '0x' || (length(head) + length(c) + 11) END AS cm,
    CASE WHEN role = 'assistant' THEN '0x' || length(head) || ' 1x' || (length(j) + 10) || ' 0x1'
         ELSE '0x' || (length(head) + length(j) + 11) END AS rm
  FROM parts
)
SELECT pair_id, any_value(n_common)::INTEGER AS n_common,
  coalesce(string_agg(ct, '' ORDER BY place) FILTER (place <= n_common), '') AS prompt,
  coalesce(string_agg(ct, '' ORDER BY place) FILTER (place > n_common), '') AS chosen,
  coalesce(string_agg(cm, ' ' ORDER BY place) FILTER (place > n_common), '') AS chosen_mask,
  coalesce(string_agg(rt, '' ORDER BY place) FILTER (place > n_common), '') AS rejected,
  coalesce(string_agg(rm, ' ' ORDER BY place) FILTER (place > n_common), '') AS rejected_mask
FROM texts GROUP BY pair_id
"""



def _clusters(k: int = 8, rounds: int = 10) -> str:
    """The rounds of centroid clustering, written out one after another."""
    kept = """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
)"""
    steps = [kept, f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""]
    gap = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT k.vec_id, k.v, n.c, n.d
  FROM kept k, LATERAL (SELECT c.c, {gap} AS d FROM c{i} c ORDER BY d, c.c LIMIT 1) n
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM (
      SELECT c, pos, sum(x) AS s, count(*) AS n
      FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY c, pos
    ) GROUP BY c
  ) m ON m.c = o.c
)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


SQL = {"op12_clusters": _clusters(), "op2_mixing": MIX, "op4_chat": CHAT, "op3_exact_dedup": EXACT_DEDUP}
