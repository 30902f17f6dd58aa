"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, clusters, conversations, decontaminate, exact_dedup, html_main, language, licenses, lm, pii, quality, secrets, simhash
from .common import table

BPE_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE_PATH, public_tokenizers.PATTERN)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.lloyd(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_licenses, op3_simhash, op4_quality, op5_secrets, op6_language, op7_bpe, op8_lm, op9_exact_dedup, op10_html, op11_pii, op12_clusters, op13_conversations)
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS t FROM bw),
ms AS (SELECT DISTINCT m FROM win),
dw AS (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dt AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS t FROM dw),
occ AS (SELECT r, dt.m, i, item_id FROM dt JOIN win ON dt.m = win.m AND dt.t = win.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM occ)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())

OP2_SQL = f"""
WITH t AS (SELECT template_id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(template_id, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
ti AS (SELECT template_id, w, unnest(range(1, len(w) - 3)) AS i FROM t),
ts AS (SELECT DISTINCT template_id, array_to_string(w[i : i + 4], ' ') AS s FROM ti),
tn AS (SELECT template_id, count(*) AS n FROM ts GROUP BY template_id),
di AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
dsh AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s FROM di),
m AS (SELECT r, template_id, count(*) AS k FROM dsh JOIN ts USING (s) GROUP BY r, template_id),
f AS (SELECT r, template_id, k / n AS c FROM m JOIN tn USING (template_id) WHERE k / n >= 0.8),
g AS (SELECT r, count(*) AS n, string_agg(template_id, ',' ORDER BY template_id) AS ids, max(c) AS c FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(ids, '') AS licenses, CAST(coalesce(c, 0) AS DOUBLE) AS containment FROM d LEFT JOIN g USING (r)
"""

OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
k AS (SELECT r, doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER best AS keep_id, row_number() OVER best = 1 AS kept
      FROM d WINDOW best AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256 FROM k
"""


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    near = "list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j])))"
    parts = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(d := CAST({near} AS BIGINT), c := c.c)) AS best FROM v, c{n} AS c GROUP BY v.r)")
        if n < rounds:
            parts += [
                f"u{n} AS (SELECT best.c AS c, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM a{n})",
                f"s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM u{n} GROUP BY c, i)",
                f"m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{n} GROUP BY c)",
                f"c{n + 1} AS (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{n} AS o LEFT JOIN m{n} AS m ON o.c = m.c)",
            ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON c.c = best.c
"""


OP12_SQL = _op12_sql()


def _op13_sql() -> str:
    put = {2: "chr(10) || 'user:'", 3: "chr(10) || 'assistant:'"}
    arcs = []
    for start in range(4):
        state, lines = start, "''"
        for inserts in range(3):
            pre = "I" * inserts
            to = 3 if state == 2 else 2
            arcs.append(f"({start}, {state}, '{pre}D', {2 * inserts + 3}, 'D', '', {lines}, '')")
            arcs.append(f"({start}, {to}, '{pre}R', {2 * inserts + 2}, 'R', '', {lines}, '{'assistant' if to == 3 else 'user'}')")
            if state == 0:
                arcs.append(f"({start}, 1, '{pre}K', {2 * inserts}, 'K', 's', {lines}, '')")
            arcs.append(f"({start}, {to}, '{pre}K', {2 * inserts}, 'K', '{'a' if to == 3 else 'u'}', {lines}, '')")
            state, lines = to, f"{lines} || {put[to]}"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) % 20 AS d FROM keyed, tab),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
               CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hit WHERE d <> 0),
pos AS (SELECT *, rtrim(text, {white}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p FROM dam),
rows_ AS (SELECT *, left(role, 1) AS ini, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS dup,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS prev FROM pos),
f AS (SELECT *, NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?') AS trunc FROM rows_),
arcs(st, st2, label, cost, op, ini, pre, new_role) AS (VALUES {", ".join(arcs)}),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM ids
  UNION ALL
  SELECT conv_id, p, st, cost, audit, lines FROM (
    SELECT dp.conv_id, f.p, arcs.st2 AS st, dp.cost + arcs.cost + CASE WHEN f.trunc AND arcs.op <> 'D' THEN 1 ELSE 0 END AS cost, dp.audit || arcs.label AS audit,
           dp.lines || arcs.pre || CASE arcs.op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || arcs.new_role || ':' || f.text END AS lines,
           row_number() OVER (PARTITION BY dp.conv_id, arcs.st2 ORDER BY dp.cost + arcs.cost + CASE WHEN f.trunc AND arcs.op <> 'D' THEN 1 ELSE 0 END, dp.audit || arcs.label) AS best
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.p = dp.p + 1 JOIN arcs ON arcs.st = dp.st AND (arcs.op = 'D' OR NOT f.blank AND NOT f.dup) AND (arcs.op <> 'K' OR arcs.ini = f.ini))
  WHERE best = 1),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
                 count(*) FILTER (p > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n FROM f GROUP BY conv_id),
done AS (SELECT dp.conv_id, cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
                lines || CASE st WHEN 1 THEN {put[2]} || {put[3]} WHEN 2 THEN {put[3]} ELSE '' END AS lines
         FROM dp LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.p = coalesce(facts.n, 0)),
first_ AS (SELECT conv_id, unnest(min(struct_pack(cost, audit, lines))) FROM done GROUP BY conv_id)
SELECT first_.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(lines[2:]) AS repaired_sha256
FROM first_ LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM first_.conv_id
"""


OP13_SQL = _op13_sql()

ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_licenses": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op12_clusters": OP12_SQL, "op13_conversations": OP13_SQL}
