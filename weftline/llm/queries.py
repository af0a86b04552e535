"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.abuse import p7_found, p7_rates, p7_scores
from weftline.llm.broken_pairs import p2_found, p2_rates
from weftline.llm.byte_bpe import p5_ids, p5_round_trip
from weftline.llm.near_duplicates import p1_found, p1_links
from weftline.llm.packing import p6_containers, p6_use
from weftline.llm.split_overlap import p3_found, p3_rates
from weftline.llm.truncation import FALSE_DISCOVERY, NEIGHBOURS, TIMES, p4_found, p4_limits, p4_rates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_limits": p4_limits, "p4_rates": p4_rates, "p6_containers": p6_containers, "p6_use": p6_use, "p5_ids": p5_ids, "p5_round_trip": p5_round_trip, "p7_found": p7_found, "p7_scores": p7_scores, "p7_rates": p7_rates}


def _alike(records: str) -> str:
    """Common table expressions up to pairs (a.part, id_a, id_b) of alike texts; records: part, id, t and others, one row a record."""
    return f"""WITH r AS ({records}),
w AS (SELECT *, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS ws FROM r WHERE t IS NOT NULL),
b AS (SELECT DISTINCT part, id, ws[i] || ' ' || ws[i + 1] AS p FROM (SELECT part, id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 20)),
n AS (SELECT part, id, count(*) AS n FROM b GROUP BY part, id),
c AS (SELECT x.part, x.id AS id_a, y.id AS id_b, count(*) AS c FROM b x JOIN b y ON x.part = y.part AND x.p = y.p AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT c.part, id_a, id_b FROM c JOIN n x ON x.part = c.part AND x.id = id_a JOIN n y ON y.part = c.part AND y.id = id_b WHERE 2 * c >= x.n + y.n - c)"""


P1 = _alike("SELECT 'prompt_log' AS part, prompt_id AS id, any_value(prompt) AS t FROM prompt_log GROUP BY prompt_id UNION ALL SELECT 'finetune_rows', example_id, any_value(train_output) FROM finetune_rows GROUP BY example_id")
SPLIT = "CASE WHEN split = 'val' THEN 'validation' ELSE split END"
P3 = _alike(
    "SELECT 'dpo' AS part, row_id AS id, train_prompts AS t, 'train' AS split, source FROM dpo_train UNION SELECT 'dpo', row_id, validation_prompts, 'validation', source FROM dpo_validation "
    f"UNION SELECT 'prompt_log', prompt_id, prompt, {SPLIT}, source FROM prompt_log WHERE split IN ('train', 'val', 'validation', 'test')"
)
CROSS = "FROM pairs JOIN r x ON x.part = pairs.part AND x.id = id_a JOIN r y ON y.part = pairs.part AND y.id = id_b WHERE (x.split = 'train') != (y.split = 'train')"


def _hazard(w: int, more: int) -> str:
    near, after = (f"OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN {a} AND {w} FOLLOWING)" for a in (f"{w} PRECEDING", "CURRENT ROW"))
    low = f"greatest(length - {w}, 1)"
    risk = f"(length + {w} - {low} + 1) * (at_risk - sum(n) {after}) + sum(n * length) {near} - ({low} - 1) * sum(n) {near} - CASE WHEN length >= {low} THEN at_risk ELSE 0 END"
    return f"(sum(n) {near} - n + {more}) / greatest({risk}, 1)"


LIMITS = f"""WITH r AS (SELECT any_value(source) AS source, any_value(train_output) AS t FROM finetune_rows GROUP BY example_id UNION ALL SELECT any_value(source), any_value(rejected) FROM dpo_train GROUP BY row_id
UNION ALL SELECT any_value(source), any_value(rejected) FROM dpo_validation GROUP BY row_id),
d AS (SELECT DISTINCT source, t FROM r WHERE t != ''),
l AS (SELECT source, 'characters' AS unit, length(t)::BIGINT AS length FROM d UNION ALL SELECT source, 'bytes', strlen(t) FROM d UNION ALL SELECT source, 'words', len(regexp_extract_all(t, '[^ \\t\\n\\v\\f\\r]+')) FROM d),
c AS (SELECT source, unit, length, count(*) AS n FROM l GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY source, unit ORDER BY length DESC) AS at_risk FROM c),
e AS (SELECT *, {TIMES} * at_risk * greatest({_hazard(NEIGHBOURS, 1)}, {_hazard(2, 0)}) AS m FROM a),
p AS (SELECT *, greatest(CASE WHEN n > m THEN -(n * ln(n / m) - n + m) ELSE 0.0 END, -2000.0) AS log_p FROM e),
b AS (SELECT *, ceil(log_p * 20)::INT AS bin FROM p),
k AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) AS rank, sum(count(*)) OVER () AS total FROM b GROUP BY bin)
SELECT source, unit, length, n, at_risk::BIGINT AS at_risk, round(log_p, 4) AS log_p FROM b WHERE bin <= (SELECT max(bin) FROM k WHERE bin / 20.0 <= ln({FALSE_DISCOVERY}) + ln(rank) - ln(total))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{P1} SELECT part AS tbl, id_a, id_b FROM pairs",
        "p1_links": f"""{P1}, s AS (SELECT part, id, string_agg(p, '|' ORDER BY p) AS k FROM b GROUP BY part, id),
o AS (SELECT part, id, count(*) AS n FROM (SELECT part, id_a AS id FROM pairs UNION ALL SELECT part, id_b FROM pairs) GROUP BY part, id)
SELECT s.part AS tbl, s.id, min(s.id) OVER (PARTITION BY s.part, k) AS class, count(*) OVER (PARTITION BY s.part, k) AS n_copies, coalesce(o.n, 0)::BIGINT AS n_links FROM s LEFT JOIN o ON o.part = s.part AND o.id = s.id""",
        "p3_found": f"{P3} SELECT pairs.part AS record_set, id_a, id_b {CROSS}",
        "p3_rates": f"""{P3}, e AS (SELECT x.part, CASE WHEN x.split = 'train' THEN id_b ELSE id_a END AS id {CROSS}), n2 AS (SELECT part, id, count(*) AS n FROM e GROUP BY part, id)
SELECT r.part AS record_set, split, source, count(*) AS n_records, count(n2.n) AS n_overlapping, coalesce(sum(n2.n), 0)::BIGINT AS n_pairs FROM r LEFT JOIN n2 ON n2.part = r.part AND n2.id = r.id WHERE split != 'train' GROUP BY r.part, split, source""",
        "p4_limits": LIMITS,
        "p5_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
