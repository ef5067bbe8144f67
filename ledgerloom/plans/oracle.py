"""DuckDB SQL shared by the oracles: the journal, then one step of the analysis per common table."""

from ledgerloom.config import ANCHOR, CATEGORIES, CHARACTERISTIC, CLOSING, FX_EXCLUDED, FX_MONETARY, FX_OPERATING, GROUP_WORDS, STOP_WORDS
from ledgerloom.sources.journal import JOURNAL_CTE


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def texts(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


R2 = lambda x: f"round_even(({x}) * 100, 0) / 100"
R6 = lambda x: f"round_even(({x}) * 1e6, 0) / 1e6"

LINES = (
    JOURNAL_CTE
    + f""",
lines AS (
  SELECT year(dt) || '年' || month(dt) || '月-记-' || lpad(CAST(k AS VARCHAR), 6, '0') AS voucher, '记-' || lpad(CAST(k AS VARCHAR), 6, '0') AS number,
    strftime(dt, '%Y-%m-%d') AS date, CAST(line_no AS BIGINT) AS line_no, subj AS subject, debit, credit,
    CASE WHEN debit > 0 THEN '借' WHEN credit > 0 THEN '贷' ELSE '' END AS direction
  FROM journal),
v AS (
  SELECT voucher, list_sort(list(DISTINCT subject)) AS subjects, string_agg(DISTINCT subject, '、' ORDER BY subject) AS feature,
    sum(abs(debit)) AS abs_amount, sum(debit) AS debit_sum, sum(credit) AS credit_sum, count(*) AS n_lines,
    count(*) FILTER (debit > 0) AS n_debit, count(*) FILTER (credit > 0) AS n_credit
  FROM lines GROUP BY voucher),
b AS (SELECT * FROM v WHERE NOT regexp_matches(feature, '{"|".join(CLOSING)}'))"""
)

GROUPED = (
    LINES
    + f""",
word(g, w) AS (VALUES {values((g, w) for g, ws in GROUP_WORDS.items() for w in ws)}),
rank_of(g, r) AS (VALUES {values([*((g, n) for n, g in enumerate(CHARACTERISTIC)), *((g, 100 + n) for n, g in enumerate(ANCHOR))])}),
feats AS (SELECT DISTINCT feature, subjects FROM b),
valid AS (SELECT feature, s, row_number() OVER (PARTITION BY feature ORDER BY s) AS pos, count(*) OVER (PARTITION BY feature) AS n
  FROM (SELECT feature, unnest(subjects) AS s FROM feats) WHERE s NOT IN ({texts(STOP_WORDS)})),
hit AS (SELECT feature, g, any_value(n) AS n, count(*) AS cnt, min(pos) AS pos FROM valid JOIN word ON s = w GROUP BY feature, g),
chosen AS (
  SELECT feature, h.g, r AS ord FROM hit h JOIN rank_of USING (g) WHERE r < 100
  UNION ALL
  SELECT feature, h.g, CASE WHEN n >= 3 THEN 200 + pos ELSE r END FROM hit h JOIN rank_of USING (g)
  WHERE r >= 100 AND CASE WHEN n = 1 THEN TRUE WHEN n = 2 THEN cnt = 2 OR NOT EXISTS (SELECT 1 FROM hit x JOIN rank_of y USING (g) WHERE x.feature = h.feature AND y.r >= 100 AND x.cnt = 2) ELSE cnt >= 2 END),
known AS (
  SELECT feature, coalesce(list(g ORDER BY ord) FILTER (g IS NOT NULL), ['其他群']) AS involved,
    CASE WHEN count(g) = 0 THEN CASE WHEN feature NOT IN (SELECT feature FROM valid) THEN '停用词主导' ELSE '其他群' END WHEN min(ord) < 100 THEN '特性群判定' ELSE '二元锚定' END AS classify_type
  FROM feats LEFT JOIN chosen USING (feature) GROUP BY feature),
c AS (SELECT b.*, involved, involved[1] AS primary_group, array_to_string(involved, '、') AS involved_groups, len(involved) AS group_count, classify_type, len(involved) > 1 AS is_cross_group
  FROM b JOIN known USING (feature))"""
)

SCORED = (
    GROUPED
    + f""",
sizes AS (SELECT g, count(*) AS n FROM (SELECT unnest(involved) AS g FROM c) GROUP BY g),
combos AS (SELECT list_sort(involved) AS combination, count(*) AS n FROM c WHERE is_cross_group GROUP BY 1),
combo_g AS (SELECT combination, n, unnest(combination) AS g FROM combos),
combo_t AS (SELECT combination, any_value(x.n) AS n, sum(s.n) AS total FROM combo_g x JOIN sizes s USING (g) GROUP BY combination),
shared AS (SELECT p.g AS g1, q.g AS g2, 1 - product(1 - (t.n + 1) / (t.total + 2)) AS x FROM combo_t t JOIN combo_g p USING (combination) JOIN combo_g q USING (combination) WHERE p.g <> q.g GROUP BY 1, 2),
dist AS (SELECT p.g AS g1, q.g AS g2, CASE WHEN p.g = q.g THEN 0.0::DOUBLE WHEN x > 0 THEN {R2("least(100.0, 1 / x - 1)")} ELSE 100.0::DOUBLE END AS distance
  FROM sizes p CROSS JOIN sizes q LEFT JOIN shared ON g1 = p.g AND g2 = q.g),
vconn AS (SELECT DISTINCT c.voucher, primary_group, x.subject AS src, y.subject AS dst FROM lines x JOIN lines y ON x.voucher = y.voucher JOIN c ON c.voucher = x.voucher
  WHERE x.credit > 0 AND y.subject <> x.subject AND y.direction = CASE x.direction WHEN '借' THEN '贷' WHEN '贷' THEN '借' END),
conn AS (SELECT primary_group, src, dst, count(*) AS n FROM vconn GROUP BY ALL),
hhi AS (SELECT primary_group, CAST(sum(n * n) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS hhi, CAST(sum(n) AS BIGINT) AS total FROM conn GROUP BY 1),
rated AS (SELECT primary_group, src, dst, least(100.0, CASE WHEN hhi >= 0.9999 THEN -ln(n / total) ELSE (power(n / total, -(1 - hhi)) - 1) / (1 - hhi) END) AS score FROM conn JOIN hhi USING (primary_group)),
best AS (SELECT voucher, max(score) AS best FROM vconn JOIN rated USING (primary_group, src, dst) GROUP BY 1),
freq AS (SELECT primary_group, feature, count(*) AS n, sum(count(*)) OVER (PARTITION BY primary_group) AS total FROM c GROUP BY 1, 2),
inn AS (SELECT c.voucher, {R2("coalesce(best, CASE WHEN f.n / f.total < 0.01 THEN CASE WHEN coalesce(hhi, 0) >= 0.9999 THEN -ln(f.n / f.total) ELSE least(100.0, (power(f.n / f.total, -(1 - coalesce(hhi, 0))) - 1) / (1 - coalesce(hhi, 0))) END ELSE 0.0 END) + CASE WHEN primary_group = '其他群' THEN 20.0 ELSE 0.0 END")} AS inner_score
  FROM c JOIN freq f USING (primary_group, feature) LEFT JOIN best USING (voucher) LEFT JOIN hhi USING (primary_group)),
sets AS (SELECT DISTINCT involved_groups, involved FROM c WHERE is_cross_group),
crs AS (SELECT involved_groups, {R2("sum(distance)")} AS cross_score FROM (SELECT involved_groups, involved, unnest(involved) AS g1 FROM sets) s JOIN dist d ON d.g1 = s.g1 AND list_contains(involved, d.g2) AND d.g1 < d.g2
  WHERE d.g1 <> '其他群' AND d.g2 <> '其他群' GROUP BY 1),
running AS (SELECT primary_group, abs_amount, sum(abs_amount) OVER (PARTITION BY primary_group ORDER BY abs_amount DESC) AS run, sum(abs_amount) OVER (PARTITION BY primary_group) AS total FROM c),
mat AS (SELECT primary_group, CASE WHEN any_value(total) = 0 THEN 0.0::DOUBLE ELSE CAST(coalesce(max(abs_amount) FILTER (CAST(run AS DOUBLE) >= CAST(total AS DOUBLE) * 0.95), min(abs_amount)) AS DOUBLE) END AS level FROM running GROUP BY 1),
alph AS (SELECT c.*, level, inner_score, coalesce(cross_score, 0.0) AS cross_score,
    CASE WHEN level <= 0 OR CAST(abs_amount AS DOUBLE) >= level THEN 1.0 ELSE greatest(0.0, least(1.0, exp(5.36::DOUBLE * (CAST(abs_amount AS DOUBLE) / level - 1)))) END AS alpha
  FROM c JOIN inn USING (voucher) JOIN mat USING (primary_group) LEFT JOIN crs USING (involved_groups)),
final AS (SELECT *, {R2("(cross_score + inner_score) * alpha")} AS final_score FROM alph),
s AS (SELECT *, CASE WHEN cross_score > 0 AND inner_score > 0 THEN '跨模块+内部异常' WHEN cross_score > 0 THEN '跨模块异常' WHEN inner_score > 0 THEN '模块内异常' ELSE '正常' END AS anomaly_type,
  CASE WHEN final_score >= 80 THEN '高风险 🔴' WHEN final_score >= 30 THEN '中风险 🟠' WHEN final_score >= 10 THEN '中低风险 🟡' ELSE '正常 🟢' END AS risk_level FROM final),
counters AS (SELECT x.voucher, x.line_no, x.subject, x.direction, x.credit, coalesce(string_agg(DISTINCT y.subject, '、' ORDER BY y.subject), '') AS counter_subject
  FROM lines x LEFT JOIN lines y ON x.voucher = y.voucher AND y.subject <> x.subject AND y.direction = CASE x.direction WHEN '借' THEN '贷' WHEN '贷' THEN '借' END GROUP BY ALL),
per AS (SELECT primary_group, subject AS src, unnest(string_split(counter_subject, '、')) AS dst, voucher FROM counters JOIN c USING (voucher) WHERE credit > 0 AND counter_subject <> ''),
e0 AS (SELECT primary_group, src, dst, count(*) AS weight, count(DISTINCT voucher) AS n_vouchers FROM per GROUP BY ALL),
e AS (SELECT *, {R6("1.5::DOUBLE + ln(1 + weight) / ln(1 + max(weight) OVER (PARTITION BY primary_group)) * 6.5::DOUBLE")} AS width, {R6("0.28::DOUBLE + ln(1 + weight) / ln(1 + max(weight) OVER (PARTITION BY primary_group)) * 0.55::DOUBLE")} AS opacity FROM e0)"""
)

CONTRA = (
    LINES
    + f""",
sums AS (SELECT voucher, sum(abs(debit)) AS sd, sum(abs(credit)) AS sc, list_sort(list(DISTINCT subject)) AS all_subjects FROM lines GROUP BY voucher),
cl AS (SELECT l.voucher, date, number, line_no, subject, all_subjects,
  CASE WHEN sc < 0.001 AND sd > 0.001 AND debit < 0 THEN 0 WHEN sd < 0.001 AND sc > 0.001 AND credit < 0 THEN -credit ELSE debit END::DECIMAL(18,2) AS debit,
  CASE WHEN sc < 0.001 AND sd > 0.001 AND debit < 0 THEN -debit WHEN sd < 0.001 AND sc > 0.001 AND credit < 0 THEN 0 ELSE credit END::DECIMAL(18,2) AS credit
  FROM lines l JOIN sums USING (voucher)),
route0 AS (SELECT voucher, any_value(all_subjects) AS all_subjects, coalesce(list_sort(list(DISTINCT subject) FILTER (debit <> 0)), []) AS ds, coalesce(list_sort(list(DISTINCT subject) FILTER (credit <> 0)), []) AS cs FROM cl GROUP BY voucher),
route AS (SELECT voucher, ds, cs,
  CASE WHEN len(ds) + len(cs) = 0 THEN 'empty' WHEN list_contains(all_subjects, '本年利润') THEN 'closing'
    WHEN len(list_filter(all_subjects, lambda s: contains(s, '财务费用'))) > 0 AND len(list_filter(all_subjects, lambda s: regexp_matches(s, '{"|".join(FX_OPERATING)}'))) = 0
      AND len(list_filter(all_subjects, lambda s: regexp_matches(s, '{"|".join(FX_MONETARY)}') AND NOT regexp_matches(s, '{"|".join(FX_EXCLUDED)}'))) >= 3 THEN 'fx'
    WHEN len(ds) = 1 AND len(cs) = 1 THEN '1v1' WHEN len(ds) = 1 AND len(cs) > 1 THEN '1vN' WHEN len(ds) > 1 AND len(cs) = 1 THEN 'Nv1' ELSE 'MvN' END AS structure
  FROM route0),
led AS (SELECT voucher, subject, CASE WHEN debit >= 0 THEN 'Pos' ELSE 'Neg' END AS sign, 'D' AS side, CAST(sum(debit * 100) AS BIGINT) AS cents FROM cl JOIN route USING (voucher) WHERE structure = 'MvN' AND debit <> 0 GROUP BY 1, 2, 3
  UNION ALL SELECT voucher, subject, CASE WHEN credit >= 0 THEN 'Pos' ELSE 'Neg' END, 'C', CAST(sum(credit * 100) AS BIGINT) FROM cl JOIN route USING (voucher) WHERE structure = 'MvN' AND credit <> 0 GROUP BY 1, 2, 3),
pat AS (SELECT voucher, string_agg(DISTINCT subject, '、' ORDER BY subject) AS pattern FROM led GROUP BY 1)"""
)

CATEGORY = f"category(c, w) AS (VALUES {values((c, w) for c, ws in CATEGORIES.items() for w in ws)})"
