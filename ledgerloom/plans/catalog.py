"""The registered queries over the journal, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import classify as C
from ledgerloom.operators import graph as G
from ledgerloom.operators import scoring as Z
from ledgerloom.operators import vouchers as V
from ledgerloom.plans.oracle import CATEGORY, GROUPED, LINES, R2, R6, SCORED
from ledgerloom.shared import written
from ledgerloom.sources import journal as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None, prefix: str = ""):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = f"{prefix}\n{oracle}"
        return f

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    return J.order_lines(spark, d)


def amounts(spark: SparkSession, d: str) -> DataFrame:
    """lines() for sums and sets by voucher: only their subjects and amounts, in no order."""
    return J.order_amounts(spark, d)


def business(spark: SparkSession, d: str) -> DataFrame:
    return V.business_vouchers(amounts(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(business(spark, d))


def classified_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Classified vouchers (of them, these columns), computed once and written, for queries that read them several times."""
    return written(classified(spark, d).select(*columns or "*"), "classified")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Classified vouchers feed five branches, so they are computed once and written."""
    return Z.score(classified_once(spark, d))


#: Subjects of the journal as people write them: with spaces, tabs, details behind all kinds of dashes, or missing. The same text for Spark and DuckDB.
WRITTEN_NAME = """CASE line_no % 9 WHEN 0 THEN '  ' || subject || ' ' WHEN 1 THEN subject || '-明细' || CAST(line_no AS STRING) WHEN 2 THEN subject || '_暂估' WHEN 3 THEN subject || '——工行'
  WHEN 4 THEN subject || '—差旅' WHEN 5 THEN ' ' || left(subject, 2) || chr(9) || substr(subject, 3) WHEN 6 THEN left(subject, 2) || ' ' || substr(subject, 3) || '　' WHEN 7 THEN NULL ELSE '' END"""
NORMAL = "coalesce(replace(replace(regexp_replace(name, '^[\\s　]+|[\\s　]+$', '', 'g'), ' ', ''), chr(9), ''), '')"


def _written_names(spark, d) -> DataFrame:
    return lines(spark, d).select("voucher", "line_no", F.expr(WRITTEN_NAME).alias("name"))


@register(f"SELECT voucher, line_no, name, {NORMAL} AS subject FROM (SELECT *, {WRITTEN_NAME} AS name FROM lines)", LINES)
def normalize_subject(spark, d):
    """Every line's subject, from the ways in which people write it."""
    return _written_names(spark, d).withColumn("subject", S.normalize_subject(F.col("name")))


@register(
    "SELECT voucher, line_no, name, CASE WHEN contains(s, '-') THEN split_part(s, '-', 1) WHEN contains(s, '_') THEN split_part(s, '_', 1) WHEN contains(s, '——') THEN split_part(s, '——', 1) WHEN contains(s, '—') THEN split_part(s, '—', 1) ELSE s END AS subject "
    f"FROM (SELECT *, {NORMAL} AS s FROM (SELECT *, {WRITTEN_NAME} AS name FROM lines))",
    LINES,
)
def first_level_subject(spark, d):
    """Every line's first-level subject, from the ways in which people write it."""
    return _written_names(spark, d).withColumn("subject", S.first_level_subject(F.col("name")))


@register("SELECT voucher, line_no, coalesce(replace(replace(regexp_replace(subject, '^[\\s　]+|[\\s　]+$', '', 'g'), ' ', ''), chr(9), ''), '') AS subject FROM lines", LINES)
def line_subjects(spark, d):
    """normalize_subject over every line of the journal."""
    return lines(spark, d).select("voucher", "line_no", S.normalize_subject(F.col("subject")).alias("subject"))


@register(
    "SELECT voucher, line_no, CASE WHEN contains(s, '-') THEN split_part(s, '-', 1) WHEN contains(s, '_') THEN split_part(s, '_', 1) WHEN contains(s, '——') THEN split_part(s, '——', 1) WHEN contains(s, '—') THEN split_part(s, '—', 1) ELSE s END AS subject "
    "FROM (SELECT voucher, line_no, coalesce(replace(replace(regexp_replace(subject, '^[\\s　]+|[\\s　]+$', '', 'g'), ' ', ''), chr(9), ''), '') AS s FROM lines)",
    LINES,
)
def line_first_level_subjects(spark, d):
    """first_level_subject over every line of the journal."""
    return lines(spark, d).select("voucher", "line_no", S.first_level_subject(F.col("subject")).alias("subject"))


@register("SELECT DISTINCT voucher, date, number FROM lines", LINES)
def voucher_id(spark, d):
    """The three accepted date formats give the same number."""
    j = J.order_journal(spark, d).select("k", "dt").distinct()
    text = F.when(F.col("k") % 3 == 0, F.date_format("dt", "yyyy/M/d")).when(F.col("k") % 3 == 1, F.date_format("dt", "yyyy-MM-dd")).otherwise(F.date_format("dt", "yyyy年M月d日"))
    number = F.concat(F.lit("记-"), F.lpad(F.col("k").cast("string"), 6, "0"))
    return j.select(S.voucher_id(text, number).alias("voucher"), F.date_format("dt", "yyyy-MM-dd").alias("date"), number.alias("number"))


@register("SELECT voucher, line_no, CAST(debit AS DOUBLE) AS amount FROM lines", LINES)
def format_amount(spark, d):
    text = F.format_number(F.col("debit").cast("decimal(18,2)"), 2)
    return lines(spark, d).select("voucher", "line_no", S.format_amount(text).alias("amount"))


@register("SELECT voucher, line_no, CAST(CASE WHEN abs(debit) >= 1000 THEN 0 ELSE debit END AS DOUBLE) AS amount FROM lines", LINES)
def contra_amount(spark, d):
    text = F.format_number(F.col("debit").cast("decimal(18,2)"), 2)
    return lines(spark, d).select("voucher", "line_no", S.contra_amount(text).alias("amount"))


@register("SELECT direction, count(*) AS n FROM lines GROUP BY 1", LINES)
def direction(spark, d):
    return lines(spark, d).groupBy(S.direction(F.col("debit"), F.col("credit")).alias("direction")).agg(F.count("*").alias("n"))


@register("SELECT subject, regexp_matches(subject, '银行|现金|Bank|Cash|支付宝|微信') AS sensitive, count(*) AS n FROM lines GROUP BY ALL", LINES)
def sensitive_subjects(spark, d):
    return lines(spark, d).groupBy("subject", S.is_sensitive(F.col("subject")).alias("sensitive")).agg(F.count("*").alias("n"))


@register(f", {CATEGORY} SELECT subject, coalesce(any_value(c), 'default') AS category, count(*) AS n FROM lines LEFT JOIN category ON subject = w GROUP BY subject", LINES)
def subject_category(spark, d):
    return lines(spark, d).groupBy("subject", S.subject_category(F.col("subject")).alias("category")).agg(F.count("*").alias("n"))


@register("SELECT voucher, feature FROM v", LINES)
def voucher_features(spark, d):
    return V.vouchers(lines(spark, d)).select("voucher", "feature")


@register("SELECT voucher, CAST(abs_amount AS DOUBLE) AS abs_amount FROM v", LINES)
def voucher_abs_amount(spark, d):
    return V.vouchers(lines(spark, d)).select("voucher", F.col("abs_amount").cast("double").alias("abs_amount"))


@register("SELECT voucher, feature, CAST(debit_sum AS DOUBLE) AS debit_sum, CAST(credit_sum AS DOUBLE) AS credit_sum, '借方' || n_debit || '条/贷方' || n_credit || '条' AS sides FROM v", LINES)
def voucher_summary(spark, d):
    return V.voucher_summary(V.vouchers(lines(spark, d)))


@register("SELECT l.voucher, line_no, subject FROM lines l JOIN b ON l.voucher = b.voucher", LINES)
def filter_closing(spark, d):
    return V.filter_closing(lines(spark, d)).select("voucher", "line_no", "subject")


@register("SELECT feature, count(*) AS n_vouchers FROM b GROUP BY 1", LINES)
def feature_counts(spark, d):
    return V.feature_distribution(business(spark, d))


@register("SELECT feature, count(*) AS n_vouchers FROM v GROUP BY 1", LINES)
def feature_distribution(spark, d):
    return V.feature_distribution(V.vouchers(lines(spark, d)))


@register("SELECT feature, count(*) AS n_vouchers FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", LINES)
def topk_features(spark, d):
    return V.feature_distribution(business(spark, d)).orderBy(F.desc("n_vouchers"), "feature").limit(10)


@register(f"SELECT count(*) AS n_vouchers, CAST(sum(abs_amount) AS DOUBLE) AS total, {R2('CAST(sum(abs_amount) AS DOUBLE) / count(*)')} AS mean, CAST(max(abs_amount) AS DOUBLE) AS largest, CAST(min(abs_amount) AS DOUBLE) AS smallest, CAST(sum(debit_sum) AS DOUBLE) AS debit_total FROM b", LINES)
def amount_stats(spark, d):
    return V.amount_stats(business(spark, d))


@register("SELECT voucher, line_no, direction, counter_subject FROM counters", SCORED)
def counter_subjects(spark, d):
    return V.with_counter_subjects(lines(spark, d)).select("voucher", "line_no", "direction", "counter_subject")


@register("SELECT voucher, min(date) AS date, min(number) AS number, string_agg(subject, ' | ' ORDER BY first) AS summaries FROM (SELECT voucher, subject, min(line_no) AS first, any_value(date) AS date, any_value(number) AS number FROM lines GROUP BY voucher, subject) GROUP BY voucher", LINES)
def voucher_meta(spark, d):
    return V.voucher_meta(lines(spark, d), "subject")


@register("SELECT (SELECT count(*) FROM lines JOIN b USING (voucher)) AS n_lines, count(*) AS n_vouchers, count(DISTINCT feature) AS n_features, count(DISTINCT primary_group) AS n_groups FROM c", GROUPED)
def overview(spark, d):
    return classified(spark, d).agg(F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_vouchers"), F.countDistinct("feature").alias("n_features"), F.countDistinct("primary_group").alias("n_groups"))


@register("SELECT voucher, primary_group, involved_groups, CAST(group_count AS INTEGER) AS group_count, classify_type, is_cross_group FROM c", GROUPED)
def classify(spark, d):
    return classified(spark, d).select("voucher", "primary_group", "involved_groups", "group_count", "classify_type", "is_cross_group")


@register("SELECT classify_type, count(*) AS n FROM c GROUP BY 1", GROUPED)
def classify_types(spark, d):
    return classified(spark, d).groupBy("classify_type").agg(F.count("*").alias("n"))


@register("SELECT primary_group, count(*) AS n_vouchers, count(DISTINCT feature) AS n_features FROM c GROUP BY 1", GROUPED)
def group_distribution(spark, d):
    return C.group_distribution(classified(spark, d))


@register("SELECT g, n FROM sizes", SCORED)
def group_counts(spark, d):
    return C.involved_counts(classified(spark, d))


@register("SELECT array_to_string(combination, '、') AS combination, n FROM combos", SCORED)
def cross_counts(spark, d):
    return C.combination_counts(classified(spark, d)).select(S.join_subjects(F.col("combination")).alias("combination"), "n")


@register("SELECT voucher, involved_groups FROM c WHERE is_cross_group", GROUPED)
def cross_vouchers(spark, d):
    return classified(spark, d).where("is_cross_group").select("voucher", "involved_groups")


@register("SELECT voucher, feature FROM c WHERE primary_group = '其他群'", GROUPED)
def uncertain_vouchers(spark, d):
    return classified(spark, d).where("primary_group = '其他群'").select("voucher", "feature")


@register("SELECT feature, primary_group, is_cross_group, involved_groups, count(*) AS n_vouchers FROM c GROUP BY ALL", GROUPED)
def feature_detail(spark, d):
    return C.feature_detail(classified(spark, d))


@register("SELECT g1, g2, distance FROM dist", SCORED)
def distance_matrix(spark, d):
    return Z.distance_matrix(classified_once(spark, d, "involved", "is_cross_group"))


PAIRS = "SELECT g1, g2, distance, '{end}' AS \"end\" FROM (SELECT * FROM dist WHERE g1 < g2 AND distance > 0 ORDER BY distance {order}, g1, g2 LIMIT 5)"


@register(PAIRS.format(end="nearest", order="") + " UNION ALL " + PAIRS.format(end="farthest", order="DESC"), SCORED)
def distance_pairs(spark, d):
    return Z.distance_pairs(written(Z.distance_matrix(classified_once(spark, d, "involved", "is_cross_group")), "distances"))


@register("SELECT primary_group, src, dst, n FROM conn", SCORED)
def connections(spark, d):
    return Z.connections(classified(spark, d))


@register(f"SELECT primary_group, {R6('hhi')} AS hhi, total, CASE WHEN hhi >= 0.5 THEN '高度集中' WHEN hhi >= 0.25 THEN '中度集中' ELSE '低度集中' END AS band FROM hhi", SCORED)
def hhi(spark, d):
    return Z.concentration(Z.connections(classified(spark, d))).select("primary_group", (F.rint(F.col("hhi") * 1e6) / 1e6).alias("hhi"), "total", S.hhi_band(F.col("hhi")).alias("band"))


@register("SELECT primary_group, feature, n, CAST(total AS BIGINT) AS total FROM freq", SCORED)
def feature_frequency(spark, d):
    return Z.feature_frequency(classified(spark, d))


@register("SELECT voucher, inner_score FROM inn", SCORED)
def inner_score(spark, d):
    return Z.inner_scores(classified_once(spark, d, "voucher", "primary_group", "feature", "debit_subjects", "credit_subjects", "both_subjects"))


@register("SELECT involved_groups, cross_score FROM crs", SCORED)
def cross_score(spark, d):
    c = classified_once(spark, d, "involved", "involved_groups", "is_cross_group")
    return Z.cross_scores(c, Z.distance_matrix(c))


@register("SELECT primary_group, level FROM mat", SCORED)
def materiality(spark, d):
    return Z.materiality(classified_once(spark, d, "primary_group", "abs_amount"))


@register(f"SELECT voucher, {R6('alpha')} AS alpha FROM alph", SCORED)
def alpha(spark, d):
    c = classified_once(spark, d, "voucher", "primary_group", "abs_amount")
    out = c.join(F.broadcast(Z.materiality(c)), "primary_group")
    return out.select("voucher", (F.rint(S.alpha(F.col("abs_amount").cast("double"), F.col("level")) * 1e6) / 1e6).alias("alpha"))


FINAL = "SELECT voucher, primary_group, involved_groups, CAST(abs_amount AS DOUBLE) AS amount, level, cross_score, inner_score, final_score, anomaly_type, risk_level FROM s"


def _final(df: DataFrame) -> DataFrame:
    return df.select("voucher", "primary_group", "involved_groups", F.col("abs_amount").cast("double").alias("amount"), "level", "cross_score", "inner_score", "final_score", "anomaly_type", "risk_level")


@register(FINAL, SCORED)
def detect_anomalies(spark, d):
    return _final(scored(spark, d))


@register("SELECT voucher, feature, primary_group, involved_groups, anomaly_type, final_score FROM s WHERE contains(risk_level, '高风险') ORDER BY voucher LIMIT 10", SCORED)
def high_risk_details(spark, d):
    """The ten high-risk vouchers that a report opens with."""
    return Z.high_risk(scored(spark, d)).select("voucher", "feature", "primary_group", "involved_groups", "anomaly_type", "final_score")


@register("SELECT voucher, string_agg(subject, ', ' ORDER BY line_no) AS subjects, any_value(feature) AS feature FROM lines JOIN (SELECT voucher, feature FROM v ORDER BY voucher LIMIT 5) USING (voucher) GROUP BY voucher", LINES)
def sample_vouchers(spark, d):
    """Five vouchers with their subjects, to check features by hand."""
    return V.samples(lines(spark, d))


@register("SELECT feature, primary_group, involved_groups, CASE WHEN is_cross_group THEN '是' ELSE '否' END AS cross_group, count(*) AS n_vouchers FROM c GROUP BY ALL ORDER BY n_vouchers DESC, feature LIMIT 100", GROUPED)
def feature_detail_head(spark, d):
    """The hundred most frequent features, as the page lists them."""
    return C.feature_detail_head(classified(spark, d))


@register(FINAL + " WHERE starts_with(risk_level, '高') OR starts_with(risk_level, '中风险')", SCORED)
def risk_filter(spark, d):
    return _final(scored(spark, d).where(F.col("risk_level").isin("高风险 🔴", "中风险 🟠")))


@register("SELECT risk_level, count(*) AS n FROM s GROUP BY 1", SCORED)
def risk_level(spark, d):
    return scored(spark, d).groupBy("risk_level").agg(F.count("*").alias("n"))


@register("SELECT anomaly_type, count(*) AS n FROM s GROUP BY 1", SCORED)
def type_distribution(spark, d):
    return scored(spark, d).groupBy("anomaly_type").agg(F.count("*").alias("n"))


@register("SELECT voucher, cross_score > 0 AS crosses, inner_score > 0 AS rare, anomaly_type FROM s", SCORED)
def anomaly_type(spark, d):
    return scored(spark, d).select("voucher", (F.col("cross_score") > 0).alias("crosses"), (F.col("inner_score") > 0).alias("rare"), "anomaly_type")


@register("SELECT voucher AS 凭证, primary_group AS 主群, cross_score AS 跨模块得分, inner_score AS 模块内得分, final_score AS 综合得分, level AS 重要性水平, CAST(abs_amount AS DOUBLE) AS 凭证金额, anomaly_type AS 异常类型, risk_level AS 风险等级 FROM s", SCORED)
def anomaly_export(spark, d):
    names = {"voucher": "凭证", "primary_group": "主群", "cross_score": "跨模块得分", "inner_score": "模块内得分", "final_score": "综合得分", "level": "重要性水平", "amount": "凭证金额", "anomaly_type": "异常类型", "risk_level": "风险等级"}
    return _final(scored(spark, d)).drop("involved_groups").withColumnsRenamed(names)


@register(f"SELECT count(*) AS total_vouchers, count(*) FILTER (contains(risk_level, '高风险')) AS high_risk, count(*) FILTER (contains(risk_level, '中风险')) AS medium_risk, count(*) FILTER (contains(risk_level, '低风险')) AS low_risk, count(*) FILTER (contains(risk_level, '正常')) AS normal, count(*) FILTER (contains(anomaly_type, '跨模块')) AS cross_group, {R2('CAST(sum(CAST(final_score AS DECIMAL(20,2))) AS DOUBLE) / count(*)')} AS avg_score, max(final_score) AS max_score FROM s", SCORED)
def anomaly_summary(spark, d):
    return Z.anomaly_summary(scored(spark, d))


@register(f"SELECT primary_group, {R2('CAST(sum(CAST(final_score AS DECIMAL(20,2))) AS DOUBLE) / count(*)')} AS mean_score, max(final_score) AS max_score, count(*) AS n_vouchers, count(*) FILTER (is_cross_group) AS n_cross FROM s GROUP BY 1", SCORED)
def group_stats(spark, d):
    return Z.group_stats(scored(spark, d))


@register("SELECT CAST(CASE WHEN m > 0 THEN least(floor(final_score * 50 / m), 49) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM s, (SELECT max(final_score) AS m FROM s) GROUP BY 1", SCORED)
def score_histogram(spark, d):
    return Z.score_histogram(scored(spark, d))


@register(
    f"SELECT *, {R6('coalesce(n_excluded / nullif(n_vouchers, 0), 0)')} AS excluded_share, {R6('coalesce(excluded_amount / nullif(amount, 0), 0)')} AS excluded_amount_share FROM ("
    "SELECT primary_group, CASE WHEN primary_group IS NOT NULL THEN max(level) END AS level, count(*) AS n_vouchers, CAST(sum(abs_amount) AS DOUBLE) AS amount, count(*) FILTER (abs_amount < level) AS n_excluded, "
    "coalesce(CAST(sum(abs_amount) FILTER (abs_amount < level) AS DOUBLE), 0) AS excluded_amount, coalesce(CAST(sum(debit_sum) FILTER (abs_amount < level) AS DOUBLE), 0) AS excluded_debit "
    "FROM c JOIN mat USING (primary_group) GROUP BY ROLLUP (primary_group))",
    SCORED,
)
def materiality_preview(spark, d):
    return Z.materiality_preview(classified_once(spark, d, "primary_group", "abs_amount", "debit_sum"))


def grouped_lines(spark, d) -> DataFrame:
    journal = written(lines(spark, d).select("voucher", "line_no", "subject", "debit", "credit"), "lines")
    of = C.classify(V.business_vouchers(journal)).select("voucher", "primary_group")
    return V.with_counter_subjects(journal).join(of, "voucher")


def edges_once(spark, d) -> DataFrame:
    return written(G.edges(grouped_lines(spark, d)), "edges")


@register("SELECT primary_group, src, dst, CAST(weight AS BIGINT) AS weight, n_vouchers, width, opacity FROM e", SCORED)
def graph_edges(spark, d):
    return G.edges(grouped_lines(spark, d))


@register(
    f", {CATEGORY}, ends AS (SELECT primary_group, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT primary_group, dst, 1, 0 FROM e) SELECT primary_group, node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, CAST(length(node) * 15 + 36 AS INTEGER) AS width, coalesce(any_value(c), 'default') AS category FROM ends LEFT JOIN category ON node = w GROUP BY primary_group, node",
    SCORED,
)
def graph_nodes(spark, d):
    return G.nodes(edges_once(spark, d))


@register("SELECT primary_group, n_nodes, n_edges, flow FROM (SELECT primary_group, count(*) AS n_edges, CAST(sum(weight) AS BIGINT) AS flow FROM e GROUP BY 1) JOIN (SELECT primary_group, count(DISTINCT node) AS n_nodes FROM (SELECT primary_group, src AS node FROM e UNION ALL SELECT primary_group, dst FROM e) GROUP BY 1) USING (primary_group)", SCORED)
def graph_summary(spark, d):
    return G.summary(edges_once(spark, d))


# A walk of more steps than there are accounts reaches nothing new.
LEVELS = (
    SCORED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
nodes AS (SELECT primary_group, src AS node FROM e UNION SELECT primary_group, dst FROM e),
walk AS (
  SELECT primary_group, node, 0 AS level FROM nodes WHERE (primary_group, node) NOT IN (SELECT (primary_group, dst) FROM e)
  UNION
  SELECT e.primary_group, e.dst, level + 1 FROM walk JOIN e ON walk.primary_group = e.primary_group AND walk.node = e.src WHERE level < (SELECT max(n) FROM (SELECT count(*) AS n FROM nodes GROUP BY primary_group))),
near AS (SELECT primary_group, node, min(level) AS level FROM walk GROUP BY ALL),
lv AS (
  SELECT primary_group, node, level FROM near
  UNION ALL
  SELECT primary_group, node, coalesce((SELECT max(level) FROM near WHERE near.primary_group = r.primary_group), 0) + row_number() OVER (PARTITION BY primary_group ORDER BY node)
  FROM (SELECT * FROM nodes ANTI JOIN near USING (primary_group, node)) r)"""
)


@register("SELECT primary_group, node, CAST(level AS INTEGER) AS level FROM lv", LEVELS)
def graph_levels(spark, d):
    return G.levels(G.edges(grouped_lines(spark, d)))


@register(
    "SELECT primary_group, node, CAST(level AS INTEGER) AS level, CAST(level * 280 + 150 AS DOUBLE) AS x, (count(*) OVER (PARTITION BY primary_group, level) - 1) * 44.0::DOUBLE - (row_number() OVER (PARTITION BY primary_group, level ORDER BY node) - 1) * 88.0::DOUBLE AS y FROM lv",
    LEVELS,
)
def graph_layout(spark, d):
    return G.layout(G.levels(G.edges(grouped_lines(spark, d))))


def queries() -> dict[str, Query]:
    from ledgerloom.plans import contra_catalog, upload_catalog  # noqa: F401  they register their queries here

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES
