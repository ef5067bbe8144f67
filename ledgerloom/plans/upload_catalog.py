"""Registered queries from an uploaded journal to results: the derived journal is written as CSV with the headers of an accounting program, and read back as text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import classify as C
from ledgerloom.operators import contra, report, solver
from ledgerloom.operators import scoring as Z
from ledgerloom.operators import vouchers as V
from ledgerloom.plans.catalog import lines, register
from ledgerloom.plans.contra_catalog import REPORT_PARTS, REPORT_SELECT, chosen_of, once, vouchers_once, without_large
from ledgerloom.plans.oracle import CONTRA, LINES, SCORED
from ledgerloom.plans.search_oracle import SEARCH
from ledgerloom.shared import shared_folder, written
from ledgerloom.sources import journal as J


def uploaded(spark, d, as_text: bool = True) -> DataFrame:
    """The whole journal as somebody would upload it, all text or with inferred types."""
    path = f"{shared_folder(spark)}/tables/journal-{uuid.uuid4().hex}.csv"
    names = {"date": "制单日期", "number": "凭证编号", "line_no": "行号", "summary": "摘要", "subject": "一级科目", "debit": "借方金额", "credit": "贷方金额", "note": "备注"}
    out = lines(spark, d).withColumns({"summary": F.concat(F.lit("摘要"), "subject"), "note": F.lit("n")})
    out.select(*(F.col(k).alias(v) for k, v in names.items())).write.csv(path, header=True)
    return J.read_csv(spark, path, as_text=as_text)


def _filled(df: DataFrame, found: list[tuple], names: str) -> DataFrame:
    """What was detected, with the number of values that each column holds."""
    counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in df.columns))
    held = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(f"`{c}`").alias("n_values")) for c in df.columns))).alias("h")).select("h.*")
    detected = df.sparkSession.createDataFrame(found, names)
    return detected.join(held, F.col("col") == F.col("of")).drop("of")


DETECTED = "SELECT t.*, (SELECT count(*) FROM lines) AS n_values FROM (VALUES {rows}) AS t({names})"


@register(DETECTED.format(names="name, col, confidence", rows="('date','制单日期','high'),('voucher_no','凭证编号','high'),('summary','摘要','high'),('first_level_subject','一级科目','high'),('subject_name','一级科目','medium'),('debit','借方金额','high'),('credit','贷方金额','high')"), LINES)
def detect_columns(spark, d):
    """The columns of the uploaded journal by the names of the anomaly analysis."""
    df = uploaded(spark, d)
    return _filled(df, [(k, *v) for k, v in J.detect_columns(df.columns).items()], "name string, col string, confidence string")


@register(DETECTED.format(names="name, col", rows="('date','制单日期'),('voucher_id','凭证编号'),('subject','一级科目'),('debit','借方金额'),('credit','贷方金额'),('summary','摘要')"), LINES)
def smart_detect(spark, d):
    """The columns of the uploaded journal by the names of the contra analysis."""
    df = uploaded(spark, d)
    return _filled(df, list(J.smart_detect(df.columns).items()), "name string, col string")


UPLOADED = "SELECT voucher, number, date, line_no, '摘要' || subject AS summary, subject, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit FROM lines"


@register(UPLOADED, LINES)
def uploaded_inferred_lines(spark, d):
    """uploaded_lines from a journal whose columns have inferred types: dates, whole numbers, amounts."""
    return uploaded_lines(spark, d, as_text=False)


@register(UPLOADED, LINES)
def uploaded_lines(spark, d, as_text: bool = True):
    amount = lambda c: F.col(c).cast("double").alias(c)
    return J.uploaded_lines(uploaded(spark, d, as_text)).select("voucher", "number", "date", F.col("source.`行号`").cast("long").alias("line_no"), "summary", "subject", amount("debit"), amount("credit"))


@register(
    "SELECT l.date AS 制单日期, l.number AS 凭证编号, CAST(l.line_no AS VARCHAR) AS 行号, '摘要' || l.subject AS 摘要, l.subject AS 一级科目, CAST(l.debit AS VARCHAR) AS 借方金额, CAST(l.credit AS VARCHAR) AS 贷方金额, 'n' AS 备注, "
    "voucher AS 凭证唯一ID, feature AS 会计分录特征, primary_group AS 主要业务群, involved_groups AS 涉及业务群, cross_score AS 跨模块得分, inner_score AS 模块内得分, round_even(alpha * 1e6, 0) / 1e6 AS α系数, final_score AS 综合得分, level AS 重要性水平, CAST(abs_amount AS DOUBLE) AS 凭证金额, anomaly_type AS 异常类型, risk_level AS 风险等级 "
    "FROM lines l JOIN s USING (voucher)",
    SCORED,
)
def uploaded_anomalies(spark, d):
    """Scores on every line of the uploaded journal, behind its own columns."""
    j = written(J.uploaded_lines(uploaded(spark, d)), "lines")
    out = report.scored_lines(j, Z.score(written(C.classify(V.business_vouchers(j)), "classified")))
    return out.withColumn("α系数", F.rint(F.col("α系数") * 1e6) / 1e6)


@register()
def uploaded_report(spark, d):
    """Contra accounts in the uploaded journal, with its own columns."""
    raw = uploaded(spark, d)
    j = written(J.contra_lines(raw), "lines")
    vouchers = vouchers_once(j)
    return report.final_report(j, chosen_of(contra.many_to_many(vouchers)), J.smart_detect(raw.columns), vouchers=vouchers)


@register(
    f"""{REPORT_PARTS}, rep AS ({REPORT_SELECT}),
seen AS (SELECT voucher, '摘要' || subject AS s, min(line_no) AS f FROM lines GROUP BY 1, 2),
meta AS (SELECT voucher, string_agg(s, ' | ' ORDER BY f) AS summary FROM seen GROUP BY 1)
SELECT l.date AS 制单日期, l.number AS 凭证编号, CASE WHEN virtual THEN '' ELSE CAST(line_no AS VARCHAR) END AS 行号, CASE WHEN virtual THEN summary ELSE '摘要' || l.subject END AS 摘要,
  rep.subject AS 一级科目, rep.debit AS 借方金额, rep.credit AS 贷方金额, contra AS 对方科目, CASE WHEN virtual THEN '' ELSE 'n' END AS 备注
FROM rep JOIN lines l USING (voucher, line_no) JOIN meta USING (voucher)""",
    SEARCH,
)
def uploaded_report_small(spark, d):
    """uploaded_report but for vouchers with more than three accounts a side in a search."""
    raw = uploaded(spark, d)
    journal = written(J.contra_lines(raw), "lines")
    vouchers, chosen = without_large(journal)
    return report.final_report(journal, chosen, J.smart_detect(raw.columns), vouchers=vouchers)


# What the report must add up to: raw amounts in vouchers that are not settled, the many side twice where the other is one account.
@register(
    ", part AS (SELECT l.number, structure, sum(l.debit) AS rd, sum(l.credit) AS rc, sum(cl.debit) AS d, sum(cl.credit) AS c, sum(CASE WHEN cl.debit = 0 THEN cl.credit ELSE 0 END) AS c1 "
    "FROM lines l JOIN cl USING (voucher, line_no) JOIN route USING (voucher) GROUP BY 1, 2) "
    "SELECT number, CAST(CASE WHEN structure IN ('empty', 'closing', 'fx') THEN rd WHEN structure = '1vN' THEN c ELSE d END AS DOUBLE) AS debit, "
    "CAST(CASE WHEN structure IN ('empty', 'closing', 'fx') THEN rc WHEN structure = '1v1' THEN c1 WHEN structure = 'Nv1' THEN d ELSE c END AS DOUBLE) AS credit FROM part",
    CONTRA,
)
def uploaded_report_totals(spark, d):
    """Debits and credits of every voucher in uploaded_report."""
    total = lambda c, name: F.sum(c).cast("decimal(18,2)").cast("double").alias(name)
    return uploaded_report(spark, d).groupBy(F.col("凭证编号").alias("number")).agg(total("借方金额", "debit"), total("贷方金额", "credit"))


@register()
def plan_sheet(spark, d):
    """The plan table of the uploaded journal under the headers people mark plans in; every sample voucher is searched to the end."""
    vl = once(J.contra_lines(uploaded(spark, d)))
    patterns = contra.pattern_counts(vl)
    samples = vl.join(patterns.select(F.col("sample").alias("voucher")), "voucher", "left_semi")
    return report.plan_sheet(solver.plan_table(vl, solver.ranked(solver.solutions(samples, whole=True)), patterns))
