"""Journals: a column mapping, canonical lines, and a journal derived from the order tables.

Canonical lines: voucher, number, dt, line_no, subject, debit, credit (decimal(18,2)), and whatever else the source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

# Accepted column names for each standard name.
COLUMN_NAMES = {
    "date": ["制单日期", "记账日期", "日期", "date", "voucher_date", "会计日期", "凭证日期"],
    "month": ["月份", "month", "会计期间", "期间"],
    "voucher_no": ["编号", "凭证编号", "凭证号", "voucher_no", "voucher_number", "凭证字号"],
    "summary": ["摘要", "摘要内容", "summary", "description", "业务摘要"],
    "subject_code": ["科目编码", "科目代码", "subject_code", "account_code", "科目号"],
    "first_level_subject": ["一级科目", "first_level_subject", "一级科目名称", "总账科目"],
    "subject_name": ["科目名称", "科目", "subject_name", "account_name", "会计科目"],
    "counter_subject": ["对方科目", "counter_subject", "对方科目名称", "对应科目"],
    "currency": ["币种", "货币", "currency"],
    "original_amount": ["原币金额", "外币金额", "original_amount"],
    "debit": ["借方金额", "借方", "debit", "debit_amount", "借方发生额", "借"],
    "credit": ["贷方金额", "贷方", "credit", "credit_amount", "贷方发生额", "贷"],
}
# Parts of column names, tried in order, for the contra analysis.
COLUMN_PARTS = {
    "date": [["制单日期", "记账日期", "凭证日期", "日期", "date", "time"], ["年", "月", "日"]],
    "voucher_id": [["凭证号", "凭证编号", "voucher", "单号", "记字号", "凭证字号"]],
    "subject": [["一级科目", "subject", "会计科目"]],
    "detail_subject": [["科目明细", "明细科目", "科目名称", "明细", "辅助核算"]],
    "debit": [["借方金额", "借方", "debit", "借", "debit_amount"]],
    "credit": [["贷方金额", "贷方", "credit", "贷", "credit_amount"]],
    "summary": [["摘要", "说明", "summary", "备注", "附注"]],
}


def detect_columns(columns: list[str]) -> dict[str, tuple[str, str]]:
    """standard name -> (column, confidence): high for an accepted name, else medium for the first column that contains one or lies in one."""
    found = {}
    for name, accepted in COLUMN_NAMES.items():
        exact = next((c for c in columns if c in accepted), None)
        close = next((c for c in columns if any(a in c or c in a for a in accepted)), None)
        if exact is not None:
            found[name] = (exact, "high")
        elif close is not None:
            found[name] = (close, "medium")
    return found


def smart_detect(columns: list[str]) -> dict[str, str]:
    """standard name -> first column that holds a known part, whatever its case; details never repeat the subject column."""
    found: dict[str, str] = {}
    for name, tiers in COLUMN_PARTS.items():
        for parts in tiers:
            fits = [c for c in columns if any(p.lower() in c.lower() for p in parts) and not (name == "detail_subject" and c == found.get("subject"))]
            if fits:
                found[name] = fits[0]
                break
    return found


def read_csv(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    """A CSV journal with header; types inferred, or all text."""
    return spark.read.csv(path, header=True, inferSchema=not as_text, multiLine=True, escape='"')


def canonical(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Lines for the anomaly analysis; original columns are kept. Missing amounts are 0, missing subjects empty, a missing number is the row's own."""
    col = lambda name: F.col(f"`{mapping[name]}`") if mapping.get(name) in df.columns else None
    text = lambda name: F.lit("") if col(name) is None else col(name)
    subject = S.normalize_subject(col("first_level_subject")) if col("first_level_subject") is not None else S.first_level_subject(text("subject_name"))
    row = F.monotonically_increasing_id()
    number = row.cast("string") if col("voucher_no") is None else col("voucher_no").cast("string")
    amount = lambda name: S.format_amount(text(name)).cast("decimal(18,2)")
    counter = F.lit(None).cast("string") if col("counter_subject") is None else F.coalesce(S.strip(col("counter_subject").cast("string")), F.lit(""))
    return df.select(
        *(F.col(f"`{c}`") for c in df.columns),
        S.voucher_id(F.lit(None).cast("string") if col("date") is None else col("date"), number).alias("voucher"),
        row.alias("line_no"),
        subject.alias("subject"),
        amount("debit").alias("debit_amount"),
        amount("credit").alias("credit_amount"),
        counter.alias("given_counter"),
    )


def _source(df: DataFrame) -> Column:
    """All original columns as one struct, so that no name of theirs clashes with ours."""
    return F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns)).alias("source")


def uploaded_lines(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Lines that the anomaly operators read, from an uploaded journal; its own columns travel in `source`.

    The mapping (standard name -> column) is detected where it is not given. A voucher without a date is known by its
    number, without a number by its row. given_counter is there only if the journal has contra accounts of its own. line_no
    is the order of the rows in the files.
    """
    mapping = {k: c for k, (c, _) in detect_columns(df.columns).items()} if mapping is None else mapping
    col = lambda name: F.col(f"source.`{mapping[name]}`") if mapping.get(name) in df.columns else None
    empty = F.lit(None).cast("string")
    text = lambda name: empty if col(name) is None else col(name).cast("string")
    amount = lambda name: S.format_amount(text(name)).cast("decimal(18,2)").alias(name)
    subject = S.first_level_subject(text("subject_name")) if col("first_level_subject") is None else S.normalize_subject(text("first_level_subject"))
    number = F.col("line_no").cast("string") if col("voucher_no") is None else text("voucher_no")
    counter = [] if col("counter_subject") is None else [S.normalize_subject(text("counter_subject")).alias("given_counter")]
    rows = df.select(_source(df), F.monotonically_increasing_id().alias("line_no"))
    return rows.select(
        "source",
        S.voucher_id(text("date"), number).alias("voucher"),
        number.alias("number"),
        text("date").alias("date"),
        "line_no",
        F.coalesce(text("summary"), F.lit("")).alias("summary"),
        subject.alias("subject"),
        amount("debit"),
        amount("credit"),
        *counter,
    )


def contra_lines(df: DataFrame, mapping: dict[str, str] | None = None, strip_commas: bool = False) -> DataFrame:
    """Lines that the contra operators read, from an uploaded journal: vouchers keep their day, amounts two decimals, and text with separators is 0 unless strip_commas. The mapping has to know date, voucher_id, subject, debit and credit."""
    mapping = smart_detect(df.columns) if mapping is None else mapping
    missing = [name for name in ("date", "voucher_id", "subject", "debit", "credit") if mapping.get(name) not in df.columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    text = lambda name: F.col(f"source.`{mapping[name]}`").cast("string") if mapping.get(name) in df.columns else F.lit(None).cast("string")
    amount = lambda name: S.contra_amount(text(name), strip_commas).cast("decimal(18,2)").alias(name)
    return df.select(_source(df), F.monotonically_increasing_id().alias("line_no")).select(
        "source",
        S.contra_uid(text("date"), text("voucher_id")).alias("voucher"),
        text("voucher_id").alias("number"),
        text("date").alias("date"),
        "line_no",
        text("summary").alias("summary"),
        F.coalesce(S.strip(text("subject")), F.lit("nan")).alias("subject"),
        amount("debit"),
        amount("credit"),
    )


# Accounts of the journal that is derived from orders and line items, by template and slot, and the accounts that balance it.
SUBJECTS = [
    ["原材料", "应交税费", "应付账款", "库存商品"],
    ["应收账款", "主营业务收入", "合同负债", "应收票据"],
    ["管理费用", "应付职工薪酬", "制造费用", "销售费用"],
    ["生产成本", "制造费用", "原材料", "库存商品"],
    ["研发费用", "银行存款", "管理费用", "原材料"],
    ["固定资产", "累计折旧", "在建工程", "银行存款"],
    ["应收账款", "应付账款", "预付账款", "短期借款"],
    ["应交税费", "税金及附加", "银行存款", "库存现金"],
    ["其他应收款", "其他应付款", "管理费用", "银行存款"],
    ["本年利润", "主营业务收入", "管理费用", "主营业务成本"],
]
BALANCES = ["应付账款", "应收账款", "应付职工薪酬", "生产成本", "银行存款", "银行存款", "财务费用", "银行存款", "银行存款", "本年利润"]
BALANCE_LINE = 999
#: The same journal as SQL, for the oracles.
JOURNAL_CTE = f"""
WITH subj_map AS (SELECT * FROM (VALUES {", ".join(f"({t},{n},'{x}')" for t, names in enumerate(SUBJECTS) for n, x in enumerate(names))}) AS t(tpl,slot,subj)),
bal_map AS (SELECT * FROM (VALUES {", ".join(f"({t},'{x}')" for t, x in enumerate(BALANCES))}) AS t(tpl,subj)),
src AS (SELECT o_orderkey AS k, o_orderdate AS dt, CAST(o_custkey % 10 AS INT) AS ctpl,
  (o_orderpriority = '5-LOW' AND o_custkey % 3 = 0) AS one_sided,
  CAST(CASE WHEN l_suppkey % 25 = 0 THEN floor((l_partkey % 40) / 4) ELSE o_custkey % 10 END AS INT) AS tpl,
  CAST(l_partkey % 4 AS INT) AS slot, l_linenumber % 2 = 1 AS is_d,
  CAST(CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amt,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ln AS (SELECT k, dt, ctpl, one_sided, line_no, subj,
  CASE WHEN is_d OR one_sided THEN amt ELSE CAST(0 AS DECIMAL(18,2)) END AS debit,
  CASE WHEN is_d OR one_sided THEN CAST(0 AS DECIMAL(18,2)) ELSE amt END AS credit
  FROM src JOIN subj_map ON src.tpl = subj_map.tpl AND src.slot = subj_map.slot),
net AS (SELECT k, dt, ctpl, one_sided, CAST(sum(debit) - sum(credit) AS DECIMAL(18,2)) AS net FROM ln GROUP BY k, dt, ctpl, one_sided),
journal AS (
  SELECT k, dt, line_no, subj, debit, credit FROM ln
  UNION ALL
  SELECT k, dt, {BALANCE_LINE} AS line_no, bal_map.subj,
   CASE WHEN one_sided OR net < 0 THEN -net ELSE CAST(0 AS DECIMAL(18,2)) END,
   CASE WHEN one_sided OR net < 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE net END
  FROM net JOIN bal_map ON net.ctpl = bal_map.tpl WHERE net <> 0)
"""


def order_journal(spark: SparkSession, sf_dir: str, of_order: dict[str, Column] | None = None, in_order: bool = True) -> DataFrame:
    """k, dt, line_no, subj, debit, credit: every order a voucher, every line item an entry, and one that balances it. Columns of_order, from k and dt, are computed once for an order.

    One shuffle by order; a window numbers an order's items and sums them, and its last item brings the balancing entry, so lines come out in order.
    Where lines need no numbers (in_order false: line_no is missing), items are not sorted within their order, and of them only what decides over the entry is shuffled.
    """
    item, order = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    money, zero = "decimal(18,2)", F.lit(0).cast("decimal(18,2)")
    own = F.col("o_custkey") % 10
    one_sided = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 3 == 0)
    fixed = F.when(F.col("l_suppkey") % 25 == 0, F.floor((F.col("l_partkey") % 40) / 4)).cast("int")
    amount = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5), -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast(money)
    places = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"] if in_order else []
    of_item = {"on_debit": F.col("l_linenumber") % 2 == 1, "of_own": ~F.coalesce(F.col("l_suppkey") % 25 == 0, F.lit(False)), "fixed": fixed, "slot": (F.col("l_partkey") % 4).cast("int"), "amount": amount}
    names = F.array(*(F.array(*map(F.lit, row)) for row in SUBJECTS))
    orders = order.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("dt"), own.alias("own"), one_sided.alias("one_sided")).withColumns(of_order or {})
    items = item.select("l_orderkey", *places, *(x.alias(name) for name, x in of_item.items()))
    joined = items.join(orders, F.col("l_orderkey") == F.col("k")).withColumn("template", F.when(F.col("of_own"), F.col("own").cast("int")).otherwise(F.col("fixed")))
    debit = F.col("on_debit") | F.col("one_sided")
    subject = F.get(F.get(names, F.col("template")), F.col("slot"))
    entries = joined.withColumns({"subj": subject, "debit": F.when(debit, F.col("amount")).otherwise(zero), "credit": F.when(debit, zero).otherwise(F.col("amount"))})
    by_order = Window.partitionBy("k", "dt", "own", "one_sided").orderBy(*([*places, "template", "slot", "amount"] if in_order else ["k"]))
    difference = F.when(F.col("subj").isNotNull(), F.col("debit") - F.col("credit"))
    every = by_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lined = entries.withColumns({"line_no": F.row_number().over(by_order).cast("long"), "n": F.count("*").over(every), "net": F.sum(difference).over(every).cast(money)})
    balance_on_debit = F.col("one_sided") | (F.col("net") < 0)
    number = ["line_no"] if in_order else []
    balance = F.struct(*(F.lit(BALANCE_LINE).cast("long").alias(x) for x in number), F.get(F.array(*map(F.lit, BALANCES)), F.col("own").cast("int")).alias("subj"), F.when(balance_on_debit, -F.col("net")).otherwise(zero).cast(money).alias("debit"), F.when(balance_on_debit, zero).otherwise(F.col("net")).cast(money).alias("credit"))
    line = F.struct(*number, "subj", "debit", "credit")
    last, known = (F.col("line_no") == F.col("n")) & (F.col("net") != 0), F.col("subj").isNotNull()
    # items of no known account go; the balancing entry stays
    with_balance = F.when(last & known, F.array(line, balance)).when(last, F.array(balance)).when(known, F.array(line))
    return lined.select("k", "dt", *(of_order or {}), F.explode(with_balance).alias("l")).select("k", "dt", *(of_order or {}), "l.*")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines of the derived journal."""
    number, date = F.concat(F.lit("记-"), F.lpad(F.col("k").cast("string"), 6, "0")), F.date_format("dt", "yyyy-MM-dd")
    j = order_journal(spark, sf_dir, {"voucher": S.voucher_id(date, number), "number": number, "date": date})
    return j.select("voucher", "number", "date", "line_no", F.col("subj").alias("subject"), "debit", "credit")


def order_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voucher, subject, debit and credit of order_lines(), without what tells the lines of a voucher apart: for sums and sets by voucher."""
    number, date = F.concat(F.lit("记-"), F.lpad(F.col("k").cast("string"), 6, "0")), F.date_format("dt", "yyyy-MM-dd")
    j = order_journal(spark, sf_dir, {"voucher": S.voucher_id(date, number)}, in_order=False)
    return j.select("voucher", F.col("subj").alias("subject"), "debit", "credit")
