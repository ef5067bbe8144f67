"""Settings of the journal analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

JOIN = "、"
OTHER = "其他群"

# The vocabulary of each business group.
GROUP_WORDS = {
    "采购活动群": ["原材料", "半成品", "库存商品", "委托加工物资", "应付账款", "预付账款", "材料采购", "在途物资", "应付账款暂估", "材料采购过渡", "周转材料", "暂估应付账款", "材料成本差异"],
    "销售活动群": ["应收账款", "应收票据", "主营业务收入", "其他业务收入", "发出商品", "主营业务成本", "其他业务成本", "其他业务支出", "预收账款", "合同负债"],
    "薪酬活动群": ["应付职工薪酬", "应付工资", "应付福利费", "应付社会保险费", "应付住房公积金"],
    "生产活动群": ["生产成本", "制造费用", "劳务成本", "研发支出", "辅助生产成本", "基本生产成本", "废品损失", "停工损失"],
    "研发活动群": ["研发费用"],
    "长期资产群": ["固定资产", "在建工程", "工程物资", "无形资产", "长期待摊费用", "累计折旧", "固定资产清理", "累计摊销", "无形资产减值准备", "固定资产减值准备", "在建工程减值准备", "工程结算", "使用权资产", "租赁负债", "长期股权投资", "投资性房地产", "使用权资产累计折旧"],
    "资金活动群": ["短期借款", "长期借款", "应付利息", "交易性金融资产", "投资收益", "应收利息", "应付股利", "应收股利", "实收资本", "资本公积", "盈余公积", "未分配利润"],
    "税务活动群": ["应交税费", "应交增值税", "应交消费税", "应交所得税", "应交城市维护建设税", "应交教育费附加", "应交地方教育费附加", "未交增值税", "待抵扣进项税额", "待认证进项税额", "进项税额转出", "出口退税", "税金及附加"],
}
# Groups that one word decides, in order of precedence; groups that need two words; words that say nothing.
CHARACTERISTIC = ["薪酬活动群", "研发活动群", "长期资产群", "生产活动群", "资金活动群", "税务活动群"]
ANCHOR = ["采购活动群", "销售活动群"]
STOP_WORDS = ["银行存款", "库存现金", "其他货币资金", "其他应付款", "其他应收款", "本年利润", "利润分配", "以前年度损益调整", "待处理财产损溢"]

# Closing vouchers, exchange differences, sensitive accounts, accounts that should not be split.
CLOSING = ["本年利润", "利润分配"]
CLOSING_SUBJECT = "本年利润"
FX_SUBJECT = "财务费用"
FX_CONTRA = "汇兑损益调整对象"
FX_OPERATING = ["管理费用", "销售费用", "研发费用", "制造费用", "生产成本", "主营业务成本", "其他业务成本", "主营业务收入", "其他业务收入", "营业收入", "营业成本"]
FX_MONETARY = ["应收", "应付", "预收", "预付", "借款", "现金"]
FX_EXCLUDED = ["应付职工", "应交税", "应付股", "应付利"]
SENSITIVE = ["银行", "现金", "Bank", "Cash", "支付宝", "微信"]
HARD_BONES = ["应交税费"]
SUFFIXES = "费款金产入本利"
INVALID, UNSOLVED = "无效分录", "需人工分析(无解)"
#: A search that its budget ended before it found or ruled out a solution.
UNFINISHED = "需人工分析(未搜完)"

# Account categories.
CATEGORIES = {
    "asset": ["银行存款", "库存现金", "其他货币资金", "原材料", "半成品", "产成品", "库存商品", "周转材料", "委托加工物资", "发出商品", "材料采购过渡", "在途物资", "材料成本差异", "交易性金融资产", "应收票据", "应收账款", "预付账款", "其他应收款", "应收利息", "应收股利", "固定资产", "累计折旧", "固定资产清理", "在建工程", "工程物资", "无形资产", "累计摊销", "长期待摊费用", "待处理财产损溢", "存货跌价准备", "固定资产减值准备", "无形资产减值准备", "长期股权投资", "投资性房地产", "使用权资产", "使用权资产累计折旧", "长期应收款"],
    "liability": ["应付账款", "应付票据", "其他应付款", "应付账款暂估", "暂估应付账款", "预收账款", "合同负债", "应付职工薪酬", "应付工资", "应付福利费", "应付社会保险费", "应付住房公积金", "应交税费", "应交增值税", "应交消费税", "应交所得税", "应交城市维护建设税", "应交教育费附加", "应交地方教育费附加", "未交增值税", "待抵扣进项税额", "待认证进项税额", "应付利息", "应付股利", "短期借款", "长期借款", "长期应付款", "预计负债", "递延收益", "租赁负债"],
    "expense": ["管理费用", "销售费用", "财务费用", "研发费用", "税金及附加", "业务招待费", "差旅费", "办公费", "折旧费", "摊销费", "维修费", "水电费", "通讯费", "培训费", "广告费", "运输费", "装卸费", "包装费", "展览费", "租赁费", "利息支出", "手续费", "汇兑损益", "资产减值损失", "信用减值损失"],
    "cost": ["主营业务成本", "其他业务成本", "其他业务支出", "生产成本", "制造费用", "劳务成本", "基本生产成本", "辅助生产成本", "废品损失", "停工损失", "开发支出"],
    "revenue": ["主营业务收入", "其他业务收入", "投资收益", "公允价值变动损益", "营业外收入", "其他收益", "补贴收入", "租赁收入"],
}


@dataclass(frozen=True)
class Settings:
    """What a caller may change; the defaults are those of the registered queries."""

    group_words: dict[str, list[str]] = field(default_factory=lambda: GROUP_WORDS)
    stop_words: list[str] = field(default_factory=lambda: STOP_WORDS)
    pareto: float = 0.95
    rare_share: float = 0.01
    slope: float = 5.36
    other_penalty: float = 20.0
    top_score: float = 100.0


DEFAULT = Settings()
