"""Word lists and rule weights of the interaction scorers.

Everything that looks at words takes a :class:`Lexicon`, so a deployment can
swap language or domain without touching an operator.  The defaults below are
the values published results depend on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Word lists, groups and weights that results depend on.
# ---------------------------------------------------------------------------

FOLLOWUP_CUES = tuple("""
    为什么 为何 原因 具体 进一步 继续 上述 前述 这个 这些 该 是否 如何 能否 请问
    说明 解释 补充 详细 多久 什么时候 何时 多少 吗 呢
""".split())

ANSWER_COMPLAINT_CUES = tuple("""
    没回话 没回复 没回答 不回答 未回答 没有回答 不送出 回答我的问题 回答问题 选择性
    效率太低 还没开始
""".split())

VAGUE_ANSWER_CUES = tuple("""
    积极 努力 持续 稳步 进一步 未来 后续 视情况 根据情况 暂不 暂无 不便 请关注
    以公告为准 相关规定 正常推进
""".split())

STRONG_SHIFT_CUES = tuple("""
    换个话题 换个问题 换一个问题 换个角度 换个说法 换一个 换下一个 换一件事 换一个话题
    换个别的问题 换个别的话题 另一个问题 另外一个问题 另外一个 另一个事 另一个话题
    另外想问 另外请问 另外问一下 另问 另请问 另请教 另起一个 顺便问一下 顺便再问
    顺手问一下 顺便问个别的 顺便再请教 再问一个 再问一下 再问点别的 再请问 再请教一个
    还有一个问题 还有个问题 还有个事 还有一件事 还有别的问题 我再问一个 我还想问 我另问
    我再请问 无关 跑题 偏题 答非所问 不相关 与此无关 与这个无关 跟这个无关
    这不是我想问的 新问题 另一个点 别的问题 其他问题
""".split())

SOFT_SHIFT_CUES = tuple("""
    另外 此外 顺便 另请问 请问另外 再请问 请教一下 我还想问 我再问一下 还有个想问
    另外我想问 再补充问 再追问一下
""".split())

QUESTION_CUES = tuple("""
    为什么 为何 如何 怎样 是否 有没有 可不可以 能否 什么 多少
""".split())

ANSWER_UNSATISFIED_TERMS = tuple("""
    感谢关注 谢谢 请关注 关注公告 以公告为准 以公司公告为准 详见公告 后续公告 及时公告
    信息披露 不便评价 无法评价 无法判断 按规定 按要求 会努力 努力工作 持续关注
""".split())

PRESSURE_TERMS = tuple("""
    请正面回答 正面回答 明确回答 请回答 为什么不回答 为何不回答 为何不披露 为什么不披露
    绕弯子 言之无物 外交辞令 敷衍 漠视 知情权 隐瞒 忽悠 欺骗 遮遮掩掩 到底 问责
    解释一下 给明确回答 给个明确 给个明确的回答 明确的回答 请明确 作解释 请作解释
    作下解释 下解释 作出解释 做出解释 请您明确回答 回答我的两个问题 请回答我的两个问题
    正面回应 请正面回应 直面回答 从不直面回答 不要回避 明确目标 明确的目标
""".split())

EXPLAIN_ONLY_TERMS = tuple("""
    解释一下 说明一下 请说明 说一下 介绍一下 讲一下 具体说说 具体说明 具体介绍 详细说明
    详细介绍 详细讲讲 具体讲讲 请讲 请介绍
""".split())

CLAIM_TERMS = tuple("""
    因为 由于 主要原因 原因 预计 将会 正在 已经 不存在 不会影响 公司认为 公司将
    我们会 正在推进 进展顺利 积极推进 及时披露 严格按照
""".split())

CHALLENGE_TERMS = tuple("""
    为何 为什么 难道 但是 可是 实际上 是否说明 是否存在 是不是 怎么解释 解释原因
    原因是什么 出了什么问题 不作披露 不披露 拖延 承诺 兑现 质疑
""".split())

EVIDENCE_TERMS = tuple("""
    公告 媒体 报道 数据显示 年报 一季报 半年报 财报 证监会 交易所 药监局 批件 临床
    项目延期 亏损 减值 处罚 诉讼
""".split())

FOLLOWUP_ACTION_TERMS = tuple("""
    为什么 为何 原因 怎么解释 具体 详细 多少 哪些 何时 什么时候 是否 能否 有没有
    怎么样 如何 进展 进度 影响 贡献 带来 体现 正常 异常 改善 措施 计划 目标 方向
    规划 打算 态度 建议 障碍 限制 承诺 兑现 属实
""".split())

REFERENCE_TERMS = tuple("""
    上述 前述 刚才 该 这个 这些 此 对此 基于 既然
""".split())

ANSWER_STATE_TERMS = tuple("""
    尚未 未 没有 不确定 存在不确定性 正在 将会 会 计划 预计 努力 有信心 有希望 需
    需要 须 办理 办理中 审批 批准 核准 推进 进展 及时披露 后续公告 关注公告
    以公告为准
""".split())

COMMITMENT_TERMS = tuple("""
    承诺 不进行 不会 没有 不存在 严格按照 及时履行 及时披露 目标 规划 方向
""".split())

CONTINUATION_TERMS = tuple("""
    为什么 为何 原因 怎么解释 是否因为 是否说明 进展 进度 何时 什么时候 是否完成 能否
    是否 具体 详细 多少 哪些 如何 影响 好处 限制 障碍 困难 态度 规划 目标 方向
    申请 临床试验 继续投入 暂停 开业 兑现 承诺
""".split())

CONCRETE_OBJECT_TERMS = tuple("""
    智能卡 智能卡基材 基材 PVC pvc 原油 石油 树脂 品级 汇率 扇贝 虾夷扇贝 浮筏
    海参 鲍鱼 棉花 天竹纤维 莫代尔 天丝纤维 重组 重大资产重组 重组方案 重组完成
    立案调查 结案 批准 证监会批准 中国证监会 摆脱困境 非公开发行 非公开发行股票 购买资产
    股票购买资产 增发 定增 不重组 六个月 6个月 限制 障碍 减持 承诺 高管 辞职 渠道
    宁波 分红 送股 现金流 负债 融资 抵押 海冰 自然灾害 风险控制 战略转型 调味品 蚝油
    盐碱地 土壤改良 PPP 通辽 燃油 燃油价格 石油涨价 原材料价格 运输费用 管理费用
    营业费用 费用增加 产品利润率 总收益 一季度亏损 亏损 散户 中小散户 煤炭 煤炭贸易
    资产注入 优质资产 收购优质资产 细分市场 市场占有率 智慧城市 智能建筑 世博会 世博
    合同 合同规模 送转 回报股东 太子参 党参 胶原蛋白 爱透 火透 凉茶 互联网医疗 大数据
    大健康 糖尿病医院 长沙医院 301医院 替芬泰 Y101 临床批件 腾讯 慢性病中心
    卫计委 政府资金 补贴 苗药 糖宁通络 院内制剂 医疗制剂 黑笔事件 高管辞职 管理层
    房产公司 房地产投资 江苏国信 国信资产 江苏省房地产 借壳 专心 发展规划 发展方向
    明确方向 项目规划 投资建设 对外投资 下一步发展 产品规划 产品定位 凉茶产品
    医疗机构制剂 执业许可证 临床试验 糖尿病 糖尿病医院 虎耳草 山银花 云南白药 合作项目
""".split())

OBJECT_STOPWORDS = tuple("""
    公司 请问 您好 谢谢 贵公司 董事长 投资者 股东 问题 回答 情况 目前 未来 方面
    具体 是否 能否 为什么 原因 如何 哪些 多少 什么 项目 业务 产品 市场 同行业 发展
    经营 正常 投资 收益 盈利 能力 盈利能力 增长 业绩 第一 主要 公司的 公司有
    有限公司 股份有限公司 公告 披露
""".split())

EVENT_GROUPS = {
    "project_capacity": tuple("""
        募投 募集资金 项目 投产 达产 产能 扩产 生产线 建设 开业 落地 推进 进展
    """.split()),
    "performance_growth": tuple("""
        收入 营收 销售 利润 净利润 业绩 增长 成长 毛利 毛利率 贡献 盈利 效益
    """.split()),
    "market_order_price": tuple("""
        订单 市场 客户 销售 价格 涨价 降价 需求 竞争 份额 渠道 推广
    """.split()),
    "cost_margin": tuple("""
        成本 原材料 毛利 毛利率 费用 管理费用 营业费用 运输费用 价格 涨价 亏损 一季度亏损
        减值 盈利能力
    """.split()),
    "product_rnd": tuple("""
        产品 新品 研发 临床 批件 审批 药品 制剂 医疗制剂 医疗机构制剂 院内制剂 技术
        商业化 医院 执业许可证 临床试验
    """.split()),
    "disclosure_process": tuple("""
        公告 披露 证监会 交易所 股东大会 审批 核准 上报 年报 一季报 半年报 进度
    """.split()),
    "capital_restructuring": tuple("""
        重组 资产重组 非公开发行 收购 股权 股东 增发 定增 注入 购买资产 资产购买 借壳
        不重组 限制 障碍
    """.split()),
    "development_strategy": tuple("""
        发展规划 发展方向 发展 规划 目标 方向 前景 主业 多元化 战略 转型 投资建设
        对外投资 项目规划
    """.split()),
    "shareholder_return": tuple("""
        分红 送股 送转 回报 市值 减持 承诺 提案 股东
    """.split()),
    "management_governance": tuple("""
        高管 辞职 管理层 董事 董事会 股东 散户 减持 投资行为
    """.split()),
}

INTENT_GROUPS = {
    "growth_profit_question": tuple("""
        成长性 增长点 利润 盈利 业绩 收入 营收 效益 贡献 每股收益 毛利 毛利率 回报
    """.split()),
    "progress_detail_question": tuple("""
        进展 进度 什么时候 何时 是否顺利 是否完成 能否 具体 哪些 多少 程序 审批 上报
        核准
    """.split()),
    "cause_explanation_question": tuple("""
        为什么 为何 原因 怎么解释 是否因为 是否说明 影响 困难 障碍 问题 亏损 费用 成本
    """.split()),
    "disclosure_detail_question": tuple("""
        披露 公告 知情权 详细 具体 数据 金额 合同 进展 是否属实
    """.split()),
    "commitment_challenge_question": tuple("""
        承诺 兑现 是否属实 是不是 难道 笔误 矛盾 拖延 不披露 质疑
    """.split()),
    "planning_question": tuple("""
        发展 规划 发展规划 发展方向 打算 目标 方向 前景 未来 下一步 计划 好处 态度
    """.split()),
    "capital_transaction_question": tuple("""
        重组 非公开发行 购买资产 资产购买 限制 障碍 区别 好处 借壳 完成 不重组
    """.split()),
    "shareholder_return_question": tuple("""
        分红 送股 送转 回报 市值 承诺 减持 提案 信心
    """.split()),
    "product_plan_question": tuple("""
        规划 定位 目标 产品 申请 临床试验 暂停 继续投入 开业 许可证 制剂
    """.split()),
}

BRIDGE_RULES = (
    ("project_capacity", "growth_profit_question", 0.28),
    ("project_capacity", "progress_detail_question", 0.3),
    ("performance_growth", "growth_profit_question", 0.22),
    ("performance_growth", "cause_explanation_question", 0.24),
    ("market_order_price", "growth_profit_question", 0.22),
    ("market_order_price", "cause_explanation_question", 0.24),
    ("cost_margin", "growth_profit_question", 0.22),
    ("cost_margin", "cause_explanation_question", 0.26),
    ("product_rnd", "growth_profit_question", 0.2),
    ("product_rnd", "progress_detail_question", 0.28),
    ("disclosure_process", "progress_detail_question", 0.28),
    ("disclosure_process", "disclosure_detail_question", 0.3),
    ("disclosure_process", "capital_transaction_question", 0.26),
    ("capital_restructuring", "progress_detail_question", 0.32),
    ("capital_restructuring", "commitment_challenge_question", 0.3),
    ("capital_restructuring", "growth_profit_question", 0.26),
    ("capital_restructuring", "planning_question", 0.28),
    ("capital_restructuring", "capital_transaction_question", 0.34),
    ("development_strategy", "planning_question", 0.3),
    ("development_strategy", "growth_profit_question", 0.22),
    ("market_order_price", "planning_question", 0.2),
    ("cost_margin", "planning_question", 0.2),
    ("shareholder_return", "shareholder_return_question", 0.32),
    ("shareholder_return", "commitment_challenge_question", 0.26),
    ("management_governance", "commitment_challenge_question", 0.28),
    ("management_governance", "planning_question", 0.22),
    ("product_rnd", "product_plan_question", 0.32),
    ("product_rnd", "planning_question", 0.24),
)
TERM_STOPWORDS = tuple("""
    请问 您好 谢谢 你好 麻烦 一下 这个 那个 是否 如何 公司 董事长 董秘 请教 问题
""".split())

CONTINUATION_CUES = tuple("""
    继续 上述 前面 刚才 刚刚 同上 关于这个 这个问题
""".split())

NEW_TOPIC_CUES = tuple("""
    另外 另 再问 顺便 还有 新问题 换个 换一个
""".split())

SHORT_COMPLAINT_CUES = ("为什么", "怎么")

CAPACITY_ANCHOR_TERMS = ("产能增长", "产能", "投产", "达产", "募集资金项目")

CAPACITY_QUERY_TERMS = ("成长性", "增长点", "未来成长")

GENERIC_ANSWER_CUES = tuple("""
    谢谢 按照规定 按规定 正在研究 暂无计划 我们会 努力工作 持续 请关注 理性判断
    无法作出评价 不便回答
""".split())

ANCHOR_QUESTION_PREFIX = "前序问题："
ANCHOR_ANSWER_PREFIX = " 管理层回答："
CANDIDATE_PREFIX = "当前追问："

SALUTATION_PATTERNS = (
    "请问[^，。；;：:\\s]{1,8}[：:]",
    "请问[^，。；;：:\\s]{1,6}",
)

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """All word lists an operator may need, with the fixed values as defaults."""

    followup: Sequence[str] = FOLLOWUP_CUES
    complaint: Sequence[str] = ANSWER_COMPLAINT_CUES
    vague: Sequence[str] = VAGUE_ANSWER_CUES
    strong_shift: Sequence[str] = STRONG_SHIFT_CUES
    soft_shift: Sequence[str] = SOFT_SHIFT_CUES
    question: Sequence[str] = QUESTION_CUES
    continuation: Sequence[str] = CONTINUATION_CUES
    new_topic: Sequence[str] = NEW_TOPIC_CUES
    short_complaint: Sequence[str] = SHORT_COMPLAINT_CUES
    term_stopwords: Sequence[str] = TERM_STOPWORDS
    unsatisfied: Sequence[str] = ANSWER_UNSATISFIED_TERMS
    pressure: Sequence[str] = PRESSURE_TERMS
    explain_only: Sequence[str] = EXPLAIN_ONLY_TERMS
    claim: Sequence[str] = CLAIM_TERMS
    challenge: Sequence[str] = CHALLENGE_TERMS
    evidence: Sequence[str] = EVIDENCE_TERMS
    action: Sequence[str] = FOLLOWUP_ACTION_TERMS
    reference: Sequence[str] = REFERENCE_TERMS
    answer_state: Sequence[str] = ANSWER_STATE_TERMS
    commitment: Sequence[str] = COMMITMENT_TERMS
    continuation_need: Sequence[str] = CONTINUATION_TERMS
    capacity_anchor: Sequence[str] = CAPACITY_ANCHOR_TERMS
    capacity_query: Sequence[str] = CAPACITY_QUERY_TERMS
    objects: Sequence[str] = CONCRETE_OBJECT_TERMS
    object_stopwords: Sequence[str] = OBJECT_STOPWORDS
    generic_answer: Sequence[str] = GENERIC_ANSWER_CUES
    salutations: Sequence[str] = SALUTATION_PATTERNS
    events: Mapping[str, Sequence[str]] = field(default_factory=lambda: EVENT_GROUPS)
    intents: Mapping[str, Sequence[str]] = field(default_factory=lambda: INTENT_GROUPS)
    bridges: Sequence[tuple[str, str, float]] = BRIDGE_RULES
    growth_event: str = "project_capacity"
    growth_intent: str = "growth_profit_question"

    def object_vocabulary(self) -> list[str]:
        """Distinct object terms worth matching: two characters up, no stop word."""
        stop = set(self.object_stopwords)
        pool = [t for group in self.events.values() for t in group] + list(self.objects)
        return [t for t in dict.fromkeys(pool) if len(t) >= 2 and t not in stop]

    def channel_vocabulary(self) -> list[str]:
        """Every term an interaction channel looks for."""
        pools = [
            self.unsatisfied, self.pressure, self.explain_only, self.claim, self.challenge,
            self.evidence, self.action, self.reference, self.answer_state, self.commitment,
            self.continuation_need, self.capacity_anchor, self.capacity_query,
            *self.events.values(), *self.intents.values(),
        ]
        return list(dict.fromkeys(t for pool in pools for t in pool if t))


DEFAULT_LEXICON = Lexicon()
