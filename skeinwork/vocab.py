"""The taxonomy and the term lists as data.

Fixed values: labels, keywords, scores and their order, as the results require. Every operator takes a Vocabulary, so another domain is
another instance.
"""

from __future__ import annotations

from dataclasses import dataclass

NEV, AI = "新能源汽车", "人工智能"


@dataclass(frozen=True)
class Vocabulary:
    industries: tuple[str, ...]
    hints: dict[str, str]
    industry_words: tuple[str, ...]
    relevance: dict[str, tuple[str, ...]]
    negative: tuple[str, ...]
    meeting: tuple[str, ...]
    subtags: dict[str, dict[str, tuple[str, ...]]]
    events: dict[str, tuple[str, ...]]
    event_scores: dict[str, float]
    default_event: str
    roles: dict[str, tuple[str, ...]]
    default_role: str
    signals: dict[str, tuple[str, ...]]
    regional_words: tuple[str, ...]
    regional_signal: str
    default_signal: str
    actors: tuple[str, ...]
    agencies: tuple[str, ...]
    medium_words: tuple[str, ...]
    importance_scores: dict[str, float]
    source_labels: dict[str, str]


REFERENCE = Vocabulary(
    industries=(NEV, AI),
    hints={"new_energy_vehicle": NEV, "nev": NEV, "ai": AI, "artificial_intelligence": AI},
    industry_words=("新能源汽车", "动力电池", "智能驾驶", "充换电", "汽车芯片", "比亚迪", "宁德时代", "特斯拉"),
    relevance={
        NEV: ("新能源汽车", "新能源车", "电动汽车", "动力电池", "电池", "智能驾驶", "自动驾驶", "辅助驾驶", "充电", "换电", "充换电", "汽车芯片", "车载软件", "整车", "比亚迪", "宁德时代", "CATL", "battery", "energy storage", "chassis", "zero-carbon", "Togg", "特斯拉", "蔚来", "小鹏", "理想汽车", "FSD", "EV"),
        AI: ("人工智能", "AI", "大模型", "基础模型", "模型", "智能体", "Agent", "算力", "GPU", "AI芯片", "AI 芯片", "数据中心", "机器人", "人形机器人", "具身智能", "物理AI", "物理 AI", "英伟达", "NVIDIA", "OpenAI", "Anthropic", "Claude", "Microsoft AI", "Google AI"),
    },
    negative=("假冒学历", "学历认证", "公安部网安", "网络诈骗", "青年理论学习", "机关党建", "共青团", "代表大会", "纪录片", "文化情缘", "儿童成长", "学习小组"),
    meeting=("青年理论学习", "机关党建", "共青团", "代表大会", "学习小组"),
    subtags={
        NEV: {
            "整车制造": ("整车", "汽车", "比亚迪", "蔚来", "小鹏", "特斯拉"), "动力电池": ("动力电池", "电池", "宁德时代", "CATL", "battery", "energy storage"),
            "智能驾驶": ("智能驾驶", "自动驾驶", "辅助驾驶"), "充换电基础设施": ("充电", "换电", "充换电"), "汽车芯片": ("汽车芯片", "车规芯片"),
            "车载软件": ("车载软件", "座舱", "车机"), "上游材料": ("锂", "镍", "上游材料"), "出口与海外市场": ("出口", "海外", "欧洲", "东南亚"),
        },
        AI: {
            "基础模型": ("基础模型", "大模型", "模型"), "AI 芯片": ("AI 芯片", "GPU", "英伟达", "NVIDIA"), "算力基础设施": ("算力", "数据中心", "集群"), "AI 应用": ("AI 应用", "应用"),
            "智能体/Agent": ("智能体", "Agent"), "数据与安全": ("数据安全", "安全", "治理"), "机器人": ("机器人", "人形机器人", "具身智能", "物理AI", "物理 AI"), "企业服务": ("企业服务", "SaaS"),
        },
    },
    events={
        "政策/监管": ("政策", "监管", "办法", "通知", "指南"), "融资/投资": ("融资", "投资", "募资"), "并购/重组": ("并购", "收购", "重组"), "产品发布": ("发布", "推出", "上线"),
        "技术突破": ("突破", "刷新", "首个", "性能提升"), "战略合作": ("合作", "签署", "联盟"), "产能/交付": ("产能", "交付", "量产"), "价格/商业化": ("价格", "降价", "商业化"),
        "龙头企业动向": (), "供应链变化": ("供应链", "短缺", "断供"), "海外扩张": ("海外", "出口", "欧洲", "美国"), "风险/负面舆情": ("风险", "处罚", "事故", "召回", "负面"),
    },
    event_scores={"政策/监管": 1.0, "风险/负面舆情": 0.95, "龙头企业动向": 0.9, "技术突破": 0.85, "供应链变化": 0.85, "并购/重组": 0.8, "融资/投资": 0.75, "产能/交付": 0.75, "战略合作": 0.65, "海外扩张": 0.65, "价格/商业化": 0.6, "产品发布": 0.5},
    default_event="龙头企业动向",
    roles={
        "政府/监管机构": ("工信部", "发改委", "监管", "政府"), "整车厂/模型厂商": ("比亚迪", "特斯拉", "蔚来", "小鹏", "OpenAI", "Anthropic", "模型"), "核心零部件/芯片企业": ("芯片", "英伟达", "NVIDIA"),
        "电池/算力基础设施企业": ("电池", "宁德时代", "算力", "数据中心"), "高校/科研机构": ("大学", "高校", "研究院"), "投资机构": ("投资", "基金", "资本"),
        "海外企业": ("海外", "美国", "欧洲", "Google", "Microsoft"), "下游客户/应用方": ("客户", "应用方", "采购"),
    },
    default_role="整车厂/模型厂商",
    signals={
        "政策信号": ("政策/监管",), "风险信号": ("风险/负面舆情",), "机会信号": ("融资/投资", "海外扩张", "战略合作", "产能/交付"), "竞争格局变化": ("龙头企业动向", "供应链变化"),
        "技术路线变化": ("技术突破",), "商业化进展": ("价格/商业化", "产品发布"), "区域产业变化": (), "资本市场信号": ("融资/投资", "并购/重组"),
    },
    regional_words=("地方", "区域", "园区"),
    regional_signal="区域产业变化",
    default_signal="机会信号",
    actors=("比亚迪", "宁德时代", "CATL", "特斯拉", "英伟达", "NVIDIA", "OpenAI", "Anthropic", "Google", "Microsoft", "工信部", "国家发改委", "国家能源局", "国家市场监督管理总局"),
    agencies=("工信部", "国家发改委", "国家能源局", "国家市场监督管理总局"),
    medium_words=("具体指标", "商业化", "产能", "融资"),
    importance_scores={"high": 1.0, "medium": 0.6, "low": 0.25},
    source_labels={"government": "政府/监管", "exchange": "交易所/公告", "company": "企业官网", "media": "行业媒体", "news_api": "新闻 API"},
)
