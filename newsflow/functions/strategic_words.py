"""Fixed values of the strategic-relationship detector: entities, actions, bonuses."""

GOVERNMENT_ENTITIES = [
    "商务部", "财政部", "能源部", "国防部", "国土安全部", "交通部", "农业部",
    "Department of Commerce", "Commerce Department", "Commerce Dept",
    "Department of Treasury", "Treasury Department", "Department of Energy",
    "Energy Department", "Energy Dept", "Department of Defense", "Defense Department",
    "Defense Dept", "DoD", "DOE", "DOC", "DHS", "Pentagon", "五角大楼", "SEC", "CFTC", "FTC",
    "FCC", "FDA", "EPA", "NASA", "DARPA", "CFIUS", "美国证券交易委员会",
    "美国商品期货交易委员会", "联邦贸易委员会", "美国食品药品监督管理局", "美国环保署",
    "CHIPS Act", "芯片法案", "Inflation Reduction Act", "通胀削减法案", "IRA", "美国政府",
    "US Government", "US govt", "US invests", "白宫", "White House", "Washington", "国会",
    "Congress", "参议院", "Senate", "众议院", "House", "行业主管部门", "监管机构", "regulator",
    "美联储", "Federal Reserve", "州政府", "state government", "federal government",
    "United States", "government backstop", "government backing", "government bailout",
    "government support", "government rescue", "state-backed", "state backed",
    "government-backed", "government backed",
]
COMPANY_ENTITIES = ["英伟达", "NVIDIA", "黄仁勋", "Jensen Huang", "NVDA", "Nvidia CEO", "Huang"]

INVESTMENT_ACTIONS = [
    "入股", "注资", "投资", "收购", "并购", "控股", "参股", "战略投资", "战略入股", "增持",
    "定向增发", "战投", "领投", "跟投", "天使轮", "A轮", "B轮", "C轮", "D轮", "补贴转股权",
    "可转换优先股", "黄金股", "贷转股", "债转股", "优先股", "认股权证", "少数股权",
    "invest", "invests", "investment", "investing", "acquire", "acquires", "acquisition",
    "merge", "merger", "take stake", "takes stake", "stake in", "stake", "stakes",
    "lead round", "leads round", "funding round", "series A", "series B", "series C",
    "series D", "strategic investment", "strategic stakes", "strategic", "minority stake",
    "majority stake", "convertible preferred", "golden share", "equity stake",
    "loan-to-equity", "debt-to-equity", "preferred stock", "converts into equity",
    "swap for equity", "bailout", "bailouts", "converts", "swap", "takes equity",
    "acquires equity", "grant converts", "convert grants", "distributes", "allocates",
    "allocate",
]
SUBSIDY_ACTIONS = [
    "资助", "扶持", "补贴", "拨款", "减税", "免税", "税收优惠", "贷款担保", "低息贷款", "研发资助",
    "专项资金", "产业基金", "引导基金", "国有资本", "授予",
    "subsidize", "subsidizes", "subsidy", "subsidies", "grant", "grants", "fund", "funding",
    "funds", "tax credit", "tax break", "loan guarantee", "bailout", "award contract",
    "award", "awards", "allocate", "allocates", "appropriation", "contract to",
    "contract for", "finalizes", "finalize", "announces", "announce", "plans", "pledges",
    "commits", "supports", "support", "backs", "backing", "package", "packages", "provides",
    "provide", "provided",
]
POLICY_ACTIONS = [
    "出台扶持", "签署", "批准", "立法", "颁布", "行政命令", "executive order", "总统令",
    "关税豁免", "出口管制放松", "放宽限制", "制裁", "限制出口", "实体清单",
    "sign into law", "signs into law", "pass legislation", "passes legislation",
    "passed legislation", "tariff exemption", "export control ease", "deregulate",
    "sanctions", "sanction", "imposes sanctions", "impose sanctions", "ban", "banning",
    "restrict", "approves", "approve", "approved",
]
ENDORSEMENT_ACTIONS = [
    "站台", "背书", "同台", "力挺", "看好", "公开支持", "直言", "将成为", "下一家万亿",
    "万亿美元公司", "战略合作", "深度合作", "独家合作", "联合发布", "推荐", "点名", "押注",
    "喊话增产", "请多生产", "买他们的股票", "买它的股票", "做得非常好", "重返赛场",
    "endorse", "endorses", "partnership", "strategic partner", "collaboration",
    "trillion dollar", "trillion-dollar", "next trillion-dollar", "bet on", "bets on",
    "bet big", "bullish on", "tout", "touts", "champion", "joint venture",
    "exclusive partner", "buy their stock", "produce more", "ramp up production",
    "they are great", "reinvent", "reinventing", "critical partner", "key partner",
    "declares", "calls them", "says they", "praises", "hails", "will become", "elevate",
    "elevates", "urges", "urged", "tell investors", "tells investors", "collaborate",
    "collaborates", "collaborating", "next major field", "the next", "says", "calls", "said",
    "called", "is doing", "are doing", '"incredible', '"amazing', '"extraordinary',
    '"critical', '"game-changing', '"breakthrough',
]
THREAT_ACTIONS = [
    "入局", "进入", "进军", "发布首款", "首款处理器", "首款芯片", "重新发明", "不需要", "无需",
    "不再需要", "正式进入", "跨界", "杀入",
    "enter the", "enters the", "entering", "enters", "launch its first",
    "launches its first", "first processor", "first cpu", "unveils", "unveil",
    "unveils first", "compete with", "competes with", "competing with",
    "directly competing", "disrupt", "disrupts", "disrupting", "no longer need",
    "no longer needs", "no longer require", "no longer requires", "doesn't require",
    "does not require", "reinvent the", "reinventing the", "dominated by",
]

# (bonus, fragments): each rule whose fragment occurs in the action adds its bonus.
ACTION_BONUSES = [
    (0.25, ["入股", "注资", "收购", "并购", "invest", "acquire", "take stake", "lead",
            "可转换优先股", "黄金股", "贷转股", "债转股", "优先股", "认股权证", "loan-to-equity",
            "debt-to-equity", "equity stake", "convertible preferred", "golden share"]),
    (0.20, ["资助", "扶持", "补贴", "拨款", "授予", "subsidize", "subsidies", "subsidy", "grant",
            "fund", "award", "provide", "package", "converts", "swap for equity", "finalizes",
            "announces", "plans", "pledges", "backs", "allocate", "distributes", "strategic"]),
    (0.15, ["签署", "批准", "行政命令", "executive order", "sign into law", "signs into law",
            "passes legislation", "approve"]),
    (0.15, ["制裁", "sanction", "实体清单", "entity list", "ban"]),
    (0.20, ["站台", "背书", "同台", "直言", "endorse", "trillion dollar", "tout", "declares",
            "will become", "the next", "tells investors"]),
    (0.10, ["战略合作", "独家合作", "strategic partner", "partnership", "collaboration"]),
    (0.20, ["入局", "进入", "进军", "enter the", "enters", "entering", "launch its first",
            "launches its first", "first processor", "first cpu", "unveils", "no longer need",
            "doesn't require", "reinvent the", "reinventing the", "dominated by"]),
]
ENTITY_BONUSES = [
    (0.15, ["chips act", "芯片法案", "inflation reduction", "department of energy",
            "energy department", "dod", "doe", "darpa", "国防部", "商务部", "能源部"]),
    (0.15, ["pentagon", "五角大楼", "white house", "白宫", "congress", "国会"]),
    (0.15, ["washington", "us government", "federal government", "united states"]),
    (0.20, ["黄仁勋", "jensen huang", "nvidia ceo", "huang"]),
    (0.15, ["nvidia", "英伟达", "nvda"]),
]
# At most one of these pair bonuses applies.
PAIR_BONUS = 0.15
PAIR_RULES = [
    (["白宫", "white house"], ["行政命令", "executive order", "签署"]),
    (["商务部", "department of commerce"], ["实体清单", "entity list", "制裁", "sanction"]),
    (["财政部", "treasury"], ["制裁", "sanction", "税收优惠"]),
    (["国防部", "defense department", "dod", "department of defense"],
     ["授予", "award", "contract", "合同", "golden share", "黄金股"]),
    (["chips act", "芯片法案"], ["拨款", "补贴", "grant", "fund", "注资", "invest"]),
    (["inflation reduction act", "ira"], ["invest", "fund", "grant", "subsidize"]),
    (["能源部", "energy department", "department of energy", "doe"],
     ["grant", "fund", "award", "invest", "拨款", "资助", "补贴"]),
]
PASSIVE_LINKS = ["by", "由", "被"]
EXCLUSION_PATTERNS = [
    r"(财报|earnings|revenue|quarterly|Q\d|财务报告|业绩预告)",
    r"(发布.*(新品|产品|GPU|芯片|显卡|手机|game|游戏))",
    r"(launch|release).*(product|GPU|chip|graphics card)",
    r"(delay|delayed|snag|snags|push\s*back|postpone|reschedule)",
    r"(manufacturing|production).*(issue|problem|snag|bottleneck|constraint)",
    r"(股价|stock\s+(price|up|down|rise|fall|surge|drop))",
    r"(上调|下调|upgrade|downgrade|target\s+price|评级)",
    r"(FDA|药监局).*(批准|approve|approval|clear|clearance)",
    r"(generic|仿制|drug|药品|treatment|therapy)",
    r"(NVIDIA|英伟达|NVDA).*(蒸发|暴跌|市值|股价|下跌|drop|market\s+cap|wipe)",
    r"(sanction|制裁).*(iran|north\s*korea|russia|venezuela)",
    r"(iran|north\s*korea|russia|venezuela).*(sanction|制裁)",
    r"sanctions?\s+relief", r"oil\s+(export|inventor|shipment)",
    r"(OPEC|opec|crude\s+oil|oil\s+price).*(iran|sanction)",
    r"(iran|sanction).*(OPEC|opec|crude\s+oil|oil\s+price)",
]
