"""Fixed values for the relevance score: keyword weights, half-lives and penalty patterns."""

MACRO_WORDS = [
    "fomc", "fed", "federal reserve", "美联储", "cpi", "inflation", "通胀", "gdp", "nfp",
    "nonfarm", "unemployment", "失业", "interest rate", "利率", "rate hike", "rate cut",
    "recession", "衰退", "treasury", "国债", "yield", "收益率", "tariff", "关税", "trade war",
    "贸易战", "geopolitical", "地缘", "war", "战争", "sanction", "制裁", "oil", "原油",
    "energy crisis", "stimulus", "刺激", "bailout", "救助", "pboc", "央行", "ecb", "boj",
]
NOVELTY_WORDS = [
    "first", "首次", "unprecedented", "史无前例", "breaking", "突发", "just in", "快讯",
    "exclusive", "独家", "scoop", "surprise", "意外", "unexpected", "出乎意料", "new", "全新",
    "launch", "发布", "unveil", "公布", "breakthrough", "突破",
]
SHOCK_WORDS = [
    "crash", "暴跌", "surge", "飙升", "plunge", "急跌", "panic", "恐慌", "meltdown", "shock",
    "震惊", "unexpectedly", "意外地", "suddenly", "突然", "unprecedented", "前所未有",
]
OPPORTUNITY_CATEGORIES = {
    "gov_intervention": 1.2, "nvda_investment": 1.0, "nvda_endorsement": 0.9,
    "nvda_competitive_threat": 0.7,
}
HIGH_IMPACT_TAGS = {
    "fomc": 1.00, "monetary_policy": 0.95, "rate_hike": 0.90, "rate_cut": 0.90,
    "inflation": 0.90, "cpi": 0.90, "fed": 0.85, "interest_rate": 0.85,
    "stagflation_risk": 0.85, "war": 1.00, "geopolitical": 1.00, "oil_supply": 0.90,
    "energy_crisis": 0.90, "trade_war": 0.85, "sanction": 0.80, "systemic_risk": 0.85,
    "contagion": 0.80, "tariff": 0.85, "trade_policy": 0.80, "macro_data": 0.80, "gdp": 0.70,
    "employment": 0.70, "china_stimulus": 0.85, "pboc": 0.80, "gov_intervention": 0.95,
    "critical_minerals": 0.90, "rare_earth": 0.90, "gov_funding": 0.90, "gov_grant": 0.90,
    "gov_equity": 0.95, "gov_contract": 0.85, "gov_subsidy": 0.85,
    "supply_chain_security": 0.85, "energy_security": 0.85, "domestic_production": 0.80,
    "reshoring": 0.80, "defense_contract": 0.85, "national_security": 0.85,
}
LOW_IMPACT_TAGS = ["earnings", "merger", "acquisition", "ipo", "product_launch",
                   "leadership_change", "transparency", "routine_data", "dividend", "buyback",
                   "share_repurchase", "analyst_rating", "price_target", "stock_movement"]
SECTOR_SIGNALS = {
    "扶持": 0.8, "补贴": 0.8, "拨款": 0.7, "行政命令": 0.7, "invests": 0.8, "subsidizes": 0.8,
    "funding": 0.7, "grant": 0.7, "strategic partnership": 0.6, "breakthrough": 0.6, "突破": 0.6,
    "战略合作": 0.6, "入股": 1.0, "收购": 0.8, "领投": 0.9, "站台": 0.7, "赞扬": 0.6,
    "加速开发": 0.75, "核反应堆": 0.75, "煤电": 0.70, "火电": 0.70, "关键矿产": 0.70,
    "能源合同": 0.75, "基础设施合同": 0.75, "喊话": 0.75, "力挺": 0.75, "背书": 0.70, "点名": 0.65,
    "公开赞扬": 0.70, "站台背书": 0.75, "fda": 0.70, "批准": 0.55, "加速批准": 0.80,
    "突破性疗法": 0.80, "accelerated approval": 0.80, "breakthrough therapy": 0.80, "拆分": 0.70,
    "spinoff": 0.70, "spin off": 0.70, "分拆上市": 0.75, "剥离": 0.65, "divestiture": 0.65,
    "breakup": 0.70, "split into": 0.70, "carve out": 0.65, "fast-track": 0.75,
    "expedite": 0.70, "accelerate": 0.65, "nuclear reactor": 0.75, "smr": 0.75,
    "small modular reactor": 0.75, "coal power": 0.70, "coal-fired": 0.70,
    "fossil fuel plant": 0.65, "critical minerals": 0.85, "rare earth": 0.85,
    "infrastructure contract": 0.75, "defense contract": 0.80, "energy contract": 0.75,
    "power purchase agreement": 0.70, "national security": 0.70, "supply chain security": 0.70,
    "domestic production": 0.65, "reshore": 0.65, "onshore": 0.65, "touted": 0.75,
    "praised": 0.70, "urged": 0.70, "called for": 0.65, "threw support behind": 0.70,
    "endorsed": 0.75, "backed": 0.70, "vouched for": 0.65, "singled out": 0.65,
    "name-checked": 0.60, "hailed": 0.65, "championed": 0.70, "fda approval": 0.75,
    "fda clearance": 0.75, "priority review": 0.75, "fast track designation": 0.75,
    "nda": 0.55, "bla": 0.55, "pdufa": 0.65, "takes stake in": 0.85, "acquires stake": 0.85,
    "convertible preferred": 0.80, "equity stake": 0.80, "strategic investment": 0.75,
    "anchor investment": 0.75, "lead investor": 0.80, "co-invest": 0.75,
    "government invests": 0.85, "government stake": 0.85, "government equity": 0.85,
    "federal funding": 0.85, "federal grant": 0.85, "federal contract": 0.85,
    "us government": 0.80, "us invests": 0.85, "us govt": 0.80, "taxpayer fund": 0.80,
    "taxpayer stake": 0.80, "bailout": 0.85, "bailout package": 0.90, "loan guarantee": 0.80,
    "debt guarantee": 0.80, "government backstop": 0.85, "government backing": 0.85,
    "implicit guarantee": 0.80, "too big to fail": 0.80, "golden share": 0.90,
    "govt acquires": 0.85, "govt takes": 0.80, "treasury acquires": 0.90,
    "treasury stake": 0.90, "white house announces": 0.80, "congress passes": 0.75,
    "bipartisan support": 0.70, "national security review": 0.75, "cfius": 0.80,
    "strategic industry": 0.75, "appropriations bill": 0.75, "defense authorization": 0.80,
    "doe grant": 0.85, "energy department grant": 0.85, "doe fund": 0.85, "doe award": 0.85,
    "doe contract": 0.85, "dod grant": 0.85, "dod contract": 0.85, "dod award": 0.85,
    "defense department grant": 0.85, "pentagon contract": 0.85,
}
RETROSPECTIVE_PATTERNS = [
    r"从\s*\S+\s*(→|到|升至|跌至|涨至|暴涨|暴跌|飙)",
    r"(蒸发|过山车|回顾|总结)",
    r"(单月|当月|本月|上周|上月|Q\d|H1|H2|季度|年度).{0,10}(蒸发|跌|涨|暴跌|暴涨|累计|流出|流入)",
    r"(YTD|今年以来|年初至今)",
    r"(创.*(?:新高|新低|纪录|记录))",
    r"(自|从)\d{4}年.{0,15}(以来|起|至今)",
    r"(上市|IPO|定价).{0,30}(?:估值|融资|万亿)",
    r"\d{4}年(?:金融危机|危机|泡沫)",
    r"(from|since)\s*\$?\d+.*(→|to)\s*\$?\d+",
    r"(plunged|surged|skyrocketed|tumbled|soared)\s*\d+%",
    r"(year.to.date|ytd|quarterly|monthly)\s+(review|recap|roundup|wrap)",
    r"(best|worst)\s+(month|quarter|year)\s+(since|in)",
    r"(market\s+cap|market\s+value)\s+(evaporat|wiped|erased|lost)",
    r"(closed|ended|finished)\s+(the\s+)?(month|quarter|week)\s+(down|up|flat)",
    r"since\s+(the\s+)?start\s+of\s+(the\s+)?(year|quarter|month)",
]
THREAT_PATTERNS = [
    r"(威胁|警告|提议|考虑|可能|计划|拟|将)\s*(征收|对|加征|禁止|限制|制裁|课征)",
    r"(尚未|还未|暂未|仍在讨论|有待|等待)\s*(实施|执行|通过|批准)",
    r"(threaten|warn|propose|consider|plan|may|might|could)\s+(?:to\s+)?(impose|levy|ban|restrict|sanction|tariff|duty)",
    r"(floated|floating)\s+(?:the\s+)?(?:idea|proposal|plan)\s+(?:of|to)",
    r"(mulled|mulling|weighed|weighing)\s+(?:a\s+)?(?:tariff|sanction|ban|restriction)",
    r"(not\s+yet|has\s+not|have\s+not|still\s+(?:under|in))\s+(?:implement|enact|enforce|approve|finalize)",
    r"(could|could\s+potentially|is\s+expected\s+to|is\s+set\s+to)\s+(levy|impose|raise|increase)",
]
PERSONNEL_PATTERN = r"(宣誓就任|被任命为|出任|接替|appointed|sworn\sin|named\sas|takes\sover|will\s+become|has\s+been\s+named|to\s+lead|to\s+head)"
POLICY_PATTERN = r"(加息|降息|利率|关税|制裁|战争|invest|subsid|fund|grant|ban|restrict|tariff|policy|行政命令|法案)"

HALF_LIFE_MINUTES = {"geopolitical": 240, "war": 240, "monetary": 90, "macro_data": 60,
                     "regulatory": 45, "corporate": 15, "other": 30}
DEFAULT_HALF_LIFE = 30
# Ordered: the first tag contained in the tag text decides the type.
TAG_EVENT_TYPES = {
    "geopolitical": "geopolitical", "war": "geopolitical", "oil_supply": "geopolitical",
    "energy_crisis": "geopolitical", "sanction": "geopolitical", "trade_war": "geopolitical",
    "defense": "geopolitical", "monetary_policy": "monetary", "fomc": "monetary",
    "rate_hike": "monetary", "rate_cut": "monetary", "fed": "monetary",
    "interest_rate": "monetary", "forward_guidance": "monetary", "hawkish": "monetary",
    "dovish": "monetary", "fed_policy": "monetary", "transparency": "monetary",
    "macro_data": "macro_data", "inflation": "macro_data", "cpi": "macro_data",
    "gdp": "macro_data", "employment": "macro_data", "stagflation_risk": "macro_data",
    "tariff": "regulatory", "trade_policy": "regulatory", "regulation": "regulatory",
    "regulatory": "regulatory", "china_regulation": "regulatory",
    "china_stimulus": "regulatory", "pboc": "regulatory", "earnings": "corporate",
    "merger": "corporate", "acquisition": "corporate", "ipo": "corporate",
    "product_launch": "corporate", "leadership_change": "corporate",
    "tech_selloff": "corporate", "ai_spending": "corporate", "magnificent_seven": "corporate",
    "sector_rotation": "corporate",
}
# Ordered: the first group with a word in the text decides the type.
TEXT_EVENT_TYPES = {
    "geopolitical": ["war", "military", "invasion", "strike", "conflict", "战争", "军事", "入侵"],
    "monetary": ["fomc", "fed", "rate hike", "rate cut", "central bank", "加息", "降息", "美联储"],
    "macro_data": ["cpi", "nfp", "gdp", "inflation", "unemployment", "通胀", "失业"],
    "regulatory": ["tariff", "sanction", "trade", "ban", "关税", "制裁", "监管"],
    "corporate": ["earnings", "revenue", "eps", "财报", "营收"],
}
STRATEGIC_EVENT_TYPES = {"gov_intervention": "regulatory", "nvda_endorsement": "corporate",
                         "nvda_investment": "corporate",
                         "nvda_competitive_threat": "corporate"}

# Topic patterns of the suppression key, in order of precedence at the same position.
MACRO_TOPICS = [
    (r"CPI|通胀|inflation", "inflation"),
    (r"FOMC|美联储|Fed\b|利率|降息|加息|rate\s*(?:cut|hike)", "fed_rate"),
    (r"非农|就业|失业|NFP|jobless|payroll", "employment"),
    (r"GDP|经济(?:增速|增长|萎缩|衰退)|recession", "gdp"),
    (r"PMI|ISM|采购经理", "pmi"),
    (r"PCE|PPI|生产者价格", "pce_ppi"),
    (r"关税|tariff|贸易(?:战|摩擦)", "trade"),
    (r"银行.*(?:财报|盈利|业绩)|(?:摩根|花旗|高盛|富国|美银|小摩|大摩).*(?:财报|盈利|业绩)|bank.*earn(?:ings)?", "bank_earnings"),
]

SENTIMENT_VALENCE = {
    "surge": 2.5, "surged": 2.5, "surges": 2.5, "soar": 2.5, "soared": 2.5, "soars": 2.5,
    "rally": 2.0, "rallied": 2.0, "rallies": 2.0, "bullish": 2.5, "outperform": 1.5,
    "outperformed": 1.5, "beat": 1.5, "beats": 1.5, "upgrade": 1.5, "upgraded": 1.5,
    "upgrades": 1.5, "breakout": 2.0, "breakthrough": 2.0, "oversold": 1.5, "dip": -1.0,
    "dips": -1.0, "dipped": -1.0, "plunge": -2.5, "plunged": -2.5, "plunges": -2.5,
    "crash": -3.0, "crashed": -3.0, "crashes": -3.0, "tumble": -2.0, "tumbled": -2.0,
    "tumbles": -2.0, "slump": -2.0, "slumped": -2.0, "slumps": -2.0, "bearish": -2.5,
    "downgrade": -1.5, "downgraded": -1.5, "downgrades": -1.5, "underperform": -1.5,
    "sell-off": -2.5, "selloff": -2.5, "overbought": -1.5, "recession": -2.0, "layoff": -1.5,
    "layoffs": -1.5, "default": -2.5, "defaults": -2.5, "bankruptcy": -3.0, "delist": -2.5,
    "delisted": -2.5, "warning": -1.0, "warns": -1.0, "warned": -1.0, "miss": -1.0,
    "missed": -1.0, "misses": -1.0, "cut": -1.0, "cuts": -1.0, "suspend": -1.5,
    "suspended": -1.5, "probe": -1.0, "investigation": -1.0, "fine": -1.0, "fined": -1.0,
    "lawsuit": -1.5, "sanction": -1.5, "sanctions": -1.5, "tariff": -1.0, "tariffs": -1.0,
    "volatile": -0.5, "volatility": -0.5, "swing": 0.0, "swings": 0.0,
}

# Fixed values of the published valence rule: words before a listed word that turn or strengthen it.
NEGATIONS = ["not", "no", "never", "none", "neither", "nor", "nothing", "nowhere", "without", "cannot", "hardly", "rarely", "scarcely",
             "barely", "seldom", "despite"]  # and every word that ends in n't
NEGATION_FACTOR = -0.74
BOOSTERS = {
    "absolutely": 0.293, "completely": 0.293, "considerably": 0.293, "deeply": 0.293, "enormously": 0.293, "entirely": 0.293,
    "especially": 0.293, "exceptionally": 0.293, "extremely": 0.293, "greatly": 0.293, "highly": 0.293, "hugely": 0.293,
    "incredibly": 0.293, "intensely": 0.293, "majorly": 0.293, "more": 0.293, "most": 0.293, "particularly": 0.293, "purely": 0.293,
    "quite": 0.293, "really": 0.293, "remarkably": 0.293, "sharply": 0.293, "so": 0.293, "substantially": 0.293, "thoroughly": 0.293,
    "totally": 0.293, "tremendously": 0.293, "unbelievably": 0.293, "unusually": 0.293, "utterly": 0.293, "very": 0.293,
    "almost": -0.293, "kinda": -0.293, "less": -0.293, "little": -0.293, "marginally": -0.293, "occasionally": -0.293, "partly": -0.293,
    "slightly": -0.293, "somewhat": -0.293,
}
BOOSTER_SHARES = [1.0, 0.95, 0.9]  # one, two and three words before

TOPIC_WORDS = {
    "semiconductor": ["芯片", "半导体", "wafer", "foundry", "fab", "台积电", "TSMC", "NVIDIA", "GPU", "CPU"],
    "AI": ["artificial intelligence", "AI", "machine learning", "deep learning", "LLM", "transformer", "GPT"],
    "monetary_policy": ["interest rate", "利率", "FOMC", "Federal Reserve", "美联储", "加息", "降息", "QE"],
    "geopolitics": ["sanction", "制裁", "export control", "chip ban", "tariff", "关税", "trade war"],
    "energy": ["oil", "crude", "OPEC", "natural gas", "renewable", "solar", "石油", "能源"],
    "crypto": ["Bitcoin", "Ethereum", "crypto", "blockchain", "BTC", "ETH", "DeFi", "比特币"],
    "EV": ["Tesla", "EV", "electric vehicle", "battery", "电动车", "锂电", "BYD"],
    "pharma": ["FDA", "drug", "clinical trial", "biotech", "pharma", "疫苗", "制药"],
    "real_estate": ["housing", "mortgage", "房地产", "房价", "REIT"],
    "fintech": ["payment", "fintech", "digital bank", "支付", "金融科技"],
}
