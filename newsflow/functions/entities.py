"""Tickers, company names, people, macro indicators, ETFs and calendar."""

KNOWN_TICKERS = [
    "AAPL", "MSFT", "NVDA", "GOOGL", "AMZN", "META", "TSLA", "AMD", "INTC", "BA", "JPM", "GS",
    "WMT", "XOM", "CVX", "NFLX", "CRM", "ORCL", "ADBE", "PYPL", "DIS", "NKE", "PLTR", "SOXX",
    "SOXL", "LRCX", "ARM", "MRVL", "MRAAY", "CBRS", "AVGO", "TSM", "QCOM", "MU", "TXN", "AMAT",
    "KLAC", "ON", "UMC", "SPCX", "RKLB", "KTOS", "ASTS", "RGTI", "OKLO", "SMR", "TEM", "NBIS",
    "BOT", "ARKK", "COIN", "MSTR", "RIOT", "MARA", "CLSK", "HUT", "WULF", "SQ", "AFRM", "SOFI",
    "HOOD",
]
DEFAULT_WATCHLIST = ["AAPL", "MSFT", "NVDA", "GOOGL", "AMZN", "META", "TSLA"]
COMPANY_TICKERS = {
    "nvidia": "NVDA", "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL",
    "alphabet": "GOOGL", "amazon": "AMZN", "meta": "META", "tesla": "TSLA",
    "palantir": "PLTR", "intel": "INTC", "amd": "AMD", "broadcom": "AVGO", "marvell": "MRVL",
    "lam research": "LRCX", "arm holdings": "ARM", "arm": "ARM", "tsmc": "TSM",
    "taiwan semiconductor": "TSM", "rocket lab": "RKLB", "spacex": "SPCX", "coinbase": "COIN",
    "microstrategy": "MSTR", "riot blockchain": "RIOT", "riot platforms": "RIOT",
    "marathon digital": "MARA", "marathon": "MARA", "cleanspark": "CLSK", "hut 8": "HUT",
    "block": "SQ", "square": "SQ", "affirm": "AFRM", "sofi": "SOFI", "robinhood": "HOOD",
    "oklo": "OKLO", "nuscale": "SMR", "kratos": "KTOS", "ast spacemobile": "ASTS",
    "rigetti": "RGTI", "tempus": "TEM", "nebus": "NBIS", "nebis": "NBIS", "nebius": "NBIS",
    "nebius group": "NBIS", "ark innovation": "ARKK",
}
COMPANY_TICKERS_CJK = {
    "英伟达": "NVDA", "辉达": "NVDA", "苹果": "AAPL", "微软": "MSFT", "谷歌": "GOOGL",
    "亚马逊": "AMZN", "脸书": "META", "元宇宙": "META", "元宇宙平台": "META", "特斯拉": "TSLA",
    "英特尔": "INTC", "超威": "AMD", "超微": "AMD", "博通": "AVGO", "高通": "QCOM", "美光": "MU",
    "德州仪器": "TXN", "应用材料": "AMAT", "泛林": "LRCX", "拉姆研究": "LRCX", "科磊": "KLAC",
    "安森美": "ON", "迈威尔": "MRVL", "迈威尔科技": "MRVL", "安谋": "ARM", "安谋科技": "ARM",
    "台积电": "TSM", "台积": "TSM", "台积公司": "TSM", "联电": "UMC", "帕兰提尔": "PLTR",
    "帕兰泰尔": "PLTR", "火箭实验室": "RKLB", "奎托斯": "KTOS", "克瑞拓斯": "KTOS",
    "克瑞拓斯安全防卫": "KTOS", "宇航电信": "ASTS", "太空移动": "ASTS", "里盖蒂": "RGTI",
    "奥克洛": "OKLO", "纽斯凯尔": "SMR", "核能革新": "SMR", "天普思": "TEM", "奈比斯": "NBIS",
    "币基地": "COIN", "微策略": "MSTR", "马拉松数字": "MARA", "马拉松": "MARA", "清洁火花": "CLSK",
    "哈特8": "HUT", "暴乱": "RIOT", "暴乱平台": "RIOT", "布洛克": "SQ", "方块": "SQ",
    "确认": "AFRM", "索菲": "SOFI", "罗宾汉": "HOOD", "摩根大通": "JPM", "高盛": "GS",
    "埃克森美孚": "XOM", "雪佛龙": "CVX", "沃尔玛": "WMT", "耐克": "NKE", "迪士尼": "DIS",
    "奈飞": "NFLX", "网飞": "NFLX", "赛富时": "CRM", "甲骨文": "ORCL", "奥多比": "ADBE",
    "贝宝": "PYPL", "波音": "BA",
}

MACRO_ALERTS = [
    "Federal Reserve", "Fed meeting", "Fed rate", "FOMC", "interest rate", "rate hike",
    "rate cut", "CPI", "consumer price", "PPI", "producer price", "inflation", "GDP",
    "unemployment", "jobless claims", "nonfarm payrolls", "Treasury yield", "bond market",
    "recession", "stimulus", "quantitative easing", "QE", "quantitative tightening", "QT",
    "tariff", "trade war", "export controls", "sanctions", "geopolitical", "美联储", "加息",
    "降息", "通胀", "非农", "非农就业", "失业率", "央行", "降准", "逆回购", "MLF", "LPR",
    "财政政策", "货币政策", "政治局", "国务院", "国常会", "中央经济工作会议", "消费者价格指数",
    "生产者价格指数", "PMI", "核心通胀", "社融", "M2", "进出口", "贸易顺差", "外汇储备",
    "人民币汇率", "初请失业金", "续请失业金", "零售销售", "ISM制造业", "ISM服务业",
    "密歇根大学消费者信心", "美联储利率决议", "点阵图", "缩表", "扩表", "收益率曲线", "倒挂",
    "关税", "贸易战", "制裁", "出口管制", "实体清单", "芯片法案", "地缘政治", "暴跌", "暴涨",
    "熔断", "闪崩", "黑天鹅", "股灾",
]
SECTOR_WORDS = {
    "semiconductor": ["semiconductor", "chip", "GPU", "AI chip", "foundry", "wafer", "半导体",
                      "芯片", "光刻机", "晶圆", "台积电", "中芯国际", "英伟达", "NVIDIA", "AMD"],
    "tech": ["cloud computing", "SaaS", "software", "AI", "artificial intelligence", "人工智能",
             "云计算", "大模型", "ChatGPT", "自动驾驶", "机器人"],
    "finance": ["bank", "fintech", "insurance", "hedge fund", "银行", "券商", "保险", "基金",
                "信托"],
    "energy": ["oil", "crude", "natural gas", "OPEC", "renewable energy", "原油", "油价",
               "新能源", "光伏", "锂电池", "电动车", "特斯拉", "比亚迪"],
    "crypto": ["Bitcoin", "Ethereum", "cryptocurrency", "DeFi", "blockchain", "SEC crypto",
               "比特币", "以太坊", "加密货币", "区块链"],
    "real_estate": ["房地产", "房价", "楼市", "房贷", "恒大", "碧桂园", "万科"],
    "healthcare": ["pharma", "biotech", "FDA", "医药", "创新药", "CXO", "集采", "医保"],
}
# name -> tier; 1 prices markets, 2 moves them, 3 political. Extend by argument.
PEOPLE_TIERS = {
    "Jensen Huang": 1, "Lisa Su": 1, "Kevin Warsh": 1, "Jerome Powell": 1, "黄仁勋": 1,
    "苏姿丰": 1, "鲍威尔": 1, "沃什": 1, "萨姆·奥特曼": 1, "山姆·奥特曼": 1,
    "Elon Musk": 2, "Warren Buffett": 2, "Jamie Dimon": 2, "Janet Yellen": 2,
    "Gary Gensler": 2, "雷军": 2, "任正非": 2, "马斯克": 2, "埃隆·马斯克": 2, "巴菲特": 2,
    "戴蒙": 2, "杰米·戴蒙": 2, "耶伦": 2, "詹斯勒": 2, "方舟": 2, "木头姐": 2,
    "Donald Trump": 3, "Joe Biden": 3, "习近平": 3, "李强": 3, "潘功胜": 3, "易纲": 3, "刘鹤": 3,
    "王毅": 3, "马化腾": 3, "马云": 3, "特朗普": 3, "拜登": 3, "贝森特": 3, "卢特尼克": 3,
}
# id -> (tier, keywords), in order of precedence.
MACRO_INDICATORS = {
    "CPI": ("A", ["CPI", "消费者价格指数", "全国居民消费价格", "consumer price index",
                  "inflation data", "通胀数据", "通货膨胀"]),
    "FOMC_RATE": ("A", ["FOMC", "美联储利率决议", "联邦公开市场委员会", "Fed rate decision",
                        "federal reserve rate", "加息", "降息", "rate hike", "rate cut",
                        "联邦基金利率", "fed funds rate"]),
    "NFP": ("A", ["非农", "非农就业", "nonfarm payrolls", "NFP", "jobs report", "就业报告",
                  "unemployment claims", "初请失业金", "续请失业金"]),
    "FED_CHAIR": ("A", ["美联储主席", "Fed Chair", "Powell speech", "鲍威尔讲话", "鲍威尔证词",
                        "Powell testimony", "Warsh speech", "Warsh讲话", "Fed chair speech",
                        "联储主席", "Jackson Hole"]),
    "PPI": ("B", ["PPI", "生产者价格指数", "工业品出厂价格", "producer price index", "批发物价"]),
    "GDP": ("B", ["GDP", "国内生产总值", "gross domestic product", "经济增速", "GDP growth",
                  "GDPNow", "GDP Now"]),
    "RETAIL": ("B", ["零售销售", "retail sales", "零售数据", "consumer spending", "消费支出"]),
    "FOMC_MINUTES": ("B", ["会议纪要", "FOMC minutes", "Fed minutes", "美联储纪要", "联储会议纪要"]),
    "ISM": ("B", ["ISM制造业", "ISM服务业", "ISM manufacturing", "ISM services", "PMI",
                  "采购经理人指数", "制造业PMI", "服务业PMI"]),
    "CONFIDENCE": ("C", ["消费者信心", "consumer confidence", "密歇根大学", "U of Michigan",
                         "消费者情绪", "consumer sentiment"]),
    "HOUSING": ("C", ["新屋开工", "成屋销售", "housing starts", "existing home sales",
                      "房价指数", "home price index"]),
    "TRADE": ("C", ["贸易逆差", "贸易顺差", "trade deficit", "trade surplus", "贸易余额",
                    "trade balance", "经常账户", "current account"]),
    "INDUSTRIAL": ("C", ["工业产出", "industrial production", "产能利用率",
                         "capacity utilization", "耐用品订单", "durable goods"]),
    "FED_SPEAKER": ("C", ["联储官员", "Fed official", "地方联储", "Fed president", "投票委员",
                          "voting member", "鹰派", "鸽派", "hawkish", "dovish"]),
}
PREVIEW_WORDS = ["预览", "前瞻", "展望", "preview", "outlook", "ahead of", "expect",
                 "anticipate", "eye", "will watch", "关注", "what to watch", "consensus",
                 "共识预期", "estimate", "预估", "survey", "调查"]
# (tier, deviation) -> level
MACRO_LEVELS = {
    ("A", "slight"): "notable", ("A", "significant"): "important", ("A", "extreme"): "important",
    ("B", "slight"): "normal", ("B", "significant"): "notable", ("B", "extreme"): "important",
    ("C", "slight"): "normal", ("C", "significant"): "normal", ("C", "extreme"): "notable",
}
# Ordered: first contained release name decides.
RELEASE_TAGS = {
    "gross domestic product": "GDP", "consumer price index": "CPI",
    "producer price index": "PPI", "unemployment rate": "Unemployment",
    "nonfarm payroll": "NFP", "federal funds": "FOMC", "fomc": "FOMC",
    "treasury constant maturity": "Treasury", "retail sales": "Retail",
    "industrial production": "Industry", "personal consumption expenditures": "PCE",
    "initial claims": "Jobless", "ism manufacturing": "ISM", "consumer sentiment": "Sentiment",
}

TICKER_ETFS = {
    "NVDA": ["SMH", "SOXX", "QQQ"], "AMD": ["SMH", "SOXX"], "INTC": ["SMH", "SOXX"],
    "AVGO": ["SMH", "SOXX", "QQQ"], "TSM": ["SMH", "SOXX"], "AAPL": ["QQQ", "XLK"],
    "MSFT": ["QQQ", "XLK"], "GOOGL": ["QQQ", "XLK"], "META": ["QQQ", "XLK"],
    "AMZN": ["QQQ", "XLK"], "TSLA": ["QQQ"], "JPM": ["XLF"], "GS": ["XLF"], "BAC": ["XLF"],
    "WFC": ["XLF"], "C": ["XLF"], "XOM": ["XLE"], "CVX": ["XLE"], "JNJ": ["XLV"],
    "PFE": ["XLV"], "LLY": ["XLV"], "PLTR": ["QQQ", "XLK", "SOXX"], "SOXX": ["SMH", "QQQ"],
    "SOXL": ["SOXX", "SMH"], "LRCX": ["SMH", "SOXX"], "ARM": ["QQQ", "SOXX"],
    "MRVL": ["SMH", "SOXX", "QQQ"], "MRAAY": ["SOXX"], "CBRS": ["QQQ"], "SPCX": ["QQQ", "ITA"],
    "RKLB": ["ITA"], "KTOS": ["ITA", "PPA"], "ASTS": ["QQQ"], "RGTI": ["QQQ"],
    "OKLO": ["QQQ", "URA"], "SMR": ["QQQ", "URA"], "TEM": ["QQQ", "XLV"], "NBIS": ["QQQ"],
    "BOT": ["XLV", "IBB"], "ARKK": ["QQQ"], "COIN": ["QQQ", "XLK", "IBIT", "MSTR"],
    "MSTR": ["QQQ", "IBIT", "COIN"], "RIOT": ["MARA", "COIN"], "MARA": ["RIOT", "COIN"],
    "CLSK": ["COIN"], "HUT": ["COIN"], "WULF": ["COIN"], "SQ": ["QQQ", "XLK"],
    "AFRM": ["QQQ"], "SOFI": ["XLF"], "HOOD": ["QQQ", "XLF"],
}
EVENT_ETFS = {
    "monetary": ["TLT", "SPY", "GLD"], "geopolitical": ["GLD", "USO", "XLE", "ITA", "PPA"],
    "macro_data": ["TLT", "SPY", "XLF"], "CHIPS": ["SMH", "SOXX"],
    "TARIFF": ["XLI", "XLE", "SPY"], "AI": ["SMH", "QQQ", "XLK"],
    "ENERGY": ["XLE", "USO", "URA"], "REGULATORY": ["XLF", "SPY", "QQQ"],
    "DEFENSE": ["ITA", "PPA", "KTOS"], "NUCLEAR": ["URA", "OKLO", "SMR"],
    "SPACE": ["ITA", "SPCX", "RKLB"],
}
BROAD_CATEGORIES = ["monetary", "geopolitical", "macro_data"]
SECTOR_ETFS = {
    "Technology": "XLK", "Financials": "XLF", "Energy": "XLE", "Healthcare": "XLV",
    "Industrials": "XLI", "Consumer Staples": "XLP", "Utilities": "XLU",
    "Consumer Disc": "XLY", "Communication": "XLC", "Real Estate": "XLRE", "Materials": "XLB",
}
HOLIDAYS = ["2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19",
            "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25", "2026-12-31"]
MARKET_NUMBERS = {105: "NASDAQ", 106: "NYSE", 107: "US_OTHER", 116: "HK"}
KNOWN_MARKETS = {
    "AAPL": 105, "MSFT": 105, "GOOGL": 105, "AMZN": 105, "NVDA": 105, "META": 105, "TSLA": 105,
    "NFLX": 105, "AMD": 105, "INTC": 105, "AVGO": 105, "ASML": 105, "ARM": 105, "MRVL": 105,
    "PLTR": 105, "RKLB": 105, "ASTS": 105, "RGTI": 105, "TEM": 105, "OKLO": 105, "SMR": 105,
    "NBIS": 105, "SOXL": 105, "BRK.A": 106, "BRK.B": 106, "JPM": 106, "V": 106, "WMT": 106,
    "XOM": 106, "SPCX": 106, "KTOS": 106, "BOT": 106, "LRCX": 106, "00700": 116,
    "09988": 116, "09618": 116, "00388": 116, "00981": 116,
}
CORPUS_SECTIONS = {
    "货币政策": "monetary", "地缘政治": "geopolitical", "宏观经济": "macro_data",
    "科技": "corporate", "并购": "corporate", "IPO": "corporate", "财报": "corporate",
    "贸易政策": "regulatory", "银行": "regulatory", "能源": "macro_data",
    "加密货币": "macro_data", "医疗": "corporate",
}
IMPACT_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
IMPACT_SCORES = {"CRITICAL": 90, "HIGH": 65, "MEDIUM": 40, "LOW": 20}
