"""Word lists, weights and patterns the scoring rules are defined by.

Every operator takes its dictionary as an argument; these are the defaults.
"""

URGENCY_PREFIXES = [
    "BREAKING:", "BREAKING—", "BREAKING -", "URGENT:", "URGENT—", "URGENT -", "JUST IN:", "JUST IN—", "JUST IN -",
    "FLASH:", "FLASH—", "FLASH -", "ALERT:", "ALERT—", "ALERT -", "DEVELOPING:", "DEVELOPING—", "DEVELOPING -",
    "突发:", "突发—", "突发 -", "快讯:", "快讯—", "快讯 -", "重磅:", "重磅—", "重磅 -",
]
EVENT_TITLE_MARKERS = ["BREAKING", "URGENT", "ALERT", "JUST IN", "FLASH", "DEVELOPING",
                       "EXCLUSIVE"]
BREAKING_MARKERS = ["BREAKING", "URGENT", "ALERT", "JUST IN", "FLASH", "DEVELOPING",
                    "EXCLUSIVE", "突发", "快讯", "紧急", "重磅"]

PRIORITY_WEIGHTS = {
    "breaking": 0.35, "macro_per_tag": 0.12, "macro_cap": 0.36, "ticker_per_hit": 0.08,
    "ticker_cap": 0.24, "resonance_max": 0.20, "deviation": 0.25, "surprise": 0.15,
    "asset_linkage": 0.15, "business_impact": 0.15,
}
PEOPLE_TIER_WEIGHTS = {1: 0.15, 2: 0.10, 3: 0.03}

SOURCE_AUTHORITY = {
    "bloomberg": 0.10, "bloomberg markets": 0.10, "reuters": 0.10, "reuters business": 0.10,
    "cnbc": 0.08, "cnbc top news": 0.08, "cnbc live blog": 0.09, "cnbc economy": 0.07,
    "wsj": 0.10, "wsj markets": 0.10, "marketwatch": 0.06, "yahoo finance": 0.05,
    "seeking alpha": 0.04, "seeking alpha market outlook": 0.04, "investing.com": 0.04,
    "zerohedge": 0.03, "sec edgar 8-k": 0.10, "fred economic releases": 0.09,
    "@elerianm": 0.07, "@lisaabramowicz1": 0.07, "@bespokeinvest": 0.06, "@newsquawk": 0.07,
    "@zerohedge": 0.03, "@fxhedgers": 0.05, "@semianalysis": 0.09,
    "新浪财经·7x24综合快讯": 0.06, "新浪财经·7x24全球财经": 0.06,
    "华尔街见闻·全球快讯": 0.08, "华尔街见闻·美股": 0.06, "华尔街见闻·外汇": 0.05,
    "华尔街见闻·加密货币": 0.05, "华尔街见闻·大宗商品": 0.05,
}
DEFAULT_AUTHORITY = 0.03

# (pattern, group of the actual value, group of the expected value)
DEVIATION_NUMBERS = [
    (r"([\d,.]+[KMB%]?)\s*(?:vs|versus|vs\.)\s*([\d,.]+[KMB%]?)\s*(?:expected|forecast|estimate|est\.?)", 1, 2),
    (r"([\d,.]+%?)\s*\(?(?:expected|forecast|est\.?)\s*([\d,.]+%?)", 1, 2),
    (r"(?:surged?|rose|fell|dropped?|added?|gained?|lost)\s+([\d,.]+[KMB%]?)\s+(?:vs|versus|vs\.)\s+([\d,.]+[KMB%]?)\s*(?:expected|forecast)", 1, 2),
    (r"(?:fell|dropped?|rose|gained?|added?)\s+(-?[\d,.]+%?)\s+(?:vs|versus|vs\.)\s+(?:expected|forecast)\s+([+\-]?[\d,.]+%?)", 1, 2),
    (r"([\d,.]+[KMB%万亿]?)\s*(?:高于|超出|超过|好于|强于)\s*(?:市场|一致)?(?:预期|预估|预测|估计)\w*(?:的\s*)?([\d,.]+[KMB%]?)?", 1, 2),
    (r"([\d,.]+[KMB%万亿]?)\s*(?:低于|不及|弱于|差于|逊于)\s*(?:市场|一致)?(?:预期|预估|预测|估计)\w*(?:的\s*)?([\d,.]+[KMB%]?)?", 1, 2),
    (r"(?:市场|一致)?(?:预期|预估|预测|估计)\s*([\d,.]+[KMB%]?)\s*(?:实际|结果|公布|录得|报)\s*([\d,.]+[KMB%万亿]?)", 2, 1),
]
DEVIATION_DIRECTION = (
    r"(beat|beats|beating|miss|misses|missed|above|below|exceed[s]?|topped)\s+(?:the\s+)?"
    r"(?:expectations|forecasts?|estimates?|consensus)"
)
BEAT_WORDS = ["beat", "beats", "beating", "exceed", "exceeds", "topped", "above"]
MISS_WORDS = ["miss", "misses", "missed", "below"]
DEVIATION_BANDS = [(0.40, 1.0), (0.15, 0.9), (0.07, 0.7), (0.04, 0.5), (0.02, 0.35)]
DEVIATION_SMALLEST, DEVIATION_BEAT, DEVIATION_MISS = 0.2, 0.4, 0.5

SURPRISE_WEIGHTS = {
    "unexpectedly": 1.0, "shock": 1.0, "shocks": 1.0, "surprise": 0.8, "surprises": 0.8,
    "record high": 0.7, "record low": 0.7, "all-time high": 0.7, "all-time low": 0.7,
    "plunge": 0.8, "plunges": 0.8, "surge": 0.7, "surges": 0.7, "tumble": 0.7, "tumbles": 0.7,
    "soar": 0.7, "soars": 0.7, "crash": 0.9, "crashes": 0.9, "panic": 0.9, "meltdown": 0.9,
    "slump": 0.6, "slumps": 0.6, "rout": 0.7, "jump": 0.5, "jumps": 0.5, "leap": 0.5,
    "spike": 0.6, "spikes": 0.6, "unexpected": 0.8, "abruptly": 0.7, "sudden": 0.6,
    "dramatically": 0.6,
    "意外": 0.8, "出乎意料": 0.8, "出人意料": 0.8, "震惊": 0.9, "震惊全球": 1.0, "暴跌": 0.8,
    "暴涨": 0.7, "闪崩": 0.9, "熔断": 0.9, "创纪录": 0.7, "创历史新高": 0.7, "创历史新低": 0.7,
    "历史新高": 0.7, "历史新低": 0.7, "历史最高": 0.7, "崩盘": 0.9, "恐慌": 0.9, "恐慌性": 0.9,
    "黑天鹅": 0.9, "灰犀牛": 0.7, "突然": 0.6, "骤然": 0.6, "急剧": 0.6, "大跌": 0.6, "大涨": 0.5,
    "飙升": 0.7, "骤降": 0.7, "大幅跳涨": 0.7, "大幅跳水": 0.8, "史诗级": 0.8, "历史性": 0.7,
}

BUSINESS_IMPACT_WEIGHTS = {
    "price increase": 0.9, "price hike": 0.9, "raise prices": 0.9, "raises prices": 0.9,
    "raising prices": 0.9, "raised prices": 0.9, "raise price": 0.9, "raises price": 0.9,
    "price raised": 0.85, "price hikes": 0.9, "price rises": 0.85, "rising prices": 0.85,
    "pricing power": 0.8, "passed on to customers": 0.7, "pass through costs": 0.7,
    "cost pass-through": 0.7, "price adjustment": 0.5, "supply chain cost": 0.5,
    "涨价": 0.9, "提价": 0.9, "全面涨价": 0.9, "价格上调": 0.85, "上调价格": 0.85, "定价权": 0.8,
    "转嫁成本": 0.7, "成本传导": 0.7, "价格调整": 0.5, "成本上升": 0.5, "tariff pass": 0.6,
    "tariff cost": 0.6, "import cost": 0.5,
    "record revenue": 0.9, "record sales": 0.9, "record quarter": 0.8, "sales surge": 0.7,
    "demand surge": 0.7, "demand exceeds": 0.7, "revenue beat": 0.7, "topline growth": 0.6,
    "sold out": 0.6, "order backlog": 0.6, "创纪录营收": 0.9, "创纪录收入": 0.9, "销量暴增": 0.7,
    "销量大增": 0.6, "营收超预期": 0.7, "收入超预期": 0.7, "订单积压": 0.6, "供不应求": 0.7,
    "record profit": 0.9, "record earnings": 0.9, "earnings beat": 0.7, "profit beat": 0.7,
    "margin expansion": 0.7, "profit surge": 0.7, "margin compression": 0.7,
    "profit warning": 0.9, "earnings miss": 0.7, "revenue miss": 0.7, "创纪录利润": 0.9,
    "创纪录盈利": 0.9, "毛利率扩张": 0.7, "利润率提升": 0.6, "盈利预警": 0.9, "利润预警": 0.9,
    "利润下滑": 0.7, "利润率压缩": 0.7,
    "raises guidance": 0.8, "raised guidance": 0.8, "lifts forecast": 0.8,
    "lifted forecast": 0.8, "raised outlook": 0.7, "upbeat outlook": 0.6, "cuts guidance": 0.8,
    "cut guidance": 0.8, "lowers forecast": 0.8, "lowered forecast": 0.8, "上调指引": 0.8,
    "上调业绩预期": 0.8, "上调盈利预期": 0.8, "调高业绩指引": 0.8, "下调指引": 0.8,
    "下调业绩预期": 0.8, "调低业绩指引": 0.8,
    "wins contract": 0.7, "won contract": 0.7, "major deal": 0.7, "landmark deal": 0.8,
    "record order": 0.8, "largest order": 0.8, "biggest deal": 0.8, "billion dollar deal": 0.9,
    "billion dollar contract": 0.9, "赢得合同": 0.7, "重大协议": 0.7, "里程碑协议": 0.8,
    "最大订单": 0.8, "创纪录订单": 0.8, "亿元大单": 0.8,
    "cost reduction": 0.6, "cost cutting": 0.6, "efficiency gain": 0.5, "cost overrun": 0.7,
    "input costs rising": 0.6, "cost reduction plan": 0.6, "成本削减": 0.6, "降本增效": 0.6,
    "效率提升": 0.5, "成本超支": 0.7,
}
PRICE_RAISE = r"\b(?:raise|raises|raising|raised|hike|hikes|hiking|hiked)\s+(?:\w+\s+){0,3}(?:price|prices)\b"
PRICE_RAISE_WEIGHT = 0.9

ASSET_CLASSES = {
    "equities": ["s&p", "nasdaq", "dow", "stock", "stocks", "equity", "equities", "index",
                 "indices", "nvidia", "apple", "tesla", "semiconductor", "费城半导体", "板块",
                 "领跌", "领涨", "普跌", "普涨", "auto", "autos", "automaker", "automakers",
                 "automotive", "clean energy", "solar", "ev ", "electric vehicle", "tech",
                 "big tech", "chip", "chips"],
    "bonds": ["bond", "bonds", "treasury", "treasuries", "yield", "yields", "10y", "10-year",
              "2-year", "30-year", "收益率", "国债", "basis point", "bp", "bps", "fed funds"],
    "currencies": ["dollar", "usd", "eur", "jpy", "gbp", "fx", "forex", "currency",
                   "currencies", "dxy", "美元", "汇率", "dollar index"],
    "commodities": ["oil", "crude", "brent", "wti", "gold", "silver", "copper", "commodity",
                    "commodities", "opec", "原油", "黄金", "大宗商品", "natural gas", "energy"],
    "crypto": ["bitcoin", "btc", "ethereum", "eth", "crypto", "比特币", "以太坊",
               "digital asset"],
}
ASSET_CLASS_FACTORS = {0: 0.0, 1: 0.3, 2: 0.6, 3: 0.9, 4: 1.0}

# Asset classes used when deciding whether single-stock news is broad.
BROAD_ASSET_CLASSES = {
    "equities": ["s&p", "sp500", "spx", "nasdaq", "ndx", "dow", "nyse", "stock market",
                 "equity market", "equities", "indices", "板块", "普跌", "普涨"],
    "bonds": ["treasury", "yield", "bond", "10-year", "2-year", "30-year", "basis point",
              "fed funds", "国债", "收益率"],
    "currencies": ["dollar index", "dxy", "usd", "eur", "jpy", "gbp", "forex", "currency",
                   "美元", "汇率"],
    "commodities": ["oil", "crude", "brent", "wti", "gold", "silver", "copper", "commodity",
                    "opec", "原油", "黄金", "大宗商品", "natural gas", "energy"],
    "crypto": ["bitcoin", "btc", "ethereum", "eth", "crypto", "比特币", "以太坊"],
}

# --- geography -------------------------------------------------------------------------
HOTSPOT_NAMES = [
    "Venezuela", "Caracas", "Maduro", "Iran", "Tehran", "Khamenei", "Ayatollah",
    "North Korea", "Pyongyang", "Kim Jong", "Myanmar", "Burma", "Naypyidaw", "Sudan",
    "Khartoum", "Darfur", "Belarus", "Minsk", "Lukashenko", "Cuba", "Havana", "Syria",
    "Damascus", "Afghanistan", "Kabul", "Taliban", "Somalia", "Mogadishu", "Yemen", "Sanaa",
    "Libya", "Tripoli", "Zimbabwe", "Harare", "Congo", "Kinshasa",
]
HOTSPOT_PARTY = ["总书记", "中共中央", "政治局常委", "国务院", "全国人大", "全国政协", "中央纪委",
                 "中央委员会", "中央经济工作会议"]
HOTSPOT_NAMES_CJK = ["委内瑞拉", "加拉加斯", "马杜罗", "伊朗", "德黑兰", "哈梅内伊", "朝鲜", "平壤",
                     "金正恩", "缅甸", "古巴", "叙利亚", "阿富汗", "塔利班", "苏丹", "白俄罗斯",
                     "卢卡申科"]
POLITICAL_ACTIONS = [
    "coup", "d'état", "dictator", "regime", "junta", "state funeral", "national mourning",
    "overthrow", "insurgency", "rebel", "militia", "civil war", "constitutional crisis",
    "parliament", "dissolve", "prime minister", "president", "election", "protest", "refugee",
    "humanitarian", "famine", "rigged", "crackdown", "political prisoner", "general strike",
    "curfew", "martial law", "succession", "coronation", "royal", "union", "parliamentary",
    "government collapse", "collapses",
    "垮台", "流亡", "国葬", "政变", "军政府", "军方接管", "内战", "叛军", "游击队", "人道主义危机",
    "饥荒", "难民", "戒严", "宵禁", "镇压", "政治犯", "党委", "全会", "总书记", "政治局", "国务院",
    "中央委员会", "党代会", "人大", "政协", "团拜", "民主生活会", "主题教育", "学习贯彻",
    "重要讲话精神", "指示", "脱贫攻坚", "乡村振兴", "共同富裕", "中国特色", "两个维护", "四个意识",
]
US_MARKET_CONNECTORS = [
    "US troops", "American forces", "US military", "Pentagon", "美军", "美国军队", "五角大楼",
    "oil supply", "oil price", "crude", "OPEC", "barrel", "油价", "原油", "供应中断", "欧佩克",
    "sanctions", "制裁", "embargo", "chip supply", "semiconductor", "rare earth", "芯片", "半导体",
    "S&P", "NASDAQ", "Dow", "NYSE", "US stock", "US equity", "Wall Street", "美股", "美国股市",
    "White House", "白宫", "Congress", "国会", "Trump", "Biden", "US administration", "contagion",
    "systemic", "IMF", "World Bank", "default", "sovereign debt", "Strait of Hormuz",
    "Bab el-Mandeb", "Suez", "oil tanker", "LNG", "sea lane",
]
US_TIER_PATTERNS = [
    r"\bFederal\s+Reserve\b", r"\bthe\s+Fed\b", r"\bFOMC\b", r"\b(?:Jerome\s+)?Powell\b",
    r"\bWarsh\b", r"\bS&P\s*500\b", r"\bSPX\b", r"\bNASDAQ\b", r"\bNDX\b", r"\bNYSE\b",
    r"\bDow\s+Jones\b", r"\bWhite\s+House\b", r"\bCongress\b", r"\bSenate\b",
    r"\b(?:US\s+)?Treasury\s+Department\b", r"\bUS\s+Treasury\b", r"\bSEC\b",
    r"\bWall\s+Street\b", r"\bSilicon\s+Valley\b", r"\bDXY\b", r"\bdollar\s+index\b",
    r"\bjobless\s+claims\b", r"\binitial\s+claims\b", r"\bcontinuing\s+claims\b",
    r"\bnonfarm\s+payrolls?\b", r"\bNFP\b", r"\bMBA\s+mortgage\b", r"\bFreddie\s+Mac\b",
    r"\bFannie\s+Mae\b", r"\bPhilly\s+Fed\b", r"\bEmpire\s+State\b", r"\bRichmond\s+Fed\b",
    r"\bDallas\s+Fed\b", r"\bChicago\s+PMI\b", r"\bU\.?S\.?\b",
    r"\bAmerican\s+(?:economy|market|consumer|business|manufacturing)\b",
]
US_TIER_CJK = ["美联储", "联邦储备", "鲍威尔", "沃尔什", "联储主席", "标普", "纳斯达克", "道琼斯",
               "纽交所", "纽约证券交易所", "白宫", "美国国会", "美财政部", "美国财政部", "非农",
               "初请失业金", "续请失业金", "美股", "美元指数", "华尔街", "硅谷", "美国CPI", "美国PPI",
               "美国GDP", "美国PMI", "美国ISM", "美国消费者信心", "美国零售", "美国制造业",
               "美国服务业"]
# Regions outside the US.
NON_US_PATTERNS = [
    r"\bECB\b", r"\bEuropean\s+Central\s+Bank\b", r"\bEurozone\b", r"\bEuro\s+area\b",
    r"\bEuropean\s+(?:Union|Commission)\b", r"\b(?:Christine\s+)?Lagarde\b", r"\bEUR\b",
    r"\beuro\b", r"\bBank\s+of\s+England\b", r"\bBoE\b", r"\b(?:Andrew\s+)?Bailey\b",
    r"\bUnited\s+Kingdom\b", r"\bUK\b", r"\bBritain\b", r"\bBritish\b", r"\bFTSE\b", r"\bGBP\b",
    r"\bsterling\b", r"\bGermany\b", r"\bGerman\b", r"\bBerlin\b", r"\bBundesbank\b",
    r"\bDAX\b", r"\bFrance\b", r"\bFrench\b", r"\bParis\b", r"\bCAC\s*40\b", r"\bItaly\b",
    r"\bItalian\b", r"\bSpain\b", r"\bSpanish\b", r"\bNetherlands\b", r"\bDutch\b",
    r"\bSwitzerland\b", r"\bSwiss\b", r"\bSNB\b", r"\bCHF\b", r"\bSweden\b", r"\bSwedish\b",
    r"\bRiksbank\b", r"\bSEK\b", r"\bNorway\b", r"\bNorwegian\b", r"\bNorges\s+Bank\b",
    r"\bNOK\b", r"\bJapan\b", r"\bJapanese\b", r"\bTokyo\b", r"\bBank\s+of\s+Japan\b",
    r"\bBoJ\b", r"\b(?:Kazuo\s+)?Ueda\b", r"\bNikkei\b", r"\bJPY\b", r"\bYen\b", r"\bTOPIX\b",
    r"\bChina\b", r"\bChinese\b", r"\bBeijing\b", r"\bPBOC\b",
    r"\bPeople'?s?\s+Bank\s+of\s+China\b", r"\bCSRC\b", r"\bShanghai\b", r"\bShenzhen\b",
    r"\bCSI\s*300\b", r"\bCNY\b", r"\bRMB\b", r"\bYuan\b", r"\bA-?shares?\b", r"\bA股\b",
    r"\bKorea\b", r"\bKorean\b", r"\bSeoul\b", r"\bBank\s+of\s+Korea\b", r"\bBoK\b",
    r"\bKOSPI\b", r"\bKRW\b", r"\bWon\b", r"\bCanada\b", r"\bCanadian\b", r"\bOttawa\b",
    r"\bBank\s+of\s+Canada\b", r"\bBoC\b", r"\bTSX\b", r"\bCAD\b", r"\bLoonie\b",
    r"\bAustralia\b", r"\bAustralian\b", r"\bSydney\b", r"\bRBA\b", r"\bASX\b", r"\bAUD\b",
    r"\bNew\s+Zealand\b", r"\bWellington\b", r"\bRBNZ\b", r"\bNZD\b", r"\bTaiwan\b",
    r"\bTaipei\b", r"\bTaiwanese\b", r"\bTWSE\b", r"\bTWD\b", r"\bHong\s+Kong\b", r"\bHK\b",
    r"\bHang\s+Seng\b", r"\bHSI\b", r"\bHKMA\b", r"\bHKD\b", r"\bIndia\b", r"\bIndian\b",
    r"\bMumbai\b", r"\bDelhi\b", r"\bRBI\b", r"\bNSE\b", r"\bBSE\b", r"\bSensex\b",
    r"\bNifty\b", r"\bINR\b", r"\bRupee\b", r"\bBrazil\b", r"\bBrazilian\b", r"\bBrasilia\b",
    r"\bSao\s+Paulo\b", r"\bBCB\b", r"\bBovespa\b", r"\bBRL\b", r"\bReal\b",
    r"\bTurkey\b", r"\bTurkish\b", r"\bAnkara\b", r"\bIstanbul\b", r"\bTCMB\b", r"\bLira\b", r"\bTRY\b",
    r"\bSouth\s+Africa\b", r"\bSARB\b", r"\bRand\b", r"\bZAR\b",
    r"\bIndonesia\b", r"\bIndonesian\b", r"\bJakarta\b", r"\bBank\s+Indonesia\b", r"\bIDR\b", r"\bRupiah\b",
    r"\bMalaysia\b", r"\bMalaysian\b", r"\bKuala\s+Lumpur\b", r"\bBNM\b", r"\bRinggit\b", r"\bMYR\b",
    r"\bThailand\b", r"\bThai\b", r"\bBangkok\b", r"\bBoT\b", r"\bBaht\b", r"\bTHB\b",
    r"\bPhilippines\b", r"\bFilipino\b", r"\bManila\b", r"\bBSP\b", r"\bPeso\b", r"\bPHP\b",
    r"\bVietnam\b", r"\bVietnamese\b", r"\bHanoi\b", r"\bDong\b", r"\bVND\b",
    r"\bSingapore\b", r"\bSingaporean\b", r"\bMAS\b", r"\bSGD\b", r"\bSTI\b",
    r"\bMexico\b", r"\bMexican\b", r"\bBanxico\b", r"\bMXN\b", r"\bChile\b", r"\bSantiago\b", r"\bCLP\b",
    r"\bArgentina\b", r"\bBuenos\s+Aires\b", r"\bARS\b", r"\bColombia\b", r"\bBogota\b", r"\bCOP\b",
    r"\bPoland\b", r"\bPolish\b", r"\bWarsaw\b", r"\bNBP\b", r"\bPLN\b", r"\bCzech\b", r"\bPrague\b", r"\bCNB\b",
    r"\bCZK\b", r"\bRussia\b", r"\bRussian\b", r"\bMoscow\b", r"\bCBR\b", r"\bRuble\b", r"\bRUB\b", r"\bMOEX\b",
    r"\bNigeria\b", r"\bLagos\b", r"\bCBN\b", r"\bNaira\b", r"\bNGN\b", r"\bEgypt\b", r"\bCairo\b", r"\bEGP\b",
    r"\bPakistan\b", r"\bKarachi\b", r"\bIslamabad\b", r"\bPKR\b", r"\bBangladesh\b", r"\bDhaka\b",
    r"\bSaudi\s+Arabia\b", r"\bSaudi\b", r"\bRiyadh\b", r"\bSAMA\b", r"\bUAE\b", r"\bEmirates\b", r"\bDubai\b",
    r"\bAbu\s+Dhabi\b", r"\bIsrael\b", r"\bIsraeli\b", r"\bTel\s+Aviv\b", r"\bBank\s+of\s+Israel\b",
    r"\bQatar\b", r"\bDoha\b", r"\bKuwait\b", r"\bUkraine\b", r"\bUkrainian\b", r"\bKyiv\b",
]
NON_US_CJK = [
    "欧洲央行", "欧央行", "拉加德", "欧元区", "欧盟委员会", "德国", "柏林", "德联邦银行", "DAX",
    "法国", "巴黎", "CAC40", "英国", "伦敦", "英央行", "英镑", "富时", "英格伦", "意大利", "西班牙",
    "荷兰", "瑞士", "瑞典", "挪威", "日本", "东京", "日本央行", "日银", "日元", "植田和男", "日经", "中国",
    "中国央行", "人民银行", "中国人民银行", "证监会", "银保监", "上海", "深圳", "沪深300", "人民币", "在岸", "离岸人民币", "A股", "韩国",
    "首尔", "韩元", "韩国央行", "KOSPI", "加拿大", "渥太华", "加元", "加拿大央行", "澳大利亚", "澳洲", "悉尼", "澳元", "澳洲央行", "台湾",
    "台北", "台币", "台股", "加权指数", "香港", "恒生", "港币", "金管局", "港股", "印度", "孟买",
    "新德里", "卢比", "印度央行", "Sensex", "巴西", "圣保罗", "雷亚尔", "巴西央行", "土耳其", "里拉", "南非", "兰特", "印尼",
    "雅加达", "印尼盾", "马来西亚", "吉隆坡", "令吉", "泰国", "曼谷", "泰铢", "菲律宾", "马尼拉", "比索",
    "越南", "河内", "胡志明", "越南盾", "新加坡", "新元", "新加坡元", "墨西哥", "墨西哥比索", "阿根廷", "布宜诺斯艾利斯", "俄罗斯",
    "莫斯科", "卢布", "沙特", "利雅得", "阿联酋", "迪拜", "以色列", "特拉维夫", "乌克兰", "基辅",
    "广东", "北京", "广州", "浙江", "江苏", "山东", "四川", "湖北", "河南", "河北", "湖南", "福建",
    "安徽", "辽宁", "重庆", "天津", "陕西", "江西", "广西", "云南", "贵州", "山西", "吉林", "黑龙江",
    "甘肃", "海南", "内蒙古", "宁夏", "青海", "西藏", "新疆",
]

# --- content quality -------------------------------------------------------------------
GOSSIP_PATTERNS = [
    r"(trump|biden)\s+(defend|defends|rally|interview|speech|campaign)",
    r"(president|former\s+president)\s+(defend|interview|rally|campaign)",
    r"exclusive\s+interview.*(president|trump|biden)",
    r"(sued|sues|lawsuit|suing)\s+(for|over).*\b(governor|congressman|senator|mayor)\b",
    r"\b(governor|congressman|senator|mayor)\b.*(sued|sues|lawsuit|scandal)",
    r"(defend|defends).{0,30}(child|children|son|daughter|family)",
    r"(divorce|affair|scandal)\b.{0,30}(president|senator|congressman)",
    r"(州长|州政府|市长|议员|州议).{0,20}(诉讼|控告|和解|赔偿)",
    r"(诉讼|控告).{0,20}(州长|州政府|市长|议员)",
    r"家族基金.{0,20}(和解|赔偿|诉讼)",
    r"(丑闻|婚外情|离婚).{0,20}(总统|州长|议员|国会)",
    r"(特朗普|川普).{0,10}(辩护|辩解|回应|采访|集会|竞选)",
    r"(总统|前总统).{0,10}(辩护|辩解|采访|集会)",
]
PROPAGANDA_MARKERS = ["党委", "全会精神", "学习贯彻", "重要讲话", "主题教育", "民主生活会", "团拜",
                      "两个维护", "四个意识", "四个自信", "新时代中国特色社会主义", "巡视整改",
                      "全面从严治党", "党史学习教育", "不忘初心"]
PROPAGANDA_REDEEMERS = ["chip", "semiconductor", "nvidia", "英伟达", "nvda", "sanction", "tariff",
                        "制裁", "关税", "stock", "market", "股市", "美股", "invest", "funding",
                        "入股", "投资", "oil", "crude", "原油", "war", "military", "战争", "军事"]
A_SHARE_PATTERNS = [r"(涨停|跌停|一字板|地天板|天地板)", r"(尾盘|午盘|早盘).{0,5}(拉升|跳水|异动)",
                    r"\d{6}"]
SINGLE_STOCK_PATTERNS = [
    r"(stock|shares?)\s+(up|down|rise|fall|surge|drop|jump)\s+\d+%",
    r"(surge|plunge|soar|tumble|skyrocket)[sd]?\s+\d+%",
    r"(stock|shares?)\s+(edge|inch|drift|slip|dip|tick)[sd]?\s+(higher|lower|up|down)",
    r"(stock|shares?)\s+(flat|mixed|little\s+changed|barely\s+moved)",
    r"trade[sd]?\s+(higher|lower|flat|down|up)\s+(in|on|after|amid)",
    r"\b(CEO|CFO|COO)\b.{0,30}(sells?|sold|buy|bought)\s+\$?\d+",
    r"analyst\s+(upgrade|downgrade|initiate|raise|lower|cut|boost)",
    r"price\s+target\s+(raised|lowered|cut|boosted|trimmed)",
    r"(earnings|revenue|eps)\s+(beat|miss|missed).{0,30}(estimate|forecast)",
    r"form\s+4.{0,20}(by|filing|filed)",
    r"insider\s+(sell|sale|buy|purchase)",
]
ROUTINE_POLITICS_PATTERNS = [
    r"(sworn\s+in|appointed|named\s+as|takes?\s+over|will\s+become)",
    r"(elected|re-elected|won\s+(the\s+)?election|vote\s+of\s+confidence)",
    r"(state\s+funeral|national\s+mourning|day\s+of\s+mourning)",
    r"(lays?\s+wreath|memorial\s+service|tribute\s+to)",
    r"(visits?\s+\w+\s+(?:in|for)\s+\w+\s+talks?)",
    r"(meets?\s+with|held\s+talks|bilateral\s+meeting)",
]
ROUTINE_POLITICS_REDEEMERS = ["us ", "u.s.", "american", "united states", "wall street", "s&p",
                              "nasdaq", "dow", "oil", "crude", "sanction", "trade war", "美国",
                              "美军", "美股"]
MEGA_CAPS = ["aapl", "msft", "nvda", "googl", "amzn", "meta", "tsla", "amd", "intc", "avgo",
             "orcl", "adbe", "crm", "nflx", "jpm", "gs", "bac", "wmt", "xom", "cvx", "pfe",
             "mrna"]
MASSIVE_MOVE_PATTERNS = [
    r"(surge|soar|skyrocket|plunge|plummet|crash|tumble|collapse)[sd]?\s+\d{2,}%",
    r"(jump|leap|spike|drop|fall|sink)[sd]?\s+(1[5-9]|[2-9]\d)%",
    r"(up|down|rise|fall)\s+(1[5-9]|[2-9]\d)%",
    r"(record|historic|biggest|largest)\s+(drop|fall|surge|gain|rally)",
    r"market\s+cap\s+(evaporat|wiped|erased|lost)\s+\$?\d+",
    r"(lost|lose|gain|add)[sd]?\s+\$?\d+\s*(billion|trillion)",
]
DRUG_SIGNALS = ["fda approval", "fda approved", "fda clearance", "breakthrough therapy",
                "accelerated approval", "priority review", "fast track designation",
                "fda 批准", "突破性疗法", "加速批准"]
DEAL_PATTERNS = [
    r"(acquire|acquisition|buy|takeover|purchase)[sd]?.{0,50}?(for|at|worth)\s+\$?[\d,.]+",
    r"(merge|merger|deal)\s+(worth|valued at|for)\s+\$?[\d,.]+",
    r"\$?[\d,.]+?\s*(billion|bn|million)\s+(acquisition|buyout|takeover|deal)",
    r"(收购|并购|要约收购)\s*\d+\s*(亿|万)",
]
LEADER_CHANGE_PATTERNS = [
    r"(ceo|chief executive|founder)\s+(step|resign|oust|fir|exit|leav|depart)",
    r"(new|name|appoint)\s+(ceo|chief executive)",
    r"(ceo|总裁|创始人).{0,20}(辞职|离职|卸任|被罢免|被解雇|下课)",
    r"(任命|聘请|委任).{0,20}(ceo|总裁|首席执行官)",
]
US_SIGNALS = [
    "s&p", "nasdaq", "dow", "nyse", "wall street", "sp500", "spx", "ndx", "vix", "fomc",
    "federal reserve", "fed ", "jerome powell", "cpi", "ppi", "nfp", "nonfarm", "gdp",
    "unemployment", "treasury", "10-year", "2-year", "nvidia", "英伟达", "apple", "苹果",
    "microsoft", "微软", "google", "alphabet", "amazon", "亚马逊", "meta", "tesla", "特斯拉", "amd",
    "intel", "broadcom", "marvell", "white house", "白宫", "congress", "国会", "us government",
    "chips act", "芯片法案", "inflation reduction act", "executive order", "行政命令", "sanctions",
    "制裁", "tariff", "关税", "trade war", "贸易战", "oil supply", "原油供应", "crude", "opec",
    "gold", "黄金", "bitcoin", "btc", "比特币", "美股", "美联储", "纳斯达克", "标普", "道琼斯",
    "华尔街", "硅谷",
]
NOISE_TITLE_WORDS = [
    "党委", "学习贯彻", "全会精神", "主题教育", "民主生活会", "团拜", "重要讲话", "指示精神",
    "新时代中国特色社会主义", "两个维护", "四个意识", "四个自信", "党史学习教育", "不忘初心",
    "牢记使命", "巡视整改", "全面从严治党", "中心组学习", "意识形态", "统战", "涨停", "跌停",
    "连续涨停", "一字板", "地天板", "天地板", "封板", "炸板", "尾盘拉升", "尾盘跳水", "油价调整",
    "成品油价格", "限行通知", "天气预报", "交通管制", "停水停电", "文体活动", "文艺汇演",
]

# --- labelled cases: fixed values of the additive headline heuristic --------------------
CASE_BASE, CASE_CAP = 0.30, 1.0
# group, words, weight, groups that rule it out
CASE_TERMS = [
    ("comment", ["admits", "no-win", "despite record", "complains", "lament"], 0.05, []),
    ("tone", ["crash", "plunge", "surge", "emergency", "circuit breaker", "evaporates", "bailout"], 0.15, ["comment"]),
    ("scale", ["49.5 billion", "52 billion", "500 billion", "80 billion"], 0.15, ["comment"]),
    ("state", ["government", "pentagon", "defense department", "commerce dept", "energy department", "chips act",
               "treasury", "congress", "washington", "us invests", "us commerce"], 0.10, []),
    ("person", ["jensen huang"], 0.10, []),
    ("company", ["nvidia"], 0.08, []),
]
CASE_AMOUNT = r"(\d+)\s*(?:billion|B)"  # each amount adds the weight of the first bound it reaches
CASE_AMOUNT_BOUNDS = [(100, 0.12), (10, 0.08), (1, 0.04)]
CASE_COMPANIES = ["intel", "amd", "qualcomm", "nvidia", "tsmc", "samsung", "ibm", "microsoft", "apple", "tesla", "google", "meta", "amazon"]
CASE_COMPANY_BOUNDS = [(3, 0.08), (1, 0.04)]  # by the number of mentions
