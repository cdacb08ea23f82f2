"""Capital-flow text feeds and labelled case files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import entities as E
from ..functions.text import market_name, strip
from ..operators.windows import top_per_key


def parse_flow_klines(lines: DataFrame, line: str = "line", market: str = "market_number") -> DataFrame:
    """'date,main,super,big,mid,small,pct' lines; malformed rows are skipped."""
    p = F.split(line, ",")
    names = ["main_net", "super_net", "big_net", "mid_net", "small_net", "main_pct"]
    out = lines.withColumn("_p", p).filter(F.size("_p") >= 7)
    cols = [F.trim(F.get("_p", F.lit(i + 1))).try_cast("double").alias(n) for i, n in enumerate(names)]
    keep = [c for c in lines.columns if c not in (line, market)]
    extra = [market_name(F.col(market)).alias("market")] if market in lines.columns else []
    return (out.select(*keep, *extra, F.trim(F.get("_p", F.lit(0))).try_cast("date").alias("date"), *cols)
            .dropna(subset=["date", *names]))


def parse_flow_array(docs: DataFrame, max_days: int, body: str = "body", key: str = "ticker") -> DataFrame:
    """Parenthesised JSON array of long CSV strings; the last ``max_days`` entries of each."""
    inner = F.regexp_replace(F.regexp_replace(strip(F.col(body)), r"^\(", ""), r"\)?;?$", "")
    items = F.from_json(inner, "array<string>")
    last = F.slice(items, F.greatest(F.size(items) - max_days + 1, F.lit(1)), max_days)
    rows = docs.select(key, F.explode(last).alias("l")).withColumn("_p", F.split("l", ",")).filter(F.size("_p") >= 23)
    at = {"main_net": 3, "main_pct": 4, "super_net": 7, "big_net": 11, "mid_net": 15, "small_net": 19,
          "close": 21, "change_pct": 22}
    cols = [F.trim(F.get("_p", F.lit(i))).try_cast("double").alias(n) for n, i in at.items()]
    return (rows.select(key, F.trim(F.get("_p", F.lit(0))).try_cast("date").alias("date"), *cols)
            .dropna(subset=["date", *at]))


def parse_event_corpus(docs: DataFrame, body: str = "value", doc: str = "path",
                       sections=E.CORPUS_SECTIONS, scores=E.IMPACT_SCORES) -> DataFrame:
    """Markdown corpora (one row per file) to labelled events.

    A "## " heading sets the category, "### N.M" starts an event, "- **field**:" lines fill it.
    Files are independent; inside a file the text is split with array functions, so no line
    order has to survive a shuffle.
    """
    blocks = F.split(body, r"(?m)^##(?!#)\s+")
    parts = docs.select(doc, F.posexplode(blocks).alias("section_no", "block")).filter("section_no > 0")
    head = F.substring_index("block", "\n", 1)
    category = F.lit("")
    for word, name in reversed(list(sections.items())):
        category = F.when(head.contains(word), name).otherwise(category)
    events = (parts.select(doc, "section_no", category.alias("category"),
                           F.posexplode(F.split("block", r"(?m)^###\s+(?=\d+\.\d+)")).alias("event_no", "e"))
              .filter("event_no > 0"))

    def field(name: str):
        return strip(F.regexp_extract("e", rf"(?m)^\s*- \*\*{name}\*\*:[ \t]*(.*)$", 1))

    level_text = F.upper(field("影响级别"))
    level = F.lit("MEDIUM")
    for word in reversed(E.IMPACT_LEVELS):
        level = F.when(level_text.contains(word), word).otherwise(level)
    score = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    tickers = F.filter(F.transform(F.split(field("受影响标的"), ","), lambda t: strip(t)), lambda t: t != "")
    tags = F.filter(F.transform(F.split(field("分类标签"), ","), lambda t: F.regexp_replace(t, r"^[`\s]+|[`\s]+$", "")),
                    lambda t: t != "")
    return (events.select(doc, "section_no", "event_no", field("日期").alias("date"), field("事件").alias("text"),
                          level.alias("level"), field("市场反应").alias("reaction"), tickers.alias("tickers"),
                          tags.alias("tags"), "category",
                          F.regexp_extract("e", r"(?m)^\s*- \*\*优先级评分参考\*\*:\s*([\d.]+)", 1)
                          .try_cast("double").alias("reference_priority"))
            .withColumn("score", F.try_element_at(score, F.col("level"))).filter("text <> ''"))


def read_event_corpus(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    return parse_event_corpus(raw)


def read_cases(spark: SparkSession, path: str, leaked: DataFrame | None = None) -> DataFrame:
    """Labelled JSON lines; ``leaked`` (case_id) rows are left out."""
    df = spark.read.schema(schemas.CASES).json(path)
    return df.join(leaked.select("case_id"), "case_id", "left_anti") if leaked is not None else df
