"""Boolean and multiplier expressions that decide whether a text is market-relevant."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import dictionaries as D
from . import entities as E
from . import signal_words as S
from .lexicon import Found, Lexicon
from .text import any_of, contains_any, empty, is_chinese_dominant, matches_any, matches_word, struct_array


def _lowered(words) -> list[str]:
    return [w.lower() for w in words]


def _has(found: Found | None, name: str, low: Column, words) -> Column:
    """A word of the list is contained: answered from the scan where there is one."""
    return found.any(name) if found else contains_any(low, words)


# --- noise titles -----------------------------------------------------------------------------
def is_noise_title(c: Column, words=D.NOISE_TITLE_WORDS) -> Column:
    return contains_any(c, words)


# --- geography --------------------------------------------------------------------------------
def geo_market_multiplier(c: Column, found: Found | None = None) -> Column:
    """1.0 unless the text is about a political hot spot without a US-market connector."""
    low = F.lower(c)
    named = matches_word(low, D.HOTSPOT_NAMES)
    party = _has(found, "party", low, D.HOTSPOT_PARTY)
    hot = named | party | _has(found, "hotspot", low, D.HOTSPOT_NAMES_CJK)
    connected = _has(found, "connector", low, _lowered(D.US_MARKET_CONNECTORS))
    political = _has(found, "political", low, _lowered(D.POLITICAL_ACTIONS))
    return (F.when(empty(c) | ~hot, 1.0).when(connected, 1.0)
            .when(political & party & ~named, 0.15).when(political, 0.2).otherwise(0.6))


def geo_tier_weight(c: Column, has_tickers: Column, extra_patterns=(), extra_words=()) -> Column:
    """0.25 for non-US regional news, 1.0 for US, company or unclassified news.

    ``extra_patterns`` and ``extra_words`` add regions to the built-in lists.
    """
    low = F.lower(c)
    us = matches_word(low, D.US_TIER_PATTERNS) | contains_any(c, D.US_TIER_CJK)
    abroad = (matches_word(low, [*D.NON_US_PATTERNS, *extra_patterns])
              | contains_any(c, [*D.NON_US_CJK, *extra_words]))
    return F.when(has_tickers | empty(c) | us, 1.0).when(abroad, 0.25).otherwise(1.0)


# --- quality ----------------------------------------------------------------------------------
def is_propaganda(c: Column, found: Found | None = None) -> Column:
    low = F.lower(c)
    return _has(found, "propaganda", low, D.PROPAGANDA_MARKERS) & ~_has(found, "redeemer", low, D.PROPAGANDA_REDEEMERS)


def has_multi_asset(c: Column, classes=D.BROAD_ASSET_CLASSES, found: Found | None = None) -> Column:
    low = F.lower(c)
    hits = [_has(found, f"broad:{name}", low, words).cast("int") for name, words in classes.items()]
    return sum(hits[1:], hits[0]) >= 2


def is_major_stock_event(c: Column, has_tickers: Column, found: Found | None = None) -> Column:
    low = F.lower(c)
    mega = _has(found, "mega", low, D.MEGA_CAPS)
    move = matches_any(low, D.MASSIVE_MOVE_PATTERNS, "")
    drug = _has(found, "drug", low, D.DRUG_SIGNALS)
    deal = matches_any(low, D.DEAL_PATTERNS, "")
    leader = matches_any(low, D.LEADER_CHANGE_PATTERNS, "")
    return (mega & (has_tickers | leader | drug)) | move | deal | ((drug | leader) & has_tickers)


def is_single_stock_noise(c: Column, has_tickers: Column, found: Found | None = None) -> Column:
    low = F.lower(c)
    a_share = matches_any(low, D.A_SHARE_PATTERNS, "")
    trivial = matches_any(low, D.SINGLE_STOCK_PATTERNS)
    return a_share | (trivial & ~has_multi_asset(c, found=found) & ~is_major_stock_event(c, has_tickers, found))


def is_political_gossip(c: Column, has_tickers: Column) -> Column:
    return ~has_tickers & matches_any(F.lower(c), D.GOSSIP_PATTERNS)


def is_routine_politics(c: Column, has_tickers: Column, found: Found | None = None) -> Column:
    low = F.lower(c)
    return (~has_tickers & matches_any(low, D.ROUTINE_POLITICS_PATTERNS, "(?iU)")
            & ~_has(found, "routine_redeemer", low, D.ROUTINE_POLITICS_REDEEMERS))


def has_us_signal(c: Column, has_tickers: Column, found: Found | None = None) -> Column:
    return has_tickers | _has(found, "us_signal", F.lower(c), D.US_SIGNALS)


def content_quality_multiplier(c: Column, has_tickers: Column, strategic: Column, found: Found | None = None) -> Column:
    """Lowest applicable demotion; strategic news is exempt, propaganda is final."""
    low = F.lower(c)
    one = F.lit(1.0)
    lowest = F.least(
        F.when(is_chinese_dominant(low) & ~has_us_signal(c, has_tickers, found), 0.5).otherwise(one),
        F.when(is_single_stock_noise(c, has_tickers, found), 0.30).otherwise(one),
        F.when(is_political_gossip(c, has_tickers), 0.30).otherwise(one),
        F.when(is_routine_politics(c, has_tickers, found), 0.20).otherwise(one))
    return (F.when(empty(c) | strategic, 1.0).when(is_propaganda(c, found), 0.15).otherwise(lowest))


def content_quality_penalty(c: Column) -> Column:
    """Discount for recaps, threats not yet carried out and bare appointments."""
    low = F.lower(c)
    one = F.lit(1.0)
    return F.least(
        F.when(matches_any(low, S.RETROSPECTIVE_PATTERNS, "(?U)"), 0.5).otherwise(one),
        F.when(matches_any(low, S.THREAT_PATTERNS, "(?U)"), 0.65).otherwise(one),
        F.when(low.rlike("(?U)" + S.PERSONNEL_PATTERN) & ~low.rlike(S.POLICY_PATTERN),
               0.55).otherwise(one))


# --- gates ------------------------------------------------------------------------------------
def quality_reason(title: Column, snippet: Column) -> Column:
    """Why an article cannot be evaluated; 'ok' when it can."""
    t = F.coalesce(title, F.lit(""))
    longest = F.greatest(F.length(F.coalesce(snippet, F.lit(""))), F.length(t))
    return (F.when(F.length(F.trim(t)) < 5, "title_too_short")
            .when(longest < 50, "content_too_short")
            .when(t.contains("\0"), "null_byte_in_title").otherwise("ok"))


def explainability_issues(steps: Column, breadth: Column, category: Column,
                          impact: Column) -> Column:
    n = F.coalesce(F.size(steps), F.lit(0))
    checks = [
        ((n < 4) | (n > 6), F.concat(F.lit("reasoning_chain has "), n.cast("string"),
                                     F.lit(" steps, expected ~5"))),
        (F.exists(steps, lambda s: empty(s)), F.lit("empty reasoning step")),
        ((breadth == "cross_asset") & (impact < 30), F.lit("cross_asset with low score")),
        ((category == "monetary") & (impact < 20), F.lit("monetary event scored too low")),
    ]
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in checks]))


def is_macro_title(title: Column, indicators=E.MACRO_INDICATORS) -> Column:
    words = [w for _, keywords in indicators.values() for w in keywords]
    return F.coalesce(title.rlike("(?iu)" + "|".join(re.escape(w) for w in words)), F.lit(False))


def macro_indicator(title: Column, indicators=E.MACRO_INDICATORS,
                    preview=E.PREVIEW_WORDS) -> Column:
    """Struct(keyword, indicator, tier) of the first listed keyword; null for previews."""
    low = F.lower(title)
    rows = [{"keyword": w, "indicator": name, "tier": tier} for name, (tier, keywords) in indicators.items() for w in keywords]
    place = F.get(Lexicon({"words": [r["keyword"].lower() for r in rows]}).found(low).places("words"), F.lit(0))
    return F.when(~contains_any(low, _lowered(preview)), F.get(struct_array(rows), place))


def is_macro_text(text: Column, tag_text: Column, words=S.MACRO_WORDS) -> Column:
    both = F.lower(F.concat_ws(" ", text, tag_text))
    return contains_any(both, words)


def is_borderline(composite: Column, low: float = 0.30, high: float = 0.70) -> Column:
    return composite.between(low, high)


def contains_urgent(c: Column, keywords) -> Column:
    low = F.lower(c)
    words = [k.strip().lower() for k in keywords if k.strip()]
    return any_of([low.contains(w) for w in words])
