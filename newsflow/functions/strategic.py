"""Strategic-relationship matches as one array expression per text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import strategic_words as W
from .lexicon import Found, Lexicon
from .text import matches_any, struct_array
from .vocabulary import strategic_lists

HIGH, MEDIUM = 0.85, 0.65
MATCH = "array<struct<conf:double,seq:int,category:string,text:string>>"


def _worth(word: str, rules, side: int) -> tuple[float, int]:
    """(bonus, pair-rule mask) of one dictionary word."""
    low = word.lower()
    bonus = sum(value for value, fragments in rules if any(f in low for f in fragments))
    mask = sum(1 << i for i, rule in enumerate(W.PAIR_RULES) if any(f in low for f in rule[side]))
    return round(bonus, 6), mask


def _entries(words, rules, side: int) -> list[tuple[str, str, float, int]]:
    return [(w, w.lower(), *_worth(w, rules, side)) for w in dict.fromkeys(words)]


def _table(entries) -> Column:
    return struct_array([{"word": w, "low": low, "bonus": float(b), "mask": m} for w, low, b, m in entries])


def _lookup(entries, word: Column) -> Column:
    """Dictionary entry of a matched lower-case word."""
    return F.get(F.filter(_table(entries), lambda e: e["low"] == word), F.lit(0))


def confidence(entity: Column, action: Column) -> Column:
    """How surely (entity, action) is a strategic event: 0.5 plus bonuses, at most 1."""
    pair = F.when(entity["mask"].bitwiseAND(action["mask"]) != 0, W.PAIR_BONUS).otherwise(F.lit(0.0))
    return F.least(F.round(F.lit(0.5) + action["bonus"] + entity["bonus"] + pair, 6), F.lit(1.0))


def _alternation(words) -> str:
    """Alternatives grouped by first character; the listed order decides within a group, as only
    words of one group can start at one position."""
    groups: dict[str, list[str]] = {}
    for word in dict.fromkeys(words):
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{re.escape(head)}(?:{'|'.join(re.escape(t) for t in tails)})" for head, tails in groups.items())


def _found(conf: Column, seq: int, category: str, text: Column) -> Column:
    return F.struct(conf.cast("double").alias("conf"), F.lit(seq).alias("seq"),
                    F.lit(category).alias("category"), text.alias("text"))


def _government(low: Column, entities, actions, found: Found) -> Column:
    """Per named entity, the first listed action within 80 characters that is convincing."""
    named = F.transform(found.places("government"), lambda p: F.get(_table(entities), p))
    acts = Lexicon({"action": [a[1] for a in actions]})

    def first_action(entity: Column) -> Column:
        after = F.substr(low, F.instr(low, entity["low"]) + F.length(entity["low"]), F.lit(80))
        said = F.transform(acts.found(after).places("action"), lambda p: F.get(_table(actions), p))
        action = F.get(F.filter(said, lambda a: confidence(entity, a) >= MEDIUM), F.lit(0))
        return F.struct(entity.alias("e"), action.alias("a"))

    pairs = F.filter(F.transform(named, first_action), lambda p: p["a"].isNotNull())
    return F.transform(pairs, lambda p: _found(
        confidence(p["e"], p["a"]), 0, "gov_intervention", F.concat(p["e"]["word"], F.lit(" ... "), p["a"]["word"])))


def _regex_pairs(low: Column, pattern: str, entity_group: int, action_group: int, entities, actions) -> Column:
    """Matched (entity, action) pairs with what each is worth. ``pattern`` has the whole match as
    group 1; entity and action are read from that short piece."""
    pieces = F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))
    return F.transform(pieces, lambda m: F.struct(
        _lookup(entities, F.regexp_extract(m, pattern, entity_group)).alias("e"),
        _lookup(actions, F.regexp_extract(m, pattern, action_group)).alias("a")))


def _company(low: Column, actions, reach: int, seq: int, category: str, entities, skip=()) -> Column:
    pattern = f"(({_alternation([e[1] for e in entities])}).{{0,{reach}}}?({_alternation([a[1] for a in actions])}))"
    pairs = F.array_distinct(_regex_pairs(low, pattern, 2, 3, entities, actions))
    kept = F.filter(pairs, lambda p: confidence(p["e"], p["a"]) >= MEDIUM)
    if skip:
        kept = F.filter(kept, lambda p: ~F.lower(p["a"]["word"]).isin([w.lower() for w in skip]))
    return F.transform(kept, lambda p: _found(confidence(p["e"], p["a"]), seq, category,
                                              F.concat(p["e"]["word"], F.lit(" ... "), p["a"]["word"])))


def strategic_matches(text: Column, government=W.GOVERNMENT_ENTITIES, company=W.COMPANY_ENTITIES,
                      investment=W.INVESTMENT_ACTIONS, subsidy=W.SUBSIDY_ACTIONS,
                      policy=W.POLICY_ACTIONS, endorsement=W.ENDORSEMENT_ACTIONS,
                      threat=W.THREAT_ACTIONS, exclusions=W.EXCLUSION_PATTERNS, found: Found | None = None) -> Column:
    """Array of (conf, seq, category, text), most confident first; empty when none.

    ``found`` answers for ``strategic_lists`` of the same words from a scan of the lower-case text.
    """
    gov = _entries(government, W.ENTITY_BONUSES, 0)
    firm = _entries(company, W.ENTITY_BONUSES, 0)
    acts = _entries([*investment, *subsidy, *policy, *endorsement], W.ACTION_BONUSES, 1)
    praise, threats = (_entries(w, W.ACTION_BONUSES, 1) for w in (endorsement, threat))
    low = F.lower(text)
    nothing = F.array().cast(MATCH)
    links = "|".join(W.PASSIVE_LINKS)
    passive_rx = (f"(({_alternation([a[1] for a in acts])}).{{0,15}}?({links}).{{0,15}}?"
                  f"({_alternation([g[1] for g in gov])}))")
    passive = F.transform(
        F.filter(_regex_pairs(low, passive_rx, 4, 2, gov, acts), lambda p: confidence(p["e"], p["a"]) * 0.9 >= MEDIUM),
        lambda p: _found(F.round(confidence(p["e"], p["a"]) * 0.9, 6), 1, "gov_intervention",
                         F.concat(p["a"]["word"], F.lit(" by "), p["e"]["word"])))
    if found is None:
        found = Lexicon(strategic_lists(government, company, [*investment, *subsidy, *policy, *endorsement], threat)).found(low)
    # a relation needs both its sides; the scan keeps the patterns off all other texts
    acting, threatening = found.any("action"), found.any("threat")
    gov_part = F.when(found.any("government") & acting, F.concat(
        _government(low, gov, acts, found), F.when(low.rlike(links), passive).otherwise(nothing))).otherwise(nothing)
    firm_part = F.when(found.any("company") & (acting | threatening), F.concat(
        F.when(acting, F.concat(_company(low, acts, 80, 2, "nvda_investment", firm, endorsement),
                                _company(low, praise, 80, 3, "nvda_endorsement", firm))).otherwise(nothing),
        F.when(threatening, _company(low, threats, 60, 4, "nvda_competitive_threat", firm)).otherwise(nothing))).otherwise(nothing)
    excluded = matches_any(text, exclusions, "(?iU)")
    kept = F.filter(F.concat(gov_part, firm_part), lambda m: (m["conf"] >= HIGH) | ~excluded)
    ordered = F.array_sort(kept, lambda a, b: F.when(a["conf"] > b["conf"], -1).when(
        a["conf"] < b["conf"], 1).when(a["seq"] < b["seq"], -1).when(
        a["seq"] > b["seq"], 1).otherwise(0))
    return F.when(F.length(text) >= 6, ordered).otherwise(nothing)


def best_category(matches: Column) -> Column:
    return F.get(matches, F.lit(0))["category"]
