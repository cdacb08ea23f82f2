"""The word lists of the news rules as one lexicon, so that a text is scanned once for all of them."""

from __future__ import annotations

from . import dictionaries as D
from . import entities as E
from . import signal_words as S
from . import strategic_words as W
from .lexicon import Lexicon


def lowered(words) -> list[str]:
    return [w.lower() for w in words]


def score_lists() -> dict[str, list[str]]:
    """Lists of the priority score."""
    return {"surprise": list(D.SURPRISE_WEIGHTS), "business": list(D.BUSINESS_IMPACT_WEIGHTS),
            **{f"asset:{name}": words for name, words in D.ASSET_CLASSES.items()}}


def filter_lists() -> dict[str, list[str]]:
    """Lists of the geography and quality multipliers."""
    return {"party": D.HOTSPOT_PARTY, "hotspot": D.HOTSPOT_NAMES_CJK, "connector": lowered(D.US_MARKET_CONNECTORS),
            "political": lowered(D.POLITICAL_ACTIONS), "propaganda": D.PROPAGANDA_MARKERS, "redeemer": D.PROPAGANDA_REDEEMERS,
            **{f"broad:{name}": words for name, words in D.BROAD_ASSET_CLASSES.items()}, "mega": D.MEGA_CAPS,
            "drug": D.DRUG_SIGNALS, "routine_redeemer": D.ROUTINE_POLITICS_REDEEMERS, "us_signal": D.US_SIGNALS}


def entity_lists(names=E.COMPANY_TICKERS, names_cjk=E.COMPANY_TICKERS_CJK, macro=E.MACRO_ALERTS, sectors=E.SECTOR_WORDS,
                 people=E.PEOPLE_TIERS) -> dict[str, list[str]]:
    """Lists of the entity tags."""
    return {"names": list(names), "names_cjk": list(names_cjk), "macro": lowered(dict.fromkeys(macro)),
            "sectors": lowered(w for words in sectors.values() for w in words), "people": lowered(people)}


def strategic_lists(government=W.GOVERNMENT_ENTITIES, company=W.COMPANY_ENTITIES, actions=(
        *W.INVESTMENT_ACTIONS, *W.SUBSIDY_ACTIONS, *W.POLICY_ACTIONS, *W.ENDORSEMENT_ACTIONS), threats=W.THREAT_ACTIONS) -> dict[str, list[str]]:
    """Lists of the strategic relations."""
    return {"government": lowered(dict.fromkeys(government)), "company": lowered(dict.fromkeys(company)),
            "action": lowered(dict.fromkeys(actions)), "threat": lowered(dict.fromkeys(threats))}


def relevance_lists() -> dict[str, list[str]]:
    """Lists of event types and relevance."""
    return {**{f"type:{name}": words for name, words in S.TEXT_EVENT_TYPES.items()}, "macro_word": S.MACRO_WORDS,
            "sector_signal": list(S.SECTOR_SIGNALS)}


def news_lexicon(**entities) -> Lexicon:
    """All lists of screening; ``entities`` replaces lists of ``entity_lists``."""
    return Lexicon({**score_lists(), **filter_lists(), **entity_lists(**entities), **strategic_lists()})
