"""SQL of the strategic relations and of screening, stated over unnested entity and action pairs."""

from __future__ import annotations

from ..functions import strategic_words as W


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def _words(words, rules, side: int) -> str:
    """A table (pos, word, low, bonus, mask) of listed words; what a word is worth is computed in SQL."""
    rows = ", ".join(f"({i}, {q(w)})" for i, w in enumerate(dict.fromkeys(words)))
    bonus = " + ".join(f"CASE WHEN {any_of('low', parts)} THEN {value} ELSE 0 END" for value, parts in rules)
    mask = " + ".join(f"CASE WHEN {any_of('low', rule[side])} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(W.PAIR_RULES))
    return (f"(SELECT pos, word, low, round(({bonus})::DOUBLE, 6) AS bonus, {mask} AS mask "
            f"FROM (SELECT *, lower(word) AS low FROM (VALUES {rows}) v(pos, word)))")


def _escaped(words) -> str:
    special = set("\\.^$*+?{}[]()|-")
    return "|".join("".join("\\" + c if c in special else c for c in w.lower()) for w in dict.fromkeys(words))


ACTIONS = [*W.INVESTMENT_ACTIONS, *W.SUBSIDY_ACTIONS, *W.POLICY_ACTIONS, *W.ENDORSEMENT_ACTIONS]
CONF = f"least(round(0.5::DOUBLE + a.bonus + e.bonus + CASE WHEN (e.mask & a.mask) <> 0 THEN {W.PAIR_BONUS} ELSE 0 END, 6), 1.0)"


def _pieces(pattern: str, entity_group: int, action_group: int, entities: str, actions: str) -> str:
    """Distinct (id, entity, action) of the matches of a pattern whose group 1 is the whole match."""
    return f"""(SELECT DISTINCT p.id, e.word AS eword, a.word AS aword, {CONF} AS conf FROM (
 SELECT id, regexp_extract(m, {q(pattern)}, {entity_group}) AS es, regexp_extract(m, {q(pattern)}, {action_group}) AS acts
 FROM (SELECT id, unnest(list_distinct(regexp_extract_all(low, {q(pattern)}, 1))) AS m FROM texts)) p
 JOIN (SELECT *, row_number() OVER (PARTITION BY low ORDER BY pos) AS k FROM {entities}) e ON e.low = p.es AND e.k = 1
 JOIN (SELECT *, row_number() OVER (PARTITION BY low ORDER BY pos) AS k FROM {actions}) a ON a.low = p.acts AND a.k = 1)"""


def strategic_ctes(source: str) -> str:
    """CTEs that end in ``strategic`` (id, conf, seq, category, text); ``source`` gives id and title."""
    firm, acts = _escaped(W.COMPANY_ENTITIES), _escaped(ACTIONS)
    passive = f"(({acts}).{{0,15}}?({'|'.join(W.PASSIVE_LINKS)}).{{0,15}}?({_escaped(W.GOVERNMENT_ENTITIES)}))"
    excluded = "regexp_matches(title, " + q("(?i)" + "|".join(f"(?:{p})" for p in W.EXCLUSION_PATTERNS)) + ")"
    skip = ", ".join(q(w.lower()) for w in W.ENDORSEMENT_ACTIONS)

    def firms(actions: str, table: str, reach: int) -> str:
        return _pieces(f"(({firm}).{{0,{reach}}}?({actions}))", 2, 3, "firms", table)

    return f"""texts AS (SELECT id, title, lower(title) AS low FROM ({source}) WHERE length(title) >= 6),
 govs AS {_words(W.GOVERNMENT_ENTITIES, W.ENTITY_BONUSES, 0)},
 firms AS {_words(W.COMPANY_ENTITIES, W.ENTITY_BONUSES, 0)},
 acts AS {_words(ACTIONS, W.ACTION_BONUSES, 1)},
 praise AS {_words(W.ENDORSEMENT_ACTIONS, W.ACTION_BONUSES, 1)},
 threats AS {_words(W.THREAT_ACTIONS, W.ACTION_BONUSES, 1)},
 near AS (SELECT e.id, e.word AS eword, a.word AS aword, {CONF} AS conf, row_number() OVER (PARTITION BY e.id, e.pos ORDER BY a.pos) AS k
  FROM (SELECT t.id, e.pos, e.word, e.bonus, e.mask, substr(t.low, instr(t.low, e.low) + length(e.low), 80) AS after
   FROM texts t JOIN govs e ON contains(t.low, e.low)) e JOIN acts a ON contains(e.after, a.low)
  WHERE {CONF} >= 0.65),
 strategic AS (SELECT m.*, t.title FROM (
  SELECT id, conf, 0 AS seq, 'gov_intervention' AS category, eword || ' ... ' || aword AS text FROM near WHERE k = 1
  UNION ALL SELECT id, round(conf * 0.9, 6), 1, 'gov_intervention', aword || ' by ' || eword FROM {_pieces(passive, 4, 2, 'govs', 'acts')} WHERE conf * 0.9 >= 0.65
  UNION ALL SELECT id, conf, 2, 'nvda_investment', eword || ' ... ' || aword FROM {firms(acts, 'acts', 80)} WHERE conf >= 0.65 AND lower(aword) NOT IN ({skip})
  UNION ALL SELECT id, conf, 3, 'nvda_endorsement', eword || ' ... ' || aword FROM {firms(_escaped(W.ENDORSEMENT_ACTIONS), 'praise', 80)} WHERE conf >= 0.65
  UNION ALL SELECT id, conf, 4, 'nvda_competitive_threat', eword || ' ... ' || aword FROM {firms(_escaped(W.THREAT_ACTIONS), 'threats', 60)} WHERE conf >= 0.65) m
  JOIN texts t USING (id) WHERE m.conf >= 0.85 OR NOT {excluded})"""
