"""All queries of this subpackage and their SQL."""

from . import attention_lm, exact_dedup, fixity, forest_join, grammar_ids, importance, packing, pieces, quality_rules, \
    repeats, secret_novelty, sharding, whitening  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
