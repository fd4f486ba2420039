"""Scores of memories as Column expressions; `now` is always a parameter."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions import vocabulary as V
from mnemos.functions.text import strip


def age_days(created: Column, now: Column) -> Column:
    """Fractional days, 0 at least."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest((micros(now) - micros(created)) / F.lit(86_400_000_000.0), F.lit(0.0))


def effective_score(importance: Column, weight: Column, created: Column, now: Column, decay: Column | float) -> Column:
    """importance x exp(-decay x age in days) x weight."""
    decay = decay if isinstance(decay, Column) else F.lit(decay)
    return importance * F.exp(-decay * age_days(created, now)) * weight


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def relevance(similarity: Column, lexical: Column, weight: float) -> Column:
    return weight * similarity + (1 - weight) * lexical


def blend(base: Column, relevant: Column) -> Column:
    """base x (0.15 + 0.85 x relevance)."""
    return base * (0.15 + 0.85 * relevant)


def passes(score: Column, lexical: Column, least: Column | float, floor: float) -> Column:
    """The two gates of recall: a least score, and a higher one where no word matches."""
    least = least if isinstance(least, Column) else F.lit(least)
    return ~((least > 0) & (score < least)) & ~((lexical <= 0) & F.lit(floor > 0) & (score < floor))


def _hits(text: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur; those without special characters are searched as they are."""
    low = F.lower(text)
    found = [F.contains(low, F.lit(p.lower())) if re.escape(p) == p else text.rlike(f"(?iU){p}") for p in patterns]
    return sum((F.when(x, 1).otherwise(0) for x in found), F.lit(0))


def importance(content: Column, kind: Column, pinned: Column, config: EngineConfig = DEFAULT) -> Column:
    """A rule-based importance from 0 to 1: the type's base, a little for length and facts, less for small talk."""
    base = F.lit(V.OTHER_IMPORTANCE)
    for name, value in V.BASE_IMPORTANCE.items():
        base = F.when(kind == name, F.lit(value)).otherwise(base)
    length = F.length(strip(content))
    longer = F.when(length >= 80, 0.1).when(length >= 40, 0.05).otherwise(0.0)
    facts = 0.05 * F.least(_hits(content, config.fact_patterns), F.lit(3))
    chat = 0.15 * F.least(_hits(content, config.chitchat_patterns), F.lit(2))
    return F.when(pinned, F.lit(1.0)).otherwise(clamp(base + longer + facts - chat, 0.0, 1.0))


def resolve_importance(content: Column, kind: Column, pinned: Column, provided: Column, config: EngineConfig = DEFAULT) -> Column:
    """The provided importance, 0.9 at least if pinned, else at least the rules' (if they are on)."""
    ruled = F.greatest(provided, importance(content, kind, pinned, config)) if config.auto_importance else provided
    return F.when(pinned, F.greatest(provided, F.lit(0.9))).otherwise(ruled)


def reweight(importance: Column, last_used: Column, access_count: Column, pinned: Column, now: Column, config: EngineConfig = DEFAULT) -> Column:
    """A new weight out of importance, recency and frequency of use, from 0.05 to 2."""
    recency = F.exp(-F.lit(config.decay_lambda) * age_days(last_used, now))
    often = F.least(F.lit(1.0), F.log1p(F.greatest(access_count, F.lit(0)).cast("double")) / F.lit(math.log(21)))
    return clamp(importance * (0.35 + 0.4 * recency + 0.25 * often) * F.when(pinned, 1.35).otherwise(1.0), 0.05, 2.0)


def shifted_weight(weight: Column, deltas: Column) -> Column:
    """A weight after each of an array of deltas in turn, from 0.05 to 3 after every one."""
    return F.aggregate(deltas, weight.cast("double"), lambda w, d: clamp(w + d, 0.05, 3.0))
