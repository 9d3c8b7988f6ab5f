"""Rules that turn measurements into labels and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def profile_tier(n_events: Column, refractory_rate: Column, lv: Column) -> Column:
    """Label of a train's profile; the first rule that holds decides."""
    return F.when(n_events < 30, "too_few").when(refractory_rate > 0.05, "contaminated").when(lv > 1.2, "bursty").when(lv < 0.8, "regular").otherwise("irregular")


def merge_tier(score: Column, sure: float = 0.85, logged: float = 0.5) -> Column:
    return F.when(score >= sure, "tier1_auto_applied").when(score >= logged, "tier2_scored_logged").otherwise("not_surfaced")


def recovery_tier(score: Column, before: Column, after: Column, inflection_found: Column, sure: float = 0.85, most_degradation: float = 0.02) -> Column:
    good = inflection_found & (score >= sure) & (after - before <= most_degradation)
    return F.when(good, "tier1_auto_applied").otherwise("tier2_scored_logged")


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order; null conditions don't."""
    return F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda r: r.isNotNull())


def shape_label(first: Column, interior_min: Column, interior_max: Column, last: Column, tolerance: float = 0.05) -> Column:
    """decay, facilitation, dip_then_rise, rise_then_dip or flat, from the ends and the interior of a curve."""
    low, high = F.least(first, last) * (1 - tolerance), F.greatest(first, last) * (1 + tolerance)
    return (
        F.when(interior_min < low, "dip_then_rise").when(interior_max > high, "rise_then_dip")
        .when(last < first * (1 - tolerance), "decay").when(last > first * (1 + tolerance), "facilitation").otherwise("flat")
    )


def finite(value: Column) -> Column:
    """Null instead of NaN and infinities, as strict JSON needs."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def weighted_score(parts: dict[str, tuple[Column, float]], cap: Column | None = None) -> Column:
    """Weighted mean of parts (nulls count 0), at most ``cap`` where that is not null."""
    total = sum(w for _, w in parts.values())
    score = sum((F.coalesce(c, F.lit(0.0)) * (w / total) for c, w in parts.values()), F.lit(0.0))
    return score if cap is None else F.least(score, F.coalesce(cap, F.lit(float("inf"))))


#: The states of a session's decisions, and the greatest held-out error of a clock that passes.
STATES = ["HALF OF A JOIN", "SUPERSEDED", "NOT REVIEWED", "ON Z", "DRIFTED", "CHECK", "SAVED, REVIEW CLOSED", "SAVED, PARTIAL", "SAVED, COMPLETE"]
HOLDOUT_MS = 50.0


def sync_verdict(matched: Column, holdout_max: Column, valid: Column, trials: Column) -> Column:
    """How well two clocks agree: all events matched, every trial valid and the error low is a pass; no share of matches is unknown.

    No error, or one of zero, was not measured and does not pass; no number of valid trials means all of them.
    """
    every = F.coalesce(valid, trials).eqNullSafe(trials)
    measured = F.coalesce(holdout_max, F.lit(0.0)) != 0
    passed = (matched >= 1.0) & measured & (holdout_max < HOLDOUT_MS) & every
    return F.when(matched.isNull(), "unknown").when(passed, "pass").when(matched >= 0.99, "check").otherwise("FAIL")


def review_state(joined: Column, superseded: Column, saved: Column, live: Column, units: Column, finished: Column) -> Column:
    """Where a session's decisions stand: ``saved`` ones, ``live`` ones (null: not looked at), its units, and three marks (null: not set)."""
    half, replaced, only_saved, closed = F.coalesce(joined, F.lit(False)), F.coalesce(superseded, F.lit(False)), live.isNull(), F.coalesce(finished, F.lit(False))
    n, none = F.coalesce(live, F.lit(0)), F.coalesce(saved, F.lit(0)) == 0
    whole = (F.coalesce(units, F.lit(0)) > 0) & (n >= units)
    rules = [
        (half, "HALF OF A JOIN"), (replaced & none & (n == 0), "SUPERSEDED"), (none & (n == 0), "NOT REVIEWED"), (only_saved, "ON Z"), (n > F.coalesce(saved, F.lit(0)), "DRIFTED"), (n < saved, "CHECK"),
        (~whole & closed, "SAVED, REVIEW CLOSED"), (~whole, "SAVED, PARTIAL"),
    ]
    return F.coalesce(*[F.when(rule, state) for rule, state in rules], F.lit("SAVED, COMPLETE"))
