"""Business rules as Column expressions (JVM-side, inside whole-stage codegen).

Each function takes Columns (or column names) and returns a Column, so one
``select`` evaluates any number of rules for a whole portfolio.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrears import schema as S
from arrears.functions.rounding import round_half_even


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds (F21). Inputs are validated non-null first: greatest/least
    skip nulls in Spark."""
    c = _c(x)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


# ---------------------------------------------------------------------------
# Formula constants
# ---------------------------------------------------------------------------
RISK_INCIDENT_WEIGHT = 10          # F1
RISK_AMOUNT_UNIT = 1000            # F1
RISK_MIN, RISK_MAX = 1, 100        # F1, F3
BASE_RISK_OFFSET = 30              # F3
BASE_RISK_SCALE = 100              # F3
BASE_RISK_DECAY = 2                # F3
JUDICIAL_CENTER = 75               # F4
JUDICIAL_WIDTH = 10                # F4
INCOME_FLOOR = 500.0               # F13
AMOUNT_FLOOR = 50.0                # F13
LOGIT_INTERCEPT = 1.0              # F5
LOGIT_RISK = 0.03                  # F5
LOGIT_RATE = 2.5                   # F5
LOGIT_INCIDENTS = 0.1              # F5
LOGIT_AGE = 0.001                  # F5
LOGIT_AMIABLE = 0.8                # F5
LOGIT_JUDICIAL = -0.5              # F5
LAWYER_RATE_WEIGHT = 100           # F7, F8, A4
LAWYER_DELAY_WEIGHT = 0.05         # F7, F8, A4
PRIOR_RATE_JUDICIAL = 0.65         # F22
PRIOR_RATE_AMIABLE = 0.85          # F22
ACTOR_DELAY_FLOOR = 10.0           # F21
COURT_DELAY_FLOOR = 30.0           # F21
ACTION_LOW_RISK = 40               # F12: score < 40
ACTION_MID_RISK_HI = 70            # F12: 40 <= score <= 70, score > 70
ACTION_STALE_DAYS = 300            # F12: age > 300
ACTION_MANY_INSTALMENTS = 10       # F12: instalments > 10


def risk_score_serving(incidents: Column | str, amount: Column | str) -> Column:
    """min(100, max(1, 10*incidents + trunc(amount/1000))) as int.

    Both terms are bounded before they become integers, where they cannot
    change the clipped result any more, so no input overflows."""
    few = F.least(F.greatest(_c(incidents), F.lit(-2 * RISK_MAX)), F.lit(RISK_MAX)) * RISK_INCIDENT_WEIGHT
    top = float(RISK_MAX + 2 * RISK_MAX * RISK_INCIDENT_WEIGHT)
    units = F.least(F.greatest(_c(amount) / RISK_AMOUNT_UNIT, F.lit(-top)), F.lit(top)).cast("long")
    return F.least(F.greatest(few + units, F.lit(RISK_MIN)), F.lit(RISK_MAX)).cast("int")


def debt_ratio(amount: Column | str, income: Column | str) -> Column:
    """amount / income (both > 0 after validation)."""
    return _c(amount) / _c(income)


def base_risk_score(ratio: Column | str) -> Column:
    """F3 without the noise term: clip(rint(30 + 100*(1 - e^(-2 ratio))), 1, 100)."""
    base = (F.lit(float(BASE_RISK_OFFSET))
            + BASE_RISK_SCALE * (F.lit(1.0) - F.exp(-_c(ratio) * BASE_RISK_DECAY)))
    return clip(F.rint(base), RISK_MIN, RISK_MAX).cast("int")


def judicial_probability(score: Column | str) -> Column:
    """1 / (1 + e^(-(score - 75)/10))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_c(score) - JUDICIAL_CENTER) / JUDICIAL_WIDTH))


def recovery_logit(score: Column | str, rate: Column | str, incidents: Column | str,
                   age: Column | str, procedure: Column | str) -> Column:
    """F5 (noise-free), summed left to right like the original."""
    proc_term = F.when(_c(procedure) == S.AMIABLE, F.lit(LOGIT_AMIABLE)) \
                 .otherwise(F.lit(LOGIT_JUDICIAL))
    return (F.lit(LOGIT_INTERCEPT) - LOGIT_RISK * _c(score)
            + LOGIT_RATE * _c(rate)
            - LOGIT_INCIDENTS * _c(incidents)
            - LOGIT_AGE * _c(age)
            + proc_term)


def sigmoid(x: Column | str) -> Column:
    """F6."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def lawyer_score_feature(rate: Column | str, case_delay: Column | str) -> Column:
    """100*rate - 0.05*case delay (the model feature, unrounded)."""
    return _c(rate) * LAWYER_RATE_WEIGHT - _c(case_delay) * LAWYER_DELAY_WEIGHT


def lawyer_score(rate: Column | str, mean_delay: Column | str) -> Column:
    """F8: round(100*rate - 0.05*mean delay, 2) (the reported score)."""
    return round_half_even(lawyer_score_feature(rate, mean_delay), 2)


def case_delay(opened: Column | str, updated: Column | str) -> Column:
    """days from opening to last update."""
    return F.datediff(_c(updated), _c(opened))


def update_date(opened: Column | str, delay_days: Column | str) -> Column:
    """opening + delay days."""
    return F.date_add(_c(opened), _c(delay_days))


def recovered_amount(status: Column | str, amount: Column | str,
                     share: Column | str | float) -> Column:
    """full if recovered, amount*share if in progress, 0 if failed; 2 dp."""
    share_c = F.lit(share) if isinstance(share, float) else _c(share)
    raw = (F.when(_c(status) == S.RECOVERED, _c(amount))
            .when(_c(status) == S.IN_PROGRESS, _c(amount) * share_c)
            .otherwise(F.lit(0.0)))
    return round_half_even(raw, 2)


def next_best_action(score: Column | str, procedure: Column | str, delays: Column | str,
                     age: Column | str, instalments: Column | str) -> Column:
    """first matching rule wins."""
    s, p = _c(score), _c(procedure)
    return (F.when((s < ACTION_LOW_RISK) & (p == S.AMIABLE), F.lit(S.ACTIONS[0]))
             .when(s.between(ACTION_LOW_RISK, ACTION_MID_RISK_HI) & (_c(delays) >= 1),
                   F.lit(S.ACTIONS[1]))
             .when((s > ACTION_MID_RISK_HI) & (p == S.JUDICIAL), F.lit(S.ACTIONS[2]))
             .when((_c(age) > ACTION_STALE_DAYS) | (_c(instalments) > ACTION_MANY_INSTALMENTS),
                   F.lit(S.ACTIONS[3]))
             .otherwise(F.lit(S.ACTIONS[0])))


def income_floor(income: Column | str) -> Column:
    """F13 + 2 dp rounding."""
    return round_half_even(F.greatest(_c(income), F.lit(INCOME_FLOOR)), 2)


def amount_floor(amount: Column | str) -> Column:
    """F13 + 2 dp rounding."""
    return round_half_even(F.greatest(_c(amount), F.lit(AMOUNT_FLOOR)), 2)


def format_id(prefix: str, width: int, key: Column | str) -> Column:
    """e.g. DOS-%06d; longer keys just widen."""
    return F.format_string(f"{prefix}-%0{width}d", _c(key))


def procedure_prior_rate(procedure: Column | str) -> Column:
    """base success rate of a procedure type."""
    return F.when(_c(procedure) == S.JUDICIAL, F.lit(PRIOR_RATE_JUDICIAL)) \
            .otherwise(F.lit(PRIOR_RATE_AMIABLE))


def court_delay_prior(procedure: Column | str, delay: Column | str) -> Column:
    """court delay only for judicial cases, floored at 30, 1 dp."""
    return F.when(_c(procedure) == S.JUDICIAL,
                  round_half_even(clip(delay, lo=COURT_DELAY_FLOOR), 1)) \
            .otherwise(F.lit(0.0))


def actor_delay_prior(delay: Column | str) -> Column:
    """actor delay floored at 10, 1 dp."""
    return round_half_even(clip(delay, lo=ACTOR_DELAY_FLOOR), 1)


def rate_bounds(rate: Column | str) -> Column:
    """a rate clipped to [0, 1], 3 dp."""
    return round_half_even(clip(rate, 0.0, 1.0), 3)


def feature_id(*parts: Column | str) -> Column:
    """a deterministic row id, so a retried append de-duplicates."""
    return F.sha2(F.concat_ws("|", *[_c(p) for p in parts]), 256)
