"""Rule chains, label maps and small arithmetic columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import COMMUNITIES, LABEL_COLLAPSE


def first_match(rules: Iterable[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds, else ``default``."""
    chain = None
    for condition, label in rules:
        chain = F.when(condition, F.lit(label)) if chain is None else chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def policy_geography(in_core: Column, near_core: Column) -> Column:
    return first_match(
        [(F.coalesce(in_core, F.lit(0)) == 1, "cbd"), (F.coalesce(near_core, F.lit(0)) == 1, "gateway_or_adjacent")],
        "outside",
    )


def log_ratio(a: Column, b: Column) -> Column:
    return F.log1p(a) - F.log1p(b)


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """Constant lookup as a literal map: no join, no shuffle; for tables fixed in code."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def collapse_label(label: Column, table: Mapping[str, str] = LABEL_COLLAPSE) -> Column:
    return lookup(label, table)


def add_geography(df: DataFrame, community: str) -> DataFrame:
    """Tier, core zone and topicality of a community, matched without regard to case."""
    key = F.lower(F.col(community))
    tier = lookup(key, {name: tier for name, tier, _, _ in COMMUNITIES}, "Unmapped")
    zone = lookup(key, {name: zone for name, _, zone, _ in COMMUNITIES if zone})
    topical = lookup(key, {name: topical for name, _, _, topical in COMMUNITIES}, "false")
    return df.withColumns({"geo_tier": tier, "cbd_zone": zone, "is_topical": topical})


def argmax_label(labels: Sequence[str], scores: Sequence[str]) -> tuple[Column, Column]:
    """Label with the highest score (first wins ties) and that score."""
    best = F.greatest(*[F.col(s) for s in scores])
    position = F.array_position(F.array(*[F.col(s) for s in scores]), best)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), position.cast("int")), best


def soft_net(p_pro: Column, p_anti: Column, p_neutral: Column) -> Column:
    mass = p_anti + p_neutral + p_pro
    return (p_pro - p_anti) / F.nullif(mass, F.lit(0.0))


def entropy_bits(*parts: Column) -> Column:
    """Shannon entropy (base 2) after normalising the parts to one."""
    floor = F.lit(1e-12)
    total = F.greatest(sum(parts[1:], parts[0]), floor)
    out = F.lit(0.0)
    for part in parts:
        share = part / total
        out = out - share * F.log2(F.least(F.greatest(share, floor), F.lit(1.0)))
    return out


def net_interval(p_pro: Column, p_anti: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Normal interval around p_pro - p_anti for two cells of one multinomial."""
    net = p_pro - p_anti
    variance = F.try_divide(p_pro + p_anti - net * net, n)
    half = F.lit(z) * F.sqrt(F.greatest(variance, F.lit(0.0)))
    return F.when(n > 0, net - half), F.when(n > 0, net + half)


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    n = n.cast("double")
    p = F.try_divide(k.cast("double"), n)
    z2 = z * z
    scale = F.lit(1.0) + F.try_divide(F.lit(z2), n)
    center = F.try_divide(p + F.try_divide(F.lit(z2), 2 * n), scale)
    spread = F.try_divide(
        F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)), scale
    )
    lo = F.least(F.greatest(center - spread, F.lit(0.0)), F.lit(1.0))
    hi = F.least(F.greatest(center + spread, F.lit(0.0)), F.lit(1.0))
    return F.when(n > 0, lo), F.when(n > 0, hi)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function.

    Zelen and Severo's five-term approximation (Abramowitz and Stegun 26.2.17), error below 7.5e-8.
    """
    a = F.abs(x)
    t = 1 / (1 + F.lit(0.2316419) * a)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(c)) * t
    upper = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def directional_label(speed_z: Column, demand_z: Column, cut: float = 1.0) -> Column:
    """Direction of a deviating state from the signs of its speed and demand z-scores.

    Slow and busy reads as congestion, slow and quiet as mixed; a value within ``cut`` has no sign.
    """
    speed = F.when(speed_z <= -cut, -1).when(speed_z >= cut, 1).otherwise(0)
    demand = F.when(demand_z <= -cut, -1).when(demand_z >= cut, 1).otherwise(0)
    return first_match(
        [
            ((speed == -1) & (demand >= 0), "congestion_oriented"),
            ((speed == 0) & (demand == 1), "positive_demand_shock"),
            ((speed == 1) & (demand <= 0), "decongestion_oriented"),
            ((speed == 0) & (demand == -1), "negative_demand_shock"),
            (speed * demand != 0, "mixed"),
        ],
        "ambiguous",
    )
