"""Column expressions shared by the operators.  All run inside Spark's own codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import fixed


def rnd(value: Column, places: int) -> Column:
    """Round half away from zero, as decimals are rounded.

    The value is taken to twelve decimal places first, which is below any meaning and above
    the noise that the order of a sum leaves.  What does not fit a decimal stays as it is.
    """
    exact = value.cast("double").try_cast("decimal(30,12)")
    return F.coalesce(F.round(exact, places).cast("double"), value.cast("double"))


def quick_rnd(value: Column, places: int) -> Column:
    """``rnd`` of a plain column, which is named several times, without decimals where that is sure.

    A decimal only decides what lies next to a half of the last place.  Elsewhere, and below
    2^30 units of that place, the nearest whole number of units is plain, and its quotient by
    the power of ten is the double nearest to the decimal.
    """
    if places > 8:
        return rnd(value, places)
    value = value.cast("double")
    units = value * 10.0**places
    plain = F.abs(units - F.floor(units) - 0.5) > 0.001
    quotient = F.floor(units + 0.5) / 10.0**places
    return F.when((F.abs(units) < float(1 << 30)) & plain, quotient).otherwise(rnd(value, places))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def encode(value: Column, codes: dict[str, int]) -> Column:
    """Code of a label, 0 when it is not listed."""
    table = F.create_map(*[F.lit(part) for pair in codes.items() for part in pair])
    return F.coalesce(table[value], F.lit(0))


def segment_code(segment: Column) -> Column:
    return encode(segment, fixed.SEGMENT_CODES)


def hash_number(text: Column) -> Column:
    """First 32 bits of the md5: the same in every process and engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sell_through_rate(initial_stock: Column, current_stock: Column) -> Column:
    sold = (initial_stock - current_stock).cast("double")
    return rnd(clip(sold / F.greatest(initial_stock, F.lit(1)), 0.0, 1.0), 3)


def margin_score(price: Column, cost: Column) -> Column:
    return rnd(clip((price - cost) / F.greatest(price, F.lit(0.01)), 0.0, 1.0), 3)


def boosted_affinity(affinity: Column, category: str, preferred: Column) -> Column:
    return F.when(preferred == category, F.least(F.lit(1.0), affinity + 0.4)).otherwise(affinity)


def price_ratio(avg_order_value: Column, current_price: Column) -> Column:
    return avg_order_value / (current_price + 1e-6)


def urgency_label(pressure: Column) -> Column:
    label = F.lit(fixed.URGENCY_REST)
    for bound, name in reversed(fixed.URGENCY_BOUNDS):
        label = F.when(pressure >= bound, name).otherwise(label)
    return label


def sale_badge(pressure: Column) -> Column:
    return pressure >= fixed.BADGE_THRESHOLD


def price_tier(price: Column) -> Column:
    last = len(fixed.PRICE_TIER_BOUNDS) - 1
    tier = F.when(price < fixed.PRICE_TIER_BOUNDS[0], last)
    for number, upper in enumerate(fixed.PRICE_TIER_BOUNDS[1:]):
        tier = tier.when(price < upper, number)
    return tier.otherwise(last)


def treatment_arm(discount: Column) -> Column:
    return (discount >= fixed.TREATED_FROM).cast("int")


def purchase_label(event_type: Column) -> Column:
    return (event_type == "purchase").cast("int")


def time_features(day: Column) -> dict[str, Column]:
    """Weekday (Monday 0), month and weekend flag of a date."""
    return {
        "day_of_week": F.weekday(day),
        "month": F.month(day),
        "is_weekend": (F.weekday(day) >= 5).cast("int"),
    }


def velocity(demand_7d: Column, previous_7d: Column) -> Column:
    return (demand_7d - previous_7d) / (previous_7d + 1e-6)


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Likeness of two products from style cluster, category and price tier."""
    tiers = float(len(fixed.PRICE_TIER_BOUNDS))
    closeness = 1.0 - F.abs(a["tier"] - b["tier"]) / F.lit(tiers)
    return rnd(
        F.when(a["cluster"] == b["cluster"], 0.5).otherwise(0.0)
        + F.when(a["category"] == b["category"], 0.3).otherwise(0.0)
        + 0.2 * closeness,
        4,
    )
