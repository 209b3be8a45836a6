"""A small shop in memory.  Values come from plain arithmetic and sit on the edges that
matter: tier bounds, empty stock, equal scores, products nobody buys, users without events."""

from __future__ import annotations

import datetime as dt

from vitrine import fixed

CATEGORIES = list(fixed.CATEGORY_CODES)
FIRST_DAY = dt.datetime(2024, 1, 1)
PRICES = [8.0, 49.5, 50.0, 99.0, 149.5, 150.0, 240.0, 349.5, 350.0, 699.5, 700.0, 1250.0]

USER_SCHEMA = (
    "user_id string, recency_days int, purchase_freq_90d bigint, avg_order_value double, "
    "lifetime_spend double, account_age_days int, price_sensitivity double, sessions_7d bigint, "
    "cart_abandon_rate double, segment string, preferred_category string, "
    + ", ".join(f"affinity_{c.lower()} double" for c in CATEGORIES)
)
PRODUCT_SCHEMA = (
    "product_id string, category string, brand string, base_price double, current_price double, "
    "cost_price double, current_stock int, initial_stock int, reorder_threshold int, "
    "days_on_shelf int, avg_rating double, review_count bigint, trend_score double, "
    "is_new_launch int, style_cluster int, seasonal_relevance double"
)
EVENT_SCHEMA = (
    "event_id bigint, user_id string, product_id string, ts timestamp_ntz, event_type string, "
    "price_paid double, quantity int, source string"
)


def user_id(i: int) -> str:
    return f"u{i:03d}"


def product_id(i: int) -> str:
    return f"p{i:03d}"


def user_rows(n=100):
    segments = list(fixed.SEGMENT_CODES)
    return [
        (
            user_id(i), 3 * i, i % 4, 10.0 + 7 * (i % 31), 100.0 * (i % 17), 40 + 5 * i,
            i % 8 / 8, i % 6, i % 5 / 4, segments[i * i % 7 % 4], CATEGORIES[i % 6],
            *[(i * (k + 2) + k) % 16 / 16 for k in range(6)],
        )
        for i in range(n)
    ]


def product_rows(n=50):
    rows = []
    for i in range(n):
        price = PRICES[i % len(PRICES)]
        stock = 0 if i % 9 == 0 else 4 * i
        rows.append(
            (
                product_id(i), CATEGORIES[i * i % 6], "xyz"[i % 3], price, price * (8 - i % 3) / 8,
                price * (1 + i % 3) / 8, stock, stock + 10 * (i % 8), 1 + i % 12, 4 * i,
                1.0 + i % 9 / 2, i % 13 * 11, i * 7 % 32 / 32, int(i % 10 == 0), i % 4,
                i * 5 % 16 / 16,
            )
        )
    return rows


def event_rows(n=2000, users=100, products=50):
    """Every user but the last ten, every product but the last two; one busy user and product."""
    kinds = ["view", "purchase", "view", "add_to_cart", "purchase", "wishlist", "view"]
    rows = []
    for i in range(n):
        who = 7 if i % 11 == 0 else i * 37 % (users - 10)
        what = 3 if i % 13 == 0 else (i * 29 + i // 50) % (products - 2)
        at = FIRST_DAY + dt.timedelta(days=i * 53 % 300, hours=i % 5)
        rows.append(
            (i, user_id(who), product_id(what), at, kinds[i * i % 23 % 7], 5.0 + i % 90, 1 + i % 2, "web")
        )
    return rows


def experiment_rows(n=500, products=50):
    """Conversion rises with the discount, in steps that differ by product."""
    rows = []
    for i in range(n):
        discount = i % 21 / 40
        rate = 0.03125 + i % 9 / 128 + discount * (1 + i % 5) / 8
        rows.append((product_id(i * 17 % products), discount, rate))
    return rows
