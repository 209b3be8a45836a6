"""Codes, weights, thresholds and column orders the results depend on."""

# Category code; a category that is not listed gets 0.
CATEGORY_CODES = {
    "Eyewear": 0,
    "Electronics": 1,
    "Home": 2,
    "Fashion": 3,
    "Beauty": 4,
    "Sports": 5,
}

# Category codes of the bundled test tables (part types).
PART_TYPE_CODES = {
    "STANDARD": 0,
    "PROMO": 1,
    "ECONOMY": 2,
    "MEDIUM": 3,
    "SMALL": 4,
    "LARGE": 5,
}

# Customer segment code; a segment that is not listed gets 0.
SEGMENT_CODES = {"New": 0, "Lapsed": 1, "Regular": 2, "VIP": 3}

# Lower bounds of price tiers 0 to 4.  A price under the first bound is tier 4.
PRICE_TIER_BOUNDS = [0, 50, 150, 350, 700]

# Weight presets.
PRESETS = [
    {
        "name": "balanced",
        "description": "General e-commerce: balanced trade-off across all signals",
        "propensity": 0.35, "inventory": 0.25, "margin": 0.20,
        "trend": 0.10, "demand_spike": 0.10, "diversity": 0.15,
    },
    {
        "name": "lenskart",
        "description": "End-of-season clearance: maximise inventory movement",
        "propensity": 0.25, "inventory": 0.45, "margin": 0.15,
        "trend": 0.05, "demand_spike": 0.10, "diversity": 0.20,
    },
    {
        "name": "dyson",
        "description": "New product launch: ride the trend and demand spike",
        "propensity": 0.30, "inventory": 0.10, "margin": 0.15,
        "trend": 0.25, "demand_spike": 0.20, "diversity": 0.10,
    },
    {
        "name": "amazon",
        "description": "High-volume marketplace: maximize conversion probability",
        "propensity": 0.50, "inventory": 0.15, "margin": 0.20,
        "trend": 0.10, "demand_spike": 0.05, "diversity": 0.10,
    },
    {
        "name": "clearance",
        "description": "Flash sale / clearance event: move critical inventory fast",
        "propensity": 0.20, "inventory": 0.50, "margin": 0.10,
        "trend": 0.10, "demand_spike": 0.10, "diversity": 0.25,
    },
]
DEFAULT_PRESET = "balanced"
SIGNALS = ["propensity", "inventory", "margin", "trend", "demand_spike"]
WEIGHT_SUM_RANGE = (0.95, 1.05)

# A/B buckets 0-99: a bucket under the bound gets the variant, the rest the last.
VARIANT_BOUNDS = [(40, "balanced"), (60, "lenskart"), (80, "dyson")]
VARIANT_REST = "amazon"
DEFAULT_EXPERIMENT = "ranking_weights"

# Inventory pressure.
BADGE_THRESHOLD = 0.65
URGENCY_BOUNDS = [(0.85, "Critical"), (0.65, "High"), (0.35, "Medium")]
URGENCY_REST = "Low"
SHELF_DAYS = 180.0

# Price experiments.
TREATED_FROM = 0.05
DISCOUNT_STEP = 0.05
MAX_DISCOUNT = 0.5
MARGIN_WEIGHT = 0.5

# Demand.
MIN_DEMAND_SAMPLES = 100
DEMAND_HISTORY_ROWS = 14
SPIKE_FACTOR = 1.5

# Storefront.
TRENDING_ABOVE = 0.7

# Request limits: default, smallest, largest.
TOP_K = (20, 1, 100)
CANDIDATE_POOL = (100, 10, 500)
DEFAULT_SCORE = 0.5

# Values for a product that is missing from the catalogue.
MISSING_PRODUCT = {
    "trend_score": 0.5,
    "avg_rating": 3.5,
    "seasonal_relevance": 0.5,
    "is_new_launch": 0,
    "base_price": 50.0,
    "category_encoded": 0,
}

# Drift.
PSI_LEVELS = (0.10, 0.25)
CHI_LEVELS = (0.05, 0.01)
ZSCORE_LEVELS = (2.0, 3.0)
PSI_FLOOR = 1e-10
DRIFT_BINS = 10
PSI_TEXT = "Distribution shift detected in '%s' (PSI=%.4f)"
CHI_TEXT = "%s in '%s' (p=%.6f)"
CHI_LEAD = {"critical": "Categorical distribution shift", "warning": "Possible categorical drift"}
SCORE_TEXT = "%s: mean shifted %.1fσ from baseline"
SCORE_LEAD = {"critical": "Score distribution anomaly", "warning": "Score distribution warning"}
ALERT_TEXT = "%s [%s] %s: %s=%.4f (threshold=%s)"
NOT_FOUND_TEXT = "User or product not found"
LEVEL_MARK = {"none": "✅", "warning": "⚠️", "critical": "🚨"}

# Feature orders.
USER_BASE = [
    "recency_days", "purchase_freq_90d", "avg_order_value", "lifetime_spend",
    "price_sensitivity", "sessions_7d", "cart_abandon_rate", "account_age_days",
]
PRODUCT_VECTOR = [
    "base_price", "current_price", "cost_price", "current_stock",
    "sell_through_rate", "days_on_shelf", "reorder_threshold", "avg_rating",
    "review_count", "trend_score", "margin_score", "is_new_launch",
    "style_cluster", "seasonal_relevance",
]
PRODUCT_TRAINING = [
    "base_price", "current_price", "sell_through_rate", "days_on_shelf",
    "avg_rating", "review_count", "trend_score", "margin_score",
    "is_new_launch", "seasonal_relevance",
]
ELASTICITY_COLUMNS = [
    "base_price", "avg_rating", "review_count", "margin_score", "trend_score",
    "is_new_launch",
]
INVENTORY_COLUMNS = [
    "stock_ratio", "sell_through_rate", "days_on_shelf", "days_normalized",
    "stock_buffer", "trend_score", "seasonal_relevance", "margin_score",
    "category_encoded", "ageing_score",
]
DEMAND_COLUMNS = [
    "demand_7d", "demand_14d", "demand_30d", "velocity", "day_of_week",
    "month", "is_weekend", "trend_score", "avg_rating", "seasonal_relevance",
    "is_new_launch", "base_price", "category_encoded",
]
