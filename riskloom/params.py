"""Fixed domain values. None of them is estimated from data."""

# Fixed values
DAYS_PER_YEAR = 365.25
SENTINEL_DAYS = 365243
NULL_LEVEL = "__NULO__"
RESIDUAL_LEVEL = "Other"

MIN_FLAG_DELTA_PP = 2.0
FAMILY_ALPHA = 0.05
MIN_CATEGORY_ROWS = 100
WOE_PRIOR_ROWS = 20.0
MAX_BINS = 10
MIN_IV = 0.02
IV_BAND = (0.015, 0.025)
SAME_ORDER_FACTOR = 2.0
REDUNDANT_PEARSON = 0.70
REDUNDANT_FLAGS = 0.50
REVIEW_PEARSON = 0.60
SCORE_OVERLAP = 0.20
MIN_YEARS = 0.5

WINSOR_FACTOR = 3.0
WINSOR_PERCENTILE = 0.99
REQUESTS_PER_DAY_CAP = 5
MORNING, AFTERNOON, EVENING = 6, 12, 18

AMOUNT_CAP = 50_000_000
ANNUITY_CAP = 10_000_000
DEBT_CREDIT_CAP = 3.0
END_DATE_MAX_YEARS = 20
PAST_DATE_MAX_YEARS = 30
RECENT_UPDATE_DAYS = 180

PANEL_MONTHS = (-96, 0)
MIN_REPORTED_MONTHS = 6
RECENT_ARREARS_MONTHS = 6
MIN_TRAJECTORY_MONTHS = 6

RECENT_WINDOW_DAYS = 365
EARLY_HOUR_MAX = 8
LONG_RELATION_YEARS = 4
EARLY_SETTLEMENT_DAYS = 365
LONG_TERM_INSTALMENTS = 60

END_DATE_GRID = (-5.0, -2.0, 0.0, 2.0, 5.0, 10.0)
OVERGRANT_GRID = (1.05, 1.1, 1.2, 1.3, 1.4, 1.5)
DENOMINATOR_MINIMA = (1, 2, 3, 5)

APPROVAL_RATES = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
OPERATING_ZONE = (0.70, 0.90)
TOP_RISK_SHARE = 0.10
PARTIAL_FPR = 0.30
PROBABILITY_CLIP = 1e-6
SEEDS = (0, 1, 2)
N_FOLDS = 5

# The eight cut-points fitted on train and read by the aggregations
FITTED_CUTS = (
    "bureau_enddate_tramo_min_anios",
    "bureau_enddate_tramo_max_anios",
    "bureau_count_cola",
    "bb_many_credits_corte",
    "prev_count_cola",
    "prev_actividad_12m_cola",
    "prev_sobreconcesion_corte",
    "prev_finalidades_urgentes",
)
