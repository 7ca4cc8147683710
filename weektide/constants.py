"""Fixed values that results depend on."""

# Three-letter actor codes counted as major countries.
MAJOR_CODES = ["USA", "CHN", "RUS", "GBR", "FRA", "DEU", "JPN", "IND", "IRN", "ISR", "UKR"]

# Two-letter geography codes counted as Middle East.
MIDDLE_EAST_GEO = ["IR", "IZ", "IS", "SY", "LE", "SA", "AE", "YM", "JO", "TU"]

# Actor code and geography code of the tracked countries.
COUNTRY_CODES = {"usa": ("USA", "US"), "china": ("CHN", "CH"), "russia": ("RUS", "RS")}

# Actor codes kept on the radar.
RADAR_REGIONS = ["USA", "CHN", "EUR", "FRA", "DEU", "GBR", "ITA", "ESP"]

# Labels of the four event classes.
QUAD_LABELS = {
    1: "Verbal cooperation",
    2: "Material cooperation",
    3: "Verbal conflict",
    4: "Material conflict",
}

# Descriptions of the twenty CAMEO root codes.
ROOT_DESCRIPTIONS = {
    "01": "Make public statement",
    "02": "Appeal",
    "03": "Express intent to cooperate",
    "04": "Consult",
    "05": "Engage in diplomatic cooperation",
    "06": "Engage in material cooperation",
    "07": "Provide aid",
    "08": "Yield",
    "09": "Investigate",
    "10": "Demand",
    "11": "Disapprove",
    "12": "Reject",
    "13": "Threaten",
    "14": "Protest",
    "15": "Exhibit force posture",
    "16": "Reduce relations",
    "17": "Coerce",
    "18": "Assault",
    "19": "Fight",
    "20": "Use unconventional mass violence",
}

# First cell of the header row found inside the event-code lookup.
EVENT_LOOKUP_HEADER = "CAMEOEVENTCODE"

# Columns an event log must have before it is cleaned.
REQUIRED_EVENT_COLUMNS = [
    "SQLDATE",
    "Actor1CountryCode",
    "Actor2CountryCode",
    "ActionGeo_CountryCode",
    "EventCode",
    "EventRootCode",
    "GoldsteinScale",
    "QuadClass",
    "NumMentions",
    "NumArticles",
    "AvgTone",
    "is_major_country",
    "QuadClassLabel",
    "EventRootDescription",
    "EventDescriptionFinal",
]

# Columns shown on the radar, in display order.
RADAR_COLUMNS = [
    "SQLDATE",
    "Actor1Name",
    "ActionGeo_CountryCode",
    "GoldsteinScale",
    "NumMentions",
    "SOURCEURL",
    "RiskScore",
]

# Weekly features that get lags, deltas and z-scores.
EVENT_FEATURES = [
    "nb_events",
    "total_mentions",
    "avg_goldstein",
    "avg_tone",
    "tension_score",
    "cooperation_score",
    "material_conflict_mentions",
    "verbal_conflict_mentions",
    "conflict_ratio",
    "material_conflict_ratio",
    "major_conflict_ratio",
    "major_country_conflict_mentions",
    "usa_conflict_mentions",
    "china_conflict_mentions",
    "russia_conflict_mentions",
    "middle_east_conflict_mentions",
    "usa_china_tension",
    "usa_russia_tension",
]
TEMPORAL_SUFFIXES = ["_lag1", "_lag2", "_delta1", "_zscore_52w"]

# Features of the direction model.
DIRECTION_FEATURES = [
    "nb_events",
    "avg_tone",
    "tension_score",
    "nb_events_lag1",
    "avg_tone_lag1",
    "tension_score_lag1",
    "weekly_return_current",
]
DIRECTION_LAGGED = ["tension_score", "avg_tone", "nb_events"]

# Variables whose week-over-week change is reported.
EVOLUTION_VARIABLES = [
    "tension_score",
    "conflict_ratio",
    "material_conflict_ratio",
    "usa_china_tension",
    "usa_russia_tension",
    "avg_tone",
    "weekly_return_current",
    "vol_4w",
    "vix",
]

# Variables quoted in the crisis report.
REPORT_VARIABLES = [
    "tension_score",
    "conflict_ratio",
    "material_conflict_ratio",
    "usa_china_tension",
    "usa_russia_tension",
    "avg_tone",
    "weekly_return_current",
    "vol_4w",
    "vol_8w",
    "momentum_4w",
    "momentum_12w",
    "drawdown_26w",
    "vix",
    "vix_delta_1w",
    "vix_zscore_52w",
    "tension_x_vol_4w",
    "conflict_x_drawdown",
    "vix_x_tension",
]

# Window lengths in weeks.
VOL_WEEKS = [4, 8, 12]
MOMENTUM_WEEKS = [4, 12, 26]
DRAWDOWN_WEEKS = 26
HORIZON_WEEKS = 4
ZSCORE_WEEKS = 52
ZSCORE_MIN_WEEKS = 20
ZSCORE_EPSILON = 1e-9

# Thresholds and split dates.
CRISIS_THRESHOLD = -0.15
STRESS_PROBABILITY = 0.55
SERVING_PROBABILITY = 0.5
CRISIS_SPLIT = "2020-08-01"
DIRECTION_SPLIT = "2019-01-01"

# Look-back of the refresh jobs.
RADAR_DAYS = 7
LIVE_EVENT_DAYS = 90
LIVE_PRICE_YEARS = 2
RADAR_ROWS = 50
FOCUS_ROWS = 3
TOP_ROWS = 10
EXAMPLE_ROWS = 20
IMPORTANCE_ROWS = 25

# Tickers.
DIRECTION_TICKERS = ["^GSPC", "BTC-USD", "NVDA", "^VIX", "GLD"]
CRISIS_TICKERS = ["^GSPC", "BTC-USD", "CL=F"]
FOREST_TICKERS = ["CL=F", "GC=F"]
VIX_TICKER = "^VIX"

# Class names and direction names in the reports.
CRISIS_CLASSES = {0: "NORMAL", 1: "STRESS"}
DIRECTION_NAMES = {0: "BAISSIÈRE", 1: "HAUSSIÈRE"}

# Neutral week on which a what-if scenario is laid.
SCENARIO_BASELINE = {
    "nb_events": 500.0,
    "nb_events_lag1": 500.0,
    "avg_tone_lag1": 0.0,
    "tension_score_lag1": 100.0,
    "nb_events_lag2": 500.0,
    "avg_tone_lag2": 0.0,
    "tension_score_lag2": 100.0,
    "weekly_return_current": 0.0,
}
