"""Fixed values whose exact text or number decides results.

Fixed values (must equal the behaviour being reproduced):
  interaction types: like, dislike, comment, watch, click, impression, share
  positive interaction types (P03): like, comment, click, share
  minimum watch ratio for a positive watch (P03, P07): 0.4
  default video duration when the video is unknown (P02): 300 seconds
  labelling rules (P06): positive watch >= 0.4 and >= 30 s; negative watch < 0.1
  popularity levels: low, medium, high, viral
  days of week: MONDAY .. SUNDAY
  devices: Mobile, Desktop, Laptop, Tablet
  special tokens: [PAD], [UNK], [START], [OOV]
"""

INTERACTION_TYPES = ["like", "dislike", "comment", "watch", "click", "impression", "share"]
POSITIVE_TYPES = ["like", "comment", "click", "share"]
SIMPLE_POSITIVE_TYPES = ["watch", "like", "comment"]
MIN_WATCH_RATIO = 0.4
DEFAULT_VIDEO_DURATION = 300

# Labelling rules (P06); each rule can be switched off by the caller.
LABEL_RULES = {
    "min_watch_percentage_positive": 0.4,
    "min_watch_percentage_negative": 0.1,
    "min_watch_seconds_positive": 30.0,
    "click_is_positive": True,
    "complete_is_positive": True,
    "like_is_positive": True,
    "dislike_is_negative": True,
    "share_is_positive": True,
    "skip_is_negative": True,
}
LABEL_TYPES = ["like", "dislike", "complete", "share", "skip", "click", "watch", "impression"]

POPULARITY_LEVELS = ["low", "medium", "high", "viral"]
DAYS_OF_WEEK = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
DEVICE_TYPES = ["Mobile", "Desktop", "Laptop", "Tablet"]

PAD, UNK, START, OOV = "[PAD]", "[UNK]", "[START]", "[OOV]"

# Ranker fill constants.
RANKER_FILLS = {"age": 30, "duration": 300, "count": 0, "hour": 12, "string": "UNKNOWN"}

# Candidate feature-row defaults.
CANDIDATE_DEFAULTS = {
    "country": "US", "language": "en", "age": 25, "category": "Unknown",
    "child_categories": "Unknown", "duration": 300, "popularity": "low",
    "view_count": 0, "like_count": 0, "comment_count": 0, "device": "desktop",
    "hour": 12, "day": "Monday",
}

# Score blend weights.
RETRIEVAL_WEIGHT = 0.3
RANKER_WEIGHT = 0.7

# Multi-query merge (F04): weights per query kind and the multi-hit bonus.
QUERY_WEIGHTS = {"primary": 0.5, "category": 0.3, "other": 0.2}
MULTI_HIT_BONUS = 0.05
MULTI_HIT_CAP = 3

# Duration preference ranges in seconds (P14), both ends inclusive.
DURATION_PREFS = {"short": (0, 300), "medium": (300, 1200), "long": (1200, None)}

# Monitoring thresholds.
MISSING_RATE_WARN = 0.05
DRIFT_WARN = 0.3
CARDINALITY_CHANGE_INFO = 0.2
P99_LATENCY_WARN_MS = 500.0
ERROR_RATE_CRIT = 0.01
LATENCY_INCREASE_WARN = 0.5
SCORE_DECREASE_WARN = -0.2
CANARY_ERROR_RATE = 0.05
CANARY_P99_MS = 500.0
CANARY_STEPS = [10, 25, 50, 75, 100]

# PSI (A35).
PSI_FLOOR = 1e-4
PSI_SCALE = 0.5

# Prediction lifetime and attribution window.
PREDICTION_TTL_HOURS = 48
ATTRIBUTION_HOURS = 24

# Widths of the model's embedding layers (E23), fixed values.
USER_TOWER_DIMS = {"user_id": 32, "country": 16, "language": 16, "category": 32, "age_bucket": 8}
VIDEO_TOWER_DIMS = {"video_id": 32, "category": 32, "popularity": 4, "duration_bucket": 8}
TITLE_EMBEDDING_DIM = 768
TAGS_EMBEDDING_DIM = 100
