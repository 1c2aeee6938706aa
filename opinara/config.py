"""Thresholds of the engine. Fixed values, as the live configuration has them."""

TAG_PRIOR_WEIGHT = 0.6
PRIOR_MEAN, PRIOR_STRENGTH = 0.5, 1.0
TIME_DECAY = 0.005
ROLE_WEIGHT = {"author": 1.0, "commenter": 1.0}
NAME_SIMILARITY, NAME_JACCARD = 0.86, 0.72
MIN_ACTIVITY, WEIGHT_FLOOR = 5, 0.1
SUSPICION_WEIGHTS = {"one_sided": 0.35, "single_brand": 0.20, "extreme": 0.20, "template_like": 0.10, "burst": 0.15}
BURST_HOURS, BURST_COUNT = 24, 3
EXTREME = 0.85
TEMPLATE_SIMILARITY = 0.8
SHILL_WORDS = ["業配", "葉配"]
SHILL_CONTEXTS = ["茶葉", "葉子", "樹葉", "葉菜", "葉片"]
SHILL_MIN_COMMENTS, SHILL_RATIO, SHILL_PENALTY = 3, 0.25, 0.3
N_EFF_MIN, HIGH_MEAN, LOW_MEAN, LOW_STD, HIGH_STD = 3.0, 0.68, 0.45, 0.25, 0.26
CONFIDENCE_BANDS = [(3.0, "低"), (8.0, "中")]
INSUFFICIENT, POLARISED, PRAISED, PANNED, MIXED = "資料不足", "評價兩極", "一致好評", "一致負評", "褒貶不一"
POSITIVE, NEGATIVE = 0.2, -0.2
REJECT_CEILING = 0.02
EXCLUDED, CLEARED = "EXCLUDE", "__CLEAR__"
