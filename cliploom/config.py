"""Fixed values that must equal the published behaviour: policies, weights, word lists."""

# Clustering profiles in match order: id, game pattern, event pattern, gap ms, minimum confidence.
CLUSTERING_PROFILES = [
    ("fc-attacking-sequence-v1", "(ea sports fc|fifa)", "(attack|possession|build.?up|counter|goal sequence)", 6000, 0.6),
    ("fc-shot-goal-v1", "(ea sports fc|fifa)", "(shot|goal|save|miss|penalty)", 3000, 0.6),
    ("cod-single-kill-v1", "(call of duty|warzone)", "(single.?kill|elimination)", 1250, 0.65),
    ("cod-combat-sequence-v1", "(call of duty|warzone)", "(multi.?kill|clutch|firefight|squad.?wipe)", 4000, 0.6),
    ("gta-chase-v1", "(grand theft auto|gta)", "(chase|escape|pursuit|wanted)", 6000, 0.6),
    ("fortnite-combat-v1", "fortnite", "(build|combat|clutch|victory)", 4000, 0.6),
    ("generic-v1", ".*", ".*", 2500, 0.0),
]

# Signal weights: key-moment strength and event score.
STRENGTH_WEIGHTS = {"SCENE_CHANGE": 0.75, "MOTION_PEAK": 0.8, "AUDIO_PEAK": 0.9, "SILENCE": 0.15}
SCORE_WEIGHTS = {"SCENE_CHANGE": 36, "MOTION_PEAK": 32, "AUDIO_PEAK": 30, "SILENCE": -8}

# Detector profiles: id, game words, (kinds needed, event type) rules in order, fallback type,
# kinds that earn the boost, boost, other boost, description.
DETECTOR_PROFILES = [
    ("fc-v1", ["fifa", "sports fc"],
     [(["MOTION_PEAK", "AUDIO_PEAK"], "FC_ATTACK_OR_REACTION_SEQUENCE"), (["SCENE_CHANGE"], "FC_REPLAY_OR_TRANSITION_SEQUENCE")],
     "FC_GAMEPLAY_ACTIVITY", ["MOTION_PEAK", "AUDIO_PEAK"], 10, 3,
     "FC activity profile matched; sampled frames are required before naming a goal, save, or card."),
    ("gta-v1", ["grand theft auto"],
     [(["SCENE_CHANGE", "AUDIO_PEAK"], "GTA_CHAOS_OR_REACTION_SEQUENCE"), (["MOTION_PEAK"], "GTA_DRIVING_OR_ACTION_SEQUENCE")],
     "GTA_GAMEPLAY_ACTIVITY", ["MOTION_PEAK", "AUDIO_PEAK"], 9, 4,
     "GTA activity profile matched; visual ranking must distinguish meaningful action from routine explosions or driving."),
    ("cod-v1", ["call of duty", "warzone"],
     [(["MOTION_PEAK", "AUDIO_PEAK"], "COD_FIREFIGHT_OR_REACTION_SEQUENCE"), (["SCENE_CHANGE"], "COD_ROUND_OR_VIEW_TRANSITION")],
     "COD_GAMEPLAY_ACTIVITY", ["MOTION_PEAK", "AUDIO_PEAK"], 10, 2,
     "COD activity profile matched; sampled frames are required before naming a kill, clutch, or win."),
    ("fortnite-v1", ["fortnite"],
     [(["MOTION_PEAK", "SCENE_CHANGE"], "FORTNITE_BUILD_OR_COMBAT_SEQUENCE"), (["AUDIO_PEAK"], "FORTNITE_REACTION_SEQUENCE")],
     "FORTNITE_GAMEPLAY_ACTIVITY", ["MOTION_PEAK", "SCENE_CHANGE"], 9, 3,
     "Fortnite activity profile matched; sampled frames are required before naming an elimination, build play, or victory."),
]
PROFILE_MIN_CONFIDENCE = 0.55

# Duplicate policy.
DUPLICATE_WEIGHTS = {
    "event": 0.2, "temporal": 0.24, "visual": 0.24, "semantic": 0.18, "transcript": 0.1, "game": 0.04,
}
#: Publications whose items count as history.
HISTORY_PUBLICATION_STATES = ["PENDING", "UPLOADING", "UPLOADED", "PUBLISHED"]
DUPLICATE_COMPOSITE = 0.82
DUPLICATE_OVERLAP = 0.75
DUPLICATE_VISUAL = 0.8

# Editorial comparison weights.
COMPARE_WEIGHTS = {
    "source": 0.05, "timestamps": 0.18, "game": 0.02, "event": 0.07, "objects": 0.05, "transcript": 0.06,
    "semantic": 0.13, "visual": 0.18, "hook": 0.12, "title": 0.07, "duration": 0.02, "template": 0.02, "tone": 0.03,
}
REUSE_KINDS = ["REPLAY", "PART_2", "ALTERNATE_EDIT"]

# Adaptive sampling, milliseconds.
SAMPLING = {
    "maximum": 24, "minimum": 5, "sparse": 3000, "approach": 750, "burst": 180, "radius": 1100,
    "payoff": 500, "payoff_span": 2000,
}

# Tracking gates and clip duration limits.
TRACKING = {"confidence": 0.72, "jitter": 0.08, "missing": 0.25}
MIN_CLIP_MS = 6000
MAX_CLIP_MS = 60000

# Learning.
SCORE_COMPONENT_WEIGHTS = {
    "retention": 0.3, "engaged_views": 0.25, "shares": 0.15, "subscribers": 0.15, "velocity": 0.15,
}
HORIZONS = [("1H", 1, True), ("6H", 6, True), ("24H", 24, False), ("72H", 72, False), ("7D", 168, False)]
LEARNING_WINDOWS = [("7", 7), ("28", 28), ("90", 90), ("lifetime", None)]
MIN_SAMPLE = 5
MAX_ADJUSTMENT = 0.15
HALF_LIFE_DAYS = 28.0

# Game names by file name pattern, in match order.
GAME_PATTERNS = [
    (r"\b(gta\s*6|gta\s*vi|grand theft auto\s*vi)\b", "Grand Theft Auto VI", "VI"),
    (r"\b(gta\s*5|gta\s*v|grand theft auto\s*v)\b", "Grand Theft Auto V", "V"),
    (r"\b(warzone)\b", "Call of Duty: Warzone", "Warzone"),
    (r"\b(call of duty|cod)\b", "Call of Duty", None),
    (r"\b(ea sports fc|fc\s*2[4-9])\b", "EA Sports FC", None),
    (r"\bfifa\b", "FIFA", None),
    (r"\bfortnite\b", "Fortnite", None),
    (r"\bvalorant\b", "Valorant", None),
    (r"\bapex( legends)?\b", "Apex Legends", None),
    (r"\bminecraft\b", "Minecraft", None),
    (r"\brocket league\b", "Rocket League", None),
    (r"\bnba\s*2k\b", "NBA 2K", None),
]
GAME_CONFIDENCE = 0.82
PODCAST_PATTERN = r"(?:^|[\s._-])(podcast|interview|conversation|roundtable|talkshow|debate)(?:[\s._-]|$)"
CURIOSITY_PATTERN = r"(?i)\b(wait|thought|almost|until|then|this|how)\b"
PICTOGRAPH_PATTERN = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{203C}\x{2049}\x{00A9}\x{00AE}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FA}\x{24C2}\x{25AA}-\x{25FE}\x{2934}\x{2935}\x{2B05}-\x{2B1C}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}-\x{1F2FF}]"

# Jobs, uploads, budget.
ACTIVE_STATES = ["PENDING", "RUNNING", "RETRYING"]
MAX_ATTEMPTS = 3
STALE_MINUTES = 60
RESERVED_STATUSES = [
    "PENDING", "SUBMITTING", "SUBMITTED", "PROCESSING", "COMPLETED", "NEEDS_RECONCILIATION",
]
SUPPORTED_CODECS = ["h264", "hevc", "vp8", "vp9", "av1", "mpeg4", "prores"]
CAMPAIGN_GOAL = 90
ROLES = ["DISCOVERY", "ENGAGEMENT", "HERO"]
