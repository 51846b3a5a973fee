"""Fixed values that decide results, and the default text catalogue."""

# Numeric defaults.
MIN_POINTS = 10
MIN_DAYS = 10
MIN_SPAN_DAYS = 21
EPSILON = 1e-10
PERIOD_MIN = 21
PERIOD_MAX = 35
WIDE_PERIOD_MIN = 10
WIDE_PERIOD_MAX = 50
LS_PERIOD_MIN = 10.0
LS_PERIOD_MAX = 90.0
LS_PERIOD_STEP = 0.1
SNR_CAP = 1000.0
SNR_THRESHOLD = 3.0
FAP_THRESHOLD = 0.1
DAYS_PER_MONTH = 30.5
MIN_TEXT_CHARS = 150
WINDOW_MONTHS = 3
CALENDAR_WINDOW_DAYS = 365
COHORT_WINDOW_DAYS = 90
FALLBACK_PERIOD = 29
OVULATION_DAY = 14
CONSENSUS_MIN_FEATURES = 5
CONSENSUS_TOLERANCE = 1
SAMPLE_SIZE = 30
SEED = 42
MATTR_WINDOW = 50

# Markers of removed content.
DELETED_AUTHOR = "[deleted]"
REMOVED_BODIES = ["[removed]", "[deleted]"]

# Ordered regex catalogue: the first entry that matches anywhere wins.
ANCHOR_PATTERNS = [
    (
        "pattern_1",
        r"(started|got) my period (yesterday|today|a couple of days ago|last night|this morning|this evening)",
    ),
    ("pattern_2", r"just got my period"),
    (
        "pattern_3",
        r"my period on (January|February|March|April|May|June|July|August|September|October|November|December)",
    ),
    ("pattern_4", r"started menstruating (today|yesterday)"),
    ("pattern_5", r"(i am|i'm) on day \d+ of my period"),
    (
        "pattern_6",
        r"my period started (yesterday|today|a couple of days ago|last night|this morning|this evening)",
    ),
    ("pattern_7", r"(?:DPO\s*:?[\s-]*(\d{1,2})|(\d{1,2})\s*:?[\s-]*DPO)"),
    ("pattern_8", r"lmp was(?: on)?"),
    ("pattern_9", r"i'm on cd"),
]

# How the day number is read from a match of each pattern.
PATTERN_RULES = {
    "pattern_1": "marker",
    "pattern_2": "zero",
    "pattern_3": "stated_date",
    "pattern_4": "marker",
    "pattern_5": "explicit_day",
    "pattern_6": "marker",
    "pattern_7": "numbered",
    "pattern_8": "stated_date_lmp",
    "pattern_9": "numbered",
}

# Groups of patterns for the users table; pattern_8 belongs to neither.
CYCLE_DAY_PATTERNS = [
    "pattern_1",
    "pattern_2",
    "pattern_3",
    "pattern_4",
    "pattern_5",
    "pattern_6",
    "pattern_9",
]
DPO_PATTERNS = ["pattern_7"]

# Relative-day markers in the order in which they are tried.
DAY_MARKERS = [
    ("a couple of days ago", 1),
    ("yesterday", 1),
    ("last night", 1),
    ("this morning", 0),
    ("this evening", 0),
    ("today", 0),
]

MONTHS = [
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
]

# Hedge wording looked for in the words just before a match.
HEDGE_WINDOW_WORDS = 3
HEDGE_PATTERNS = [
    r"\bi\s+(think|thought|guess|suspect|wonder|hope)\b",
    r"\bi\s+(might|may|could|probably|possibly|maybe)\b",
    r"\bmaybe\b",
    r"\bnot\s+sure\b",
    r"\bunsure\b",
    r"\bfeel(?:s)?\s+like\b",
    r"\bseems?\s+like\b",
    r"\bsort\s+of\b",
    r"\bkind\s+of\b",
    r"\balmost\b",
    r"\babout\s+to\b",
    r"\bshould(?:'ve| have)\b",
    r"\bsupposed\s+to\b",
    r"\bexpecting\b",
    r"\bexpected\b",
]

MODERATOR_FLAIR = r"\b(mod|moderator|\[m\])\b"
DPO_FORMS = [r"\bdpo\s*:?\s*[-\s]*(\d{1,2})\b", r"\b(\d{1,2})\s*:?\s*[-\s]*dpo\b"]
CYCLE_DAY_FORM = r"\bcd\s*:?\s*(\d{1,2})\b"

# Phase names in cycle order.
FOUR_PHASES = ["Menstrual", "Follicular", "Ovulation", "Luteal"]
SPLIT_PHASES = ["Menstrual", "Follicular", "Ovulation", "Early Luteal", "Late Luteal"]
FIVE_PHASES = ["Perimenstrual", "Midfollicular", "Periovulatory", "Early Luteal", "Midluteal"]

# Columns that never count as features.
NON_FEATURE_COLUMNS = {
    "author",
    "user",
    "id",
    "created_utc",
    "ts_utc",
    "ts_date",
    "offset_from_cd1",
    "dpo_days",
    "title",
    "selftext",
    "text",
    "subreddit",
    "permalink",
    "score",
}
