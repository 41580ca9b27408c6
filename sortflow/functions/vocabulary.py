"""Categories, icons, suffix sets, thresholds and limits."""

# Fixed values, in their natural order.
CATEGORIES = ["Code", "Docs", "Finance", "Study", "Media", "Archives", "Logs", "Other"]

CATEGORY_ICONS = {
    "Code": "💻",
    "Docs": "📄",
    "Finance": "💰",
    "Study": "📚",
    "Media": "🎬",
    "Archives": "📦",
    "Logs": "📋",
    "Other": "📂",
}

# category, confidence, suffixes; the first matching rule wins.
EXTENSION_RULES = [
    (
        "Media",
        0.99,
        ["jpg", "jpeg", "png", "gif", "bmp", "webp", "mp4", "avi", "mov", "mkv", "mp3", "wav", "flac"],
    ),
    ("Archives", 0.99, ["zip", "rar", "7z", "tar", "gz", "bz2", "xz"]),
    ("Code", 0.98, ["py", "js", "ts", "java", "cpp", "go", "sql", "sh"]),
    ("Logs", 0.98, ["log"]),
]

TEXT_SUFFIXES = [
    "txt", "py", "js", "ts", "java", "cpp", "go", "sql", "md", "log",
    "csv", "json", "yaml", "yml", "html", "css", "sh", "env", "toml",
]

# Labels that need no source of their own.
SELF_SUPPLIED_LABELS = ["Media", "Archives", "Other"]

# Suffix of a made-up file name, per label.
FALLBACK_SUFFIXES = {"Logs": "log"}
DEFAULT_FALLBACK_SUFFIX = "txt"

FOCUS_LABELS = ["Docs", "Finance", "Study"]

DEFAULT_CATEGORY = "Other"
REJECT_THRESHOLD = 0.55
HIGH_CONFIDENCE = 0.8
MEDIUM_CONFIDENCE = 0.55

MAX_NAME_CHARS = 180
NAME_PREFIX_CHARS = 40
MAX_CONTENT_CHARS = 4000
MIN_CONTENT_CHARS = 20
EXTRACT_CHARS = 500
RESULT_PREVIEW_CHARS = 120
ERROR_PREVIEW_CHARS = 220
SEED = 42
