"""The turn and hit schemas, and the fixed values of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

TIERS = ("conversation", "invocation", "result")
TIER_RANK = {t: i for i, t in enumerate(TIERS)}

_S = T.StringType()
TURN = T.StructType([T.StructField(c, _S) for c in ("session", "uuid", "ts", "tier", "author", "agent", "origin", "repo", "branch", "cwd", "text")] + [T.StructField("seq", T.IntegerType())])
TURN_COLUMNS = TURN.names

# Scoring.
SHRINKAGE = 20
TURN_SCALE = 4000
SYSTEM_WEIGHT = 0.25
INSIDE_WEIGHT = 0.30
PREFIX_WEIGHT = 0.85

# Query compilation.
MIN_STEM = 4
SUFFIXES = ("ies", "ing", "es", "ed", "ly", "s", "y")
STOPWORDS = frozenset(
    "a about after all also am an and any are as at be been before being but by can could did do does for from get got "
    "had has have he her here him his how i if in into is it its just me more most my no not now of on one only or other "
    "our out over she should so some such than that the their them then there these they this those to too up us very "
    "was we were what when where which while who why will with would you your".split()
)
SYNONYM_PAIRS = (
    ("authentication", "auth"),
    ("database", "db"),
    ("repository", "repo"),
    ("configuration", "config"),
    ("configuration", "cfg"),
    ("environment", "env"),
    ("directory", "dir"),
    ("dependency", "dep"),
    ("parameter", "param"),
    ("argument", "arg"),
    ("message", "msg"),
    ("package", "pkg"),
    ("function", "func"),
    ("reference", "ref"),
    ("identifier", "id"),
    ("application", "app"),
    ("temporary", "tmp"),
    ("initialize", "init"),
    ("utility", "util"),
    ("utilities", "utils"),
    ("specification", "spec"),
    ("implementation", "impl"),
    ("documentation", "docs"),
    ("development", "dev"),
    ("production", "prod"),
    ("request", "req"),
    ("response", "resp"),
)

# Near misses.
MIN_TOKEN = 3
NEARBY_MAX = 8
SUBSTITUTE_DISTANCE = 1
VARIANTS_PER_TERM = 4

# Record types of the first provider.
KNOWN_TYPES = (
    "assistant", "user", "attachment", "system", "last-prompt", "mode", "permission-mode", "ai-title", "custom-title",
    "queue-operation", "pr-link", "file-history-snapshot", "file-history-delta", "agent-name", "bridge-session",
    "worktree-state", "relocated", "frame-link", "started", "result",
)

# Characters whose lower case has another UTF-8 width; folding leaves them alone.
WIDTH_CHANGING = "".join(
    map(chr, (0x0130, 0x023A, 0x023E, 0x1E9E, 0x2126, 0x212A, 0x212B, 0x2C62, 0x2C64, 0x2C6D, 0x2C6E, 0x2C6F, 0x2C70, 0x2C7E, 0x2C7F, 0xA78D, 0xA7AA, 0xA7AB, 0xA7AC, 0xA7AD, 0xA7AE, 0xA7B0, 0xA7B1, 0xA7B2, 0xA7C5, 0xA7CB, 0xA7DC))
)
SHIELDS = "".join(chr(0xF0000 + i) for i in range(len(WIDTH_CHANGING)))
