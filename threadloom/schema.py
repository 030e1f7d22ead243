"""Fixed values of the data model: sources, roles, limits."""

DEFAULT_SOURCE = "claude-code"
SOURCES = ("claude-code", "codex", "gemini")
ALL_SOURCES = "all"
DIALOGUE = ("user", "assistant")
ROLES = ("user", "assistant", "system", "thinking", "tool_use", "tool_result")
UNKNOWN_MODEL, MIXED_MODEL = "(unknown)", "(mixed)"
KINDS = ("file", "command", "pattern", "url", "tool")

#: Default and largest row counts by surface.
LIMITS = {
    "search": (20, 50),
    "list": (50, 50),
    "read": (50, 200),
    "activity": (30, 50),
    "ask_sessions": (6, 10),
    "ask_tokens": (2000, 8000),
    "retrieve": (60, 10_000),
}
LEAST_ASK_TOKENS = 200
OVERSCAN = 12
HITS_PER_SESSION = 3
LEAST_POOL = 200
EXCERPT_CHARS, FLOOR_CHARS = 600, 80

#: Tools with the kind of what they act on and the field that names it.
TOOL_FIELDS = {
    "Edit": ("file", "file_path"),
    "Write": ("file", "file_path"),
    "Read": ("file", "file_path"),
    "MultiEdit": ("file", "file_path"),
    "NotebookEdit": ("file", "notebook_path"),
    "Bash": ("command", "command"),
    "Grep": ("pattern", "pattern"),
    "Glob": ("pattern", "pattern"),
    "WebFetch": ("url", "url"),
}
#: Tools of the engine itself, whose traffic is not indexed.
OWN_TOOLS = "mcp__threadloom__"
TARGET_BYTES = 512


def clamp(value: int | None, default: int, most: int, least: int = 1) -> int:
    """No or no positive value means the default; others are brought into the range."""
    return default if not value or value <= 0 else max(least, min(value, most))


def valid_source(source: str) -> bool:
    return source in ("", ALL_SOURCES, *SOURCES)
