"""Query text on the driver: search terms, question terms, points in time."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

#: Words that are dropped from questions.
STOPWORDS = frozenset(
    """
    how what when where why who which whom whose did do does is are was were be been am the a an to of in
    on at for and or but we i you it they he she that this these those my our your with about from by as can
    could would should will shall me us there here any some
    的 了 嗎 呢 吧 啊 我 我們 你 你們 他 她 怎麼 怎樣 如何 什麼 為什麼 那個 這個 那 這 是 在 有 跟 和 與
    """.split()
)
#: Fixed value: signs that are trimmed from the ends of a question's words.
PUNCTUATION = ".,?!;:\"'()[]{}…？。，！；：、「」『』（）"
MOST_LONG, MOST_SHORT = 48, 16
LONG = 3
IDEOGRAPH = "㐀-䶿一-鿿"
_RUNS = re.compile(f"([{IDEOGRAPH}]+)")
_SPLITTERS = sorted((w for w in STOPWORDS if len(w) > 1 and _RUNS.fullmatch(w)), key=lambda w: (-len(w), w))
_SPLIT = re.compile("|".join(map(re.escape, _SPLITTERS)))


def search_terms(query: str) -> list[str]:
    """Terms between spaces; quotation marks keep spaces in a term and are not part of it."""
    out, term, quoted = [], "", False
    for ch in query:
        if ch == '"':
            quoted = not quoted
        elif ch == " " and not quoted:
            out.append(term)
            term = ""
        else:
            term += ch
    return [t for t in [*out, term] if t]


def by_length(terms: list[str]) -> tuple[list[str], list[str]]:
    """(terms of three characters or more, shorter ones)."""
    return [t for t in terms if len(t) >= LONG], [t for t in terms if len(t) < LONG]


def _grams(segment: str) -> list[str]:
    return [segment[k : k + n] for n in (3, 2) for k in range(len(segment) - n + 1)]


def _expand(word: str, raw: bool) -> list[str]:
    """A word with ideographs as overlapping threes and twos of them; its other runs as they are."""
    if not _RUNS.search(word):
        return [word]
    out: list[str] = []
    for k, run in enumerate(_RUNS.split(word)):
        if k % 2:
            for segment in [run] if raw else _SPLIT.split(run):
                out += _grams(segment)
        elif (run := run.strip(PUNCTUATION)) and (raw or run not in STOPWORDS):
            out.append(run)
    return out


def question_terms(question: str) -> list[str]:
    """Content words of a question, first seen first: at most 48 long and 16 short ones.

    A question of nothing but dropped words keeps them all.
    """
    words = [w for w in (f.strip(PUNCTUATION) for f in question.lower().split()) if w]
    terms = [t for w in words if w not in STOPWORDS for t in _expand(w, False)] or [t for w in words for t in _expand(w, True)]
    long, short = by_length(list(dict.fromkeys(terms)))
    return long[:MOST_LONG] + short[:MOST_SHORT]


def parse_since(text: str, as_of: int, zone: str = "UTC") -> int:
    """Unix seconds of ``7d``, ``12h``, ``30m`` before ``as_of``, or of a local date or date and time; 0 for an empty text."""
    text = text.strip()
    if not text:
        return 0
    if m := re.fullmatch(r"(\d+)([dhm])", text):
        return as_of - int(m.group(1)) * {"d": 86_400, "h": 3_600, "m": 60}[m.group(2)]
    for form in ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S"):
        try:
            return int(datetime.strptime(text, form).replace(tzinfo=ZoneInfo(zone)).timestamp())
        except ValueError:
            pass
    raise ValueError(f"not a time: {text!r}")


def as_text(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if seconds else ""
