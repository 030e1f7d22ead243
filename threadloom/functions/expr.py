"""Column expressions: folds, predicates, scores, excerpts.

All stay inside the JVM.  Long terms compare with Unicode case folding, short terms and path
prefixes with that of ASCII alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions.text import IDEOGRAPH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weights by role; others have OTHER_WEIGHT.
ROLE_WEIGHTS = {"user": 1.0, "assistant": 1.0, "thinking": 0.6, "tool_use": 0.5, "tool_result": 0.4}
OTHER_WEIGHT = 0.7
K1, B = 1.2, 0.75
#: White space as Unicode has it.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def starts_with(c: Column, prefix: str) -> Column:
    return ascii_lower(c).startswith(prefix.translate(str.maketrans(_UPPER, _LOWER)))


def contains_short(c: Column, term: str) -> Column:
    return ascii_lower(c).contains(term.translate(str.maketrans(_UPPER, _LOWER)))


def contains_long(c: Column, term: str) -> Column:
    return F.lower(c).contains(term.lower())


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions) if conditions else F.lit(False)


def source_or_default(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c), F.lit(schema.DEFAULT_SOURCE))


def of_source(c: Column, source: str) -> Column:
    """Rows of a source; no or an empty one is the default source, ``all`` is every source."""
    if source == schema.ALL_SOURCES:
        return F.lit(True)
    if source in ("", schema.DEFAULT_SOURCE):
        return c.isNull() | (c == "") | (c == schema.DEFAULT_SOURCE)
    return F.coalesce(c == source, F.lit(False))


def role_weight(role: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in ROLE_WEIGHTS.items():
        out = F.when(role == name, weight).otherwise(out)
    return out


def recency(ts: Column, as_of: int) -> Column:
    """0.5 for now, half of that after 30 days; 0 without a time."""
    days = F.greatest((F.lit(as_of) - ts) / F.lit(86_400.0), F.lit(0.0))
    return F.when(F.coalesce(ts, F.lit(0)) <= 0, 0.0).otherwise(F.lit(0.5) / (1 + days / F.lit(30.0)))


def relevance(bm25: Column, role: Column, ts: Column, as_of: int) -> Column:
    return -bm25 * role_weight(role) + recency(ts, as_of)


def occurrences(c: Column, term: str) -> Column:
    """Overlapping occurrences of a long term."""
    folded = term.lower()
    if not _overlaps(folded):
        return (F.length(F.lower(c)) - F.length(F.replace(F.lower(c), F.lit(folded), F.lit("")))) / len(folded)
    return F.regexp_count(F.lower(c), F.lit(f"(?=\\Q{folded}\\E)"))


def _overlaps(term: str) -> bool:
    return any(term.startswith(term[k:]) for k in range(1, len(term)))


def trigrams(c: Column) -> Column:
    return F.greatest(F.length(c) - 2, F.lit(0))


def bm25(c: Column, terms: list[str], n: Column, average: Column, df: list[Column]) -> Column:
    """Negative score of the terms, summed left to right; lower is better."""
    return bm25_of([occurrences(c, t).cast("double") for t in terms], trigrams(c), n, average, df)


def bm25_of(frequencies: list[Column], trigrams_: Column, n: Column, average: Column, df: list[Column]) -> Column:
    """The same from the terms' frequencies and the trigrams of a message."""
    total = F.lit(0.0)
    size = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * trigrams_ / average)
    for f, have in zip(frequencies, df):
        raw = F.log((n - have + 0.5) / (have + 0.5))
        total = total + F.when(raw <= 0, 1e-6).otherwise(raw) * f * (K1 + 1) / (f + size)
    return -total


def first_position(c: Column, terms: list[str]) -> Column:
    """Earliest place (from 1) of any term, 0 if there is none."""
    places = [F.nullif(F.locate(t.translate(str.maketrans(_UPPER, _LOWER)), ascii_lower(c)), F.lit(0)) for t in terms]
    return F.coalesce(F.least(*places, F.lit(2**31 - 1)) if places else F.lit(2**31 - 1), F.lit(2**31 - 1))


def window_snippet(c: Column, terms: list[str], width: int = 160, before: int = 60) -> Column:
    """At most ``width`` characters around the first hit, with an ellipsis at each cut edge."""
    size, place = F.length(c), first_position(c, terms)
    start = F.when(place >= 2**31 - 1, 0).otherwise(F.greatest(place - 1 - before, F.lit(0)))
    start = F.when(start + width > size, F.greatest(size - width, F.lit(0))).otherwise(start)
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""),
        F.substring(c, start + 1, F.lit(width)),
        F.when(start + width < size, "…").otherwise(""),
    )
    return F.when(size <= width, c).otherwise(cut)


def marked_snippet(c: Column, terms: list[str], width: int = 66) -> Column:
    """A window around the first hit with the hit in brackets."""
    size, place = F.length(c), first_position(c, terms)
    hit = F.lit(len(terms[0]) if terms else 0)
    for t in terms[1:]:
        hit = F.when(F.lower(F.substring(c, place, F.lit(len(t)))) == t.lower(), len(t)).otherwise(hit)
    start = F.greatest(F.when(place >= 2**31 - 1, 1).otherwise(place) - width // 3, F.lit(1))
    end = F.least(start + width, size + 1)
    body = F.concat(
        F.substring(c, start, place - start),
        F.lit("["),
        F.substring(c, place, hit),
        F.lit("]"),
        F.substring(c, place + hit, F.greatest(end - place - hit, F.lit(0))),
    )
    return F.concat(
        F.when(start > 1, "…").otherwise(""),
        F.when(place >= 2**31 - 1, F.substring(c, start, F.lit(width))).otherwise(body),
        F.when(end <= size, "…").otherwise(""),
    )


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def estimate_tokens(c: Column) -> Column:
    """An ideograph is a token, four other characters are one."""
    wide = F.length(F.regexp_replace(c, f"[^{IDEOGRAPH}]", ""))
    return (wide + F.ceil((F.length(c) - wide) / 4)).cast("bigint")


def first_line(c: Column, size: int = 200) -> Column:
    return cap_bytes(F.substring_index(c, "\n", 1), size)


def cap_bytes(c: Column, size: int) -> Column:
    """At most ``size`` bytes of UTF-8, no character cut in two."""
    head = F.substring(F.encode(c, "UTF-8"), 1, size)
    lead = F.regexp_extract(F.hex(head), "((?:F[0-4](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])?)$", 1)
    whole = F.substring(head, F.lit(1), F.lit(size) - (F.length(lead) / 2).cast("int"))
    return F.when(F.octet_length(c) <= size, c).otherwise(F.decode(whole, "UTF-8"))


def clip_middle(c: Column, most: int = 65_536) -> Column:
    """Texts above ``most`` bytes: head and tail of half that size around a mark."""
    half = most // 2
    raw = F.encode(c, "UTF-8")
    tail = F.substring(raw, F.octet_length(c) - half + 1, F.lit(half))
    stray = F.length(F.regexp_extract(F.hex(F.substring(tail, 1, 3)), "^((?:[89AB][0-9A-F])*)", 1)) / 2
    tail = F.decode(F.substring(tail, (stray + 1).cast("int"), F.lit(half)), "UTF-8")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(cap_bytes(c, half), F.lit("\n…[truncated]…\n"), tail))


def trim_space(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def strip_context(c: Column) -> Column:
    """Without blocks of injected session context; an unclosed one reaches to the end."""
    return F.trim(F.regexp_replace(c, r"(?s)<session_context>.*?(</session_context>|$)", ""))


def is_wrapper(c: Column) -> Column:
    """A block that the harness put into a user's message."""
    return F.trim(c).rlike("^<environment_context|^<[^>]+_instructions>")


def title(c: Column, most: int = 100) -> Column:
    """A user text as a session title: a command's name, or the text behind harness boilerplate; '' if that is all."""
    t = trim_space(c)
    command = trim_space(F.regexp_extract(t, r"(?s)^(?=<command-).*?<command-name>(.*?)</command-name>", 1))
    is_command = t.rlike(r"(?s)^(?=<command-).*?<command-name>.*?</command-name>")
    wrapped = t.rlike(r"^(<local-command-caveat|<task-notification|\[Request interrupted)")
    behind = trim_space(
        F.regexp_extract(t, r"(?s)^(?:<(local-command-caveat|task-notification).*?</\1>|\[Request interrupted[^\]]*\])(.*)$", 2)
    )
    return F.when(is_command, command).otherwise(F.substring(F.when(wrapped, behind).otherwise(t), 1, most))
