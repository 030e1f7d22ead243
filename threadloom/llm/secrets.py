"""Credentials embedded in text, code and configuration: found and redacted.

Candidates are of two sorts.  Every literal that its syntax announces is one, whatever its
length, case or digits: the value behind a secret's name, in a header, in a login, behind a
client's flag; it ends where its quotes, its line or its URL say.  Tokens that nothing
announces are candidates if they could be made up: they have a digit or changes of case, or are
a block of encoded lines.  References to variables and stores are no literals.

A logistic regression over hashed features scores each candidate: the likelihood of its
characters under two Markov chains (secrets and other tokens), its first characters and
shape, the identifiers around it, and the paths (file named before it, its extension, the
record's own path, the field).  Features meet in pairs (likelihood or shape with the nearest
identifiers); no pattern that labels is a feature.  The sample is labelled weakly by patterns;
announced places are seen again with values drawn from the sample's words, so that a plain word in such a place
is learned as a secret although the sample has none.  The score is calibrated on held-out rows;
candidates above the threshold are redacted in place.

Escapes (``\\n``, ``\\"``) are blanked in a copy of equal length, so a span that is found can be
cut from the text as it stands: quotes, names and the code around a value stay.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: rows read, characters of a text in it, characters in all, candidates used.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TOTAL, SAMPLE_CANDIDATES = 30_000, 20_000, 60_000_000, 40_000
THRESHOLD = 0.5
#: Candidates with made values that a small sample gets; a larger one gets three a place.
MADE = 12_000
BUCKETS = 1 << 16
MARK = "[REDACTED:credential]"

_OWN = r"\s\"'`\\<>(){}\[\],;|=:?&@"
CANDIDATE = re.compile(
    r"(?P<pem>-----BEGIN [A-Z0-9 ]{3,40}-----(?:\s*[A-Za-z-]+: [^\n]{1,80})*+(?:\s*[A-Za-z0-9+/=]{8,})*+(?:\s*-----END [A-Z0-9 ]{3,40}-----)?)"
    r"|(?P<data>data:[a-z]+/[\w.+-]+;base64,[A-Za-z0-9+/=]+)"
    r"|(?P<uuid>[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"
    rf"|(?<![^{_OWN}])(?P<token>[^{_OWN}\d]*+\d[^{_OWN}]*+)"
    r"|(?<![A-Za-z0-9+/_.~-])(?P<mixed>[A-Za-z+/_.~-]*[a-z][A-Z][A-Za-z+/_.~-]*[a-z][A-Z][A-Za-z+/_.~-]*|[A-Z]{16,}(?![A-Za-z0-9_]))"
)
#: A value that is put together from literals.
JOINED = re.compile(r"([\w+/.~-]{3,})\s*+[\"']\s*\+\s*[\"']([\w+/.~=-]{3,})")
ESCAPE = re.compile(r"\\+[nrtbf\"/']")
UNESCAPED = {"n": "\n", '"': '"', "'": "'", "/": "/"}
#: Plain tokens that nothing announces: numbers, times, paths, words, names in camel case, identifiers with the prefix of their kind.
PLAIN_TOKEN = re.compile(
    r"(?:call|toolu|srvtoolu|msg|req|resp|fc|rs|run|item|chatcmpl)_[A-Za-z0-9]+|[\d.,:/%+T_-]*|\d{4}-\d\d-\d\d.*|[./~]*(?:[a-z0-9._*-]+/)+[a-z0-9._*-]*|[a-z_]+\.?\d{0,4}|[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)+",
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[一-鿿]{2}|--?[a-z](?![a-z])")
PATH = re.compile(r"(?:[\w.-]+/)+[\w.-]*|[\w-]*\.(?:env|ya?ml|json|toml|ini|cfg|conf|properties|tf|tfvars|sh|py|js|ts|go|rs|java|rb|php|md|txt|pem|key|netrc|npmrc|pgpass)\b")
#: Names that announce a secret, and names of values that are none.
SECRET_WORDS = frozenset(
    "password passwd pwd pass passphrase pgpassword sshpass secret token apikey key bearer basic authorization auth cookie sid credential credentials creds 密碼 密码".split(),
)
OTHER_WORDS = frozenset(
    "sha integrity checksum commit digest uuid request public certificate image png ssh parent session id fingerprint etag hash md version limit count timestamp date".split(),
)
#: Words that stand in a secret's place without being one.
STANDINS = frozenset(
    "true false null none nil undefined nan enabled disabled enable disable required optional string str text bool boolean int integer number bytes object array any password passwd pass pwd secret token key "
    "user username name value changeme change me example sample dummy fake test todo tbd placeholder redacted masked hidden removed omitted your here my insert replace with the a an bearer basic digest "
    "default empty unset missing invalid valid expired wrong incorrect yes no on off field input prompt stdin file env".split()
)
#: Names in front of ``key`` that make it no secret, schemes of headers, attributes of cookies.
OPEN_KEYS = frozenset("public primary foreign sort partition cache map hash dict lookup index row group routing object idempotency config ssh host translation label i18n column".split())
SCHEMES = frozenset("bearer basic digest negotiate".split())
ATTRIBUTES = frozenset("path domain max-age expires samesite version comment priority".split())
#: issuers' formats.
FORMATS = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{6,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{10,}|sk-(?=[a-z-]*[A-Z0-9])[A-Za-z0-9_-]{5,}|[rs]k_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|AIza[\w-]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}"
)
SPECIAL = frozenset("!#$%^*~+")
CHARS = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-/+.!#$%^*~")}
N_CHARS = len(CHARS) + 2
_CLASS = np.full(256, N_CHARS - 1, dtype=np.int64)
for _c, _k in CHARS.items():
    _CLASS[ord(_c)] = _k
START = N_CHARS - 2

# --- announced literals: looked for by plain search, parsed from the name on ----------------------

#: Words that announce; those in the second group need a boundary before them (``compass``, ``monkey``).
ANNOUNCERS = ("password", "passwd", "passphrase", "secret", "token", "credential", "pwd", "pass", "key", "creds", "auth", "cookie", "authorization", "bearer ", "密碼", "密码")
BOUNDED = frozenset(("pwd", "pass", "key", "creds", "auth", "cookie"))
FLAGGED = ("redis-cli", "mysql", "mariadb", "sshpass", "curl", "docker login")
_NAME_END = re.compile(r"s?(?:[_-]?(?:value|b64|base64|raw|text|string)(?![A-Za-z])|[_-]?\d+)?")
_ASSIGNED = re.compile(r"[ \t]*[\"'`]?\]?\)?[ \t]*(?:=>|:=|===?|[=:：])(?![=:])\s*|[ \t]*[\"'`]?[ \t]*,[ \t]*(?=[\"'])")
_TOLD = re.compile(r"[ \t]*(?:(?:for|of)[ \t]+\S+[ \t]+)?(?:is|was|ist|est|es|é|是|は)[ \t:：]+(?=[\"'`]|\S*[\d!#$%^*~+&]|\S*[a-z][A-Z])")
_FORMER = re.compile(r"[\"'`]?[ \t]*(?:#|//|--)[ \t]*(?:was|old|formerly|previously)[: \t]+")
_GIVEN = re.compile(r"[ =]\s*")
_SCHEME = re.compile(r"(?:bearer|basic|token|apikey|digest|negotiate)[ \t]+", re.IGNORECASE)
_BARE = re.compile(r"[^\s\"'`<>]+")
_NO_LITERAL = re.compile(
    r"\$|<|\{|\[REDACTED|%\w+%|%[sdv]$|(?:await|new|yield|lambda|function|not|return|None|null)\b|\(|@@|[\w.]+\(|[A-Z]\w*\[|!\w+$|(?:os|process|env|ENV|System|vault|config|settings|self|this|secrets?|args|options|params|ctx|props|var|local|data|module)[.\[]|-----BEGIN|data:|[a-z][a-z0-9+.-]*://|[|>][-+]?$|\[|&|\*\w"
)
_COUNT = re.compile(r"[\"'`]?\d+(?![\w.-])")
_NETRC = re.compile(r"login[ \t]+\S+\s+$")
_LOGIN = re.compile(r"(?<=://)([^\s/:@\"'`<>]*):([^\s/\"'`<>]+)(?=@[\w.\[-])")
_CLIENT = {
    "redis-cli": re.compile(r"[^\n|;]*?\s(?:-a|--pass)\s+(\S+)"), "mysql": re.compile(r"[^\n|;]*?\s-p(?!\s|assword)([^\s]+)"), "mariadb": re.compile(r"[^\n|;]*?\s-p(?!\s|assword)([^\s]+)"),
    "sshpass": re.compile(r"\s+-p\s*(\S+)"), "curl": re.compile(r"[^\n|]*?\s(?:-u|--user)\s*[\"']?[^\s:\"']+:([^\s\"']+)"), "docker login": re.compile(r"[^\n|;]*?\s-p\s+(\S+)"),
}


@dataclass
class Found:
    start: int
    end: int
    kind: str
    token: str
    words: list[str]
    right: str
    #: How its syntax announces it: assigned, former, told, given, header, cookie, login, client; empty if it does not.
    role: str = ""
    name: str = ""
    left: str = ""
    path: str = ""


def blank_escapes(text: str) -> str:
    """A copy of equal length in which escape sequences are white space, quotes or slashes."""
    if "\\" not in text:
        return text
    return ESCAPE.sub(lambda m: " " * (len(m.group()) - 1) + UNESCAPED.get(m.group()[-1], " "), text)


def _literal(seen: str, at: int, in_url: bool = False, spaces: bool = False) -> tuple[int, int] | None:
    """The literal at a place: to its closing quote, else to white space; without signs that close the phrase around it."""
    quote = seen[at : at + 1]
    if quote and quote in "\"'`":
        end = at + 1
        while (end := seen.find(quote, end)) > 0 and seen[end - 1] == "\\":
            end += 1
        start = at + 1
        if end < 0 or "\n" in seen[start:end]:
            return None
        # a quote that was escaped leaves a blank before it
        value = seen[start:end].strip()
        start = seen.find(value, start)
        end = start + len(value)
        if not value or (not spaces and any(c.isspace() for c in value)):
            return None
    else:
        m = _BARE.match(seen, at)
        if not m:
            return None
        start, value = at, m.group()
        if in_url:
            value = re.split("[&#]", value)[0]
        value = re.split(r"[,;](?=$|\\)|;(?=[\w ]+=)", value)[0].rstrip("\\")
        while value and (value[-1] in ",;." or (value[-1] in ")]}" and value.count(value[-1]) > value.count({")": "(", "]": "[", "}": "{"}[value[-1]]))):
            value = value[:-1]
        for mark in ("，", "。", "；", "、"):
            value = value.split(mark)[0]
        end = start + len(value)
    if not value or _NO_LITERAL.match(value) or value.lower() in SCHEMES:
        return None
    return start, end


def _named(seen: str, low: str, a: int, b: int, word: str) -> tuple[str, int] | None:
    """(whole identifier, its start) if the word found ends one that may announce a secret."""
    first = a
    while first > 0 and (seen[first - 1].isalnum() or seen[first - 1] in "_-.") and ord(seen[first - 1]) < 0x2E80:
        first -= 1
    before = seen[a - 1] if a > first else ""
    if word in BOUNDED and before.isalpha() and not (seen[a].isupper() and before.islower()) and low[first:a] not in ("api", "access", "db", "auth"):
        return None
    name = low[first:b]
    if word == "key":
        lead = WORD.findall(seen[first:a])
        if not lead or {w.lower() for w in lead} & OPEN_KEYS:
            return None
    if word == "pass" and a == first:
        return None
    return name, first


def announced(seen: str) -> list[tuple[int, int, str, str, int]]:
    """(start, end, role, name, where the name starts) of every literal that its syntax announces."""
    low = seen.lower()
    if len(low) != len(seen):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in seen)
    out = []
    for word in ANNOUNCERS:
        at = low.find(word)
        while at >= 0:
            b = at + len(word)
            if word == "bearer ":
                if (got := _literal(seen, b)) is not None:
                    out.append((*got, "header", "bearer", at))
            elif word == "authorization":
                m = _ASSIGNED.match(seen, b)
                if m:
                    place = m.end() + (seen[m.end() : m.end() + 1] in ("'", '"'))
                    scheme = _SCHEME.match(seen, place)
                    # a quoted value without a scheme is read with its quotes
                    if (got := _literal(seen, scheme.end() if scheme else m.end())) is not None:
                        out.append((*got, "header", "authorization " + (scheme.group().strip().lower() if scheme else ""), at))
            elif (own := _named(seen, low, at, b, word)) is not None:
                name, first = own
                end = _NAME_END.match(seen, b).end()
                follows = seen[end : end + 1]
                if not (follows.isalnum() or follows == "_") or ord(follows) >= 0x2E80:
                    out += _behind(seen, end, name, first, word)
            at = low.find(word, b)
    if "://" in seen:
        for m in _LOGIN.finditer(seen):
            if not _NO_LITERAL.match(m.group(2)):
                out.append((m.start(2), m.end(2), "login", "://", m.start(1)))
    for tool in FLAGGED:
        at = low.find(tool)
        while at >= 0:
            if m := _CLIENT[tool].match(seen, at + len(tool)):
                quoted = m.group(1)[0] in "\"'"
                if (got := _literal(seen, m.start(1))) is not None:
                    out.append((*got, "client", tool, at))
                elif quoted:
                    pass
            at = low.find(tool, at + len(tool))
    return out


def _behind(seen: str, end: int, name: str, first: int, word: str) -> list[tuple[int, int, str, str, int]]:
    """What stands behind the name of a secret."""
    flag = name.startswith("--")
    m = _ASSIGNED.match(seen, end)
    if m and "," in m.group() and not seen[max(0, first - 8) : first].rstrip(" \"'`").endswith("("):
        m = None  # an argument behind the name, or just the next item of a list
    if m:
        role, place = "assigned", m.end()
    elif flag and (m := _GIVEN.match(seen, end)):
        role, place = "given", m.end()
    elif m := _TOLD.match(seen, end):
        role, place = "told", m.end()
    elif word in ("password", "passwd") and seen[end : end + 1] in " \t" and _NETRC.search(seen, max(0, first - 256), first):
        role, place = "login", end + 1
    else:
        return []
    if word == "cookie" and role == "assigned":
        stop = len(seen) if (stop := seen.find("\n", place)) < 0 else stop
        out = []
        for pair in re.finditer(r"([\w.-]+)=([^;\s\"'`]+)", seen[place:stop]):
            if pair.group(1).lower() not in ATTRIBUTES and not _NO_LITERAL.match(pair.group(2)):
                out.append((place + pair.start(2), place + pair.end(2), "cookie", pair.group(1).lower(), first))
        return out
    if scheme := _SCHEME.match(seen, place + (seen[place : place + 1] in ("'", '"'))):
        place = scheme.end()
    in_url = first > 0 and seen[first - 1] in "?&"
    if word == "token" and _COUNT.match(seen, place):
        return []  # a number behind a token's name counts something
    got = _literal(seen, place, in_url, spaces=word in ("password", "passphrase", "passwd"))
    out = [(*got, role, name, first)] if got else []
    if got and (m := _FORMER.match(seen, got[1])) and (old := _literal(seen, m.end())):
        out.append((*old, "former", name, first))
    return out


def candidates(text: str) -> list[Found]:
    """All literals and tokens of the text that could be a secret, with the words and the path before them."""
    seen = blank_escapes(text)
    out: list[Found] = []
    taken: list[tuple[int, int]] = []
    if "+" in seen:
        for m in JOINED.finditer(seen):
            token = m.group(1) + m.group(2)
            if FORMATS.fullmatch(token) or strong_shape(token):
                taken.append(m.span())
                out.append(Found(*m.span(), "token", token, _words(seen, m.start()), seen[m.end() : m.end() + 1]))
    for start, end, role, name, first in sorted(announced(seen), key=lambda x: (x[0], -x[1])):
        if any(start < b and a < end for a, b in taken):
            continue
        taken.append((start, end))
        words = _words(seen, first) + [w.lower() for w in WORD.findall(seen, first, start)]
        out.append(Found(start, end, "literal", seen[start:end], words[-8:], seen[end : end + 1], role, name, seen[start - 1 : start]))
    taken.sort()
    at = 0
    for m in CANDIDATE.finditer(seen):
        kind = m.lastgroup
        if kind == "uuid":
            continue
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        token = m.group()
        if kind in ("token", "mixed"):
            if kind == "token":
                # a full stop ends a sentence, other signs may belong to the value
                token = token.rstrip(".") if token[-1] in ".!*)" else token
                end = start + len(token)
                skip = len(token) - len(token.lstrip("-"))
                start, token = start + skip, token[skip:]
            if len(token) < 8 and not FORMATS.fullmatch(token) or PLAIN_TOKEN.fullmatch(token):
                continue
            if kind == "mixed" and (len(token) < 12 or seen[end : end + 1] == "(" or seen[end : end + 2] in ('":', "':")):
                continue
            while end < len(seen) and seen[end] == "=" and end - start - len(token) < 2:
                end += 1
        out.append(Found(start, end, kind, token, _words(seen, start), seen[end : end + 1], "", "", seen[start - 1 : start] if start else ""))
    out.sort(key=lambda c: c.start)
    if out:
        _set_paths(seen, out)
    return out


def _set_paths(seen: str, found: list[Found]) -> None:
    """The last file named before each candidate (both in the order of the text)."""
    paths, k, last = ([(m.end(), m.group()) for m in PATH.finditer(seen)] if "/" in seen or "." in seen else []), 0, ""
    for c in found:
        while k < len(paths) and paths[k][0] <= c.start:
            last, k = paths[k][1], k + 1
        c.path = last


def _words(seen: str, start: int) -> list[str]:
    """The eight words before a value in its line; if it begins the line, in the line before, too.

    Words are taken from a window of 256 characters before the value: a definition of what is near, not of what is read.
    """
    first = max(0, start - 256, seen.rfind("\n", 0, start))
    got = WORD.findall(seen, first, start)
    if not got and first > 0:
        got = WORD.findall(seen, max(0, first - 256, seen.rfind("\n", 0, first)), start)
    return [w.lower() for w in got][-8:]


def strong_shape(token: str) -> bool:
    """Looks made up: digits with mixed case or signs, or long hexadecimal or mixed-case text."""
    digit = any(c.isdigit() for c in token)
    upper, lower = any("A" <= c <= "Z" for c in token), any("a" <= c <= "z" for c in token)
    if digit and (SPECIAL & set(token) or upper and lower or (len(token) >= 12 and (upper or lower) and token.isalnum())):
        return True
    turns = len(re.findall("[a-z][A-Z]", token))
    return len(token) >= 12 and turns >= (3 if "_" in token or "." in token else 2)


# --- weak labels ---------------------------------------------------------------------------------


def stands_in(token: str) -> bool:
    """A placeholder or masked value: few different characters, or made of words that stand in a secret's place."""
    if len(set(token.lower()) - set("-_. ")) <= 2 or re.search(r"[xX*•.]{6}|EXAMPLE|\.\.\.", token):
        return True
    words = [w.lower() for w in WORD.findall(token)]
    return bool(words) and not any(c.isdigit() for c in token) and (all(w in STANDINS for w in words) or (token.isupper() and "_" in token) or bool({"your", "placeholder", "changeme", "redacted", "example"} & set(words)))


def weak_label(c: Found) -> int:
    """1: a pattern says that this is a secret; 0: none does."""
    if c.kind == "pem":
        header = c.token[:60].split("-----")[1]
        body = re.sub(r"-----[A-Z0-9 ]+-----|\s", "", c.token)
        return int("PRIVATE KEY" in header and len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 40)
    if c.kind == "data":
        return 0
    if FORMATS.fullmatch(c.token):
        return int(re.search(r"[xX*]{8}|EXAMPLE", c.token) is None)
    near, wider = c.words[-3:], c.words
    strong = strong_shape(c.token)
    if c.role:
        if stands_in(c.token) or re.fullmatch(r"sha\d+[:-].*", c.token) or {"public", "fingerprint", "checksum", "sha"} & set(WORD.findall(c.name)):
            return 0
        if c.role in ("login", "client", "cookie", "header", "told"):
            return int(strong or c.role in ("login", "client"))
        # numbers behind a token's name count something
        return int(not c.token.isdigit() or "pass" in c.name or "pwd" in c.name)
    if not strong:
        return 0
    if (near and near[-1] in OTHER_WORDS) or (set(near) & {"sha", "integrity", "checksum", "commit", "ssh", "public", "png"}):
        return 0
    return int(bool(set(near) & SECRET_WORDS))


def augmented(found: list[Found], labels: np.ndarray) -> tuple[list[Found], list[int], list[int]]:
    """Announced places of the sample again, with other values: (candidate, label, its place).

    A place labelled 1, with and without what stands before it, is seen with words, short names and numbers made from the sample's own words (label
    1: whatever stands there gives access), and with masks and stand-ins (label 0).
    """
    vocabulary = sorted({w for c in found for w in c.words if w.isascii() and w.isalpha() and 4 <= len(w) <= 12 and w not in STANDINS})
    out, label, place = [], [], []
    if not vocabulary:
        return out, label, place
    standins = sorted(STANDINS)
    masks = ("*" * 8, "x" * 16, "xxxx", "********", "...", "YOUR_API_KEY_HERE", "CHANGE_ME", "your-token", "-----")
    places = [(k, c) for k, (c, y) in enumerate(zip(found, labels)) if c.role and c.kind == "literal" and y]
    turns = min(max(3, MADE // max(1, len(places))), 40)
    for k, c in places:
        for turn in range(turns):
            h = zlib.crc32(f"{k}{turn}{c.name}".encode())
            a, b, d = vocabulary[h % len(vocabulary)], vocabulary[h // 7 % len(vocabulary)], h // 49 % 10_000
            kinds = (a, f"{a}{d % 100}", f"{a}{b}", f"{a}-{b}", f"{a[:2]}{d}{b[:2]}", f"{a.capitalize()}{d}", f"{d}{d * 7 % 10_000}", f"{h:08x}{h * 7919 % 65536:04x}", f"{a}{b}{d % 1000}")
            made = kinds[h // 3 % len(kinds)]
            # a word in prose, a header's or a cookie's word, and a number of tokens may be anything
            if not (c.role in ("told", "header", "cookie") and made.isalpha()):
                plain = replace(c, token=made, path=c.path if turn % 3 else "", right=c.right if h % 4 else "")
                if turn % 3 == 2 and c.name:  # under another name, in front of nothing else
                    last = WORD.findall(c.name)[-1:] or [c.name]
                    plain = replace(plain, name=f"{b}_{last[0]}", words=[b, last[0].lower()], path="")
                out.append(plain)
                label.append(int(not (made.isdigit() and "token" in c.name)))
                place.append(k)
            if turn % 3 == 0:
                out.append(replace(c, path=c.path if h % 2 else "", token=standins[h % len(standins)] if h % 3 else masks[h // 5 % len(masks)]))
                label.append(0)
                place.append(k)
    return out, label, place


# --- features ------------------------------------------------------------------------------------

FIELDS = ("content", "raw_json", "payload.output")
N_SLOTS = 48
_HASHED: dict[str, int] = {}


def _bucket(name: str) -> int:
    got = _HASHED.get(name)
    if got is None:
        if len(_HASHED) > 400_000:
            _HASHED.clear()
        got = _HASHED[name] = 1 + zlib.crc32(name.encode("utf-8", "replace")) % (BUCKETS - 1)
    return got


def _shape(t: str) -> tuple[str, str]:
    """(which character classes occur, a finer form of it with length and runs)."""
    n = len(t)
    digits = sum(map(str.isdigit, t))
    uppers = sum(map(str.isupper, t))
    lowers = sum(map(str.islower, t))
    signs = n - digits - uppers - lowers
    mask = "0" * bool(digits) + "A" * bool(uppers) + "a" * bool(lowers) + "!" * (not SPECIAL.isdisjoint(t)) + "." * bool(signs and SPECIAL.isdisjoint(t))
    size = "s" if n < 8 else "m" if n < 16 else "l" if n < 32 else "x"
    return mask, f"{mask}{size}"


def _names(c: Found, field: str, llr: float, own_path: str) -> list[str]:
    """The features of a candidate by name."""
    if c.kind in ("pem", "data"):
        header = WORD.findall(c.token[:60].split("-----")[1]) if c.kind == "pem" else [c.token[5 : c.token.find(";")]]
        body = len(c.token) - 60
        return ["bias", f"block:{c.kind}", f"body:{min(body // 40, 3)}", "header:" + " ".join(header), *[f"head:{w}" for w in header[:6]], f"tail:{' '.join(header[-2:])}:{min(body // 40, 1)}"]
    t = c.token
    n = len(t)
    mask, fine = _shape(t)
    level = min(max(int(llr * 3 + 6), 0), 11)
    total = min(max(int(llr * n / 4 + 4), 0), 11)
    different = len(set(t))
    turns = sum((a.isupper() and b.islower()) or (a.islower() and b.isupper()) for a, b in zip(t, t[1:]))
    words = c.words[-3:][::-1]
    parts = [w.lower() for w in WORD.findall(t)][:5]
    turned = f"{fine}{min(turns, 3)}{min(n // 10, 6)}"
    out = [
        "bias", f"level:{level}", f"total:{total}", f"mask:{mask}", f"fine:{fine}", f"turned:{turned}", f"different:{min(different, 6)}:{min(n // 4, 4)}", f"kind:{c.kind}:{c.role}", f"role:{c.role}:{level}",
        f"role:{c.role}:{fine}", f"field:{field}", f"right:{c.right}", f"left:{c.left}:{c.role}", f"p2:{t[:2]}:{fine}", f"p3:{t[:3]}:{size_of(n)}", f"p4:{t[:4]}", f"p4:{t[:4]}:{size_of(n)}", f"p5:{t[:5]}",
        f"hex:{_HEX.fullmatch(t) is not None}:{size_of(n)}", f"name:{c.name}", f"name:{c.name}:{mask}", f"different:{min(different, 6)}:{c.role}",
    ]
    for k, w in enumerate(words):
        out += [f"w:{w}:{k > 0}", f"w:{w}:{level}", f"w:{w}:{turned}", f"w:{w}:{fine}:{level // 2}"]
    out += [f"part:{w}" for w in parts]
    if len(parts) > 1:
        out.append("parts:" + ":".join(parts[:2]))
    if c.role and parts and t.isalpha():
        out.append(f"word:{t.lower()}")
    if c.path:  # the last file named before
        stem, _, ext = c.path.rpartition(".")
        out += [f"ext:{ext[:8]}" if stem else "ext:", f"dir:{c.path.split('/')[0][:24]}"]
    if own_path:
        out += [f"own:{own_path.rpartition('.')[2][:8]}", f"in:{own_path.strip('/').split('/')[0][:24]}"]
    return out


_HEX = re.compile("[0-9a-fA-F]+")


def size_of(n: int) -> int:
    return n if n < 12 else 12 + n // 8 if n < 80 else 22


def chain_scores(tokens: list[str], chain: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each token's characters under the two chains, per character."""
    joined = [t.encode("latin-1", "replace") or b" " for t in tokens]
    sizes = np.array([len(j) for j in joined])
    flat = _CLASS[np.frombuffer(b"".join(joined), dtype=np.uint8)]
    before = np.concatenate([[START], flat[:-1]])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before[firsts] = START
    return np.add.reduceat(chain[before, flat], firsts) / sizes


def train_chain(tokens: list[str], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, N_CHARS, N_CHARS), 0.2)
    for t, y in zip(tokens, labels):
        c = _CLASS[np.frombuffer(t.encode("latin-1", "replace"), dtype=np.uint8)]
        np.add.at(counts[int(y)], (np.concatenate([[START], c[:-1]]), c), 1)
    p = counts / counts.sum(axis=2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def features(found: list[Found], fields: list[str], chain: np.ndarray, paths: list[str] | None = None) -> np.ndarray:
    """Row by row the buckets that are set, filled up with bucket 0, whose weight is 0."""
    block = [c.kind in ("pem", "data") for c in found]
    llr = chain_scores(["" if b else c.token for b, c in zip(block, found)], chain)
    x = np.zeros((len(found), N_SLOTS), dtype=np.int32)
    for k, (c, f, s) in enumerate(zip(found, fields, llr)):
        got = [_bucket(name) for name in _names(c, f, float(s), paths[k] if paths else "")][:N_SLOTS]
        x[k, : len(got)] = got
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 2e-6, steps: int = 160, weight: np.ndarray | None = None) -> np.ndarray:
    """Full-batch Adam over rows of buckets; both classes weigh the same."""
    w, m, v = (np.zeros(BUCKETS) for _ in range(3))
    own = np.ones(len(y)) if weight is None else weight
    share = np.where(y > 0, 0.5 / max(1e-9, own[y > 0].sum()), 0.5 / max(1e-9, own[y == 0].sum())) * own
    flat = x.ravel()
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(flat, weights=np.repeat((p - y) * share, x.shape[1]), minlength=BUCKETS) + l2 * w
        g[0] = 0
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-7)
        w[0] = 0
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the scores (Platt) on rows the weights have not seen."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y == 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, q = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -1, 1)
    return max(float(a), 0.05), float(b)


@dataclass
class Model:
    chain: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float
    prior: bool = field(default=False)

    def probabilities(self, found: list[Found], fields: list[str], paths: list[str] | None = None) -> np.ndarray:
        if self.prior:
            return np.array([float(weak_label(c)) for c in found])
        z = self.weights[features(found, fields, self.chain, paths)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def train(sample: list[tuple[str, ...]]) -> Model:
    """``sample``: (field, text) or (field, text, path of the record).  Every fourth text by hash is held out for the calibration.

    The weights are fitted twice: candidates of the training texts that the first weights get wrong, but that
    the bound left out, join the second fit.  Without both classes in the sample the patterns judge alone.
    """
    found, fields, held, paths = [], [], [], []
    for name, text, *path in sample:
        late = zlib.crc32(text.encode("utf-8", "replace")) % 4 == 0
        for c in candidates(text):
            found.append(c)
            fields.append(name)
            paths.append(path[0] if path else "")
            held.append(late)
    labels = np.array([weak_label(c) for c in found], dtype=float)
    if not found or labels.min() == labels.max():
        return Model(np.zeros((N_CHARS, N_CHARS)), np.zeros(0), 1.0, 0.0, prior=True)
    more, more_labels, place = augmented(found, labels)
    # each way of announcing weighs about the same among the made ones
    roles = Counter(c.role for c in more)
    weight = np.concatenate([np.ones(len(found)), [min(0.1 * (len(more) / roles[c.role]) ** 0.5, 0.9) for c in more]])
    found, fields, held = found + more, fields + [fields[k] for k in place], held + [held[k] for k in place]
    paths += [paths[k] for k in place]
    labels, test = np.concatenate([labels, more_labels]), np.array(held)
    if not test.any() or test.all():
        test = np.arange(len(found)) % 4 == 0
    rank = np.array([zlib.crc32(f"{k}".encode()) for k in range(len(found))])
    kept = np.zeros(len(found), dtype=bool)
    for y in (0, 1):  # half of the candidates used from either class
        own = np.flatnonzero(labels == y)
        kept[own[np.argsort(rank[own], kind="stable")[: SAMPLE_CANDIDATES // 2]]] = True
    real = weight == 1
    chain = train_chain([c.token for c, k in zip(found, kept & ~test & real) if k and c.kind not in ("pem", "data")], np.array([y for c, y, k in zip(found, labels, kept & ~test & real) if k and c.kind not in ("pem", "data")]))
    x = features(found, fields, chain, paths)
    for _ in range(2):
        use = kept & ~test
        w = fit_logistic(x[use], labels[use], weight=weight[use])
        z = w[x].sum(axis=1)
        wrong = ~test & ((z > -1) != (labels > 0))
        kept |= wrong
    scale, shift = calibrate(z[test & real], labels[test & real])
    return Model(chain, w, scale, shift)


def find(texts: list[str | None], fields: list[str], model: Model, paths: list[str | None] | None = None) -> list[list[tuple[int, int]]]:
    """The spans of secrets in each text."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found, owner = [], []
    for k, text in enumerate(texts):
        if text:
            got = candidates(text)
            found += got
            owner += [k] * len(got)
    if found:
        own = [paths[k] or "" for k in owner] if paths else None
        for c, k, p in zip(found, owner, model.probabilities(found, [fields[k] for k in owner], own)):
            if p >= THRESHOLD:
                spans[k].append((c.start, c.end))
    return spans


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    parts, end = [], 0
    for a, b in spans:
        parts += [text[end:a], MARK]
        end = b
    return "".join(parts) + text[end:]


def _scan(model: Model, src: str, names: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for at, name in enumerate(names, 2):
                texts = batch.column(at).to_pylist()
                for row_id, text, spans in zip(ids, texts, find(texts, [name] * len(texts), model, paths)):
                    if spans:
                        rows.append((row_id, name, cut(text, spans) if with_text else "", len(spans)))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([src] * len(rows), pa.string()),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.string()),
                    pa.array(columns[2], pa.string()),
                    pa.array(columns[3], pa.int64()),
                ],
                ["src", "row_id", "field", "redacted", "n"],
            )

    return run


def sample_of(table: DataFrame, row_id: str, fields: dict[str, str], most: int, path: str | None = None, chars: int = SAMPLE_TOTAL) -> list[tuple[str, str, str]]:
    """(field, text, path) of about ``most`` rows and ``chars`` characters at most, spread evenly by the hash of their id, without overlong texts."""
    texts = [F.when(F.length(c) <= SAMPLE_CHARS, F.col(c)) for c in fields.values()]
    sizes = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0))
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(sizes.cast("bigint")), F.lit(0))).first()
    share = min(1.0, most / max(1, n), chars / max(1, size))
    kept = table if share == 1 else table.where(F.pmod(F.xxhash64(row_id), F.lit(1 << 20)) < int((1 << 20) * share))
    own = (F.col(path) if path else F.lit("")).alias("p")
    rows = kept.select(own, *[t.alias(f"f{k}") for k, t in enumerate(texts)]).limit(most + most // 8).collect()
    return [(f, r[k + 1], r["p"] or "") for r in rows for k, f in enumerate(fields) if r[k + 1]]


def scan(tables: list[tuple], with_text: bool = True) -> DataFrame:
    """(src, row_id, field, redacted, n): one row per field with at least one secret, ``n`` of them.

    ``tables``: (rows, src, id column, {field: text column}) or with a fifth entry, the column of the
    record's own path.  Every physical row is read and judged, copies too; null and empty texts have
    no secrets; texts of any length are scanned whole.  The model is the same for all tables, trained
    on at most ``SAMPLE_ROWS`` of their rows and ``SAMPLE_TOTAL`` characters.
    """
    tables = [(*t, None)[:5] for t in tables]
    sample: list[tuple[str, str, str]] = []
    for rows, _, row_id, fields, path in tables:
        sample += sample_of(rows, row_id, fields, SAMPLE_ROWS // len(tables), path, SAMPLE_TOTAL // len(tables))
    model = train(sorted(sample))
    parts = []
    for rows, src, row_id, fields, path in tables:
        own = rows.select(
            F.col(row_id).cast("bigint").alias("row_id"),
            (F.col(path) if path else F.lit(None).cast("string")).alias("path"),
            *[F.col(c).alias(f"t{k}") for k, c in enumerate(fields.values())],
        )
        parts.append(
            own.mapInArrow(
                _scan(model, src, list(fields), with_text), "src string, row_id bigint, field string, redacted string, n bigint"
            ),
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
