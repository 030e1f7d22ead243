"""Garbled text from a wrong character decoding: found, and restored where possible.

Characters are mapped back to the bytes of the code page they were wrongly read with; a
byte-structure automaton (well-formed UTF-8 multibyte sequences) finds the maximal spans
that make sense, and only those spans are decoded.  This repeats for text garbled twice.
Text that was read as one single-byte code page and written in another has no such
structure: there each code page pair is judged by how often the corpus has the characters
in their neighbourhood, a table that is counted over all documents and bounded by the
alphabets.  Lines of dense accented characters can be legacy multibyte text read bytewise; they
count where a decoding gives common text, or where no clean text could look like them.

A span is decoded if the decoded text is likelier in its place than the text as it stands, both by that
table.  What is judged is the run of characters beyond ASCII with what stands beside it; runs recur, so
their judgements are kept per worker and a clean document costs a few lookups.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages that UTF-8 text is wrongly read with.
SINGLE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250")
CYRILLIC = frozenset(("cp1251", "koi8_r", "cp866"))
MULTI_BYTE = ("gb18030", "cp932", "cp950", "euc_jp", "euc_kr")
#: Pairs of single-byte code pages (read as, written in).
PAIRS = tuple((w, r) for w in ("cp850", "cp437", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1252") for r in ("cp1252", "mac_roman", "cp1251", "koi8_r", "cp850", "cp866") if w != r)

#: Well-formed UTF-8 multibyte sequences, one or more.
UTF8_SPANS = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
UTF8_SPANS_BYTES = re.compile(UTF8_SPANS.pattern.encode("latin-1"))
#: What a decoded character may be: letters and marks of any living script, punctuation and signs, box drawing, kana, CJK, Hangul, wide forms, emoji.
_SIGNS = "\u00a0-¿×÷​-\u206f₠-⃀℀-⅏←-⇿∀-⋿⌀-⏿─-◿☀-➿　-〿＀-￯\ufffd\U0001f000-\U0001faff\u02c6-\u02dd\u0300-\u036f"
#: Scripts by range; letters of one stand beside each other or beside common characters.
SCRIPTS = ("À-ſƏƒƠơƯưǍ-ǜȘ-țəḀ-ỿ", "Ͱ-Ͽἀ-῿", "Ѐ-ӿ", "\u0531-\u058f", "\u0590-\u05ff", "\u0600-\u06ff", "\u0900-\u097f", "\u0980-\u09ff", "\u0a00-\u0a7f", "\u0b80-\u0bff", "\u0c00-\u0cff", "\u0e00-\u0e7f", "\u10a0-\u10ff", "\u1780-\u17ff", "぀-ヿ㐀-䶿一-鿿", "가-힣")
PLAUSIBLE = re.compile("(?:[" + _SIGNS + SCRIPTS[0] + "\x81\x8d\x8f\x90\x9d]|" + "|".join(f"[{x}]" for x in SCRIPTS[1:]) + ")+")
#: Letters that need another of their script, or to be common, to be taken for restored text.
_PAIRWISE = re.compile("|".join(f"[{x}]{{2,}}" for x in SCRIPTS[1:]))
_LONE = re.compile("|".join(f"[{x}]" for x in SCRIPTS[1:]))
QUOTED = re.compile(r"`[^`\n]+`")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
NON_ASCII_RUN = re.compile(r"[^\x00-\x7f]+")
#: Five or more characters of the upper half of Latin-1 in a row, with a sign or both cases among them: no language writes so.
DENSE = re.compile("(?=[^\\s]*[a-zß-ÿœšž][A-ZÀ-ÞŒŠŽ]|[^\\s]*[\u0080-¿ƒˆ˜‚-„†-•‰‹›€™])[\u0080-ÿŒœŠšŸŽžƒˆ˜–-•…‰‹›€™]{5,}")
#: Runs that bytes of two-byte characters make.
BYTEWISE = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-•…‰‹›€™]{2}")
WIDE = re.compile("[⺀-鿿가-힣＀-￯]")
_ODD = "￿"


def _back(codec: str) -> dict[int, str]:
    """Code point -> character whose code point is the byte; everything beyond ASCII without a byte becomes a break."""
    table: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
    if codec == "cp1252":  # decoders differ in what they make of its holes
        for b in range(0x80, 0xA0):
            table.setdefault(b, chr(b))
    return table


class _Table(dict):
    def __missing__(self, key: int) -> str:
        return _ODD if key > 0x7F else chr(key)


BACK = {c: _Table(_back(c)) for c in SINGLE_BYTE}


def _pair(read: str, written: str) -> dict[int, str]:
    out = {}
    for point, byte in _back(read).items():
        try:
            out[point] = bytes([ord(byte)]).decode(written)
        except UnicodeDecodeError:
            out[point] = _ODD
    return {p: c for p, c in out.items() if ord(c) != p}


PAIR_TABLES = {p: _pair(*p) for p in PAIRS}
PAIR_CHARS = {p: {chr(a): b for a, b in t.items()} for p, t in PAIR_TABLES.items()}
ALPHABET = frozenset().union(*[_back(c).keys() for c in SINGLE_BYTE])
IN_ALPHABET = frozenset(map(chr, ALPHABET))


@lru_cache(maxsize=65_536)
def _beside(ch: str) -> str:
    """A neighbour as a class: its lower-case letter, or kind."""
    if ch.isalpha():
        return ch.lower() if ord(ch) < 0x500 else "L"
    return " " if ch.isspace() else "0" if ch.isdigit() else "."


def _keys(run: str, left: str, right: str) -> list[str]:
    """For each character of a run: (left class, character, right class), or "c" and itself beyond the single-byte alphabets."""
    sides = [left, *map(_beside, run), right]
    return [sides[k] + ch + sides[k + 2] if ch in IN_ALPHABET else "c" + ch for k, ch in enumerate(run)]


def runs_of(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, run, class before, class after) of each run of characters beyond ASCII."""
    n = len(text)
    for m in NON_ASCII_RUN.finditer(text):
        a, b = m.span()
        yield a, b, m.group(), _beside(text[a - 1]) if a else " ", _beside(text[b]) if b < n else " "


def neighbourhoods(text: str) -> list[str]:
    """(left class, character, right class) of each character of the single-byte code pages beyond ASCII."""
    return [k for *_, run, left, right in runs_of(text) for k in _keys(run, left, right) if len(k) == 3]


def _visible(text: str) -> str:
    """Text without the examples in backticks; every other character keeps its place."""
    return QUOTED.sub(lambda m: " " * len(m.group()), text)


def _pairs_of(codec: str) -> re.Pattern:
    """A lead byte's character followed by a continuation byte's: without one there is no span."""
    back = _back(codec)
    lead = "".join(re.escape(chr(p)) for p, b in back.items() if 0xC2 <= ord(b) <= 0xF4)
    rest = "".join(re.escape(chr(p)) for p, b in back.items() if 0x80 <= ord(b) <= 0xBF)
    return re.compile(f"[{lead}][{rest}]")


PAIRED = {c: _pairs_of(c) for c in SINGLE_BYTE}
ANY_PAIRED = re.compile("|".join(p.pattern for p in PAIRED.values()))
#: Counts that are added to those of the corpus: for characters as they stand, and for plausible decoded ones.
UNSEEN, UNSEEN_DECODED = 0.3, 3.0
#: Least log-likelihood ratio for a line's spans, and the least share of a run that its spans must hold (the rest is lost bytes).
LEAST_GAIN, LEAST_COVER = 0.5, 0.5


def decode_spans(text: str, codec: str, common: Callable[[str], bool] = lambda c: False) -> tuple[str, float]:
    """Decode the maximal well-formed spans of one single-byte code page; (text, share of characters beyond ASCII in spans).

    Decoded letters of scripts other than Latin must stand beside another of their script, or be common.
    """
    if not PAIRED[codec].search(text):
        return text, 0.0
    seen = text.translate(BACK[codec])
    parts, end, n = [], 0, 0
    for m in UTF8_SPANS.finditer(seen):
        try:
            good = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not PLAUSIBLE.fullmatch(good) or any(not common(c) for c in _LONE.findall(_PAIRWISE.sub("", good))):
            continue
        parts += [text[end : m.start()], good]
        end, n = m.end(), n + m.end() - m.start()
    return "".join(parts) + text[end:], n / max(1, len(NON_ASCII.findall(text)))


class Judge:
    """The corpus' counts, and what was found out about each run so far (per worker, bounded)."""

    MOST = 300_000

    def __init__(self, known: dict[str, int], odds: dict[str, int]):
        self.known, self.odds = known, odds
        self.n = max(1, known.get("\x00n", 0))
        self.usual, self.enough = odds["\x00usual"], known["\x00common"]
        self.common_chars = frozenset(c for c, k in known.items() if len(c) == 1 and k >= self.enough)
        self.runs: dict[tuple[str, str, str], tuple] = {}
        # by character and code page pair: whether the pair moves it, and how much likelier that makes it by itself
        self.row = {c: k for k, c in enumerate(sorted(IN_ALPHABET))}
        self.moves = np.zeros((len(self.row), len(PAIRS)))
        self.single = np.zeros((len(self.row), len(PAIRS)))
        for p, pair in enumerate(PAIRS):
            for c, to in PAIR_CHARS[pair].items():
                self.moves[self.row[c], p] = 1
                self.single[self.row[c], p] = -1e9 if to == _ODD else math.log((known.get(to, 0) + 0.5) / (known.get(c, 0) + 0.5))

    def likelihood(self, keys: list[str], unseen: float) -> float:
        odds, known, n = self.odds, self.known, self.n
        return sum(math.log(((known.get(k[1], 0) if len(k) == 2 else odds.get(k, 0)) + unseen) / (n + 1)) for k in keys)

    def line(self, text: str) -> float:
        return self.likelihood([k for *_, run, left, right in runs_of(text) for k in _keys(run, left, right)], UNSEEN)

    def common(self, ch: str) -> bool:
        return ch in self.common_chars

    def run(self, run: str, left: str, right: str) -> tuple[int, int, list[tuple[str, float, str, bool]]]:
        """(characters of the alphabets, how many of them stand as usual, [(code page, gain, decoded, is weak)]).

        Weak is a single two-byte span of a Cyrillic page: clean text has such pairs (a capital and a closing quote).
        """
        key = (left, run, right)
        got = self.runs.get(key)
        if got is None:
            got = self._judge(run, left, right)
            if len(run) <= 40:
                if len(self.runs) >= self.MOST:
                    self.runs.clear()
                self.runs[key] = got
        return got

    def _judge(self, run: str, left: str, right: str) -> tuple[int, int, list[tuple[str, float, str, bool]]]:
        keys = _keys(run, left, right)
        own = [k for k in keys if len(k) == 3]
        usual = sum(self.odds.get(k, 0) > self.usual for k in own)
        options = []
        if ANY_PAIRED.search(run):
            here = None
            for codec in SINGLE_BYTE:
                out, share = decode_spans(run, codec, self.common)
                if share < LEAST_COVER:
                    continue
                if here is None:
                    here = self.likelihood(keys, UNSEEN)
                there = [k for *_, r, a, b in runs_of(_frame(left) + out + _frame(right)) for k in _keys(r, a, b)]
                gain = self.likelihood(there, UNSEEN_DECODED) - here
                if gain > 0:
                    options.append((codec, gain, out, codec in CYRILLIC and len(out) == len(run) - 1))
        return len(own), usual, options


def _frame(side: str) -> str:
    """A character of a neighbour's class."""
    return side if side.isascii() and len(side) == 1 and side != "L" else "x"


def decode_wide_runs(text: str, codec: str, judge: Judge) -> tuple[str, float]:
    """Decode runs that were read with a multibyte code page: nearly all their bytes must be well-formed and common."""
    parts, end, n = [], 0, 0
    for m in NON_ASCII_RUN.finditer(text):
        run = m.group()
        if not WIDE.search(run):
            continue
        raw = run.replace("�", "?").encode(codec, "replace")
        found = list(UTF8_SPANS_BYTES.finditer(raw))
        covered = sum(m.end() - m.start() for m in found)
        if covered < 0.75 * len(raw.replace(b"?", b"")):
            continue
        good = "".join(s.group().decode("utf-8", "ignore") for s in found)
        share = _common(good, judge)
        if not good or share < 0.6 or share <= _common(run, judge):
            continue
        # what lies between the spans is lost: one replacement character for each gap
        out, at = [], 0
        for span in found:
            out += ["\ufffd"] * (span.start() > at) + [span.group().decode("utf-8", "ignore")]
            at = span.end()
        out += ["\ufffd"] * (len(raw) > at)
        parts += [text[end : m.start()], *out]
        end, n = m.end(), n + len(run)
    return "".join(parts) + text[end:], n / max(1, len(NON_ASCII.findall(text)))


def _common(text: str, judge: Judge) -> float:
    """Share of the characters beyond ASCII that many documents have."""
    wide = "".join(NON_ASCII_RUN.findall(text))
    return sum(map(judge.common_chars.__contains__, wide)) / max(1, len(wide))


def restore_bytewise(line: str, judge: Judge) -> str | None:
    """Legacy multibyte or Cyrillic text that was read byte by byte; null if no code page gives common characters.

    A few bytes that got lost are replaced.
    """
    seen = line.translate(BACK["cp1252"])
    if _ODD in seen:
        return None
    raw, best = seen.encode("latin-1"), None
    for codec in ("gb18030", "cp950", "cp932", "euc_jp", "euc_kr", "cp1251", "koi8_r"):
        out = raw.decode(codec, "replace")
        lost = out.count("\ufffd")
        if lost > 0.1 * len(out):
            continue
        score = _common(out, judge) - lost / len(out)
        if score > 0.7 and (best is None or score > best[0]):
            best = (score, out)
    return best and best[1]


#: Least gain of a shift between single-byte pages.
LEAST_SHIFT = 8.0


def shift_page(text: str, judge: Judge) -> tuple[str, str] | None:
    """Text of one single-byte code page read as another: (restored, pair), or null if it is fine as it is.

    Only the runs and their neighbours are weighed.  A pair is weighed in full if its characters
    alone, wherever they stand, aren't far rarer than those that are there.
    """
    runs = [x[2:] for x in runs_of(text)]
    now = [k for run in runs for k in _keys(*run) if len(k) == 3]
    if len(now) < 2 or sum(judge.odds.get(x, 0) > judge.usual for x in now) > 0.5 * len(now):
        return None
    here = sum(math.log(judge.odds.get(x, 0) + 0.5) for x in now)
    held = Counter(k[1] for k in now)
    at, times = [judge.row[c] for c in held], np.array(list(held.values()), dtype=float)
    moved, single = times @ judge.moves[at], times @ judge.single[at]
    best = None
    for p in np.flatnonzero((moved >= 2) & (moved >= 0.5 * len(now)) & (single >= -moved)):
        pair, n = PAIRS[p], moved[p]
        table = PAIR_CHARS[pair]
        gain = -here
        for run, left, right in runs:
            for k in _keys("".join([table.get(c, c) for c in run]), left, right):
                if len(k) == 3:
                    gain += math.log(judge.odds.get(k, 0) + 0.5)
        if gain > LEAST_SHIFT and gain > 1.2 * n and (best is None or gain > best[0]):
            best = (gain, pair)
    return best and (text.translate(PAIR_TABLES[best[1]]), "/".join(best[1]))


def _decode_line(line: str, judge: Judge, found: list[str]) -> tuple[str, bool]:
    """A line with its spans decoded, again and again while something is found (each time it gets shorter), and if it then looks unusual."""
    while True:
        gains: dict[str, float] = {}
        runs = []
        n = usual = 0
        for a, b, run, left, right in runs_of(line):
            own, fine, options = judge.run(run, left, right)
            n, usual = n + own, usual + fine
            if options:
                runs.append((a, b, options))
                for codec, gain, _, weak in options:
                    if not weak:
                        gains[codec] = gains.get(codec, 0.0) + gain
        best = max(gains, key=gains.get, default=None)
        if best is not None and gains[best] > LEAST_GAIN:
            parts, end = [], 0
            for a, b, options in runs:
                for codec, _, out, _ in options:
                    if codec == best:
                        parts += [line[end:a], out]
                        end = b
            line = "".join(parts) + line[end:]
        elif WIDE.search(line) and _common(line, judge) < 0.85:
            best, _, line = _wide(line, judge)
            if best is None:
                return line, _few(n, usual)
        else:
            return line, _few(n, usual)
        found.append(f"utf-8 as {best}")


def _few(n: int, usual: int) -> bool:
    """Half or more of at least two characters of the single-byte alphabets stand where the corpus has them rarely."""
    return n >= 2 and 2 * usual <= n


def _wide(line: str, judge: Judge) -> tuple[str | None, float, str]:
    """(code page, share, text) of the best multibyte code page; none if none fits."""
    options = [(share, -c, out) for c, codec in enumerate(MULTI_BYTE) for out, share in [decode_wide_runs(line, codec, judge)] if share]
    if not options:
        return None, 0.0, line
    share, c, out = max(options)
    return MULTI_BYTE[-c], share, out


def _unusual(line: str, judge: Judge) -> bool:
    got = [judge.run(*x[2:])[:2] for x in runs_of(line)]
    return _few(sum(a for a, _ in got), sum(b for _, b in got))


def restore(text: str | None, judge: Judge) -> tuple[str, list[str]]:
    """(restored text, what was found); nothing found for null, empty, ASCII and clean texts.

    Examples in backticks are neither judged nor changed.  Replacement characters count as
    garbled although they cannot be restored.
    """
    if not text or text.isascii():
        return text or "", []
    quoted = "`" in text
    visible = _visible(text) if quoted else text
    if visible.isascii():
        return text, []
    found: list[str] = []
    lines = visible.split("\n")
    odd: list[int] = []
    for k, line in enumerate(lines):
        if line.isascii():
            continue
        own: list[str] = []
        good, unusual = _decode_line(line, judge, own)
        if (unusual or own) and BYTEWISE.search(line) and (not own or _unusual(line, judge)):
            legacy = restore_bytewise(line, judge)
            if legacy is not None and judge.line(legacy) > judge.line(good):
                own, good = ["bytewise"], legacy
                unusual = _unusual(good, judge)
            elif DENSE.search(line) and (not own or DENSE.search(good)):
                own, good = ["bytewise, not restored"], line
        found += own
        lines[k] = good
        if unusual:
            odd.append(k)
    for k in odd:
        if moved := shift_page(lines[k], judge):
            lines[k] = moved[0]
            found.append(moved[1])
    out = "\n".join(lines)
    if not found and len(lines) > 1 and _unusual(out, judge) and (moved := shift_page(out, judge)):
        out = moved[0]
        found.append(moved[1])
    if "�" in visible:
        found.append("lost")
    if quoted and found:
        out = _put_back(text, out)
    return (out, found) if found else (text, [])


def _put_back(text: str, out: str) -> str:
    """Return the quoted examples to their lines."""
    a, b = text.split("\n"), out.split("\n")
    if len(a) != len(b):
        return out
    for k, (old, new) in enumerate(zip(a, b)):
        for quote in QUOTED.findall(old):
            new = new.replace(" " * len(quote), quote, 1)
        b[k] = new
    return "\n".join(b)


# --- over the corpus ----------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per map task: in how many documents each neighbourhood and each character occurs."""
    got: Counter = Counter()
    keys_of: dict[tuple[str, str, str], tuple[str, ...]] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            got["n"] += 1
            if text and not text.isascii():
                seen = _visible(text) if "`" in text else text
                keys: set[str] = set()
                for run in {x[2:] for x in runs_of(seen)}:
                    own = keys_of.get(run)
                    if own is None:
                        # the classes of neighbours vary beyond the alphabets, their characters count all the same
                        own = (*_keys(*run), *("c" + c for c in run[0] if c in IN_ALPHABET))
                        if len(run[0]) <= 24 and len(keys_of) < Judge.MOST:
                            keys_of[run] = own
                    keys.update(own)
                got.update(keys)
    keys = list(got)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([got[k] for k in keys], pa.int64())], ["key", "n"])


def character_statistics(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], dict[str, int]]:
    """(documents per character, documents per neighbourhood) over all documents.

    Bounded by the alphabets, not by the corpus: characters by Unicode, neighbourhoods by the
    single-byte code pages (about 600 characters) and the classes beside them.
    """
    counts = docs.select(text).mapInArrow(_count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    known: dict[str, int] = {}
    odds: dict[str, int] = {}
    for key, n in counts.collect():
        if key == "n":
            known["\x00n"] = n
            # a neighbourhood that one document in 60 has is a usual one
            odds["\x00usual"] = max(2, n // 60)
        elif len(key) == 2 and key[0] == "c":
            known[key[1]] = n
        else:
            odds[key] = n
    common = sorted((n for c, n in known.items() if WIDE.match(c)), reverse=True)
    odds.setdefault("\x00usual", 2)
    known["\x00common"] = max(3, common[len(common) // 4] if common else 3)
    return known, odds


def _judge(known: dict[str, int], odds: dict[str, int], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(known, odds)
        for batch in batches:
            ids, outs, hows = [], [], []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, found = restore(text, judge)
                if found:
                    ids.append(row_id)
                    outs.append(out if with_text else "")
                    hows.append(",".join(dict.fromkeys(found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(outs, pa.string()), pa.array(hows, pa.string())],
                ["row_id", "restored", "how"],
            )

    return run


def repair(docs: DataFrame, row_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(row_id, restored, how) of every garbled document; clean, null and empty texts give no row.

    A repeated document is judged each time.  ``how`` names the wrong decodings; "lost" are
    replacement characters, which nothing can restore.  Other columns are not read.
    """
    known, odds = character_statistics(docs, text)
    rows = docs.select(F.col(row_id).cast("bigint"), F.col(text))
    return rows.mapInArrow(_judge(known, odds, with_text), "row_id bigint, restored string, how string")
