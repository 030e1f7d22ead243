"""Evaluation texts leaking into training text.

The test items are an inverted index of their terms (pairs of neighbouring words, of characters
in scripts without spaces) with BM25 impacts, kept in blocks with their largest impact.  Every passage
of every document is a query: block-max WAND skips the items whose bound stays below the
threshold and retrieves all others.  An item's threshold is ``KEPT`` times the least score that
any of its own passages of the least length has, so a passage that keeps that much of its
weight is retrieved (a changed word costs two pairs).  Retrieved pairs are verified by aligning both texts word by word.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BLOCK = 32
#: Words of a passage that is looked up, and its step; a passage of up to 40 words lies whole in one.
WINDOW, STEP = 80, 40
#: Least length of a leak: words, or characters for texts without spaces.
LEAST_WORDS, LEAST_CHARS = 30, 60
#: A leak's edge words may be among the changed ones.
EDGE = 3
#: Share of a passage's weight that changes leave.
KEPT = 0.4
#: What a word that isn't found costs against one that is.
MISS = 1.5
#: Bounds of one index, which is sent to the executors: items and their characters.
ITEMS_PER_INDEX, CHARS_PER_INDEX = 20_000, 40_000_000

TOKEN = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]|[^\W_぀-ヿ㐀-䶿一-鿿가-힣]+")
WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]")


def tokens(text: str) -> list[str]:
    """Words in lower case; each character of a script without spaces is a word."""
    return TOKEN.findall(text.lower())


def terms(words: list[str]) -> list[str]:
    """The index term that starts at each word: it and the next one."""
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


class ItemIndex:
    """Inverted index of test items with block-max WAND retrieval."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [tokens(t or "") for _, t in items]
        self.wide = [sum(map(len, filter(WIDE.match, w))) > 0.5 * sum(map(len, w)) for w in self.words]
        lists = [terms(w) for w in self.words]
        n = len(items)
        average = sum(map(len, lists)) / max(1, n) or 1.0
        df = Counter(t for x in lists for t in set(x))
        self.idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.postings: dict[str, tuple[list[int], list[float], list[int], list[float]]] = {}
        gathered: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, x in enumerate(lists):
            for t, f in Counter(x).items():
                gathered[t].append((k, self.idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(x) / average))))
        for t, entries in gathered.items():
            docs, impacts = [d for d, _ in entries], [s for _, s in entries]
            cuts = range(0, len(docs), BLOCK)
            self.postings[t] = (docs, impacts, [docs[min(c + BLOCK, len(docs)) - 1] for c in cuts], [max(impacts[c : c + BLOCK]) for c in cuts])
        self.bound = {t: max(p[1]) for t, p in self.postings.items()}
        self.pairs: dict[str, dict[str, float]] = defaultdict(dict)
        for t, most in self.bound.items():
            a, _, b = t.partition(" ")
            self.pairs[a][b] = most
        self.pairs = dict(self.pairs)
        # words that nearly all items share (of their common templates) say little about a copy
        seen = Counter(w for x in self.words for w in set(x))
        self.weights = [[0.1 + math.log(1 + (n - seen[w] + 0.5) / (seen[w] + 0.5)) for w in x] for x in self.words]
        self.threshold = [self._least(k, lists[k]) for k in range(n)]
        self.least = min(self.threshold, default=math.inf)
        self.asked = [question_words(t or "") for _, t in items]

    def _least(self, k: int, own: list[str]) -> float:
        """``KEPT`` times the least score of the item's own passages of the least length."""
        length = (LEAST_CHARS // 2 if self.wide[k] else LEAST_WORDS) - 1
        impact = {t: self.postings[t][1][bisect_left(self.postings[t][0], k)] for t in set(own)}
        spans = [own[a : a + length] for a in range(0, max(1, len(own) - length + 1))]
        return KEPT * min(sum(impact[t] for t in set(s)) for s in spans) if own else math.inf

    def retrieve(self, query: set[str]) -> list[int]:
        """All items whose score reaches their threshold."""
        # a cursor: its item, its number, its place in its list, the list, its impacts, last items and largest impacts of its blocks, its bound
        cursors = []
        for t in query:
            if t in self.postings:
                docs, impacts, ends, tops = self.postings[t]
                cursors.append([docs[0], len(cursors), 0, docs, impacts, ends, tops, self.bound[t]])
        least, out = self.least, []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for j, c in enumerate(cursors):
                bound += c[7]
                if bound >= least:
                    pivot = j
                    break
            if pivot < 0:
                break
            item, n = cursors[pivot][0], len(cursors)
            while pivot + 1 < n and cursors[pivot + 1][0] == item:
                pivot += 1
            # block bounds of the lists up to the pivot: the item is skipped if they stay below
            blocks, last = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                at = bisect_left(c[5], item)
                if at < len(c[5]):
                    blocks += c[6][at]
                    last = min(last, c[5][at])
            target = item + 1
            if blocks >= least:
                if cursors[0][0] == item:
                    if sum(c[4][c[2]] for c in cursors[: pivot + 1]) >= self.threshold[item]:
                        out.append(item)
                else:
                    target = item
            elif last != math.inf:
                after = cursors[pivot + 1][0] if pivot + 1 < n else math.inf
                target = max(target, int(min(last + 1, after)))
            spent = False
            for c in cursors[: pivot + 1]:
                at = c[2] = bisect_left(c[3], target, c[2])
                if at < len(c[3]):
                    c[0] = c[3][at]
                else:
                    c[0], spent = -1, True
            if spent:
                cursors = [c for c in cursors if c[0] >= 0]
        return out


def matched_words(doc: list[str], item: list[str]) -> list[bool]:
    """Which words of ``item`` stand in ``doc`` in order, along the chain that matches most.

    Pairs of neighbouring words are chained in both orders; up to seven words may be missing or
    different between two of them, as long as both sides move on by nearly as many.
    """
    where: dict[tuple[str, str], list[int]] = defaultdict(list)
    for q in range(len(item) - 1):
        where[item[q], item[q + 1]].append(q)
    seeds = [(p, q) for p in range(len(doc) - 1) for q in where.get((doc[p], doc[p + 1]), ())]
    chains: list[tuple[int, int, int, int]] = []  # doc word, item word, words matched, chain before
    recent, best = 0, -1
    for p, q in seeds:
        while recent < len(chains) and chains[recent][0] < p - 8:
            recent += 1
        hits, before = 2, -1
        for k in range(recent, len(chains)):
            a, b, h, _ = chains[k]
            if a < p and b < q <= b + 8 and abs((p - a) - (q - b)) <= 4 and h + min(2, q - b) > hits:
                hits, before = h + min(2, q - b), k
        chains.append((p, q, hits, before))
        if best < 0 or hits > chains[best][2]:
            best = len(chains) - 1
    found = [False] * len(item)
    while best >= 0:
        _, q, _, best = chains[best]
        found[q] = found[q + 1] = True
    return found


def repeated_part(found: list[bool], weight: list[float]) -> tuple[int, int]:
    """(first, after last) of the part of the item where matched words outweigh ``MISS`` times the others most."""
    best, total, start = (0.0, 0, 0), 0.0, 0
    for k, (hit, w) in enumerate(zip(found, weight)):
        total += w if hit else -MISS * w
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best[0]:
            best = (total, start, k + 1)
    return best[1], best[2]


def repeats(doc: list[str], index: ItemIndex, k: int) -> tuple[int, int, list[bool]] | None:
    """(first, after last, matched words) of the item's part that the text repeats; null if it is too short for a leak."""
    item = index.words[k]
    found = matched_words(doc, item)
    first, after = repeated_part(found, index.weights[k])
    long = sum(map(len, item[first:after])) >= LEAST_CHARS - 2 * EDGE if index.wide[k] else after - first >= LEAST_WORDS - EDGE
    return (first, after, found) if long else None


def is_leak(doc: list[str], index: ItemIndex, k: int) -> bool:
    return repeats(doc, index, k) is not None


def regions_of(words: list[str], index: ItemIndex) -> dict[int, list[tuple[int, int]]]:
    """{item: parts of the text} whose passages retrieve the item, neighbouring passages joined."""
    regions: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if len(words) < LEAST_WORDS - EDGE:
        return regions
    pairs, none = index.pairs, {}
    # passages whose bounds, repeats included, stay below every threshold cannot retrieve anything
    total = list(accumulate([pairs.get(a, none).get(b, 0.0) for a, b in zip(words, words[1:])], initial=0.0))
    if total[-1] < index.least:
        return regions
    last = len(total) - 1
    for a in range(0, max(1, len(words) - WINDOW + STEP), STEP):
        b = min(len(words), a + WINDOW)
        if total[min(b, last)] - total[min(a, last)] < index.least - 1e-9:
            continue
        for item in index.retrieve({f"{x} {y}" for x, y in zip(words[a:b], words[a + 1 : b + 1])}):
            spans = regions[item]
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return regions


def leaks_of(text: str | None, index: ItemIndex) -> list[int]:
    """Items (their places) of which the text repeats a passage."""
    words = tokens(text or "")
    return [k for k, spans in regions_of(words, index).items() if any(is_leak(words[a:b], index, k) for a, b in spans)]


def overlaps_of(text: str | None, index: ItemIndex) -> list[tuple[int, int, float, float]]:
    """(item, words repeated, share of its question's words, share of its other words) of each leak."""
    words, out = tokens(text or ""), []
    for k, spans in regions_of(words, index).items():
        got = [x for a, b in spans if (x := repeats(words[a:b], index, k)) is not None]
        if got:
            found = [any(x[2][q] and x[0] <= q < x[1] for x in got) for q in range(len(index.words[k]))]
            asked = index.asked[k]
            ask, rest = [f for f, q in zip(found, asked) if q], [f for f, q in zip(found, asked) if not q]
            out.append((k, sum(found), sum(ask) / max(1, len(ask)), sum(rest) / max(1, len(rest))))
    return out


def question_words(text: str) -> list[bool]:
    """For each word whether it stands in a sentence that asks."""
    out: list[bool] = []
    for sentence in re.split(r"(?<=[.!?。！？])", text):
        out += [sentence.rstrip().endswith(("?", "？"))] * len(tokens(sentence))
    return out


#: The index of the pass that this Python worker is on, under the pass's key.
_HELD: dict[str, ItemIndex] = {}


def _index_of(key: str, items) -> ItemIndex:
    """The index is built once per worker and pass, not in each task."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = ItemIndex(items.value)
    return _HELD[key]


LEAKS = "item_id bigint, doc_id bigint, n_words bigint, question double, rest double"


def _search(key: str, items, overlaps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(key, items)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = overlaps_of(text, index) if overlaps else [(k, 0, 0.0, 0.0) for k in leaks_of(text, index)]
                rows += [(index.ids[k], doc_id, *x) for k, *x in got]
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "doc_id", "n_words", "question", "rest"])

    return run


def overlap_report(docs: DataFrame, items: DataFrame, overlaps: bool = True) -> DataFrame:
    """(item_id, doc_id, n_words, question, rest): what each leak repeats of its item.

    ``n_words`` of the item stand in the document (characters in scripts without spaces); ``question`` and ``rest`` are
    the shares of the words in its sentences that ask, and of its other words.  Without ``overlaps`` these stay 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    out = spark.createDataFrame([], LEAKS)
    blocks = max(math.ceil(n / ITEMS_PER_INDEX), math.ceil(chars / CHARS_PER_INDEX))
    for k in range(blocks):
        part = items.select(F.col("item_id").cast("bigint"), "text").where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(sorted((i, t) for i, t in part.collect() if t))
        out = out.unionByName(rows.mapInArrow(_search(uuid.uuid4().hex, held, overlaps), LEAKS))
    return out


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that repeat a passage of a test item.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are not read.  Items are
    indexed in blocks of ``ITEMS_PER_INDEX`` and ``CHARS_PER_INDEX``, each its own pass, so what is sent to the executors is
    bounded.  Null and empty texts match nothing; repeated documents give a row each, repeated items
    one per item id.  Without items there are no rows.
    """
    return overlap_report(docs, items, overlaps=False).select("item_id", "doc_id")
