"""Deeply nested records as flat tables with Merkle subtree identities.

Every object gets the identity of its subtree: hashes are formed bottom-up over sorted names
and their values, in which an object counts as its hash, so two objects have one identity wherever and with whatever
spacing and key order they occur.  Identical objects are stored once (``stored``); every
occurrence stays as a row of the bridge with its parent's identity and its ordinals (``descend``).

The bridge needs no shuffle: it is computed record by record in Arrow batches, because columns cannot recurse
without bound.  What goes there is the object that holds the elements, as canonical text.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from hashlib import md5
from json.encoder import encode_basestring as quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = "line_id bigint, child string, root string, parent_ord bigint, ord bigint, path string, node string, parent string"
#: The kinds of child elements, and what is none of them: the object that holds elements, and objects in either.
ELEMENTS = ("message_block", "result_block", "content_block", "tool_call", "thought")
#: More levels than a variant can have, with two frames for each.
FRAMES = 10_000
ROWS_PER_BATCH = 4096
#: Parts of the path of the innermost element: content, number, content, number.
DEEPEST_ELEMENT = 5


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _holder(kind: str, at: Column, v: Column) -> list[Column]:
    return ["line_id", F.lit(kind).alias("holder"), at.cast("bigint").alias("at"), F.to_json(v).alias("text")]


def holders(events: DataFrame, rollouts: DataFrame, chats: DataFrame) -> DataFrame:
    """(line_id, holder, at, text): the object of every physical line that can hold child elements.

    ``message`` of events, ``payload`` of rollout messages, and chat messages with their index ``at`` in a list (-1 for a
    single one).  Each table needs ``line_id`` and ``raw_line``; other columns are not read.  Lines that are null
    or no JSON give no rows.  Repeated lines give rows for each.
    """
    e = events.select("line_id", F.expr("try_variant_get(try_parse_json(raw_line), '$.message', 'variant')").alias("v"))
    e = e.where(get(F.col("v"), "$.content").isNotNull()).select(*_holder("message", F.lit(-1), F.col("v")))
    r = rollouts.select("line_id", F.expr("try_variant_get(try_parse_json(raw_line), '$.payload', 'variant')").alias("v"))
    r = r.where((get(F.col("v"), "$.type", "string") == "message") & get(F.col("v"), "$.content").isNotNull())
    r = r.select(*_holder("payload", F.lit(-1), F.col("v")))
    c = chats.select("line_id", F.expr("try_parse_json(raw_line)").alias("v")).where("v is not null")
    listed = F.transform(
        get(F.col("v"), '$["$set"].messages', "array<variant>"), lambda m, i: F.struct(i.alias("at"), m.alias("m"))
    )
    one = F.array(F.struct(F.lit(-1).alias("at"), F.col("v").alias("m")))
    c = c.select("line_id", F.inline(F.when(get(F.col("v"), '$["$set"]').isNull(), one).otherwise(listed)))
    some = get(F.col("m"), "$.toolCalls").isNotNull() | get(F.col("m"), "$.thoughts").isNotNull()
    c = c.where(some).select(*_holder("chat", F.col("at"), F.col("m")))
    return e.unionByName(r).unionByName(c)


class _Number(str):
    """A number as it is written."""


def _hash(text: str) -> str:
    return md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _seal(v: object, path: str, rows: list[list], loose: list[int], bodies: bool) -> tuple[str, str]:
    """Canonical text of a value (with ``bodies``), and the same with its objects as their hashes.

    Objects are added to ``rows`` as [path, node, parent, text], inner ones first; ``loose`` has the
    numbers of those that no object encloses yet.
    """
    if isinstance(v, dict):
        inside: list[int] = []
        parts = [(quote(k), *_seal(v[k], f"{path}/{k.replace('~', '~0').replace('/', '~1')}", rows, inside, bodies)) for k in sorted(v)]
        text = "{" + ",".join([f"{k}:{t}" for k, t, _ in parts]) + "}" if bodies else ""
        node = _hash("{" + ",".join([f"{k}:{s}" for k, _, s in parts]) + "}")
        for k in inside:
            rows[k][2] = node
        loose.append(len(rows))
        rows.append([path, node, None, text])
        return text, "#" + node
    if isinstance(v, list):
        parts = [_seal(e, f"{path}/{k}", rows, loose, bodies) for k, e in enumerate(v)]
        return "[" + ",".join([t for t, _ in parts]) + "]" if bodies else "", "[" + ",".join([s for _, s in parts]) + "]"
    if isinstance(v, str) and not isinstance(v, _Number):
        text = quote(v)
    else:
        text = {None: "null", True: "true", False: "false"}.get(v, v)
    return text, text


def _is_text(v: object) -> bool:
    return isinstance(v, str) and not isinstance(v, _Number)


def _items(v: object, path: str, text: bool) -> Iterator[tuple[str, int, object]]:
    """(path, ordinal, element): of an array, or of an object (with ``text`` also a non-empty string) in its place."""
    if isinstance(v, list):
        for k, e in enumerate(v):
            if isinstance(e, dict) or text and _is_text(e):
                yield f"{path}/{k}", k, e
    elif isinstance(v, dict) or text and _is_text(v) and v != "":
        yield path, 0, v


def _elements(holder: str, at: int, v: dict) -> Iterator[tuple[str, str, int, int, str, object]]:
    """(kind, path, parent_ord, ord, path of the object around it, element) of the elements that a holder has."""
    if holder == "chat":
        for kind, name in (("tool_call", "toolCalls"), ("thought", "thoughts")):
            for path, k, e in _items(v.get(name), f"/{name}", False):
                yield kind, path, at, k, "", e
    elif holder == "payload":
        for path, k, e in _items(v.get("content"), "/content", True):
            yield "content_block", path, -1, k, "", e
    else:
        for path, k, e in _items(v.get("content"), "/content", True):
            yield "message_block", path, -1, k, "", e
            if isinstance(e, dict) and e.get("type") == "tool_result":
                for inner, j, x in _items(e.get("content"), f"{path}/content", True):
                    yield "result_block", inner, k, j, path, x


def _rows_of(holder: str, at: int, text: str, bodies: bool) -> Iterator[tuple]:
    """(child, root, parent_ord, ord, path, node, parent, body) of a holder, its elements and every object in them."""
    v = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    if not isinstance(v, dict):
        return
    rows: list[list] = []
    _seal(v, "", rows, [], bodies)
    found = list(_elements(holder, at, v))
    places = {path: (kind, parent_ord, k) for kind, path, parent_ord, k, _, e in found if isinstance(e, dict)}
    nodes = {row[0]: row[1] for row in rows}
    for kind, _, parent_ord, k, around, e in found:
        if not isinstance(e, dict):
            yield kind, kind, parent_ord, k, "", _hash(quote(e)), nodes[around], quote(e)
    for path, node, parent, body in rows:
        parts = path.split("/")
        for cut in range(min(len(parts), DEEPEST_ELEMENT), 0, -1):
            base = "/".join(parts[:cut])
            if base in places:
                root, parent_ord, k = places[base]
                below = path[len(base) :]
                yield ("object" if below else root), root, parent_ord, k, below, node, parent, body
                break
        else:
            yield ("object" if path else "record"), "record", -1, at, path, node, parent, body


def _descend(bodies: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["line_id", "child", "root", "parent_ord", "ord", "path", "node", "parent", "body"][: 9 if bodies else 8]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4][: len(names)]
    schema = pa.schema(list(zip(names, kinds)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
        rows: list[tuple] = []
        for b in batches:
            for line, holder, at, text in zip(*[c.to_pylist() for c in b.columns]):
                rows += [(line, *r) for r in _rows_of(holder, at, text, bodies)]
                if len(rows) >= ROWS_PER_BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return run


def descend(held: DataFrame, bodies: bool = False) -> DataFrame:
    """The bridge of ``holders``: ``PLACES``, with ``bodies`` also the canonical text.

    ``child`` is the kind of an element, ``record`` for the object that holds elements, or ``object`` for what lies in
    one of them; ``root``, ``parent_ord`` and ``ord`` name that element (for a record its index), ``path`` (a JSON pointer with
    names and ordinals, empty for the element itself) the place in it.  ``parent`` is the hash of the nearest object
    around, null for records alone.  An object has one hash at whatever depth it occurs.  Missing, null or empty arrays
    and elements of other types than objects (in contents also strings) have no rows; ordinals count all elements.
    """
    return held.mapInArrow(_descend(bodies), PLACES + (", body string" if bodies else ""))


def elements(held: DataFrame) -> DataFrame:
    """(line_id, child, parent_ord, ord, node, parent): the rows of the bridge that are elements."""
    return descend(held).where(F.col("child").isin(*ELEMENTS)).select("line_id", "child", "parent_ord", "ord", "node", "parent")


def stored(objects: DataFrame) -> DataFrame:
    """Each distinct element or object of ``descend`` once: (node, n, body)."""
    return objects.groupBy("node").agg(F.count("*").alias("n"), F.min("body").alias("body"))
