"""Schemas that drift between versions: one consistent table and a report of each change.

Every record is reduced to its schema text (names, types, nesting) and equal texts are merged
before anything is shuffled, so what moves is the set of distinct schemas per version, not
records.  For each two successive versions the fields that vanished and those that are new
form the nodes of a pairwise graph together with their types, child names and parents; match
scores start from name similarity and flow along its edges until they settle (similarity
flooding), and consistent one-to-one correspondences are selected from the settled scores.
Renames are the correspondences whose settled score is high enough.  Under the stated rule of the
report (``single_pairs``) a rename is the one vanished/new pair of one type in a step, whatever its score:
there the rule is an exact check behind the matching.  Records are then renamed to the last names, as the
settled scores have them, cast and unioned.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = {
    "STRING": "string",
    "BOOLEAN": "boolean",
    "OBJECT": "object",
    "ARRAY": "array",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "FLOAT": "number",
}
CHANGES = "src string, record string, field string, new_field string, change string, version string"


def version_text(value: Column) -> Column:
    """Bare version numbers of a version in whatever form (prefix, suffix, object); null without one."""
    found = F.regexp_extract(value, r"(\d+(?:\.\d+)+)", 1)
    return F.when(found != "", found)


def version_key(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in version.split("."))


def parse_schema(text: str) -> dict[str, tuple[str, list[str], str]]:
    """Fields of a schema text ``OBJECT<name: TYPE, ...>`` as {name: (type, child names, type as written)}; nulls are left out."""
    end = len(text)

    def word(at: int) -> tuple[str, int]:
        stop = at
        while stop < end and text[stop] not in "<>,:(":
            stop += 1
        return text[at:stop].strip(), stop

    def kind(at: int) -> tuple[str, dict, int]:
        name, at = word(at)
        fields: dict = {}
        if at < end and text[at] == "(":  # precision
            stop = text.index(")", at) + 1
            name, at = name + text[at:stop], stop
        if at < end and text[at] == "<":
            at += 1
            if name == "OBJECT":
                while text[at] != ">":
                    while text[at] in ", ":
                        at += 1
                    if text[at] == "`":
                        key, at = "", at + 1
                        while text[at] != "`" or text[at : at + 2] == "``":
                            step = 2 if text[at] == "`" else 1
                            key, at = key + text[at], at + step
                        at += 1
                    else:
                        key, at = word(at)
                    inner, sub, at = kind(
                        text.index(":", at) + 1 + (text[text.index(":", at) + 1 : text.index(":", at) + 2] == " ")
                    )
                    fields[key] = (inner, sub)
            else:
                inner, sub, at = kind(at)
                fields = sub if inner == "OBJECT" else {}
            at = text.index(">", at) + 1
        return name, fields, at

    _, fields, _ = kind(0)
    plain = {k: t.partition("(")[0] for k, (t, _) in fields.items()}
    return {k: (KIND[plain[k]], sorted(sub), t) for k, (t, sub) in fields.items() if plain[k] in KIND}


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for src, record, version, text in zip(pdf["src"], pdf["record"], pdf["version"], pdf["schema"]):
            rows.append((src, record, version, None, None, None, None))
            rows += [(src, record, version, name, kind, ",".join(children), written) for name, (kind, children, written) in parse_schema(text).items()]
        yield pd.DataFrame(rows, columns=["src", "record", "version", "field", "kind", "children", "written"])


def flood(
    old: dict[str, tuple[frozenset, frozenset]],
    new: dict[str, tuple[frozenset, frozenset]],
    kept: set[str],
    rounds: int = 50,
    eps: float = 1e-4,
) -> dict[tuple[str, str], float]:
    """Settled match scores of (vanished, new) fields, relative to those of fields that both versions have.

    A pair node is linked with the pair of its types, with the pairs of its child names and with
    the pair of the two records that hold it; so are the pairs of fields that both versions keep,
    whose scores feed the record pair.
    """
    pairs = [(a, b) for a in old for b in new] + [(k, k) for k in kept]
    base = {p: SequenceMatcher(None, p[0].lower(), p[1].lower()).ratio() for p in pairs}
    edges: dict[tuple, list[tuple]] = defaultdict(list)
    seed: dict[tuple, float] = {("record",): 1.0} | {("field", *p): base[p] for p in pairs}
    for a, b in pairs:
        node = ("field", a, b)
        edges[node].append(("record",))
        edges[("record",)].append(node)
        if a in old and b in new:
            kinds = [(x, y) for x in old[a][0] for y in new[b][0]]
            inner = [(x, y) for x in old[a][1] for y in new[b][1] if x == y]
            for tag, links in (("kind", kinds), ("child", inner)):
                for x, y in links:
                    other = (tag, x, y)
                    seed[other] = 1.0 if x == y else 0.0
                    edges[node].append(other)
                    edges[other].append(node)
    score = dict(seed)
    for _ in range(rounds):
        fresh = {n: seed[n] + sum(score[m] / len(edges[m]) for m in edges[n]) for n in seed}
        top = max(fresh.values()) or 1.0
        fresh = {n: v / top for n, v in fresh.items()}
        moved = max(abs(fresh[n] - score[n]) for n in seed)
        score = fresh
        if moved < eps:
            break
    # what fields that both versions have reach in this graph is the measure
    scale = sum(score["field", k, k] for k in kept) / len(kept) if kept else max(score.values())
    return {(a, b): score["field", a, b] / (scale or 1.0) for a in old for b in new}


#: Least settled score of a rename; fields that both versions have reach 1 on the average.
LEAST_SCORE = 0.68


def correspondences(old: dict, new: dict, kept: set[str]) -> list[tuple[str, str, float]]:
    """One-to-one pairs of equal type, best settled score first."""
    scores = flood(old, new, kept)
    taken_a, taken_b, out = set(), set(), []
    for (a, b), s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if a not in taken_a and b not in taken_b and old[a][0] == new[b][0]:
            taken_a.add(a)
            taken_b.add(b)
            out.append((a, b, s))
    return out


def diff_versions(
    seen: dict[str, dict[str, tuple[frozenset, frozenset]] | None], versions: list[str], single_pairs: bool = True
) -> list[tuple[str, str, str, str]]:
    """(field, new_field, change, version) of one record type; ``seen``: fields by version, missing where the type is absent.

    With ``single_pairs`` a step's only pair of one type is a rename and steps with several have none; without,
    every correspondence of at least ``LEAST_SCORE`` is.
    """
    out = []
    for before, after in pairwise(versions):
        a, b = seen.get(before), seen.get(after)
        if a is None or b is None:
            if a is not b:
                out.append(("*", "", "added" if a is None else "removed", after))
            continue
        gone, new, both = {k: a[k] for k in a.keys() - b.keys()}, {k: b[k] for k in b.keys() - a.keys()}, a.keys() & b.keys()
        matched = correspondences(gone, new, set(both)) if gone and new else []
        if single_pairs:
            single = sum(x[0] == y[0] for x in gone.values() for y in new.values()) == 1
            renamed = [(x, y) for x, y, _ in matched] if single else []
        else:
            renamed = [(x, y) for x, y, score in matched if score >= LEAST_SCORE]
        out += [(x, y, "renamed", after) for x, y in renamed]
        out += [(k, "", "removed", after) for k in sorted(gone.keys() - {x for x, _ in renamed})]
        out += [(k, "", "added", after) for k in sorted(new.keys() - {y for _, y in renamed})]
        out += [(k, "", "retyped", after) for k in sorted(both) if a[k][0] != b[k][0]]
    return out


def field_table(schemas: DataFrame) -> DataFrame:
    """(src, record, version, field, kind, children, written), distinct, of (src, record, version, schema)."""
    small = schemas.where("version is not null and schema is not null").distinct()
    return small.mapInPandas(
        _fields, "src string, record string, version string, field string, kind string, children string, written string"
    ).distinct()


def _drift_of_source(ignore: tuple[str, ...], single_pairs: bool):
    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        versions = sorted(pdf["version"].unique(), key=version_key)
        out = []
        for record, part in pdf.groupby("record"):
            seen: dict = {}
            for version, own in part.groupby("version"):
                fields: dict = defaultdict(lambda: (set(), set()))
                for name, kind, children in zip(own["field"], own["kind"], own["children"]):
                    if name is not None and name not in ignore:
                        fields[name][0].add(kind)
                        fields[name][1].update(filter(None, (children or "").split(",")))
                seen[version] = {k: (frozenset(a), frozenset(b)) for k, (a, b) in fields.items()}
            out += [(pdf["src"].iloc[0], record, *x) for x in diff_versions(seen, versions, single_pairs)]
        return pd.DataFrame(out, columns=["src", "record", "field", "new_field", "change", "version"])

    return report


def drift_report(schemas: DataFrame, ignore: tuple[str, ...] = (), single_pairs: bool = True) -> DataFrame:
    """Every change between successive versions of each source.

    ``schemas``: (src, record, version, schema) with schema texts of records; rows with a null
    version, record or schema are ignored, repeated rows count once, an empty table gives no rows.
    Versions are ordered by their numbers.  A group holds a source's distinct fields per version,
    never its records.
    """
    fields = field_table(schemas.where("record is not null"))
    return fields.groupBy("src").applyInPandas(_drift_of_source(ignore, single_pairs), CHANGES)


def canonical_names(
    fields: list[tuple[str, str, str, str]], renames: list[tuple[str, str, str, str, str]]
) -> dict[tuple[str, str, str, str], str]:
    """(src, record, version, field) -> the name used last, for fields renamed later on.

    ``fields``: (src, record, version, field); ``renames``: (src, record, field, new_field, version).
    """
    out = {}
    ordered = sorted(renames, key=lambda r: version_key(r[4]))
    for src, record, version, field in fields:
        name = field
        for s, r, old, new, since in ordered:
            if (s, r, old) == (src, record, name) and version_key(since) > version_key(version):
                name = new
        if name != field:
            out[src, record, version, field] = name
    return out


#: Most fields that become columns; the rarer ones stay together in a map.
MOST_COLUMNS = 2_000


def number_type(written: set[str]) -> str:
    """A type that holds all numbers of a field without rounding; decimal text beyond 38 digits, double only for doubles."""
    whole, parts = 0, 0
    for t in written:
        m = re.match(r"DECIMAL\((\d+),\s*(\d+)\)", t)
        if m:
            whole, parts = max(whole, int(m.group(1)) - int(m.group(2))), max(parts, int(m.group(2)))
        elif t == "BIGINT":
            whole = max(whole, 19)
        elif KIND.get(t.partition("(")[0]) == "number":
            return "double"
    if parts == 0 and whole <= 19 and written <= {"BIGINT"}:
        return "bigint"
    return f"decimal(38,{parts})" if whole + parts <= 38 else "string"


def unify(records: DataFrame, schemas: DataFrame, ignore: tuple[str, ...] = (), most_columns: int = MOST_COLUMNS) -> DataFrame:
    """All records as one table with the last names and types.

    ``records``: (src, record, row_id, version, fields) with ``fields`` a map of name to variant;
    ``schemas`` as in ``drift_report``.  One column ``f_<name>`` per field: whole numbers as bigint, others
    as decimal (double where a record has doubles), booleans and strings as such, objects and arrays as JSON
    text; a name whose last types differ between sources or record types is a string.  Nothing is lost:
    values that the last type cannot hold are in ``uncast`` as text, by name; fields beyond the ``most_columns``
    commonest ones are in ``more``.  Fields that a record lacks are null; records without a version keep
    their own names.  The driver gets the names of the columns, the renames and the versions, never rows.
    """
    known = field_table(schemas).where("field is not null")
    renames = [tuple(r) for r in drift_report(schemas, ignore, single_pairs=False).where("change = 'renamed'").select("src", "record", "field", "new_field", "version").collect()]
    fields = F.col("fields")
    named = known.withColumn("name", F.col("field"))
    if renames:
        versions = known.select("src", "version").distinct().where(F.col("src").isin(sorted({r[0] for r in renames}))).collect()
        held = sorted({(s, r, v.version, old) for s, r, old, _, _ in renames for v in versions if v.src == s})
        names = canonical_names(held, renames)
        lookup = F.create_map(*[F.lit(x) for k, v in sorted(names.items()) for x in ("\u0001".join(k), v)])
        key = lambda k: F.concat_ws("\u0001", "src", "record", "version", k)
        fields = F.transform_keys("fields", lambda k, _: F.coalesce(F.try_element_at(lookup, key(k)), k))
        named = known.withColumn("name", F.coalesce(F.try_element_at(lookup, key(F.col("field"))), F.col("field")))
    order = F.struct(F.split("version", r"\.").cast("array<bigint>"), "kind")
    last = named.groupBy("src", "record", "name").agg(F.max_by("kind", order).alias("kind"), F.collect_set("written").alias("written"))
    columns = last.groupBy("name").agg(
        F.collect_set("kind").alias("kinds"), F.array_distinct(F.flatten(F.collect_list("written"))).alias("written"), F.count("*").alias("n")
    ).orderBy(F.desc("n"), "name").limit(most_columns).collect()
    typed, kept = [], []
    for c in sorted(columns, key=lambda c: c.name):
        value = F.try_element_at(F.col("fields"), F.lit(c.name))
        kind = c.kinds[0] if len(c.kinds) == 1 else "string"
        target = number_type({w for w in c.written if KIND[w.partition("(")[0]] == "number"}) if kind == "number" else "boolean" if kind == "boolean" else "string"
        typed.append(F.try_variant_get(value, "$", target).alias(f"f_{c.name}"))
        if target != "string":
            text = F.try_variant_get(value, "$", "string")
            # a cast that changes the value is none
            same = F.try_variant_get(value, "$", target).isNotNull()
            if target == "bigint":
                same &= F.coalesce(~text.contains("."), F.lit(False))
            kept.append(F.struct(F.lit(c.name).alias("name"), F.when(~same, text).alias("text")))
    named_columns = {c.name for c in columns}
    table = records.withColumn("fields", fields)
    present = lambda entries: F.map_from_entries(F.filter(entries, lambda e: e["text"].isNotNull()))
    uncast = present(F.array(*kept)) if kept else F.lit(None).cast("map<string,string>")
    more = F.map_filter(
        F.transform_values("fields", lambda _, v: F.try_variant_get(v, "$", "string")), lambda k, v: v.isNotNull() & ~k.isin(*sorted(named_columns) or [""])
    )
    return table.select("src", "record", "row_id", "version", *typed, uncast.alias("uncast"), more.alias("more"))
