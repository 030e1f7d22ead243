"""Full-text index over character trigrams, kept beside the messages.

A run of postings has a row for each trigram of each message with its places, sorted by trigram within buckets of
trigrams, so a term reads the rows of its own trigrams in their buckets.  A term stands in a message where
its trigrams follow each other: matches, frequencies and document frequencies come from the places alone, no text is
read.  Runs are immutable; new messages make a run, removed ones a list of ids, and many runs are merged.  The
manifest keeps the number of messages and of their trigrams, so the statistics of the corpus cost nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.shared import drop_path, materialise, names_in, new_path, read_text, write_text

GRAM = 3
BUCKETS = 32
POSTINGS = "gram string, id bigint, size bigint, places array<int>"
_ROWS = 20_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: list[str] = []
    ids: list[int] = []
    sizes: list[int] = []
    places: list[list[int]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(grams, pa.string()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["gram", "id", "size", "places"])

    for b in batches:
        for ident, text, size in zip(*[c.to_pylist() for c in b.columns]):
            folded, own = (text or "").lower(), {}
            for k in range(len(folded) - GRAM + 1):
                own.setdefault(folded[k : k + GRAM], []).append(k)
            grams += own.keys()
            places += own.values()
            ids += [ident] * len(own)
            sizes += [size] * len(own)
            if len(grams) >= _ROWS:
                yield batch()
                grams, ids, sizes, places = [], [], [], []
    if grams:
        yield batch()


class TextIndex:
    """The index in the folder ``path``; opening a folder that has one goes on with it."""

    def __init__(self, spark: SparkSession, path: str | None = None, merge_every: int = 8):
        self.spark, self.merge_every = spark, merge_every
        self.path = (path or new_path(spark, "text-index")).rstrip("/")
        versions = [int(n[9:-5]) for n in names_in(spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        self.version = max(versions, default=0)
        held = json.loads(read_text(spark, self._manifest(self.version))) if self.version else {"runs": [], "gone": [], "n": 0, "total": 0}
        self.runs, self.gone, self.n, self.total = held["runs"], held["gone"], held["n"], held["total"]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version:08d}.json"

    def _commit(self, runs: list[str], gone: list[list], n: int, total: int) -> None:
        text = json.dumps({"runs": runs, "gone": gone, "n": n, "total": total})
        write_text(self.spark, self._manifest(self.version + 1), text)
        kept = runs + [g for g, _ in gone]
        for old in [x for x in self.runs + [g for g, _ in self.gone] if x not in kept]:
            drop_path(self.spark, f"{self.path}/{old}")
        self.version, self.runs, self.gone, self.n, self.total = self.version + 1, runs, gone, n, total
        drop_path(self.spark, self._manifest(self.version - 2))

    @property
    def average(self) -> float:
        """Trigrams of a message on the average, those without text included."""
        return max(self.total / self.n, 1e-9) if self.n else 1e-9

    def _write(self, postings: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
        # a trigram that most messages have is spread over several files of its bucket
        rows = postings.withColumn("bucket", bucket).repartition("bucket", F.pmod("id", F.lit(8)))
        rows.sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def add(self, messages: DataFrame) -> None:
        """Index messages (id, content) that are not in the index yet; null and short contents only count."""
        size = F.greatest(F.length(F.coalesce("content", F.lit(""))) - (GRAM - 1), F.lit(0)).cast("bigint")
        rows = messages.select(F.col("id").cast("bigint"), "content", size.alias("size"))
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not n:
            return
        run = self._write(rows.mapInArrow(_postings, POSTINGS))
        lengths = f"sizes-{uuid.uuid4().hex}"
        rows.select("id", "size").write.parquet(f"{self.path}/{lengths}")
        self._commit([*self.runs, run, lengths], self.gone, self.n + n, self.total + total)
        if len(self.runs) >= 2 * self.merge_every:
            self.merge()

    def remove(self, ids: DataFrame) -> None:
        """Take messages (id) out; ids that aren't there change nothing, and may be added anew with another text."""
        if not self.runs:
            return
        name = f"gone-{uuid.uuid4().hex}"
        there = self._sizes().join(ids.select(F.col("id").cast("bigint")).distinct(), "id", "left_semi")
        there.write.parquet(f"{self.path}/{name}")
        n, total = self.spark.read.schema("id bigint, size bigint").parquet(f"{self.path}/{name}").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n:
            self._commit(self.runs, [*self.gone, [name, len(self.runs)]], self.n - n, self.total - total)
        else:
            drop_path(self.spark, f"{self.path}/{name}")

    def merge(self) -> None:
        """All runs as one, without what was removed."""
        run, sizes = self._write(self._read()), f"sizes-{uuid.uuid4().hex}"
        self._sizes().write.parquet(f"{self.path}/{sizes}")
        self._commit([run, sizes], [], self.n, self.total)

    def _alive(self, rows: DataFrame, place: int) -> DataFrame:
        """Rows of the run at a place, without what was removed after it was made."""
        gone = [f"{self.path}/{g}" for g, upto in self.gone if upto > place]
        if not gone:
            return rows
        return rows.join(self.spark.read.schema("id bigint, size bigint").parquet(*gone).select("id"), "id", "left_anti")

    def _parts(self, kind: str, schema: str) -> list[tuple[DataFrame, int]]:
        return [(self.spark.read.schema(schema).parquet(f"{self.path}/{r}"), k) for k, r in enumerate(self.runs) if r.startswith(kind)]

    def _sizes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._alive(rows, k) for rows, k in self._parts("sizes-", "id bigint, size bigint")])

    def ids(self) -> DataFrame:
        """The messages that are in the index: (id)."""
        return self._sizes().select("id") if self.runs else self.spark.createDataFrame([], "id bigint")

    def _read(self, grams: list[str] | None = None) -> DataFrame:
        parts = self._parts("run-", POSTINGS + ", bucket int")
        if grams is not None:
            own = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct().collect()
            held = F.col("bucket").isin([r[0] for r in own]) & F.col("gram").isin(grams)
            parts = [(rows.where(held), k) for rows, k in parts]
        return reduce(DataFrame.unionByName, [self._alive(rows.drop("bucket"), k) for rows, k in parts])

    def hits(self, terms: list[str]) -> DataFrame:
        """(id, size, f0, f1, ...): messages that hold any of the terms, and how often (places may overlap).

        Terms have three characters or more and match without regard to case.
        """
        folded = [t.lower() for t in terms]
        wanted = [(g, k, at) for k, t in enumerate(folded) for at in range(len(t) - GRAM + 1) for g in [t[at : at + GRAM]]]
        if any(len(t) < GRAM for t in folded):
            raise ValueError("a term of the index has three characters or more")
        fields = "id bigint, size bigint" + "".join(f", f{k} bigint" for k in range(len(terms)))
        if not self.runs or not wanted:
            return self.spark.createDataFrame([], fields)
        by_gram: dict[str, list[tuple[int, int]]] = {}
        for g, k, at in wanted:
            by_gram.setdefault(g, []).append((k, at))
        uses = F.create_map(*[x for g, u in sorted(by_gram.items()) for x in (F.lit(g), F.array(*[F.struct(F.lit(k).alias("term"), F.lit(at).alias("at")) for k, at in u]))])
        rows = self._read(sorted(by_gram)).select("id", "size", "places", F.explode(F.element_at(uses, F.col("gram"))).alias("u"))
        rows = rows.select("id", "size", "u.term", F.transform("places", lambda p: p - F.col("u.at")).alias("starts"))
        per = rows.groupBy("id", "size", "term").agg(F.collect_list("starts").alias("starts"))
        need = F.element_at(F.array(*[F.lit(len(t) - GRAM + 1) for t in folded]), F.col("term") + 1)
        per = per.where(F.size("starts") == need)  # a term's trigrams are few
        shared = F.aggregate(F.slice("starts", 2, F.size("starts")), F.col("starts")[0], lambda a, b: F.array_intersect(a, b))
        per = per.select("id", "size", "term", F.size(shared).cast("bigint").alias("f")).where("f > 0")
        return per.groupBy("id", "size").agg(*[F.coalesce(F.max(F.when(F.col("term") == k, F.col("f"))), F.lit(0)).alias(f"f{k}") for k in range(len(terms))])


def scored(index: TextIndex, terms: list[str], every: bool) -> DataFrame:
    """(id, bm25) of the messages that hold every (or any) term; statistics are those of the whole corpus."""
    from threadloom.functions import expr

    hits = materialise(index.hits(terms), "hits")
    have = hits.agg(F.struct(*[F.coalesce(F.sum((F.col(f"f{k}") > 0).cast("bigint")), F.lit(0)).alias(f"df{k}") for k in range(len(terms))]))
    rows = hits.withColumn("df", have.scalar())
    found = [F.col(f"f{k}") > 0 for k in range(len(terms))]
    rows = rows.where(expr.all_of(found) if every else expr.any_of(found))
    score = expr.bm25_of([F.col(f"f{k}").cast("double") for k in range(len(terms))], F.col("size"), F.lit(index.n), F.lit(index.average), [F.col(f"df.df{k}") for k in range(len(terms))])
    return rows.select("id", score.alias("bm25"))
