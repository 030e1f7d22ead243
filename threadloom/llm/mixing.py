"""Sources mixed to target shares of all tokens.

The largest mix that no source's cap forbids is taken.  Each source is cut into blocks of
documents; whole passes over a source and the last, partial pass are drawn as disjoint
blocks in a permuted order, the last block document by document up to the quota.  A tree
splits the exact block quotas of all sources among the output shards: each node deals its
blocks to its halves by a multivariate hypergeometric draw, seeded by the node, so every
shard has a fair sample of every source and no shard's content depends on another's.
Within a shard the documents are shuffled by their hash.

Orders within a source are prefix sums over hash ranges: a row per range is chained, the rest is summed
within its range, so no source is in one task.  The driver holds the block counts of the upper nodes of
the tree, at most ``MOST_CELLS`` numbers; finer nodes are split where their blocks are.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The vocabulary of a public tokenizer, as ranks; read by the driver and sent along (under 1 MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 20_000
#: Hash ranges of a source's blocks.
RANGES_BITS = 12
#: Most block counts (nodes of one level times sources) on the driver.
MOST_CELLS = 4_000_000

_ENCODERS: dict[int, object] = {}


def _encoder(ranks: bytes):
    """The tokenizer of a rank file; made once per Python worker."""
    key = zlib.crc32(ranks)
    if key not in _ENCODERS:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[key]


def _count(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"]
            )

    return run


def ranked(df: DataFrame, group: list[str], key: Column, ties: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the group up to this one, in the order of a hash ``key``."""
    rows = df.withColumn("__key", key).withColumn("__range", F.shiftrightunsigned("__key", 64 - RANGES_BITS)).withColumn("__value", value)
    sums = rows.groupBy(*group, "__range").agg(F.sum("__value").alias("__sum"))
    before = sums.select(*group, "__range", (F.sum("__sum").over(Window.partitionBy(*group).orderBy("__range")) - F.col("__sum")).alias("__before"))
    own = Window.partitionBy(*group, "__range").orderBy("__key", *ties).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__before") + F.sum("__value").over(own)
    return rows.join(before, [*group, "__range"]).withColumn(name, upto).drop("__key", "__range", "__value", "__before")


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) with the tokens of the whole text by a public tokenizer; null texts have none."""
    with open(tokenizer, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(
        _count(ranks), "doc_id bigint, source string, n_tokens bigint"
    )


def plan(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, tokens, passes, rest) of the largest mix: whole passes over a source and the tokens of its last pass.

    ``totals``: source, tokens; ``targets``: source, target_share, max_repeats (of several rows of a source the
    first by share and repeats counts).  Sources without tokens, share or repeats cannot take part; the other shares are
    scaled to sum to 1.
    """
    first = targets.where("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    there = totals.join(first.select("source", F.col("t.target_share").alias("share"), F.col("t.max_repeats").alias("cap")), "source")
    there = there.where("tokens > 0 and share > 0 and cap > 0")
    whole = there.withColumn("share", F.col("share") / there.agg(F.sum("share").alias("s")).scalar())
    size = whole.agg(F.min(F.col("cap") * F.col("tokens") / F.col("share")).alias("s"))
    most = F.col("cap") * F.col("tokens")
    quota = F.least(F.col("share") * size.scalar(), most.cast("double"))
    rows = whole.withColumn("quota", quota).withColumn("passes", F.least(F.col("cap").cast("long"), F.floor(F.col("quota") / F.col("tokens") + 1e-9)).cast("int"))
    return rows.select("source", "share", "tokens", "passes", F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens")).alias("rest"))


def split_tree(quotas: list[int], depth: int, seed: int) -> list[np.ndarray]:
    """Blocks of each source that go left at each node of each level; level k has 2**k nodes."""
    levels, counts = [], np.array([quotas], dtype=np.int64)
    for level in range(depth):
        left = np.zeros_like(counts)
        for node, own in enumerate(counts):
            n = int(own.sum())
            rng = np.random.default_rng([seed, level, node])
            half = n // 2 + (n % 2) * int(rng.integers(2))
            left[node] = rng.multivariate_hypergeometric(own, half, method="marginals") if n else 0
        levels.append(left)
        counts = np.stack([left, counts - left], axis=1).reshape(-1, len(quotas))
    return levels


def shard_of(levels: list[np.ndarray], source: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The leaf of the ``index``-th block of a source in its permuted order."""
    node, at = np.zeros(len(index), dtype=np.int64), index.astype(np.int64)
    for left in levels:
        n = left[node, source]
        right = at >= n
        at = np.where(right, at - n, at)
        node = node * 2 + right
    return node


def _finer(depth: int, seed: int):
    """The lower levels of the tree for the blocks of one upper node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = [zlib.crc32(f"{seed} {b} {t}".encode()) for b, t in zip(pdf["block"], pdf["turn"])]
        pdf = pdf.assign(rank=rank).sort_values(["source", "rank", "block", "turn"], kind="stable")
        number = pdf["source"].astype("category").cat.codes.to_numpy().astype(np.int64)
        node = int(pdf["shard"].iloc[0])
        levels = split_tree(np.bincount(number).tolist(), depth, seed + 1 + node)
        shard = shard_of(levels, number, pdf.groupby("source").cumcount().to_numpy())
        return pdf.assign(shard=node * 2**depth + shard)[["source", "block", "turn", "shard"]]

    return run


def _place(levels: list[np.ndarray], numbers: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([numbers[s] for s in batch.column("source").to_pylist()], dtype=np.int64)
            shard = shard_of(levels, number, batch.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("source"), batch.column("block"), batch.column("turn"), pa.array(shard)],
                ["source", "block", "turn", "shard"],
            )

    return run


def mix(
    docs: DataFrame,
    targets: DataFrame,
    shard_tokens: int = 1_000_000,
    seed: int = 7,
    tokenizer: str = TOKENIZER,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(shard, pos, source, doc_id, turn, n_tokens): the chosen documents, one row per repeat.

    ``docs``: doc_id, source, text; ``targets``: source, target_share, max_repeats.  ``turn`` counts
    a document's repeats from 0.  Documents without tokens or with a source that has no target
    are not part of the mix; repeated documents are documents of their own.  The actual share
    of a source misses its target by half a document at most.
    """
    from threadloom.shared import materialise

    counted = count_tokens(docs.join(targets.select("source").distinct(), "source", "left_semi"), tokenizer)
    counted = materialise(counted, "tokens").where("n_tokens > 0")
    plans = materialise(plan(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), targets), "plan")
    facts = plans.select(
        "source", "passes", "rest", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("bigint").alias("blocks")
    )
    placed = counted.join(facts, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    blocks = materialise(placed.groupBy("source", "passes", "rest", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    # the last pass takes whole blocks in a permuted order while they fit
    last = ranked(blocks, ["source"], F.xxhash64(F.lit(seed + 1), "block"), ["block"], F.col("tokens"), "upto")
    full = last.where("upto <= rest").select("source", "block", F.col("passes").alias("turn"), F.lit(None).cast("double").alias("room"))
    edge = last.where("upto > rest and upto - tokens < rest").select(
        "source", "block", F.col("passes").alias("turn"), (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("room")
    )
    passes = blocks.where("passes > 0").select(
        "source", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("turn"), F.lit(None).cast("double").alias("room")
    )
    units = passes.unionByName(full).unionByName(edge)
    units = ranked(units, ["source"], F.xxhash64(F.lit(seed + 2), "block", "turn"), ["block", "turn"], F.lit(1), "place")
    units = materialise(units.withColumn("place", F.col("place") - 1), "units")
    size = plans.agg(F.coalesce(F.sum(F.col("passes") * F.col("tokens") + F.col("rest")), F.lit(0.0))).first()[0]
    depth = max(0, int(np.ceil(np.log2(max(1.0, size / shard_tokens)))))
    drawn = {r.source: r.n for r in units.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(MOST_CELLS).collect()}
    # levels that the driver can hold; what is below is split node by node
    upper = min(depth, max(0, int(np.log2(MOST_CELLS / max(1, len(drawn))))))
    levels = split_tree(list(drawn.values()), upper, seed)
    numbers = {s: k for k, s in enumerate(drawn)}
    shards = units.select("source", "block", "turn", "place").mapInArrow(_place(levels, numbers), "source string, block bigint, turn int, shard bigint")
    if depth > upper:
        shards = shards.groupBy("shard").applyInPandas(_finer(depth - upper, seed), "source string, block bigint, turn int, shard bigint")
    shards = shards.join(units.select("source", "block", "turn", "room"), ["source", "block", "turn"])
    own = placed.select("source", "block", "doc_id", "n_tokens").join(shards, ["source", "block"])
    within = Window.partitionBy("source", "block", "turn").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id")
    # only the edge block of a source is cut, document by document
    cut = own.where("room is not null").withColumn("upto", F.sum("n_tokens").over(within)).where("upto - n_tokens / 2 <= room").drop("upto")
    chosen = own.where("room is null").unionByName(cut)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 4), "doc_id", "turn"), "doc_id", "turn")
    return chosen.select("shard", F.row_number().over(shuffled).alias("pos"), "source", "doc_id", "turn", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats) of a mix; sources that are missing have zeros."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.sum("n_tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_repeats")
    )
    return targets.select("source", "target_share").join(got, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1))).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")
    )
