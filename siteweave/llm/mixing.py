"""Operator 4: mix sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources a document belongs
to). Word capacity flows from patterns to source quotas; the k-th repetition of a
pattern costs k, so fresh words are used before second and third copies. What flows
through a pattern fixes how often each of its documents is taken: a whole number of
times for all, once more for documents that a seeded hash puts first. Only the sums by
pattern and by (pattern, hash bucket) leave the tasks.

Cases: a null source is a source of its own, last in order; null and empty texts have
size 0 and are never taken; ties in the hash go to the smaller doc_id; repeated rows are
repeated documents; an empty table gives no rows; other columns are kept out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.llm.shared import few, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKETS = 4096  # at most, for each pattern
BUCKET_ROWS = 256
SEED = 17
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Share the sum of ``sizes`` by weight; nothing above ``cap`` times its size.

    The excess of capped sources is shared again by weight until none is above.
    """
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = MAX_REPEATS) -> list[dict[int, int]]:
    """Route words of each pattern to the quotas of its sources at least total cost.

    ``patterns`` holds (sources, capacity). Arc k of a pattern carries its capacity once
    more at cost k. Successive shortest paths; returns words by source for each pattern.
    """
    n, m = len(patterns), len(quotas)
    start, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    arcs: list[list[int]] = []  # head, room, cost; the reverse arc is at the index xor 1

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            graph[x].append(len(arcs))
            arcs.append([y, r, c])

    for p, (members, capacity) in enumerate(patterns):
        for k in range(repeats):
            arc(start, p, capacity, k)
        for s in members:
            arc(p, n + s, capacity * repeats, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, sink, quota, 0)
    potential = [0] * len(graph)
    while True:
        far = [None] * len(graph)
        via = [-1] * len(graph)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for a in graph[x]:
                y, room, cost = arcs[a]
                if room > 0 and (far[y] is None or d + cost + potential[x] - potential[y] < far[y]):
                    far[y], via[y] = d + cost + potential[x] - potential[y], a
                    heapq.heappush(heap, (far[y], y))
        if far[sink] is None:
            break
        potential = [h + (d if d is not None else 0) for h, d in zip(potential, far, strict=True)]
        path, x = [], sink
        while x != start:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        amount = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= amount
            arcs[a ^ 1][1] += amount
    return [{arcs[a][0] - n: arcs[a ^ 1][1] for a in graph[p] if n <= arcs[a][0] < start and arcs[a ^ 1][1] > 0} for p in range(n)]


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table; broadcast only while its known row count is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def pattern_key() -> Column:
    return F.to_json(F.struct("sources"))


def law_of(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """``key, source_size, target, rounds, n_buckets, edge, room``: what the mix takes of each pattern of ``sized``.

    Each document goes ``rounds`` times; once more those in buckets before the one that
    holds the last wanted word, ``edge`` (none: all), and in that one those that fit ``room``.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("sources", pattern_key().alias("key")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    named = sorted({s for r in sums for s in r.sources if s is not None}, key=lambda s: s.encode("utf-8", "surrogatepass"))
    names: list[str | None] = named + ([None] if any(None in r.sources for r in sums) else [])
    place = {s: i for i, s in enumerate(names)}
    patterns = [(tuple(sorted({place[s] for s in r.sources})), r["size"]) for r in sums]
    sizes = [sum(c for members, c in patterns if i in members) for i in range(len(names))]
    shared = sum(sizes) / total if (total := sum(c for _, c in patterns)) else 1.0
    wanted = targets([x / shared for x in sizes] if shared != 1 else sizes, [weights[i % len(weights)] for i in range(len(names))], repeats)
    routed = min_cost_flow(patterns, [round(x) for x in wanted], repeats)

    plan = []
    for r, (members, capacity), flows in zip(sums, patterns, routed, strict=True):
        flow, lead = sum(flows.values()), members[0]
        rounds = min(repeats, flow // capacity) if capacity else 0
        rest = flow - rounds * capacity if rounds < repeats else 0
        plan.append((r.key, sizes[lead], float(wanted[lead]), rounds, rest, max(1, min(BUCKETS, r.n // BUCKET_ROWS))))
    schema = "key string, source_size long, target double, rounds long, rest long, n_buckets long"

    buckets = in_buckets(sized, small(spark, plan, schema), seed).groupBy("key", "bucket", "rest").agg(F.sum("size").alias("bucket_size"))
    upto = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    buckets = buckets.withColumn("upto", F.sum("bucket_size").over(upto))
    first = buckets.where(F.col("upto") > F.col("rest")).groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("bucket_size")).alias("room")), "bucket").alias("edge"))
    edges = {r.key: (r.edge.bucket, r.edge.room) for r in first.collect()}  # a row a pattern
    rows = [(key, size, target, rounds, n, *edges.get(key, (None, None))) for key, size, target, rounds, _, n in plan]
    return small(spark, rows, "key string, source_size long, target double, rounds long, n_buckets long, edge long, room long")


def in_buckets(rows: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """``rows(doc_id, sources)`` with the columns of their pattern in ``table``, and their hash and bucket."""
    rows = rows.withColumn("key", pattern_key()).join(table, "key")
    return rows.withColumn("hash", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("hash", "n_buckets"))


def under(rows: DataFrame, law: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``rows(doc_id, sources)`` with ``more``, 1 if taken once more and 0 if not, and apart those in edge buckets, where the room decides."""
    rows = in_buckets(rows, law, seed).drop("key", "n_buckets")
    at_edge = F.col("bucket") == F.col("edge")
    sure = rows.where(~at_edge | F.col("edge").isNull()).withColumn("more", (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))).cast("long"))
    return sure, rows.where(at_edge)


def times(repeats: int = MAX_REPEATS) -> Column:
    return F.least(F.col("rounds") + F.col("more"), F.lit(repeats))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """``sized(doc_id, size, sources array<string>)`` with what the mix takes.

    Adds ``source_size`` and ``target`` (of the first source) and ``taken``. Sources in
    code-point order get the weights in turn, null last. A document may belong to many
    sources; its words count in the size of each. Other columns of ``sized`` are kept.
    """
    extra = [c for c in sized.columns if c not in ("doc_id", "size", "sources")]
    sure, edge = under(sized, law_of(sized, weights, repeats, seed), seed)
    fitted = edge.groupBy("sources").applyInPandas(_fit, sure.schema)
    taken = (F.col("size") * times(repeats)).alias("taken")
    return sure.unionByName(fitted).select("doc_id", "size", "source_size", "target", "sources", taken, *extra)


def _fit(rows):
    """Take documents in hash order while they fit the room; one bucket of one pattern."""
    rows = rows.sort_values(["hash", "doc_id", "size"], ignore_index=True)
    room, more = int(rows["room"].iloc[0]) if len(rows) else 0, []
    for size in rows["size"]:
        more.append(int(size <= room))
        room -= size * more[-1]
    return rows.assign(more=more)


def sized_columns() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), F.array(F.col("source").cast("string")).alias("sources")]


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(*sized_columns())


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it (stage of the pipeline).

    The law of its source and its doc_id decide on a row, so texts stay where they are. Only
    the rows of edge buckets meet what the mix has found for them. Those are told apart by
    doc_id, text and source, so different texts that share a doc_id, or have none, are taken
    each by itself; rows that repeat are taken as often as all of them together.
    """
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", "source", F.col("source").isNull()).alias("row")
    sized = stored(docs.select(*sized_columns(), key), "mix-sizes")
    law = law_of(sized, seed=seed)
    sure, edge = under(sized, law, seed)
    fitted = edge.where("size > 0").groupBy("sources").applyInPandas(_fit, sure.schema)
    fitted = few(stored(fitted.groupBy("row").agg(F.sum(times()).alias("times")), "mix-edge"))

    doc_id, _, sources = sized_columns()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), doc_id, sources, key).where(F.col("doc.text").rlike(WORD))
    sure, edge = under(rows, law, seed)
    taken = sure.select("doc", times().alias("times")).union(edge.dropDuplicates(["row"]).join(fitted, "row").select("doc", "times"))
    return taken.where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(stored(sized_documents(docs), "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")
