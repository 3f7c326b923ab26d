"""Mixing sources to target weights by min-cost flow.

Documents belong to one or more sources. They are aggregated by membership pattern; a
flow network carries words from patterns (each further repetition of a document costs
more: convex costs) through their sources to the sources' targets. A pattern's flow
becomes whole passes over its documents plus one seeded prefix: documents in the order
of a hash, up to the point nearest to the rest of the flow. The prefix sums have two
levels (hash bins, then rows inside a bin; about as many bins as rows in a bin), so no
source's rows meet in one task.

Only the pattern table reaches the driver: one row per combination of sources.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source,
last in order; repeated rows count each for itself; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendra.llm.common import CREATED, GAP, finish, remove, save, scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
SEED = 42


def targets(sizes: list[float], weights: list[float], total: float, repeats: float = REPEATS) -> list[float]:
    """total shared by weight, none above ``repeats`` times its size; what is over is shared again among the others."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if weights[i] > 0]
    left = min(total, repeats * sum(sizes[i] for i in open_))
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] >= repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, float, float]], s: int, t: int, eps: float = 1e-9) -> list[float]:
    """Flow of each arc (from, to, capacity, cost) of the cheapest maximal flow, by successive shortest paths."""
    to, cap, cost, adj = [], [], [], defaultdict(list)
    for a, b, c, w in arcs:
        for x, y, k, v in ((a, b, c, w), (b, a, 0.0, -w)):
            adj[x].append(len(to))
            to.append(y)
            cap.append(float(k))
            cost.append(v)
    scale = max([c for _, _, c, _ in arcs if math.isfinite(c)], default=1.0) * eps
    while True:
        dist, via, queued, queue = {s: 0.0}, {}, {s}, deque([s])
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in adj[x]:
                if cap[e] > scale and dist[x] + cost[e] < dist.get(to[e], math.inf) - 1e-12:
                    dist[to[e]] = dist[x] + cost[e]
                    via[to[e]] = e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if t not in dist:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        path, x = [], t
        while x != s:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: list[tuple[tuple, float]], want: dict, repeats: int = REPEATS) -> list[float]:
    """Words each pattern (its sources, its size) gives so that sources reach their targets with the fewest repetitions.

    Groups of sources that share no pattern are networks of their own."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for sources, _ in patterns:
        for k in sources[1:]:
            root[find(k)] = find(sources[0])
    groups = defaultdict(list)
    for i, (sources, _) in enumerate(patterns):
        groups[find(sources[0])].append(i)
    flow = [0.0] * len(patterns)
    for members in groups.values():
        sources = sorted({k for i in members for k in patterns[i][0]}, key=lambda k: (k is None, k))
        at = {k: 1 + len(members) + j for j, k in enumerate(sources)}
        end = 1 + len(members) + len(sources)
        arcs = [(0, 1 + j, patterns[i][1], float(tier * tier)) for tier in range(repeats) for j, i in enumerate(members)]
        arcs += [(1 + j, at[k], repeats * patterns[i][1], 0.0) for j, i in enumerate(members) for k in patterns[i][0]]
        arcs += [(at[k], end, want.get(k, 0.0), 0.0) for k in sources]
        for f, j in zip(min_cost_flow(end + 1, arcs, 0, end), [j for _ in range(repeats) for j in range(len(members))], strict=False):
            flow[members[j]] += f
    return flow


def words(text_col: str = "text"):
    """Number of words of a text, 0 for null: pieces between gaps that aren't empty."""
    return F.coalesce(F.size(F.array_remove(F.split(text_col, GAP, -1), "")).cast("bigint"), F.lit(0).cast("bigint"))


def draw(id_col: str, seed: int) -> Column:
    """The place of a document in its source's order: 60 bits of a digest of the id and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def mix(sized: DataFrame, id_col: str = "doc_id", size_col: str = "size", sources_col: str = "sources", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """sized: (id, size, array of sources). Adds times (0..repeats passes over the document), taken, and for the first source its size and target.

    Sources by code point (null last) have the weights in turn; together they get ``share`` of all sizes."""
    spark, since = sized.sparkSession, len(CREATED)
    kind = sized.schema[id_col].dataType
    rows = sized.select(
        F.col(id_col),
        F.col(size_col).cast("bigint").alias("size"),
        F.array_sort(F.array_distinct(sources_col)).alias("sources"),
        F.element_at(sources_col, 1).alias("source"),
    )
    rows = rows.withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"})).withColumn("h", draw(id_col, seed))
    rows = rows.withColumn("bin", F.shiftright("h", 60 - (max(4, sized.count().bit_length() // 2))))
    bins = save(rows.groupBy("pattern", "bin").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")), scratch(spark, "mixing-bins"))
    table = bins.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).collect()
    table.sort(key=lambda r: r.pattern)
    size: dict = defaultdict(int)
    for r in table:
        for k in r.sources:
            size[k] += r.size
    order = sorted(size, key=lambda k: (k is None, k or ""))
    total = share * sum(r.size for r in table)
    want = dict(zip(order, targets([size[k] for k in order], [weights[i % len(weights)] for i in range(len(order))], total, repeats), strict=True))
    flow = route([(tuple(r.sources), float(r.size)) for r in table], want, repeats)
    plan = []
    for r, f in zip(table, flow, strict=True):
        passes = min(repeats, int(f // r.size)) if r.size else 0
        plan.append((r.pattern, passes, f - passes * r.size if passes < repeats else 0.0))
    plan = spark.createDataFrame(plan, "pattern string, passes int, rest double")
    known = spark.createDataFrame([(k, size[k], want[k]) for k in order], "__source string, source_size bigint, target double")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = bins.select("pattern", "bin", before.alias("before")).join(plan, "pattern")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("pattern", "bin").orderBy("h", F.col(id_col), "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("inside", inside).join(starts, ["pattern", "bin"])
    prefix = (F.col("rest") > 0) & (F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("rest"))
    times = F.col("passes") + F.when(prefix, 1).otherwise(0)
    # one row per source: as small as the pattern table that the driver has held
    out = out.join(F.broadcast(known) if len(order) <= 100_000 else known, F.col("source").eqNullSafe(F.col("__source")))
    out = out.select(F.col(id_col).cast(kind), "size", "source_size", F.round("target", 6).alias("target"), times.cast("int").alias("times"), (F.col("size") * times).alias("taken"), "source")
    return finish(out, "mixing-result", since)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """mix() over documents of one source each, sized by their words; the sizes are written once, so texts are read once."""
    sized = docs.select(F.col(id_col), words(text_col).alias("size"), F.array(F.col(source_col)).alias("sources"))
    path = scratch(docs.sparkSession, "mixing-sizes")
    out = mix(save(sized, path), id_col)
    remove(docs.sparkSession, path)
    CREATED.remove(path)
    return out
