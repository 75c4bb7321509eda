"""Operator 9: mixing sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Words flow from
patterns to the quotas of their sources; a pattern offers its words once at cost 0, a second time at
cost 1 and a third time at cost 3, so nothing is repeated while fresh text is left. Costs depend on the
pattern's repetition alone, hence successive shortest paths are maximum flows tier by tier, with
rerouting between patterns that share sources.

Within a pattern whole passes take every document; the rest is filled by documents in the order of a
seeded hash, up to a cut, and the last gap by a few further documents that fit. Patterns are routed in
blocks of PATTERNS: the driver holds one row for each pattern of a block, at most FILL documents for each
pattern and size class, and one number for each source. With more than one block every block gets its
share of each quota by its words, what it leaves over goes to the next, and costs are least within a
block; the plan is then a table that is joined, with one block it is sent to the tasks whole.

The choice is a function of seed and ids, so reruns agree; rows that repeat an id are chosen together,
ties of the hash, too. Null texts have size 0, as empty ones have; very long texts count whole; a null
source is a source of its own, the last; an empty table gives an empty mix. Columns of documents pass
through mixed_documents() as they are, whatever their names; mix_report() leaves extra ones out.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, scratch, written

MOST_TIMES = 3
PATTERNS = 100_000
FILL = 8
BUCKETS = 4096


def n_words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII spaces; null: 0."""
    inside = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(inside == "", 0).otherwise(F.size(F.split(inside, r"[\x20\x09-\x0D]+"))).cast("long")


def in_order(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights: dict, most: int = MOST_TIMES) -> dict:
    """Shares of all words by weight; what exceeds `most` times a source's size is shared anew."""
    total, out, free = sum(sizes.values()), {}, in_order(sizes)
    left = float(total)
    while free:
        whole = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / whole > most * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / whole for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def route(capacity: list[int], members: list[list], quota: dict, most: int = MOST_TIMES) -> list[dict]:
    """Words that each pattern sends to each of its sources: maximum flow of least cost."""
    flow: list[dict] = [dict.fromkeys(m, 0) for m in members]
    left = {s: int(round(q)) for s, q in quota.items()}
    feeds: dict = {}
    for p, m in enumerate(members):
        for s in m:
            feeds.setdefault(s, []).append(p)
    for _ in range(most):  # the tiers, cheapest first
        spare = list(capacity)
        for p, m in enumerate(members):
            for s in m:
                x = min(spare[p], left.get(s, 0))
                flow[p][s] += x
                spare[p] -= x
                left[s] = left.get(s, 0) - x
        for p in range(len(members)):
            while spare[p] and (path := _reroute(p, members, flow, left, feeds)):
                x = min([spare[p], left[path[-1][1]], *(flow[b][s] for (_, s), (b, _) in zip(path, path[1:]))])
                for (a, s), nxt in zip(path, [*path[1:], None]):
                    flow[a][s] += x
                    if nxt:
                        flow[nxt[0]][s] -= x
                spare[p] -= x
                left[path[-1][1]] -= x
    return flow


def _reroute(p: int, members, flow, left, feeds) -> list[tuple] | None:
    """A shortest chain p -> s1 -> p2 -> s2 ... that ends in a source with quota left."""
    back, queue, seen = {p: None}, deque([p]), set()
    while queue:
        a = queue.popleft()
        for s in members[a]:
            if s in seen:
                continue
            seen.add(s)
            if left.get(s, 0) > 0:
                path = [(a, s)]
                while back[path[0][0]]:
                    path.insert(0, back[path[0][0]])
                return path
            for b in feeds[s]:
                if b not in back and flow[b][s] > 0:
                    back[b] = (a, s)
                    queue.append(b)
    return None


#: Names of columns of this module beside a user's own; made free of clashes by `fresh`.
PATTERN, TIMES = "_mix_pattern", "_mix_times"


@dataclass
class Mix:
    """The plan: a table by pattern, and how to read it."""

    plan: DataFrame  # pattern, passes, cut, fill
    small: bool  # one block of patterns: the plan may be sent to the tasks
    by_source: dict  # source -> (size, target)
    seed: int

    def times(self, rows: DataFrame, pattern: str, times: str) -> DataFrame:
        """rows (with doc_id and a column of patterns) plus `times`: how often the mix takes each."""
        u = order_key(self.seed)
        own = [fresh(rows, f"_mix_{c}") for c in self.plan.columns]
        name, passes, cut, fill = own
        chosen = (u <= F.col(cut)) | F.array_contains(fill, u)
        plan = self.plan.toDF(*own)
        return (
            rows.join(F.broadcast(plan) if self.small else plan, F.col(pattern) == F.col(name))
            .withColumn(times, (F.col(passes) + F.coalesce(chosen, F.lit(False)).cast("int")))
            .drop(*own)
        )


def order_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))


def pattern_of(members: Column) -> Column:
    """Text that names a membership pattern: its sources, sorted and distinct."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("s")), {"ignoreNullFields": "false"})


def plan_mix(rows: DataFrame, weights=None, seed: int = 11, most: int = MOST_TIMES) -> Mix:
    """rows: doc_id, size, members (array of sources). weights: source -> weight; None: 1, 2, 3 in turn."""
    spark = rows.sparkSession
    rows = written(
        rows.select(pattern_of(F.col("members")).alias("pattern"), order_key(seed).alias("u"), F.col("size").cast("long").alias("size")), "sized"
    )
    sums = written(rows.groupBy("pattern").agg(F.sum("size").alias("size")), "patterns")
    n = sums.count()
    blocks = max(1, -(-n // PATTERNS))
    parsed = sums.select("pattern", "size", F.from_json("pattern", "s array<string>")["s"].alias("members"))
    sizes = {r["s"]: r["size"] for r in parsed.select(F.explode("members").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("size")).collect()}
    if weights is None:
        weights = {s: i % 3 + 1 for i, s in enumerate(in_order(sizes))}
    goal = targets(sizes, weights, most)
    schema = "pattern string, passes int, cut long, fill array<long>"
    path, carried = scratch(spark, "plan"), {}
    for b in range(blocks):
        own = parsed.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).orderBy("pattern").collect() if n else []
        members = [in_order(r["members"]) for r in own]
        quota = goal
        if blocks > 1:
            here: dict = {}
            for r, m in zip(own, members):
                for s in m:
                    here[s] = here.get(s, 0) + r["size"]
            quota = {s: goal.get(s, 0.0) * here[s] / max(1, sizes[s]) + carried.pop(s, 0.0) for s in here}
        flow = route([r["size"] for r in own], members, quota, most)
        if blocks > 1:
            for s, q in quota.items():
                carried[s] = carried.get(s, 0.0) + q - sum(f.get(s, 0) for f in flow)
        need = {}
        for r, f in zip(own, flow):
            used = sum(f.values())
            passes = min(most, used // r["size"]) if r["size"] else 0
            need[r["pattern"]] = (passes, used - passes * r["size"] if passes < most else 0)
        cuts = _cuts(rows, need)
        spark.createDataFrame([(p, int(need[p][0]), *cuts.get(p, (None, []))) for p in need], schema).write.mode("append").parquet(path)
    return Mix(spark.read.schema(schema).parquet(path), blocks == 1, {s: (sizes[s], goal.get(s, 0.0)) for s in sizes}, seed)


def _cuts(rows: DataFrame, need: dict) -> dict:
    """For each pattern with a part to fill: the last hash taken, and hashes that fill the gap."""
    spark = rows.sparkSession
    wanted = [(p, rest) for p, (_, rest) in need.items() if rest > 0]
    if not wanted:
        return {}
    rest = F.broadcast(spark.createDataFrame(wanted, "pattern string, rest long"))
    keyed = rows.where("size > 0").join(rest, "pattern").withColumn("bucket", F.shiftright("u", 52))
    by_bucket = keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    total = F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket"))
    edge = (
        by_bucket.withColumn("through", total)
        .where("through > rest")
        .groupBy("pattern")
        .agg(F.min_by(F.struct("bucket", (F.col("through") - F.col("size")).alias("before")), "bucket").alias("e"))
        .select("pattern", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    )
    edge = F.broadcast(spark.createDataFrame(edge.collect(), "pattern string, edge long, before long"))
    inside = keyed.join(edge, "pattern").where("bucket = edge")
    by_hash = inside.groupBy("pattern", "u").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    through = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("u"))
    taken = (
        by_hash.withColumn("through", through)
        .groupBy("pattern")
        .agg(
            F.max(F.when(F.col("through") <= F.col("rest"), F.col("u"))).alias("cut"),
            F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))).alias("through"),
            F.first("before").alias("before"),
            F.first("rest").alias("rest"),
            F.min("u").alias("least"),
        )
        .collect()
    )
    # no hash of the edge bucket fits: the cut lies just below the bucket
    cuts = {r["pattern"]: (r["cut"] if r["cut"] is not None else (r["least"] >> 52 << 52) - 1) for r in taken}
    gaps = {r["pattern"]: r["rest"] - (r["through"] if r["through"] is not None else r["before"]) for r in taken}
    after = F.broadcast(spark.createDataFrame([(p, cuts[p], gaps[p]) for p in cuts], "pattern string, cut long, gap long"))
    rest_of = (
        rows.where("size > 0")
        .join(after, "pattern")
        .where("u > cut and size <= gap")
        .withColumn("class", F.floor(F.log2("size")))
        .withColumn("n", F.row_number().over(Window.partitionBy("pattern", "class").orderBy("u")))
        .where(F.col("n") <= FILL)
    )
    fill: dict = {p: {} for p in cuts}
    for r in rest_of.collect():
        own = fill[r["pattern"]]
        own[r["u"]] = own.get(r["u"], 0) + r["size"]
    chosen = {}
    for p, own in fill.items():
        gap, chosen[p] = gaps[p], []
        for u, size in sorted(own.items(), key=lambda x: (-x[1], x[0])):
            if size <= gap:
                gap -= size
                chosen[p].append(u)
    return {p: (cuts[p], chosen[p]) for p in cuts}


def mix_report(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")), "sizes")
    mix = plan_mix(rows.withColumn("members", F.array("source")), seed=seed)
    known = [(s, size, float(target)) for s, (size, target) in mix.by_source.items()]
    by_source = docs.sparkSession.createDataFrame(known, "_s string, source_size long, target double")
    return (
        mix.times(rows.withColumn(PATTERN, pattern_of(F.array("source"))), PATTERN, TIMES)
        .join(F.broadcast(by_source) if mix.small else by_source, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col(TIMES)).alias("taken"))
    )


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: documents with all their columns, each as often as the mix takes it."""
    rows = docs.select("doc_id", n_words(F.col("text")).alias("size"), F.array("source").alias("members"))
    mix = plan_mix(rows, seed=seed)
    pattern, times = fresh(docs, PATTERN), fresh(docs, TIMES)
    taken = mix.times(docs.withColumn(pattern, pattern_of(F.array("source"))), pattern, times).where(F.col(times) > 0)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
