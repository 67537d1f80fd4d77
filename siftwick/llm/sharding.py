"""Sharding by balanced label propagation: linked documents meet, shard sizes stay even."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate, combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, unit_hash, written

ROUNDS = 5
ROWS_PER_BUCKET = 20_000
#: A swap between shards takes up to so many hubs from each, of so many of its smallest and largest sizes.
SWAPPED, MIXED = 3, 12


def capacities(n: int, shards: int) -> list[int]:
    """Counts at most one apart that add up to n."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def lookup(values: list[int], at: Column) -> Column:
    """values[at] for a short list."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), at)


def ranked(df: DataFrame, key: Column, rows: int, name: str) -> DataFrame:
    """Number the rows of each key gaplessly from 0, without a task that holds a key.

    Rows are dealt to so many buckets a key that a bucket has about
    ROWS_PER_BUCKET of them at any scale; buckets are counted, and each starts
    where the ones before it end. Needs a column ``rid``; the table of bucket
    counts is the only thing that is ordered by key.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    df = df.withColumns({"__k": key, "__b": F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int")})
    w = Window.partitionBy("__k", "__b").orderBy("rid")
    counts = df.groupBy("__k", "__b").count()
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__k", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    numbered = df.withColumn("__r", F.row_number().over(w) - 1)
    return numbered.join(starts, ["__k", "__b"]).withColumn(name, F.col("__s") + F.col("__r")).drop("__k", "__b", "__s", "__r")


def loads(labels: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in labels.groupBy("shard").count().collect()}  # a row per shard
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(rid, hub) -> (rid, hub, shard): members of a hub move to where most of them are.

    Each round joins members to their hub's counts by shard. A hub aims at the
    fullest of its shards that have, with their free places, room for all of
    it: one for a small hub, several for one larger than a shard. Moves are
    granted by hash in the proportion that free places bear to requests; small
    hubs are granted as one, large ones by member.
    """
    shards = len(quota)
    state = written(linked.withColumn("shard", F.pmod(F.xxhash64("rid", F.lit("start")), F.lit(shards)).cast("int")), "labels")
    for r in range(rounds):
        load = loads(state, shards)
        free = [max(0, q - x) for q, x in zip(quota, load, strict=True)]
        counts = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        # at most one entry a shard in a hub's list
        places = counts.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("n", "shard")), asc=False).alias("p"), F.sum("n").alias("m"))
        places = places.where(F.size("p") > 1)
        room = F.transform("p", lambda x: x["n"] + lookup(free, x["shard"]))
        reach = F.aggregate(room, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("k")), lambda a, x: F.when(a["sum"] >= F.col("m"), a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["k"] + 1).alias("k"))))
        aims = F.transform(F.slice("p", F.lit(1), reach["k"]), lambda x: x["shard"])
        # written, so that both sides of the join are plain shuffles, of which a hot hub's can be split
        places = written(places.select("hub", "m", aims.alias("aims")), "places")
        open_to = F.filter("aims", lambda s: lookup(free, s) > 0)
        pick = F.get(open_to, F.pmod(F.xxhash64("rid", F.lit(r)), F.greatest(F.size(open_to), F.lit(1)).cast("long")).cast("int"))
        want = state.join(places, "hub", "left").withColumn("to", F.when(F.col("aims").isNotNull() & ~F.array_contains("aims", F.col("shard")), pick))
        asked = {x[0]: x[1] for x in want.where("to IS NOT NULL").groupBy("to").count().collect()}
        if not asked:
            break
        share = [min(1.0, free[s] / asked[s]) if asked.get(s) else 0.0 for s in range(shards)]
        grant = F.get(F.array(*[F.lit(x) for x in share]), F.col("to"))
        small = F.col("m") * 10 <= lookup(free, F.col("to"))
        luck = F.when(small, unit_hash(F.col("hub"), F.lit(r))).otherwise(unit_hash(F.col("rid"), F.lit(r + 100)))
        moved = want.withColumn("shard", F.when(F.col("to").isNotNull() & (luck < grant), F.col("to")).otherwise(F.col("shard")))
        old, state = state, written(moved.select("rid", "hub", "shard"), "labels")
        remove(old)
        remove(places)
    return state


def best_fit(sizes: Counter, free: list[int], held: list[Counter]) -> Counter:
    """Add whole hubs, the largest first, to the fullest shards that have room; gives back those that fit nowhere."""
    left: Counter = Counter()
    for m in sorted(sizes, reverse=True):
        c = sizes[m]
        for s in sorted(range(len(free)), key=free.__getitem__):
            k = min(c, free[s] // m)
            held[s][m] += k
            free[s] -= k * m
            c -= k
        left[m] = c
    return +left


def handfuls(held: Counter) -> dict[int, tuple[int, ...]]:
    """By sum: a few hubs that a shard can give in a swap, or none."""
    sizes = sorted(m for m, k in held.items() if k)
    sizes = sizes if len(sizes) <= MIXED else sizes[: MIXED // 2] + sizes[-MIXED // 2 :]
    out: dict[int, tuple[int, ...]] = {0: ()}
    for k in range(1, SWAPPED + 1):
        for c in combinations_with_replacement(sizes, k):
            if all(held[m] >= c.count(m) for m in c):
                out.setdefault(sum(c), c)
    return out


def gather(m: int, free: list[int], held: list[Counter]) -> bool:
    """Swap hubs between shards, within their quotas, until one has room for ``m`` more rows."""
    order = sorted(range(len(free)), key=free.__getitem__, reverse=True)
    for b in order:
        for a in order:
            while a != b and 0 < free[a] and free[b] < m:
                mine, other = handfuls(held[b]), handfuls(held[a])
                sums = sorted(other)
                # the most that one swap can bring: the least handful of a's that makes it fit there
                d, x = max(((x - sums[i], x) for x in mine if (i := bisect_left(sums, x - free[a])) < len(sums)), default=(0, 0))
                if d <= 0:
                    break
                out, back = Counter(mine[x]), Counter(other[x - d])
                held[b] = held[b] - out + back
                held[a] = held[a] - back + out
                free[a] -= d
                free[b] += d
        if free[b] >= m:
            return True
    return False


def fill(m: int, free: list[int]) -> list[tuple[int, int]]:
    """(rows, shard): a hub that must be cut takes the emptiest shards whole."""
    pieces = []
    while m:
        s = max(range(len(free)), key=free.__getitem__)
        k = min(m, free[s])
        pieces.append((k, s))
        free[s] -= k
        m -= k
    return pieces


def settle(classes: dict[tuple[int, int], int], quota: list[int]) -> tuple[dict[tuple[int, int], list[tuple[int, int]]], list[tuple[int, list[tuple[int, int]]]]]:
    """Shards for hubs that are counted by (size, shard that holds all of it, or -1).

    Hubs larger than a shard come first and span as few as they can. Others
    stay where they are whole as long as the quota lasts; the rest is placed
    whole, largest first, with swaps where room is scattered. If some still
    fit nowhere, all are placed anew; the plan that cuts fewer rows holds. What
    it cuts comes last. Gives runs of (hubs, shard) by class, a shard -1 - i
    for the cut hub i, and the cut hubs' sizes and pieces.

    The table of sizes has at most sqrt(2 n) of them for n rows.
    """
    shards, largest = range(len(quota)), max(quota)
    total: Counter = Counter()
    for (m, _), c in classes.items():
        total[m] += c
    plans = []
    for keep in (True, False):
        held: list[Counter] = [Counter() for _ in shards]
        free = list(quota)
        cuts = [(m, fill(m, free)) for m in sorted(total.elements(), reverse=True) if m > largest] if max(total, default=0) > largest else []
        pool = Counter({m: c for m, c in total.items() if m <= largest})
        if keep:
            for (m, at), c in sorted(classes.items(), reverse=True):
                if at >= 0 and m <= largest:
                    k = min(c, free[at] // m)
                    held[at][m] += k
                    free[at] -= k * m
                    pool[m] -= k
        left = best_fit(+pool, free, held)
        for m in sorted(left):
            while left[m] and gather(m, free, held):
                left = best_fit(left, free, held)
            if left[m]:
                break
        lost = sum(left.elements())
        cuts += [(m, fill(m, free)) for m in sorted(left.elements(), reverse=True)]
        plans.append((lost, held, cuts))
        if not lost:
            break
    _, held, cuts = min(plans, key=lambda x: x[0])
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    rest = dict(classes)
    for m, at in classes:
        k = min(rest[m, at], held[at][m]) if at >= 0 else 0
        runs[m, at] = [(k, at)] if k else []
        rest[m, at] -= k
        held[at][m] -= k
    wanted: dict[int, list[list[int]]] = {m: [] for m in total}
    for s in shards:
        for m, k in (+held[s]).items():
            wanted[m].append([k, s])
    for i, (m, _) in enumerate(cuts):
        wanted[m].append([1, -1 - i])
    for m, at in classes:
        while rest[m, at]:
            k = min(rest[m, at], wanted[m][-1][0])
            runs[m, at].append((k, wanted[m][-1][1]))
            rest[m, at] -= k
            wanted[m][-1][0] -= k
            if not wanted[m][-1][0]:
                wanted[m].pop()
    return runs, cuts


def run_table(spark: SparkSession, runs: dict[int, list[tuple[int, int]]], key: str) -> DataFrame:
    """(key, ends, shards): the shard of number i is at the first end beyond i."""
    rows = [(k, list(accumulate(n for n, _ in r)), [s for _, s in r]) for k, r in runs.items()]
    return F.broadcast(spark.createDataFrame(rows, f"{key} long, ends array<long>, shards array<int>"))


def place(at: str) -> Column:
    return F.get("shards", F.size(F.filter("ends", lambda e: e <= F.col(at))))


def settled(state: DataFrame, quota: list[int]) -> DataFrame:
    """(rid, hub, shard) -> (rid, shard) within the quotas, each hub in one shard if it can be."""
    spark, shards = state.sparkSession, len(quota)
    hubs = state.groupBy("hub").agg(F.count("*").alias("m"), F.min("shard").alias("a"), F.max("shard").alias("b"))
    hubs = written(hubs.select(F.col("hub").alias("rid"), "m", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(-1)).alias("at")), "hubs")
    classes = {(r[0], r[1]): r[2] for r in hubs.groupBy("m", "at").count().collect()}  # a row per size and shard
    runs, cuts = settle(classes, quota)
    kind = (F.col("m") * (shards + 1) + F.col("at") + 1).alias("kind")
    table = run_table(spark, {m * (shards + 1) + at + 1: r for (m, at), r in runs.items()}, "kind")
    numbered = ranked(hubs, kind, max(classes.values(), default=1), "__n").withColumn("kind", kind)
    # written, so that both sides of the join are plain shuffles, of which a hot hub's can be split
    places = written(numbered.join(table, "kind").select(F.col("rid").alias("hub"), place("__n").alias("to")), "places")
    rows = written(state.select("rid", "hub").join(places, "hub"), "placed")
    out = rows.where("to >= 0").select("rid", F.col("to").alias("shard"))
    if cuts:
        parts = ranked(rows.where("to < 0"), F.col("to"), max(m for m, _ in cuts), "__n")
        pieces = run_table(spark, {-1 - i: p for i, (_, p) in enumerate(cuts)}, "to")
        out = out.unionByName(parts.join(pieces, "to").select("rid", place("__n").alias("shard")))
    return written(out, "settled")


def shard_rows(df: DataFrame, shards: int = 40, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard; shards' counts are at most one apart (law ``rows``).

    Documents with equal texts are linked. What the last round leaves cut, or
    beyond its shard's quota, is placed whole wherever that can be found; those
    without links fill shards up last, so that counts come out exact. Null texts count as empty: size 16,
    crc32 0, linked with each other. Repeated rows are rows of their own. With
    fewer rows than shards some shards stay empty; an empty table gives an
    empty one. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = written(
        df.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("hub"),
        ),
        "shard-base",
    )
    n = base.count()
    quota = capacities(n, shards)
    hubs = written(base.groupBy("hub").count().where("count > 1").select("hub"), "hubs")
    linked = base.select("rid", "hub").join(hubs, "hub", "left_semi")
    state = propagate(linked.select("rid", "hub"), quota, rounds)
    placed = settled(state, quota)
    load = loads(placed, shards)
    room = [q - x for q, x in zip(quota, load, strict=True)]
    ends = list(accumulate(room))
    rest = base.select("rid").join(placed, "rid", "left_anti")
    rest = ranked(rest, F.lit(0), ends[-1], "__g")
    where = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("__g")))
    final = placed.unionByName(rest.select("rid", where.cast("int").alias("shard")))
    out = written(base.drop("hub").join(final, "rid"), "sharded")
    out = ranked(out, F.col("shard"), max(quota), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
