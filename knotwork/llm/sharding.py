"""Sharding by balanced label propagation.

Documents that share a group (here: equal texts) are linked with each other. They start in shards by hash. In each round every torn group looks at the shards where its members - each other's neighbours -
stand, and names the one that holds most of them among those with room for the rest, ties to the smaller number; members elsewhere want to move there. Only where no neighbour's shard has room it names another one, by hash, in proportion
to the room left. Wishes are counted by shard and by the groups' hash bucket, and each shard admits buckets up to its quota, so sizes stay even while links that are cut
become fewer. At the end counts are made exactly even (at most one apart): shards above their quota give up documents without links first, then whole groups. Each row tells how many links it has and how many of them are cut.

Only tables of shards x buckets come to the driver; no group and no shard is ever gathered in one task. A group larger than a shard is split, by hash, into as many parts as it needs. Groups or parts larger than an eighth of a shard,
of which there are fewer than eight a shard, are placed first, the largest ones first, where most of their members are among the shards with room. Their rows, and those of other hot texts, are joined by broadcast.
Null texts are linked with nothing, empty ones with each other; a null doc_id is a document like any other, repeated rows count each. Very long texts count by their bytes alone. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.llm import sampling, store

SHARDS, ROUNDS, BUCKETS = 24, 6, 256


def _look_up(df: DataFrame, values: dict[tuple, int], keys: list[str], name: str) -> DataFrame:
    """df with the value of a table of at most shards x buckets x buckets keys; null where there is none."""
    fields = ", ".join(f"{k} int" for k in keys) + f", {name} long"
    table = df.sparkSession.createDataFrame([(*k, v) for k, v in values.items()], fields)
    return df.join(F.broadcast(table), keys, "left")


def _place_wide(counts: list, room: list[int]) -> dict[tuple, int]:
    """The shard of each large group, from rows (g, shard, n); room becomes less. The largest first: where most members are, of the shards with room; where none has, that with the most room."""
    held: dict[int, dict[int, int]] = {}
    for r in counts:
        held.setdefault(r.g, {})[r.shard] = r.n
    out = {}
    for g, n in sorted(((g, sum(by.values())) for g, by in held.items()), key=lambda x: (-x[1], x[0])):
        s = max(range(len(room)), key=lambda s: (room[s] >= n, held[g].get(s, 0) if room[s] >= n else room[s], -s))
        room[s] -= n
        out[(g,)] = s
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, buckets: int = BUCKETS) -> DataFrame:
    """For each row of docs: doc_id, size (UTF-8 bytes + 8), text_crc32, shard, slot (from 0, gapless in each shard), links (other rows with its text), cut (of these, in other shards). Counts of shards differ by one at most."""
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(t.isNotNull(), F.sha2(t.cast("binary"), 256)).alias("g"),
    )
    base, base_path = store.keep(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups, groups_path = store.keep(base.where("g is not null").groupBy("g").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    home = F.expr(f"cast(pmod(xxhash64(row, 11), {shards}) as int)")
    full = max(2, total // shards)
    # parts are cut by hash, so they are planned two standard deviations below a shard's size
    parts = f"if(members <= {full}, 1, ceil(members / {max(1, int(full - 2 * full**0.5))}))"
    linked = sampling.join_split(base.where("g is not null").select("row", "g"), groups, ["g"], total, "members").select(
        "row", F.col("g").alias("text"), F.expr(f"xxhash64(g, pmod(xxhash64(row, 5), {parts}))").alias("g"), F.expr(f"members / {parts} > {max(64, total // (8 * shards))}").alias("wide"), home.alias("shard")
    )
    linked, linked_path = store.keep(linked, "linked")

    counts = linked.where("wide").groupBy("g", "shard").agg(F.count("*").alias("n")).collect()  # fewer than 8 x shards groups
    room = list(quota)
    wide = _place_wide(counts, room)
    large = spark.createDataFrame([(*k, v) for k, v in wide.items()], "g long, to int")
    settled = linked.where("wide").join(F.broadcast(large), "g").select("row", "g", "wide", F.col("to").alias("shard"))
    free = [max(0, n) for n in room]
    state, path = store.keep(linked.where("not wide").select("row", "g", "wide", "shard"), "labels")

    for k in range(rounds):
        # members by group and shard, counted before the shuffle; a group has at most as many places as there are shards
        by_shard = state.groupBy("g", "shard").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("members"), F.collect_list(F.struct("n", (-F.col("shard")).alias("minus"))).alias("places"))
        by_shard, counts_path = store.keep(by_shard, "neighbours")
        held = {r.shard: r.n for r in by_shard.where("size(places) = 1").groupBy((-F.col("places")[0]["minus"]).alias("shard")).agg(F.sum("members").alias("n")).collect()}
        room = [max(0, free[s] - held.get(s, 0)) for s in range(shards)]
        fits = f"filter(places, p -> array({', '.join(f'{n}L' for n in room)})[-p.minus] >= members - p.n)"
        ends = [sum(room[: s + 1]) / max(1, sum(room)) for s in range(shards - 1)]
        other = F.expr(f"size(filter(array({', '.join(f'{e}D' for e in ends) or '1D'}), x -> x <= pmod(xxhash64(g, {k}), 1000000) / 1000000D))")
        best = F.expr(f"array_max({fits})")
        torn = by_shard.where("size(places) > 1").select("g", "members", F.coalesce(-best["minus"], other).cast("int").alias("target"), F.coalesce(F.col("members") - best["n"], F.col("members")).alias("moving"), F.expr(f"cast(pmod(xxhash64(g, 13), {buckets}) as int)").alias("bucket"))
        asked = torn.groupBy("target", "bucket").agg(F.sum("members").alias("n"), F.sum("moving").alias("moving")).collect()  # shards x buckets at most
        admitted: dict[tuple, int] = {}
        for r in sorted(asked, key=lambda r: (r.moving / r.n, r.n, r.target, r.bucket)):  # those with most neighbours there already come first
            if r.n <= room[r.target]:
                room[r.target] -= r.n
                admitted[r.target, r.bucket] = 1
        if not admitted:
            store.drop(spark, counts_path)
            break
        going = _look_up(torn, admitted, ["target", "bucket"], "ok").where("ok = 1").select("g", "target")
        new, new_path = store.keep(state.join(going, "g", "left").select("row", "g", "wide", F.coalesce("target", "shard").alias("shard")), "labels")
        store.drop(spark, path, counts_path)
        state, path = new, new_path

    alone = base.select("row").join(linked.select("row"), "row", "left_anti").select("row", F.lit(None).cast("long").alias("g"), F.lit(False).alias("wide"), home.alias("shard"))
    placed, placed_path = store.keep(_even_out(alone.unionByName(settled).unionByName(state), quota, buckets), "placed")
    store.drop(spark, path)
    out, out_path = store.keep(_ranked(base.join(placed, "row"), ["shard"], buckets).withColumnRenamed("rank", "slot"), "slots")
    store.drop(spark, base_path, placed_path, linked_path)

    here, _ = store.keep(out.where("g is not null").groupBy("g", "shard").agg(F.count("*").alias("here")), "here")
    # by text and shard, and the text's members, known from few rows a group
    facts, _ = store.keep(here.join(groups, "g"), "links")
    store.drop(spark, groups_path)
    tied = sampling.join_split(out.where("g is not null"), facts, ["g", "shard"], total, "here").select("row", (F.col("members") - 1).alias("links"), (F.col("members") - F.col("here")).alias("cut"))
    zero = F.lit(0).cast("long")
    return out.join(tied, "row", "left").select("doc_id", "size", "text_crc32", "shard", "slot", F.coalesce("links", zero).alias("links"), F.coalesce("cut", zero).alias("cut"))


def _ranked(df: DataFrame, keys: list[str], buckets: int, by: str = "row") -> DataFrame:
    """df with "rank": 0, 1, ... among the rows that have equal keys; counted by hash bucket, so no group of keys is in one task. Rows with one value of `by` follow each other."""
    df = df.withColumn("b", F.expr(f"cast(pmod(xxhash64({by}, 3), {buckets}) as int)"))
    counts = sorted(((tuple(r[k] for k in keys), r.b, r.n) for r in df.groupBy(*keys, "b").agg(F.count("*").alias("n")).collect()))
    before: dict[tuple, int] = {}
    last, run = None, 0
    for key, b, n in counts:
        run = 0 if key != last else run
        before[(*key, b)] = run
        last, run = key, run + n
    inside = F.row_number().over(W.partitionBy(*keys, "b").orderBy(by, "row")) - 1
    return _look_up(df.withColumn("inside", inside), before, [*keys, "b"], "before").withColumn("rank", F.col("before") + F.col("inside")).drop("b", "inside", "before")


def _even_out(placed: DataFrame, quota: list[int], buckets: int) -> DataFrame:
    """(row, shard) with exactly quota[s] rows in shard s; rows without links move first, then group by group."""
    kinds = placed.withColumn("tied", F.col("g").isNotNull().cast("int")).withColumn("block", F.expr("if(g is null or wide, xxhash64(row), g)"))
    counts = {(r.shard, r.tied): r.n for r in kinds.groupBy("shard", "tied").agg(F.count("*").alias("n")).collect()}
    surplus = [counts.get((s, 0), 0) + counts.get((s, 1), 0) - q for s, q in enumerate(quota)]
    give = {}
    for s, over in enumerate(surplus):
        loose = counts.get((s, 0), 0)
        if over > 0:
            give[s, 0], give[s, 1] = min(over, loose), max(0, over - loose)
    ranked = _ranked(kinds.select("row", "shard", "tied", "block"), ["shard", "tied"], buckets, "block")
    start = dict(zip(give, accumulate([0, *give.values()]), strict=False))
    ranked = _look_up(_look_up(ranked, give, ["shard", "tied"], "give"), start, ["shard", "tied"], "start")
    going, number = F.expr("rank < coalesce(give, 0)"), F.expr("start + rank")
    takers = [(s, -over) for s, over in enumerate(surplus) if over < 0]
    to = F.lit(None).cast("int")
    for (s, _), upto in reversed(list(zip(takers, accumulate(n for _, n in takers), strict=True))):
        to = F.when(number < upto, F.lit(s)).otherwise(to)
    return ranked.select("row", F.when(going, to).otherwise(F.col("shard")).cast("int").alias("shard"))
