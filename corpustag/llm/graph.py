"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpustag.llm.ordering import slice_of
from corpustag.llm.storage import Scratch


def _differences() -> list[int]:
    """Least sizes of the classes of numbers of differences, a half apart."""
    out = [0, 1]
    while out[-1] < 1 << 41:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


DIFFERENCES = _differences()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(``node``, ``component``) for every node of the undirected edges ``a``-``b``; the least node names it.

    Each round is joins with the least neighbour of a node, never a list of neighbours, and ends as a
    written table. Rounds grow with the logarithm of the longest path. Only a checksum comes to the driver.
    """
    current = scratch.keep(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    state, step = _state(current), 0
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        downward = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(downward, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        step += 1
        new = scratch.keep(small.filter("a <> b").distinct(), f"{name}_{step}")
        new_state = _state(new)
        scratch.drop(f"{name}_{step - 1}")
        current = new
        if new_state == state:
            break
        state = new_state
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose ``sets`` (``node``, ``tokens``) have a Jaccard similarity of ``percent`` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").withColumn("both", both).filter(
        100 * F.col("both") >= percent * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")


def _across(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (``x``, ``y``) of ``members`` (``lead``, ``node``, ``part``) of one leader but different parts that may link.

    Members are described by their differences from the leader. With e and f differences, sets of n and m differ from each other
    in e + f - 2 (shared differences) tokens, and link if those are at most h = (n + m) (100 - percent) / (100 + percent). So they share
    at least (e + f - h) / 2 differences. That is 1 or more, as two that link with the leader are in one part. Differences that only
    one part has are left out, and of the others, rarest first, those that a prefix needs are compared, by classes of f. Two members
    that meet at a difference share no more than what either has left from there on, if it is the first they share: they are a
    pair only if that may do.
    """
    least = F.array(*[F.lit(x).cast("bigint") for x in DIFFERENCES])
    leader = sets.select(F.col("node").alias("lead"), F.col("tokens").alias("tl"))
    member = sets.select("node", F.col("tokens").alias("tm"))
    differences = F.concat(F.array_except("tl", "tm"), F.array_except("tm", "tl"))
    # dropped by the caller, once it has written the pairs
    rows = scratch.keep(members.join(member, "node").join(leader, "lead").select(
        "lead", "node", "part", F.size("tm").cast("bigint").alias("n"), F.size("tl").cast("bigint").alias("nl"), differences.alias("diff")), "differences")
    e = F.size("diff").cast("bigint")
    tokens = rows.select("lead", "node", "part", "n", "nl", e.alias("e"), F.explode("diff").alias("token"))
    shared = tokens.groupBy("lead", "token").agg(
        F.count(F.lit(1)).alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("lead", "token", "df")
    held = tokens.join(shared, ["lead", "token"]).groupBy("lead", "node", "part", "n", "nl", "e").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))

    slack = lambda m: F.floor((F.col("n") + m) * (100 - percent) / F.lit(100 + percent))
    widest = slack(F.floor(100 * F.col("n") / percent))
    low, high = F.get(least, F.col("to")), F.get(least, F.col("to") + 1) - 1
    h = slack(F.least(F.floor(100 * F.col("n") / percent), F.col("nl") + high))
    both = F.col("e") + F.greatest(low, F.col("e") - F.col("h")) - F.col("h")
    wanted = F.greatest(F.lit(1).cast("bigint"), F.floor((both + 1) / 2))
    dealt = (held.withColumn("of", slice_of(F.col("e") + 1, DIFFERENCES) - 1)
             .withColumn("to", F.explode(F.sequence(
                 slice_of(F.greatest(F.lit(1).cast("bigint"), F.col("e") - widest + 1), DIFFERENCES) - 1,
                 slice_of(F.col("e") + widest + 1, DIFFERENCES) - 1)))
             .withColumn("h", h).withColumn("length", (F.size("held") - wanted + 1).cast("int")).filter("length > 0"))
    keys = dealt.select("lead", "node", "part", "n", "e", "of", "to", F.size("held").alias("size"),
                        F.posexplode(F.slice("held", F.lit(1), F.col("length"))["token"]).alias("pos", "token"))
    keys = keys.withColumn("left", F.col("size") - F.col("pos")).drop("size", "pos")
    keys = scratch.keep(keys, "difference_keys")
    parts = members.groupBy("lead", "part").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("lead").agg(F.max(F.struct("m", "part"))["part"].alias("main"))
    aside = keys.join(main, "lead").filter("part <> main").select(
        F.col("node").alias("x"), F.col("part").alias("xp"), *[F.col(c).alias(f"x{c}") for c in ("lead", "token", "n", "e", "left", "of", "to")])
    differ = F.col("e") + F.col("xe") - 2 * F.least("left", "xleft")
    met = ((F.col("xlead") == F.col("lead")) & (F.col("xtoken") == F.col("token")) & (F.col("xof") == F.col("to")) & (F.col("xto") == F.col("of"))
           & (F.col("xp") != F.col("part")) & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("xn"))))
    return aside.join(keys, met).select("x", F.col("node").alias("y"))


def linked_components(index: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Components of the nodes of ``index`` (``key``, ``node``, ``rank``), linked where they share a key and ``sets`` (``node``, ``tokens``)
    have a Jaccard similarity of ``percent`` or more.

    Each key's nodes are compared with the one of least rank, its leader. After that only pairs in different components are
    left, and of those only such as share enough differences from the leader. So a key whose nodes are all alike costs its
    size, outliers of a large group are not compared with all of it, and no link between components is missed.
    """
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    leaders = scratch.keep(index.groupBy("key").agg(
        F.min(F.struct("rank", "node"))["node"].alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "lead"), "leaders")
    stars = scratch.keep(index.join(leaders, "key").filter("node <> lead").select(*pair("node", "lead")).distinct(), "stars")
    links = scratch.keep(overlapping(stars, sets, percent), "star_links")
    first = components(links, scratch, "first").withColumnRenamed("node", "_node")
    named = scratch.keep(index.join(leaders, "key").join(first, F.col("node") == F.col("_node"), "left").select(
        "key", "lead", "node", F.coalesce("component", "node").alias("part")), "named")
    split = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    members = scratch.keep(named.join(split, "key", "left_semi").select("lead", "node", "part").distinct(), "members")
    for name in ("leaders", "named"):
        scratch.drop(name)
    across = scratch.keep(_across(members, sets, percent, scratch).select(*pair("x", "y")).distinct().join(stars, ["a", "b"], "left_anti"), "across")
    for name in ("members", "differences", "difference_keys", "stars"):
        scratch.drop(name)
    out = scratch.keep(components(links.unionByName(overlapping(across, sets, percent)), scratch, "last"), "components")
    for name in ("star_links", "across"):
        scratch.drop(name)
    return out
