"""Components of groups of candidates, compared hub by hub.

In each group one member, the hub, is compared with the others first; then several hubs a round.
Hubs leave a group once compared, and a group in one component is closed, so at the end every pair
of a group has been compared or is connected. A group of very many members that one hub did not
connect is split by a second key that linked pairs also share, before it is compared further; so
members that share one key but are not alike are not compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage
from .components import connected_components

MOST_HUBS = 4096
#: Members of a group from which it is split, and how often.
SPLIT_OVER, MOST_SPLITS = 2000, 3


def relabel(labels: DataFrame | None, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(class, root of all classes linked so far; label, root of the labels that moved)."""
    if labels is None:
        edges = links
    else:
        of = lambda x: labels.select(F.col("class").alias(x), F.col("root").alias(f"root_{x}"))
        edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    found = connected_components(edges)
    roots = found.select(F.col("node").alias("label"), "root")
    roots._staged_at = found._staged_at
    moved = roots.withColumnRenamed("label", "class")
    if labels is not None:
        kept = labels.withColumnRenamed("root", "label").join(roots, "label", "left").select("class", F.coalesce("root", "label").alias("root"))
        moved = kept.unionByName(moved)
    return stage(moved, f"{name}-labels"), roots


def link_groups(members: DataFrame, extra: list[str], near: Column, links_of: Callable[[DataFrame], DataFrame], name: str, refine: Callable[[DataFrame], tuple[DataFrame, list[str], Column]] | None = None, split: Callable[[DataFrame, int], DataFrame] | None = None, labels: DataFrame | None = None, hubs_per_group: int = 1, source: DataFrame | None = None) -> DataFrame | None:
    """class, root of the components of all pairs that share a sig, satisfy `near` and that links_of
    confirms; None if there are no groups.

    members: sig, class, shares and the columns in extra; the member of a group with the most shares
    is its first hub. near is a condition on extra and hub_* columns, evaluated inside the join.
    links_of gets pairs a < b and returns those that link. After the first round refine may add
    columns to what is left and give a sharper near. split(classes, level) gives class, sig2: further
    keys of which linked pairs that share a sig have one in common with equal low 8 bits. labels: roots
    known before, with which members have a column label; source: a staged table that members read."""
    columns = ["class", *extra]
    members = stage(members if "label" in members.columns else members.withColumn("label", F.col("class")), f"{name}-members")
    unstage(source)
    level = 0
    while members.take(1):
        hub = F.max(F.struct("shares", *columns, "label")).alias("hub")
        slot = F.pmod(F.xxhash64("class"), F.lit(hubs_per_group)).alias("slot")
        hubs = members.groupBy("sig", slot).agg(hub).select("sig", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in (*columns, "label")])
        hubs = stage(hubs, f"{name}-hubs")
        pairs = members.join(hubs, "sig").where((F.col("label") != F.col("hub_label")) & near)
        pairs = stage(pairs.select(F.least("class", "hub_class").alias("a"), F.greatest("class", "hub_class").alias("b")).distinct(), f"{name}-pairs")
        links = stage(links_of(pairs).select("a", "b"), f"{name}-links")
        unstage(pairs)
        rest = members.join(hubs.select("sig", F.col("hub_class").alias("class")), ["sig", "class"], "left_anti")
        roots = None
        if links.take(1):
            old = labels
            labels, roots = relabel(labels, links, name)
            unstage(old)
            rest = rest.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label"))
        rest = stage(rest.select("sig", *columns, "shares", "label"), f"{name}-rest")
        unstage(links, hubs, members, roots)
        sizes = rest.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"))
        sizes = stage(sizes.where("lo < hi").select("sig", "members"), f"{name}-open")
        still = rest.join(sizes, "sig")
        hubs_per_group = MOST_HUBS
        if refine and sizes.take(1):
            still, more, near = refine(still)
            columns, refine = [*columns, *more], None
        if split and level < MOST_SPLITS and sizes.where(F.col("members") > SPLIT_OVER).take(1):
            level += 1
            still = stage(still, f"{name}-still")
            large = still.where(F.col("members") > SPLIT_OVER)
            keys = stage(split(large.select("class").distinct(), level), f"{name}-split")
            dealt = large.join(keys, "class").where(F.pmod("sig", F.lit(256)) == F.pmod("sig2", F.lit(256)))
            dealt = stage(dealt.withColumn("sig", (F.xxhash64("sig", "sig2").bitwiseAND(F.lit(-256))).bitwiseOR(F.pmod("sig", F.lit(256)))).select("sig", *columns, "shares", "label"), f"{name}-dealt")
            again = dealt.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("sig")
            after = still.where(F.col("members") <= SPLIT_OVER).select("sig", *columns, "shares", "label").unionByName(dealt.join(again, "sig").select("sig", *columns, "shares", "label"))
            members = stage(after, f"{name}-members")
            unstage(still, keys, dealt)
            hubs_per_group = 1
        else:
            members = stage(still.select("sig", *columns, "shares", "label"), f"{name}-members")
        unstage(rest, sizes)
    unstage(members)
    return labels
