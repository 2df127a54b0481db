"""Traversals of object and commit graphs: reachability, copying, history, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.digest import NATIVE, object_digest
from siltstone.sources.tables import write_scratch


#: Rounds of a traversal before chains are looked for.
SHALLOW = 10


def edges(objects: DataFrame) -> DataFrame:
    """parent, child for every reference of every object."""
    return objects.select(F.col("digest").alias("parent"), F.explode("refs").alias("child"))


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """node of everything reachable from roots (node) along links (parent, child), roots included.

    Breadth first; each node is expanded once, with an anti-join against what
    was reached.  Long chains would take a round a link, so after ``SHALLOW``
    rounds shortcuts are made: a node with a single child skips to where the chain
    below it leads, which pointer doubling finds in a logarithmic number of
    rounds, and the nodes of the chains passed over are added at the end.  What
    was reached is written out as one table whenever its parts would become many.
    """
    links = write_scratch(links.select(F.col("parent").alias("node"), "child").distinct(), "links")
    nexts, members = links, None
    seen = write_scratch(roots.select("node").distinct(), "reached")
    frontier, parts, rounds = seen, 1, 0
    while True:
        rounds += 1
        if rounds == SHALLOW:
            nexts, members = _chains(links)
        step = nexts.join(frontier, "node").select(F.col("child").alias("node")).distinct()
        frontier = write_scratch(step.join(seen, "node", "left_anti"), "reached")
        if frontier.isEmpty():
            break
        seen, parts = seen.union(frontier), parts + 1
        if parts == 8:
            seen, parts = write_scratch(seen, "reached"), 1
    return _passed(members, seen)


def _chains(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that skip chains, and steps (node, child, span) of 1, 2, 4, ... links along them.

    A chain is a run of nodes with one child each.  ``child`` of a skipping link
    is the first node on the way that has none or several children.
    """
    only = links.groupBy("node").agg(F.count("*").alias("n"), F.first("child").alias("child"))
    chain = write_scratch(only.where("n = 1").select("node", "child"), "chains")
    inner = chain.join(chain.select(F.col("node").alias("child")), "child", "left_semi")  # whose child goes on along a chain
    if inner.isEmpty():
        return links, None
    steps, jump, span = [], chain, 1
    while True:
        steps.append(jump.withColumn("span", F.lit(span)))
        far = write_scratch(jump.alias("a").join(jump.alias("b"), F.col("a.child") == F.col("b.node"), "left").select(F.col("a.node").alias("node"), F.coalesce("b.child", "a.child").alias("child"), F.col("b.child").isNotNull().alias("more")), "chains")
        jump, span = far.select("node", "child"), span * 2
        if far.where("more").isEmpty() or span > 1 << 40:
            break
    several = links.join(chain.select("node"), "node", "left_anti")
    return write_scratch(several.unionByName(jump.select("node", "child")), "links"), steps


def _passed(steps: list[DataFrame] | None, seen: DataFrame) -> DataFrame:
    """The nodes of chains between the reached ones: halves of the longest jumps, then of those, and so on."""
    found = seen
    for step in reversed(steps or []):
        found = write_scratch(found.union(step.drop("span").join(found, "node").select(F.col("child").alias("node"))).distinct(), "reached")
    return found


def copy_missing(source: DataFrame, target: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects reachable from roots (node) that the target lacks, each once."""
    wanted = reachable(edges(source), roots).withColumnRenamed("node", "digest")
    return source.join(wanted, "digest", "left_semi").dropDuplicates(["digest"]).join(target.select("digest"), "digest", "left_anti")


def history(commits: DataFrame, head: bytes | DataFrame) -> DataFrame:
    """Commits (digest, parents, seconds, ...) reachable from a head, newest first, then by digest."""
    spark = commits.sparkSession
    roots = spark.createDataFrame([(head,)], "node binary") if isinstance(head, bytes) else head
    links = commits.select(F.col("digest").alias("parent"), F.explode("parents").alias("child"))
    return commits.join(reachable(links, roots).withColumnRenamed("node", "digest"), "digest", "left_semi").orderBy(F.desc("seconds"), "digest")


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their places, from 1, in an order that no two share; ranges are numbered apart, so no task sees all."""
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = write_scratch(dealt, "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_before"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_before").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, within.cast("long")).join(sizes, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def check_integrity(objects: DataFrame, hash_name: str = NATIVE) -> DataFrame:
    """stored, calculated for objects whose digest is not that of their content and of their children's content.

    Digests are calculated from calculated ones below, so a bad leaf shows in
    all that refer to it.  Each round does the objects whose children are done.
    An object that refers to a missing one is told with a null digest.
    """
    objects = write_scratch(objects.select("digest", "blob", "refs").dropDuplicates(["digest"]), "objects")  # each round reads it
    leaves = objects.where(F.size("refs") == 0)
    done = write_scratch(leaves.select("digest", object_digest(F.col("blob"), F.col("refs"), hash_name).alias("calculated")), "checked")
    inner = objects.where(F.size("refs") > 0)
    while True:
        waiting = inner.join(done.select("digest"), "digest", "left_anti")
        refs = waiting.select("digest", F.posexplode("refs").alias("at", "child"))
        known = refs.join(done.withColumnRenamed("digest", "child"), "child").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", "calculated"))).alias("found"))
        ready = waiting.join(known, "digest").where(F.size("found") == F.size("refs"))
        new = write_scratch(ready.select("digest", object_digest(F.col("blob"), F.col("found.calculated"), hash_name).alias("calculated")), "checked")
        if new.isEmpty():
            break
        done = done.union(new)
    all_done = done.union(waiting.select("digest", F.lit(None).cast("binary").alias("calculated")))
    return all_done.where(~F.col("digest").eqNullSafe(F.col("calculated"))).select(F.col("digest").alias("stored"), "calculated")


def within_depth(objects: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """digest, depth of objects at most ``depth`` references below roots (node), each once with its least depth."""
    links = write_scratch(edges(objects).distinct(), "links")
    seen = write_scratch(roots.select(F.col("node").alias("digest"), F.lit(0).alias("depth")).distinct(), "reached")
    frontier = seen
    for d in range(1, depth + 1):
        step = links.join(frontier.select(F.col("digest").alias("parent")), "parent").select(F.col("child").alias("digest")).distinct()
        frontier = write_scratch(step.join(seen, "digest", "left_anti").select("digest", F.lit(d).alias("depth")), "reached")
        if frontier.isEmpty():
            break
        seen = write_scratch(seen.unionByName(frontier), "reached")
    return seen


def check_to_depth(objects: DataFrame, roots: DataFrame, depth: int, hash_name: str = NATIVE) -> DataFrame:
    """stored, calculated, depth for objects at most ``depth`` below roots whose own content does not have their digest."""
    near = within_depth(objects, roots, depth)
    return check_each(objects.join(near, "digest"), hash_name, ["depth"])


def check_each(objects: DataFrame, hash_name: str = NATIVE, more: list[str] | None = None) -> DataFrame:
    """stored, calculated for objects whose own content does not have their digest, without regard to others."""
    return objects.withColumn("calculated", object_digest(F.col("blob"), F.col("refs"), hash_name)).where("digest <> calculated").select(F.col("digest").alias("stored"), "calculated", *(more or []))
