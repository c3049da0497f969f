"""Categories of any depth: ancestors by pointer doubling, circles, and faults of a changed layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.sources.staging import discard, staged


def _jumped(open_: DataFrame, closed: DataFrame, joined: Column, of: str) -> DataFrame:
    """Nodes after a jump: each takes over the pointer, and what stands before it, of the node that it points at."""
    ahead = open_.unionByName(closed).select(F.col("id").alias("_at"), F.col("up").alias("_up"), F.col(of).alias("_before"))
    return open_.join(ahead, F.col("up") == F.col("_at")).select("id", F.col("_up").alias("up"), joined.alias(of))


def paths(nodes: DataFrame, own: Column, root: int = 0) -> DataFrame:
    """Rows (id, path) of the nodes (id, parent_id) below the root: path holds ``own`` of all ancestors, the topmost first, and of the
    node itself. Nodes below a missing parent or in a circle, and those below these, have no row.

    Each round a pointer reaches twice as far, so the rounds are the logarithm of the depth. Nodes of every depth below
    the greatest exist, so a round in which none reaches the root leaves only circles. Ids are unique.
    """
    state = staged(nodes.select("id", F.col("parent_id").alias("up"), F.array(own).alias("path")), "tree")
    done, kept = state.where(F.col("up") == root), [state]
    open_ = state.where(F.col("up") != root)
    left = open_.count()
    while left:
        state = staged(_jumped(open_, done, F.concat("_before", "path"), "path"), "tree")
        kept.append(state)
        reached, open_ = state.where(F.col("up") == root), state.where(F.col("up") != root)
        done, now = done.unionByName(reached), open_.count()
        if now == left and reached.isEmpty():
            break
        left = now
    out = staged(done.select("id", "path"), "paths")
    discard(*kept)
    return out


def circles(nodes: DataFrame, root: int = 0) -> DataFrame:
    """Ids of nodes (id, parent_id) that are their own ancestors.

    Nodes that reach the root, or a missing parent, fall out as pointers double. After as many steps as nodes are left,
    what the others point at are the circles themselves, whole.
    """
    state = staged(nodes.select("id", F.col("parent_id").alias("up"), F.lit(None).cast("int").alias("none")).where(F.col("up") != root), "circles")
    kept, steps = [state], 1
    left = state.count()
    while left and steps < 2 * left:
        state = staged(_jumped(state, state.limit(0), F.lit(None).cast("int"), "none"), "circles")
        kept.append(state)
        left, steps = state.count(), 2 * steps
    out = staged(state.select(F.col("up").alias("id")).distinct(), "circles")
    discard(*kept)
    return out


def tag_tree(tags: DataFrame) -> DataFrame:
    """Categories (type 1) below the roots (parent 0): depth, path of names, and a key that sorts them in pre-order."""
    own = tags.where("tag_type = 1")
    place = F.struct(F.col("sort_order").alias("s"), F.col("id").alias("i"), F.col("tag_name").alias("name"))
    found = paths(own, place).join(own.select("id", "tag_name"), "id")
    key = F.transform("path", lambda p: F.struct(p["s"].alias("s"), p["i"].alias("i")))
    return found.select("id", "tag_name", (F.size("path") - 1).alias("depth"), F.transform("path", lambda p: p["name"]).alias("path"), key.alias("key"))


def descendants(nodes: DataFrame) -> DataFrame:
    """Rows (ancestor, descendant) of all pairs; as many as all depths together."""
    found = paths(nodes, F.col("id"))
    return found.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("ancestor"), F.col("id").alias("descendant"))


def layout_faults(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """Over categories (id, name, parent_id) and moves (id, parent_id): rows (id, fault) of the moved ones, by the first rule
    that is broken: unknown, self (its own parent), parent (no such category), circle, name (a sibling of the same name). Of several
    moves of one id one counts."""
    new = moved.dropDuplicates(["id"]).select("id", F.col("parent_id").alias("_to"))
    after = nodes.join(new, "id", "left").select("id", "name", F.coalesce("_to", "parent_id").alias("parent_id"))
    in_circle = circles(after).withColumn("_circle", F.lit(True))
    twins = after.groupBy("parent_id", "name").agg(F.count("*").alias("_same"))
    known = after.join(twins, ["parent_id", "name"]).select("id", "_same")
    parents = nodes.select(F.col("id").alias("_to"), F.lit(True).alias("_parent"))
    rows = new.join(known, "id", "left").join(parents, "_to", "left").join(in_circle, "id", "left")
    fault = F.when(F.col("_same").isNull(), "unknown").when(F.col("_to") == F.col("id"), "self").when((F.col("_to") != 0) & F.col("_parent").isNull(), "parent").when(F.col("_circle"), "circle").when(F.col("_same") > 1, "name")
    return rows.select("id", fault.alias("fault"))
