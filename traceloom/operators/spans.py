"""Span trees from events: states, waiting, closure, costs, and the time spent suspended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.schema import STATUS_WEIGHT
from traceloom.shared import Tables, materialise

METRICS = ("size", "own_size", "duration", "own_duration", "cached_duration")


def reduce_spans(events: DataFrame) -> DataFrame:
    """One row a span (run_id, seq), as of its last events; events of spans that never spawned are ignored.

    The last lifecycle event by ord decides the status, and a later spawn replaces an earlier span. One aggregate
    with partial sums; no event is gathered.
    """
    own = events.filter(F.col("e").isin("spawn", "start", "end", "error", "cancel"))
    spawned = own.groupBy("run_id", "seq").agg(F.max(F.when(F.col("e") == "spawn", F.col("ord"))).alias("_from"))
    own = own.join(spawned, ["run_id", "seq"]).filter(F.col("ord") >= F.col("_from"))
    last = lambda value, *kinds: F.max_by(F.when(F.col("e").isin(*kinds), value), F.when(F.col("e").isin(*kinds), F.col("ord")))
    status = F.when(F.col("e") == "spawn", "pending").when(F.col("e") == "start", "running").when(F.col("e") == "error", "error").when(F.col("e") == "cancel", "cancelled").when(F.col("cached"), "cached").otherwise("ok")
    filled = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & F.col("e").isin("end", "error"), F.col("ord")))
    return own.groupBy("run_id", "seq").agg(
        last(F.coalesce("name", F.lit("?")), "spawn").alias("name"),
        last(F.col("parent_seq"), "spawn").alias("parent_seq"),
        last(F.col("args"), "spawn").alias("args"),
        last(F.col("ts"), "spawn").alias("spawn_ts"),
        last(F.col("ts"), "start").alias("start_ts"),
        last(F.col("ts"), "end", "error", "cancel").alias("end_ts"),
        F.max_by(status, "ord").alias("status"),
        last(F.col("record_path"), "end").alias("record_path"),
        last(F.col("origin"), "end").alias("origin"),
        last(F.coalesce("err", F.lit("error")), "error").alias("error"),
        *[filled(c).alias(c) for c in METRICS],
    )


def own_traces(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Trace events whose parent span is known."""
    known = spans.select("run_id", F.col("seq").alias("parent_seq"))
    return events.filter("e = 'trace'").join(known, ["run_id", "parent_seq"], "left_semi")


def open_waits(events: DataFrame, legacy: bool = False) -> DataFrame:
    """run_id, seq, kind, target, ids: the newest wait that is still open.

    A wait ends with a resume for the same target, or, of older traces that name none, with any resume that
    would leave it above the stack; an end closes all. `legacy` reads only waits that name their target by id.
    """
    w = Window.partitionBy("run_id", "seq").orderBy("ord")
    marks = events.filter(F.col("e").isin("wait", "resume", "end", "error", "cancel"))
    marks = marks.withColumn("kind", F.col("on.kind"))
    usable = (F.col("kind") == "span") & (F.col("on.id").isNotNull() if legacy else F.coalesce("on.seq", "on.id").isNotNull()) | (F.col("kind") == "group")
    marks = marks.filter((F.col("e") != "wait") | usable)
    closes = F.max(F.when(F.col("e").isin("end", "error", "cancel"), F.col("ord"))).over(Window.partitionBy("run_id", "seq"))
    marks = marks.withColumn("_closed", closes).filter(F.col("_closed").isNull() | (F.col("ord") > F.col("_closed"))).filter(F.col("e").isin("wait", "resume"))
    # The stack's height after each event; a resume of an empty stack changes nothing.
    raw = F.sum(F.when(F.col("e") == "wait", 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("_raw", raw)
    marks = marks.withColumn("_height", F.col("_raw") - F.least(F.lit(0), F.min("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    later = F.min("_height").over(w.rowsBetween(0, Window.unboundedFollowing))
    marks = marks.withColumn("_later", later).filter((F.col("e") == "wait") & (F.col("_later") >= F.col("_height")))
    top = marks.groupBy("run_id", "seq").agg(F.max_by(F.struct("kind", F.coalesce("on.seq", "on.id").alias("target"), F.col("on.ids").alias("ids")), "ord").alias("top"))
    return top.select("run_id", "seq", "top.*")


def status_weight(status: Column) -> Column:
    out = F.lit(0)
    for name, weight in STATUS_WEIGHT.items():
        out = F.when(status == name, weight).otherwise(out)
    return out


def effective_status(spans: DataFrame, waits: DataFrame) -> DataFrame:
    """run_id, seq, effective: a span that waits has the status of what it waits for, a group's the weightiest.

    Chains are followed by pointer jumping, so rounds grow with the logarithm of a chain. What waits for itself
    in the end is running; an unknown target is pending.
    """
    terminal = ("ok", "cached", "error", "cancelled")
    own = spans.select("run_id", "seq", "status")
    single = waits.filter("kind = 'span'").select("run_id", "seq", "target")
    live = own.join(single, ["run_id", "seq"], "left").withColumn("target", F.when(~F.col("status").isin(*terminal), F.col("target")))
    table = materialise(live.select("run_id", "seq", "status", "target"), "waiting")
    while not table.filter("target is not null").isEmpty() and not _is_circular(table):
        ahead = table.select("run_id", F.col("seq").alias("target"), F.col("status").alias("_s"), F.col("target").alias("_t"), F.lit(True).alias("_known"))
        waiting = table.filter("target is not null").join(ahead, ["run_id", "target"], "left")
        jumped = waiting.select("run_id", "seq", F.when(F.col("_known").isNull(), "pending").otherwise(F.col("_s")).alias("status"), F.col("_t").alias("target"))
        table = materialise(table.filter("target is null").unionByName(jumped), "waiting")
    done = table.select("run_id", "seq", F.when(F.col("target").isNotNull(), "running").otherwise(F.col("status")).alias("effective"))
    groups = waits.filter("kind = 'group'").join(own.filter(~F.col("status").isin(*terminal)), ["run_id", "seq"], "left_semi")
    members = groups.select("run_id", "seq", F.explode_outer("ids").alias("member"))
    found = members.join(done.select("run_id", F.col("seq").alias("member"), "effective"), ["run_id", "member"], "left")
    found = found.withColumn("effective", F.when(F.col("member").isNull(), "ok").otherwise(F.coalesce("effective", F.lit("pending"))))
    merged = found.groupBy("run_id", "seq").agg(F.max_by("effective", status_weight(F.col("effective"))).alias("_group"))
    return done.join(merged, ["run_id", "seq"], "left").select("run_id", "seq", F.coalesce("_group", "effective").alias("effective"))


def _is_circular(table: DataFrame) -> bool:
    """Whether all that still waits, waits for something that waits."""
    waiting = table.filter("target is not null")
    return waiting.join(waiting.select("run_id", F.col("seq").alias("target")), ["run_id", "target"], "left_anti").isEmpty()


def closure(edges: DataFrame) -> DataFrame:
    """anc, desc, dist over edges(child, parent) of a forest, each node also its own; pointer jumping.

    A round doubles the distance covered, and only its newest, farthest pairs are extended and written, so each pair is made once.
    """
    tables = Tables(edges.sparkSession, "closure")
    nodes = edges.select(F.col("child").alias("n")).union(edges.select(F.col("parent").alias("n"))).distinct()
    own = nodes.select(F.col("n").alias("anc"), F.col("n").alias("desc"), F.lit(0).cast("bigint").alias("dist"))
    pairs, reach = tables.save(own.unionByName(edges.select(F.col("parent").alias("anc"), F.col("child").alias("desc"), F.lit(1).cast("bigint").alias("dist")))), 1
    while True:
        upper = pairs.filter("dist > 0").select("anc", F.col("desc").alias("mid"), F.col("dist").alias("_up"))
        lower = pairs.filter(F.col("dist") == reach).select(F.col("anc").alias("mid"), "desc")
        farther = tables.save(upper.join(lower, "mid").select("anc", "desc", (F.col("_up") + reach).alias("dist")))
        if farther.isEmpty():
            return pairs
        pairs, reach = tables.together(farther, tables.written), reach * 2


def roll_up(own: DataFrame, pairs: DataFrame, key: str = "key", value: str = "amount") -> DataFrame:
    """anc, key, amount: sums over each node and all below it. own(node, key, amount), pairs as of closure()."""
    summed = own.groupBy("node", key).agg(F.sum(value).alias(value))  # before it is spread over ancestors
    return summed.join(pairs, summed["node"] == pairs["desc"]).groupBy("anc", key).agg(F.sum(value).alias(value))


def _jumps(edges: DataFrame, tables: Tables):
    """Tables of (node, up) with the ancestor 1, 2, 4, ... above, each written; they end when no node has one."""
    jump = tables.save(edges.select(F.col("child").alias("node"), F.col("parent").alias("up")))
    while not jump.isEmpty():
        yield jump
        jump = tables.save(jump.withColumnRenamed("up", "_mid").join(jump.select(F.col("node").alias("_mid"), "up"), "_mid").select("node", "up"))


def roll_up_tree(own: DataFrame, edges: DataFrame, key: str = "key", value: str = "amount") -> DataFrame:
    """As roll_up(), without the pairs: after round k each node has the sums of what is less than 2^k below it.

    A round adds to each node the sums of the nodes 2^k below; its rows are at most the nodes and keys, and the rounds the
    logarithm of the depth. edges(child, parent) of a forest.
    """
    sums_of, ways = Tables(own.sparkSession, "roll-up"), Tables(own.sparkSession, "jumps")
    sums = sums_of.save(own.groupBy("node", key).agg(F.sum(value).alias(value)))
    for jump in _jumps(edges, ways):
        lifted = sums.join(jump, "node").groupBy(F.col("up").alias("node"), key).agg(F.sum(value).alias(value))
        sums = sums_of.save(sums.unionByName(lifted).groupBy("node", key).agg(F.sum(value).alias(value)))
        sums_of.drop_all_but(sums_of.written[-1])
    ways.drop_all_but()
    return sums.withColumnRenamed("node", "anc")


def rolled_cost(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """anc, key, amount of the costs in traces(node, cost map)."""
    own = traces.select("node", F.explode("cost").alias("key", "amount"))
    return roll_up(own.filter(F.col("amount").isNotNull()), pairs)


def depths(edges: DataFrame, roots: DataFrame, label: str = "depth") -> DataFrame:
    """node, depth: distance from a root, a level a round. edges(child, parent), roots(node)."""
    frontier, depth = roots.select("node", F.lit(0).cast("bigint").alias(label)), 0
    levels = [frontier]
    while True:
        depth += 1
        below = edges.join(frontier.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node"), F.lit(depth).cast("bigint").alias(label))
        frontier = materialise(below, "depth")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def active_time(marks: DataFrame, key: list[str], time: str, step: str, order: list[str]) -> DataFrame:
    """key, active: how long the running sum of `step` stands above zero; the union of intervals, without pairing ends."""
    w = Window.partitionBy(*key).orderBy(*order)
    level = F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spent = marks.withColumn("_level", level).withColumn("_next", F.lead(time).over(w))
    return spent.groupBy(*key).agg(F.sum(F.when(F.col("_level") > 0, F.col("_next") - F.col(time)).otherwise(0)).alias("active"))


def sessions(rows: DataFrame, key: list[str], time: str, order: list[str], gap: int) -> DataFrame:
    """rows with `session`, from 1 on within their key: a new one after a gap of more than `gap`."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = F.when(F.col(time) - F.lag(time).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def next_after(rows: DataFrame, key: list[str], order: str, first: Column, then: Column, name: str) -> DataFrame:
    """Rows of the kind `first`, with the `order` of the next of the kind `then` in their key."""
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.min(F.when(then, F.col(order))).over(after)).filter(first)


def peak(marks: DataFrame, key: list[str], step: str, order: list[str]) -> DataFrame:
    """key, peak: the highest running sum of `step`."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("_level", F.sum(step).over(w)).groupBy(*key).agg(F.max("_level").alias("peak"))


def own_duration(wall: Column, suspended: Column) -> Column:
    return F.greatest(F.lit(0.0), wall - F.coalesce(suspended, F.lit(0.0)))


def deltas(traces: DataFrame, key: list[str], time: str, order: list[str], start: Column | None = None) -> DataFrame:
    """traces with delta: time since the one before, or since the start, or 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.col(time) if start is None else F.coalesce(start, F.col(time))
    return traces.withColumn("delta", F.col(time) - F.coalesce(F.lag(time).over(w), first))


def stitch(children: DataFrame, root: str, first_seq: int = 1) -> DataFrame:
    """seq, parent_seq, record_id, depth, path of a recalled record's tree, depth first; a shared child comes once for each way to it.

    children(record_id, child_index, child_record_id). One round a level; a path that comes back to itself ends there.
    """
    roots = children.sparkSession.createDataFrame([(root,)], "root string")
    return stitch_each(children, roots, first_seq).drop("root")


def stitch_each(children: DataFrame, roots: DataFrame, first_seq: int = 1) -> DataFrame:
    """root and the columns of stitch() of the tree of each of roots(root), each numbered from first_seq on."""
    level = roots.select("root", F.col("root").alias("record_id"), F.array().cast("array<int>").alias("path"), F.array("root").alias("trail"))
    found = [level]
    while True:
        below = level.join(children, "record_id").filter(~F.array_contains("trail", F.col("child_record_id")))
        level = materialise(below.select("root", F.col("child_record_id").alias("record_id"), F.concat("path", F.array(F.col("child_index"))).alias("path"), F.concat("trail", F.array("child_record_id")).alias("trail")), "stitch")
        if level.isEmpty():
            break
        found.append(level)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    numbered = in_order(rows, "root", "path", "seq").withColumn("seq", F.col("seq") + first_seq - 1)
    up = numbered.select("root", F.col("path").alias("_up"), F.col("seq").alias("parent_seq"))
    numbered = numbered.withColumn("_up", F.when(F.size("path") > 0, F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))))
    return numbered.join(up, ["root", "_up"], "left").select("root", "seq", "parent_seq", "record_id", F.size("path").cast("bigint").alias("depth"), "path")


def in_order(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """rows with their number from 1 on within their key, by `order`, which is unique there; however many a key has, no task holds them all.

    Rows are dealt by ranges and sorted, and a row's number is its place in its range and what is before that.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, key, order).sortWithinPartitions(key, order)
    dealt = materialise(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = dealt.join(bases, "_part").withColumn("_at", F.col("_base") + F.col("_at"))
    first = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"))
    return placed.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, (F.col("_at") - F.col("_first") + 1).cast("bigint")).drop("_part", "_at", "_base", "_key", "_first")


def within(pairs: DataFrame, ancestor: str) -> DataFrame:
    """desc: a node and all below it."""
    return pairs.filter(F.col("anc") == ancestor).select("desc")


def above_flagged(flagged: DataFrame, pairs: DataFrame) -> DataFrame:
    """anc: nodes that have one of flagged(node) among themselves and what is below them."""
    return pairs.join(flagged.select(F.col("node").alias("desc")), "desc", "left_semi").select("anc").distinct()


def flagged_tree(flagged: DataFrame, edges: DataFrame) -> DataFrame:
    """As above_flagged(), from edges(child, parent) of a forest, in rounds of at most its nodes."""
    tables, ways = Tables(edges.sparkSession, "flagged"), Tables(edges.sparkSession, "jumps")
    marked = tables.save(flagged.select("node").distinct())
    for jump in _jumps(edges, ways):
        marked = tables.save(marked.union(marked.join(jump, "node").select("up")).distinct())
        tables.drop_all_but(tables.written[-1])
    ways.drop_all_but()
    return marked.withColumnRenamed("node", "anc")


def refreshed_labels(changed: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(node, label) of what changed(node) and all above it, up to the roots."""
    return labels.join(flagged_tree(changed, edges).withColumnRenamed("anc", "node"), "node", "left_semi")


def preorder(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth, nth: each tree depth first, siblings by name; a level a round."""
    level = materialise(roots.select(F.col("node").alias("root"), "node", F.array("node").alias("path")), "order")
    found = [level]
    while True:
        below = level.withColumnRenamed("node", "parent").join(edges, "parent").select("root", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"))
        level = materialise(below, "order")
        if level.isEmpty():
            break
        found.append(level)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return in_order(rows, "root", "path", "nth").select("root", "node", (F.size("path") - 1).cast("bigint").alias("depth"), "nth")


def merged_events(traces: DataFrame, spawns: DataFrame, key: str = "record_id") -> DataFrame:
    """Traces and spawns of records as one ordered stream: by time, traces first at equal times, then in their own order."""
    both = traces.withColumn("kind", F.lit("trace")).unionByName(spawns.withColumn("kind", F.lit("spawn")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("ts", F.when(F.col("kind") == "trace", 0).otherwise(1), "ord")
    return both.withColumn("place", F.row_number().over(order).cast("bigint"))


def child_spans(children: DataFrame, start: Column, child_start: Column, child_end: Column) -> DataFrame:
    """children with their times from their record's start on, not below zero."""
    rel = lambda c: F.greatest(c - start, F.lit(0))
    return children.withColumn("start_rel", rel(child_start)).withColumn("end_rel", rel(child_end))


def elapsed(events: DataFrame, key: list[str], time: str) -> DataFrame:
    """events with the time since their key's first."""
    first = events.groupBy(*key).agg(F.min(time).alias("_first"))
    return events.join(first, key).withColumn("elapsed", F.col(time) - F.col("_first")).drop("_first")


def named(events: DataFrame, names: DataFrame) -> DataFrame:
    """events with the name of their span, `task-{seq}` where none is known."""
    known = names.select("run_id", "seq", F.col("name").alias("_name"))
    return events.drop("name").join(known, ["run_id", "seq"], "left").withColumn("name", F.coalesce("_name", F.concat(F.lit("task-"), F.col("seq").cast("string")))).drop("_name")
