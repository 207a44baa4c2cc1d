"""The catalogue of contract queries: each operator over a projection of the fixture tables, with SQL for the same rows.

events are a record stack (computation = user, newest by event_id) and an event stream; region, nation, customer,
orders and lineitem are a span tree; documents are content-addressed values, labels their roots and overlay;
orders are runs of customers; conversations are ordered traces; pages are texts to extract from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom.functions import formats, keys, versions
from traceloom.functions.codecs import result_field
from traceloom.operators import clock, inspection, lifecycle, lookup, memo_map, spans
from traceloom.sources import traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records of computations."""
    error = F.when(F.col("event_type") == "error", F.lit("error"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("comp_id"), F.col("event_id").alias("record_id"), F.col("event_type").alias("version"), error.alias("error"),
        F.col("props").alias("body_hash"), F.sha2(F.concat("event_type", "props"), 256).alias("result_hash"), "value", micros(F.col("ts")).alias("ts_created"),
    )


def micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def cents(amount):
    return F.round(amount * 100).cast("bigint")


MICROS = "epoch_us(ts)"


# Looking up.


@query("""SELECT user_id AS comp_id, event_id AS record_id, event_type AS version, epoch_us(ts) AS ts_created
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""")
def stack_latest_ok(spark, sf_dir):
    """The newest record without error of each computation."""
    return lookup.latest(stack(spark, sf_dir)).select("comp_id", "record_id", "version", "ts_created")


@query("""SELECT user_id AS comp_id, event_id AS record_id, props AS body_hash
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1""")
def stack_latest_version(spark, sf_dir):
    """The newest record of one version."""
    return lookup.latest(stack(spark, sf_dir), version="purchase").select("comp_id", "record_id", "body_hash")


@query("""SELECT user_id AS comp_id, event_id AS record_id, event_type AS version
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE props = '{"k": 7}' AND event_type <> 'error') WHERE n = 1""")
def stack_latest_body(spark, sf_dir):
    """The newest record made by one code."""
    where = lookup.memo_predicate(body_hash='{"k": 7}') & F.col("error").isNull()
    return lookup.newest(stack(spark, sf_dir), ["comp_id"], where=where).select("comp_id", "record_id", "version")


@query("""SELECT comp_id, record_id, nth, version FROM (SELECT user_id AS comp_id, event_id AS record_id, event_type AS version,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 3""")
def stack_iter_top3(spark, sf_dir):
    """The three newest records of each computation, errors too: a report of that length."""
    top = lookup.newest_first(stack(spark, sf_dir), ["comp_id"], most=3)
    return top.select("comp_id", "record_id", F.col("nth").cast("bigint").alias("nth"), "version")


@query("""SELECT user_id AS comp_id, event_id AS record_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events)""")
def stack_history(spark, sf_dir):
    """Each computation's records, newest first."""
    return lookup.newest_first(stack(spark, sf_dir), ["comp_id"]).select("comp_id", "record_id", F.col("nth").cast("bigint").alias("nth"))


@query("""SELECT user_id, event_type, count(*) AS n,
sha256('{"args":{"__dict__":{"event_type":"' || event_type || '","user_id":' || user_id || '}},"identity":"emit"}') AS comp_id FROM events GROUP BY user_id, event_type""")
def comp_id(spark, sf_dir):
    """Computation keys of calls, and how often each was made."""
    calls = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return calls.withColumn("comp_id", keys.comp_id(calls, "emit", ["user_id", "event_type"]))


@query("""SELECT o_custkey AS comp_id, o_orderkey AS record_id, n_dangling FROM orders JOIN
(SELECT l_orderkey, count(*) AS n_dangling FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def cas_dangling(spark, sf_dir):
    """Records with children that are gone: orders with lines whose part is not stored."""
    stored = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("record_id"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("child_record_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("comp_id"), F.col("o_orderkey").alias("record_id"))
    return orders.join(lookup.dangling(children, stored), "record_id").select("comp_id", "record_id", "n_dangling")



@query("""SELECT comp_id, record_id FROM (SELECT o_custkey AS comp_id, o_orderkey AS record_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))) WHERE n = 1""")
def stack_find_intact(spark, sf_dir):
    """The newest record of each computation all of whose children are stored."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("comp_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("ts_created"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("child_record_id"))
    stored = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("record_id"))
    return lookup.newest(lookup.without_dangling(orders, children, stored), ["comp_id"]).select("comp_id", "record_id")


@query("""SELECT user_id AS comp_id, CASE WHEN user_id % 5 = 0 THEN first_event ELSE event_id END AS record_id, CASE WHEN user_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS donor_comp_id,
CASE WHEN user_id % 5 = 0 THEN 'carried' ELSE 'recalled' END AS origin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error')
LEFT JOIN (SELECT user_id - 1 AS before, min(event_id) AS first_event FROM events GROUP BY user_id) d ON before = user_id
WHERE n = 1 AND (user_id % 5 <> 0 OR first_event IS NOT NULL)
UNION ALL SELECT user_id - 1, min(event_id), user_id, 'carried' FROM events WHERE user_id % 5 = 1 AND user_id - 1 NOT IN (SELECT user_id FROM events WHERE event_type <> 'error') GROUP BY user_id
UNION ALL SELECT user_id, event_id, user_id, 'recalled' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error')
WHERE n = 1 AND user_id % 5 = 0 AND user_id + 1 NOT IN (SELECT user_id FROM events)""")
def overlay_resolve(spark, sf_dir):
    """Records as found, with an overlay in front of them: every fifth computation is pinned to the next one's oldest record."""
    records = stack(spark, sf_dir)
    oldest = records.groupBy("comp_id").agg(F.min("record_id").alias("donor_record_id")).filter("comp_id % 5 = 1")
    pins = oldest.select((F.col("comp_id") - 1).alias("comp_id"), F.col("comp_id").alias("donor_comp_id"), "donor_record_id")
    return lookup.overlaid(lookup.latest(records), pins, records).select("comp_id", "record_id", "donor_comp_id", "origin")


@query("""SELECT comp_id, run_id, carried_as FROM (SELECT DISTINCT p_size AS comp_id, p_brand AS run_id, p_partkey % 40 AS carried_as FROM part) WHERE comp_id IN (SELECT o_custkey FROM orders)""")
def overlay_backlinks(spark, sf_dir):
    """Which runs pinned a computation's records, where it has any."""
    overlay = table(spark, sf_dir, "part").select(F.col("p_brand").alias("run_id"), (F.col("p_partkey") % 40).alias("comp_id"), F.col("p_size").alias("donor_comp_id"))
    return lookup.backlinks(overlay, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("comp_id")))


@query("""WITH r AS (SELECT o_custkey AS comp_id, o_orderkey AS record_id, o_orderdate AS made FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey + 7 * l_partkey NOT IN (SELECT o_orderkey FROM orders)))
SELECT comp_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY made DESC, record_id DESC) AS n FROM r) WHERE n = 1""")
def lookup_find(spark, sf_dir):
    """The newest record of each computation without error, with all its children and with its payload."""
    error = F.when(F.col("o_orderstatus") == "P", F.lit("failed"))
    records = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("comp_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("ts_created"), error.alias("error"), F.col("o_orderpriority").alias("result_hash"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_orderkey") + 7 * F.col("l_partkey")).alias("child_record_id"))
    blobs = records.select(F.col("result_hash").alias("content_hash")).distinct().filter("content_hash <> '1-URGENT'").withColumn("payload", F.lit("{}"))
    return lookup.find(records, children, blobs).select("comp_id", "record_id")


@query("""SELECT u.user_id AS comp_id, coalesce(l.doc_id, h.event_id) AS record_id, CASE WHEN l.doc_id IS NOT NULL THEN 'carried' WHEN h.event_id IS NOT NULL THEN 'recalled' ELSE 'created' END AS origin
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN labels l ON l.doc_id = u.user_id
LEFT JOIN (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase' AND value > 150) WHERE n = 1) h ON h.user_id = u.user_id""")
def resolve_origin(spark, sf_dir):
    """Carried, recalled or created, for each computation asked for."""
    records = stack(spark, sf_dir)
    found = lookup.newest(records, ["comp_id"], where=(F.col("version") == "purchase") & (F.col("value") > 150))
    pins = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comp_id"), F.col("doc_id").alias("donor_record_id"))
    return lookup.resolve(records.select("comp_id").distinct(), found, pins).select("comp_id", "record_id", "origin")


@query("""SELECT user_id AS comp_id, event_type AS version, count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type || props) AS results,
count(DISTINCT event_type || props) > 1 AS nondeterministic FROM events GROUP BY user_id, event_type""")
def nondeterminism(spark, sf_dir):
    """Digest of each computation's versions: records, errors, different results."""
    digest = lookup.result_digest(stack(spark, sf_dir).withColumnRenamed("value", "duration"))
    return digest.drop("durations")


# Content-addressed values and garbage.


@query("""SELECT sha256(text) AS content_hash, count(*) AS refs, CAST(max(length(text)) AS BIGINT) AS size, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text)""")
def cas_dedup(spark, sf_dir):
    """Values stored once, by content."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), keys.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("bigint").alias("size"))
    return lookup.stored_once(docs).withColumnRenamed("first", "first_doc")



@query("""SELECT CAST(sum(length(text)) AS BIGINT) AS size, CAST((SELECT sum(length(text)) FROM (SELECT DISTINCT text FROM documents)) AS BIGINT) AS own_size, count(*) AS refs, count(DISTINCT text) AS blobs FROM documents""")
def cas_sizes(spark, sf_dir):
    """What all values take, and what is stored of them."""
    return lookup.payload_sizes(cas_dedup(spark, sf_dir))



def _blobs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), keys.content_hash(F.col("text")).alias("result_hash"))
    live = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"))
    return lifecycle.sweep(docs, docs.select(F.col("result_hash").alias("content_hash")).distinct(), live)


@query("""SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def gc_sweep(spark, sf_dir):
    """Values that nothing live refers to."""
    return _blobs(spark, sf_dir)["removed_blobs"]


@query("""SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def gc_live(spark, sf_dir):
    """Values that stay."""
    return _blobs(spark, sf_dir)["blobs"]


def tree_edges(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """child, parent of the span tree; nodes are named by level and key."""
    name = lambda level, *c: F.concat(F.lit(level), F.concat_ws(".", *[F.col(x).cast("string") for x in c]))
    edges = [
        table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")),
        table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")),
        table(spark, sf_dir, "orders").select(name("o", "o_orderkey").alias("child"), name("c", "o_custkey").alias("parent")),
    ]
    if lines:
        edges.append(table(spark, sf_dir, "lineitem").select(name("l", "l_orderkey", "l_linenumber").alias("child"), name("o", "l_orderkey").alias("parent")).distinct())
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


@query("""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2)), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)), l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT * FROM o))
SELECT 'r' AS level, 2::BIGINT AS live UNION ALL SELECT 'n', count(*) FROM n UNION ALL SELECT 'c', count(*) FROM c UNION ALL SELECT 'o', count(*) FROM o UNION ALL SELECT 'l', count(*) FROM l""")
def gc_mark_closure(spark, sf_dir):
    """How many nodes of each level the roots reach."""
    roots = table(spark, sf_dir, "region").filter("r_regionkey in (0, 2)").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    edges = tree_edges(spark, sf_dir).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return lifecycle.reachable(roots, edges).groupBy(F.substring("node", 1, 1).alias("level")).agg(F.count(F.lit(1)).alias("live"))


# Spans.


@query("""SELECT user_id, event_id AS spawn, ended FROM (SELECT user_id, event_id, event_type,
min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ended FROM events) WHERE event_type = 'signup'""")
def span_pairs(spark, sf_dir):
    """Each spawn with the end that follows it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    found = spans.next_after(events, ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", "ended")
    return found.select("user_id", F.col("event_id").alias("spawn"), "ended")



def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lifecycle events: a run a hundred users, a span a user."""
    kind = F.when(F.col("event_type") == "signup", "spawn").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "cancel").when(F.col("event_type") == "purchase", "end").otherwise("error")
    none = lambda t: F.lit(None).cast(t)
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 100).cast("string").alias("run_id"), F.col("event_id").alias("ord"), kind.alias("e"), F.col("user_id").cast("int").alias("seq"),
        none("int").alias("parent_seq"), F.col("props").alias("name"), none("string").alias("args"), F.col("event_id").cast("double").alias("ts"), (F.col("value") > 50).alias("cached"),
        none("string").alias("record_path"), none("string").alias("origin"), F.col("props").alias("err"),
        none("bigint").alias("size"), none("bigint").alias("own_size"), F.when(F.col("event_type").isin("purchase", "error"), F.col("value")).alias("duration"), none("double").alias("own_duration"), none("double").alias("cached_duration"),
    )


@query("""WITH born AS (SELECT user_id, max(event_id) AS b FROM events WHERE event_type = 'signup' GROUP BY user_id),
own AS (SELECT e.* FROM events e JOIN born USING (user_id) WHERE event_id >= b),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM own) WHERE n = 1)
SELECT l.user_id AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'error' WHEN 'click' THEN 'cancelled' ELSE CASE WHEN value > 50 THEN 'cached' ELSE 'ok' END END AS status,
b AS spawned, (SELECT max(event_id) FROM own o WHERE o.user_id = l.user_id AND event_type = 'view') AS started,
(SELECT max(event_id) FROM own o WHERE o.user_id = l.user_id AND event_type IN ('purchase', 'error', 'click')) AS ended FROM last l JOIN born USING (user_id)""")
def span_status(spark, sf_dir):
    """Spans as their events leave them."""
    reduced = spans.reduce_spans(span_events(spark, sf_dir))
    return reduced.select(F.col("seq").cast("bigint").alias("seq"), "status", F.col("spawn_ts").cast("bigint").alias("spawned"), F.col("start_ts").cast("bigint").alias("started"), F.col("end_ts").cast("bigint").alias("ended"))


@query("""SELECT c_nationkey AS nation, CASE max(CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'P' THEN 3 ELSE 0 END) WHEN 5 THEN 'error' WHEN 3 THEN 'running' ELSE 'ok' END AS effective
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def span_effective_status(spark, sf_dir):
    """The weightiest status of a group; chains are in wait_chains."""
    status = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "P", "running").otherwise("ok")
    orders = table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"))
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return orders.join(nations, "o_custkey").groupBy("nation").agg(F.max_by("status", spans.status_weight(F.col("status"))).alias("effective"))


@query("""SELECT 0::BIGINT AS depth, count(*) AS nodes FROM region UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM customer UNION ALL SELECT 3, count(*) FROM orders
UNION ALL SELECT 4, count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def span_depth(spark, sf_dir):
    """How many spans stand at each depth."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return spans.depths(tree_edges(spark, sf_dir), roots).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("""SELECT 'r' || n_regionkey AS anc, count(*) AS spans, max(3)::BIGINT AS farthest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def span_closure(spark, sf_dir):
    """How many orders lie below each region, and how far."""
    pairs = spans.closure(tree_edges(spark, sf_dir, lines=False))
    return pairs.filter("substring(anc, 1, 1) = 'r' and substring(desc, 1, 1) = 'o'").groupBy("anc").agg(F.count(F.lit(1)).alias("spans"), F.max("dist").alias("farthest"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey, c_nationkey, n_regionkey, cast(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 'o' || o_orderkey AS anc, cast(sum(cents) AS BIGINT) AS amount FROM b GROUP BY o_orderkey UNION ALL SELECT 'c' || o_custkey, cast(sum(cents) AS BIGINT) FROM b GROUP BY o_custkey
UNION ALL SELECT 'n' || c_nationkey, cast(sum(cents) AS BIGINT) FROM b GROUP BY c_nationkey UNION ALL SELECT 'r' || n_regionkey, cast(sum(cents) AS BIGINT) FROM b GROUP BY n_regionkey""")
def rolled_cost(spark, sf_dir):
    """Costs of each node and all below it."""
    own = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node"), F.lit("cents").alias("key"), cents(F.col("l_extendedprice")).alias("amount"))
    return spans.roll_up_tree(own, tree_edges(spark, sf_dir, lines=False)).select("anc", "amount")


def waiting_marks(spark, sf_dir):
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1)
    return table(spark, sf_dir, "events").withColumn("step", step).filter("step is not null").select("user_id", "event_id", micros(F.col("ts")).alias("at"), "step")


@query("""SELECT user_id, cast(sum(CASE WHEN level > 0 THEN coalesce(nxt - t, 0) ELSE 0 END) AS BIGINT) AS active FROM (SELECT user_id, epoch_us(ts) AS t,
lead(epoch_us(ts)) OVER w AS nxt, sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS level
FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id""")
def suspended_time(spark, sf_dir):
    """How long something was open: a sweep over beginnings and ends."""
    found = spans.active_time(waiting_marks(spark, sf_dir), ["user_id"], "at", "step", ["at", "event_id"])
    return found.select("user_id", F.coalesce("active", F.lit(0)).alias("active"))


@query("""SELECT user_id, cast(max(level) AS BIGINT) AS peak FROM (SELECT user_id, sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS level
FROM events WHERE event_type IN ('view', 'click')) GROUP BY user_id""")
def concurrency_peak(spark, sf_dir):
    """The most that was open at once."""
    return spans.peak(waiting_marks(spark, sf_dir), ["user_id"], "step", ["at", "event_id"])


@query("""SELECT user_id, event_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch_us(ts)) AS delta FROM events""")
def trace_delta(spark, sf_dir):
    """Time since the trace before."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("at"))
    return spans.deltas(rows, ["user_id"], "at", ["at", "event_id"]).select("user_id", "event_id", "delta")


@query("""SELECT event_type AS e, count(*) AS n, count(*) FILTER (WHERE value > 50) AS cached, min(event_id) AS first_ord FROM events GROUP BY event_type""")
def exec_counts(spark, sf_dir):
    """Events by kind."""
    return inspection.counts(kinds(spark, sf_dir))


def kinds(spark, sf_dir):
    """events with their type as the kind."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("e"), F.col("event_id").alias("ord"), (F.col("value") > 50).alias("cached"))


@query("""SELECT 'n' || c_nationkey AS anc FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION
SELECT 'c' || o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION
SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""")
def span_flagged(spark, sf_dir):
    """Spans with something awaiting among them or below."""
    flagged = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return spans.flagged_tree(flagged, tree_edges(spark, sf_dir, lines=False))


@query("""WITH t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0::BIGINT AS depth, ['r' || r_regionkey] AS path FROM region
UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1, ['r' || n_regionkey, 'n' || n_nationkey] FROM nation
UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT root, node, depth, row_number() OVER (PARTITION BY root ORDER BY path) AS nth FROM t""")
def span_preorder(spark, sf_dir):
    """Trees depth first."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return spans.preorder(tree_edges(spark, sf_dir, lines=False).filter("substring(child, 1, 1) <> 'o'"), roots)


@query("""SELECT user_id AS record_id, event_id AS ord, CASE event_type WHEN 'signup' THEN 'spawn' ELSE 'trace' END AS kind,
row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 3600000000, CASE event_type WHEN 'signup' THEN 1 ELSE 0 END, event_id) AS place FROM events WHERE event_type IN ('signup', 'view')""")
def record_events(spark, sf_dir):
    """Traces and spawns of a record in one order."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("ord"), F.floor(micros(F.col("ts")) / 3_600_000_000).alias("ts"), "event_type")
    merged = spans.merged_events(rows.filter("event_type = 'view'").drop("event_type"), rows.filter("event_type = 'signup'").drop("event_type"))
    return merged.select("record_id", "ord", "kind", "place")


@query("""SELECT l_orderkey AS record_id, cast(l_linenumber AS BIGINT) AS child_index, greatest(0, epoch_us(l_shipdate) - epoch_us(o_orderdate)) AS start_rel, greatest(0, epoch_us(l_shipdate) + 1000 - epoch_us(o_orderdate)) AS end_rel
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def child_times(spark, sf_dir):
    """Children's times from their record's start on."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), micros(F.col("o_orderdate")).alias("start"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("child_index"), micros(F.col("l_shipdate")).alias("at")).join(orders, "l_orderkey")
    return spans.child_spans(lines, F.col("start"), F.col("at"), F.col("at") + 1000).select(F.col("l_orderkey").alias("record_id"), "child_index", "start_rel", "end_rel")


@query("""SELECT l_orderkey AS record_id, cast(l_linenumber AS BIGINT) AS child_index, coalesce(n.p_partkey, -1 - l_suppkey) AS child_record_id, n.p_partkey IS NOT NULL AS found
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) LEFT JOIN part n ON n.p_partkey = l_partkey AND n.p_size > 5""")
def child_pointers(spark, sf_dir):
    """Children by their pointer, or by the older one."""
    stored = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("record_id"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("bigint").alias("child_index"))
    lines = lines.agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    new = lines.withColumnRenamed("l_partkey", "child_record_id").join(stored.withColumnRenamed("record_id", "child_record_id"), "child_record_id", "left_semi")
    return lookup.child_records(new, stored, lines.withColumn("child_record_id", -1 - F.col("l_suppkey"))).select("record_id", "child_index", "child_record_id", "found")


@query("""SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS elapsed FROM events""")
def trace_elapsed(spark, sf_dir):
    """Time since a run's first event."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("at"))
    return spans.elapsed(rows, ["user_id"], "at").select("event_id", "elapsed")


@query("""SELECT e.event_id, coalesce(p.p_brand, 'task-' || e.user_id) AS name FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id AND p.p_size > 25 WHERE e.event_type = 'purchase'""")
def span_names(spark, sf_dir):
    """Ends with their span's name, or a made one."""
    names = table(spark, sf_dir, "part").filter("p_size > 25").select(F.lit("r").alias("run_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("name"))
    ends = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.lit("r").alias("run_id"), F.col("user_id").alias("seq"), "event_id")
    return spans.named(ends, names).select("event_id", "name")


@query("""SELECT event_type, event_id, props FROM events WHERE user_id IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def strict_traces(spark, sf_dir):
    """Traces whose span is known; the others are left out."""
    known = table(spark, sf_dir, "part").filter("p_size > 25").select(F.lit("r").alias("run_id"), F.col("p_partkey").alias("seq"))
    events = table(spark, sf_dir, "events").withColumn("e", F.lit("trace")).withColumn("run_id", F.lit("r")).withColumn("parent_seq", F.col("user_id"))
    return spans.own_traces(events, known).select("event_type", "event_id", "props")



# Runs.


def order_runs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("entry"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


@query("""SELECT o_orderkey AS run_id, o_custkey AS entry, coalesce(steps, 0) AS steps, row_number() OVER w = 1 AS is_latest,
o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest_ok
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS steps FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)""")
def run_latest(spark, sf_dir):
    """Runs with their steps, and which are their entry's newest."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return lifecycle.runs_listed(order_runs(spark, sf_dir), steps).select("run_id", "entry", "steps", "is_latest", "is_latest_ok")


@query("""SELECT run_id, entry FROM (SELECT o_orderkey AS run_id, o_custkey AS entry, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
WHERE n > 1 AND o_orderdate < TIMESTAMP '1997-01-01'""")
def run_retention(spark, sf_dir):
    """Runs that a date limit removes; each entry's newest stays."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    listed = lifecycle.runs_listed(order_runs(spark, sf_dir), steps)
    return lifecycle.expired(listed, "1997-01-01 00:00:00").select("run_id", "entry")


@query("""SELECT o_custkey AS entry, count(*) AS runs, min(o_orderkey) AS first_run FROM orders GROUP BY o_custkey""")
def runs_per_entry(spark, sf_dir):
    """How many runs each entry has."""
    return inspection.runs_per_entry(order_runs(spark, sf_dir))


@query("""SELECT entry, run_id, row_number() OVER (PARTITION BY entry ORDER BY made DESC, run_id DESC) AS nth FROM (SELECT o_custkey AS entry, o_orderkey AS run_id, o_orderdate AS made FROM orders)""")
def runs_selector(spark, sf_dir):
    """Entries by name, the newest run of each first."""
    return inspection.selector(order_runs(spark, sf_dir)).select("entry", "run_id", "nth")


@query("""WITH s AS (SELECT conv_id AS run_id, turn * 10 + CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS seq, max(role) AS name, sha256(min(text)) AS path FROM conversations GROUP BY ALL)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS ordinal, CASE WHEN seq % 2 = 0 THEN name ELSE 'task-' || seq END AS name, path AS record_path FROM s""")
def step_ordinal(spark, sf_dir):
    """Steps of a run, numbered by their ends; half of them have spawns that name them."""
    role = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    steps = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id"), (F.col("turn") * 10 + role).alias("seq")).agg(F.max("role").alias("name"), F.min("text").alias("text"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    spawns = steps.filter("seq % 2 = 0").select("run_id", "seq", F.lit("spawn").alias("e"), (F.col("seq") - 5000).alias("ord"), "name", none("record_path"), none("origin"))
    ends = steps.select("run_id", "seq", F.lit("end").alias("e"), F.col("seq").alias("ord"), none("name"), F.sha2("text", 256).alias("record_path"), none("origin"))
    numbered = lifecycle.step_ordinals(spawns.unionByName(ends))
    return numbered.select("run_id", F.col("ordinal").cast("bigint").alias("ordinal"), "name", "record_path")


@query("""WITH t AS (SELECT o_custkey AS entry, epoch_us(o_orderdate) AS at, 'spawn' AS kind, o_orderkey AS ref, 0::BIGINT AS nth, 0 AS s FROM orders
UNION ALL SELECT o_custkey, epoch_us(l_shipdate), 'end', l_orderkey, cast(l_linenumber AS BIGINT), 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT entry, "at", kind, ref, nth, row_number() OVER (PARTITION BY entry ORDER BY "at", s, ref, nth) AS place FROM t""")
def timeline(spark, sf_dir):
    """Two streams of events as one, in order of time."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    spawned = orders.select(F.col("o_custkey").alias("entry"), micros(F.col("o_orderdate")).alias("at"), F.lit("spawn").alias("kind"), F.col("o_orderkey").alias("ref"), F.lit(0).cast("bigint").alias("nth"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ended = lines.select(F.col("o_custkey").alias("entry"), micros(F.col("l_shipdate")).alias("at"), F.lit("end").alias("kind"), F.col("l_orderkey").alias("ref"), F.col("l_linenumber").cast("bigint").alias("nth"))
    return inspection.timeline(spawned, ended, key="entry")


@query("""SELECT user_id, session, count(*) AS events, min(event_id) AS first_event, max(epoch_us(ts)) - min(epoch_us(ts)) AS length FROM (SELECT *, cast(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def sessions(spark, sf_dir):
    """Events with gaps of six hours at most, in one session."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("at"))
    rows = spans.sessions(rows, ["user_id"], "at", ["at", "event_id"], 6 * 3600 * 1_000_000)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), (F.max("at") - F.min("at")).alias("length"))



# Texts and versions.


@query("""SELECT p_partkey, p_size || '.' || p_partkey % 10 || '.0' AS version FROM part WHERE (p_size > 10 OR (p_size = 10 AND p_partkey % 10 >= 2)) AND p_size < 20""")
def semver_match(spark, sf_dir):
    """Versions in a range."""
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("0"))
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version")).filter(versions.satisfies(F.col("version"), ">=10.2.0,<20.0.0"))


@query("""SELECT p_brand AS comp_id, max(p_partkey) AS record_id FROM part WHERE p_size >= 10 AND p_size < 20 GROUP BY p_brand""")
def semver_latest(spark, sf_dir):
    """The newest record whose version is in a range: newest by time, not by version."""
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("0"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("comp_id"), F.col("p_partkey").alias("record_id"), version.alias("version"))
    return lookup.newest(rows, ["comp_id"], ("record_id",), versions.satisfies(F.col("version"), ">=10.0.0,<20.0.0")).select("comp_id", "record_id")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def page_extract(spark, sf_dir):
    """Titles and links."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", formats.page_title(html).alias("title"), F.size(formats.page_links(html)).cast("bigint").alias("links"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def props_extract(spark, sf_dir):
    """A field of a JSON column."""
    payload = F.concat(F.lit('{"result":'), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", result_field(payload, "k").alias("k"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 30 THEN text ELSE left(text, 27) || '...' END AS summary,
replace(replace(replace(left(text, 20), '/', '.'), chr(92), '.'), ' ', '_') AS name, left(sha256(text), 8) AS short_hash FROM documents""")
def text_forms(spark, sf_dir):
    """Summaries, safe names and short hashes."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", formats.shortened(text).alias("summary"), formats.safe_name(F.substring(text, 1, 20)).alias("name"), keys.short_hash(keys.content_hash(text)).alias("short_hash"))


@query("""SELECT l_orderkey, l_linenumber, cast(l_quantity AS BIGINT) AS seconds, CASE WHEN l_quantity < 1 THEN (l_quantity * 1000)::BIGINT || 'ms' ELSE l_quantity::BIGINT || '.0s' END AS duration,
CASE WHEN l_quantity * 100 < 60 THEN (l_quantity * 100)::BIGINT || 's' WHEN l_quantity * 100 < 3600 THEN (l_quantity * 100)::BIGINT // 60 || 'm' ELSE (l_quantity * 100)::BIGINT // 3600 || 'h' END AS age FROM lineitem""")
def time_forms(spark, sf_dir):
    """Durations and ages as text."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.cast("bigint").alias("seconds"), formats.duration(q).alias("duration"), formats.age(q * 100).alias("age"))


@query("""SELECT turn, role, CASE role WHEN 'user' THEN 'red' WHEN 'system' THEN 'yellow' ELSE 'dim' END AS colour, '[' || repeat('█', cast(10 * (turn % 11) // 10 AS INT)) || repeat('░', 10 - cast(10 * (turn % 11) // 10 AS INT)) || '] ' || role || ' (' || turn % 11 || '/10) {turn=' || turn || '} (by=' || role || ')' AS line, count(*) AS n
FROM conversations GROUP BY turn, role""")
def trace_lines(spark, sf_dir):
    """Trace events as text: progress, message, level."""
    rows = table(spark, sf_dir, "conversations").groupBy("turn", "role").agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("role") == "user", "error").when(F.col("role") == "system", "warn").otherwise("info")
    progress = F.array((F.col("turn") % 11).cast("int"), F.lit(10))
    line = formats.trace_line(F.col("role"), F.lit(None).cast("string"), progress, F.create_map(F.lit("turn"), F.col("turn").cast("double")), F.create_map(F.lit("by"), F.col("role")))
    return rows.select("turn", "role", formats.level_colour(level).alias("colour"), line.alias("line"), "n")


# Computing what is missing; trees of recalled records.


@query("""SELECT event_id, user_id * 2 + 1 AS result, CASE WHEN user_id % 3 = 0 THEN 'recalled' ELSE 'created' END AS origin FROM events""")
def memo_mapped(spark, sf_dir):
    """A function over a table: hits are recalled, the rest is computed once a computation."""
    args = table(spark, sf_dir, "events").select("event_id", "user_id")
    key = keys.comp_id(args, "double", ["user_id"])
    known = args.select("user_id").distinct().filter("user_id % 3 = 0")
    records = known.select(keys.comp_id(known, "double", ["user_id"]).alias("comp_id"), F.lit("old").alias("record_id"), (F.col("user_id") * 2 + 1).cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("ts_created"))
    mapped, _ = memo_map.memo_map(args, key, records, _double)
    return mapped.select("event_id", F.col("result").cast("bigint").alias("result"), "origin")


def _double(row: dict) -> str:
    return str(row["user_id"] * 2 + 1)


@query("""WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'l' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey FROM lineitem),
i AS (SELECT child, parent, row_number() OVER (PARTITION BY parent ORDER BY child) AS n FROM e),
t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0::BIGINT AS depth, CAST([] AS BIGINT[]) AS path FROM region),
t1 AS (SELECT root, child AS node, 1::BIGINT AS depth, list_append(path, n) AS path FROM t JOIN i ON parent = node),
t2 AS (SELECT root, child AS node, 2::BIGINT AS depth, list_append(path, n) AS path FROM t1 JOIN i ON parent = node),
t3 AS (SELECT root, child AS node, 3::BIGINT AS depth, list_append(path, n) AS path FROM t2 JOIN i ON parent = node),
t4 AS (SELECT root, child AS node, 4::BIGINT AS depth, list_append(path, n) AS path FROM t3 JOIN i ON parent = node),
a AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS seq FROM (FROM t UNION ALL FROM t1 UNION ALL FROM t2 UNION ALL FROM t3 UNION ALL FROM t4))
SELECT a.root, a.seq, up.seq AS parent_seq, a.node AS record_id, a.depth FROM a LEFT JOIN a up ON up.root = a.root AND a.depth > 0 AND up.path = a.path[:-2]""")
def stitch(spark, sf_dir):
    """The trees of all recalled records, each numbered depth first; a child with two parents comes twice."""
    edges = tree_edges(spark, sf_dir)
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    index = F.row_number().over(Window.partitionBy("parent").orderBy("child"))
    children = edges.select(F.col("parent").alias("record_id"), index.alias("child_index"), F.col("child").alias("child_record_id"))
    return spans.stitch_each(children, roots).drop("path")


# Waiting, recalled time, and questions about runs.


@query("""WITH RECURSIVE u AS (SELECT DISTINCT user_id FROM events),
w AS (SELECT user_id AS seq, user_id AS tip FROM u UNION ALL SELECT seq, tip + 1 FROM w WHERE tip % 4 <> 3 AND tip IN (SELECT user_id FROM u)),
e AS (SELECT seq, max(tip) AS last FROM w GROUP BY seq)
SELECT seq, CASE WHEN last NOT IN (SELECT user_id FROM u) THEN 'pending' WHEN last % 8 = 3 THEN 'error' ELSE 'ok' END AS effective FROM e""")
def wait_chains(spark, sf_dir):
    """Spans that wait for spans that wait: each has the status of the last in its chain."""
    users = table(spark, sf_dir, "events").select(F.lit("r").alias("run_id"), F.col("user_id").alias("seq")).distinct()
    status = F.when(F.col("seq") % 4 != 3, "running").when(F.col("seq") % 8 == 3, "error").otherwise("ok")
    waits = users.filter("seq % 4 <> 3").select("run_id", "seq", F.lit("span").alias("kind"), (F.col("seq") + 1).alias("target"), F.lit(None).cast("array<bigint>").alias("ids"))
    return spans.effective_status(users.withColumn("status", status), waits).select("seq", "effective")


@query("""WITH m AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS step FROM events e WHERE event_type IN ('view', 'click')
AND event_id > coalesce((SELECT max(event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase'), -1)),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS raw FROM m),
h AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS height FROM r),
l AS (SELECT *, min(height) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM h)
SELECT user_id AS seq, max(event_id) AS target FROM l WHERE event_type = 'view' AND later >= height GROUP BY user_id""")
def waits_open(spark, sf_dir):
    """What each span still waits for: the top of its stack of waits."""
    kind = F.when(F.col("event_type") == "view", "wait").when(F.col("event_type") == "click", "resume").when(F.col("event_type") == "purchase", "end")
    on = F.struct(F.lit("span").alias("kind"), F.col("event_id").alias("seq"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("array<bigint>").alias("ids"))
    events = table(spark, sf_dir, "events").select(F.lit("r").alias("run_id"), F.col("event_id").alias("ord"), kind.alias("e"), F.col("user_id").alias("seq"), on.alias("on")).filter("e is not null")
    return spans.open_waits(events).select("seq", "target")


def recalled_events(spark, sf_dir):
    """Orders as runs of recalled lines: awaited in turn in even orders, together in odd ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("double").alias("took"))
    run, child = F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").cast("int")
    far = F.when(F.col("l_orderkey") % 2 == 0, child * 10)
    row = lambda e, ord_, seq, parent, on, cached, took: [run, ord_.cast("bigint").alias("ord"), F.lit(e).alias("e"), seq.cast("int").alias("seq"), parent.cast("int").alias("parent_seq"), on.cast("int").alias("on_seq"), F.lit(cached).alias("cached"), took.cast("double").alias("duration"), F.lit(0.0).alias("cached_duration")]
    none, zero = F.lit(None), F.lit(0)
    born = lines.select("l_orderkey").distinct().select(*row("spawn", F.lit(-1), zero, none, none, False, none))
    return born.unionByName(lines.select(*row("spawn", F.coalesce(far, child), child, zero, none, False, none))).unionByName(lines.select(*row("end", F.coalesce(far + 1, 1000 + child), child, none, none, True, F.col("took")))).unionByName(
        lines.select(*row("resume", F.coalesce(far + 2, 2000 + child), zero, none, child, False, none))
    )


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_quantity)::DOUBLE AS took FROM lineitem GROUP BY ALL)
SELECT l_orderkey::VARCHAR AS run_id, l_linenumber::BIGINT AS seq, took AS cached_duration FROM l
UNION ALL SELECT l_orderkey::VARCHAR, 0, CASE WHEN l_orderkey % 2 = 0 THEN sum(took) ELSE max(took) END FROM l GROUP BY l_orderkey""")
def recalled_time(spark, sf_dir):
    """How long recalled work would have taken: in turn it adds up, together the longest counts."""
    return clock.cached_durations(recalled_events(spark, sf_dir)).select("run_id", F.col("seq").cast("bigint").alias("seq"), "cached_duration")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '-x' ELSE NULL END AS entry, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) END AS at FROM orders""")
def run_names(spark, sf_dir):
    """Names of runs taken apart; a name of another form gives nothing."""
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit("-x-"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))).otherwise(F.concat("o_orderstatus", F.lit("-latest")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("name"))
    entry, at = traces.run_id_parts(F.col("name"))
    return orders.select("id", entry.alias("entry"), micros(at).alias("at"))


@query("""WITH w AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT e.user_id AS seq, count(*) FILTER (WHERE first IS NULL OR event_id < first) AS spawned FROM events e LEFT JOIN w USING (user_id) WHERE event_type = 'view' GROUP BY e.user_id""")
def span_fan_out(spark, sf_dir):
    """How many children a span starts before it waits."""
    kind = F.when(F.col("event_type") == "view", "spawn").when(F.col("event_type") == "click", "wait")
    events = table(spark, sf_dir, "events").select(F.lit("r").alias("run_id"), F.col("event_id").alias("ord"), kind.alias("e"), F.col("user_id").alias("seq"), F.when(F.col("event_type") == "view", F.col("user_id")).alias("parent_seq"))
    return inspection.fan_out(events).select("seq", "spawned")


@query("""WITH s AS (SELECT user_id // 100 AS run, props AS name, min(event_id) AS first FROM events WHERE event_type = 'signup' GROUP BY ALL),
n AS (SELECT s.*, e.user_id AS seq FROM s JOIN events e ON e.event_id = s.first)
SELECT run::VARCHAR AS run_id, name, seq, first::DOUBLE AS start_ts, (SELECT min(event_id)::DOUBLE FROM events x WHERE x.user_id = seq AND event_type IN ('purchase', 'error', 'click')) AS end_ts FROM n""")
def spans_by_name(spark, sf_dir):
    """The first span of each name in each run, with its first end."""
    events = span_events(spark, sf_dir).withColumn("identity", F.col("name"))
    return inspection.first_named(events).select("run_id", "name", F.col("seq").cast("bigint").alias("seq"), "start_ts", "end_ts")


@query("""SELECT user_id // 100 || '' AS run_id, count(*) FILTER (WHERE event_type = 'view') AS executions, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS recalled FROM events GROUP BY user_id // 100""")
def run_executions(spark, sf_dir):
    """Bodies that ran and ends that were recalled, by run."""
    return inspection.executions(span_events(spark, sf_dir))


@query("""SELECT user_id, event_id, coalesce(min(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(f) OVER (PARTITION BY user_id)) AS next
FROM (SELECT *, CASE WHEN event_type = 'error' THEN event_id END AS f FROM events)""")
def next_flagged(spark, sf_dir):
    """From each event the next flagged one, going round."""
    return inspection.next_flagged(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


@query("""SELECT lang, source, avg(CAST(n_chars AS DOUBLE)) AS mean, count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*) AS win_rate, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL GROUP BY lang, source""")
def evaluation(spark, sf_dir):
    """Mean, share of wins and number by group."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return inspection.evaluation(rows, ["lang", "source"], F.col("n_chars").cast("double"), F.col("quality") == 1)


@query("""SELECT user_id, first(epoch_us(ts) - 1577836800000000 ORDER BY event_id) FILTER (WHERE event_id % 7 <> 0) AS began FROM events GROUP BY user_id""")
def first_times(spark, sf_dir):
    """The time of each run's first event that has one."""
    at = F.when(F.col("event_id") % 7 == 0, 0).otherwise(micros(F.col("ts")) - 1577836800000000)
    return inspection.first_time(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), at.alias("ts")), "user_id")


@query("""SELECT page_id, coalesce(nullif(regexp_extract(html, 'price=[$]?([0-9.]+)', 1), ''), '0') AS price, coalesce(nullif(regexp_extract(html, 'stock=([0-9]+)', 1), ''), '0') AS stock FROM (SELECT page_id, html || ' price=$' || page_id || '.5, stock=' || CASE WHEN page_id % 2 = 0 THEN page_id || ' units' ELSE 'none' END AS html FROM pages)""")
def page_offers(spark, sf_dir):
    """Prices and stock on pages."""
    tail = F.concat(F.lit(" price=$"), F.col("page_id").cast("string"), F.lit(".5, stock="), F.when(F.col("page_id") % 2 == 0, F.concat(F.col("page_id").cast("string"), F.lit(" units"))).otherwise("none"))
    html = F.concat("html", tail)
    return table(spark, sf_dir, "pages").select("page_id", formats.page_price(html).alias("price"), formats.page_stock(html).alias("stock"))


@query("""SELECT event_id, CASE WHEN value > 20 THEN round(value)::BIGINT END AS done, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, value > 100 AS edge FROM events""")
def lenient_traces(spark, sf_dir):
    """Stored trace fields as far as they have their form."""
    done = F.when(F.col("value") > 20, F.round("value").cast("bigint").cast("string")).otherwise(F.lit("many"))
    level = F.when(F.col("event_type") == "error", ',"level":"error"').otherwise("")
    kwargs = F.concat(F.lit('{"progress":["'), done, F.lit('",9],"edge":"'), (F.col("value") > 100).cast("string"), F.lit('"'), level, F.lit("}"))
    rows = table(spark, sf_dir, "events").withColumn("kwargs", kwargs).select("event_id", *traces.lenient_fields(F.col("kwargs")))
    return rows.select("event_id", F.get("progress", 0).cast("bigint").alias("done"), "level", "edge")


@query("""WITH b AS (SELECT event_id // 4 AS stream, event_id, event_type, value FROM events)
SELECT stream || '' AS stream, max(event_id) AS ord, first(event_type ORDER BY event_id) AS name, '{"k":1' || string_agg(event_id % 10, '' ORDER BY event_id) || '}' AS args FROM b GROUP BY stream""")
def tool_calls(spark, sf_dir):
    """Calls whose arguments come in pieces, one piece an event, four events a call."""
    from traceloom.operators.calls import tool_events

    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).cast("string").alias("stream"), "event_id", "event_type")
    ends = rows.groupBy("stream").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    rows = rows.join(ends, "stream")
    piece = F.concat(F.when(F.col("event_id") == F.col("lo"), '{"k":1').otherwise(""), (F.col("event_id") % 10).cast("string"), F.when(F.col("event_id") == F.col("hi"), "}").otherwise(""))
    wrap = lambda *cols: F.to_json(F.struct(F.lit("stream_event").alias("type"), F.struct(F.lit(0).alias("index"), *cols).alias("event")))
    begin = rows.filter("event_id = lo").select("stream", (F.col("event_id") * 3).alias("ord"), wrap(F.lit("content_block_start").alias("type"), F.struct(F.lit("tool_use").alias("type"), F.col("event_type").alias("name"), F.col("stream").alias("id")).alias("content_block")).alias("raw"))
    parts = rows.select("stream", (F.col("event_id") * 3 + 1).alias("ord"), wrap(F.lit("content_block_delta").alias("type"), F.struct(piece.alias("partial_json")).alias("delta")).alias("raw"))
    stops = rows.filter("event_id = hi").select("stream", (F.col("event_id") * 3 + 2).alias("ord"), wrap(F.lit("content_block_stop").alias("type")).alias("raw"))
    calls = tool_events(begin.unionByName(parts).unionByName(stops))
    return calls.select("stream", F.floor(F.col("ord") / 3).alias("ord"), "name", "args")
