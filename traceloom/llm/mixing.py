"""Operator 6, mixing sources to target weights by temperature, DataFrame functions only.

Source token shares p are raised to an exponent t and normalised: under 1 they get flatter, over 1 sharper. The
exponent is bisected, many points at a time, in [0, MOST] to the flattest mixture that meets both targets: its
entropy is at most `entropy_share` of the largest possible entropy, and no source is repeated more than
`max_repeats` times in the budget. The weights are then realised: each source's documents are dealt into blocks of
about BLOCK_DOCS by a hash, the blocks are permuted, and whole blocks are taken in that order until the source's token
target is reached; only in the block where it is reached are single documents counted. Whole epochs come first. The
blocks' order is summed in two levels, so that no task holds more than about SPAN blocks or sums of SPAN blocks.

Defined results: a null source is a source of its own, reported as null; a null text has no tokens and an
empty text neither, and such documents are taken with their block. Documents of equal doc_id lie in one block
in the order of their token counts. A source without tokens has weight 0 and its documents are taken once. An empty
table gives an empty result; a very long text is one document like any other and is counted whole. Extra columns are not
read. A budget that repeats every source more than max_repeats times raises. Where an exponent over 1 would repeat the
largest source too often, it stays at the most that is allowed; where sources are all of one size, no exponent changes
anything and it is 1; in both cases the entropy target is missed, and a RuntimeWarning says by how much.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import Scratch, fresh

ENTROPY_SHARE, MAX_REPEATS, BUDGET_SHARE = 0.97, 4.0, 1.0
BLOCK_DOCS, SPAN = 64, 4096
WORDS = "[^\\x20\\x09-\\x0D]+"
MOST, POINTS, TAU_DIGITS = 64.0, 2048, 6


def tokens(text: Column) -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """60 bits of an md5, as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def find_exponent(sources: DataFrame, budget: float, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> float:
    """The smallest exponent that meets both targets for sources(tokens); each round is one aggregate of POINTS candidates a source."""
    held = sources.filter("tokens > 0").select(F.col("tokens").cast("double").alias("tokens"))
    seen = held.agg(F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        return 0.0
    share = held.select((F.col("tokens") / seen["most"]).alias("q"))  # of the largest, so that no power vanishes

    def measure(points: list[float]) -> list[tuple[float, float, float, float]]:
        """(point, entropy over target, repeats of the least source over the limit, of the largest) of each of evenly spaced points."""
        low, step = points[0], (points[-1] - points[0]) / max(1, len(points) - 1)
        each = share.select("q", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))).alias("i")).withColumn("w", F.pow("q", F.lit(low) + F.lit(step) * F.col("i")))
        sums = {r["i"]: r for r in each.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("q")).alias("zl")).collect()}
        out = []
        for i in range(len(points)):
            t, z = low + step * i, sums[i]["z"]
            entropy = math.log(z) - t * sums[i]["zl"] / z
            repeats = [budget * w / z / tokens - max_repeats for w, tokens in (((seen["least"] / seen["most"]) ** t, seen["least"]), (1.0, seen["most"]))]
            out.append((t, entropy - entropy_share * math.log(seen["n"]), *repeats))
        return out

    def least_good(low: float, high: float, good) -> float:
        """The least point in (low, high] from which on `good` holds; it holds at high."""
        while high - low > 1e-10:
            step = (high - low) / POINTS
            found = next((m[0] for m in measure([low + step * i for i in range(1, POINTS)]) if good(m)), high)
            low, high = max(low, found - step), found
        return round(high, TAU_DIGITS)

    ends = measure([float(t) for t in range(int(MOST) + 1)])
    flat, raw, sharp = ends[0], ends[1], ends[-1]
    meets = lambda m: m[1] <= 1e-12 and m[2] <= 1e-12
    if meets(flat):
        return 0.0
    if raw[2] > 1e-12:
        raise ValueError("the budget repeats every source more than max_repeats times")
    if meets(raw):
        return least_good(0.0, 1.0, meets)
    tau = least_good(1.0, MOST, meets) if meets(sharp) else 1.0
    if meets(sharp) and measure([tau])[0][3] > 1e-9:  # the largest source would come too often
        tau = max(1.0, round(least_good(1.0, tau, lambda m: m[3] > 1e-12) - 10.0**-TAU_DIGITS, TAU_DIGITS))
    over = measure([tau])[0][1]
    if over > 1e-5:
        warnings.warn(f"entropy target not met: with exponent {tau} the entropy is {over:.6f} above {entropy_share} of the largest", RuntimeWarning, stacklevel=2)
    return tau


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, place, copies for each row of docs(doc_id, text, source).

    place orders the blocks of a source; copies is how often the document is taken, over all epochs.
    """
    return _mix(docs, budget_share, entropy_share, max_repeats, seed)


def _mix(docs: DataFrame, budget_share: float, entropy_share: float, max_repeats: float, seed: int, *extra: Column) -> DataFrame:
    """As mix(), with more columns, which order rows that are else equal."""
    spark = docs.sparkSession
    counted = docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), *extra)
    more = counted.columns[3:]
    scratch = Scratch(spark, "mix")
    counted = scratch.save(counted, "counted")  # small: ids, sources and counts
    sources = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    sources = scratch.save(sources, "sources")
    known = sources.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most")).first()
    total, most = known["total"] or 0, float(known["most"] or 1)
    budget = float(round(total * budget_share))
    tau = find_exponent(sources, budget, entropy_share, max_repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(most), F.lit(tau))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    target = F.floor(F.lit(budget) * weight + 1e-6).cast("long")
    plan = sources.select(
        F.col("source").alias("_source"), weight.alias("weight"), "tokens",
        F.when(F.col("tokens") > 0, F.floor(target / F.col("tokens"))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("tokens") > 0, target % F.col("tokens")).otherwise(0).alias("rest"),
        F.ceil(F.col("docs") / BLOCK_DOCS).cast("long").alias("blocks"),
    )
    name = F.coalesce("source", F.lit("(null)"))
    order = _hash(F.lit(str(seed)), name, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Sources are far fewer than documents; Spark broadcasts them where their measured size allows, else splits the hot ones.
    dealt = counted.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_order", order).withColumn("block", F.col("_order") % F.col("blocks"))
    heads = dealt.groupBy("source", "block", "weight", "epochs", "rest", "blocks").agg(F.sum("n_tokens").alias("_sum"))
    turn = _hash(F.lit(f"{seed}b"), name, F.col("block").cast("string"))
    # Stretches of the permuted order, of about SPAN blocks each: their sums first, then the blocks within each.
    stretch = F.floor(turn / F.lit(float(1 << 60)) * F.ceil(F.col("blocks") / SPAN)).cast("long")
    heads = heads.withColumn("_turn", turn).withColumn("_stretch", stretch)
    along = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = heads.groupBy("source", "_stretch").agg(F.count(F.lit(1)).alias("_n"), F.sum("_sum").alias("_s"))
    sums = sums.select(F.col("source").alias("_src"), F.col("_stretch").alias("_st"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_places"), F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_base"))
    heads = heads.join(sums, heads["source"].eqNullSafe(sums["_src"]) & (heads["_stretch"] == sums["_st"])).drop("_src", "_st")
    by = Window.partitionBy("source", "_stretch").orderBy("_turn", "block")
    heads = heads.withColumn("place", (F.col("_places") + F.row_number().over(by)).cast("long")).withColumn("_upto", F.col("_base") + F.sum("_sum").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("_upto") - F.col("_sum")
    heads = heads.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "place", (F.col("_upto") <= F.col("rest")).alias("_whole"), ((F.col("_upto") > F.col("rest")) & (before < F.col("rest"))).alias("_cut"), (F.col("rest") - before).alias("_left"))
    heads = heads.withColumn("_hk", F.xxhash64("_s", "_b"))
    dealt = dealt.withColumn("_k", F.xxhash64("source", "block"))
    placed = dealt.join(heads, dealt["source"].eqNullSafe(heads["_s"]) & (dealt["block"] == heads["_b"]) & (F.col("_k") == F.col("_hk"))).drop("_k", "_hk", "_s", "_b")
    # One block of each source is counted document by document; in the others the window has nothing to order.
    inside = Window.partitionBy("source", "block").orderBy("_order", F.col("doc_id").asc_nulls_first(), "n_tokens", *more)
    cut = placed.filter("_cut").withColumn("_run", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_in", F.col("_run") <= F.col("_left")).drop("_run")
    out = placed.filter("not _cut").withColumn("_in", F.col("_whole")).unionByName(cut)
    return out.select("doc_id", "source", "n_tokens", F.round("weight", TAU_DIGITS).alias("weight"), "block", "place", (F.col("epochs") + F.col("_in").cast("long")).alias("copies"), *more)


def realised(docs: DataFrame, budget_share: float = BUDGET_SHARE, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """docs, with all its columns, each row as often as the mixture takes it.

    A null doc_id is matched like any other; rows that repeat a doc_id in one source are told apart by their texts.
    Of rows with equal texts as well, as many are taken once more as the mixture says.
    """
    id_, source, key, copies, more, nth = fresh(docs, "id", "source", "key", "copies", "more", "nth")
    taken = _mix(docs, budget_share, entropy_share, max_repeats, seed, F.xxhash64("text").alias("_text_key"))
    taken = taken.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("_text_key").alias(key))
    # Counts of equal rows differ by one at most: where the cut falls among them, `more` of them come once more.
    least = F.min("copies")
    taken = taken.agg(least.cast("int").alias(copies), (F.sum("copies") - F.count(F.lit(1)) * least).alias(more))
    taken = Scratch(docs.sparkSession, "taken").save(taken, "taken")  # small: ids, sources and counts
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & docs["source"].eqNullSafe(F.col(source)) & (F.xxhash64(docs["text"]) == F.col(key))
    joined = docs.join(taken.filter((F.col(copies) > 0) | (F.col(more) > 0)), same)
    if not taken.filter(F.col(more) > 0).isEmpty():  # one group of equal rows a source at most; the rest is not moved for it
        among = Window.partitionBy(id_, source, key).orderBy(key)
        split = joined.filter(F.col(more) > 0).withColumn(copies, F.col(copies) + (F.row_number().over(among) <= F.col(more)).cast("int"))
        joined = joined.filter(F.col(more) == 0).unionByName(split).filter(F.col(copies) > 0)
    repeated = joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*docs.columns)
