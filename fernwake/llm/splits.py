"""Splits that keep linked records together: hash-to-min components and weighted rendezvous hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwake.operators.ordering import join_unique, positions, range_parts
from fernwake.session import Scratch

MAX_ROUNDS = 200
ALONE = 8191  # heaviest units, which are drawn one by one
GROWTH = 1 / 8  # of the batches after them


def subject_number(c: Column) -> Column:
    """The number after "chb", whatever the case, blanks, leading zeros and trailing letter; else null."""
    digits = F.regexp_extract(F.lower(F.regexp_replace(c, r"[\s ]+", "")), r"^chb[^0-9a-z]*([0-9]{1,18})[a-z]?$", 1)
    return F.when(digits != "", digits.cast("long"))


def patient_key(c: Column) -> Column:
    """The clinic's reference without case and separators if it begins with PX; else null."""
    bare = F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]", ""))
    return F.when(bare.startswith("PX") & (F.length(bare) > 2), bare)


def hash_to_min(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``): one row for each node, with ``component``.

    ``component`` is the smallest node of the component. Every node holds a cluster, at first
    itself and its neighbours; in each round it sends its cluster to the cluster's minimum and the
    minimum to all of the cluster, and a node's new cluster is the union of what it got. Clusters
    are kept as rows (node, member), so a large component is no large row, and the rows of a hub
    (``join_unique``) don't meet in one task. Edges with a null end only keep the other end as a
    node. Clusters that haven't settled after 200 rounds are an error.
    """
    scratch = Scratch(edges.sparkSession, "components")
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("x")).select(F.col("x.a").alias("v"), F.col("x.b").alias("u"))
    state = scratch.keep(both.dropna().distinct(), "clusters")
    mark = _mark(state)
    for _ in range(MAX_ROUNDS):
        least = scratch.keep(state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("_n")), "least")
        sent = join_unique(state, least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("u").alias("u")))).alias("x"))
        state, old = scratch.keep(sent.select("x.v", "x.u").distinct(), "clusters"), state
        scratch.drop(old, least)
        before, mark = mark, _mark(state)
        if before == mark:
            return state.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")


def _mark(state: DataFrame) -> tuple:
    h = F.xxhash64("v", "u").cast("decimal(20,0)")
    row = state.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return tuple(row)


def recording_groups(recordings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each recording once with ``component``, ``group_no`` and ``n_subjects`` (capped at 2) of its group.

    Recordings belong together if they share a subject number, a source signature or a patient
    reference, or if an alias links their numbers. Numbers, signatures and patients are the nodes,
    and a recording links its number to its signature and patient, so that a key of many
    recordings gives one edge for each distinct pair. A recording without any of the three is a
    group of its own, with a null ``group_no``. Null recordings are left out: nothing names them.
    """
    r = recordings.select("recording", "subject", subject_number(F.col("subject")).alias("number"), patient_key(F.col("patient_ref")).alias("patient"), F.nullif(F.trim("source_signature"), F.lit("")).alias("signature"))
    r = r.dropna(subset=["recording"]).dropDuplicates(["recording"])
    node = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    keys = [node("n", F.col("number")), node("p", F.col("patient")), node("s", F.col("signature"))]
    r = r.withColumn("node", F.coalesce(*keys, node("r", F.col("recording"))))
    links = r.select("node", F.explode(F.array_compact(F.array(*keys, F.col("node")))).alias("b")).select(F.col("node").alias("a"), "b")
    named = aliases.select(subject_number(F.col("alias")).alias("x"), subject_number(F.col("subject")).alias("y")).dropna()
    edges = links.unionByName(named.select(node("n", F.col("x")).alias("a"), node("n", F.col("y")).alias("b"))).distinct()
    scratch = Scratch(recordings.sparkSession, "recordings")
    r = scratch.keep(r.select("recording", "subject", "number", "node"), "recordings")
    own = r.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("number").alias("number"), F.min("subject").alias("_lo"), F.max("subject").alias("_hi"))
    nodes = scratch.keep(own.join(hash_to_min(edges), "node"), "nodes")
    groups = nodes.groupBy("component").agg(F.min("number").alias("group_no"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    groups = groups.select("component", "group_no", F.when(F.col("_lo").isNull(), 0).when(F.col("_lo") == F.col("_hi"), 1).otherwise(2).alias("n_subjects"))
    named = scratch.keep(nodes.select("node", "component", "_n").join(groups, "component"), "groups")
    return join_unique(r.select("recording", "subject", "node"), named, "node").select("recording", "subject", "component", "group_no", "n_subjects")


def assign_splits(members: DataFrame, shares: dict[str, float], unit: str = "component", weight: str | None = None, seed: int = 17) -> DataFrame:
    """``members`` with ``split``: every row of one ``unit`` in the same one, the shares of weight as given.

    Units are drawn by weighted rendezvous hashing: a unit goes to the split of the highest
    -missing / ln(hash of unit and split), ``missing`` being what the split still lacks of its
    share. They are drawn in order of falling weight (ties: the unit's name), the first 8,191 one
    by one, the others in batches of about an eighth of the units before them, all of a batch by
    the same missing weights. A split that lacks less than the unit weighs is left out, and where
    all do, the one that lacks most takes it. So what one batch draws unevenly the next ones, of
    lighter units, even out, and the rule is the same for a unit of any weight.

    Rows without a unit are each on their own (equal ones together). A null weight is 0. Shares
    need not sum to 1. The driver holds the first 8,191 units, which it draws, and one row a batch.
    """
    if not shares or any(not s >= 0 for s in shares.values()) or not sum(shares.values()) > 0:
        raise ValueError("shares must be positive")
    scratch = Scratch(members.sparkSession, "splits")
    names = sorted(shares)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    held = members.withColumn("_unit", F.coalesce(F.col(unit).cast("string"), F.concat(F.lit("?"), F.xxhash64(*members.columns).cast("string"))))
    sizes = held.groupBy("_unit").agg(F.sum(w).alias("_size"), F.count(F.lit(1)).alias("_n")).withColumns({"_all": F.lit(0), "_light": -F.col("_size")})
    placed = positions(range_parts(sizes, "_all", ["_light", "_unit"], scratch, "sizes"), "_all", ["_light", "_unit"])
    draws = F.array(*[_draw(F.col("_unit"), s, seed) for s in names])
    batch = F.when(F.col("pos") >= ALONE, F.floor(F.ln((F.col("pos") + 1) / (ALONE + 1)) / math.log(1 + GROWTH)).cast("int"))
    ranked = scratch.keep(placed.select("_unit", "_size", "_n", "pos", batch.alias("_batch"), draws.alias("_draws")), "ranked")
    top = ranked.agg(F.max("_batch"), F.sum("_size")).first()
    whole, total = sum(shares.values()), top[1] or 0.0
    missing = [total * shares[s] / whole for s in names]
    alone = []
    for r in sorted(ranked.where("_batch is null").select("pos", "_unit", "_size", "_draws", "_n").collect()):
        i = _choice(r["_size"], r["_draws"], missing)
        missing[i] -= r["_size"]
        alone.append((r["_unit"], r["_n"], names[i]))
    tables: list[list[float]] = []
    for b in range((top[0] if top[0] is not None else -1) + 1):
        tables.append(list(missing))
        got = ranked.where(F.col("_batch") == b).groupBy(_chosen([missing]).alias("i")).agg(F.sum("_size").alias("s")).collect()  # a row a split
        for r in got:
            missing[r["i"]] -= r["s"]
    chosen = members.sparkSession.createDataFrame(alone, "_unit string, _n long, split string")
    if tables:
        split = F.element_at(F.array(*map(F.lit, names)), _chosen(tables) + 1)
        chosen = chosen.unionByName(ranked.where("_batch is not null").select("_unit", "_n", split.alias("split")))
    return join_unique(held, scratch.keep(chosen, "chosen"), "_unit").drop("_unit")


def _draw(unit: Column, split: str, seed: int) -> Column:
    """-1 / ln of a hash in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(unit, F.lit(split), F.lit(seed)), 11)
    return -1 / F.ln((bits.cast("double") + 0.5) / float(2**53))


def _choice(size: float, draws: list[float], missing: list[float]) -> int:
    """Place of the split of a unit among the splits by name."""
    fits = [i for i, m in enumerate(missing) if m > 0 and m >= size]
    return max(fits, key=lambda i: (missing[i] * draws[i], i)) if fits else max(range(len(missing)), key=lambda i: (missing[i], i))


def _chosen(tables: list[list[float]]) -> Column:
    """``_choice`` as an expression over ``_batch``, ``_size`` and ``_draws``; one table holds for all batches."""
    lacks = [F.array(*map(F.lit, t)) for t in tables]
    lacks = lacks[0] if len(tables) == 1 else F.element_at(F.array(*lacks), F.col("_batch") + 1)
    fits = lambda m: (m > 0) & (m >= F.col("_size"))
    scored = F.transform(lacks, lambda m, i: F.struct(fits(m).alias("fits"), F.when(fits(m), m * F.get("_draws", i)).otherwise(m).alias("score"), i.alias("i")))
    return F.array_max(scored)["i"]
