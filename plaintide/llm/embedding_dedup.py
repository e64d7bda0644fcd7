"""Near-duplicate vectors by sorted projection passes, with exact links inside every component."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.links import components, extended
from plaintide.llm.scratch import written

#: Directions of a hash: a vector's hash is the one of 2*DIRECTIONS signed random directions nearest to it.
DIRECTIONS = 64
#: Hashes in a sort key, 7 bits each: at most, and at least.
HASHES, FEWEST = 8, 4
#: Neighbours compared with each vector, in sort order, and rows of a task's block of the order.
WINDOW, BLOCK = 64, 2048
#: Rows compared with their windows at once: so few that the product isn't dealt to threads that wait for each other.
TILE = 32
#: Measured chance that two vectors with a cosine of 0.9 share a hash; the passes follow from it.
AGREE = 0.45
#: Vectors on either side of a task that compares the members of a component.
PART = 1024
#: Passes on which crowding is measured.
TRIAL = 2


def hashes_for(vectors: int) -> int:
    """Leading hashes that cut so many vectors, were they spread evenly over the codes, to windows."""
    return min(HASHES, max(1, math.ceil(math.log(max(vectors / WINDOW, 1.1), 2 * DIRECTIONS))))


def passes_with(hashes: int, recall: float = 0.99) -> int:
    """Passes in one of which so many leading hashes of a pair at the threshold agree, with the given chance.

    The directions don't depend on the vectors, so neither does this chance.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE**hashes)) if hashes else 1


def passes_for(vectors: int, recall: float = 0.99) -> int:
    return passes_with(hashes_for(vectors), recall)


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    """Rows as doubles, scaled by powers of two so that squares neither overflow nor vanish."""
    rows = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    _, powers = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -powers[:, None])


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left @ right.T) / np.outer(np.sqrt((left * left).sum(1)), np.sqrt((right * right).sum(1)))


def _codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows at length 1 as whole steps of -127 to 127, each row's step, and how far its code is from it at most."""
    units = rows / np.sqrt((rows * rows).sum(1))[:, None]
    steps = (np.abs(units).max(axis=1) / 127).astype("<f4")
    codes = np.clip(np.rint(units / steps[:, None]), -127, 127).astype(np.int8)
    off = units - codes * steps[:, None].astype(np.float64)
    return codes, steps, (np.sqrt((off * off).sum(1)) * (1 + 1e-6) + 1e-9).astype("<f4")


def _coded(classes: DataFrame, kind: str) -> DataFrame:
    """cid and code: a vector's step and distance as floats, then a byte for each component."""

    def code(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in values])
            out = np.empty(len(values), object)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                codes, steps, off = _codes(_matrix([values[i] for i in own], kind))
                packed = np.hstack([np.column_stack([steps, off]).view(np.int8), codes])
                out[own] = [row.tobytes() for row in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.binary())], names=["cid", "code"])

    return classes.select("cid", "_vector").mapInArrow(code, "cid bigint, code binary")


def _decoded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one length as rows in single precision, and their distances from the vectors at length 1."""
    packed = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1)
    steps, off = np.ascontiguousarray(packed[:, :8]).view("<f4").T
    return packed[:, 8:] * steps[:, None], off


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """_id and _vector: the components as bytes, null if the vector takes part in no link; and their type."""
    element = df.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    id_kind = df.schema[id_col].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            out = []
            for vector in batch.column(1).to_pylist():
                usable = vector and None not in vector
                row = np.array(vector if usable else [0], kind) + np.array(0, kind)  # -0 becomes 0
                out.append(row.tobytes() if np.isfinite(row).all() and row.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["_id", "_vector"])

    chosen = df.select(F.col(id_col), F.col(vector_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>"))
    return chosen.mapInArrow(pack, f"_id {id_kind}, _vector binary"), kind


def _directions(size: int, turn: int, width: int, seed: int) -> np.ndarray:
    """The directions of a pass's hashes, side by side."""
    drawn = [np.random.default_rng([seed, size, turn * HASHES + h]).standard_normal((size, DIRECTIONS)) for h in range(width)]
    return np.hstack(drawn).astype(np.float32)


def _sort_keys(classes: DataFrame, kind: str, passes: range, width: int, seed: int) -> DataFrame:
    """pass, key and cid: a long of `width` concatenated hashes per vector and pass, so that numeric order is theirs."""

    def keys(batches):
        directions: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in values])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                rows = _matrix([values[i] for i in own], kind).astype(np.float32)
                for turn in passes:
                    if (size, turn) not in directions:
                        directions[size, turn] = _directions(rows.shape[1], turn, width, seed)
                    near = (rows @ directions[size, turn]).reshape(len(own), width, DIRECTIONS)
                    best = np.abs(near).argmax(axis=2)
                    signed = 2 * best + (np.take_along_axis(near, best[:, :, None], 2)[:, :, 0] < 0)
                    code = np.zeros(len(own), np.int64)
                    for h in range(width):
                        code = code * (2 * DIRECTIONS) + signed[:, h]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), turn, np.int32)), pa.array(np.full(len(own), size, np.int32)),
                         pa.array(code), pa.array(ids[own])],
                        names=["pass", "size", "key", "cid"],
                    )

    return classes.select("cid", "_vector").mapInArrow(keys, "pass int, size int, key bigint, cid bigint")


def _ranked(keys: DataFrame) -> DataFrame:
    """The keys with their rank in the order of pass, vector length and key; ties by cid, so equal keys fill several tasks."""
    order = ["pass", "size", "key", "cid"]
    place = F.monotonically_increasing_id()
    ordered = written(
        keys.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)),
        "sorted-keys",
    )
    # One row per written partition: the driver only adds up their sizes.
    parts = ordered.groupBy("_part").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    before, at = [], 0
    for row in sorted(parts.collect(), key=lambda r: tuple(r.first)):
        before.append((row._part, at))
        at += row.n
    offsets = keys.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(offsets), "_part").select(*order, rank.alias("rank"))


class _Sets:
    """Union-find over the rows of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _window_links(ranked: DataFrame, classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Links a, b between neighbours; and pairs (sure = false) that their codes can't decide.

    Only codes are moved. The product of two codes is off the cosine by no more than their distances from the
    vectors allow, so nearly all pairs are decided by it. Of the links a block of the order gives only enough to keep
    its components, of the undecided pairs those that these don't join.
    """

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        ranks, own, ids = block["rank"].to_numpy(), block["_own"].to_numpy(), block["cid"].to_numpy()
        sizes = block["code"].map(len).to_numpy()
        sets, open_pairs = _Sets(len(block)), []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            values, off = _decoded(block["code"].iloc[rows].tolist())
            # Rounding of a product in single precision stays below this.
            rounding = (size + 4) * 2.0**-23
            for a in range(0, len(rows), TILE):
                here, there = slice(a, a + TILE), slice(a, a + TILE + WINDOW)
                gap = ranks[rows[there]][None, :] - ranks[rows[here]][:, None]
                near = values[here] @ values[there].T
                # With units u = code + off, u * v = code * code' + off * v + code * off'.
                slack = off[here][:, None] + off[there][None, :] + np.outer(off[here], off[there]) + rounding
                likely = (near >= threshold - slack) & (gap > 0) & (gap <= WINDOW) & own[rows[here]][:, None]
                for x, y in np.argwhere(likely):
                    if near[x, y] >= threshold + slack[x, y]:
                        sets.join(rows[a + x], rows[a + y])
                    else:
                        open_pairs.append((rows[a + x], rows[a + y]))
        roots = np.array([sets.root(i) for i in range(len(block))], int)
        found = pd.DataFrame({"a": ids, "b": ids[roots] if len(ids) else ids, "sure": True})
        left, right = np.array(open_pairs, int).reshape(-1, 2).T
        apart = roots[left] != roots[right]
        low, high = np.minimum(ids[left], ids[right])[apart], np.maximum(ids[left], ids[right])[apart]
        return pd.concat([found[found["a"] != found["b"]], pd.DataFrame({"a": low, "b": high, "sure": False})])

    number = F.floor(F.col("rank") / BLOCK).cast("bigint")
    halo = (F.col("rank") % BLOCK < WINDOW) & (F.col("rank") >= BLOCK)
    blocks = F.when(halo, F.array(number, number - 1)).otherwise(F.array(number))
    dealt = ranked.select("cid", "rank", number.alias("_home"), F.explode(blocks).alias("block"))
    dealt = dealt.withColumn("_own", F.col("block") == F.col("_home")).drop("_home")
    return (
        dealt.join(_coded(classes, kind), "cid").groupBy("block")
        .applyInPandas(compare, "a bigint, b bigint, sure boolean").distinct()
    )


def _confirmed(pairs: DataFrame, classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The pairs a, b whose vectors, as doubles, reach the threshold."""

    def confirm(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("_left", "_right"))
            sizes, kept = np.array([len(v) for v in left]), np.zeros(batch.num_rows, bool)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                a, b = (_matrix([side[i] for i in own], kind) for side in (left, right))
                kept[own] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    sides = (classes.select(F.col("cid").alias(c), F.col("_vector").alias(v)) for c, v in (("a", "_left"), ("b", "_right")))
    for side in sides:
        pairs = pairs.join(side, side.columns[0])
    return pairs.select("a", "b", "_left", "_right").mapInArrow(confirm, "a bigint, b bigint")


def _unjoined(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The pairs a, b whose ends are in no common component."""
    for end in ("a", "b"):
        pairs = pairs.join(grouped.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    return pairs.filter(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).select("a", "b")


def _prefix(hashes: int, width: int):
    """The leading hashes of a key of `width`; with none, one run holds all vectors of a length."""
    return F.shiftright("key", 7 * (width - hashes)) if hashes else F.lit(0).cast("bigint")


def _crowding(keys: DataFrame, grouped: DataFrame, width: int) -> list[float]:
    """For 0, 1, ... `width` leading hashes: pairs a pass that lie in one run, overflow its window and are not joined yet."""
    runs = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), _prefix(h, width).alias("run")) for h in range(width + 1)]))
    placed = keys.filter(F.col("pass") < TRIAL).join(grouped.select(F.col("node").alias("cid"), "component"), "cid", "left")
    run = ["pass", "size", "h", "run"]
    counts = placed.select("pass", "size", "component", runs.alias("_r")).select("pass", "size", "_r.*", "component")
    n = F.col("n").cast("double")
    pairs = (
        counts.groupBy(*run, "component").agg(F.count("*").alias("n"))
        .groupBy(*run).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("component").isNull(), n).otherwise(n * n)).alias("joined"))
        .filter(F.col("n") > WINDOW + 1)
        .groupBy("h").agg((F.sum(n * n - F.col("joined")) / 2 / TRIAL).alias("pairs"))
    )
    found = {r.h: r.pairs for r in pairs.collect()}
    return [found.get(h, 0.0) for h in range(width + 1)]


def _run_links(keys: DataFrame, classes: DataFrame, grouped: DataFrame, kind: str, threshold: float, hashes: int,
               width: int, covered: int) -> DataFrame:
    """Verified links a, b between components inside runs of equal leading hashes, compared in full.

    Runs of passes below `covered` that fit a window were compared there. A run is dealt into parts of about PART
    vectors and every two parts meet in one task. Vectors of a large component fill parts of their own, which
    don't meet each other. A task returns only enough links to keep its components.
    """

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        own, ids, joined = pair["_part"].to_numpy(), pair["cid"].to_numpy(), pair["component"].to_numpy()
        left, right = (np.flatnonzero(own == pair[c].iloc[0]) for c in ("_p", "_q"))
        tops = np.arange(len(pair))
        if len(left) and len(right):
            a, b = (_matrix(pair["_vector"].iloc[x].tolist(), kind) for x in (left, right))
            linked = (_cosines(a, b) >= threshold) & (joined[left][:, None] != joined[right][None, :])
            rows, columns = linked.any(1), linked.any(0)
            left, right, linked = left[rows], right[columns], linked[rows][:, columns]
            while linked.size:
                before = tops.copy()
                tops[left] = np.minimum(tops[left], np.where(linked, tops[right][None, :], len(pair)).min(1))
                tops[right] = np.minimum(tops[right], np.where(linked, tops[left][:, None], len(pair)).min(0))
                if (before == tops).all():
                    break
        found = pd.DataFrame({"a": ids, "b": ids[tops] if len(ids) else ids})
        return found[found["a"] != found["b"]]

    run = ["pass", "size", "run"]
    placed = (
        keys.select("pass", "size", _prefix(hashes, width).alias("run"), "cid")
        .join(grouped.select(F.col("node").alias("cid"), "component"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least = F.when(F.col("pass") < covered, WINDOW + 1).otherwise(1)
    crowded = written(
        placed.groupBy(*run).agg(F.count("*").alias("_n"), F.min("component").alias("_c"), F.max("component").alias("_d"))
        .filter((F.col("_n") > least) & (F.col("_c") < F.col("_d"))).select(*run, "_n"),
        "crowded-runs",
    )
    members = written(placed.join(crowded, run).drop("_n"), "run-members")
    # At most one row per PART vectors.
    large = members.groupBy(*run, "component").agg(F.count("*").alias("_m")).filter(F.col("_m") >= PART)
    large = large.withColumn("_own", F.ceil(F.col("_m") / PART).cast("int"))
    upto = Window.partitionBy(*run).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = written(large.withColumn("_from", F.coalesce(F.sum("_own").over(upto), F.lit(0)).cast("int")), "large-components")
    inside = large.groupBy(*run).agg(F.sum("_own").cast("int").alias("_first"), F.sum("_m").alias("_m"))
    sizes = written(
        crowded.join(inside, run, "left").select(
            *run, F.coalesce("_first", F.lit(0)).alias("_first"),
            F.ceil((F.col("_n") - F.coalesce("_m", F.lit(0))) / PART).cast("int").alias("_rest")),
        "run-sizes",
    )
    spread = F.xxhash64("cid")
    part = F.when(F.col("_own").isNotNull(), F.col("_from") + F.pmod(spread, "_own")).otherwise(
        F.col("_first") + F.pmod(spread, "_rest")).cast("int")
    every = F.sequence(F.lit(0), F.col("_first") + F.col("_rest") - 1)
    others = F.when(F.col("_own").isNull(), every).otherwise(
        F.filter(every, lambda x: (x < F.col("_from")) | (x >= F.col("_from") + F.col("_own"))))
    dealt = (
        members.join(sizes, run).join(large.drop("_m"), [*run, "component"], "left")
        .withColumn("_part", part).withColumn("_other", F.explode(others))
        .withColumn("_p", F.least("_part", "_other")).withColumn("_q", F.greatest("_part", "_other"))
    )
    return (
        dealt.select(*run, "_p", "_q", "_part", "cid", "component").join(classes.select("cid", "_vector"), "cid")
        .groupBy(*run, "_p", "_q").applyInPandas(compare, "a bigint, b bigint").distinct()
    )


def _links_inside(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """cid and links: the vectors (copies counted) linked with each member of a component, all pairs compared.

    A component is dealt into parts of about PART members and every two parts meet in one task, so no task holds
    a component; a task returns one number for each of its rows.
    """

    def count(pair: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(len(pair), np.int64)
        copies, own = pair["n"].to_numpy(), pair["_part"].to_numpy()
        low, high = pair["_p"].iloc[0], pair["_q"].iloc[0]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        if len(left) and len(right):
            a, b = (_matrix(pair["_vector"].iloc[x].tolist(), kind) for x in (left, right))
            linked = _cosines(a, b) >= threshold
            if low == high:
                np.fill_diagonal(linked, False)
            counts[left] += linked @ copies[right]
            if low != high:
                counts[right] += linked.T @ copies[left]
        return pd.DataFrame({"cid": pair["cid"], "links": counts})

    sizes = written(members.groupBy("component").agg(F.count("*").alias("_members")), "component-sizes")
    parts = F.ceil(F.col("_members") / PART).cast("int")
    dealt = (
        members.join(sizes, "component")
        .withColumn("_part", F.pmod(F.xxhash64("cid"), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("_p", F.least("_part", "_other")).withColumn("_q", F.greatest("_part", "_other"))
    )
    # The diagonal task of a part gets it once, the others get both their parts.
    return (
        dealt.select("component", "_p", "_q", "_part", "cid", "n", "_vector")
        .groupBy("component", "_p", "_q").applyInPandas(count, "cid bigint, links bigint")
        .groupBy("cid").agg(F.sum("links").alias("links"))
    )


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           threshold: float = 0.9, recall: float = 0.99, seed: int = 1) -> DataFrame:
    """One row per row of `df`: id, n_links, component_id, kept (id = component_id), copies (of the vector).

    Two vectors are linked if they have the same length and a cosine (in doubles) of `threshold` or more. Null,
    empty and zero vectors and those with null or non-finite components have no links. Equal vectors are one
    class and linked with each other; repeated rows count as copies. Null ids come last in a component.

    Passes: each orders all classes by a key of concatenated random hashes (nearest signed direction out of 128),
    so similar vectors come close, and compares every vector with its 64 neighbours; verified pairs of all
    passes are united. Then runs of equal leading hashes that overflow the window are compared in full, part against
    part, without the pairs joined already. passes_with() gives the number of passes in one of which a pair at the
    threshold shares the leading hashes with the wanted chance, and a pair that shares them is always compared,
    however crowded its neighbourhood is. How many hashes lead follows from the crowding measured on TRIAL passes:
    the number with the fewest pairs to compare; none, i.e. all pairs of the table, if vectors are so alike that
    hashes don't tell them apart. Hashes are of the vectors as they are: without their mean, a linked pair can be as
    far apart as any other. Within a component all pairs are compared, part against part, and counted. A pair whose
    vectors no chain of verified pairs joins is the only possible loss.

    A crowd of m vectors that are alike but not linked costs up to m * m / 2 comparisons.

    A byte a component moves once per pass; whole vectors move for pairs so near the threshold that bytes can't decide
    them, and once per part of their component or crowded run; keys and ids otherwise.
    """
    vectors, kind = _vectors(df, id_col, vector_col)
    packed = written(vectors.withColumn("_key", F.unhex(F.sha2("_vector", 256))), "vectors")
    usable = packed.filter(F.col("_vector").isNotNull())
    classes = written(
        usable.groupBy("_key")
        .agg(F.min("_id").alias("rep"), F.count("*").alias("n"), F.min("_vector").alias("_vector"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    total = classes.count()
    passes = passes_for(total, recall)
    usual = hashes_for(total)
    width = max(FEWEST, usual)
    ranked = _ranked(_sort_keys(classes, kind, range(passes), width, seed))
    neighbours = written(_window_links(ranked, classes, kind, threshold), "neighbours")
    found = components(neighbours.filter("sure"))
    undecided = _unjoined(neighbours.filter("not sure").select("a", "b"), found)
    confirmed = written(_confirmed(undecided, classes, kind, threshold), "confirmed")
    found = found if confirmed.isEmpty() else extended(found, confirmed)
    pairs = _crowding(ranked, found, width)
    wanted = [passes_with(h, recall) for h in range(len(pairs))]
    cost = [p * n + max(0, p - passes) * total * WINDOW for p, n in zip(wanted, pairs)]
    hashes = min(range(len(pairs)), key=lambda h: (cost[h], h != usual))
    keys = ranked.filter(F.col("pass") < wanted[hashes]).drop("rank")
    if wanted[hashes] > passes:
        keys = keys.unionByName(_sort_keys(classes, kind, range(passes, wanted[hashes]), width, seed))
    found = extended(found, _run_links(keys, classes, found, kind, threshold, hashes, width, passes))
    members = written(
        found.withColumnRenamed("node", "cid").join(classes.select("cid", "rep", "n", "_vector"), "cid"), "members")
    counts = _links_inside(members.drop("rep"), kind, threshold)
    lowest = written(members.groupBy("component").agg(F.min("rep").alias("_lowest")), "component-heads")
    settled = members.select("cid", "component").join(lowest, "component").join(counts, "cid", "left")
    answers = written(
        classes.select("_key", "cid", "rep", "n").join(settled.drop("component"), "cid", "left").select(
            "_key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("_lowest", "rep").alias("component_id"), F.col("n").alias("copies")),
        "vector-answers",
    )
    linked = usable.select("_id", "_key").join(answers, "_key").select("_id", "n_links", "component_id", "copies")
    alone = packed.filter(F.col("_vector").isNull()).select(
        "_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"),
        F.lit(1).cast("bigint").alias("copies"))
    return linked.unionByName(alone).select(
        F.col("_id").alias(id_col), "n_links", "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), "copies")
