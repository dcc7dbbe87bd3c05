"""Numbers of links of the n-gram Jaccard join, derived from a similar set's differences.

The join decides components without building the pairs within one. Here every link is counted and
none is written out. Where the verified pairs of a component are all it has, they are its links. In
any other one each set a is told by its differences D(a) from a hub r, the set with most verified
links. Where m(a) tokens of r are missing in a and m(b) in b,

    |a & b| = |r| - m(a) - m(b) + |D(a) & D(b)|

for any sets, whether they resemble the hub or not. So 0 <= |D(a) & D(b)| <= min of the missing + min
of the added tokens bounds the overlap from the differences' sizes alone. Sets of a component lie in
blocks by the size of their differences; of two blocks these bounds say that all pairs link (their
weights are added unread), that none does (skipped), or nothing: then the blocks are sent together and
the differences are intersected. The work left grows with the square of a component's different sets
only where the bounds cannot decide; equal texts are one set with a weight. A task holds two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, stored

#: Sets of a block, and tokens of the sets or differences that share one.
BLOCK, BLOCK_TOKENS = 512, 1_000_000
#: Tokens that are compared at a time.
WIDTH = 4096

_RELATED = "component long, d1 long, d2 long, w long, size long, minus long, plus long, base long, differ binary"


def _differences(table: pa.Table) -> pa.Table:
    """Of a block of sets and the hub: each set's sorted differences from it."""
    is_hub = table.column("hub").to_pylist()
    payload = table.column("payload")
    hub = np.frombuffer(payload[is_hub.index(True)].as_py(), np.uint64)
    out: dict[str, list] = {name: [] for name in ("component", "d1", "d2", "w", "size", "minus", "plus", "base", "differ")}
    head = [table.column(c).to_pylist() for c in ("component", "d1", "d2", "w")]
    for i, hub_row in enumerate(is_hub):
        if hub_row:
            continue
        own = np.frombuffer(payload[i].as_py(), np.uint64)
        differ = np.setxor1d(own, hub, assume_unique=True)
        minus = (len(differ) + len(hub) - len(own)) // 2
        for name, value in zip(out, (*(c[i] for c in head), len(own), minus, len(differ) - minus, len(hub), differ.tobytes()), strict=True):
            out[name].append(value)
    return pa.table({name: pa.array(values, pa.binary() if name == "differ" else pa.int64()) for name, values in out.items()})


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets of tokens."""
    sizes = np.zeros((len(left), len(right)), np.float32)
    a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))
    common = np.intersect1d(a, b)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    for start in range(0, len(common), WIDTH):
        both = []
        for tokens, at, rows, n in ((a, at_a, row_a, len(left)), (b, at_b, row_b, len(right))):
            here = np.flatnonzero((at >= start) & (at < min(start + WIDTH, len(common))))
            here = here[common[at[here]] == tokens[here]]
            grid = np.zeros((n, WIDTH), np.float32)
            grid[rows[here], at[here] - start] = 1
            both.append(grid)
        sizes += both[0] @ both[1].T
    return sizes.astype(np.int64)


def _links_of(num: int, den: int):
    """Of two blocks, or a block with itself: for each set the weight of the sets it links with."""
    schema = pa.schema([(c, pa.int64()) for c in ("d1", "d2", "n")])

    def run(table: pa.Table) -> pa.Table:
        side, d1, d2, w, size, minus, plus, base = (table.column(c).to_numpy() for c in ("side", "d1", "d2", "w", "size", "minus", "plus", "base"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        alone = not len(right)  # a block with itself has one side
        if alone:
            right = left
        least = base[0] - minus[left][:, None] - minus[right][None]
        most = least + np.minimum(minus[left][:, None], minus[right][None]) + np.minimum(plus[left][:, None], plus[right][None])
        limit = num * (size[left][:, None] + size[right][None])
        linked = least * (num + den) >= limit
        if (~linked & (most * (num + den) >= limit)).any():
            differ = table.column("differ")
            tokens = lambda rows: [np.frombuffer(differ[int(i)].as_py(), np.uint64) for i in rows]
            linked = (least + _shared(tokens(left), tokens(right))) * (num + den) >= limit
        if alone:
            np.fill_diagonal(linked, False)
            n = linked @ w[right]
            rows = left
        else:
            n = np.concatenate([linked @ w[right], w[left] @ linked])
            rows = np.concatenate([left, right])
        return pa.Table.from_arrays([pa.array(d1[rows]), pa.array(d2[rows]), pa.array(n.astype(np.int64))], schema=schema)

    return run


def partners(pairs: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(d1, d2, n): for each class with any the number of rows in the other classes it links with.

    pairs: verified links (a1, a2, b1, b2), at least enough to connect every component by links or by
    shared ids; classes: (d1, d2, w rows, component); sets: (d1, d2, n, payload) of the classes that can link.
    """
    known = stored(classes.join(sets.select("d1", "d2", F.col("n").cast("long").alias("n")), ["d1", "d2"]), "link-classes")
    of = lambda s: known.select(F.col("d1").alias(s + "1"), F.col("d2").alias(s + "2"), F.col("w").alias("w" + s))
    first, second = (F.struct(F.col(s + "1").alias("d1"), F.col(s + "2").alias("d2")) for s in "ab")
    once = pairs.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).distinct()
    once = once.select(F.col("x.d1").alias("a1"), F.col("x.d2").alias("a2"), F.col("y.d1").alias("b1"), F.col("y.d2").alias("b2"))
    both = once.join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"])
    ends = both.select(F.explode(F.array(F.struct(F.col("a1").alias("d1"), F.col("a2").alias("d2"), F.col("wb").alias("n")), F.struct(F.col("b1").alias("d1"), F.col("b2").alias("d2"), F.col("wa").alias("n")))).alias("e")).select("e.*")
    met = ends.groupBy("d1", "d2").agg(F.sum("n").alias("direct"), F.count(F.lit(1)).alias("degree"))
    graph = stored(known.join(met, ["d1", "d2"], "left").fillna(0, ["direct", "degree"]), "link-graph")
    forget(known)
    shape = graph.groupBy("component").agg(
        F.count(F.lit(1)).alias("many"),
        F.sum("degree").alias("degrees"),
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"),
        F.max_by(F.struct("d1", "d2"), F.struct("degree", "n", "d1", "d2")).alias("hub"),
    )
    whole = F.col("degrees") == F.col("many") * (F.col("many") - 1)  # every pair of the component is a verified link
    shape = stored(shape.where("many > 1").withColumn("whole", whole), "link-shape")
    done = graph.join(shape.where("whole").select("component"), "component", "left_semi").select("d1", "d2", F.col("direct").alias("n"))
    # the rest: differences from the hub, which goes to every block of its component
    open_ = shape.where(~F.col("whole"))
    sent = stored(
        graph.join(open_.select("component", "blocks"), "component").select("component", F.pmod("d1", "blocks").cast("int").alias("block"), F.lit(False).alias("hub"), "d1", "d2", "w").unionAll(
            open_.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("hub"), "hub.d1", "hub.d2", F.lit(0).cast("long").alias("w"))
        ),
        "link-sent",
    )
    related = sent.join(sets.select("d1", "d2", "payload"), ["d1", "d2"]).groupBy("component", "block").applyInArrow(_differences, _RELATED)
    related = stored(related.withColumn("g", F.floor(2 * F.log2((1 + F.col("minus") + F.col("plus")).cast("double"))).cast("int")), "link-differences")
    levels = related.groupBy("component", "g").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.col("minus") + F.col("plus")) / BLOCK_TOKENS)).cast("int").alias("parts"))
    members = related.join(levels, ["component", "g"]).withColumn("part", F.pmod("d2", "parts").cast("int")).drop("parts")
    bounds = {f"{how}_{c}": getattr(F, how)(c) for how in ("min", "max") for c in ("minus", "plus", "size")}
    blocks = stored(members.groupBy("component", "g", "part").agg(*(v.alias(k) for k, v in bounds.items()), F.sum("w").alias("w"), F.max("base").alias("base")), "link-blocks")
    other = blocks.select("component", *(F.col(c).alias("o_" + c) for c in blocks.columns if c != "component"))
    met_blocks = blocks.join(other, "component").where("g < o_g or (g = o_g and part <= o_part)")
    least = F.col("base") - F.col("max_minus") - F.col("o_max_minus")
    most = F.col("base") - F.greatest("min_minus", "o_min_minus") + F.least("max_plus", "o_max_plus")
    met_blocks = met_blocks.withColumns(
        {
            "all": least * (num + den) >= num * (F.col("max_size") + F.col("o_max_size")),
            "none": F.least(most, "max_size", "o_max_size") * (num + den) < num * (F.col("min_size") + F.col("o_min_size")),
            "same": (F.col("g") == F.col("o_g")) & (F.col("part") == F.col("o_part")),
        }
    )
    met_blocks = stored(met_blocks.where(~F.col("none")), "link-block-pairs")
    # all pairs link: a block's sets get the other block's weight, in their own block all but their own
    sure = met_blocks.where("all")
    sure = sure.select("component", "g", "part", F.col("o_w").alias("plus_w"), F.col("same").cast("int").alias("own")).unionAll(
        sure.where(~F.col("same")).select("component", F.col("o_g").alias("g"), F.col("o_part").alias("part"), F.col("w").alias("plus_w"), F.lit(0).alias("own"))
    )
    sure = sure.groupBy("component", "g", "part").agg(F.sum("plus_w").alias("plus_w"), F.max("own").alias("own"))
    certain = members.join(sure, ["component", "g", "part"]).select("d1", "d2", (F.col("plus_w") - F.col("own") * F.col("w")).alias("n"))
    # nothing is known: the two blocks go to one task
    unsure = met_blocks.where(~F.col("all")).withColumn("pair", F.struct("g", "part", "o_g", "o_part"))
    ways = unsure.select("component", "g", "part", "pair", F.lit(0).alias("side")).unionAll(
        unsure.where(~F.col("same")).select("component", F.col("o_g").alias("g"), F.col("o_part").alias("part"), "pair", F.lit(1).alias("side"))
    )
    pieces = members.join(ways, ["component", "g", "part"]).select("component", "pair.*", "side", "d1", "d2", "w", "size", "minus", "plus", "base", "differ")
    counted = pieces.groupBy("component", "g", "part", "o_g", "o_part").applyInArrow(_links_of(num, den), "d1 long, d2 long, n long")
    counts = stored(done.unionAll(certain).unionAll(counted).groupBy("d1", "d2").agg(F.sum("n").alias("n")), "link-counts")
    for used in (graph, shape, sent, related, blocks, met_blocks):
        forget(used)
    return counts
