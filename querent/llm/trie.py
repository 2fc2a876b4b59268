"""A binary trie of 64-bit fingerprints joined with itself within a Hamming budget.

The distinct fingerprints stand in a binary trie, which is joined with itself
from the root: a pair of nodes (a, b) with the number of bits in which their
paths differ leads to the pairs of their children, each differing bit adds an
error, and a pair goes once it exceeds the error budget or one of its nodes is
empty. A pair of a node with itself that holds one fingerprint goes as well; a
pair that has at most ``leaf`` pairs of fingerprints below is a leaf, and those
are compared.

The descent is distributed: a round takes STEP levels, its node pairs are rows,
and it is two equi-joins, of the pairs with the children of a, and of what the
budget allows with the populated nodes b. A node has at most 2^STEP children and
meets a bounded number of others, so no key of these joins is hot.

Two tries share the work. Of two errors, either at most one lies in the upper
32 bits, or none in the lower ones; so the first trie allows one error in its
top 32 levels, and the second, which has the halves of the fingerprint
swapped, none. A fingerprint then meets about (1 + level) / 2 other nodes at
the level where nodes are nearly single, which grows with the logarithm of the
corpus, where one trie with both errors allowed from the root would meet the
square of that.

Defined results: an empty table has no links, and neither has a null
fingerprint; repeated fingerprints count once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.shared import written

BUDGET = 2
#: Levels of the trie that a round descends; divides 32.
STEP = 8
#: Node pairs with at most so many pairs of fingerprints below are compared.
LEAF = 8
EDGES = "u long, v long"


def _masks(low: int, high: int) -> Column:
    """All step-wide bit patterns of low to high set bits, fewest first."""
    return F.array(*[F.lit(sum(1 << b for b in bits)).cast("long") for n in range(low, high + 1) for bits in combinations(range(STEP), n)])


def _limits(budget: int) -> list[tuple[int, int]]:
    """For each trie, the errors allowed in the top 32 levels and in all 64.

    Of b errors, either at most b // 2 lie in the one half of the bits or at
    most (b - 1) // 2 in the other, so no pair within the budget is lost.
    """
    return [(budget // 2, budget), *([((budget - 1) // 2, budget)] if budget else [])]


def trie_links(distinct: DataFrame, leaf: int = LEAF, budget: int = BUDGET, report: list | None = None) -> DataFrame:
    """Links (u, v), u < v, of all pairs within the budget; distinct has a long column fingerprint.

    report, if given, gets (level, node pairs kept, of them leaves) of each round.
    """
    fp, half, limits = F.col("fingerprint"), 32, _limits(budget)
    turned = F.shiftleft(fp, half).bitwiseOR(F.shiftrightunsigned(fp, half))
    tries = F.array(*[F.struct(F.lit(t).alias("trie"), v.alias("value"), fp.alias("own")) for t, v in enumerate([fp, turned][: len(limits)])])
    rows = written(distinct.select("fingerprint").where(fp.isNotNull()).distinct().select(F.explode(tries).alias("x")).select("x.*"), "tries")
    size = rows.count()
    pairs = rows.groupBy("trie").agg(F.count("*").alias("n_a")).where("n_a > 1").select("trie", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("errors"))
    found = None
    for level in range(STEP, 65, STEP):
        node = F.shiftrightunsigned("value", 64 - level) if level < 64 else F.col("value")
        nodes = written(rows.groupBy("trie", node.alias("node")).agg(F.count("*").alias("n")), f"nodes-{level}")
        most = F.element_at(F.array(*[F.lit(top if level <= half else whole) for top, whole in limits]), F.col("trie") + 1)
        below = nodes.select("trie", F.col("node").alias("child"), F.shiftrightunsigned("node", STEP).alias("a"), F.col("n").alias("n_a"))
        # The errors between a child of a and one of b are the bits set in the pattern that tells them apart.
        patterns = F.filter(_masks(0, budget), lambda m: F.bit_count(m) + F.col("errors") <= most)
        other = F.shiftleft("b", STEP).bitwiseOR(F.col("child").bitwiseAND(F.lit((1 << STEP) - 1).cast("long")))
        met = pairs.join(below, ["trie", "a"]).select("trie", "a", "b", "errors", "child", "n_a", other.alias("other"), F.explode(patterns).alias("m"))
        met = met.select("trie", F.col("child").alias("a"), F.col("other").bitwiseXOR(F.col("m")).alias("b"), (F.col("errors") + F.bit_count("m")).cast("int").alias("errors"), "n_a", (F.col("a") == F.col("b")).alias("same"))
        # Children of one node meet each other once; a node of one fingerprint has no pair within itself.
        met = met.where("(not same or a <= b) and (a <> b or n_a > 1)").drop("same")
        ends = nodes.select("trie", F.col("node").alias("b"), F.col("n").alias("n_b"))
        done = (F.lit(level) == 64) | (F.col("n_a") * F.col("n_b") <= leaf)
        kept = written(met.join(ends, ["trie", "b"]).select("trie", "a", "b", "errors", "n_a", "n_b", done.alias("done")), f"pairs-{level}")
        total, leaves = kept.agg(F.count("*"), F.count_if("done")).first()
        if report is not None:
            report.append((level, total, leaves))
        if leaves:
            at = rows.select("trie", node.alias("node"), "own")
            one, two = (at.select("trie", F.col("node").alias(x), F.col("own").alias(y)) for x, y in (("a", "u"), ("b", "v")))
            links = kept.where("done").join(one, ["trie", "a"]).join(two, ["trie", "b"]).where((F.col("a") != F.col("b")) | (F.col("u") < F.col("v")))
            links = links.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= budget).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            found = links if found is None else found.unionByName(links)
        if total == leaves:
            break
        pairs = kept.where("not done").select("trie", "a", "b", "errors")
        if 4 * (total - leaves) < size:
            # Few nodes are open: later rounds read the fingerprints below those alone.
            open_ = pairs.select("trie", F.explode(F.array("a", "b")).alias("node")).distinct()
            rows = written(rows.withColumn("node", node).join(open_, ["trie", "node"], "left_semi").select("trie", "value", "own"), "open-tries")
            size = rows.count()
    return distinct.sparkSession.createDataFrame([], EDGES) if found is None else found.distinct()
