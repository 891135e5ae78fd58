"""Closed frequent itemsets of baskets, by ascending-frequency prefix trees over weighted conditional shards.

Items get a total order, rarest first. A shard is for a group of items (by hash): it holds, of each basket, the part from
its first item of the group on, equal parts once with their weight. In it the baskets of an item, cut behind that item,
are its conditional ones. They become a prefix tree whose single branches are arrays; its branches are mined from
the rarest item on, and a branch that has been mined is pushed right, into its siblings, so that each sibling then holds all of
its baskets. An item in all baskets of a set joins the set at once.

A shard sees only what follows an item in the order, so a set found there may still lack a rarer item. Each set therefore
carries, beside its support, two sums (exclusive or of 64-bit hashes) of the baskets that hold it. Sets with one support and
equal sums are held by the same baskets; the longest of them is closed, and the others are parts of it.

How it is spread. Repeated rows become one, before they are exchanged too. Rows meet their item's count by item and a salt (a hash of the basket), so that a hot item is many tasks'; items
that have fewer rows than the least support go. A basket's items then meet in one row, which holds at most rows / least support
of them. Weighted parts are summed before they are exchanged. A shard of more than MOST_CELLS items is split: each item of its group becomes a
prefix with shards of its own, in another round of the same Spark steps. Only counts go to the driver, nothing is broadcast.

Cases. Rows without basket or item take no part; repeated rows count once; other columns are not read. Items must be whole numbers (TypeError), baskets may be
of any type that can be hashed. Ties in frequency go by item. An empty table gives no set. Baskets of any length are whole.
Texts play no part.
"""

from __future__ import annotations

import itertools
import math
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: The largest shard that one task mines, in items; parts of a basket in a shard group, on average; into how many a key is split.
MOST_CELLS, GROUP_CELLS, SALTS, CHUNK = 4_000_000, 50_000, 64, 2_000_000
FOUND = "items array<long>, support long, x long, y long"


# --- in a task: one shard --------------------------------------------------------------------------------------------


def push(tree: dict, sub, n: int, x: int, y: int) -> None:
    """Merge a branch (a dict of nodes, or the array of a single branch with weight n, x, y) into tree."""
    for item, node in ((sub[0], [n, x, y, sub[1:]]),) if isinstance(sub, tuple) and sub else sub.items() if sub else ():
        mine = tree.get(item)
        if mine is None:
            tree[item] = node
            continue
        if isinstance(mine[3], tuple):  # the array becomes a node, as it forks here
            mine[3] = {mine[3][0]: [*mine[:3], mine[3][1:]]} if mine[3] else {}
        mine[0], mine[1], mine[2] = mine[0] + node[0], mine[1] ^ node[1], mine[2] ^ node[2]
        push(mine[3], node[3], *node[:3])


def paths(sub: dict) -> list[tuple]:
    """The weighted baskets (items, n, x, y) of a branch."""
    out, stack = [], [((), sub)]
    while stack:
        before, level = stack.pop()
        for item, (n, x, y, below) in level.items():
            here = (*before, item)
            if isinstance(below, tuple):
                out.append((here + below, n, x, y))
                continue
            stack.append((here, below))
            for m, u, v, _ in below.values():
                n, x, y = n - m, x ^ u, y ^ v
            if n:
                out.append((here, n, x, y))
    return out


def totals(baskets: list[tuple]) -> dict[int, int]:
    out: dict[int, int] = {}
    for items, n, _, _ in baskets:
        for i in items:
            out[i] = out.get(i, 0) + n
    return out


def grow(baskets: list[tuple], count: dict[int, int], held: tuple, least: int, found: dict) -> None:
    """All sets of held and at least one item of count (each in at least `least` baskets), into found by (support, sums)."""
    order = sorted(count, key=lambda i: (count[i], i))
    rank = {i: k for k, i in enumerate(order)}
    tree: dict = {}
    for items, n, x, y in baskets:
        push(tree, tuple(sorted(rank[i] for i in items if i in rank)), n, x, y)
    for k, item in enumerate(order):
        n, x, y, sub = tree.pop(k)
        below, mark = (*held, item), (n, x, y)
        if mark not in found:  # else a set of the same baskets, with a rarer item, is there: all that follows lacks that item
            if isinstance(sub, tuple):
                found[mark] = below + tuple(order[j] for j in sub)
            else:
                inner = [(tuple(order[j] for j in p), *w) for p, *w in paths(sub)]
                more = totals(inner)
                below += tuple(i for i, m in more.items() if m == n)
                found[mark] = below
                if rest := {i: m for i, m in more.items() if least <= m < n}:
                    grow(inner, rest, below, least, found)
        push(tree, sub, n, x, y)


def conditional(flat: np.ndarray, at: np.ndarray, n: np.ndarray, own: np.ndarray, least: int):
    """(item, list of (place of its basket, items behind it)) for each item that `own` marks, with the items that are in `least` of its baskets or more.

    flat, at: items of the baskets one after another; n: weights; own: for each distinct item, in order.
    """
    names, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(n)), np.diff(at))
    place = np.flatnonzero(own(names)[code] & (np.arange(len(flat)) + 1 < at[row + 1]))
    place = place[np.argsort(code[place], kind="stable")]
    behind = at[row[place] + 1] - place - 1
    first = np.flatnonzero(np.concatenate([[True], np.diff(code[place]) > 0])) if len(place) else np.zeros(0, np.int64)
    cells = np.add.reduceat(behind, first) if len(first) else first
    bound = np.append(first, len(place))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(cells[lo:]), CHUNK, side="right")) + lo)
        p, size = place[bound[lo] : bound[hi]], behind[bound[lo] : bound[hi]]
        rep = np.repeat(np.arange(len(p)), size)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size) + p[rep] + 1
        key, inverse = np.unique(code[p[rep]] * len(names) + code[other], return_inverse=True)
        keep = np.bincount(inverse, weights=n[row[p[rep]]], minlength=len(key))[inverse] >= least
        rep, other = rep[keep], other[keep]
        cuts = np.append(np.flatnonzero(np.diff(rep, prepend=-1)), len(rep)).tolist()
        items, last, lists = flat[other].tolist(), None, []
        for a, b in itertools.pairwise(cuts):
            i = code[p[rep[a]]]
            if i != last:
                if lists:
                    yield int(names[last]), lists
                last, lists = i, []
            lists.append((int(row[p[rep[a]]]), tuple(items[a:b])))
        if lists:
            yield int(names[last]), lists
        lo = hi


def mine(least: int, groups: int):
    """The sets of a shard: its prefix, an item of its group, and at least one more."""

    def run(table: pa.Table) -> pa.Table:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
        table = table.combine_chunks()
        prefix, group = tuple(table.column("prefix")[0].as_py()), table.column("part")[0].as_py()
        lists = table.column("items").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, at = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]
        n, x, y = (table.column(c).to_numpy() for c in ("n", "x", "y"))
        xs, ys, ns = x.tolist(), y.tolist(), n.tolist()
        out: list = []
        for item, parts in conditional(flat, at, n, lambda names: blocks.bucket_of(names, groups) == group, least):
            weighted: dict[tuple, tuple] = {}
            for r, behind in parts:
                a, b, c = weighted.get(behind, (0, 0, 0))
                weighted[behind] = (a + ns[r], b ^ xs[r], c ^ ys[r])
            baskets, found = [(k, *w) for k, w in weighted.items()], {}
            grow(baskets, totals(baskets), (*prefix, item), least, found)
            out += [(sorted(s), *mark) for mark, s in found.items()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("items", "support", "x", "y"), columns, kinds, strict=True)})

    return run


# --- in Spark: rounds of shards --------------------------------------------------------------------------------------


def _group(item: str | Column, groups: int) -> Column:
    """The group of an item: what blocks.bucket_of() gives."""
    return F.pmod(F.xxhash64(item), F.lit(groups))


def _salts() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))


def _baskets(rows: DataFrame, least: int) -> DataFrame:
    """(x, y, items): the items of each basket that have at least `least` rows, rarest first."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
    often = rows.groupBy("i").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least).withColumn("salt", F.explode(_salts()))
    kept = rows.distinct().withColumn("salt", salt).join(often.hint("shuffle_hash"), ["i", "salt"])
    held = kept.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("s"))
    return held.select("b", F.col("s.i").alias("items"))


def _singles(rows: DataFrame, least: int) -> DataFrame:
    """prefix and one item of a part: the sets that a round can tell by counting."""
    each = rows.select("prefix", F.explode("items").alias("i"), "n", "x", "y")
    sums = each.groupBy("prefix", "i").agg(F.sum("n").alias("support"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return sums.where(F.col("support") >= least)


def _shards(rows: DataFrame, groups: int) -> DataFrame:
    """(prefix, part, items, n, x, y): parts from the first item of each group on, of two items or more, equal ones as one."""
    own = F.transform("items", lambda i: _group(i, groups))
    cut = rows.where(F.size("items") > 1).withColumn("own", own).select("*", F.explode(F.array_distinct("own")).alias("part"))
    behind = cut.select("prefix", "part", F.expr("slice(items, cast(array_position(own, part) as int), size(items))").alias("items"), "n", "x", "y").where(F.size("items") > 1)
    return behind.groupBy("prefix", "part", "items").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))


def _deeper(shards: DataFrame, singles: DataFrame, groups: int) -> DataFrame:
    """Rows (prefix, items, n, x, y) of the shards' own items as prefixes, of those that are frequent."""
    each = shards.select("prefix", "part", "n", "x", "y", "items", F.posexplode("items").alias("at", "i")).where(_group("i", groups) == F.col("part"))
    rest = each.select("prefix", "i", "n", "x", "y", F.expr("slice(items, at + 2, size(items))").alias("items")).where(F.size("items") > 0)
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("items"), F.lit(SALTS)))
    often = singles.select("prefix", "i", F.explode(_salts()).alias("salt"))
    joined = salted.join(often.hint("shuffle_hash"), ["prefix", "i", "salt"])
    return joined.select(F.concat("prefix", F.array("i")).alias("prefix"), "items", "n", "x", "y")


def found_sets(rows: DataFrame, least: int, folder: str, most_cells: int = MOST_CELLS) -> DataFrame:
    """FOUND: sets of at least `least` baskets, all closed ones among them; rows: (b, i), not null. Steps are written to folder, in which the result lies."""
    spark = rows.sparkSession
    blocks.prepare(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    held = kept(_baskets(rows, least), "baskets")
    cells = held.agg(F.coalesce(F.sum(F.size("items").cast("long")), F.lit(0))).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells / GROUP_CELLS))
    level = held.select(F.expr("cast(array() as array<long>)").alias("prefix"), "items", F.lit(1).cast("long").alias("n"), F.xxhash64(F.lit(1), "b").alias("x"), F.xxhash64(F.lit(2), "b").alias("y"))
    out = []
    for depth in range(1 << 20):
        singles = kept(_singles(level, least), f"singles-{depth}")
        out.append(singles.select(F.array_sort(F.concat("prefix", F.array("i"))).alias("items"), "support", "x", "y"))
        shards = kept(_shards(level, groups), f"shards-{depth}")
        size = shards.groupBy("prefix", "part").agg(F.sum(F.size("items").cast("long")).alias("cells")).where(F.col("cells") > most_cells)
        large = not size.isEmpty()
        small = shards.join(size.hint("shuffle_hash"), ["prefix", "part"], "left_anti") if large else shards
        mined = small.select("prefix", "part", "items", "n", "x", "y").groupBy("prefix", "part").applyInArrow(blocks.tidy(mine(least, groups)), FOUND)
        out.append(kept(mined, f"mined-{depth}"))
        if not large:
            break
        level = kept(_deeper(shards.join(size.hint("shuffle_hash"), ["prefix", "part"], "left_semi"), singles, groups), f"level-{depth}")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def closed(found: DataFrame) -> DataFrame:
    """(items, support) of the closed sets among found: of those that the same baskets hold, the longest."""
    longest = found.groupBy("support", "x", "y").agg(F.max(F.struct(F.size("items").alias("n"), "items")).alias("m"))
    return longest.select(F.col("m.items").alias("items"), "support")


def rules(closed_: DataFrame, found: DataFrame, baskets: int, percent: int = 10) -> DataFrame:
    """(items, c, a, s): closed sets of two items or more without item c, as a rule to c.

    a is the support of the other items, s that of c; a rule holds in `percent` of the a baskets or more, and more often than chance.
    The others' support stands in found, or is that of the closed sets around them with the greatest.
    """
    sets = closed_.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("c"))
    sets = sets.select("*", F.expr("filter(items, i -> i <> c)").alias("others"))
    known = found.select(F.col("items").alias("others"), F.col("support").alias("known"))
    asked = sets.join(known.hint("shuffle_hash"), "others", "left")
    # others that no shard gave have a closed set around them: looked for by their first two items
    open_ = asked.where("known is null").select("others").distinct().select("others", F.get("others", F.lit(0)).alias("p"), F.get("others", F.lit(1)).alias("q"))
    pairs = closed_.where(F.size("items") > 2).select("items", "support", F.explode("items").alias("p")).select("*", F.explode("items").alias("q")).where("p < q")
    around = open_.join(pairs.hint("shuffle_hash"), ["p", "q"]).where(F.size(F.array_except("others", "items")) == 0).groupBy("others").agg(F.max("support").alias("around"))
    one = found.where(F.size("items") == 1).select(F.col("items")[0].alias("c"), F.col("support").alias("s"))
    told = asked.join(around.hint("shuffle_hash"), "others", "left").join(one.hint("shuffle_hash"), "c")
    told = told.select("items", "support", "c", F.coalesce("known", "around").alias("a"), "s")
    wide = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(19,0)")
    good = (wide("support") * 100 >= wide("a") * percent) & (wide("support") * wide(baskets) > wide("a") * wide("s"))
    return told.where(good).select("items", "c", "a", "s")


def basket_rows(lines: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    blocks.whole_ids(lines, item_col)
    return lines.select(F.col(basket_col).alias("b"), F.col(item_col).cast("long").alias("i")).where("b is not null and i is not null")


def itemsets(lines: DataFrame, basket_col: str, item_col: str, folder: str, least: int = 8, share: int = 5000, most_cells: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """Closed itemsets (items ascending, support) in at least `least` baskets and one of `share`, and their rules; both read from folder."""
    rows = basket_rows(lines, basket_col, item_col)
    baskets = rows.select("b").distinct().count()
    found = found_sets(rows, max(least, -(-baskets // share)), folder, most_cells)
    closed(found).write.parquet(f"{folder}/closed")
    sets = lines.sparkSession.read.parquet(f"{folder}/closed")
    return sets, rules(sets, found, baskets)


def report(sets: DataFrame, rules_: DataFrame) -> DataFrame:
    """items as text, n_items, support, n_rules, best_item and rules_sha256 of each closed set."""
    of = rules_.groupBy("items").agg(
        F.count(F.lit(1)).alias("n_rules"), F.min(F.struct("a", "c")).alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "a", "s"))), lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";").alias("told"),
    )
    return sets.join(of.hint("shuffle_hash"), "items", "left").select(
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support",
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.col("best.c").alias("best_item"), F.sha2(F.coalesce("told", F.lit("")), 256).alias("rules_sha256"),
    )


def work_folder(spark) -> str:
    return f"{blocks.shared_folder(spark)}/itemsets-{uuid.uuid4().hex}"


def remove(folder: str) -> None:
    """Delete what itemsets() wrote."""
    where, path = blocks.file_system(folder)
    where.delete_dir(path)
