"""Triples (s, p, o) as DataFrames: patterns, traversal, facts, union and difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule import session
from ferrule.functions import text as T


def pattern(triples: DataFrame, s: str | None, p: str | None, o: str | None) -> DataFrame:
    """Bindings of one triple pattern: "?x" is a variable (a column x), anything else a constant."""
    out, cols = triples, []
    for name, term in (("s", s), ("p", p), ("o", o)):
        if term is None:
            continue
        if term.startswith("?"):
            cols.append(F.col(name).alias(term[1:]))
        else:
            out = out.where(F.col(name) == F.lit(term))
    return out.select(*cols)


def bgp(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Patterns joined on the variables that they share; each must share one with those before it."""
    out = pattern(triples, *patterns[0])
    for p in patterns[1:]:
        nxt = pattern(triples, *p)
        shared = [c for c in nxt.columns if c in out.columns]
        if not shared:
            raise ValueError(f"{p} shares no variable with the patterns before it")
        out = out.join(nxt, shared)
    return out


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in right.columns if c in left.columns], "left")


def neighbours(triples: DataFrame) -> DataFrame:
    """(a, p, b, direction): each edge between nodes both ways."""
    e = triples.where("o_is_uri")
    return e.select(F.col("s").alias("a"), "p", F.col("o").alias("b"), F.lit("out").alias("direction")).unionByName(e.select(F.col("o").alias("a"), "p", F.col("s").alias("b"), F.lit("in").alias("direction")))


def hops(triples: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): nodes within `depth` out-edges of seeds (seed), with the least depth; the seeds at 0.

    Each step keeps distinct nodes, so a path count never multiplies.
    """
    e = triples.where("o_is_uri").select(F.col("s").alias("a"), F.col("o").alias("b"))
    step = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    parts = [step]
    for d in range(1, depth + 1):
        step = step.join(e, step["node"] == e["a"]).select("seed", F.col("b").alias("node"), F.lit(d).alias("depth")).distinct()
        parts.append(step)
    return reduce(DataFrame.unionByName, parts).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def reach(triples: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within `depth` out-edges of any of seeds (seed), with the least depth. Each step goes on from the nodes that are new, once each, whatever seeds they were reached from."""
    e = triples.where("o_is_uri").select(F.col("s").alias("a"), F.col("o").alias("b"))
    found = step = session.kept(seeds.select(F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    for d in range(1, depth + 1):
        new = step.join(e, step["node"] == e["a"]).select(F.col("b").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        step = session.kept(new.select("node", F.lit(d).alias("depth")), "reached")
        found = found.unionByName(step)
    return found


def fact_score(depth: Column, tokens: Column, words: Column) -> Column:
    """0.94 at one hop, 0.84 at two, 0.05 more for each query token in the fact."""
    return F.when(depth <= 1, 0.94).otherwise(0.84) + 0.05 * F.size(F.array_intersect(tokens, words))


def facts(triples: DataFrame, labels: DataFrame, most: int = 8) -> DataFrame:
    """(s, position, fact, score): each node's facts in order of predicate and object; description-like ones first.

    Labels are as many as nodes, and small files of them become many rows: they are shuffled, never broadcast by what their files look like.
    """
    from ferrule.operators.retrieve import ranked

    t = triples.join(labels.select(F.col("s").alias("o"), F.col("label").alias("o_label")).hint("shuffle_hash"), "o", "left")
    fact = F.concat(T.friendly_predicate(F.col("p")), F.lit(": "), F.coalesce("o_label", "o"))
    scored = t.where("p not in ('label', 'type')").select("s", fact.alias("fact"), F.when(F.col("p") == "description", 0.92).otherwise(0.88).alias("score"))
    return ranked(scored, ["s"], [F.desc("score"), F.asc("fact")], most).withColumnRenamed("rank", "position")


def merge(*graphs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, graphs).distinct()


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct triples of old that new doesn't have."""
    return old.select("s", "p", "o").subtract(new.select("s", "p", "o"))


def course_lookup(questions: DataFrame, courses: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, keyword, label, code): courses (label, code) whose name or code holds a keyword; the first keyword with hits counts."""
    from ferrule.operators.retrieve import ranked, small

    k = questions.select("query_id", F.posexplode(T.keywords(F.col("query"))).alias("_i", "keyword"))
    held = F.contains(F.lower("label"), F.col("keyword")) | F.coalesce(F.contains(F.lower("code"), F.col("keyword")), F.lit(False))
    words = k.select("keyword").distinct()  # each keyword is looked for once, whoever asks
    each = courses.groupBy("label", "code").agg(F.count("*").alias("_n"))  # each course is looked at once, however often it is told
    held_by = each.join(small(words), held).select("keyword", "label", "code", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(most)))).alias("_k"))
    hits = ranked(held_by, ["keyword"], [F.asc("label"), F.asc("code")], most).select("keyword", "label", "code")  # no question takes more of a keyword's
    first = k.join(hits.select("keyword").distinct(), "keyword").groupBy("query_id").agg(F.min_by("keyword", "_i").alias("keyword"))
    return ranked(first.join(hits, "keyword"), ["query_id"], [F.asc("label"), F.asc("code")], most).select("query_id", "keyword", "label", "code")


def by_type(triples: DataFrame, part: Column, kind: str | None = None) -> DataFrame:
    """(entity, label, type): nodes whose label or code holds `part`, of one type if given."""
    named = triples.where(F.col("p").isin("label", "code")).select(F.col("s").alias("entity"), F.col("o").alias("label"))
    typed = triples.where("p = 'type'").select(F.col("s").alias("entity"), F.col("o").alias("type"))
    typed = typed.where(F.col("type") == kind) if kind else typed
    return named.where(F.contains(F.lower("label"), F.lower(part))).join(typed, "entity").select("entity", "label", "type").distinct()


def fast_path(query: Column, intent: Column, question_type: Column, has_entities: Column, has_upload: Column) -> Column:
    """What the fast path does with a question: skipped, skipped_for_explanation or lookup."""
    from ferrule import params

    wanted = has_entities | (intent == "FACULTY_INFO") | T.any_of(F.lower(query), params.ROLE_TERMS)
    return F.when(~wanted, "skipped").when((question_type == "explanation") & has_upload, "skipped_for_explanation").otherwise("lookup")


def build(root: tuple[str, str, str], groups: DataFrame, members: dict[str, tuple[DataFrame, str, str | None, str | None]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a knowledge base: groups (id, label), and kinds of members (id, label, group) by name.

    For each kind: its rows, the relation of the root to it, that of a group to it, and that of it to its group (null: none).
    Nodes (id, label, type) and edges (id, source, target, type), each once.
    """
    node = lambda df, kind: df.select(F.concat(F.lit(f"{kind.lower()}-"), F.col("id").cast("string")).alias("id"), "label", F.lit(kind).alias("type"))
    spark = groups.sparkSession
    nodes = [spark.createDataFrame([root], "id string, label string, type string"), node(groups, "Group")]
    edges = []
    of = groups.select(F.col("label").alias("group"), F.concat(F.lit("group-"), F.col("id").cast("string")).alias("_g"))
    for kind, (rows, from_root, from_group, to_group) in members.items():
        n = F.concat(F.lit(f"{kind.lower()}-"), F.col("id").cast("string"))
        nodes.append(node(rows, kind))
        edge = lambda df, s, t, name: df.select(F.concat_ws("|", F.lit(name), s, t).alias("id"), s.alias("source"), t.alias("target"), F.lit(name).alias("type"))
        if from_root:
            edges.append(edge(rows, F.lit(root[0]), n, from_root))
        if from_group or to_group:
            linked = rows.join(of, "group")
            edges += [edge(linked, F.col("_g"), n, from_group)] if from_group else []
            edges += [edge(linked, n, F.col("_g"), to_group)] if to_group else []
    return reduce(DataFrame.unionByName, nodes).dropDuplicates(["id"]), reduce(DataFrame.unionByName, edges).dropDuplicates(["id"])
