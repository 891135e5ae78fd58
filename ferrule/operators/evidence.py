"""Evidence selection: distinct unions, caps, budgets, confidence, grounding, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule import params
from ferrule.functions import text as T


def union_distinct(parts: list[DataFrame], key: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """The parts one after another, of rows with one key the first; ordered within a part by `order`."""
    both = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        both = p if both is None else both.unionByName(p)
    first = both.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy("_part", *order))).where("_k = 1").drop("_k")
    return first.orderBy("_part", *order).limit(limit).drop("_part") if limit else first.drop("_part")


def capped(df: DataFrame, group: list[str], source: list[str], order: list[Column], cap: Column) -> DataFrame:
    """No more rows of a source in a group than the cap says."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*group, *source).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")


def packed(df: DataFrame, group: str, order: list[str], tokens: str, budget: int = params.BUDGET_DOCS) -> DataFrame:
    """Rows in order while they fit the budget; a row that doesn't fit is passed over, and a smaller one after it may fit.

    What fits depends on what was taken, so it is a fold over each group's sorted rows (a query's candidates, which
    the channels bound before).
    """
    sorted_ = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, tokens))).alias("xs"))
    kind = f"struct<{df.select(*order, tokens).schema.simpleString()[7:-1]}>"
    fold = F.expr(f"""aggregate(xs, named_struct('used', 0, 'kept', cast(array() as array<{kind}>)),
      (a, x) -> if(a.used + x.{tokens} <= {budget}, named_struct('used', a.used + cast(x.{tokens} as int), 'kept', array_append(a.kept, x)), a))""")
    return sorted_.select(group, fold.alias("f")).select(group, F.explode("f.kept").alias("x")).select(group, "x.*")


def confidence(evidence: Column, chunk: Column, fact: Column) -> Column:
    """From the best evidence, chunk and fact scores; null where there is none."""
    blend = F.when(evidence.isNotNull() & fact.isNotNull(), evidence * 0.5 + chunk * 0.3 + fact * 0.2).when(evidence.isNotNull(), evidence * 0.7 + chunk * 0.3).otherwise(F.coalesce(fact, F.lit(0.0)))
    return F.round(T.clamp(blend), 2)


def fact_relevance(score: Column, hits: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(score, F.when(hits > 0, params.FACT_FLOOR).otherwise(score)) + hits * 0.04), 2)


def unsupported(answer: Column, context: Column) -> Column:
    """Answer tokens that neither are stop words nor occur, as they are or with an ending cut, in the context."""
    allowed = T.token_set(context)
    asked = F.filter(T.token_set(answer), lambda t: ~t.isin(*params.GROUNDING_STOPWORDS))
    return F.filter(asked, lambda t: ~F.arrays_overlap(T.stem_variants(t), allowed))


def grounded(sentence_tokens: Column, evidence_tokens: Column, question_type: Column) -> Column:
    """Whether a sentence shares enough tokens with a piece of evidence."""
    brief = question_type.isin("fact", "definition")
    need = F.greatest(F.when(brief, 1).otherwise(2), F.ceil(F.size(sentence_tokens) * F.when(brief, 0.25).otherwise(0.4)))
    return (F.size(sentence_tokens) == 0) | (F.size(F.array_intersect(sentence_tokens, evidence_tokens)) >= need)


def status(confidence_: Column, n_evidence: Column, forced: Column) -> Column:
    return F.when(n_evidence == 0, "refused").when((confidence_ >= params.CONFIDENT) | forced, "complete").otherwise("limited")


def diverse(df: DataFrame, group: str, text: str, score: str, most: int = 4, overlap: int = 5) -> DataFrame:
    """Greedy choice by score, without sentences that share `overlap` content words or more with one chosen before.

    What is chosen depends on what was chosen before, so it is a fold over each group's sorted rows that carries the chosen ones' words.
    """
    words = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")), " "), lambda w: (F.length(w) > 2) & ~w.isin(*params.GROUNDING_STOPWORDS)))
    row = F.struct(*df.columns)
    x = df.select(F.col(group).alias("_g"), F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("n"), F.coalesce(text, F.lit("")).alias("t"), words.alias("w"), row.alias("r")).alias("x"))
    sorted_ = x.groupBy("_g").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] < b["n"], -1).otherwise(1)).when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0)).alias("xs"))
    kind = x.schema["x"].dataType.simpleString()
    fold = F.expr(f"""aggregate(xs, cast(array() as array<{kind}>),
      (kept, x) -> if(size(kept) < {most} and not exists(kept, k -> size(array_intersect(k.w, x.w)) >= {overlap}), array_append(kept, x), kept))""")
    return sorted_.select(F.explode(fold).alias("x")).select("x.r.*")
