"""A cascade of branches: each is handed only the questions that no branch before it has answered."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule import params, session
from ferrule.functions import rules as L
from ferrule.functions import text as T

from . import answers as A
from .retrieve import ranked

#: From open questions to (key, answer); null answers count as none.
Branch = Callable[[DataFrame], DataFrame]


def cascade(questions: DataFrame, branches: list[tuple[str, Branch]], key: str = "query_id", on_branch: Callable[[str, int, int], None] | None = None) -> DataFrame:
    """(key, answer, branch) of each question: that of the first branch that has an answer, null where none has.

    What a branch answers is written to the shared folder, and the next one starts from the rest; when none is left, no further branch
    runs. on_branch(name, questions read, answers) is told after each. A branch may give a question several answers: the smallest counts.
    """
    spark = questions.sparkSession
    folder = f"{session.shared_folder(spark)}/cascade-{uuid.uuid4().hex}"
    atexit.register(session.forget, folder)
    every = left = session.kept(questions, "questions")
    n, done = left.count(), None
    for k, (name, branch) in enumerate(branches):
        if not n:
            break
        found = branch(left).select(key, "answer").where("answer is not null").groupBy(key).agg(F.min("answer").alias("answer"))
        found.withColumn("branch", F.lit(name)).write.parquet(f"{folder}/{k}")
        mine = spark.read.parquet(f"{folder}/{k}")
        m = mine.count()
        if on_branch:
            on_branch(name, n, m)
        done = mine if done is None else done.unionByName(mine)
        left, n = left.join(mine, key, "left_anti"), n - m
    if done is None:
        return every.select(key, F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("branch"))
    return every.select(key).join(done, key, "left")


def best_definition(evidence: DataFrame, least: float = 1.6) -> DataFrame:
    """(query_id, answer): the evidence sentence that defines the question's focus best."""
    focus = T.focus_phrase(F.col("query"))
    x = T.once(evidence, "_focus", focus)
    x = T.once(x, "_x", A.extracted(F.col("sentence"), F.col("_focus"))).where((F.col("_x") != "") & ~L.is_low_value(F.col("_x")) & ~L.is_incomplete(F.col("_x")))
    x = T.once(x, "_d", L.definition_score(F.col("_focus"), F.col("_x"))).where(F.col("_d") >= least)
    return ranked(x.select("query_id", "_x", "_d", F.col("rank").alias("_r")), ["query_id"], [F.desc("_d"), F.asc("_r"), F.asc("_x")], 1).select("query_id", F.col("_x").alias("answer"))


def role_of(question: Column) -> Column:
    """The first role that a question asks for; null if none."""
    out = None
    for label in A.ROLES:
        out = (F if out is None else out).when(A.holds_role(label, question), label)
    return out


def named_for_role(evidence: DataFrame) -> DataFrame:
    """(query_id, answer): "role: name" of the evidence that gives the asked role a name; structured evidence and short sentences come first."""
    x = T.once(evidence, "_role", role_of(F.col("query"))).where("_role is not null")
    name = None
    for label in A.ROLES:
        name = (F if name is None else name).when(F.col("_role") == label, A.name_in_role(label, F.col("sentence")))
    x = T.once(x, "_name", name).where("_name is not null")
    score = F.col("score") + F.when(F.col("match_type") == "structured", params.ROLE_STRUCTURED).otherwise(0.0) + F.when(T.word_count(F.col("sentence")) <= params.ROLE_SHORT_WORDS, params.ROLE_SHORT).otherwise(0.0)
    best = ranked(x.select("query_id", "_role", "_name", F.round(score, 6).alias("_s"), F.col("rank").alias("_r")), ["query_id"], [F.desc("_s"), F.asc("_r"), F.asc("_name")], 1)
    return best.select("query_id", F.concat("_role", F.lit(": "), L.person_name(F.col("_name"))).alias("answer"))


def direct_answers(questions: DataFrame, evidence: DataFrame, facts: DataFrame | None = None, people: DataFrame | None = None, texts: DataFrame | None = None, on_branch: Callable | None = None) -> DataFrame:
    """(query_id, answer, branch): what answers a question by itself.

    questions: query_id, query, question_type. evidence: query_id, rank, sentence, score, match_type. facts: query_id, entity, fact, score.
    people: name, designation, department. texts: query_id, chunk_id, text of uploads. Explanations have no direct answer.
    """

    def of(left: DataFrame) -> DataFrame:
        return evidence.join(left.select("query_id", "query", "question_type"), "query_id")

    kind, role = F.col("question_type"), role_of(F.col("query")).isNotNull()
    branches: list[tuple[str, Branch]] = [("definition", lambda q: best_definition(of(q.where(kind == "definition"))))]
    if people is not None:
        profile = A.profile_sentence(F.col("name"), F.col("designation"), F.col("department")).alias("answer")
        branches.append(("profile", lambda q: A.profile_match(q.where(kind != "explanation"), people).select("query_id", profile)))
    if texts is not None:
        told = F.concat_ws(", ", "name", "register", "project", "department", "year").alias("answer")
        branches.append(("person", lambda q: A.person_records(texts.join(q.where(kind != "explanation").select("query_id", "query"), "query_id")).select("query_id", told)))
    branches += [
        ("role", lambda q: named_for_role(of(q.where((kind != "explanation") & role)))),
        ("fact", lambda q: A.best_fact(of(q.where((kind != "explanation") & ~role))).withColumnRenamed("sentence", "answer")),
    ]
    if facts is not None:
        first = lambda q: ranked(facts.join(q.where(kind != "explanation").select("query_id", "query"), "query_id"), ["query_id"], [F.desc("score"), F.asc("entity"), F.asc("fact")], 1)
        said = F.when(role & (F.col("entity") != ""), F.concat(role_of(F.col("query")), F.lit(": "), "entity")).otherwise(F.concat_ws(": ", F.nullif("entity", F.lit("")), F.nullif("fact", F.lit(""))))
        branches.append(("graph", lambda q: first(q).select("query_id", T.squash(said).alias("answer"))))
    return cascade(questions, branches, "query_id", on_branch)
