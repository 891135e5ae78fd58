"""One object for callers: documents in, questions in, answers, graph facts and metrics out, all as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule import params, session
from ferrule.functions import rules as L
from ferrule.functions import text as T
from ferrule.operators import answers as A
from ferrule.operators import cascade as C
from ferrule.operators import docs as D
from ferrule.operators import evidence as E
from ferrule.operators import graph as G
from ferrule.operators import ingest as I
from ferrule.operators import measure as M
from ferrule.operators import retrieve as R


class Retriever(Protocol):
    """A channel: (chunks, queries) to (query_id, channel, chunk_id, rank, score). among: the ids (one column) that may be given, of all if None."""

    def __call__(self, chunks: DataFrame, queries: DataFrame, among: DataFrame | None = None) -> DataFrame: ...


def bm25_channel(chunks: DataFrame, queries: DataFrame, k: int = 20, among: DataFrame | None = None) -> DataFrame:
    hits = R.bm25(chunks, queries, "chunk_id", F.col("text"), "query_id", F.col("query"), k, among)
    return hits.select("query_id", F.lit("bm25").alias("channel"), "chunk_id", "rank", "score")


def lexical_channel(chunks: DataFrame, queries: DataFrame, k: int = 20, among: DataFrame | None = None) -> DataFrame:
    hits = R.lexical_top(chunks, queries, "chunk_id", F.col("text"), F.coalesce("title", F.lit("")), "query_id", F.col("query"), k, among)
    return hits.select("query_id", F.lit("lexical").alias("channel"), "chunk_id", "rank", F.col("keyword_score").alias("score"))


def vector_channel(encoder: Callable, k: int = 20) -> Retriever:
    """A dense channel with an encoder UDF for questions; chunks carry `embedding`."""

    def run(chunks: DataFrame, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
        chunks = chunks if among is None else chunks.join(among, "chunk_id", "left_semi")
        q = queries.select("query_id", encoder("query").alias("qv"))
        hits = R.vector_topk(chunks, q, "chunk_id", "embedding", "query_id", "qv", k)
        return hits.select("query_id", F.lit("vector").alias("channel"), "chunk_id", "rank", "score")

    return run


class Engine:
    """chunks: chunk_id, text, title, category and, for a vector channel, embedding. triples: s, p, o, o_is_uri.

    scorer: a UDF of (query, text) for reranking. kg_query: from (query_id, query) to facts (query_id, entity, fact, score).
    generator: a UDF from a prompt to an answer; without one answers are extractive. on_stage(name, seconds) is told when
    a stage of respond() is done: its rows are written then, only the last stage is a plan yet.
    """

    def __init__(self, chunks: DataFrame, triples: DataFrame | None = None, channels: list[Retriever] | None = None, scorer: Callable | None = None, kg_query: Callable | None = None, generator: Callable | None = None, on_stage: Callable | None = None):
        self.chunks, self.triples, self.scorer, self.kg_query, self.generator, self.on_stage = chunks, triples, scorer, kg_query, generator, on_stage
        self.channels = channels or [bm25_channel, lexical_channel]
        self.timings: dict[str, float] = {}
        self.rows: dict[str, int] = {}  # that the stages of the last respond() wrote
        self.branches: dict[str, tuple[int, int]] = {}  # of the last respond(): questions that each branch read, and answered

    def _stage(self, name: str, make: Callable):
        start = time.monotonic()
        out = make()
        self.timings[name] = time.monotonic() - start
        if self.on_stage:
            self.on_stage(name, self.timings[name])
        return out

    def documents(self) -> DataFrame:
        return self.chunks.groupBy("title").agg(F.count("*").alias("chunks"))

    def add(self, chunks: DataFrame) -> Engine:
        """An engine with these chunks besides; those that it had before are replaced."""
        return self._with(I.appended(self.chunks, chunks, "chunk_id"))

    def remove(self, titles: DataFrame) -> Engine:
        """An engine without the chunks of these titles."""
        return self._with(self.chunks.join(titles.select("title"), "title", "left_anti").select(*self.chunks.columns))

    def _with(self, chunks: DataFrame) -> Engine:
        return Engine(chunks, self.triples, self.channels, self.scorer, self.kg_query, self.generator, self.on_stage)

    @classmethod
    def of_documents(cls, documents: DataFrame, **options) -> Engine:
        """From documents (doc_id, text, source, lang): chunks with stable ids."""
        base = documents.select("doc_id", "source", "lang")
        c = D.recursive_chunks(documents).join(base, "doc_id")
        c = c.select(T.chunk_id(F.col("source"), F.col("doc_id"), F.concat_ws(" ", F.col("chunk_index").cast("string"), "text")).alias("chunk_id"), "doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("category"))
        return cls(c, **options)

    def plan(self, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """query_id, question, query as retrieved with, follow-up note, intent, question type, category filter by intent.

        history: (query_id, turn, role, text) of what was said before; a question that follows up on the last one of the user is retrieved with both.
        """
        asked = queries.select("query_id", F.col("query").alias("question"), T.without_intent(F.col("query")).alias("query"))
        if history is not None:
            said = history.where("role = 'user'").select("query_id", "turn", T.squash(F.col("text")).alias("_t")).where("_t <> ''")
            asked = asked.join(said.groupBy("query_id").agg(F.max_by("_t", "turn").alias("_before")), "query_id", "left")
            follows = F.col("_before").isNotNull() & T.is_follow_up(F.col("question")) & (F.lower("_before") != F.lower(T.squash(F.col("question"))))
            asked = asked.withColumn("note", F.when(follows, F.concat(F.lit("Follow-up to: "), "_before"))).withColumn("query", F.when(follows, F.concat_ws("\n", "_before", "query")).otherwise(F.col("query"))).drop("_before")
        else:
            asked = asked.withColumn("note", F.lit(None).cast("string"))
        q = F.col("question")
        kind = T.intent(q)
        category = F.lit(None).cast("string")
        for name, value in params.CATEGORY_BY_INTENT.items():
            category = F.when(F.col("intent") == name, value).otherwise(category)
        return T.once(asked, "intent", kind).withColumn("question_type", T.question_type(q)).withColumn("category_filter", category)

    def retrieve(self, queries: DataFrame, top_n: int = 8, history: DataFrame | None = None) -> DataFrame:
        """The channels' hits fused and reranked, with texts joined late.

        A question with a category is answered from chunks of that category, before the best are taken; if the chunks have none of it, from all.
        """
        q = self.plan(queries, history)
        known = [c for c in sorted(set(params.CATEGORY_BY_INTENT.values())) if not self.chunks.where(F.col("category") == c).isEmpty()]
        hits = None
        for category in [None, *known]:
            mine = q.where(F.col("category_filter") == category) if category else q.where(F.col("category_filter").isNull() | ~F.col("category_filter").isin(*known)) if known else q
            among = self.chunks.where(F.col("category") == category).select("chunk_id") if category else None
            for channel in self.channels:
                h = channel(self.chunks, mine, among=among) if category else channel(self.chunks, mine)
                hits = h if hits is None else hits.unionByName(h)
        fused = R.rrf(hits, "query_id", "chunk_id").join(self.chunks.select("chunk_id", "text", "title"), "chunk_id").join(q, "query_id")
        return R.rerank(fused, "query_id", "chunk_id", top_n, self.scorer)

    def evidence(self, queries: DataFrame, most: int = 5, history: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
        """The best sentences of the best chunks, which are ordered as sources of answers before: those that a question's words or focus stand in, two a source, distinct."""
        hits = self.retrieve(queries, history=history)
        named = facts.groupBy("query_id").agg(F.collect_set(F.trim(T.searchable(F.col("entity")))).alias("_entities")) if facts is not None else None
        hits = hits.join(named, "query_id", "left") if named is not None else hits.withColumn("_entities", F.array().cast("array<string>"))
        entities = F.coalesce("_entities", F.array().cast("array<string>"))
        hits = R.answer_order(hits, A.answer_bonus(F.col("question"), F.col("question_type"), entities, F.col("title"), F.col("text")))
        s = hits.select("query_id", F.col("query").alias("_with"), F.col("question").alias("query"), "question_type", "chunk_id", "title", F.col("top_score").alias("chunk_score"), "reranker_score", F.explode(D.sentences(F.col("text"))).alias("sentence"))
        terms = L.grounding_terms(F.col("_with"))
        s = T.once(s, "hits", T.whole_word_hits(terms, T.padded(T.searchable(F.col("sentence"))))).where((F.col("hits") > 0) & ~L.is_low_value(F.col("sentence")))
        score = F.round(T.clamp(0.14 * F.col("hits") + 0.08 * L.definition_score(F.col("query"), F.col("sentence")) - F.when(L.is_incomplete(F.col("sentence")), 0.2).otherwise(0.0)), 6)
        s = s.withColumn("score", score).withColumn("key", T.sentence_key(F.col("sentence")))
        one = R.ranked(s, ["query_id", "key"], [F.desc("score"), F.asc("chunk_id")], 1).drop("rank", "_with")
        capped = E.capped(one, ["query_id"], ["title"], [F.desc("score"), F.asc("key")], F.lit(2))
        return R.ranked(capped, ["query_id"], [F.desc("score"), F.asc("key")], most)

    def answer(self, queries: DataFrame) -> DataFrame:
        """query_id, status, confidence, answer, sources: extractive, and refused where there is no evidence."""
        e = self.evidence(queries)
        top = e.groupBy("query_id").agg(
            F.max("score").alias("ev"), F.least(F.lit(1.0), F.max("chunk_score")).alias("ch"), F.count("*").alias("n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]), " ").alias("answer"), F.array_join(F.array_sort(F.collect_set("title")), ",").alias("sources"),
        )
        q = queries.select("query_id").join(top, "query_id", "left")
        c = E.confidence(F.col("ev"), F.col("ch"), F.lit(None).cast("double"))
        return q.select("query_id", E.status(c, F.coalesce("n", F.lit(0)), F.lit(False)).alias("status"), c.alias("confidence"), L.cleaned_answer(F.col("answer")).alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"))

    def respond(self, queries: DataFrame, most: int = 5, history: DataFrame | None = None, people: DataFrame | None = None, uploads: DataFrame | None = None) -> DataFrame:
        """query_id, status, confidence, answer, branch, sources, facts: retrieval with history, facts, direct answers by a cascade, a budgeted context, generation, and the grounding check.

        What isn't grounded, and what a generator refuses or fails to give, is answered directly, or by the best evidence sentence. people: (name, designation, department);
        uploads: (query_id, chunk_id, text). Facts are asked for with the query as retrieved with.
        """
        # what several later steps read is written once: else each would search again
        plan = self._stage("plan", lambda: session.kept(self.plan(queries, history), "plan", self.rows))
        none = queries.sparkSession.createDataFrame([], plan.select("query_id").schema.add("entity", "string").add("fact", "string").add("score", "double"))
        facts = self._stage("facts", lambda: session.kept(self.kg_query(plan.select("query_id", "query")), "facts", self.rows) if self.kg_query else none)
        e = self._stage("evidence", lambda: session.kept(self.evidence(queries, most, history, facts if self.kg_query else None).select("query_id", "rank", "title", F.lit(None).cast("int").alias("page"), "sentence", "score", "chunk_score").withColumn("match_type", F.lit("vector")), "evidence", self.rows))
        ranked_facts = R.ranked(facts, ["query_id"], [F.desc("score"), F.asc("entity"), F.asc("fact")], 12)
        context = A.budgeted(ranked_facts.select("query_id", "rank", "entity", "fact"), e)
        asked = plan.select("query_id", F.col("question").alias("query"), "question_type", "note")
        direct = self._stage("direct", lambda: C.direct_answers(asked.drop("note"), e, facts if self.kg_query else None, people, uploads, self._branch)).withColumnRenamed("answer", "direct")
        scores = e.groupBy("query_id").agg(F.max("score").alias("ev"), F.least(F.lit(1.0), F.max("chunk_score")).alias("ch"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("title")), ",").alias("sources"), F.min_by("sentence", "rank").alias("first"))
        kg = facts.groupBy("query_id").agg(F.max("score").alias("kg"))
        x = asked.join(context, "query_id", "left").join(direct, "query_id", "left").join(scores, "query_id", "left").join(kg, "query_id", "left")
        empty = F.array().cast("array<string>")
        x = x.withColumn("facts", F.coalesce("facts", empty)).withColumn("texts", F.concat(F.coalesce("evidence", empty), F.coalesce("facts", empty), F.filter(F.array("direct"), lambda d: d.isNotNull())))
        x = x.withColumn("confidence", E.confidence(F.col("ev"), F.col("ch"), F.col("kg"))).withColumn("fallback", F.coalesce("direct", "first", F.try_element_at("facts", F.lit(1)), F.lit(params.REFUSAL)))
        shown = A.prompt(A.generation_context(F.col("facts"), F.coalesce("evidence", empty), F.col("direct"), F.coalesce("note", F.lit(""))), F.col("question_type"))
        x = x.withColumn("generated", self.generator(shown) if self.generator else F.col("fallback"))
        grounded = A.answer_is_grounded(F.col("generated"), F.col("confidence"), F.col("question_type"), F.col("texts"), F.lit(False))
        answer = F.when(F.size("texts") == 0, params.REFUSAL).otherwise(A.finalised(F.col("generated"), F.col("fallback"), F.col("question_type"), grounded))
        status = E.status(F.col("confidence"), F.size("texts"), F.lit(False))
        return self._stage("answer", lambda: x.select("query_id", status.alias("status"), F.col("confidence"), answer.alias("answer"), "branch", F.coalesce("sources", F.lit("")).alias("sources"), "facts"))

    def _branch(self, name: str, read: int, answered: int) -> None:
        self.branches[name] = (read, answered)

    def graph_query(self, seeds: DataFrame, depth: int = 2, most: int = 12) -> DataFrame:
        """seed, fact, score, rank: facts of the nodes within `depth` of each seed."""
        labels = self.triples.where("p = 'label'").select("s", F.col("o").alias("label"))
        near = G.hops(self.triples, seeds, depth)
        facts = near.join(G.facts(self.triples, labels), near["node"] == F.col("s"))
        scored = facts.select("seed", "node", "fact", F.round(F.when(F.col("depth") <= 1, 0.94).otherwise(0.84), 2).alias("score"))
        return R.ranked(scored, ["seed"], [F.desc("score"), F.asc("node"), F.asc("fact")], most)

    def evaluate(self, queries: DataFrame, truth: DataFrame) -> DataFrame:
        """One row: recall at 3, 5 and 10 and the mean reciprocal rank, for truth (query_id, chunk_id)."""
        asked = truth.select("query_id").distinct()
        first = self.retrieve(queries, 10).join(truth, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
        at = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"recall{k}")
        return asked.join(first, "query_id", "left").agg(F.count("*").alias("n"), at(3), at(5), at(10), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))

    def readiness(self) -> DataFrame:
        c = self.chunks.agg(F.count("*").alias("chunks"))
        return c.withColumn("state", F.when(F.col("chunks") == 0, "empty").otherwise("ready"))

    def judged(self, queries: DataFrame, truth: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Details of each question and one row of metrics, for truth (query_id, ground_truth, context: texts that a hit should match): recall, reciprocal rank, correctness, share of answers that evidence doesn't support."""
        hits = session.kept(self.retrieve(queries, 10, history).select("query_id", "rank", "text"), "hits", self.rows)
        answers = self.respond(queries, history=history).select("query_id", "status", "answer")
        details = session.kept(M.details(hits, answers, truth), "details", self.rows)
        return details, M.summary(details)
