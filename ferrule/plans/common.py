"""Tables, and the SQL twins of the column functions, for the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule import params


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; text tables that come in fewer files than there are cores (one row group, say, of which one task reads all) are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and len(df.inputFiles()) < cores else df


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def searchable(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s]', ' ', 'g')"


def compact(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({searchable(x)}, '\\s+'), lambda t: t <> '')"


def unique(x: str) -> str:
    """Distinct values of a list column, in order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def keywords(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: length(t) >= 3 AND t NOT IN ({listed(params.STOPWORDS)}))"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def starts(x: str, terms) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{t}')" for t in terms) + ")"


def word_count(x: str) -> str:
    return f"len(list_filter(string_split({squash(x)}, ' '), lambda w: w <> ''))"


def noise(x: str) -> str:
    """x: an expression of a squashed line."""
    t = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    n = f"len({t})"
    nav = f"len(list_filter({t}, lambda w: w IN ({listed(params.NAVIGATION)})))"
    con = f"len(list_filter({t}, lambda w: w IN ({listed(params.CONTACT)})))"
    return f"""({x} = '' OR (NOT regexp_full_match({x}, '\\[PAGE\\s+[0-9]+\\]') AND ({any_of(f"lower({x})", params.NOISE_PHRASES)} OR {n} = 0
      OR ({n} >= 8 AND {nav} >= greatest(5, floor({n} * 0.45)) AND {con} = 0) OR ({n} >= 6 AND len(list_distinct({t})) <= greatest(2, floor({n} / 4))))))"""


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\r?\\n'), lambda s: {squash('s')}), lambda s: s <> '')"


#: Questions about parts, of every intent, type and role that the rules know; {x} is the part. An SQL expression of both engines.
QUESTION_FORMS = (
    "What is {x}?", "Who is the head of department for {x}?", "Show the syllabus and credit of {x}", "Is there a regulation on {x}?", "Explain {x}", "Compare {x} and its kind", "Where is {x} located?", "How many {x} are left?", "Is the principal in charge of {x}?",
    "Which professor knows {x}", "Define {x}.", "How does {x} work?", "List every {x}", "{x}", "Give me the address of {x}", "Why is {x} used", "Tell me about {x}", "A class teacher asks for {x}",
)
QUESTION = f"CASE p_partkey % {len(QUESTION_FORMS)} " + " ".join(f"WHEN {k} THEN {' || '.join(x for x in (chr(39) + q.split('{x}')[0] + chr(39), 'p_name', chr(39) + q.split('{x}')[1] + chr(39)) if x != chr(39) * 2)}" for k, q in enumerate(QUESTION_FORMS)) + " END"
TURNS = f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1 - p_partkey, 0, 'user', {QUESTION} FROM part)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TURNS: the conversations' turns, and a question about each part as a conversation of its own."""
    asked = table(spark, sf_dir, "part").selectExpr("-1 - p_partkey AS conv_id", "cast(0 as long) AS turn", "'user' AS role", f"{QUESTION} AS text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(asked)


def marked(text: str, number: str) -> str:
    """A text with front matter, section heads and runs of letters before some rows' own; an SQL expression of both engines."""
    return f"CASE {number} % 9 WHEN 1 THEN 'Table of contents ' || {text} WHEN 2 THEN 'Case study: ' || {text} WHEN 3 THEN 'S u b m i t t e d  b y ' || {text} WHEN 4 THEN 'abcdefghijklmnopqrstuvwxyzabcd ' || {text} WHEN 5 THEN 'Declaration. Appendix ' || {text} ELSE {text} END"
