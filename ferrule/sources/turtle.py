"""A reader and writer of the plain subset of Turtle: prefixes, "a", ";", ",", quoted strings, numbers, comments."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule import session

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<string>\"{3}.*?\"{3}|"(?:[^"\\]|\\.)*")(?P<suffix>\^\^\S+?(?=[\s;,.])|@[A-Za-z-]+)?|(?P<dot>\.(?=\s|$))|(?P<mark>[;,\[\]])|(?P<word>[^\s;,<>"]+?(?=[\s;,]|\.\s|\.$|$))""", re.S)
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def parse(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(s, p, o, whether o is a node) of each statement."""
    prefixes: dict[str, str] = {}

    def resolve(kind: str, t: str) -> tuple[str, bool]:
        if kind == "iri":
            return t[1:-1], True
        if kind == "string":
            body = t[3:-3] if t.startswith('"""') else t[1:-1]
            return re.sub(r'\\(["\\nt])', lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body), False
        name, colon, rest = t.partition(":")
        if colon and name in prefixes:
            return prefixes[name] + rest, True
        return t, False

    statement: list[tuple[str, str]] = []
    pos, subject, predicate = 0, None, None
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"can't read Turtle at {text[pos : pos + 40]!r}")
        pos = m.end()
        kind = m.lastgroup if m.lastgroup != "suffix" else "string"
        if not kind:
            continue
        t = m[kind]
        if kind == "dot":
            if statement and statement[0][1].lower() in ("@prefix", "prefix"):
                prefixes[statement[1][1].rstrip(":")] = statement[2][1][1:-1]
            statement, subject, predicate = [], None, None
            continue
        statement.append((kind, t))
        if statement[0][1].lower() in ("@prefix", "prefix", "@base"):
            continue
        if kind == "mark":
            predicate = None if t == ";" else predicate
        elif subject is None:
            subject = resolve(kind, t)[0]
        elif predicate is None:
            predicate = TYPE if t == "a" else resolve(kind, t)[0]
        else:
            o, node = resolve(kind, t)
            yield subject, predicate, o, node


def read(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all Turtle files at path, a file at a time."""
    session.ship(spark)
    files = spark.read.text(path, wholetext=True).withColumn("graph", F.col("_metadata.file_name"))

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(*t, g) for text, g in zip(b["value"], b["graph"], strict=True) for t in parse(text)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_is_uri", "graph"])

    return files.mapInPandas(run, "s string, p string, o string, o_is_uri boolean, graph string")


def literal(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def lines(triples: DataFrame) -> DataFrame:
    """(line): a statement each; write it with the text sink."""
    node = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    o = F.when(F.col("o_is_uri"), node(F.col("o"))).otherwise(F.concat(F.lit('"'), literal(F.col("o")), F.lit('"')))
    return triples.select(F.concat_ws(" ", node(F.col("s")), node(F.col("p")), o, F.lit(".")).alias("line"))
