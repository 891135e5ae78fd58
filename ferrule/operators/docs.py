"""Document processing: line cleaning, page sections, sentences, chunks, pages of HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrule import params, session
from ferrule.functions import text as T

PAGE_MARKER = r"^\[PAGE\s+[0-9]+\]$"


def lines_of(text: Column) -> Column:
    """The text's squashed lines that aren't empty, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), T.squash), lambda x: x != "")


def _words(x: Column) -> Column:
    return F.size(F.split(x, " "))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, i, s): the squashed lines that aren't empty, with their numbers; one shuffle by document serves all that follows."""
    each = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n")).alias("i", "s"))
    return each.select(id_col, "i", T.squash(F.col("s")).alias("s")).where("s <> ''").repartition(id_col)


def _rejoined(lines: DataFrame, id_col: str) -> DataFrame:
    got = lines.groupBy(id_col).agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("x"))
    return got.select(id_col, "n_lines", F.array_join("x.s", "\n").alias("cleaned"))


def clean_page(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, cleaned): without noise lines, and of lines of up to 10 words that come again only the first."""
    kept = _numbered(docs, id_col, text_col).where(~T.is_noise(F.col("s")))
    k = F.row_number().over(W.partitionBy(id_col, F.lower("s")).orderBy("i"))
    return _rejoined(kept.withColumn("k", k).where((F.col("k") == 1) | (_words(F.col("s")) > 10)), id_col)


def clean_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, cleaned): without noise, short lines that occur over twice, and lines like the one before."""
    lines = _numbered(docs, id_col, text_col).withColumn("n", F.count("*").over(W.partitionBy(id_col, F.lower("s"))))
    kept = lines.where(F.col("s").rlike(PAGE_MARKER) | (~T.is_noise(F.col("s")) & ~((F.col("n") > 2) & (_words(F.col("s")) <= 6))))
    kept = kept.withColumn("before", F.lag(F.lower("s")).over(W.partitionBy(id_col).orderBy("i")))
    return _rejoined(kept.where(F.col("before").isNull() | (F.col("before") != F.lower("s")) | (_words(F.col("s")) > 20)), id_col)


def page_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seq, page, section): the text between page markers; what stands before the first has a null page."""
    parts = F.split(F.concat(F.lit("[PAGE ]"), F.coalesce(F.col(text_col), F.lit(""))), r"(?=\[PAGE\s*[0-9]*\])")
    each = docs.select(id_col, F.posexplode(F.filter(parts, lambda p: p != "")).alias("seq", "p"))
    page = F.nullif(F.regexp_extract("p", r"^\[PAGE\s*([0-9]*)\]", 1), F.lit("")).cast("int")
    section = T.squash(F.regexp_replace("p", r"^\[PAGE\s*[0-9]*\]", ""))
    return each.select(id_col, F.col("seq").cast("long").alias("seq"), page.alias("page"), section.alias("section")).where("section <> ''")


def sentences(text: Column) -> Column:
    """Sentences, split after . ! ? before a capital or digit, at line ends, and after ": " before a capital or digit; titles and initials don't end one."""
    mark = F.regexp_replace(F.coalesce(text, F.lit("")), r"\b(Dr|Mr|Mrs|Ms|Prof)\. ", "$1\u0001 ")
    mark = F.regexp_replace(mark, r"\b([A-Z])\. ", "$1\u0001 ")
    mark = F.regexp_replace(mark, r"([.!?:])\s+(?=[A-Z0-9])", "$1\u0002")
    mark = F.regexp_replace(mark, r"\n+", "\u0002")
    parts = F.transform(F.split(mark, "\u0002"), lambda x: T.squash(F.regexp_replace(x, "\u0001", ".")))
    return F.filter(parts, lambda x: x != "")


def fixed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = params.CHUNK_SIZE, overlap: int = params.CHUNK_OVERLAP) -> DataFrame:
    """(id, chunk_index, text): windows of `size` characters, each `size - overlap` after the last."""
    text = T.squash(F.col(text_col))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("t") - overlap - 1), F.lit(size - overlap))
    each = docs.select(id_col, text.alias("t")).where("t <> ''").select(id_col, "t", F.posexplode(starts).alias("chunk_index", "at"))
    return each.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("t").substr(F.col("at") + 1, F.lit(size)).alias("text"))


def pack(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Recursive splitting: by the first separator that occurs, pieces merged up to size with an overlap, pieces too long split further."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] or ("",)
    pieces = list(text) if sep == "" else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out, held, n = [], [], 0

    def emit():
        if s := "".join(held).strip():
            out.append(s)

    for p in pieces:
        if len(p) > size:
            emit()
            held, n = [], 0
            out += pack(p, size, overlap, rest)
            continue
        if n + len(p) > size:
            emit()
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.pop(0))
        held.append(p)
        n += len(p)
    emit()
    return out


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = params.CHUNK_SIZE, overlap: int = params.CHUNK_OVERLAP) -> DataFrame:
    """(id, chunk_index, text): chunks packed along paragraphs, lines, sentences, words."""
    session.ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for k, c in enumerate(pack(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{docs.select(id_col).schema.simpleString()[7:-1]}, chunk_index long, text string")


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, n_lines, cleaned), the visible text: scripts, styles, navigation, footers and comments out, the article or main part if there is one, tags out, entities of the basic set."""
    x = F.coalesce(F.col(html_col), F.lit(""))
    for tag in ("script", "style", "nav", "footer", "header", "noscript", "form", "svg", "aside"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    picked = pages.select(id_col, F.explode(F.array(x)).alias("x")).select(id_col, F.explode(F.array(F.struct(main_of(F.col("x")).alias("m"), "x"))).alias("p"))
    x = F.when(F.col("p.m") != "", F.col("p.m")).otherwise(F.col("p.x"))
    x = F.regexp_replace(x, r"(?i)<h[1-4]\b[^>]*>", "\n\u0001")  # headings stay, however short
    x = F.regexp_replace(x, r"(?i)</?(p|div|h[1-6]|li|br|tr|td|section)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    kept = _numbered(picked.select(id_col, x.alias("t")), id_col, "t").where((_words(F.col("s")) >= 3) | F.col("s").rlike("^\u0001."))
    kept = kept.withColumn("s", F.replace("s", F.lit("\u0001"), F.lit("")))
    k = F.row_number().over(W.partitionBy(id_col, F.lower("s")).orderBy("i"))
    return _rejoined(kept.withColumn("k", k).where("k = 1"), id_col)


def main_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<(?:main|article)\b[^>]*>(.*?)</(?:main|article)>", 1)


def html_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, label): absolute links, the first label of each, labels not empty."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r'(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    each = pages.select(id_col, F.regexp_extract(url_col, r"^([a-z]+://[^/?#]+)", 1).alias("base"), F.posexplode(links).alias("pos", "a"))
    href = F.regexp_extract("a", r'(?is)href="([^"]*)"', 1)
    label = T.squash(F.regexp_replace(F.regexp_extract("a", r"(?is)>(.*)</a>", 1), "<[^>]*>", ""))
    each = each.select(id_col, "pos", F.when(href.startswith("/"), F.concat("base", href)).otherwise(href).alias("url"), label.alias("label")).where("label <> ''")
    return each.groupBy(id_col, "url").agg(F.min_by("label", "pos").alias("label"))


def html_title(html: Column) -> Column:
    return T.squash(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def phrases(text: Column, longest: int = 4, stop: tuple[str, ...] = params.STOPWORDS) -> Column:
    """The whole phrase, then its word n-grams from `longest` words down to one, each once."""
    t = F.filter(T.tokens(text), lambda w: ~w.isin(*stop))
    n = F.size(t)

    def grams(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
        if k == 1:
            every = F.filter(every, lambda p: (F.length(p) >= 3) | p.rlike("[0-9]"))
        return F.when(n >= k, every).otherwise(F.array().cast("array<string>"))

    whole = F.when(n > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, *[grams(k) for k in range(longest, 0, -1)]))


#: A sentence that starts by saying what something is: its subject in the first group (a fixed pattern).
DEFINITION = r"^([A-Z][A-Za-z]+( [a-z]+){0,2}) (is|are|was|were) "


def defined_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences_read: int = 240, most: int = 8) -> DataFrame:
    """(id, label, first, description, mentions): subjects of defining sentences, their first definition, and in how many sentences they are named.

    Of each document the first `most` entities, in order of their definitions.
    """
    s = docs.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("i", "s")).where(F.col("i") < sentences_read)
    found = s.select(id_col, "i", "s", F.regexp_extract("s", DEFINITION, 1).alias("label")).where("label <> ''")
    first = found.groupBy(id_col, F.lower("label").alias("key")).agg(F.min("i").cast("long").alias("first"), F.min_by("label", "i").alias("label"), F.min_by("s", "i").alias("description"), F.count("*").alias("mentions"))
    k = F.row_number().over(W.partitionBy(id_col).orderBy("first"))
    return first.withColumn("k", k).where(F.col("k") <= most).drop("k", "key")


def carry_forward(df: DataFrame, value: Column, partition: list[str], order: list[str]) -> Column:
    """The last value that isn't null so far."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
