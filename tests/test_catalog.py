"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from ferrule.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck(sf_dir="/root/testdata/sf0.001"):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    v = v.tolist() if hasattr(v, "tolist") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


#: Columns that must show more than one value, of queries whose rules have several outcomes: so that each branch is reached.
VARIED = {
    "intent_route": "intent", "category_by_intent": "category", "question_type": "question_type", "location_and_role": "location role_label", "section_penalty": "penalty", "grounding_check": "grounded", "role_match": "head teacher",
    "document_priority": "priority", "qualifier_aliases": "aliases", "answer_grounded": "grounded", "sentence_rules": "heading incomplete low_value spacing", "name_in_role": "head_of_department", "overview_evidence": "sentence", "person_records": "name register",
    "upload_steps": "state progress", "run_healed": "state", "topic_boost": "title_score keyword_score", "regulation_faqs": "question", "linear_fusion": "vector bm25 keyword title coverage rerank score", "evidence_strength": "strength",
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    for c in VARIED.get(name, "").split():
        assert got[c].map(plain).nunique(dropna=False) > 1, f"{c} is {got[c].iloc[0]} in all rows"
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_removed_blocks_change_pages(spark, sf):
    p = catalog.QUERIES["boilerplate_removed"](spark, sf)
    assert 0 < p.where("text <> before").count() < p.count()
