"""The functions that only Python has, as Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts that are Python's at once, of a batch.
TEXTS = 64


@F.arrow_udf(T.StringType())
def nfkc(x: pa.Array) -> pa.Array:
    """Unicode NFKC, NUL as a space; null gives ''."""
    one = lambda t: unicodedata.normalize("NFKC", t or "").replace("\x00", " ")
    parts = [pa.array([one(t) for t in x.slice(at, TEXTS).to_pylist()], pa.string()) for at in range(0, len(x), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def spelling(terms: list[str], cutoff: float = 0.8):
    """A UDF that replaces words of over three letters by the closest known term, if no more than two letters longer or shorter."""

    def fix(word: str) -> str:
        if len(word) <= 3:
            return word
        near = difflib.get_close_matches(word.lower(), terms, n=1, cutoff=cutoff)
        return near[0] if near and abs(len(near[0]) - len(word)) <= 2 else word

    @F.pandas_udf(T.StringType())
    def corrected(x: pd.Series) -> pd.Series:
        return x.fillna("").map(lambda t: " ".join(map(fix, t.split())))

    return corrected


def hashing_encoder(dims: int = 64):
    """A deterministic stand-in for a text encoder: hashed word counts, scaled to length 1."""
    import zlib

    import numpy as np

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(x: pd.Series) -> pd.Series:
        out = []
        for t in x.fillna(""):
            v = np.zeros(dims)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return encode
