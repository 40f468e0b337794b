"""Language of a text: the nearest of several centroids per language.

A text is a vector of hashed letter pairs and triples, (1 + log count) times inverse
document frequency, of length one. Each language has a few centroids (spherical k-means).
The prediction is the language of the centroid with the highest cosine.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 4096
#: Characters that are worked on at once, which bounds memory for very long texts.
CHUNK = 1 << 20
#: Documents per language that the centroids are fitted on, and languages at most.
FIT_PER_LANG, MAX_LANGS = 300, 500
CLUSTERS = 3


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> np.ndarray:
    """Counts of hashed pairs and triples of letters; every run of other characters is one space."""
    counts = np.zeros(DIMS, np.int64)
    if not text:
        return counts
    tail = np.zeros(1, np.uint32)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le"), np.uint32)
        codes = np.concatenate([tail, np.where(_letters()[codes], codes, 0).astype(np.uint32)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        codes = codes[keep]
        if at + CHUNK >= len(text) and codes[-1]:
            codes = np.append(codes, np.uint32(0))
        mixed = codes * np.uint32(2654435761)
        pair = mixed[:-1] * np.uint32(31) ^ mixed[1:]
        triple = pair[:-1] * np.uint32(37) ^ mixed[2:]
        # what ends in the characters kept from before is counted already
        for h in (pair[len(tail) - 1 :], triple[max(len(tail) - 2, 0) :]):
            counts += np.bincount((h * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS)
        tail = codes[-2:]
    return counts


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    x = np.stack([grams(t) for t in texts]).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-9)


def _document_frequency(batches):
    total, docs = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            total += grams(text) > 0
            docs += 1
    yield pd.DataFrame({"bucket": np.arange(-1, DIMS), "n": np.concatenate([[docs], total])})


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the mean and then the rows that are farthest from what is chosen."""
    centers = [x.mean(0)]
    while len(centers) < min(k, len(x)):
        near = np.max(x @ np.stack([c / max(np.linalg.norm(c), 1e-9) for c in centers]).T, axis=1)
        centers.append(x[int(np.argmin(near))])
    c = np.stack(centers)
    for _ in range(20):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


class Model:
    """Inverse document frequencies, centroids, their languages, and the cosine below which a text is far from all."""

    def __init__(self, idf, centroids, langs, floor):
        self.idf, self.centroids, self.langs, self.floor = idf, centroids, langs, floor


def fit(docs: DataFrame, per_lang: int = FIT_PER_LANG, clusters: int = CLUSTERS) -> Model | None:
    """Learn from (doc_id, text, lang) rows with a language and a letter; None if there are none.

    Document frequencies come from all rows. Centroids are fitted on about ``per_lang`` rows
    of each language, chosen by a hash of the id; that bound times MAX_LANGS bounds what the
    driver gets. The floor is the 0.5 % quantile of the fitted rows' cosines, less 0.05.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    langs = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return None
    df = np.zeros(DIMS + 1)
    for r in rows.select("text").mapInPandas(_document_frequency, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r.bucket + 1] = r.n
    idf = np.log((1 + df[0]) / (1 + df[1:])).astype(np.float32) + 1
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))) for lang, n in sorted(langs.items())])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share * 1_000_000)
    chosen = chosen.select("lang", "doc_id", "text", F.xxhash64("text").alias("h"))

    @F.pandas_udf("array<float>")
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([vectors([t], idf)[0] for t in text])

    found: dict[str, list] = {}
    for r in chosen.select("lang", "doc_id", "h", features("text").alias("x")).toLocalIterator():
        found.setdefault(r.lang, []).append((r.doc_id is None, r.doc_id or 0, r.h, np.asarray(r.x, np.float32)))
    names, centers, cosines = [], [], []
    for lang in sorted(found):
        x = np.stack([v for *_, v in sorted(found[lang], key=lambda v: v[:3])])
        c = _clusters(x, clusters)
        names += [lang] * len(c)
        centers.append(c)
        cosines.append((x @ c.T).max(1))
    if not names:
        return None
    return Model(idf, np.concatenate(centers).astype(np.float32), names, float(np.quantile(np.concatenate(cosines), 0.005)) - 0.05)


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: str = "_lang") -> DataFrame:
    """``into``: struct of lang_pred, score (cosine, 0 to 1) and far (below the model's floor).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    nothing could be learned. Ties go to the language that sorts first. Whole texts count,
    in blocks of rows and characters that bound memory; repeated rows get equal results.
    """
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("far", T.BooleanType())])

    @F.pandas_udf(schema)
    def nearest(texts: pd.Series) -> pd.DataFrame:
        langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        if model is not None:
            for at in range(0, len(texts), 256):
                x = vectors(texts.iloc[at : at + 256], model.idf)
                # a text without letters has no grams
                cos = np.clip(x @ model.centroids.T, 0, 1)
                best = cos.argmax(1)
                has = np.linalg.norm(x, axis=1) > 0
                langs[at : at + 256] = np.where(has, np.array(model.langs, object)[best], "und")
                scores[at : at + 256] = np.where(has, cos[np.arange(len(cos)), best], 0)
        floor = model.floor if model is not None else 1.0
        return pd.DataFrame({"lang_pred": langs, "score": scores, "far": scores < floor})

    return docs.withColumn(into, nearest(text))
