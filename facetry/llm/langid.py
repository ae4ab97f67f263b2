"""Language ID: nearest of several clustered TF-IDF centroids per language, with distance-based rejection.

A text's vector counts its hashed letter bigrams and trigrams (lower case, runs of other characters as one blank),
damps them with log(1 + n), weighs them by inverse document frequency and has length one. Spherical k-means in one
task per language clusters a bounded sample of labelled documents, about `sample` of each language chosen by a hash
of the id; the language of the centroid with the greatest cosine is predicted for every whole text. A text is
rejected when its cosine is below `slack` times the first percentile that texts of its language and size reach in
the sample; the limits are fitted for sizes from a few letters up, so short clean texts are not turned away.

Defined cases: a null text or one without a letter is `und`, rejected, with score 0; documents without a language
or id are not learned from but are predicted (held_out is false without an id); repeated rows get the same prediction; with nothing to learn from
everything is `und`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, text_or_empty

SIZE, CLUSTERS, SAMPLE, SLACK = 2048, 4, 600, 0.5
#: Letters in the cut-outs that the limits are fitted on.
BANDS = (4, 8, 16, 32, 64, 128, 256)
_OTHER = re.compile(r"[\W\d_]+")


def learned_from(id_col: str = "doc_id") -> Column:
    """Documents that may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def letters(text: str | None) -> str:
    """The text's letters in lower case, all else as single blanks; empty without a letter."""
    out = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {out} " if out else ""


def counts(cleaned: str) -> np.ndarray:
    """How often each hashed bigram and trigram occurs."""
    c = np.frombuffer(cleaned.encode("utf-32-le", "surrogatepass"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate([two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(13)) ^ np.uint32(0x165667B1)])
    return np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SIZE.bit_length() + 1), minlength=SIZE)


def unit(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first rows."""
    at = [0]
    near = v @ v[0]
    while len(at) < min(k, len(v)):
        at.append(int(near.argmin()))
        near = np.maximum(near, v @ v[at[-1]])
    c = v[at]
    for _ in range(rounds):
        of = (v @ c.T).argmax(1)
        c = np.stack([v[of == i].sum(0) if (of == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


@dataclass
class Model:
    """Centroids with their languages, the weights, and a limit for each language and band."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    limits: np.ndarray

    def with_open_band(self) -> Model:
        """The model with no limit for texts of the first band."""
        limits = self.limits.copy()
        limits[:, :1] = 0.0
        return Model(self.langs, self.idf, self.centroids, self.of, limits)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, rejected."""
        langs, scores, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cleaned = [letters(t) for t in texts]
        known = [i for i, c in enumerate(cleaned) if c and self.langs]
        for at in range(0, len(known), 256):
            rows = known[at : at + 256]
            cos = unit(np.stack([counts(cleaned[i]) for i in rows]), self.idf) @ self.centroids.T
            best = cos.argmax(1)
            for i, b, s in zip(rows, self.of[best], cos.max(1), strict=True):
                band = int(np.searchsorted(BANDS, len(cleaned[i]), side="right"))
                langs[i], scores[i], out[i] = self.langs[b], min(1.0, max(0.0, float(s))), s < self.limits[b, band]
        return langs, scores, out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS, slack: float = SLACK) -> Model:
    """The model from a sample of the labelled rows of docs; `sample` bounds each language's share in expectation."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull())
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], np.ones(SIZE, np.float32), np.zeros((0, SIZE)), np.zeros(0, int), np.zeros((0, len(BANDS) + 1)))
    chosen = F.lit(False)
    for lang in langs:
        below = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share[lang] * 1_000_000)
        chosen = chosen | ((F.col("lang") == lang) & below)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, key, text in zip(b["lang"], b["id"], b["text"], strict=True):
                if not (cleaned := letters(text)):
                    continue
                cuts = [(len(BANDS), cleaned)]
                start = len(cleaned) // 3
                cuts += [(i, " " + cleaned[start : start + n] + " ") for i, n in enumerate(BANDS) if len(cleaned) > 2 * n]
                yield pd.DataFrame([(lang, key, i, np.minimum(counts(c), 65_535).astype("<u2").tobytes()) for i, c in cuts], columns=["lang", "id", "band", "n"])

    made = staged(rows.where(chosen).mapInPandas(vectors, "lang string, id string, band int, n binary"))

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            for x in b["n"]:
                total += np.frombuffer(x, "<u2") > 0
            n += len(b)
        yield pd.DataFrame({"n": [n], "df": [total.astype("<i8").tobytes()]})

    parts = made.where(F.col("band") == len(BANDS)).coalesce(8).mapInPandas(frequency, "n long, df binary").collect()
    total = sum(r["n"] for r in parts)
    df = sum((np.frombuffer(r["df"], "<i8") for r in parts), np.zeros(SIZE, np.int64))
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)

    def learn(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "band"])
        v = unit(np.stack([np.frombuffer(x, "<u2") for x in b["n"]]), idf)
        whole = (b["band"] == len(BANDS)).to_numpy()
        c = cluster(v[whole], clusters)
        near = (v @ c.T).max(1)
        limits, low = [], 1.0
        for i in range(len(BANDS), -1, -1):  # a shorter text is never held to more than a longer one
            of_band = near[(b["band"] == i).to_numpy()]
            low = min(low, float(np.quantile(of_band, 0.01))) if len(of_band) else low
            limits.append(slack * low)
        return pd.DataFrame({"lang": b["lang"].iloc[:1], "c": [c.astype("<f4").tobytes()], "limits": [np.array(limits[::-1]).tobytes()]})

    learned = {r["lang"]: r for r in made.groupBy("lang").applyInPandas(learn, "lang string, c binary, limits binary").collect()}
    langs = sorted(learned)
    each = [np.frombuffer(learned[x]["c"], "<f4").reshape(-1, SIZE) for x in langs]
    of = np.repeat(np.arange(len(langs)), [len(c) for c in each])
    limits = [np.frombuffer(learned[x]["limits"]) for x in langs]
    return Model(langs, idf, np.concatenate(each) if each else np.zeros((0, SIZE)), of, np.stack(limits) if limits else np.zeros((0, len(BANDS) + 1)))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: one map over the whole texts. The first band's limit is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model.with_open_band())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores, out = shared.value.predict(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": langs, "score": scores, "rejected": out})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def rejects(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function of the text: whether the model rejects it. For a session and not for docs, as no row is keyed."""
    shared = spark.sparkContext.broadcast(model.with_open_band())

    @F.pandas_udf("boolean")
    def rejected(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(list(text))[2])

    return rejected


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected; learned from the rows not held out."""
    model = fit(docs.where(learned_from(id_col)), id_col, text_col, lang_col)
    out = predicted(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(~learned_from(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
