"""Quality classifier by compression.

A zstandard dictionary is built from good and one from bad labelled text. A text, block by block, is
compressed with each; the difference of the two sizes over their mean says to which it is nearer.
A logistic curve, fitted on labelled texts that are in neither dictionary, turns it into a score.

Bound of the sample: SAMPLE_DOCS labelled documents of each class, by least hash of doc_id, less those of more than SAMPLE_CHARS
characters; every other of them makes the dictionaries, the rest the curve.

Defined results: null and empty texts have the difference 0, hence the curve's value there; documents without a
label or doc_id, or with labels of both kinds, aren't learned from; with one class only, the score is its label's;
with none, 0.5; repeated rows are each scored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scryline.llm.common import bounded, crc32_mod, documents
from scryline.llm.language import chosen_ids

SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 200_000
DICTIONARY_BYTES = 1 << 16
BLOCK_BYTES = 2048
LEVEL = 3


def blocks(text: str | None, size: int = BLOCK_BYTES) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary from blocks of the texts; raw content where they are too few to train one."""
    import zstandard

    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[-DICTIONARY_BYTES:] or b"\n"


class Classifier:
    def __init__(self, good: list[str], bad: list[str], fit: list[tuple[str, int]]):
        self.dictionaries = [dictionary(bad), dictionary(good)] if good and bad else []
        self.slope, self.shift = 0.0, (0.0 if not good and not bad else 4.0 if good else -4.0) if not (good and bad) else 0.0
        if self.dictionaries:
            x = np.array([self.difference(t) for t, _ in fit])
            y = np.array([label for _, label in fit], float)
            self.scale = float(x.std()) or 1.0
            self.slope, self.shift = _logistic(x / self.scale, y)
            self.slope /= self.scale

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def difference(self, text: str | None) -> float:
        import zstandard

        if not self.dictionaries or not text:
            return 0.0
        if "_compressors" not in self.__dict__:
            self._compressors = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_dict_id=False) for d in self.dictionaries]
        bad, good = (sum(len(c.compress(b)) for b in blocks(text)) for c in self._compressors)
        return (bad - good) / (bad + good)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.difference(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood (a little penalised), by Newton's method."""
    w, ridge = np.zeros(2), np.array([1e-2, 1e-3])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """docs (doc_id, text), labels (doc_id, quality). The texts of the bounded sample come to the driver."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    # ids first, out of the labels alone; then the texts of those few
    ids = chosen_ids(known.where(learnable).select("doc_id", F.col("quality").alias("label")), sample_docs)
    chosen = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # two classes of sample_docs at most
    rows = sorted((r["label"], r["k"], r["text"]) for r in chosen.select("label", "k", "text").collect())
    prior = {r["quality"]: r["count"] for r in known.where(learnable).groupBy("quality").count().collect()}
    build = {q: [t for label, k, t in rows if label == q and k % 2] for q in (0, 1)}
    fit = [(t, label) for label, k, t in rows if not k % 2] or [(t, label) for label, _, t in rows]
    out = Classifier(build[1], build[0], fit)
    n = [max(1, sum(label == q for _, label in fit)) for q in (0, 1)]
    if out.dictionaries:  # the sample has as many of either class as it can; the score has the labels' own shares
        out.shift += np.log(max(1, prior.get(1, 0)) / max(1, prior.get(0, 0))) - np.log(n[1] / n[0])
    return out


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(text)))

    return docs.select("doc_id", of("text").alias("score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those whose crc32(doc_id) mod 3 is not 1."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    classifier = learn(docs, labels, crc32_mod("doc_id", 3) != 1)
    out = scored(docs, classifier)
    return out.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
