"""Language identification with interpolated Kneser-Ney models of characters.

One model for each language, all in one set of tables: for each order a sorted array of n-gram hashes, with a
row of log probabilities (one for each language) beside each. A text gets the language whose length-normalised cross-entropy is
least. The score is the calibrated share of that language times how near its cross-entropy is to that of texts of the
language, rather than to that of the same texts with their characters shuffled; both are measured on texts kept from the
counts. So texts unlike any language get a low score and can be rejected.

Bound of the sample: SAMPLE_DOCS documents of each language, those with the least hash of doc_id, none of more than SAMPLE_CHARS
characters; CALIBRATE of them are kept from the counts and used for calibration alone.

Defined results: a null text or one without a letter is `und` with score 0; documents without a language
or doc_id aren't learned from; ties go to the first language in alphabetical order; rows that repeat are each
predicted; without any language to learn from, every row is `und`; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scryline.llm.common import bounded, crc32_mod, documents, fresh, release

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_CHARS = 200_000
CALIBRATE = 0.25
#: Texts that a task normalises and scores at a time.
PREDICT_ROWS = 1_000
#: A text whose score is below this is rejected: its cross-entropy is over three quarters of the way to that of shuffled texts.
REJECT_BELOW = 0.02
TURN, STEEP = 2 / 3, 40
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower-case letters, each run of other characters one space; empty if there is no letter."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words.isascii() and not words.replace(" ", "").isalpha():  # numbers that aren't digits
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return f" {words} " if words else ""


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position from n - 1 on."""
    h = codes[: len(codes) - n + 1].astype(np.uint64)
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER + codes[k : len(codes) - n + 1 + k]
    return h * _MULTIPLIER


def _counts(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each different n-gram, of its first n - 1 and of its last n - 1 characters, with counts."""
    whole, head, tail = [], [], []
    for t in texts:
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        if len(codes) >= n:
            whole.append(hashes(codes, n))
            if n > 1:
                shorter = hashes(codes, n - 1)
                head.append(shorter[:-1])
                tail.append(shorter[1:])
    if not whole:
        return tuple(np.empty(0, np.uint64) for _ in range(4))  # type: ignore[return-value]
    keys, first, count = np.unique(np.concatenate(whole), return_index=True, return_counts=True)
    none = np.zeros(len(keys), np.uint64)
    return keys, np.concatenate(head)[first] if head else none, np.concatenate(tail)[first] if tail else none, count  # type: ignore[return-value]


def kneser_ney(texts: list[str], order: int) -> list[dict]:
    """For each order: keys (sorted), logp of each, ctx (sorted hashes of contexts), backoff of each."""
    grams = [_counts(texts, n) for n in range(1, order + 1)]
    lower: dict | None = None
    out = []
    for n in range(1, order + 1):
        keys, head, tail, count = grams[n - 1]
        if n < order:  # how many characters stand before it
            longer = grams[n]
            at, c = np.unique(longer[2], return_counts=True)
            pos = np.searchsorted(at, keys)
            found = (pos < len(at)) & (at[np.minimum(pos, max(len(at) - 1, 0))] == keys) if len(at) else np.zeros(len(keys), bool)
            count = np.where(found, c[np.minimum(pos, max(len(c) - 1, 0))] if len(c) else 0, 0) + (0 if n > 1 else 1)
            count = np.maximum(count, 1)
        n1, n2 = int((count == 1).sum()), int((count == 2).sum())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.75
        if lower is None:
            total = float(count.sum())
            unseen = d * len(count) / total / (len(count) + 1)  # the mass taken off goes to all characters and an unknown one alike
            level = {"keys": keys, "logp": np.log((count - d) / total + unseen), "ctx": np.empty(0, np.uint64), "backoff": np.empty(0), "unseen": np.log(unseen)}
        else:
            ctx, inverse = np.unique(head, return_inverse=True)
            total = np.bincount(inverse, count)
            kinds = np.bincount(inverse)
            gamma = d * kinds / total
            pos = np.searchsorted(lower["keys"], tail)
            p = np.maximum(count - d, 0) / total[inverse] + gamma[inverse] * np.exp(lower["logp"][np.minimum(pos, len(lower["keys"]) - 1)])
            level = {"keys": keys, "logp": np.log(p), "ctx": ctx, "backoff": np.log(gamma)}
        out.append(level)
        lower = level
    return out


class Model:
    """Tables of all languages, merged: one look-up gives the log probability in every language."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.languages = sorted(texts)
        self.order = order
        models = [kneser_ney(texts[x], order) for x in self.languages]
        self.unseen = np.array([m[0]["unseen"] for m in models], np.float32)
        self.keys, self.logp, self.ctx, self.backoff = [], [], [], []
        for n in range(order):
            ctx = np.unique(np.concatenate([m[n]["ctx"] for m in models]))
            back = np.zeros((len(ctx), len(models)), np.float32)
            for i, m in enumerate(models):
                back[np.searchsorted(ctx, m[n]["ctx"]), i] = m[n]["backoff"]
            keys = np.unique(np.concatenate([m[n]["keys"] for m in models]))
            logp = np.full((len(keys), len(models)), np.nan, np.float32)
            for i, m in enumerate(models):
                logp[np.searchsorted(keys, m[n]["keys"]), i] = m[n]["logp"]
            self.keys.append(keys)
            self.logp.append(logp)
            self.ctx.append(ctx)
            self.backoff.append(back)
        self._fill(texts)

    def _fill(self, texts: dict[str, list[str]]) -> None:
        """Complete the rows: an n-gram that one language has gets its backed-off probability in the others."""
        for n in range(self.order):
            if n == 0:
                self.logp[0] = np.where(np.isnan(self.logp[0]), self.unseen, self.logp[0])
                continue
            head, tail = np.zeros(len(self.keys[n]), np.uint64), np.zeros(len(self.keys[n]), np.uint64)
            for x in self.languages:
                keys, h, t, _ = _counts(texts[x], n + 1)
                at = np.searchsorted(self.keys[n], keys)
                head[at], tail[at] = h, t
            lower = self.logp[n - 1][np.searchsorted(self.keys[n - 1], tail)]
            back = self.backoff[n][np.searchsorted(self.ctx[n], head)]
            self.logp[n] = np.where(np.isnan(self.logp[n]), back + lower, self.logp[n])

    def _lookup(self, codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the characters at `at`, given the n - 1 before each."""
        if n == 0:
            return np.broadcast_to(self.unseen, (len(at), len(self.languages)))
        h = codes[at - n + 1].astype(np.uint64)
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER + codes[at - n + 1 + k]
        keys = self.keys[n - 1]
        h *= _MULTIPLIER
        pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = self.logp[n - 1][pos]
        miss = np.flatnonzero(keys[pos] != h)
        if len(miss):
            rest = self._lookup(codes, at[miss], n - 1)
            if n > 1:
                c = codes[at[miss] - n + 1].astype(np.uint64)
                for k in range(1, n - 1):
                    c = (c ^ (c >> np.uint64(29))) * _MULTIPLIER + codes[at[miss] - n + 1 + k]
                c *= _MULTIPLIER
                ctx = self.ctx[n - 1]
                cpos = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                rest = rest + np.where((ctx[cpos] == c)[:, None], self.backoff[n - 1][cpos], np.float32(0))
            out[miss] = rest
        return out

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats a character of each normalised text in each language; texts shorter than the order use shorter contexts."""
        out = np.zeros((len(texts), len(self.languages)))
        if not self.languages:
            return out
        for lo, hi in _runs(texts):
            part = texts[lo:hi]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = np.array([len(t) for t in part])
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(codes)) - np.repeat(begin, sizes)  # in its text
            total = np.zeros((len(part), len(self.languages)))
            owner = np.repeat(np.arange(len(part)), sizes)
            for n in range(2, self.order + 1):  # the first character is always a space
                at = np.flatnonzero(place >= n - 1) if n == self.order else np.flatnonzero(place == n - 1)
                if not len(at):
                    continue
                for a in range(0, len(at), 1 << 18):
                    sub = at[a : a + (1 << 18)]
                    p = self._lookup(codes, sub, n)
                    own = owner[sub]
                    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    total[own[edge]] += np.add.reduceat(p, edge, axis=0, dtype=np.float64)
            out[lo:hi] = -total / np.maximum(sizes - 1, 1)[:, None]
        return out


def _runs(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters in all."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class Identifier:
    def __init__(self, learn: dict[str, list[str]], calibrate: dict[str, list[str]]):
        learn = {k: v for k, v in learn.items() if v}
        self.model = Model(learn) if learn else None
        self.languages = self.model.languages if self.model else []
        self.own, self.noise, self.heat = np.zeros(len(self.languages)), np.ones(len(self.languages)), 1.0
        if not self.model:
            return
        gaps, rng = [], np.random.default_rng(0)
        for i, x in enumerate(self.languages):
            texts = calibrate.get(x) or learn[x]
            ce = self.model.cross_entropy(texts)
            if len(self.languages) > 1:
                gaps.append(np.delete(ce, i, axis=1).min(axis=1) - ce[:, i])
            self.own[i] = ce[:, i].mean()
            shuffled = [f" {' '.join(''.join(rng.permutation(list(t.strip())).tolist()).split())} " for t in texts]
            self.noise[i] = max(self.model.cross_entropy(shuffled).min(axis=1).mean(), self.own[i] + 0.5)
        if gaps:
            # A logistic scale under which the calibration texts' languages are as sure as they are often right.
            gap = np.concatenate(gaps)
            heats = np.geomspace(0.5, 200, 40)
            loss = [np.logaddexp(0, -h * gap).mean() for h in heats]
            self.heat = float(heats[int(np.argmin(loss))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        forms = [normal(t) for t in texts]
        score = np.zeros(len(texts))
        names = ["und"] * len(texts)
        if not self.model:
            return names, score
        has = np.array([bool(f) for f in forms])
        ce = self.model.cross_entropy(forms)
        best = ce.argmin(axis=1)
        share = 1 / np.exp(-self.heat * (ce - ce.min(axis=1, keepdims=True))).sum(axis=1)
        way = (ce.min(axis=1) - self.own[best]) / (self.noise[best] - self.own[best])
        usual = 1 / (1 + np.exp(np.clip(STEEP * (way - TURN), -50, 50)))
        score = np.where(has, np.clip(share * usual, 0, 1), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], score


def chosen_ids(labelled: DataFrame, per_label: int) -> DataFrame:
    """labelled (doc_id, label) -> doc_id, label, k: at most per_label different ids of each label, by least hash."""
    first = Window.partitionBy("label").orderBy("h", "doc_id")
    part = Window.partitionBy("label", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")  # a label may hold most rows
    rows = labelled.where("doc_id is not null and label is not null").select("doc_id", "label", F.xxhash64(F.lit("sample"), "doc_id").alias("h")).distinct()
    rows = rows.withColumn("k", F.row_number().over(part)).where(F.col("k") <= per_label)
    return rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_label).select("doc_id", "label", "k")


def sample(docs: DataFrame, learnable: Column, per_label: int) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, label, k, text of at most per_label documents of each language."""
    labelled = docs.select("doc_id", "text", F.col("lang").alias("label"))
    chosen = chosen_ids(labelled.where(learnable & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "label"), per_label)
    return labelled.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), ["doc_id", "label"])  # at most per_label rows for each label


def learn(docs: DataFrame, learnable: Column) -> Identifier:
    """docs (doc_id, text, lang). The texts of the bounded sample come to the driver."""
    rows = sorted((r["label"], r["k"], r["text"]) for r in sample(docs, learnable, SAMPLE_DOCS).select("label", "k", "text").collect())
    fit: dict[str, list[str]] = {}
    hold: dict[str, list[str]] = {}
    for label, k, text in rows:
        if form := normal(text):
            (hold if k % round(1 / CALIBRATE) == 0 else fit).setdefault(label, []).append(form)
    for label in [x for x in hold if x not in fit]:
        fit[label] = hold.pop(label)
    return Identifier(fit, hold)


def _predictor(identifier: Identifier, spark: SparkSession):
    """text -> lang_pred, score; the model is broadcast (bounded by the sample)."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(identifier)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        names, score = [], [np.empty(0)]
        for lo in range(0, len(text), PREDICT_ROWS):
            some, values = shared.value.predict(text.iloc[lo : lo + PREDICT_ROWS].tolist())
            names += some
            score.append(values)
        release()
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(score)})

    return predict


def identify(docs: DataFrame, identifier: Identifier, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs (other than lang_pred and score) with lang_pred and score."""
    (judged,) = fresh(docs, "_judged")
    out = docs.select(*keep, _predictor(identifier, docs.sparkSession)("text").alias(judged))
    return out.select(*keep, F.col(judged)["lang_pred"].alias("lang_pred"), F.col(judged)["score"].alias("score"))


def accepted(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """docs (text, ...) without the rows that are `und` or whose score is below REJECT_BELOW; same columns, whatever their names."""
    (judged,) = fresh(docs, "_judged")
    out = docs.withColumn(judged, _predictor(identifier, docs.sparkSession)("text"))
    return out.where((F.col(judged)["lang_pred"] != "und") & (F.col(judged)["score"] >= REJECT_BELOW)).select(*docs.columns)


def learnable() -> Column:
    return crc32_mod("doc_id", 4) != 2


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    identifier = learn(docs, learnable())
    out = identify(docs, identifier, ["doc_id"])
    return out.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
