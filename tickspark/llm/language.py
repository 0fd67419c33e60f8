"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary n-gram classifier (logistic, over log counts of hashed
character n-grams, scaled to unit length) is fitted on a bounded sample of texts of known language. A text's bits are
decoded by loss-weighted decoding: the codeword with the least total logistic loss, each bit weighted by its accuracy on
the sample, is nearest; a text whose two nearest codewords lie close is flagged as ambiguous. Every
language is learnt. At most ``per_language`` texts of each enter the fit, by hash of the identifier; beyond ``total`` texts
they are dealt equally to the languages, ``least`` to each at the least. Every text is decoded whole.

Edge cases: a text that is null or has no letter is `und` with score 0; with a single known language that is the answer
for all others, score 1; without any known language all texts are `und`; rows with a null language are not learnt from
but decoded, and neither are identifiers that several languages share; ties go to the language that sorts first; repeated
rows get the same answer; a very long text is decoded whole, over a MiB alone in its slice; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.features import char_grams, collected, has_letter, logistic, remainder, sampled, scored
from tickspark.llm.text import LOWER, slices

BITS = 16
ORDERS = (1, 2, 3)


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A row of -1 and 1 for each language: all splits of up to 6 languages, else random columns with wide row distances."""
    if languages <= 6:
        columns = [[1 if (i == 0 or not (c >> (i - 1)) & 1) else -1 for i in range(languages)] for c in range(1, 1 << (languages - 1))]
        return np.array(columns, np.float32).reshape(-1, languages).T
    rng, width, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages))), None, -1
    for _ in range(200):
        tried = rng.choice([-1, 1], (languages, width)).astype(np.float32)
        apart = ((width - tried @ tried.T) / 2)[~np.eye(languages, dtype=bool)].min()
        if apart > most and (abs(tried.sum(axis=0)) < languages).all():
            best, most = tried, apart
    return best


class Model:
    """languages, their codewords, and weights, intercept and decoding weight of each bit's classifier."""

    def __init__(self, languages: list[str], words: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.words, self.weights, self.bias, self.trust = languages, words, weights, bias, trust

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its score, and its relative lead over the next (0: as near, 1: the next is far off), for rows of
        bit margins."""
        loss = np.logaddexp(0, -bits[:, None, :] * self.words[None]) @ self.trust
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        ordered = np.sort(loss, axis=1)
        lead = (ordered[:, 1] - ordered[:, 0]) / (ordered[:, 1] + ordered[:, 0] + 1e-9)
        return best, share[np.arange(len(share)), best], lead


class Counted:
    """Feature numbers (distinct) and log counts of each row, for the fit."""

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        for codes in each_text(data, offsets):
            found, n = np.unique(codes, return_counts=True)
            yield np.concatenate([found.astype(np.uint32), n.astype(np.uint32)])


def each_text(data: np.ndarray, offsets: np.ndarray):
    for lo, hi in slices(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        kinds = [(char_grams(part, n, BITS), n) for n in ORDERS]
        cuts = offsets[lo : hi + 1] - offsets[lo]
        for i in range(hi - lo):
            yield np.concatenate([codes[cuts[i] : max(cuts[i], cuts[i + 1] - n + 1)] for codes, n in kinds])


def unit(counts: np.ndarray) -> np.ndarray:
    values = np.log1p(counts).astype(np.float32)
    return values / max(float(np.sqrt((values * values).sum())), 1e-6)


def fit(y: np.ndarray, rows: list[np.ndarray], steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> Model:
    languages = sorted(set(y.tolist()))
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 0), np.float32), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(0))
    words = codewords(len(languages))
    target = words[[languages.index(v) for v in y]] > 0
    codes = [r[: len(r) // 2].astype(np.int64) for r in rows]
    values = np.concatenate([unit(r[len(r) // 2 :]) for r in rows])
    flat, owner = np.concatenate(codes), np.repeat(np.arange(len(rows)), [len(c) for c in codes])
    balance = np.array([1 / (len(languages) * (y == v).sum()) for v in y])
    used, place = np.unique(flat, return_inverse=True)
    weights, bias = np.zeros((1 << BITS, words.shape[1]), np.float32), np.zeros(words.shape[1])
    for b in range(words.shape[1]):
        w, square = np.zeros(len(used)), np.full(len(used), 1e-6)
        c, c_square = 0.0, 1e-6
        for _ in range(steps):
            margin = np.bincount(owner, w[place] * values, len(rows)) + c
            slope = (logistic(margin) - target[:, b]) * balance
            grad = np.bincount(place, slope[owner] * values, len(used)) + decay * w
            square += grad * grad
            w -= rate * grad / np.sqrt(square)
            c_square += slope.sum() ** 2
            c -= rate * slope.sum() / np.sqrt(c_square)
        weights[used, b], bias[b] = w, c
    model = Model(languages, words, weights, bias, np.ones(words.shape[1]))
    margins = np.array([model.weights[k].T @ v for k, v in zip(codes, np.split(values, np.cumsum([len(c) for c in codes])[:-1]), strict=True)]) + bias
    model.trust = np.maximum(2 * ((margins > 0) == target).mean(axis=0) - 1, 0.05)
    model.trust /= model.trust.mean()
    return model


def train(docs: DataFrame, fold: tuple[int, int] = (4, 2), per_language: int = 400, total: int = 25_600, least: int = 50) -> Model:
    """Learns from texts with a known language outside the held-out fold, at most ``per_language`` of each and, where each
    then has ``least``, at most ``total``."""
    known = docs.where((remainder(F.col("doc_id"), fold[0]) != fold[1]) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    named = known.groupBy("doc_id").agg(F.min("lang").alias("known"), F.max("lang").alias("other")).where("known = other")
    # texts come from the rows that name a language, not from others of their identifier
    return fit(*collected(sampled(named, known, "known", per_language, total, least), "known", Counted))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), close: float = 0.8) -> DataFrame:
    """``keep`` columns, lang_pred, score and ambiguous (the relative lead over the next language is below ``close``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"_c{i}" for i in range(len(keep))]
    given = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept, strict=True)), "text", has_letter(F.col("text")).alias("lettered"))
    out = scored(given, lambda: None, partial(_weigh, shared), "lang_pred string, score double, lead double", (*kept, "lettered"))
    clear = F.col("lettered") & F.col("lang_pred").isNotNull()
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, kept, strict=True)), F.when(clear, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(clear, F.col("score")).otherwise(0.0).alias("score"), (~clear | (F.col("lead") < close)).alias("ambiguous"))


def _weigh(shared, of, data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
    model, n = shared.value, len(offsets) - 1
    if len(model.languages) < 2:
        return {"lang_pred": [model.languages[0] if model.languages else None] * n, "score": [1.0] * n, "lead": [1.0] * n}
    bits = np.zeros((n, model.words.shape[1]))
    space = model.weights.shape[0]
    for i, codes in enumerate(each_text(data, offsets)):
        if len(codes) > space // 16:
            counts = np.bincount(codes, minlength=space)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(codes, return_counts=True)
        bits[i] = unit(counts) @ model.weights[found] + model.bias
    best, score, lead = model.decode(bits)
    return {"lang_pred": [model.languages[b] for b in best], "score": score, "lead": lead}


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
