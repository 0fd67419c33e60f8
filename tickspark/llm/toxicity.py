"""Toxicity by non-negative positive-unlabelled learning.

A linear model over indicators of character n-grams is trained with numpy from texts confirmed as toxic and from unlabelled
texts. The risk of the unlabelled part, less the positives' share of it (class prior times the risk of calling positives
negative), estimates the risk on negatives; where that estimate turns negative for a batch, its gradient is reversed, as the
non-negative estimator asks for.

Only the confirmed texts are a sample (at most ``positives`` of them, lowest hashes of the identifier). All rows outside the
held-out fold are the unlabelled part, whatever the size of the table: one pass counts their features, those that mark the
positives best are chosen, a second pass keeps each row's chosen features, and rounds of mini-batches over them follow. In
a round each partition goes through its rows from the same weights, and the results are averaged by numbers of rows. Last,
the intercept is set so that the scores of all these rows average to the class prior. Every text is scored whole.

Edge cases: null and empty texts have no features and score as the intercept says; null labels are left out; an
identifier with both labels counts as not confirmed; without confirmed texts every score is the class prior, 0 when
there is none; repeated rows count each and are scored alike; a very long text is one row like any other; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.features import indicators, logistic, remainder, sampled, scored
from tickspark.llm.spill import cut
from tickspark.llm.text import bounded_batches, raw

BITS = 20
ORDERS = (4, 5, 6)
THRESHOLD = 0.3
#: Rows, and bytes of their chosen features, that a partition of the fit holds at once.
PART_ROWS, PART_BYTES = 50_000, 32 << 20
#: Rows of a partition of the fit at the least.
LEAST_ROWS = 512
#: Parts in which counts are added up before they come to the driver, and how many tasks' results meet in one group.
SUMS, FAN = 64, 64


class Model:
    """weights over all feature numbers (0 where a feature isn't chosen) and the calibrated slope and intercept."""

    def __init__(self, weights: np.ndarray, slope: float, intercept: float):
        self.weights, self.slope, self.intercept = weights, slope, intercept

    def margins(self, rows) -> np.ndarray:
        return np.array([self.weights[c].sum() for c in rows], np.float64)


def features():
    return indicators(ORDERS, BITS, shapes=False, lower=True)


def added(sent: DataFrame, kind: type, tasks: int) -> pa.Table:
    """Sums of binary vectors that tasks send (part, task, n, vector), by part: turn by turn, at most FAN of them in a group."""
    schema = "part int, task long, n long, vector binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), kind) for c in table.column("vector"))
        return pa.table({"part": table.column("part")[:1], "task": table.column("task")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "vector": pa.array([total.tobytes()], pa.binary())})

    while tasks > 1:
        tasks = -(-tasks // FAN)
        sent = sent.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("part", "task").applyInArrow(add, schema)
    return sent.toArrow().sort_by("part")


def counted(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the rows each feature occurs, and the rows. A task sends its counts in SUMS parts, added up by part."""
    bounded_batches(rows.sparkSession)
    width = (1 << BITS) // SUMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, n, task = features(), np.zeros(1 << BITS, np.int64), 0, 0
        for b in batches:
            task = b.column("task")[0].as_py() if b.num_rows else task
            for codes in of(*raw(b.column("text"))):
                counts[codes] += 1
                n += 1
        if n:
            yield pa.record_batch({"part": pa.array(range(SUMS), pa.int32()), "task": pa.array([task] * SUMS, pa.int64()), "n": pa.array([n] * SUMS, pa.int64()), "vector": pa.array([c.tobytes() for c in counts.reshape(SUMS, width)], pa.binary())})

    given = rows.select("text", F.spark_partition_id().alias("task"))
    got = added(given.mapInArrow(count, "part int, task long, n long, vector binary"), np.int64, max(2, given.rdd.getNumPartitions()))
    if not got.num_rows:
        return np.zeros(1 << BITS, np.int64), 0
    return np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for c in got.column("vector")]), got.column("n")[0].as_py()


def chosen_features(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int, most: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features that mark positives best, and the log ratio of their shares in the two parts."""
    p, u = positive / n_positive, unlabelled / n_unlabelled
    gain = np.where(positive >= 3, (p - u) / np.sqrt((p + u) / 2 * (1 / n_positive + 1 / n_unlabelled) + 1e-9), 0)
    best = np.argpartition(-gain, min(most, len(gain) - 1))[:most]
    best = best[gain[best] > 3]
    return best, np.log((p[best] + 1 / n_positive) / (u[best] + 1 / n_unlabelled))


def shortened(rows: DataFrame, best: np.ndarray) -> DataFrame:
    """(codes): of each row the places in ``best`` of the features that it has, as 16-bit numbers."""
    place = np.full(1 << BITS, -1, np.int16)
    place[best] = np.arange(len(best))
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place = features(), shared.value
        for b in batches:
            found = (place[codes] for codes in of(*raw(b.column("text"))))
            yield pa.record_batch({"codes": pa.array([c[c >= 0].tobytes() for c in found], pa.binary())})

    return rows.select("text").mapInArrow(shorten, "codes binary")


def unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(c, np.int16) for c in column.to_pylist()]


def nnpu_steps(theta: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: int = 100, rate: float = 0.03, batch: int = 2048, decay: float = 2e-4, seed: int = 3) -> np.ndarray:
    """Weights and intercept after passes over the unlabelled rows in mini-batches, ``least`` of them at the least, each with
    its share of positives: the non-negative risk with the logistic loss, by Adam."""
    rng, width = np.random.default_rng(seed), len(theta) - 1
    theta, first, second, t = theta.copy(), np.zeros(width + 1), np.zeros(width + 1), 0
    n_batches = max(1, len(unlabelled) // batch)

    def look(rows: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = [rows[i] for i in at]
        owner = np.repeat(np.arange(len(at)), [len(c) for c in codes])
        flat = np.concatenate(codes).astype(np.int64)
        return flat, owner, np.bincount(owner, theta[flat], len(at)) + theta[-1]

    def gradient(flat: np.ndarray, owner: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(flat, slope[owner], width), [slope.sum()]])

    while t < least:
        for at_u in np.array_split(rng.permutation(len(unlabelled)), n_batches):
            at_p = rng.permutation(len(positive))[: max(1, min(len(positive), batch))]
            flat_p, own_p, z_p = look(positive, at_p)
            flat_u, own_u, z_u = look(unlabelled, at_u)
            # the loss of calling a row negative is log(1 + e^z), of slope s; of calling it positive log(1 + e^-z), of slope s - 1
            negative_risk = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
            s_p, s_u = logistic(z_p) / len(z_p), logistic(z_u) / len(z_u)
            if negative_risk >= 0:
                grad = gradient(flat_p, own_p, np.full(len(z_p), -prior / len(z_p))) + gradient(flat_u, own_u, s_u)
            else:
                grad = gradient(flat_p, own_p, prior * s_p) - gradient(flat_u, own_u, s_u)
            grad[:-1] += decay * theta[:-1]
            t += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta


def fitted(held: DataFrame, positive: list[np.ndarray], prior: float, ratio: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Weights of the chosen features after ``rounds`` in which partitions learn from the same start and are averaged."""
    theta = np.concatenate([ratio * 0.1, [np.log(prior / (1 - prior))]])
    schema = "part int, task long, n long, vector binary"
    tasks = held.rdd.getNumPartitions()

    for turn in range(rounds):
        shared = held.sparkSession.sparkContext.broadcast((theta, positive))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            start, positive = shared.value
            rows: list[np.ndarray] = []
            task = 0
            for b in batches:
                rows += unpacked(b.column("codes"))
                task = b.column("task")[0].as_py() if b.num_rows else task
            if rows:
                found = nnpu_steps(start, positive, rows, prior, seed=turn) * len(rows)
                yield pa.record_batch({"part": pa.array([0], pa.int32()), "task": pa.array([task], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "vector": pa.array([found.tobytes()], pa.binary())})

        got = added(held.select("codes", F.spark_partition_id().alias("task")).mapInArrow(learn, schema), np.float64, max(2, tasks))
        if got.num_rows:
            theta = np.frombuffer(got.column("vector")[0].as_buffer(), np.float64) / got.column("n")[0].as_py()
        shared.unpersist()
    return theta[:-1]


def dealt(short: DataFrame) -> DataFrame:
    """Rows of chosen features dealt evenly for the fit: to each core if it gets LEAST_ROWS, so that a task has something to learn
    from, and to more tasks where one would hold too much."""
    rows, size = short.agg(F.count(F.lit(1)), F.sum(F.octet_length("codes"))).first()
    cores = min(short.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS)
    return short.repartition(max(1, cores, -(-rows // PART_ROWS), -(-(size or 0) // PART_BYTES)))


def intercept_for(held: DataFrame, weights: np.ndarray, prior: float) -> float:
    """The intercept at which the scores of all held rows average to the class prior, from their margins' histogram in
    hundredths: at most 12,001 rows."""
    shared = held.sparkSession.sparkContext.broadcast(weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([shared.value[c].sum() for c in unpacked(b.column("codes"))], np.float64)
            yield pa.record_batch({"m": pa.array(np.rint(np.clip(found, -60, 60) * 100).astype(np.int32))})

    got = held.mapInArrow(margins, "m int").groupBy("m").agg(F.count(F.lit(1)).alias("n")).toArrow()
    at, many = np.asarray(got.column("m")) / 100, np.asarray(got.column("n"))
    low, high = -120.0, 120.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (logistic(at + middle) * many).sum() < prior * many.sum() else (low, middle)
    return (low + high) / 2


def constant(prior: float) -> Model:
    p = min(max(prior, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BITS, np.float32), 0.0, float(np.log(p / (1 - p))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = (4, 2), positives: int = 2000, prior: float | None = None) -> Model:
    """Learns from at most ``positives`` confirmed toxic texts and from all others, both outside the held-out fold.

    prior: the share of toxic texts; by default their share of the labelled rows outside the held-out fold.
    """
    open_ = lambda df: df.where(remainder(F.col("doc_id"), fold[0]) != fold[1])
    known = open_(labels).where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias(label))
    share, n = known.agg(F.avg(label), F.count(F.lit(1))).first()
    share = prior if prior is not None else (share if n else 0.0)
    confirmed = sampled(known.where(F.col(label) == 1).select("doc_id", F.lit(1).alias("confirmed")), docs, "confirmed", positives)
    in_positive, n_positive = counted(confirmed)
    pool = open_(docs)
    in_pool, n_pool = counted(pool)
    if not n_positive or not n_pool:
        return constant(share)
    best, ratio = chosen_features(in_positive, n_positive, in_pool, n_pool)
    share = min(max(share, 1e-3), 0.9)
    positive = unpacked(shortened(confirmed, best).toArrow().column("codes"))
    held = cut(dealt(cut(shortened(pool, best))))
    weights = np.zeros(1 << BITS, np.float32)
    weights[best] = found = fitted(held, positive, share, ratio)
    return Model(weights, 1.0, intercept_for(held, found, share))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score (0 to 1) of every row."""
    return scored(docs, features, partial(_weigh, docs.sparkSession.sparkContext.broadcast(model)), "score double", keep)


def _weigh(shared, of, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    model = shared.value
    return {"score": logistic(model.slope * model.margins(of(data, offsets)) + model.intercept)}


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
