"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 3- and 4-grams of the lower-cased text, in which ASCII
characters other than letters count as spaces; they are hashed to ``BUCKETS``
embeddings. A text's vector is the mean over all its subwords, and a linear
layer with softmax gives the language. Embeddings and layer are trained with
stochastic gradient descent in numpy on a bounded, stratified sample of rows, whose whole texts
the executors turn into bags of buckets; a part of the
sample is held back to calibrate the softmax temperature and the rejection.

Since the layer is linear, embedding and layer are folded into one table of a row
a bucket, so that prediction is one look-up and one mean over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import text_groups

BUCKETS = 1 << 15
DIM = 16
#: The documented bounds of what is fitted: sampled rows a language, and of all languages (but ``LEAST_ROWS`` of each).
SAMPLE_ROWS, SAMPLE_TOTAL, LEAST_ROWS = 800, 40_000, 20
#: Share of calibration texts that each of the two rejection rules may refuse.
REFUSED = 0.001

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[:128] = 32
_LOWER[97:123] = np.arange(97, 123)
_WORDLIKE = re.compile(r"[^\W\d_]")
_PAD = b"    "


def _buckets(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-gram and of the 4-gram at each position of ``buf`` (three fewer than its bytes)."""
    b = _LOWER[buf].astype(np.uint32)
    three = (b[:-3] << np.uint32(16)) | (b[1:-2] << np.uint32(8)) | b[2:-1]
    four = (three << np.uint32(8)) | b[3:]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return (three * np.uint32(2654435761)) >> shift, ((four ^ (four >> np.uint32(15))) * np.uint32(2246822519)) >> shift


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, embedding and layer folded, and whether the bucket is known
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and the share of known subwords of each text."""
        width = self.table.shape[1]
        out = np.zeros((len(texts), width))
        step = 1 << 20
        for lo, hi in text_groups(texts, step):
            buf = np.frombuffer(_PAD.join([b"", *texts[lo:hi], b""]), np.uint8)[:-1]  # the last text has no more grams than others
            size = np.array([len(t) + len(_PAD) for t in texts[lo:hi]])
            starts = np.concatenate(([0], np.cumsum(size)[:-1])) if hi - lo > 1 else np.zeros(1, np.int64)
            total = np.zeros((hi - lo, width))
            for at in range(0, len(buf) - 3, step if hi - lo == 1 else len(buf)):  # a text that stands alone may be very long
                for h in _buckets(buf[at : at + step + 3] if hi - lo == 1 else buf):
                    total += np.add.reduceat(self.table[h], starts, axis=0, dtype=np.float64)
            out[lo:hi] = total / (2 * size)[:, None]
        return out[:, :-1] + self.bias, np.minimum(out[:, -1], 1.0)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        z, known = self.logits(texts)
        z = z / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), known


def has_letter(text: str) -> bool:
    """Whether a text has a letter; circled or superscript numerals and the like are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


#: The buckets of a text and the share of its subwords that each has.
Bag = tuple[np.ndarray, np.ndarray]


def bag(text: bytes, step: int = 1 << 20) -> Bag:
    """The bag of a whole (lower-cased) text of any length."""
    buf = np.frombuffer(_PAD + text + _PAD, np.uint8)[:-1]
    n = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(buf) - 3, step):
        for h in _buckets(buf[at : at + step + 3]):
            n += np.bincount(h, minlength=BUCKETS)
    u = np.flatnonzero(n)
    return u.astype(np.uint16), (n[u] / n.sum()).astype(np.float32)


def train(bags: list[Bag], langs: list[str], epochs: int = 6, rate: float = 0.1, seed: int = 11) -> Model:
    """Fit on the bags given; every fifth is kept for calibration."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    kept, fit = order[::5], np.concatenate([order[i::5] for i in range(1, 5)]) if len(order) >= 10 else order
    place = {k: i for i, k in enumerate(names)}
    y = np.array([place[x] for x in langs])
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    W += rng.normal(0, 0.1, W.shape).astype(np.float32)
    rows = np.bincount(y[fit], minlength=len(names))
    weight = np.clip(len(fit) / np.maximum(1, rows) / len(names), 0.2, 5)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(fit):
            u, share = bags[k]
            x = share @ E[u]
            z = x @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= rate * (1 - done / steps) * weight[y[k]]
            step = W @ p
            W -= np.outer(x, p)
            b -= 0.1 * p
            # the mean spreads the step over many embeddings: each gets its share, scaled to the text's distinct subwords
            E[u] -= (share * min(len(u), 300))[:, None] * step
            done += 1
    seen = np.zeros(BUCKETS, np.float32)
    for k in fit:
        seen[bags[k][0]] = 1
    table = np.concatenate((E @ W, seen[:, None]), axis=1).astype(np.float32)
    model = Model(names, table, b.astype(float))
    check = kept if len(order) >= 10 else order
    if not len(check):
        return model
    z = np.stack([share @ table[u] for u, share in (bags[k] for k in check)]).astype(float)
    z, known = z[:, :-1] + model.bias, z[:, -1]
    loss = []
    grid = np.geomspace(0.05, 50, 60)
    for t in grid:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        loss.append(float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(check)), y[check]])))
    model.temperature = float(grid[int(np.argmin(loss))])
    p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    p /= p.sum(axis=1, keepdims=True)
    model.least_score = float(min(0.4, np.quantile(p.max(axis=1), REFUSED)))
    model.least_known = float(0.8 * np.quantile(known, REFUSED))
    return model


def held_out(id_column: str = "doc_id"):
    """True for rows that are never learned from; false without an id (which isn't learned from either)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [bag(t) for t in pc.utf8_lower(batch.column(2)).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([u.tobytes() for u, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=["doc_id", "lang", "u", "share"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> Model | None:
    """Train on about ``rows`` documents a language, chosen by a hash of the id, and about ``total`` of all.

    Whole texts are read; what comes to the driver is a bag a row, of 6 bytes a distinct
    bucket. None if there is no labelled row.
    """
    usable = docs.where("doc_id is not null and text is not null and lang is not null and trim(lang) <> ''").where(~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rows = max(LEAST_ROWS, min(rows, total // len(counts)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30))
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, rows / n) * (1 << 30))) for k, n in counts.items()], "lang string, below long")
    sample = usable.select("doc_id", "lang", "text", draw.alias("draw")).join(F.broadcast(share), "lang").where("draw < below").select("doc_id", "lang", "text")
    got = sorted(sample.mapInArrow(_bags, "doc_id long, lang string, u binary, share binary").limit(2 * rows * len(counts)).collect())
    if not got:
        return None
    return train([(np.frombuffer(r["u"], np.uint16), np.frombuffer(r["share"], np.float32)) for r in got], [r["lang"] for r in got])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(1)
            plain = texts.to_pylist()
            has = np.array([t is not None and has_letter(t) for t in plain], bool)
            del plain
            pred = np.full(len(has), "und", dtype=object)
            score, refused = np.zeros(len(has)), np.ones(len(has), bool)
            at = np.flatnonzero(has)
            if model and len(at):
                p, known = model.scores(pc.utf8_lower(texts.take(pa.array(at))).cast(pa.binary()).to_pylist())
                best = p.argmax(axis=1)
                pred[at], score[at] = np.array(model.languages, dtype=object)[best], p[np.arange(len(at)), best]
                refused[at] = (score[at] < model.least_score) | (known < model.least_known)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != 1], pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(refused)], names=[n for i, n in enumerate(batch.schema.names) if i != 1] + ["lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, a row for each of ``docs``.

    Null text or text without letters: ``und``, score 0, rejected. Without a model
    (nothing to learn from) every row is ``und``. Repeated rows get equal results; ties
    go to the language first in alphabetical order. A table without rows gives none, and texts of any length are
    read whole; other columns aren't read.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = given.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _keep(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at = batch.schema.get_field_index("text")
            given = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["row", "text"])
            (found,) = _predict(model)(iter([given]))
            yield batch.filter(pc.invert(found.column("rejected")))

    return run


def drop_unidentified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without those that :func:`identify` rejects, null and letterless texts among them.

    Columns and other rows stay as they are, rows without an id and repeated rows too.
    """
    return docs.mapInArrow(_keep(model), docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
