"""Language identification with error-correcting output codes.

Every language has a codeword of signs.  For each bit a binary classifier over
byte trigrams tells the languages with +1 from those with -1; a text's language
is the codeword at the least weighted loss from the classifiers' outputs.
Several classifiers may err before the nearest codeword changes, and a small
distance to the second codeword shows an ambiguous text.

Training is on a bounded sample of labelled rows (``rows_per_lang``, the rows of
least hash of ``doc_id`` in each language): half gives the trigram counts, half
the classifiers' scale and their weights.  Prediction reads whole texts.

Defined results:

* A null or empty text, or one without letters, has no trigrams: ``lang_pred``
  null, ``rejected`` true, ``ambiguous`` true.
* A text is rejected too when less than ``min_known`` of its trigrams occur in
  the sample, or when even its nearest codeword is at a loss over ln 2 (worse
  than guessing every bit).
* Codewords at equal distance: the first language in order, ``ambiguous`` true.
* Very long texts are read whole, in blocks of 2^18 bytes.
* Rows with equal ``doc_id`` are classified one by one; a null id stays null.
  Repeated rows are one row of the sample.
* Rows without a label take no part in training.  If no row is labelled there is
  no model: ``lang_pred`` is null, nothing is rejected, all is ambiguous.
* An empty table gives an empty result.
* Columns other than ``doc_id``, ``text`` and ``lang`` are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, materialize, ship
from .textbytes import buffers, lowered, pieces

BUCKETS = 1 << 16
_BLOCK = 1 << 18
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)

RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("codeword", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("known", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)
_ARROW = pa.struct(
    [("lang_pred", pa.string()), ("codeword", pa.string()), ("distance", pa.float64()), ("margin", pa.float64()),
     ("known", pa.float64()), ("ambiguous", pa.bool_()), ("rejected", pa.bool_())]
)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, usable) for each byte position: the trigram that begins there."""
    n = len(raw)
    low = _LETTER[lowered(raw)].astype(np.uint32)
    code = np.zeros(n, np.uint32)
    usable = np.zeros(n, bool)
    if n > 2:
        code[:-2] = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        usable[:-2] = low[1:-1] != 32
        for back in (1, 2):
            at = offsets[1:] - back
            usable[at[(at >= 0) & (at < n)]] = False
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int32), usable


def sums(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per row the sum of the table's rows over the trigrams; the last column counts them."""
    rows = len(offsets) - 1
    out = np.zeros((rows, table.shape[1] + 1))
    for at in range(0, len(raw), _BLOCK):
        end = min(len(raw), at + _BLOCK)
        over = min(len(raw), end + 2)
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        local = np.clip(offsets[first : last + 1], at, over) - at
        code, usable = trigrams(raw[at:over], offsets[first : last + 1] - at)
        pick = np.flatnonzero(usable[: end - at])
        if len(pick) == 0:
            continue
        got = np.take(table, code[pick], axis=0)
        row = np.searchsorted(local[1:], pick, "right")
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[first + row[begin], :-1] += np.add.reduceat(got, begin, axis=0)
        out[first + row[begin], -1] += np.diff(np.r_[begin, len(pick)])
    return out


def codewords(k: int) -> np.ndarray:
    """k rows of signs: the exhaustive code up to six languages, else the best of random dense codes."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 6:
        bits = np.arange(1, 1 << (k - 1))
        return np.vstack([np.ones(len(bits))] + [1.0 - 2.0 * ((bits >> i) & 1) for i in range(k - 1)])
    rng = np.random.Generator(np.random.PCG64(k))
    width, best, least = math.ceil(10 * math.log2(k)), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(k, width))
        if (np.abs(code.sum(0)) == k).any():
            continue
        gap = (width - code @ code.T) / 2
        np.fill_diagonal(gap, width)
        if gap.min() > least:
            best, least = code, gap.min()
    return best


class Model:
    """What ``fit`` found; small, and sent with the function that uses it."""

    def __init__(self, langs, code, table, scale, shift, weight, min_known, min_margin):
        self.langs, self.code, self.table = langs, code, table
        self.scale, self.shift, self.weight = scale, shift, weight
        self.min_known, self.min_margin = min_known, min_margin

    def outputs(self, raw, offsets):
        """Signed outputs of the bit classifiers, share of known trigrams, number of trigrams."""
        total = sums(raw, offsets, self.table)
        n = np.maximum(total[:, -1:], 1)
        known = total[:, -2] / n[:, 0]
        return total[:, :-2] / n * self.scale + self.shift, known, total[:, -1]

    def distances(self, z):
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None])
        return loss @ self.weight

    def predict(self, raw, offsets):
        z, known, n = self.outputs(raw, offsets)
        d = self.distances(z)
        order = np.argsort(d, axis=1, kind="stable")
        rows = np.arange(len(d))
        first = d[rows, order[:, 0]]
        margin = d[rows, order[:, 1]] - first if d.shape[1] > 1 else np.full(len(d), np.inf)
        none = n == 0
        rejected = none | (known < self.min_known) | (first > math.log(2))
        return order[:, 0], z, first, margin, known, none, rejected, none | (margin < self.min_margin)


def _classify(model: Model | None, column: pa.Array) -> pa.Array:
    n = len(column)
    if model is None:
        null = pa.nulls(n)
        return pa.StructArray.from_arrays(
            [null.cast(pa.string()), null.cast(pa.string())] + [null.cast(pa.float64())] * 3
            + [pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool))], fields=list(_ARROW))
    raw, offsets = buffers(column)
    parts = []
    for a, b in pieces(offsets):
        parts.append(model.predict(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    if not parts:
        return pa.array([], _ARROW)
    best, z, first, margin, known, none, rejected, unsure = (np.concatenate(x) for x in zip(*parts))
    langs = pa.array(model.langs, pa.string()).take(pa.array(np.where(none, 0, best)))
    signs = np.where(z > 0, ord("+"), ord("-")).astype(np.uint8)
    width = signs.shape[1]
    words = pa.Array.from_buffers(
        pa.string(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(signs.tobytes())]
    )
    blank = pa.array(none)
    hide = lambda x: pa.compute.if_else(blank, pa.scalar(None, x.type), x)
    return pa.StructArray.from_arrays(
        [hide(langs), hide(words), hide(pa.array(first)), hide(pa.array(margin)), pa.array(known), pa.array(unsure), pa.array(rejected)],
        fields=list(_ARROW),
    )


def _sample(docs: DataFrame, rows_per_lang: int) -> DataFrame:
    """Of every language the rows of least hash of doc_id, with their texts; of rows alike in language and id one, by a hash of the text."""
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    key = ["lang", "doc_id"]
    named = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND lang <> ''").select(*key, "text")
    chosen = named.select(*key).withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows_per_lang).select(*key).distinct()
    # at most rows_per_lang rows a language, so this broadcast does not grow with the corpus
    held = named.join(F.broadcast(chosen), key).groupBy(*key).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return held.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))


def fit(
    docs: DataFrame, rows_per_lang: int = 400, min_known: float = 0.25, min_margin: float = 0.05, smooth: float = 0.5
) -> Model | None:
    """Train on at most ``rows_per_lang`` rows of each language; None without labels."""
    ship(docs.sparkSession)
    sample = materialize(_sample(docs, rows_per_lang), "lang-sample")

    def count(batches):
        for batch in batches:
            for lang, half in sorted({(x, h) for x, h in zip(batch["lang"].to_pylist(), batch["half"].to_pylist())}):
                mask = pa.compute.and_(pa.compute.equal(batch["lang"], lang), pa.compute.equal(batch["half"], half))
                raw, offsets = buffers(batch["text"].filter(mask))
                code, usable = trigrams(raw, offsets)
                n = np.bincount(code[usable], minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array([half] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())],
                    names=["lang", "half", "gram", "n"],
                )

    counted = (
        sample.select("lang", "half", "text")
        .mapInArrow(count, "lang string, half int, gram long, n long")
        .groupBy("lang", "half", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if counted.empty:
        return None
    langs = sorted(counted["lang"].unique())
    code = codewords(len(langs))
    place = {x: i for i, x in enumerate(langs)}
    half = 0 if set(counted.loc[counted["half"] == 0, "lang"]) == set(langs) else None
    used = counted if half is None else counted[counted["half"] == half]
    n = np.zeros((len(langs), BUCKETS))
    np.add.at(n, (used["lang"].map(place).to_numpy(), used["gram"].to_numpy()), used["n"].to_numpy())
    table = np.zeros((BUCKETS, code.shape[1] + 1), np.float32)
    seen = n.sum(0) > 0
    n = n / np.maximum(n.sum(1, keepdims=True), 1)  # languages count alike, however much text they have
    unit = smooth / max(int(used["n"].sum()), 1) * len(langs)
    for b in range(code.shape[1]):
        yes, no = n[code[:, b] > 0].sum(0) + unit, n[code[:, b] < 0].sum(0) + unit
        if (code[:, b] < 0).any():
            table[:, b] = np.where(seen, np.log(yes / yes.sum()) - np.log(no / no.sum()), 0)
    table[:, -1] = seen
    model = Model(langs, code, table, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]) / code.shape[1], min_known, min_margin)

    def score(batches):
        for batch in batches:
            raw, offsets = buffers(batch["text"])
            z, _, seen_n = model.outputs(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(list(z), pa.list_(pa.float64())), pa.array(seen_n)], names=["lang", "z", "n"])

    held = sample if half is None else sample.where(F.col("half") == 1)
    scored = held.select("lang", "text").mapInArrow(score, "lang string, z array<double>, n double").where("n > 0").toPandas()
    if len(scored) and len(langs) > 1:
        z = np.stack(scored["z"].to_numpy())
        want = code[scored["lang"].map(place).to_numpy()]
        scale, shift, weight = [], [], []
        for b in range(code.shape[1]):
            a, c = _logistic(z[:, b], want[:, b])
            scale.append(a)
            shift.append(c)
            wrong = np.mean((z[:, b] * a + c) * want[:, b] <= 0)
            weight.append(max(0.05, 1 - 2 * wrong))
        model.scale, model.shift = np.array(scale), np.array(shift)
        model.weight = np.array(weight) / sum(weight)
    return model


def _logistic(x: np.ndarray, sign: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic regression, by Newton's method; the slope is not negative."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    y = (sign > 0).astype(float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w -= step / max(1.0, size / 2)
        if size < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def classifier(model: Model | None):
    """A column function: text -> struct of the results."""

    @F.arrow_udf(RESULT)
    def classify(text: pa.Array) -> pa.Array:
        return _classify(model, text)

    return classify


def identify(docs: DataFrame, text: str | Column = "text", **params) -> DataFrame:
    """(doc_id, lang_pred, codeword, distance, margin, known, ambiguous, rejected) of each row."""
    model = fit(docs, **params)
    got = docs.select("doc_id", classifier(model)(text).alias("_r"))
    return got.select("doc_id", "_r.*")


def keep_identified(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected."""
    model = fit(docs, **params)
    name = free_name(docs, "_lang")
    return docs.withColumn(name, classifier(model)("text")).where(~F.col(f"{name}.rejected")).drop(name)
