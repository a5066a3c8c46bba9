"""Quality rules: counted signals plus a calibrated logistic regression over hashed word and character n-grams.

The model is fitted on a bounded sample of labelled rows (`max_train`, the labels of smallest hash, and `max_chars`) by
one task, and scored over every whole text in Arrow batches against fixed thresholds.

Cases: a null or empty text has no words, so it fails the base rule; a null doc_id is scored like any other; repeated
rows are scored each by itself; a null label trains nothing in its head; without labels of both classes a head is absent
and only the base rules decide; an empty table gives no rows; columns of the input that share a name with a signal give
way to the signal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import table

DIMS = 1 << 17
WORD_ORDERS = (1, 2)
#: Bytes of text that are taken apart at a time; n-grams of characters take many times their bytes.
CHUNK = 1 << 18
CHAR_ORDER = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_quality double, p_toxic double, base_failed boolean, kept boolean"


@dataclass
class Model:
    """Weights of the heads that could be fitted; a head maps to (weights, bias, slope and offset of its calibration)."""

    heads: dict[str, tuple[np.ndarray, float, float, float]]
    quality_at: float = 0.5
    toxic_at: float = 0.5


def ngram_slots(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for characters: slots of all n-grams and the offsets of the texts among them."""
    n = len(offs) - 1
    low = K.lower(buf)
    starts, ends, first = K.word_spans(low, offs)
    h = K.span_hashes(low, starts, ends)
    words, of = [], []
    for k in WORD_ORDERS:
        if len(h) >= k:
            x = K.windows(h, k)
            doc = np.searchsorted(first, np.arange(len(x)), "right") - 1
            inside = np.arange(len(x)) + k <= first[doc + 1]
            words.append((x[inside] % np.uint64(DIMS // 2)).astype(np.int64))
            of.append(doc[inside])
    slot, doc = (np.concatenate(words), np.concatenate(of)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(doc, kind="stable")
    out = [(slot[order], np.searchsorted(doc[order], np.arange(n + 1)))]
    lead = (low & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(lead)))[offs]
    code = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) >= CHAR_ORDER and before[-1] == len(code):
        m = len(code) - CHAR_ORDER + 1
        x = np.zeros(m, np.uint64)
        for k in range(CHAR_ORDER):
            x = x * np.uint64(0x100000001B3) + code[k : k + m]
        inside = np.ones(m, bool)
        for k in range(1, CHAR_ORDER):
            cut = before[1:-1] - k
            inside[cut[(cut >= 0) & (cut < m)]] = False
        at = np.flatnonzero(inside)
        out.append(((K.mix(x[at]) % np.uint64(DIMS // 2)).astype(np.int64) + DIMS // 2, np.searchsorted(at, before)))
    else:
        out.append((np.zeros(0, np.int64), np.zeros(n + 1, np.int64)))
    return out


def logits(heads: np.ndarray, slots: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Mean weight of a text's n-grams, over both families, for each head."""
    z = np.zeros((heads.shape[0], n))
    for slot, first in slots:
        count = np.maximum(np.diff(first), 1)
        for k in range(heads.shape[0]):
            z[k] += K.per_text(heads[k][slot].astype(np.float64), first) / count
    return z


def signals(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    starts, ends, first = K.word_spans(buf, offs)
    n_words = np.diff(first)
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    word_chars = K.per_text(chars[ends] - chars[starts], first)
    n_symbols = K.per_text(_SYMBOL[buf].astype(np.int64), offs)
    h = K.span_hashes(buf, starts, ends)
    repeat, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    eight = K.windows(h, 8) if len(h) >= 8 else np.zeros(0, np.uint64)
    for d in np.flatnonzero(n_words >= 9):
        x = eight[first[d] : first[d + 1] - 7]
        if len(np.unique(x)) < len(x):
            own = slice(first[d], first[d + 1])
            x = K.doubled_classes(K.span_classes(buf, starts[own], ends[own]), 3)
            _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
            hit = np.zeros(n_words[d] + 1, np.int64)
            at = np.flatnonzero(count[inverse] > 1)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + 8, -1)
            repeat[d] = int((np.cumsum(hit)[:-1] > 0).sum())
    feeds = np.flatnonzero(buf == 10)
    cut = np.searchsorted(feeds, offs)
    for d in np.flatnonzero(np.diff(cut) > 0):
        inner = feeds[cut[d] : cut[d + 1]]
        a, b = np.concatenate(([offs[d]], inner + 1)), np.concatenate((inner, [offs[d + 1]]))
        solid = np.searchsorted(starts, b) > np.searchsorted(starts, a)
        a, b = a[solid], b[solid]
        if len(a) > 1:
            text = buf[offs[d] : offs[d + 1]]
            lines = K.span_classes(text, a - offs[d], b - offs[d])
            dup[d] = len(lines) - len(np.unique(lines))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * z + offset) a probability on held-out rows.

    Newton steps that are halved until the loss falls, so that separable rows can't send them astray.
    """
    scale = max(1.0, float(np.abs(z).max()))
    x = np.stack((z / scale, np.ones_like(z)), 1)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda w: float((np.logaddexp(0, x @ w) - t * (x @ w)).sum())
    w = np.array([0.0, np.log((y.sum() + 1) / ((1 - y).sum() + 1))])
    now = loss(w)
    for _ in range(100):
        p = _sigmoid(x @ w)
        g = x.T @ (p - t)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-9 * np.eye(2), g)
        size = 1.0
        while size > 1e-8 and (then := loss(w - size * step)) > now - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-8 or now - then < 1e-10:
            break
        w, now = w - size * step, then
    return float(w[0] / scale), float(w[1])


def features(rows: DataFrame) -> DataFrame:
    """(_key, slots, shares, quality, toxic) of labelled texts (_key, text, quality, toxic): the distinct n-grams of a
    text and their shares among the words' and among the characters'. The work is done where the texts lie."""
    schema = pa.schema([("_key", pa.int64()), ("slots", pa.binary()), ("shares", pa.binary()), ("quality", pa.int32()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in K.chunks(batch.column(1), CHUNK):
                families, slots, shares = ngram_slots(buf, offs), [], []
                for d in range(hi - lo):
                    own = [np.unique(slot[first[d] : first[d + 1]], return_counts=True) for slot, first in families]
                    slots.append(np.concatenate([s for s, _ in own]).astype("<i4").tobytes())
                    shares.append(np.concatenate([n / max(1, n.sum()) for _, n in own]).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(slots, pa.binary()), pa.array(shares, pa.binary()), *(batch.column(k).slice(lo, hi - lo).cast(pa.int32()) for k in (2, 3))], schema=schema)

    return rows.mapInArrow(run, "_key long, slots binary, shares binary, quality int, toxic int")


def fit_head(slots: np.ndarray, shares: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 256, l2: float = 1e-6) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, bias and calibration for targets y (nan: no label); three rows in four fit the weights (Adam over
    batches of texts, classes weighing the same), every fourth row the calibration. None if a class has too few rows."""
    n = len(y)
    held, known = np.arange(n) % 4 == 3, ~np.isnan(y)
    pos, neg = known & (y > 0), known & (y <= 0)
    if min((pos & ~held).sum(), (neg & ~held).sum()) < 2 or min((pos & held).sum(), (neg & held).sum()) < 1:
        return None
    weight = np.where(pos, 0.5 / (pos & ~held).sum(), np.where(neg, 0.5 / (neg & ~held).sum(), 0.0)) * ~held
    goal = np.where(pos, 1.0, 0.0)
    w, bias, m1, m2, b1, b2, t = np.zeros(DIMS), 0.0, np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, 0
    cuts = list(range(0, n, batch))
    steps = epochs * len(cuts)

    def raw(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c, v, size = slots[first[lo] : first[hi]], shares[first[lo] : first[hi]], np.diff(first[lo : hi + 1])
        return c, v, size, K.per_text(w[c] * v, first[lo : hi + 1] - first[lo])

    for _ in range(epochs):
        for lo in cuts:
            hi, t = min(n, lo + batch), t + 1
            c, v, size, z = raw(lo, hi)
            e = (_sigmoid(z + bias) - goal[lo:hi]) * weight[lo:hi] * (n / (hi - lo))
            g, gb = np.bincount(c, weights=np.repeat(e, size) * v, minlength=DIMS) + l2 * w, e.sum()
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
            rate = min(1, 2 * (1 - t / (steps + 1)))
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
            bias -= 0.05 * rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-7)
    z = np.concatenate([raw(lo, min(n, lo + batch))[3] for lo in cuts]) + bias
    use = held & known
    return (w.astype(np.float32), float(bias), *_platt(z[use], goal[use]))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: the bounded sample of features in, a row for each head that could be fitted out."""
    slots, shares, targets = [], [], {"quality": [], "toxic": []}
    for batch in batches:
        slots += [np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()]
        shares += [np.frombuffer(x, "<f4") for x in batch.column(2).to_pylist()]
        for k, name in enumerate(targets):
            targets[name] += batch.column(3 + k).to_pylist()
    if not slots:
        return
    first = np.concatenate(([0], np.cumsum([len(x) for x in slots])))
    flat, share = np.concatenate(slots), np.concatenate(shares)
    del slots, shares
    for name, given in targets.items():
        head = fit_head(flat, share, first, np.array([np.nan if x is None else float(x != 0) for x in given]))
        if head:
            yield pa.RecordBatch.from_pydict({"head": [name], "weights": pa.array([head[0].astype("<f4").tobytes()], pa.binary()), "bias": [head[1]], "slope": [head[2]], "offset": [head[3]]})


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000, max_chars: int = 20_000, quality_at: float = 0.5, toxic_at: float = 0.4) -> Model:
    """Fits both heads on at most max_train labelled documents of at most max_chars characters (longer ones don't train,
    they are scored whole all the same), so the sample has at most 4 * max_train * max_chars bytes.

    N-grams are counted by the tasks that read the texts, one task fits, and the driver gets the heads' weights alone. A
    null label trains nothing in its head; of labels of one doc_id the least quality and the most toxicity count, and of
    texts of one doc_id the smallest one.
    """
    rows = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic")).where("_quality IS NOT NULL OR _toxic IS NOT NULL")
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= max_chars).join(F.broadcast(few), "doc_id")
    once = texts.groupBy("doc_id", "_quality", "_toxic").agg(F.min("text").alias("text")).select(F.xxhash64(F.lit(7), "doc_id").alias("_key"), "text", "_quality", "_toxic")
    fitted = features(once).repartition(1).sortWithinPartitions("_key").mapInArrow(_fitted, "head string, weights binary, bias double, slope double, offset double")
    return Model({r["head"]: (np.frombuffer(r["weights"], "<f4"), r["bias"], r["slope"], r["offset"]) for r in fitted.collect()}, quality_at, toxic_at)


def score(docs: DataFrame, model: Model, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """docs with SIGNALS. A document is kept if the base rules pass, p_quality reaches its threshold and p_toxic stays below its own."""
    spark = docs.sparkSession
    names = list(model.heads)
    shared = spark.sparkContext.broadcast((np.stack([model.heads[k][0] for k in names]) if names else np.zeros((0, DIMS), np.float32), [model.heads[k][1:] for k in names]))
    at = {"quality": model.quality_at, "toxic": model.toxic_at}
    own = [x.split()[0] for x in SIGNALS.split(", ")]
    rest = [c for c in docs.columns if c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, more = shared.value
        for batch in batches:
            for lo, hi, buf, offs in K.chunks(batch.column(1), CHUNK):
                x = signals(buf, offs)
                z = logits(weights, ngram_slots(buf, offs), hi - lo)
                p = {k: _sigmoid(more[j][1] * (z[j] + more[j][0]) + more[j][2]) for j, k in enumerate(names)}
                x["base_failed"] = (x["n_words"] < min_words) | (100 * x["n_repeat_words"] > max_repeat * x["n_words"])
                x["kept"] = ~x["base_failed"]
                if "quality" in p:
                    x["kept"] &= p["quality"] >= at["quality"]
                if "toxic" in p:
                    x["kept"] &= p["toxic"] < at["toxic"]
                for k in ("quality", "toxic"):
                    x[f"p_{k}"] = pa.array(p[k]) if k in p else pa.nulls(hi - lo, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(x[c] if isinstance(x[c], pa.Array) else pa.array(x[c]) for c in own)], ["_row", *own])

    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col("text").alias("_text"))
    schema = f"_row {given.schema['_row'].dataType.simpleString()}, {SIGNALS}"
    return given.mapInArrow(run, schema).select("_row.*", *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_quality", 4).alias("p_quality"), F.round("p_toxic", 4).alias("p_toxic"))
