"""Language identification with a byte convolutional network in numpy.

Filters of several widths slide over the bytes of fixed-length windows; a
filter's output at a place is the sum of one learned number per byte of its
width, so it is read from tables.  The largest output in a window (max pooling)
passes a rectifier and a softmax layer.  A text's windows cover it whole; its
language is the one of the highest mean probability, windows weighing as many
bytes as they hold.

The network is trained on the driver on the whole texts of at most `per_language`
different labelled texts for each language, those with the smallest hashes; that
sample is the only bounded part, and `per_language` its only bound.

Outputs whose name a column of docs has get an underscore appended; the column stays.

Cases: text null or without a letter is `und` with score 0, as is everything if
no labelled document is there to learn from; texts shorter than a window are
padded; a null label is not learned from; rows with equal doc_id are predicted
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table
from .words import text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_LANGUAGE = 400
EPOCHS = 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class Network:
    """Tables[w] has for each place of a filter of width w and each byte one number per filter."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        for t in self.tables.values():
            t[:, 0] = 0  # padding
        self.weight = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _places(self, x: np.ndarray, w: int) -> np.ndarray:
        m = x.shape[1] - w + 1
        return sum(self.tables[w][i][x[:, i : i + m]] for i in range(w))

    def _softmax(self, f: np.ndarray) -> np.ndarray:
        z = np.maximum(f, 0) @ self.weight + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
        """Adam on the cross entropy; only the place that won the pooling gets a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.weight, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                at = order[s : s + batch]
                wins, pooled = {}, []
                for w in WIDTHS:
                    z = self._places(x[at], w)
                    wins[w] = z.argmax(axis=1)
                    pooled.append(np.take_along_axis(z, wins[w][:, None], axis=1)[:, 0])
                f = np.concatenate(pooled, axis=1)
                d = self._softmax(f)
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                back = (d @ self.weight.T) * (f > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    own = back[:, i * FILTERS : (i + 1) * FILTERS]
                    g = np.zeros_like(self.tables[w])
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x[at], wins[w] + j, axis=1), np.arange(FILTERS)[None, :]), own)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [np.maximum(f, 0).T @ d, d.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def compiled(self) -> Compiled:
        return Compiled(self)


class Compiled:
    """The same network with two bytes per table read, for prediction."""

    def __init__(self, net: Network):
        self.languages = np.array(net.languages)
        self.net = net
        self.pairs, self.singles = {}, {}
        for w, t in net.tables.items():
            self.pairs[w] = [(t[i + 1][:, None, :] + t[i][None, :, :]).reshape(65536, -1) for i in range(0, w - 1, 2)]
            self.singles[w] = t[w - 1].copy() if w % 2 else None

    def predict(self, x: np.ndarray, chunk: int = 64) -> np.ndarray:
        """Probabilities for each window of x."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for s in range(0, len(x), chunk):
            b = x[s : s + chunk]
            two = b[:, :-1].astype(np.int32) | b[:, 1:].astype(np.int32) << 8
            pooled = []
            for w in self.pairs:
                m = b.shape[1] - w + 1
                z = self.pairs[w][0].take(two[:, :m], axis=0)
                for i, t in enumerate(self.pairs[w][1:], 1):
                    z += t.take(two[:, 2 * i : 2 * i + m], axis=0)
                if self.singles[w] is not None:
                    z += self.singles[w].take(b[:, w - 1 : w - 1 + m], axis=0)
                pooled.append(z.max(axis=1))
            out[s : s + chunk] = self.net._softmax(np.concatenate(pooled, axis=1))
        return out


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in windows: bytes, the text each is of, and how many bytes it holds."""
    data, offsets = text_bytes(texts)
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.concatenate(([0], np.cumsum(count)))
    flat = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    for i in np.flatnonzero(size):
        flat[first[i] * WINDOW : first[i] * WINDOW + size[i]] = data[offsets[i] : offsets[i + 1]]
    held = np.full(len(owner), WINDOW, np.int64)
    held[first[1:][count > 0] - 1] -= (count * WINDOW - size)[count > 0]
    return flat.reshape(-1, WINDOW), owner, held


def sample(docs: DataFrame, learn: Column, per_language: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels of the whole texts of at most per_language different texts of each language, chosen by hash.

    A first cut by a share of all hashes leaves slightly more of them, so few rows come to the driver; reruns agree."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["count"] for r in labelled.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.3 * per_language / n))).otherwise(share)
    got = labelled.where(F.col("h") < share * (1 << 30)).dropDuplicates(["lang", "h"]).orderBy("lang", "h").toArrow()
    languages, taken, texts, y = sorted(counts), dict.fromkeys(counts, 0), [], []
    for lang, text in zip(got["lang"].to_pylist(), got["text"]):
        if taken[lang] < per_language:
            taken[lang] += 1
            texts.append(text.as_py())
            y.append(languages.index(lang))
    x, owner, _ = windows(pa.array(texts, pa.string()))
    return x, np.array(y, int)[owner], languages


def learned(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Compiled | None:
    """The network for the languages of the rows for which `learn` holds; only their text and lang are looked at."""
    typed = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    x, y, languages = sample(typed, learn, per_language)
    return Network(languages).train(x, y).compiled() if languages else None


def identify(docs: DataFrame, learn: Column | None = None, per_language: int = PER_LANGUAGE, network: Compiled | None = None) -> DataFrame:
    """docs with lang_pred and score, by `network` or one learned from the rows for which `learn` holds."""
    network = learned(docs, learn, per_language) if network is None and learn is not None else network
    languages = list(network.languages) if network is not None else []
    model = docs.sparkSession.sparkContext.broadcast(network)
    names = docs.columns
    at = names.index("text")
    added = fresh(names, "lang_pred", "score")
    typed = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches):
        net = model.value
        for batch in batches:
            texts = batch.column(at)
            n = batch.num_rows
            total = np.zeros((n, len(languages) or 1))
            x, owner, held = (np.zeros((0, WINDOW), np.uint8), [], [])
            if net is not None:
                x, owner, held = windows(texts)
            if len(x):
                np.add.at(total, owner, net.predict(x) * held[:, None])
            letters = np.array([bool(t.is_valid and _LETTER.search(t.as_py())) for t in texts], bool)
            if net is None:
                letters[:] = False
            best = total.argmax(axis=1)
            score = np.where(letters, total[np.arange(n), best] / np.maximum(total.sum(axis=1), 1e-30), 0.0)
            pred = [str(languages[b]) if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            cols = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in batch.columns]
            yield pa.record_batch([*cols, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], [*names, *added])

    return typed.mapInArrow(run, typed.withColumn(added[0], F.lit("")).withColumn(added[1], F.lit(0.0)).schema)


def held_out() -> Column:
    """Documents whose crc32 of doc_id as text is 2 modulo 4; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
