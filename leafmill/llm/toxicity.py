"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text compress each window."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.scratch import give_back

#: Bounds of the training sample: documents of each class.
MAX_TOXIC, MAX_ORDINARY = 1200, 4000
#: A third of the sample calibrates; the rest trains the dictionaries.
CALIBRATE = 3
DICT_BYTES = 32_768
WINDOW = 64
#: A toxic stem occurs in this share of the toxic texts, and thirty times rarer in the ordinary ones.
STEM_SHARE, STEM_RATIO = 0.03, 30
STEM_BYTES = 16


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of whole words of about size bytes, each sharing half with the one before, over the whole text."""
    out, last, now, n = [], [], [], 0
    for w in _words(text):
        now.append(w)
        n += len(w) + 1
        if n >= size // 2:
            out.append(b" " + b" ".join(last + now) + b" ")
            last, now, n = now, [], 0
    if now:
        out.append(b" " + b" ".join(last + now) + b" ")
    return out


def _stems(text: str, size: int, known: set[bytes] | None) -> set[bytes]:
    """Beginnings of size bytes of the words with the space before them, of words whose beginnings of one byte less
    are known (all if None); for size 0, whole words with the spaces around them."""
    words = {w.strip(b".,!?;:") for w in set(_words(text))}
    if not size:
        return {b" " + w + b" " for w in words if len(w) >= 3 and (known is None or b" " + w[:4] in known)}
    return {b" " + w[:size] for w in words if len(w) >= size and (known is None or b" " + w[: size - 1] in known)}


def _fresh(texts: list[str]) -> list[str]:
    """Texts without those of which most rare words were seen before: copies would count a stem again and again."""
    seen, out = Counter(), []
    for t in texts:
        own = set(_words(t))
        rare = [w for w in own if seen[w] <= 2]
        if len(own) < 8 or len(rare) >= 0.2 * len(own) or not out:
            out.append(t)
            seen.update(own)
    return out


def _toxic_stems(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Recurring stems of toxic text that ordinary text lacks, the commonest last; of nested ones, the one that
    keeps most of the occurrences."""
    least = max(3, STEM_SHARE * len(toxic))
    t: Counter = Counter()

    def count(size: int, known: set[bytes] | None) -> set[bytes]:
        seen: Counter = Counter()
        for x in toxic:
            seen.update(_stems(x, size, known))
        often = {g: n for g, n in seen.items() if n >= least}
        t.update(often)
        return set(often)

    level = first = count(4, None)
    for size in range(5, STEM_BYTES + 1):  # only beginnings of stems that are common themselves are counted
        level = count(size, level)
    count(0, None)
    o: Counter = Counter()
    for x in ordinary:
        words = {w.strip(b".,!?;:") for w in set(_words(x))}
        o.update({g for w in words for g in (b" " + w + b" ", *(b" " + w[:n] for n in range(4, min(len(w), STEM_BYTES) + 1) if b" " + w[:4] in first)) if g in t})
    found = {g: n for g, n in t.items() if o[g] * STEM_RATIO * len(toxic) <= n * len(ordinary)}
    ends = {g for g in found if not any(h != g and h.startswith(g) and n >= 0.8 * found[g] for h, n in found.items())}
    return sorted((g for g in ends if not any(h != g and g.startswith(h) and found[h] > 1.25 * found[g] for h in ends)), key=lambda g: (found[g], g))


def _train(texts: list[str], size: int) -> bytes:
    """A trained dictionary's content; the texts' own end where there are too few to train on."""
    import zstandard

    samples = [b" ".join(_words(t)) for t in texts]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _compressor(content: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=15, chain_log=16, search_log=4,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


@dataclass
class Model:
    """Two dictionaries and the calibration of their differences; a few tens of kilobytes."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return (self.ordinary, self.toxic, self.weights)

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights = state
        self._pair = None

    def features(self, text: str | None) -> list[float]:
        """Of the bytes that the toxic dictionary saves in each window: the most, the sum and how many save any."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary).compress, _compressor(self.toxic + self.ordinary).compress
        plain, toxic = self._pair
        most = total = hits = n = 0
        for w in windows(text):
            saved = len(plain(w)) - len(toxic(w))
            n += 1
            if saved > 0:
                most, total, hits = max(most, saved), total + saved, hits + 1
        return [min(most, 6) / 3, np.log1p(total), np.log1p(hits), np.log1p(n), 1.0]

    def score(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([self.features(t) for t in texts], dtype=np.float64).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """A model of labelled texts. Where one class is missing, all scores are 0 (no toxic text) or as calibrated."""
    if not toxic or not ordinary:
        return Model(b"", b"", None)
    parts = [([t for k, t in enumerate(x) if k % CALIBRATE or len(x) < 2 * CALIBRATE], [t for k, t in enumerate(x) if k % CALIBRATE == 0 or len(x) < 2 * CALIBRATE]) for x in (toxic, ordinary)]
    (fit_t, cal_t), (fit_o, cal_o) = parts
    model = Model(_train(fit_o, DICT_BYTES), b"".join(_toxic_stems(_fresh(fit_t), fit_o)), None)
    x = np.array([model.features(t) for t in [*cal_t, *cal_o]])
    y = np.array([1.0] * len(cal_t) + [0.0] * len(cal_o))
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method for the ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
    model.weights = w
    return model


def fold(id_col):
    """Which fifth of the ids a row is in; fifth 0 is held out. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled documents outside the held-out fifth, in one task.

    The sample is of at most MAX_TOXIC and MAX_ORDINARY ids, those that hash lowest, with whole texts. Rows with a null
    label, id or text and empty texts don't count; repeated rows count once, and of repeated ids with two labels the
    toxic one holds. Without labelled texts the model scores everything 0.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna().filter(fold(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    pick = lambda y, n: marked.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = F.broadcast(pick(1, MAX_TOXIC).union(pick(0, MAX_ORDINARY)))  # bounded, so that no text is shuffled
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text != ''")
    found = texts.join(chosen, F.col("doc_id") == F.col("id")).select(F.lit(0).alias("one"), "y", F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("doc_id"), "text")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "text"]).drop_duplicates(["doc_id", "text"])
        model = fit(*(pdf.loc[pdf["y"] == y, "text"].tolist() for y in (1, 0)))
        give_back()
        return pd.DataFrame({"ordinary": [model.ordinary], "toxic": [model.toxic], "weights": [None if model.weights is None else model.weights.tolist()]})

    row = found.groupBy("one").applyInPandas(learn, "ordinary binary, toxic binary, weights array<double>").first()
    if row is None or row["weights"] is None:
        return Model(b"", b"", None)
    return Model(bytes(row["ordinary"]), bytes(row["toxic"]), np.array(row["weights"]))


def score_column(spark, model: Model, text):
    """A column of scores from 0 to 1 of the whole text; null and empty texts get the score of no windows."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        scores = pd.Series(shared.value.score(texts))
        give_back()
        return scores

    return of(text)
