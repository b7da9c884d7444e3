"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the mean of the embeddings of its byte n-grams (hashed into
``buckets``), followed by one linear layer.  Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; a held-back
part of the sample sets the temperature of the softmax and the threshold
below which a prediction is rejected.  As mean and layer are linear, a text's
logits are the mean of one row of ``buckets x languages`` per n-gram, which is
all that the tasks need (a table of fixed size).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import arrow_map, extended, strings, with_columns

ORDERS = (2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
UND = "und"

#: Bytes as features see them: ASCII letters and all bytes of other characters; the rest is a blank.
_BYTE = np.full(256, 32, np.uint32)
_BYTE[128:] = np.arange(128, 256)
_BYTE[97:123] = np.arange(97, 123)


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of the lower-cased texts (``len(ORDERS)`` per byte) and where
    each text's begin."""
    coded = [t.lower().encode("utf-8", "replace") + b"    " for t in texts]
    b = _BYTE[np.frombuffer(b" " + b"".join(coded) + b"    ", np.uint8)]
    n = len(b) - max(ORDERS)
    value, out = np.zeros(n, np.uint32), np.empty((n, len(ORDERS)), np.uint32)
    for k in range(max(ORDERS)):
        value = (value << np.uint32(8)) | b[k:k + n]
        if k + 1 in ORDERS:
            j = ORDERS.index(k + 1)
            out[:, j] = ((value ^ np.uint32(0x5bd1e995 * (k + 1) & 0xffffffff)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    starts = np.concatenate(([0], np.cumsum([len(c) for c in coded])))
    return out, starts


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: what an n-gram adds to the mean logits
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.languages)))
        g, starts = grams(texts, self.bits)
        each = self.table[g[:, 0]]
        for j in range(1, g.shape[1]):
            each += self.table[g[:, j]]
        total = np.add.reduceat(each[:starts[-1]], starts[:-1], axis=0, dtype=np.float64)
        z = (total / (np.diff(starts) * g.shape[1])[:, None] + self.bias) / self.temperature
        return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _snippets(texts: list[str], rng: np.random.Generator, per_text: int, longest: int) -> tuple[list[str], list[int]]:
    """Random passages of the texts, of 20 characters or more, so that short texts are learned too."""
    out, of = [], []
    for i, t in enumerate(texts):
        for _ in range(per_text):
            n = int(rng.integers(20, longest + 1))
            at = int(rng.integers(0, max(1, len(t) - n + 1)))
            out.append(t[at:at + n])
            of.append(i)
    return out, of


def train(texts: list[str], labels: list[str], bits: int = 15, dim: int = 16, epochs: int = 3, rate: float = 0.5,
          batch: int = 64, least_steps: int = 500, per_text: int = 4, longest: int = 400, rejected: float = 0.001, seed: int = 7) -> Model:
    """Fit a model; ``rejected`` is the share of rightly labelled held-back passages that the threshold may refuse
    (the threshold is at most one half)."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y_all = np.array([languages.index(x) for x in labels], np.int64)
    held = rng.random(len(texts)) < 0.2
    if held.all() or not held.any():
        held = np.zeros(len(texts), bool)
    emb = (rng.random((1 << bits, dim)) - 0.5).astype(np.float32) / dim
    lin, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    own = np.flatnonzero(~held)
    passages, of = _snippets([texts[i] for i in own], rng, per_text, longest)
    y = y_all[own[np.array(of, np.int64)]] if len(of) else np.zeros(0, np.int64)
    epochs = max(epochs, -(-least_steps * batch // max(1, len(passages))))
    steps, done = max(1, epochs * -(-len(passages) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(passages))
        for at in range(0, len(order), batch):
            idx = order[at:at + batch]
            g, starts = grams([passages[i] for i in idx], bits)
            g = g[:starts[-1]]
            size = (np.diff(starts) * g.shape[1]).astype(np.float32)
            flat, row = g.ravel(), np.repeat(np.arange(len(idx)), np.diff(starts) * g.shape[1])
            used, place = np.unique(flat, return_inverse=True)
            # documents x used buckets, as counts over lengths
            share = np.bincount(row * len(used) + place, minlength=len(idx) * len(used)).reshape(len(idx), -1).astype(np.float32)
            share /= size[:, None]
            x = share @ emb[used]
            p = _softmax(x @ lin + bias)
            p[np.arange(len(idx)), y[idx]] -= 1
            now = rate * (1 - done / steps)
            grad = p @ lin.T
            lin -= now * (x.T @ p)
            bias -= now * p.mean(axis=0)
            emb[used] -= now * (share.T @ grad)
            done += 1
    model = Model(languages, (emb @ lin).astype(np.float32), bias.astype(np.float64), 1.0, 0.0, bits)

    back = np.flatnonzero(held)
    if len(back):
        passages, of = _snippets([texts[i] for i in back], rng, per_text, longest)
        passages += [texts[i] for i in back]
        truth = y_all[back[np.array(of + list(range(len(back))), np.int64)]]
        blocks = [model.probabilities(passages[i:i + 128]) for i in range(0, len(passages), 128)]  # bounds the driver's memory
        z = np.log(np.maximum(np.concatenate(blocks), 1e-300))

        def loss(t: float) -> float:
            return -float(np.mean(np.log(np.maximum(_softmax(z / t)[np.arange(len(truth)), truth], 1e-12))))

        model.temperature = min(np.geomspace(0.02, 20, 61).tolist(), key=loss)
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == truth
        if right.any():
            model.threshold = float(min(0.5, np.quantile(p.max(axis=1)[right], rejected)))
    return model


def sample(docs: DataFrame, usable: Column, per_language: int, text_col: str, lang_col: str, max_rows: int = 24_000) -> list:
    """About ``per_language`` rows (text, lang) of each language, chosen by a hash of the id: first
    the languages are counted, then each keeps the share of its hash range that gives the number.  With
    very many languages each has fewer rows, so that there are about ``max_rows`` of all."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, max_rows // len(counts)))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    bound = F.lit(0)
    for lang, n in sorted(counts.items()):
        bound = F.when(F.col(lang_col) == lang, F.lit(min(1 << 30, -(-(per_language << 30) // n)))).otherwise(bound)
    got = rows.where(spot < bound).select("doc_id", F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return sorted(got.limit(2 * per_language * len(counts)).collect(), key=lambda r: (str(r[0]), r[1]))


def stretches(text: Column, chars: int, n: int = 4) -> Column:
    """The whole text up to ``chars`` characters; of a longer one ``n`` stretches of equal length, together as long, from
    places all over it (chosen by hashes of the text)."""
    long = chars // n
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(
        text, (F.pmod(F.xxhash64(text, i), F.char_length(text) - long + 1) + 1).cast("int"), F.lit(long)))
    return F.when(F.char_length(text) <= chars, text).otherwise(F.array_join(places, "\n"))


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = 600, sample_chars: int = 6000,
        text_col: str = "text", lang_col: str = "lang", **options) -> Model | None:
    """A model from at most ``2 * per_language`` rows of each language among the ``usable`` ones; passages are drawn from
    the whole of each text, ``sample_chars`` characters of it in all (the bound of what the driver holds of a row).  None without labelled rows."""
    rows = docs.withColumn("_text", stretches(F.col(text_col), sample_chars))
    got = sample(rows, F.lit(True) if usable is None else usable, per_language, "_text", lang_col)
    return train([r["text"] for r in got], [r["lang"] for r in got], **options) if got else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, accepted`` from the whole text alone.

    ``lang_pred`` is ``und`` (score 0, not accepted) for a null text, one without
    letters, or when nothing could be learned; ``accepted`` tells whether the
    calibrated score reaches the model's threshold.  Rows are judged one by one;
    columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = strings(batch.column(batch.schema.get_field_index(text_col)))
        lang, score, ok = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        todo = [i for i, t in enumerate(texts) if m is not None and _LETTER.search(t)]
        at = 0
        while at < len(todo):
            end, size = at, 0
            while end < len(todo) and (end == at or size < 1 << 20):
                size += len(texts[todo[end]])
                end += 1
            p = m.probabilities([texts[i] for i in todo[at:end]])
            for i, row in zip(todo[at:end], p):
                k = int(row.argmax())
                lang[i], score[i], ok[i] = m.languages[k], row[k], row[k] >= m.threshold
            at = end
        return with_columns(batch, {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                                    "accepted": pa.array(ok, pa.bool_())})

    return arrow_map(docs, run, extended(docs, {"lang_pred": "string", "score": "double", "accepted": "boolean"}))


def keep_known(docs: DataFrame, usable: Column | None = None, **options) -> DataFrame:
    """The rows whose language is recognised, with their columns as they were.

    Where no row has both a text and a language, nothing can be learned and no row can be judged: all are kept.
    """
    model = fit(docs, usable, **options)
    if model is None:
        return docs
    return predict(docs, model).where("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
