"""Language identification by a byte convolutional network, trained in numpy.

The network reads fixed-length windows of the lower-cased text's UTF-8 bytes:
byte embeddings, convolutions of several widths, ReLU, max pooling over the
window and a softmax over the languages seen. A text is judged by all its
windows, so whole texts count, whatever their length: the mean of the windows'
log probabilities, weighted by their bytes, gives its language and its score.

Convolutions over embedded bytes are sums of per-byte table rows, so inference
looks up a table by byte pairs and adds: for even widths, one gathered row per
pair of bytes.

Defined results: a null text, or one without any letter, is ``und`` with score 0.
If no row can be learned from, every text is ``und``. Repeated rows are judged
alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bytes in a window.
WINDOW = 128
WIDTHS = (2, 4, 6)
FILTERS = 16
EMBED = 8
#: Training windows at most, in all; every language gets its share, rare ones keep all their rows.
SAMPLE_WINDOWS = 12_000
EPOCHS = 6
SEED = 2
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    widths: tuple[int, ...]
    embed: np.ndarray  # 256 x EMBED
    kernels: list[np.ndarray]  # width x EMBED x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, a table per pair of neighbouring places: row ``256 * first + second``."""
        tables = []
        for kernel in self.kernels:
            by_byte = np.einsum("be,wef->wbf", self.embed, kernel)
            tables.append(
                [
                    (by_byte[j][:, None, :] + by_byte[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32)
                    for j in range(0, len(kernel), 2)
                ]
            )
        return tables


def _pooled(net: Network, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """Max-pooled features of windows (n x length bytes), and what the gradient needs."""
    x = net.embed[codes]
    pooled, kept = [], []
    for kernel, bias in zip(net.kernels, net.biases, strict=True):
        w = len(kernel)
        span = codes.shape[1] - w + 1
        cols = np.concatenate([x[:, j : j + span] for j in range(w)], axis=2)
        z = cols @ kernel.reshape(-1, kernel.shape[2]) + bias
        best = z.argmax(axis=1)
        top = np.take_along_axis(z, best[:, None, :], 1)[:, 0]
        pooled.append(np.maximum(top, 0))
        kept.append((cols, best, top > 0))
    return np.concatenate(pooled, axis=1), kept


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray, labels: Sequence[str], widths: tuple[int, ...] = WIDTHS, epochs: int = EPOCHS, seed: int = SEED
) -> Network:
    """Fit by Adam on cross entropy; ``windows`` is n x WINDOW bytes. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    net = Network(
        languages,
        widths,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in widths],
        [np.zeros(FILTERS, np.float32) for _ in widths],
        rng.normal(0, 0.1, (FILTERS * len(widths), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    params = [net.embed, *net.kernels, *net.biases, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * share))[y].astype(np.float32)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            rows = order[at : at + 64]
            codes = windows[rows]
            pooled, kept = _pooled(net, codes)
            p = _softmax(pooled @ net.out + net.out_bias)
            d = p
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= (weight[rows] / len(rows))[:, None]
            grads_out, grads_bias = pooled.T @ d, d.sum(axis=0)
            back = d @ net.out.T
            grad_embed = np.zeros_like(net.embed)
            grad_k, grad_b = [], []
            for i, (kernel, (cols, best, on)) in enumerate(zip(net.kernels, kept, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS] * on
                w = len(kernel)
                picked = np.take_along_axis(cols[:, :, None, :], best[:, None, :, None], 1)[:, 0]
                grad_k.append(np.einsum("nfc,nf->cf", picked, g).reshape(kernel.shape))
                grad_b.append(g.sum(axis=0))
                into = np.einsum("nf,cf->nfc", g, kernel.reshape(-1, FILTERS)).reshape(len(rows), FILTERS, w, EMBED)
                at_bytes = np.take_along_axis(codes[:, None, :], best[:, :, None] + np.arange(w), 2)
                np.add.at(grad_embed, at_bytes.ravel(), into.reshape(-1, EMBED))
            grad_embed[0] = 0
            t += 1
            for q, g, a, b in zip(params, [grad_embed, *grad_k, *grad_b, grads_out, grads_bias], m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.004 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


class Scorer:
    """Log probabilities of windows by gathered pair tables."""

    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, net.pair_tables()

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """n x WINDOW bytes -> n x languages log probabilities."""
        pairs = codes[:, :-1].astype(np.int32) * 256 + codes[:, 1:]
        pooled = []
        for width, tables, bias in zip(self.net.widths, self.tables, self.net.biases, strict=True):
            span = codes.shape[1] - width + 1
            z = np.take(tables[0], pairs[:, :span], axis=0)
            for j, table in enumerate(tables[1:], 1):
                z += np.take(table, pairs[:, 2 * j : 2 * j + span], axis=0)
            pooled.append(np.maximum(z.max(axis=1) + bias, 0))
        z = np.concatenate(pooled, axis=1) @ self.net.out + self.net.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def texts(self, texts: Sequence[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        raw = [(t or "").lower().encode() for t in texts]
        n = np.array([-(-len(b) // WINDOW) for b in raw])
        total = np.zeros((len(raw), len(self.net.languages)))
        if n.sum():
            codes = np.frombuffer(b"".join(b.ljust(k * WINDOW, b"\0") for b, k in zip(raw, n, strict=True)), dtype=np.uint8)
            codes = codes.reshape(-1, WINDOW)
            owner = np.repeat(np.arange(len(raw)), n)
            filled = np.full(len(owner), float(WINDOW))
            filled[np.cumsum(n)[n > 0] - 1] = [len(b) - (k - 1) * WINDOW for b, k in zip(raw, n, strict=True) if k]
            for at in range(0, len(codes), batch):
                logs = self.windows(codes[at : at + batch]) * filled[at : at + batch, None]
                np.add.at(total, owner[at : at + batch], logs)
        mean = total / np.maximum([len(b) for b in raw], 1)[:, None]
        p = _softmax(mean)
        best = p.argmax(axis=1)
        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        langs = [self.net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return langs, [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]


def training_windows(
    rows: DataFrame, text: str, lang: str, doc_id: str, most: int = SAMPLE_WINDOWS
) -> tuple[np.ndarray, list[str]]:
    """At most about ``most`` windows: from a hash sample of each language's rows, one at a hashed place of each text."""
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    quota = most / len(counts)
    rates = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, quota / n)))])
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text)), F.lit(1_000_000)) / 1e6
    size = F.length(text)
    start = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col(doc_id), size), F.greatest(size - WINDOW // 2, F.lit(1))) + 1
    part = F.substring(F.col(text), start.cast("int"), F.lit(WINDOW))
    picked = rows.filter(draw < rates[F.col(lang)]).select(part.alias("t"), F.col(lang).alias("l")).orderBy("l", "t")
    sample = picked.limit(2 * most).collect()
    windows = np.zeros((len(sample), WINDOW), np.uint8)
    for i, r in enumerate(sample):
        b = r["t"].lower().encode()[:WINDOW]
        windows[i, : len(b)] = np.frombuffer(b, np.uint8)
    return windows, [r["l"] for r in sample]


def held_out(doc_id) -> object:
    """Rows never learned from: those whose crc32(doc_id as text) leaves remainder 1 by 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``."""
    windows, labels = training_windows(docs.filter(~held_out(F.col(doc_id))), text, lang, doc_id)
    net = train(windows, labels) if labels else None
    columns = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(2).to_pylist()
                langs, scores = scorer.texts(texts) if scorer else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return columns.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
