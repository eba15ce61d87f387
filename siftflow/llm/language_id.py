"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows; over each window one network reads forward and one backward, their
states label every byte with a probability per language, and a document's probabilities are the mean over all
its bytes. Training is backpropagation through time with Adam on windows of a bounded sample of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table

#: Bytes of a window, hidden units of each direction, windows that are run side by side.
WINDOW, HIDDEN, LANES = 128, 16, 1024
#: The bound of the training sample: documents of a language, and windows of a document.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 600, 6
#: Texts of the learned languages stay below 0.2 (of 200 bytes or more, on the sf tables), others lie above 0.45.
STRANGE_SHARE = 0.35
EPOCHS, BATCH, SEED = 4, 256, 7
UNDETERMINED = "und"


@dataclass
class BiGru:
    """Weights. First axis: direction; gates stack as update, reset, candidate."""

    langs: list[str]
    x: np.ndarray  # (2, 3H, 256): what a byte adds to the gates
    u: np.ndarray  # (2, 3H, H): what the state adds
    b: np.ndarray  # (2, 3H, 1)
    o: np.ndarray  # (2, C, H): state to label
    c: np.ndarray  # (C, 1)
    seen: np.ndarray | None = None  # a bit per byte trigram: in the training windows

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> BiGru:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype("f4")

        n = len(langs)
        return cls(langs, draw(2, 3 * hidden, 256, scale=0.3), draw(2, 3 * hidden, hidden, scale=hidden**-0.5), np.zeros((2, 3 * hidden, 1), "f4"), draw(2, n, hidden, scale=hidden**-0.5), np.zeros((n, 1), "f4"))

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.o, self.c]

    def _gates(self, both: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input part, state part, and update and reset gates of a step."""
        k = 2 * h.shape[1]
        g = np.empty((2, self.x.shape[1], h.shape[2]), "f4")
        for d in (0, 1):
            np.take(self.x[d], both[d], axis=1, out=g[d], mode="clip")
        s = self.u @ h
        s += self.b
        zr = g[:, :k] + s[:, :k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        return g, s, zr

    def label(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (T, C, N) of every byte of windows (N, T)."""
        n, steps = windows.shape
        hidden = self.u.shape[2]
        seq = np.ascontiguousarray(windows.T).astype(np.intp)
        h = np.zeros((2, hidden, n), "f4")
        out = np.zeros((steps, len(self.langs), n), "f4")
        for t in range(steps):
            g, s, zr = self._gates((seq[t], seq[steps - 1 - t]), h)
            new = s[:, 2 * hidden :] * zr[:, hidden:]
            new += g[:, 2 * hidden :]
            np.tanh(new, out=new)
            h -= new
            h *= zr[:, :hidden]
            h += new
            p = self.o @ h
            out[t] += p[0]
            out[steps - 1 - t] += p[1]
        out += self.c
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (D, C) over all bytes of each non-empty text."""
        size = np.array([len(t) for t in texts])
        count = -(-size // WINDOW)
        first = np.concatenate([[0], np.cumsum(count)])
        cells = np.zeros((int(first[-1]), WINDOW), np.uint8)
        flat = cells.reshape(-1)
        for t, at in zip(texts, first, strict=False):
            flat[at * WINDOW : at * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        used = np.full(len(cells), WINDOW)
        used[first[1:] - 1] = size - (count - 1) * WINDOW
        sums = np.empty((len(cells), len(self.langs)))
        for lo in range(0, len(cells), LANES):
            part = cells[lo : lo + LANES]
            p = self.label(part)
            ragged = used[lo : lo + LANES]
            if (ragged < WINDOW).any():
                p *= (np.arange(WINDOW)[:, None] < ragged)[:, None, :]
            sums[lo : lo + LANES] = p.sum(axis=0, dtype="f8").T
        return np.add.reduceat(sums, first[:-1], axis=0) / size[:, None]

    def loss_and_gradients(self, windows: np.ndarray, used: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of all bytes and its gradients, by backpropagation through time."""
        n, steps = windows.shape
        hidden = self.u.shape[2]
        k = 2 * hidden
        seq = np.ascontiguousarray(windows.T).astype(np.intp)
        h = np.zeros((2, hidden, n), "f4")
        logits = np.zeros((steps, len(self.langs), n), "f4")
        kept = []
        for t in range(steps):
            g, s, zr = self._gates((seq[t], seq[steps - 1 - t]), h)
            new = np.tanh(g[:, k:] + zr[:, hidden:] * s[:, k:])
            before, h = h, new + zr[:, :hidden] * (h - new)
            kept.append((before, zr, s[:, k:], new, h))
            p = self.o @ h
            logits[t] += p[0]
            logits[steps - 1 - t] += p[1]
        logits += self.c
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        mask = (np.arange(steps)[:, None] < used).astype("f4")
        lanes = np.arange(n)
        total = mask.sum()
        loss = float(-(np.log(p[:, target, lanes] + 1e-9) * mask).sum() / total)
        d = p
        d[:, target, lanes] -= 1
        d *= (mask / total)[:, None, :]
        dx, du, db, do = (np.zeros_like(w) for w in (self.x, self.u, self.b, self.o))
        pre = np.empty((steps, 2, 3 * hidden, n), "f4")
        dh = np.zeros((2, hidden, n), "f4")
        for t in reversed(range(steps)):
            before, zr, sn, new, h = kept[t]
            z, r = zr[:, :hidden], zr[:, hidden:]
            dl = np.stack((d[t], d[steps - 1 - t]))
            do += dl @ h.transpose(0, 2, 1)
            dh = dh + self.o.transpose(0, 2, 1) @ dl
            dn = dh * (1 - z) * (1 - new * new)
            pre[t, :, :hidden] = dh * (before - new) * z * (1 - z)
            pre[t, :, hidden:k] = dn * sn * r * (1 - r)
            pre[t, :, k:] = dn
            ds = pre[t].copy()
            ds[:, k:] *= r
            du += ds @ before.transpose(0, 2, 1)
            db += ds.sum(axis=2, keepdims=True)
            dh = dh * z + self.u.transpose(0, 2, 1) @ ds
        for way, order in ((0, seq), (1, seq[::-1])):
            at = order.reshape(-1)
            for row in range(3 * hidden):
                dx[way, row] = np.bincount(at, weights=pre[:, way, row].reshape(-1), minlength=256)
        return loss, [dx, du, db, do, d.sum(axis=(0, 2))[:, None]]


def train(windows: np.ndarray, used: np.ndarray, target: np.ndarray, langs: list[str], epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = SEED) -> BiGru:
    """Fit a network to windows (N, T) with ``used`` bytes each and class numbers ``target``."""
    rng = np.random.default_rng(seed)
    net = BiGru.fresh(langs, hidden, rng)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    steps = epochs * -(-len(windows) // BATCH)
    n = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            _, grads = net.loss_and_gradients(windows[at], used[at], target[at])
            norm = float(np.sqrt(sum((g.astype("f8") ** 2).sum() for g in grads)))
            n += 1
            rate = 0.01 * (1 - 0.95 * n / steps)
            for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return net


def trigrams(text: bytes) -> np.ndarray:
    """Every three consecutive bytes of a text, letters A-Z lower-cased, as one number each."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else b[:0]


def is_strange(text: bytes, seen: np.ndarray) -> bool:
    """Whether a text is in none of the languages learned, by its byte trigrams that the training windows don't hold.

    They must be more than ``STRANGE_SHARE`` of all, by twice the square root of how many there are: the shorter
    a text, the more it takes, and up to about ten trigrams nothing will do. ``seen`` has a bit per trigram. A
    probability can't tell that, as those of the learned languages add up to 1 for any text.
    """
    t = trigrams(text)
    unseen = int((seen[t >> 3] >> (7 - (t & 7)).astype(np.uint8) & 1 == 0).sum())
    return unseen > STRANGE_SHARE * len(t) + 2 * len(t) ** 0.5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGru | None:
    """Train on ``docs`` outside the held-out third, with text and language given.

    The sample is bounded: about ``DOCS_PER_LANGUAGE`` documents of each language, those with the smallest
    hashes of id and text, and ``WINDOWS_PER_DOC`` windows spread evenly over each whole text. Rows without
    id, text, letters or language are not learned from; without any row left there is no model.
    """
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, DOCS_PER_LANGUAGE / n)).otherwise(share)
    luck = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / float(1 << 30)
    raw = F.col(text_col).cast("binary")
    room = F.greatest(F.octet_length(raw) - WINDOW, F.lit(0))
    starts = F.array_distinct(F.array(*(F.floor(room * i / max(1, WINDOWS_PER_DOC - 1)) for i in range(WINDOWS_PER_DOC))))
    drawn = usable.where(luck < share).select(F.col(lang_col).alias("lang"), F.transform(starts, lambda s: F.substring(raw, (s + 1).cast("int"), F.lit(WINDOW))).alias("w"))
    # repeated rows have one hash, so without distinct() they would all be drawn
    pairs = [(bytes(w), r.lang) for r in drawn.distinct().collect() for w in r.w]
    langs = sorted({lang for _, lang in pairs})
    if not langs:
        return None
    pairs.sort()
    windows = np.zeros((len(pairs), WINDOW), np.uint8)
    for row, (w, _) in zip(windows, pairs, strict=True):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    net = train(windows, np.array([len(w) for w, _ in pairs]), np.array([langs.index(lang) for _, lang in pairs]), langs)
    seen = np.zeros(1 << 24, bool)
    for w, _ in pairs:
        seen[trigrams(w)] = True
    net.seen = np.packbits(seen)
    return net


def predict(docs: DataFrame, net: BiGru | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, the mean probability of that language over all bytes, and ``strange``.

    ``strange`` texts are in no learned language (``is_strange``), though the nearest one is named.

    Only the text is looked at, and the whole of it. Null texts and texts without a letter, and all texts if
    there is no model, get ``und`` and score 0, and aren't strange. Equal texts get equal results; an empty table stays empty.
    """
    schema = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("strange", T.BooleanType(), False)])

    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = list(part)
            lang, score, strange = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for lo in range(0, len(texts), 512):
                known = [i for i in range(lo, min(lo + 512, len(texts))) if net and texts[i] and any(map(str.isalpha, texts[i]))]
                if known:
                    raw = [texts[i].encode("utf-8", "replace") for i in known]
                    p = net.document_probabilities(raw)
                    for i, text in zip(known, raw, strict=True):
                        strange[i] = net.seen is not None and is_strange(text, net.seen)
                    for i, best, value in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                        lang[i], score[i] = net.langs[best], min(1.0, float(value))
            yield pd.DataFrame({"lang_pred": lang, "score": score, "strange": strange})

    # not to be evaluated again in filters on its result
    out = bound_batches(docs).withColumn("_language", run.asNondeterministic()(F.col(text_col)))
    return out.withColumns({name: F.col(f"_language.{name}") for name in schema.names}).drop("_language")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs)
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
