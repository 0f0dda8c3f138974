"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of a text gets a label distribution from two recurrent passes, one from
the left and one from the right; the mean over a text's bytes is its distribution.
Texts are read in windows of ``WINDOW`` bytes that start with an empty state, so all
windows of many texts advance together.  The texts of one batch and their window positions are
held in memory, so a worker needs a few times the longest text.

The network is trained in numpy by backpropagation through time, on the driver, from
``WINDOWS_A_DOC`` windows of about ``TRAIN_DOCS`` documents of each language (a hash
sample, at most twice that); only the windows reach the driver.

Defined results: null texts and texts without a letter are ``und`` with score 0; with
no learnable row every text is ``und``; ties go to the alphabetically first language;
repeated rows and null ids keep their rows (a null id is neither held out nor learned from);
extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

HIDDEN = 8
WINDOW = 128
#: Windows that advance together (their states fit the processor's cache).
LANES = 2048
TRAIN_DOCS = 250
WINDOWS_A_DOC = 4
TRAIN_BYTES = 64
STEPS = 160
PAD = 256


class Network:
    """One recurrent layer each way and a linear output at every position.

    Parameters of a direction: E (3H x 257: gate inputs of each byte, the gates being
    update, reset, candidate) and U (3H x H).  The column of ``PAD`` is fixed: it
    opens the update gate, so padding leaves the state as it is."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p["E" + way] = r.normal(0, 0.3, (3 * hidden, 257))
            self.p["U" + way] = r.normal(0, 0.3, (3 * hidden, hidden))
            self.p["W" + way] = r.normal(0, 0.3, (languages, hidden))
        self.p["c"] = np.zeros((languages, 1))
        self.fix()

    def fix(self) -> None:
        for way in "fb":
            self.p["E" + way][:, PAD] = 0
            self.p["E" + way][:self.hidden, PAD] = 40

    # --- training ------------------------------------------------------
    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of x (time x lanes, PAD behind the
        ends) with the language y of each lane, and its gradients."""
        h, (steps, lanes) = self.hidden, x.shape
        sig = lambda v: 0.5 + 0.5 * np.tanh(0.5 * v)
        kept = {}
        for way in "fb":
            e, u = self.p["E" + way], self.p["U" + way]
            state, states, parts = np.zeros((h, lanes)), np.zeros((steps, h, lanes)), {}
            for t in (range(steps) if way == "f" else range(steps - 1, -1, -1)):
                a, g = e[:, x[t]], u @ state
                z, r = sig(a[:h] + g[:h]), sig(a[h:2 * h] + g[h:2 * h])
                n = np.tanh(a[2 * h:] + r * g[2 * h:])
                parts[t] = (state, z, r, n, g[2 * h:])
                state = n + z * (state - n)
                states[t] = state
            kept[way] = (states, parts)
        logits = self.p["c"] + self.p["Wf"] @ kept["f"][0] + self.p["Wb"] @ kept["b"][0]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        live = (x != PAD)
        total = live.sum()
        lane = np.arange(lanes)
        value = -(np.log(prob[:, y, lane] + 1e-12) * live).sum() / total
        prob[:, y, lane] -= 1
        d = prob * live[:, None] / total                                  # time, language, lane
        grads = {"c": d.sum((0, 2))[:, None]}
        for way in "fb":
            states, parts = kept[way]
            u = self.p["U" + way]
            grads["W" + way] = np.einsum("tkl,thl->kh", d, states)
            back = np.einsum("kh,tkl->thl", self.p["W" + way], d)
            du, da, carry = np.zeros_like(u), np.zeros((steps, 3 * h, lanes)), np.zeros((h, lanes))
            for t in (range(steps - 1, -1, -1) if way == "f" else range(steps)):
                state, z, r, n, gn = parts[t]
                up = back[t] + carry
                dn = up * (1 - z) * (1 - n * n)
                dz, dr = up * (state - n) * z * (1 - z), dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r])
                da[t] = np.concatenate([dz, dr, dn])
                du += dg @ state.T
                carry = up * z + u.T @ dg
            grads["U" + way] = du
            flat, ids = da.transpose(1, 0, 2).reshape(3 * h, -1), x.ravel()
            grads["E" + way] = np.stack([np.bincount(ids, row, 257) for row in flat])
            grads["E" + way][:, PAD] = 0
        return float(value), grads

    def train(self, windows: list[bytes], y: np.ndarray, steps: int = STEPS, lanes: int = 256, rate: float = 0.03, seed: int = 11) -> None:
        """Adam over random batches that draw every language alike."""
        r = np.random.default_rng(seed)
        longest = max(map(len, windows))
        x = np.full((len(windows), longest), PAD)
        for i, w in enumerate(windows):
            x[i, :len(w)] = np.frombuffer(w, np.uint8)
        groups = [np.flatnonzero(y == k) for k in np.unique(y)]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in (0, 1))
        for step in range(1, steps + 1):
            rows = np.concatenate([r.choice(g, max(1, lanes // len(groups))) for g in groups])
            _, grads = self.loss(x[rows].T, y[rows])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
            self.fix()

    # --- labelling -----------------------------------------------------
    def frozen(self) -> dict[str, np.ndarray]:
        """Weights for ``label``: the gates' halves of the logistic are folded in."""
        h, out = self.hidden, {}
        for k, v in self.p.items():
            v = v.astype(np.float32)
            if k[0] in "EU":
                v[:2 * h] *= 0.5
            out[k] = np.ascontiguousarray(v)
        return out


def label(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities (time x language x lane) of every byte of x (time x lanes)."""
    (steps, lanes), h = x.shape, w["Uf"].shape[1]
    out = np.empty((steps, len(w["c"]), lanes), np.float32)
    a, g = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
    gates, n, part = a[:2 * h], np.empty((h, lanes), np.float32), np.empty(out.shape[1:], np.float32)
    for way in "fb":
        e, u, v = w["E" + way], w["U" + way], w["W" + way]
        state = np.zeros((h, lanes), np.float32)
        for t in (range(steps) if way == "f" else range(steps - 1, -1, -1)):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=g)
            gates += g[:2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(a[h:2 * h], g[2 * h:], out=n)
            n += a[2 * h:]
            np.tanh(n, out=n)
            state -= n
            state *= a[:h]
            state += n
            if way == "f":
                np.matmul(v, state, out=out[t])
            else:
                np.matmul(v, state, out=part)
                out[t] += part
    out += w["c"].astype(np.float32)
    out -= out.max(1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(1, keepdims=True)
    return out


def pooled(w: dict[str, np.ndarray], texts: list[bytes], window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
    """Mean probabilities (texts x languages) over the bytes of each text."""
    total = np.zeros((len(texts), len(w["c"])))
    counts = [-(-len(t) // window) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(owner):
        return total
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    start, length = begin[owner] + nth * window, np.minimum(window, size[owner] - nth * window)
    for i in range(0, len(owner), lanes):
        s, n, o = start[i:i + lanes], length[i:i + lanes], owner[i:i + lanes]
        at = np.arange(n.max())[:, None]
        live = at < n
        x = np.where(live, flat[np.minimum(s + at, len(flat) - 1)].astype(np.int64), PAD)
        sums = np.einsum("tkl,tl->lk", label(w, x), live.astype(np.float32))
        np.add.at(total, o, sums)
    return total / np.maximum(1, size)[:, None]


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_language(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                 train_docs: int = TRAIN_DOCS, steps: int = STEPS):
    """(languages, weights) learned from the rows where ``learn`` holds."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], {}
    cells = 1_000_000
    share = F.lit(0)
    for k in languages:
        share = F.when(F.col("lang") == k, min(cells, max(1, round(cells * train_docs / counts[k])))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(cells)) < share).limit(2 * train_docs * len(languages))
    place = lambda i: F.pmod(F.xxhash64("key", F.lit(i)), F.length("text")).cast("int") + 1
    windows = F.array(*[F.substring(F.col("text"), place(i), F.lit(TRAIN_BYTES)) for i in range(WINDOWS_A_DOC)])
    got = sorted((w.encode()[:TRAIN_BYTES], r.lang) for r in picked.select("lang", windows.alias("w")).collect() for w in r.w)
    got = [g for g in got if g[0]]
    net = Network(len(languages))
    net.train([g[0] for g in got], np.array([languages.index(g[1]) for g in got]), steps)
    return languages, net.frozen()


def identify(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score), one row per row."""
    languages, weights = model
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            while a < len(batch):
                # as many rows as hold about a million bytes
                b, held, texts = a, 0, []
                while b < len(batch) and (held < 1_000_000 or b == a):
                    t = batch.column("text")[b].as_py()
                    t = t if languages and t and any(map(str.isalpha, t)) else None
                    texts.append(None if t is None else t.encode())
                    held += len(texts[-1] or b"")
                    b += 1
                some = [i for i, t in enumerate(texts) if t is not None]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if some:
                    p = pooled(weights, [texts[i] for i in some])
                    for i, k, s in zip(some, p.argmax(1), p.max(1)):
                        lang[i], score[i] = languages[k], min(1.0, max(0.0, float(s)))
                yield pa.record_batch([batch.column("key").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])
                a = b

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)
