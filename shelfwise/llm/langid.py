"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every byte position with a
distribution over the learned languages, and a document's distribution is pooled from its
positions. It is trained here in numpy by backpropagation through time on a bounded
sample of labelled rows (``TRAIN_DOCS`` by share, at least ``LANGUAGE_DOCS`` of each language or all it has) and applied to every byte of every text.
The ``LEARNED_LANGUAGES`` languages with most labelled rows are learned (ties: the one that sorts first), so the sample is
bounded however many distinct tags, noisy ones included, a table holds.

Texts are cut into windows of ``WINDOW`` bytes (state starts anew in each), so many windows run
side by side as matrices and a very long text needs no more memory than a short one. Bytes that
belong to no letter are read but take no part in the pooling.

Learning uses only the text and the language of labelled rows; predictions use only the
text. Defined cases: a null text, or one without any letter, is ``und`` with score 0;
repeated rows are rows of their own; ties go to the language that sorts first; a table
without a usable label teaches nothing, so every text is ``und``; further columns are not
read by ``predict``; an empty table gives no rows. The model is a few kilobytes whatever
the table's size and travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import HASH_BUCKETS, fold, sliced

UNKNOWN = "und"
HELD_OUT_MOD, HELD_OUT_FOLD = 4, 2
TRAIN_DOCS = 2000
LANGUAGE_DOCS = 100
LEARNED_LANGUAGES = 256
TRAIN_WINDOWS_PER_DOC = 6
HIDDEN = 8
WINDOW = 64
STEPS = 160
BATCH = 256
RATE = 0.02
SEED = 20
REJECT_BELOW = 0.3
PAD = 0
#: windows that run side by side
LANES = 2048


class ByteGRU:
    """Weights of both directions and of the output layer. Gate order: reset, update, candidate.

    Gates are hard sigmoids (the sum clipped to 0..1, half open at the start) and the candidate is
    a softsign, x / (1 + |x|): the same roles as sigmoid and tanh at a fraction of the time per byte.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.params = {
            "gates_in": draw(2, 256, 2 * hidden, scale=0.1) + np.float32(0.5), "cand_in": draw(2, 256, hidden, scale=0.5),
            "gates_h": draw(2, hidden, 2 * hidden, scale=0.3 * hidden ** -0.5), "cand_h": draw(2, hidden, hidden, scale=hidden ** -0.5),
            "out": draw(2 * hidden, len(languages), scale=0.3), "bias": np.zeros(len(languages), np.float32),
        }

    def states(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, direction, lane, hidden) over byte windows ``x`` (lane, time), and what training needs again."""
        p, hidden = self.params, self.hidden
        lanes, time = x.shape
        both = np.stack([x.T, x.T[::-1]], axis=1)  # time, direction, lane
        h = np.zeros((2, lanes, hidden), np.float32)
        out, kept = np.empty((time, 2, lanes, hidden), np.float32), []
        for t in range(time):
            gates = np.stack([p["gates_in"][0][both[t, 0]], p["gates_in"][1][both[t, 1]]]) + h @ p["gates_h"]
            gates = np.clip(gates, 0, 1)
            r, z = gates[..., :hidden], gates[..., hidden:]
            inner = h @ p["cand_h"]
            c = np.stack([p["cand_in"][0][both[t, 0]], p["cand_in"][1][both[t, 1]]]) + r * inner
            c = c / (1 + np.abs(c))
            new = h + z * (c - h)
            kept.append((h, r, z, c, inner))
            out[t] = h = new
        return out, kept

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the labelled positions of windows ``x`` with languages ``y``, and its gradients."""
        p, hidden = self.params, self.hidden
        lanes, time = x.shape
        h, kept = self.states(x)
        features = np.concatenate([h[:, 0], h[::-1, 1]], axis=-1)  # time, lane, 2 x hidden
        logits = features @ p["out"] + p["bias"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        mask = (x.T != PAD)[..., None].astype(np.float32)
        count = max(1.0, float(mask.sum()))
        rows = np.arange(lanes)
        loss = -float((np.log(prob[:, rows, y] + 1e-9) * mask[..., 0]).sum()) / count
        d = prob.copy()
        d[:, rows, y] -= 1
        d *= mask / count
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = np.einsum("tlf,tlo->fo", features, d, optimize=True).astype(np.float32)
        g["bias"] = d.sum((0, 1))
        df = d @ p["out"].T
        dh_out = np.stack([df[..., :hidden], df[::-1, :, hidden:]], axis=1)
        both = np.stack([x.T, x.T[::-1]], axis=1)
        dgates_all = np.empty((time, 2, lanes, 2 * hidden), np.float32)
        dcand_all = np.empty((time, 2, lanes, hidden), np.float32)
        dh = np.zeros((2, lanes, hidden), np.float32)
        for t in range(time - 1, -1, -1):
            h0, r, z, c, inner = kept[t]
            dh = dh + dh_out[t]
            dc = dh * z * np.square(1 - np.abs(c))
            dz = dh * (c - h0) * ((z > 0) & (z < 1))
            dinner = dc * r
            dr = dc * inner * ((r > 0) & (r < 1))
            dgates = np.concatenate([dr, dz], axis=-1)
            g["gates_h"] += h0.transpose(0, 2, 1) @ dgates
            g["cand_h"] += h0.transpose(0, 2, 1) @ dinner
            dh = dh * (1 - z) + dgates @ p["gates_h"].transpose(0, 2, 1) + dinner @ p["cand_h"].transpose(0, 2, 1)
            dgates_all[t], dcand_all[t] = dgates, dc
        for k in range(2):
            hot = both[:, k].ravel()
            order = np.argsort(hot, kind="stable")
            used, first = np.unique(hot[order], return_index=True)
            g["gates_in"][k][used] = np.add.reduceat(dgates_all[:, k].reshape(-1, 2 * hidden)[order], first)
            g["cand_in"][k][used] = np.add.reduceat(dcand_all[:, k].reshape(-1, hidden)[order], first)
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over random batches; languages are drawn evenly. Returns the losses."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        of = [rows for rows in of if rows.size]
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses = []
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(r, max(1, batch // len(of))) for r in of])
            loss, g = self.loss_and_gradients(x[rows], y[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            shrink = min(1.0, 1.0 / (norm + 1e-12))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v * shrink
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                self.params[k] -= now * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
        return losses

    def position_log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (time, lane, language) of every byte of windows ``x``; buffers are reused over time."""
        p, hidden = self.params, self.hidden
        lanes, time = x.shape
        states = np.empty((2, time, lanes, hidden), np.float32)
        r, z, c, inner = (np.empty((lanes, hidden), np.float32) for _ in range(4))
        steps = np.ascontiguousarray(x.T)
        for k in range(2):
            r_in, z_in, c_in = (np.ascontiguousarray(w) for w in (p["gates_in"][k][:, :hidden], p["gates_in"][k][:, hidden:], p["cand_in"][k]))
            r_h, z_h, c_h = (np.ascontiguousarray(w) for w in (p["gates_h"][k][:, :hidden], p["gates_h"][k][:, hidden:], p["cand_h"][k]))
            h = np.zeros((lanes, hidden), np.float32)
            for t in (range(time) if k == 0 else range(time - 1, -1, -1)):
                seen = steps[t]
                for gate, w_in, w_h in ((r, r_in, r_h), (z, z_in, z_h)):
                    np.matmul(h, w_h, out=gate)
                    gate += w_in[seen]
                    np.clip(gate, 0, 1, out=gate)
                np.matmul(h, c_h, out=inner)
                inner *= r
                inner += c_in[seen]
                np.abs(inner, out=c)
                c += 1
                np.divide(inner, c, out=c)
                c -= h
                c *= z
                h = np.add(h, c, out=states[k, t])
        logits = states[0] @ p["out"][:hidden] + states[1] @ p["out"][hidden:] + p["bias"]
        logits -= logits.max(-1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(-1, keepdims=True))
        return logits


def letter_positions(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to letters: ASCII letters and bytes of longer UTF-8 sequences."""
    lower = data | 32
    return ((lower >= 97) & (lower <= 122)) | (data >= 128)


def windows_of(data: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Cut bytes into rows of ``width``; the last row is padded."""
    lanes = -(-len(data) // width)
    out = np.full(lanes * width, PAD, np.uint8)
    out[:len(data)] = data
    return out.reshape(lanes, width)


def predict_texts(model: ByteGRU, texts: list[str | None], window: int = WINDOW, lanes: int = LANES) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: pooled log probabilities decide, the score is the mean probability of that language."""
    n_lang = len(model.languages)
    log_sum, prob_sum, letters = np.zeros((len(texts), n_lang)), np.zeros((len(texts), n_lang)), np.zeros(len(texts))
    waiting: list[tuple[int, np.ndarray]] = []

    def run() -> None:
        x = np.concatenate([w for _, w in waiting])
        owner = np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
        log_p = model.position_log_probs(x)
        counted = letter_positions(x).T.astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        who = owner[first]
        log_sum[who] += np.add.reduceat(np.einsum("tlo,tl->lo", log_p, counted), first)
        prob_sum[who] += np.add.reduceat(np.einsum("tlo,tl->lo", np.exp(log_p), counted), first)
        letters[who] += np.add.reduceat(counted.sum(0), first)
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        if not text or not n_lang or not any(map(str.isalpha, text)):
            continue
        rows = windows_of(np.frombuffer(text.encode(), np.uint8), window)
        for at in range(0, len(rows), lanes):
            part = rows[at:at + lanes]
            if held + len(part) > lanes and waiting:
                run()
                held = 0
            waiting.append((i, part))
            held += len(part)
    if waiting:
        run()
    best = np.argmax(log_sum, axis=1) if n_lang else np.zeros(len(texts), int)
    known = letters > 0
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    score = np.where(known, prob_sum[np.arange(len(texts)), best] / np.maximum(letters, 1), 0.0) if n_lang else np.zeros(len(texts))
    return names, np.clip(score, 0, 1).tolist()


def held_out(column: str = "doc_id") -> Column:
    """Whether a row's language must not be learned from (a null id: not held out)."""
    return F.coalesce(fold(column, HELD_OUT_MOD) == HELD_OUT_FOLD, F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED,
        learned_languages: int = LEARNED_LANGUAGES) -> ByteGRU:
    """Train on about ``train_docs`` labelled rows that are not held out, and about ``LANGUAGE_DOCS`` of each rarer language;
    windows are drawn from the whole text of each. Only the ``learned_languages`` languages with most rows are learned."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("id"), "lang", F.col("text").cast("binary").alias("text"))
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(learned_languages)
    counts = {r["lang"]: r["rows"] for r in most.collect()}
    if not counts:
        return ByteGRU([], hidden, seed)
    share = train_docs / sum(counts.values())
    keep = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(HASH_BUCKETS * min(1.0, max(share, LANGUAGE_DOCS / n))))])
    picked = labelled.where(F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(HASH_BUCKETS)) < F.try_element_at(keep, F.col("lang")))
    size = F.octet_length("text")
    # a window at each of some random starts: what reaches the driver is bounded per document
    starts = F.transform(F.sequence(F.lit(1), F.lit(TRAIN_WINDOWS_PER_DOC)), lambda i: F.pmod(F.xxhash64("id", i), F.greatest(size - WINDOW // 2, F.lit(1))))
    sample = (picked
              .select("id", "lang", F.explode(starts).alias("start"), "text")
              .select("lang", "id", "start", F.substring("text", (F.col("start") + 1).cast("int"), F.lit(WINDOW)).alias("bytes")))
    rows = sorted(map(tuple, sample.collect()))
    languages = sorted({r[0] for r in rows})
    model = ByteGRU(languages, hidden, seed)
    x = np.full((len(rows), WINDOW), PAD, np.uint8)
    for i, r in enumerate(rows):
        x[i, :len(r[3])] = np.frombuffer(r[3], np.uint8)
    y = np.array([languages.index(r[0]) for r in rows], np.int64)
    if languages:
        model.train(x, y, steps=steps, seed=seed)
    return model


PREDICT_SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: ByteGRU) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred (``und`` without a letter) and score (0 to 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            names, scores = predict_texts(model, part.column(2).to_pylist())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                  names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, PREDICT_SCHEMA)


def keep_identified(docs: DataFrame, model: ByteGRU, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language is known and scored at least ``reject_below``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            names, scores = predict_texts(model, part.column(at).to_pylist())
            yield part.filter(pa.array([n != UNKNOWN and s >= reject_below for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
