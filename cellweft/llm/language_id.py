"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on windows of labelled texts.  In use
every byte of every text gets label probabilities; a document's are their mean.  A text is cut into windows
of WINDOW bytes and each window is read in both directions from an empty state, so all windows of many texts
are read side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units per direction.
HIDDEN = 8
WINDOW = 64
#: Bound of the labelled sample: texts per label, and windows taken from each.
SAMPLE_TEXTS = 150
SAMPLE_WINDOWS = 6
#: Rows that pass through at once, so that no second copy of a large batch is held.
ROWS_AT_ONCE = 2048
STEPS = 260
BATCH = 256
RATE = 0.02
#: Windows that are read side by side.
WIDE = 4096
UNKNOWN = "und"
#: The byte after the end of a text; it leaves the state at zero.
PAD = 256


class Network:
    """One gated layer per direction and a softmax over both states at each position."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h, self.labels = HIDDEN, labels
        self.p = {"out": rng.normal(0, 0.3, (len(labels), 2 * h)), "bias": np.zeros((len(labels), 1))}
        for d in "fb":
            self.p[f"in_{d}"] = rng.normal(0, 0.5, (3 * h, 257))  # rows: update, reset, state
            self.p[f"re_{d}"] = rng.normal(0, 0.4, (3 * h, h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, data: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (positions, units, windows) of one direction; data holds bytes (positions, windows)."""
        h = HIDDEN
        table, re = self.p[f"in_{d}"].copy(), self.p[f"re_{d}"]
        table[2 * h :, PAD] = 0  # an empty state stays empty on padding
        length, width = data.shape
        out = np.empty((length, h, width), np.float32)
        state = np.zeros((h, width), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            x = table[:, data[t]]
            y = re @ state
            gates = x[: 2 * h]
            gates += y[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:h], gates[h:]
            new = reset * y[2 * h :]
            new += x[2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, state, gates, new, y[2 * h :].copy()))
            state = np.add(new, update * (state - new), out=out[t])
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities (positions, labels, windows)."""
        h, out = HIDDEN, self.p["out"]
        z = np.matmul(out[:, :h], self.states(data, "f"))
        z += np.matmul(out[:, h:], self.states(data, "b"))
        z += self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per position and its gradients; target is the label of each window."""
        h, out = HIDDEN, self.p["out"]
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(data, d, kept[d]) for d in "fb"}
        z = np.matmul(out[:, :h], states["f"]) + np.matmul(out[:, h:], states["b"]) + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        real = (data != PAD)[:, None, :]
        n = max(1, int(real.sum()))
        columns = np.arange(data.shape[1])
        loss = -float((np.log(p[:, target, columns] + 1e-9) * real[:, 0, :]).sum()) / n
        p[:, target, columns] -= 1
        p *= real
        p /= n
        both = np.concatenate([states["f"], states["b"]], axis=1)
        g = {"out": np.einsum("tlw,thw->lh", p, both, optimize=True), "bias": p.sum(axis=(0, 2))[:, None]}
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            re = self.p[f"re_{d}"]
            down = np.matmul(out[:, part].T, p)
            g_in, g_re = np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(re)
            carry = np.zeros((h, data.shape[1]), np.float32)
            for t, before, gates, new, seen in reversed(kept[d]):
                carry = carry + down[t]
                update, reset = gates[:h], gates[h:]
                d_new = carry * (1 - update) * (1 - new * new)
                d_update = carry * (before - new) * update * (1 - update)
                d_reset = d_new * seen * reset * (1 - reset)
                pre = np.concatenate([d_update, d_reset, d_new])
                own = np.concatenate([d_update, d_reset, d_new * reset])
                for unit in range(3 * h):
                    g_in[unit] += np.bincount(data[t], weights=pre[unit], minlength=257)
                g_re += own @ before.T
                carry = carry * update + re.T @ own
            g_in[2 * h :, PAD] = 0
            g[f"in_{d}"], g[f"re_{d}"] = g_in, g_re
        return loss, g


def windows(text: bytes) -> np.ndarray:
    """A text's bytes in rows of WINDOW, the last one padded."""
    rows = -(-len(text) // WINDOW)
    out = np.full(rows * WINDOW, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, WINDOW)


def some_windows(text: str, seed: int) -> np.ndarray:
    """At most SAMPLE_WINDOWS windows from anywhere in a text."""
    own = windows(text.encode("utf-8"))
    return own[np.random.default_rng(seed).permutation(len(own))[:SAMPLE_WINDOWS]]


def train(samples: list[tuple[str, np.ndarray]], seed: int = 7) -> Network:
    """A network from (label, windows) pairs; the same pairs in the same order give the same network."""
    labels = sorted({label for label, _ in samples})
    net, rng = Network(labels, seed), np.random.default_rng(seed)
    if len(labels) < 2:
        return net
    rows = np.concatenate([own for _, own in samples])
    targets = np.concatenate([np.full(len(own), labels.index(label)) for label, own in samples])
    by_label = [np.flatnonzero(targets == k) for k in range(len(labels))]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        share = max(1, BATCH // len(labels))  # every label has the same weight
        chosen = np.concatenate([x[rng.integers(0, len(x), share)] for x in by_label if len(x)])
        _, g = net.gradients(np.ascontiguousarray(rows[chosen].T), targets[chosen])
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, x in g.items():
            x = x * min(1.0, 1.0 / (size + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * x
            square[k] = 0.99 * square[k] + 0.01 * x * x
            net.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _cut(seed: int):
    def run(batches):
        for batch in batches:
            own = [some_windows(t, seed + n).tobytes() for t, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["lang", "nth", "data"])

    return run


def sample(docs: DataFrame, seed: int = 7) -> list[tuple[str, np.ndarray]]:
    """Windows of at most SAMPLE_TEXTS labelled texts per label, those with the smallest seeded hash.

    Only rows with a label whose crc32(doc_id as text) mod 4 is not 2 are learnt from; a null doc_id counts
    as empty.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.filter(~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", F.xxhash64("text"))
    # each task passes SAMPLE_TEXTS rows per label on
    best = known.select("lang", F.row_number().over(order).alias("nth"), "text").filter(F.col("nth") <= SAMPLE_TEXTS)
    rows = best.mapInArrow(_cut(seed), "lang string, nth int, data binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["nth"]))
    return [(r["lang"], np.frombuffer(r["data"], np.int16).reshape(-1, WINDOW)) for r in rows]


def held_out():
    """Whether a document is never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _pooled(texts: list[bytes], net: Network) -> np.ndarray:
    """Mean label probabilities of each text; all positions count alike."""
    sums, sizes = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts))
    rows, owners, n = [], [], 0

    def read():
        data, own = np.concatenate(rows), np.concatenate(owners)
        for at in range(0, len(data), WIDE):
            part = np.ascontiguousarray(data[at : at + WIDE].T)
            p = net.probabilities(part)
            p *= (part != PAD)[:, None, :]
            total = p.sum(axis=0, dtype=np.float64)
            for k in range(len(net.labels)):
                sums[:, k] += np.bincount(own[at : at + WIDE], weights=total[k], minlength=len(texts))
            sizes[:] += np.bincount(own[at : at + WIDE], weights=(part != PAD).sum(axis=0), minlength=len(texts))

    for i, text in enumerate(texts):
        for at in range(0, len(text), WIDE * WINDOW):
            own = windows(text[at : at + WIDE * WINDOW])
            rows.append(own)
            owners.append(np.full(len(own), i))
            n += len(own)
            if n >= WIDE:
                read()
                rows, owners, n = [], [], 0
    if rows:
        read()
    return sums / np.maximum(sizes, 1)[:, None]


def _predicted(texts: pa.Array, ok: pa.Array, net: Network) -> tuple[list[str], np.ndarray]:
    """Label and score of each text; what is not ok is unknown."""
    known = [t.encode("utf-8") if o else b"" for t, o in zip(texts.to_pylist(), ok.to_pylist(), strict=True)]
    p = _pooled(known, net)
    best = p.argmax(axis=1)
    # a mean of float32 values can end a hair above one
    label = [net.labels[k] if t else UNKNOWN for k, t in zip(best.tolist(), known, strict=True)]
    return label, np.where([bool(t) for t in known], np.minimum(p[np.arange(len(best)), best], 1.0), 0.0)


def _labels(net: Network):
    def run(batches):
        for batch in batches:
            label, score = _predicted(batch.column(1), batch.column(2), net)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(label), pa.array(score, pa.float64())], ["doc_id", "own", "lang_pred", "score"])

    return run


def _learnt(docs: DataFrame) -> Network | None:
    learnt = sample(docs)
    return train(learnt) if learnt else None


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, own (checksum of the text), lang_pred and score of each document.

    A null text, or one without a letter, is 'und' with score 0.  Without labelled rows every text is 'und';
    with one label it is that label; of equally likely labels the first by name counts.  Repeated rows get the same answer
    each; long texts are read whole, window by window; an empty table gives no rows.  Text is the only input of a
    prediction, and no other column than text, lang and doc_id is read.
    """
    schema = "doc_id long, own long, lang_pred string, score double"
    net = net or _learnt(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("ok"), F.xxhash64("text").alias("own"))
    if net is None:
        return rows.select("doc_id", "own", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_labels(net), schema)


def keep_known(docs: DataFrame, least: float) -> DataFrame:
    """The documents, with all their columns, whose language is known with a score of least or more; cases as in identify.

    Rows pass through as they are, so nothing is joined.
    """
    net = _learnt(docs)
    if net is None:
        return docs.filter("false")
    ok = F.coalesce("text", F.lit("")).rlike(r"\p{L}").alias("ok")
    asked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ok)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                label, score = _predicted(part.column(0).field(place), part.column(1), net)
                good = (np.array(label, object) != UNKNOWN) & (score >= least)
                yield pa.RecordBatch.from_arrays([part.column(0)], ["row"]).filter(pa.array(good, pa.bool_()))

    return asked.mapInArrow(run, asked.select("row").schema).select("row.*")


