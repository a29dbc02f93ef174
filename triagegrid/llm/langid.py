"""Language ID: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

A text is cut into windows of ``WINDOW`` bytes.  Two gated recurrent cells read every window, one from each end; at each byte their states
together give a probability for every language, and a text's probabilities are the means over all its bytes.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid.llm import textbytes as tb
from triagegrid.llm.tables import free_name

WINDOW = 64
HIDDEN = 8
#: The training sample's bounds: documents of each language, and windows of each document.
DOCUMENTS, WINDOWS = 400, 4
STEPS, BATCH, RATE = 400, 256, 0.02
#: Windows that are read side by side.
LANES = 4096
UNDETERMINED = "und"


@dataclass
class Network:
    """Weights of both cells: ``table`` (2, 256, 3H) for the byte read, ``carry`` (2, H, 3H) for the state, ``out`` (2, H, K), ``bias`` (K)."""

    languages: list[str]
    table: np.ndarray
    carry: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        k = len(languages)
        return Network(languages, draw(2, 256, 3 * hidden, by=0.3), draw(2, hidden, 3 * hidden, by=hidden**-0.5), draw(2, hidden, k, by=0.3), np.zeros(k, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.carry, self.out, self.bias]

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients over windows ``data`` (T, B) of bytes, read up to ``mask``, each with one label."""
        steps, n = data.shape
        hidden = self.carry.shape[1]
        read = np.stack([data, data[::-1]])
        state = np.zeros((steps + 1, 2, n, hidden), np.float32)
        gates = np.empty((steps, 2, n, 3 * hidden), np.float32)
        held = np.empty((steps, 2, n, hidden), np.float32)
        both = np.arange(2)[:, None]
        for t in range(steps):
            given = self.table[both, read[:, t]]
            own = state[t] @ self.carry
            zr = 1 / (1 + np.exp(-(given[..., : 2 * hidden] + own[..., : 2 * hidden])))
            held[t] = own[..., 2 * hidden :]
            new = np.tanh(given[..., 2 * hidden :] + zr[..., hidden:] * held[t])
            gates[t, ..., : 2 * hidden], gates[t, ..., 2 * hidden :] = zr, new
            state[t + 1] = new + zr[..., :hidden] * (state[t] - new)
        ahead, back = state[1:, 0], state[1:, 1][::-1]
        logits = ahead @ self.out[0] + back @ self.out[1] + self.bias
        logits -= logits.max(axis=-1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=-1, keepdims=True)
        weight = mask / mask.sum()
        own = np.take_along_axis(chance, np.broadcast_to(label[None, :, None], (steps, n, 1)), axis=-1)[..., 0]
        loss = float(-(np.log(own + 1e-9) * weight).sum())
        wrong = chance * weight[..., None]
        np.put_along_axis(wrong, np.broadcast_to(label[None, :, None], (steps, n, 1)), np.take_along_axis(wrong, np.broadcast_to(label[None, :, None], (steps, n, 1)), -1) - weight[..., None], -1)
        d_out = np.stack([np.einsum("tnh,tnk->hk", ahead, wrong), np.einsum("tnh,tnk->hk", back, wrong)])
        d_state_out = np.stack([wrong @ self.out[0].T, (wrong @ self.out[1].T)[::-1]], axis=1)
        d_table, d_carry = np.zeros_like(self.table), np.zeros_like(self.carry)
        flow = np.zeros((2, n, hidden), np.float32)
        turned = self.carry.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            flow = flow + d_state_out[t]
            z, r, new = gates[t, ..., :hidden], gates[t, ..., hidden : 2 * hidden], gates[t, ..., 2 * hidden :]
            d_new = flow * (1 - z) * (1 - new * new)
            d_z = flow * (state[t] - new) * z * (1 - z)
            d_r = d_new * held[t] * r * (1 - r)
            d_given = np.concatenate([d_z, d_r, d_new], axis=-1)
            d_own = np.concatenate([d_z, d_r, d_new * r], axis=-1)
            d_carry += state[t].transpose(0, 2, 1) @ d_own
            flow = flow * z + d_own @ turned
            for side in (0, 1):
                np.add.at(d_table[side], read[side, t], d_given[side])
        return loss, [d_table, d_carry, d_out, wrong.sum(axis=(0, 1))]

    def train(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> None:
        """Adam over random batches; ``windows`` (N, T) bytes, of which the first ``lengths`` count."""
        rng = np.random.default_rng(seed)
        first, second = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            mask = (np.arange(windows.shape[1])[:, None] < lengths[pick][None]).astype(np.float32)
            _, found = self.gradients(windows[pick].T, mask, labels[pick])
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in found)))
            now = rate * (1 - step / (steps + 1))
            for w, g, m, v in zip(self.weights(), found, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def byte_sums(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each window the sum over its bytes of every language's probability; at most ``LANES`` windows at once."""
        n, steps = windows.shape
        hidden, k = self.carry.shape[1], len(self.languages)
        logits = np.zeros((steps, k, n), np.float32)
        # tanh gives the gates too: sigmoid(x) = (1 + tanh(x / 2)) / 2.
        half = np.ones(3 * hidden, np.float32)
        half[: 2 * hidden] = 0.5
        columns = np.ascontiguousarray(windows.T)
        for side in (0, 1):
            table = np.ascontiguousarray((self.table[side] * half).T)
            carry = np.ascontiguousarray((self.carry[side] * half).T)
            out = np.ascontiguousarray(self.out[side].T)
            state = np.zeros((hidden, n), np.float32)
            given, own = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                np.take(table, columns[t], axis=1, out=given, mode="clip")
                np.matmul(carry, state, out=own)
                gates = given[: 2 * hidden]
                gates += own[: 2 * hidden]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new = given[2 * hidden :]
                own[2 * hidden :] *= gates[hidden:]
                new += own[2 * hidden :]
                np.tanh(new, out=new)
                state -= new
                state *= gates[:hidden]
                state += new
                logits[t] += out @ state
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits *= (np.arange(steps)[:, None] < lengths[None])[:, None, :]
        return logits.sum(axis=0).T.astype(np.float64)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, lengths, row): every text in stretches of ``WINDOW`` bytes, the last one padded with zeros."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    begin = offsets[row] + place * WINDOW
    lengths = np.minimum(WINDOW, offsets[row + 1] - begin)
    at = begin[:, None] + np.arange(WINDOW)[None]
    inside = np.arange(WINDOW)[None] < lengths[:, None]
    windows = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    return windows, lengths, row


def fit_language(docs: DataFrame, documents: int = DOCUMENTS, windows: int = WINDOWS) -> Network | None:
    """Train on a sample of ``docs`` (doc_id, text, lang): about ``documents`` of each language, ``windows`` stretches of each.

    One row for each language reaches the driver, and the sample.  Rows without lang or without a letter do not count; None if none is left.
    """
    docs = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    chance = F.create_map(*[F.lit(x) for lang in languages for x in (lang, documents / counts[lang])])
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)

    def sample(batches):
        for batch in tb.slices(batches, "text"):
            data, offsets = tb.column_bytes(batch.column("text"))
            found, lengths, row = cut_windows(data, offsets)
            at = tb.runs(row, batch.num_rows)
            pick = [i for a, b in zip(at[:-1], at[1:]) for i in np.unique(np.linspace(a, b - 1, windows).astype(int))]
            take = pa.array(row[pick])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(take), pa.array([found[i].tobytes() for i in pick], pa.binary()), pa.array(lengths[pick])], ["lang", "window", "length"])

    rows = docs.where(spot < chance[F.col("lang")]).select("text", "lang").mapInArrow(sample, "lang string, window binary, length long")
    # The bound holds for repeated rows too, whose hashes are equal; which rows it leaves out depends on their bytes only.
    rows = rows.orderBy(F.xxhash64("window", "lang"), "window", "lang").limit(2 * documents * windows * len(languages)).toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("window", "ascending")])
    labels = np.searchsorted(languages, np.array(rows.column("lang").to_pylist()))
    held = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    network = Network.fresh(languages)
    # Every language weighs the same, whatever its sample's size.
    rng = np.random.default_rng(3)
    most = np.bincount(labels, minlength=len(languages)).max()
    even = np.concatenate([rng.permutation(np.resize(np.flatnonzero(labels == k), most)) for k in range(len(languages)) if (labels == k).any()])
    network.train(held[even], rows.column("length").to_numpy()[even], labels[even])
    return network


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def with_language(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score, the mean probability of that language over all bytes of the text.

    A null text or one without a letter is ``und`` with score 0, as are all texts without a network.  Equal probabilities go to
    the first language in order.  Columns of these names are replaced, others stay.  No rows: no rows.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    mark = free_name(names, "__letter")
    schema = docs.select(names).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def label(batches):
        for batch in tb.slices(batches, "text"):
            named, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if network:
                data, offsets = tb.column_bytes(batch.column(batch.schema.get_field_index("text")))
                windows, lengths, row = cut_windows(data, offsets)
                total = np.zeros((batch.num_rows, len(network.languages)))
                for i in range(0, len(windows), LANES):
                    np.add.at(total, row[i : i + LANES], network.byte_sums(windows[i : i + LANES], lengths[i : i + LANES]))
                best = total.argmax(axis=1)
                for i, letter in enumerate(batch.column(batch.schema.get_field_index(mark)).to_pylist()):
                    if letter:
                        named[i], score[i] = network.languages[best[i]], min(1.0, total[i, best[i]] / total[i].sum())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(named), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.select(*names, has_letter(F.col("text")).alias(mark)).mapInArrow(label, fields + ", lang_pred string, score double")
