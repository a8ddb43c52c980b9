"""A bidirectional gated recurrent network over bytes, in numpy, with its training by backpropagation through time.

Both directions run side by side in arrays with a leading axis of two, so that a step over a byte costs
one set of calls for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_F = np.float32
_ROW = np.array([[0], [256]])
#: Bytes over which states are held at once when labelling.
BLOCK = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def _both(codes: np.ndarray) -> np.ndarray:
    """(T, 2, B) rows of the input table for bytes (T, B) and for the same read from the end."""
    return np.stack([codes, codes[::-1]], 1).astype(np.int64) + _ROW


@dataclass
class ByteLabeller:
    """Labels each byte of a text; ``labels`` names the classes.

    Weights of the two directions: input table (512, 3H), recurrent matrices (2, H, 3H) with their
    biases (2, 1, 3H), output matrices (2, H, L); and the biases of the labels (L).
    """

    labels: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    prior: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, rng: np.random.Generator) -> ByteLabeller:
        turns = [np.linalg.qr(rng.standard_normal((hidden, hidden)))[0] for _ in range(2)]
        return cls(
            labels,
            (rng.standard_normal((512, 3 * hidden)) * 0.3).astype(_F),
            np.stack([np.concatenate([q, q.T, q @ q], axis=1) for q in turns]).astype(_F),
            np.tile(np.concatenate([np.full(hidden, 1.0), np.zeros(2 * hidden)]), (2, 1, 1)).astype(_F),
            (rng.standard_normal((2, hidden, len(labels))) * 0.1).astype(_F),
            np.zeros(len(labels), _F),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.bias, self.output, self.prior]

    def _run(self, rows: np.ndarray, state: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States (T, 2, B, H) for table rows (T, 2, B), going on from ``state`` (2, B, H); ``keep`` gets what the way back needs."""
        steps, h = rows.shape[0], self.recurrent.shape[1]
        states = np.empty((steps, *state.shape), _F)
        inputs, recurrent, bias = self.inputs, self.recurrent, self.bias
        for t in range(steps):
            a = inputs[rows[t]]
            g = np.matmul(state, recurrent)
            g += bias
            zr = _sigmoid(a[..., : 2 * h] + g[..., : 2 * h])
            z, r, gn = zr[..., :h], zr[..., h:], g[..., 2 * h :]
            n = r * gn
            n += a[..., 2 * h :]
            np.tanh(n, out=n)
            fresh = states[t]
            np.subtract(state, n, out=fresh)
            fresh *= z
            fresh += n
            state = fresh
            if keep is not None:
                keep["zr"][t], keep["n"][t], keep["g"][t] = zr, n, gn
        return states

    def step(self, codes: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of a batch (T, B) and the gradients of all arrays."""
        steps, batch = codes.shape
        h = self.recurrent.shape[1]
        rows = _both(codes)
        keep = {"zr": np.empty((steps, 2, batch, 2 * h), _F), "n": np.empty((steps, 2, batch, h), _F), "g": np.empty((steps, 2, batch, h), _F)}
        states = self._run(rows, np.zeros((2, batch, h), _F), keep)
        logits = states[:, 0] @ self.output[0] + states[::-1, 1] @ self.output[1] + self.prior
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        hit = np.take_along_axis(p, targets[:, :, None], 2)
        loss = float(-np.log(np.maximum(hit, 1e-9)).mean())
        np.put_along_axis(p, targets[:, :, None], hit - 1, 2)
        d = (p / codes.size).astype(_F)
        both = np.stack([d, d[::-1]], 1)
        d_states = np.matmul(both, self.output.transpose(0, 2, 1))
        d_a, d_gn = np.empty((steps, 2, batch, 3 * h), _F), np.empty((steps, 2, batch, h), _F)
        carried = np.zeros((2, batch, h), _F)
        before = np.concatenate([np.zeros((1, 2, batch, h), _F), states[:-1]])
        turned = np.ascontiguousarray(self.recurrent.transpose(0, 2, 1))
        d_g = np.empty((2, batch, 3 * h), _F)
        for t in range(steps - 1, -1, -1):
            carried += d_states[t]
            z, r, n = keep["zr"][t, ..., :h], keep["zr"][t, ..., h:], keep["n"][t]
            dn = carried * (1 - z)
            dn *= 1 - n * n
            part = d_a[t]
            part[..., :h] = carried * (before[t] - n) * (z - z * z)
            part[..., h : 2 * h] = dn * keep["g"][t] * (r - r * r)
            part[..., 2 * h :] = dn
            d_gn[t] = dn * r
            d_g[..., : 2 * h] = part[..., : 2 * h]
            d_g[..., 2 * h :] = d_gn[t]
            carried = carried * z
            carried += np.matmul(d_g, turned)
        d_inputs = np.zeros_like(self.inputs)
        flat = d_a.reshape(-1, 3 * h)
        order = np.argsort(rows.reshape(-1), kind="stable")
        held = rows.reshape(-1)[order]
        starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        d_inputs[held[starts]] = np.add.reduceat(flat[order], starts)
        d_all = np.concatenate([d_a[..., : 2 * h], d_gn], 3).transpose(1, 0, 2, 3).reshape(2, -1, 3 * h)
        d_recurrent = np.matmul(before.transpose(1, 3, 0, 2).reshape(2, h, -1), d_all)
        d_output = np.matmul(states.transpose(1, 3, 0, 2).reshape(2, h, -1), both.transpose(1, 0, 2, 3).reshape(2, -1, d.shape[2]))
        return loss, [d_inputs, d_recurrent, d_all.sum(1, keepdims=True), d_output, d.sum((0, 1))]

    def _scores(self, rows: np.ndarray, state: np.ndarray, direction: int) -> tuple[np.ndarray, np.ndarray]:
        """Part of the logits (T, B, L) that one direction gives for table rows (T, B), going on from ``state`` (B, H), and the last state."""
        one = ByteLabeller(self.labels, self.inputs, self.recurrent[direction : direction + 1], self.bias[direction : direction + 1], self.output, self.prior)
        states = one._run(rows[:, None], state[None])[:, 0]
        return states @ self.output[direction], states[-1]

    def long_probabilities(self, data: bytes, block: int = 1 << 15) -> Iterator[tuple[int, np.ndarray]]:
        """(start, log-probabilities of the next bytes) over a text of any length, in memory of one block.

        The way back runs over the whole text once, keeping its state at the block ends only, and again
        within each block as the way ahead comes to it; so the result is that of the text in one piece.
        """
        codes, h = np.frombuffer(data, np.uint8).astype(np.int64), self.recurrent.shape[1]
        starts = range(0, len(codes), block)
        behind, state = {}, np.zeros((1, h), _F)
        for start in reversed(starts):
            behind[start] = state
            if start:
                for end in range(min(start + block, len(codes)), start, -BLOCK):
                    state = self._scores(codes[max(start, end - BLOCK) : end][::-1, None] + 256, state, 1)[1]
        ahead = np.zeros((1, h), _F)
        for start in starts:
            part = codes[start : start + block, None]
            forward, ahead = self._scores(part, ahead, 0)
            back, _ = self._scores(part[::-1] + 256, behind.pop(start), 1)
            yield start, _log_softmax(forward[:, 0] + back[::-1, 0] + self.prior)

    def log_probabilities(self, texts: list[bytes], cells: int = 1 << 17) -> list[np.ndarray]:
        """(bytes, labels) log-probabilities for each text; texts of like length run together."""
        out: list[np.ndarray] = [np.zeros((0, len(self.labels)), _F)] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        h, at = self.recurrent.shape[1], len(order)
        while at > 0:
            steps = len(texts[order[at - 1]])
            part = order[max(0, at - max(1, min(256, cells // steps))) : at]
            at -= len(part)
            lengths = np.array([len(texts[i]) for i in part])
            codes = np.zeros((len(part), steps), np.uint8)
            for row, i in enumerate(part):
                codes[row, : lengths[row]] = np.frombuffer(texts[i], np.uint8)
            turn = lengths[:, None] - 1 - np.arange(steps)[None, :]
            turn[turn < 0] += steps  # padding keeps its place behind the text
            rows = np.stack([codes, np.take_along_axis(codes, turn, 1)]).transpose(2, 0, 1).astype(np.int64) + _ROW
            state = np.zeros((2, len(part), h), _F)
            forward, back = (np.empty((steps, len(part), len(self.labels)), _F) for _ in range(2))
            for start in range(0, steps, BLOCK):  # states of a block only are held; the last one is carried on
                states = self._run(rows[start : start + BLOCK], state)
                state = states[-1]
                forward[start : start + BLOCK], back[start : start + BLOCK] = states[:, 0] @ self.output[0], states[:, 1] @ self.output[1]
            for row, i in enumerate(part):
                n = lengths[row]
                out[i] = _log_softmax(forward[:n, row] + back[:n, row][::-1] + self.prior)
        return out


def train(model: ByteLabeller, batches, *, rate: float = 0.01, clip: float = 1.0, steps: int = 300) -> list[float]:
    """Adam over the batches, with a rate that falls to a tenth; returns the losses."""
    arrays = model.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    losses = []
    for k, (codes, targets) in enumerate(batches, 1):
        loss, gradients = model.step(codes, targets)
        losses.append(loss)
        size = float(np.sqrt(sum(float((g * g).sum()) for g in gradients)))
        scale = min(1.0, clip / max(size, 1e-12))
        now = rate * (0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * min(k, steps) / steps)))
        for a, g, m, v in zip(arrays, gradients, first, second):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (now * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(_F)
    return losses
