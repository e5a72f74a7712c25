"""A bidirectional gated recurrent network with attention pooling, in numpy.

A token enters as two inputs, a vector of the word and the mean of vectors of its hashed character n-grams, so that misspelt, inflected
and unseen words still say something. Two gated recurrent layers read a window from either end; attention weighs their states into one
vector, from which four classes are scored. Gradients are written out by hand; training is Adam on shuffled batches with fixed seeds,
so the same examples give the same model.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np

LABELS = ("none", "abusive", "hateful", "sexual")


@dataclass(frozen=True)
class Shape:
    word: int = 32
    chars: int = 32
    hidden: int = 24
    attention: int = 24
    buckets: int = 16_384
    grams: tuple[int, ...] = (2, 3, 4, 5)


def char_grams(word: str, shape: Shape) -> np.ndarray:
    """Buckets of all of a word's character n-grams, its borders marked."""
    marked = f"<{word}>"
    found = [zlib.crc32(marked[i : i + n].encode()) % shape.buckets for n in shape.grams for i in range(len(marked) - n + 1)]
    if not found:
        found = [zlib.crc32(marked.encode()) % shape.buckets]
    return np.array(found, dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _summed(rows: np.ndarray, into: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by the index in ``into``."""
    out = np.zeros((size, rows.shape[1]), dtype=rows.dtype)
    if len(into):
        order = np.argsort(into, kind="stable")
        sorted_into = into[order]
        starts = np.flatnonzero(np.append(True, sorted_into[1:] != sorted_into[:-1]))
        out[sorted_into[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class GatedLayer:
    """One direction. Weights: ``W`` (input to the three gates), ``U`` (state to them), ``b``."""

    def __init__(self, p: dict[str, np.ndarray], name: str):
        self.W, self.U, self.b = (p[f"{name}.{k}"] for k in "WUb")
        self.h = self.U.shape[0]

    def run(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (batch, time, hidden) from projected inputs; masked steps carry the state on."""
        batch, time, _ = projected.shape
        h, H = self.h, np.zeros((batch, self.h), dtype=projected.dtype)
        states = np.empty((batch, time, h), dtype=projected.dtype)
        kept = []
        for t in range(time):
            a, u = projected[:, t], H @ self.U
            rz = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            m = mask[:, t : t + 1]
            new = H + m * (1 - z) * (n - H)
            if keep:
                kept.append((H, r, z, n, u[:, 2 * h :], m))
            H = new
            states[:, t] = H
        return states, kept

    def back(self, grad: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the projected inputs and of U from those of the states."""
        batch, time, h = grad.shape
        d_projected = np.empty((batch, time, 3 * h), dtype=grad.dtype)
        d_U = np.zeros_like(self.U)
        carry = np.zeros((batch, h), dtype=grad.dtype)
        for t in range(time - 1, -1, -1):
            H, r, z, n, un, m = kept[t]
            d = carry + grad[:, t]
            dz = d * m * -(n - H) * z * (1 - z)
            dn = d * m * (1 - z) * (1 - n * n)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dr, dz, dn * r], axis=1)
            d_projected[:, t] = np.concatenate([dr, dz, dn], axis=1)
            d_U += H.T @ du
            carry = d * (1 - m * (1 - z)) + du @ self.U.T
        return d_projected, d_U


@dataclass
class Model:
    shape: Shape
    words: dict[str, int]
    p: dict[str, np.ndarray]
    _rows: dict[str, np.ndarray] = field(default_factory=dict, repr=False)
    _grams: dict[str, np.ndarray] = field(default_factory=dict, repr=False)
    kept_words: int = 50_000

    @staticmethod
    def fresh(shape: Shape, words: Sequence[str], seed: int) -> Model:
        rng = np.random.default_rng(seed)
        h, d, a = shape.hidden, shape.word + shape.chars, shape.attention
        near = lambda *size: (rng.standard_normal(size) / np.sqrt(size[0])).astype(np.float32)
        p = {"word": 0.1 * rng.standard_normal((len(words) + 1, shape.word)).astype(np.float32), "gram": 0.3 * rng.standard_normal((shape.buckets, shape.chars)).astype(np.float32)}
        p["word"][0] = 0
        for side in ("ahead", "back"):
            p |= {f"{side}.W": near(d, 3 * h), f"{side}.U": near(h, 3 * h), f"{side}.b": np.zeros(3 * h, dtype=np.float32)}
        p |= {"att.W": near(2 * h, a), "att.b": np.zeros(a, dtype=np.float32), "att.v": near(a), "out.W": near(2 * h, len(LABELS)), "out.b": np.zeros(len(LABELS), dtype=np.float32)}
        return Model(shape, {w: i + 1 for i, w in enumerate(words)}, p)

    # --- scoring

    def _row(self, word: str) -> np.ndarray:
        """A word's inputs, projected for both directions; kept for words seen before."""
        row = self._rows.get(word)
        if row is None:
            if len(self._rows) >= self.kept_words:
                self._rows.clear()
            x = np.concatenate([self.p["word"][self.words.get(word, 0)], self.p["gram"][char_grams(word, self.shape)].mean(axis=0)])
            row = self._rows[word] = np.concatenate([x @ self.p["ahead.W"] + self.p["ahead.b"], x @ self.p["back.W"] + self.p["back.b"]])
        return row

    def scores(self, windows: list[list[str]]) -> np.ndarray:
        """Class probabilities (windows, classes). A window without tokens is ``none``."""
        words: dict[str, int] = {}
        at = np.full((len(windows), max(map(len, windows), default=0)), -1, dtype=np.int32)
        for i, w in enumerate(windows):
            at[i, : len(w)] = [words.setdefault(t, len(words)) for t in w]
        return self.scores_at(list(words), at)

    def scores_at(self, words: list[str], at: np.ndarray, batch: int = 2048) -> np.ndarray:
        """The same for windows given as places in ``words``, -1 beyond the end of a window."""
        out = np.zeros((len(at), len(LABELS)), dtype=np.float32)
        out[:, 0] = 1
        if not words:
            return out
        rows = np.stack([self._row(w) for w in words])
        length = (at >= 0).sum(axis=1)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            places = at[chosen, : length[chosen[-1]]]
            mask = (places >= 0).astype(np.float32)
            out[chosen] = self._head(rows[places], mask)[0]
        return out

    def _head(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        h3 = 3 * self.shape.hidden
        ahead, kept_a = GatedLayer(self.p, "ahead").run(projected[:, :, :h3], mask, keep)
        back, kept_b = GatedLayer(self.p, "back").run(projected[:, ::-1, h3:], mask[:, ::-1], keep)
        states = np.concatenate([ahead, back[:, ::-1]], axis=2)
        hidden = np.tanh(states @ self.p["att.W"] + self.p["att.b"])
        weight = hidden @ self.p["att.v"] + np.where(mask > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,btd->bd", weight, states)
        logits = pooled @ self.p["out.W"] + self.p["out.b"]
        probability = np.exp(logits - logits.max(axis=1, keepdims=True))
        probability /= probability.sum(axis=1, keepdims=True)
        return probability, (states, hidden, weight, pooled, kept_a, kept_b)

    # --- training

    def _grams_of(self, word: str) -> np.ndarray:
        found = self._grams.get(word)
        if found is None:
            found = self._grams[word] = char_grams(word, self.shape)
        return found

    def gradients(self, texts: list[list[str]], target: np.ndarray, weights: np.ndarray, rng: np.random.Generator | None = None, word_drop: float = 0.0, gram_drop: float = 0.0):
        """Loss and gradients of a batch; ``target`` is (batch, classes). Words and n-grams are dropped at random when ``rng`` is given."""
        shape, p = self.shape, self.p
        time = max(map(len, texts))
        size = len(texts)
        place = np.zeros((size, time), dtype=np.int64)  # of each token's word among the batch's words; the last is padding
        mask = np.zeros((size, time), dtype=np.float32)
        at: dict[str, int] = {}
        for b, text in enumerate(texts):
            place[b, : len(text)] = [at.setdefault(w, len(at)) for w in text]
            mask[b, : len(text)] = 1
        place[mask == 0] = len(at)
        ids = np.array([self.words.get(w, 0) for w in at] + [0])[place]
        grams = [self._grams_of(w) for w in at]
        gram = np.concatenate(grams)
        owner = np.repeat(np.arange(len(at)), [len(x) for x in grams])
        if rng is not None:
            ids[rng.random(ids.shape) < word_drop] = 0
            stay = rng.random(len(gram)) >= gram_drop
            gram, owner = gram[stay], owner[stay]
        per_word = np.bincount(owner, minlength=len(at) + 1).astype(np.float32)
        share = (1 / np.maximum(per_word, 1))[owner]
        chars = _summed(p["gram"][gram] * share[:, None], owner, len(at) + 1)
        x = np.concatenate([p["word"][ids], chars[place]], axis=2)
        W = np.concatenate([p["ahead.W"], p["back.W"]], axis=1)
        projected = x @ W + np.concatenate([p["ahead.b"], p["back.b"]])
        probability, (states, hidden, weight, pooled, kept_a, kept_b) = self._head(projected, mask, keep=True)
        loss = -(target * np.log(probability + 1e-9)).sum(axis=1)

        g: dict[str, np.ndarray] = {}
        d_logits = (probability - target) * (weights / size)[:, None]
        g["out.W"], g["out.b"] = pooled.T @ d_logits, d_logits.sum(axis=0)
        d_pooled = d_logits @ p["out.W"].T
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("bd,btd->bt", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["att.v"] = np.einsum("bt,bta->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["att.v"] * (1 - hidden * hidden)
        g["att.W"], g["att.b"] = np.einsum("btd,bta->da", states, d_hidden), d_hidden.sum(axis=(0, 1))
        d_states += d_hidden @ p["att.W"].T
        h = shape.hidden
        d_ahead, g["ahead.U"] = GatedLayer(p, "ahead").back(d_states[:, :, :h], kept_a)
        d_back, g["back.U"] = GatedLayer(p, "back").back(d_states[:, ::-1, h:], kept_b)
        d_projected = np.concatenate([d_ahead, d_back[:, ::-1]], axis=2)
        d_W = np.einsum("btd,btk->dk", x, d_projected)
        g["ahead.W"], g["back.W"] = d_W[:, : 3 * h], d_W[:, 3 * h :]
        d_b = d_projected.sum(axis=(0, 1))
        g["ahead.b"], g["back.b"] = d_b[: 3 * h], d_b[3 * h :]
        d_x = d_projected @ W.T
        flat = d_x.reshape(size * time, -1)
        g["word"] = _summed(flat[:, : shape.word], ids.ravel(), len(p["word"]))
        g["word"][0] = 0
        d_chars = _summed(flat[:, shape.word :], place.ravel(), len(at) + 1)
        g["gram"] = _summed(d_chars[owner] * share[:, None], gram, shape.buckets)
        return loss, probability, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float, decay: float):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 2.0 / (norm + 1e-9))
        for k, x in g.items():
            x = x * clip
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.005 * (x * x - self.v[k])
            step = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.995**self.t)) + 1e-8)
            self.p[k] -= scale * self.rate * (step + self.decay * self.p[k])


def train(
    examples: Sequence[tuple[list[str], int]],
    shape: Shape = Shape(),
    seed: int = 1,
    epochs: int = 6,
    batch: int = 96,
    rate: float = 0.005,
    decay: float = 0.003,
    word_drop: float = 0.35,
    gram_drop: float = 0.15,
    smoothing: float = 0.03,
    min_word_count: int = 2,
) -> Model:
    """Fit a model to tokenised examples with class numbers. From half-way on, examples the model finds clearly mislabelled count nothing."""
    examples = [e for e in examples if e[0]]
    if not examples:
        raise ValueError("no examples to fit to")
    counts: dict[str, int] = {}
    for text, _ in examples:
        for w in text:
            counts[w] = counts.get(w, 0) + 1
    model = Model.fresh(shape, sorted(w for w, n in counts.items() if n >= min_word_count), seed)
    rng = np.random.default_rng(seed)
    adam = Adam(model.p, rate, decay)
    weights = np.ones(len(examples), dtype=np.float32)
    steps = epochs * -(-len(examples) // batch)
    done = 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        # batches of similar length waste little on padding
        blocks = [sorted(order[i : i + 16 * batch], key=lambda k: len(examples[k][0])) for i in range(0, len(order), 16 * batch)]
        parts = [block[i : i + batch] for block in blocks for i in range(0, len(block), batch)]
        for i in rng.permutation(len(parts)):
            chosen = parts[i]
            label = np.array([examples[k][1] for k in chosen])
            target = np.full((len(chosen), len(LABELS)), smoothing / len(LABELS), dtype=np.float32)
            target[np.arange(len(chosen)), label] += 1 - smoothing
            _, probability, g = model.gradients([examples[k][0] for k in chosen], target, weights[chosen], rng, word_drop, gram_drop)
            if epoch >= epochs // 2:
                weights[chosen] = np.where(probability[np.arange(len(chosen)), label] < 0.05, 0.0, 1.0)
            adam.step(g, scale=max(0.05, 1 - done / steps))
            done += 1
    model._grams.clear()
    return model


def to_bytes(model: Model) -> bytes:
    """A model as one file."""
    out = io.BytesIO()
    np.savez_compressed(out, words=np.frombuffer("\n".join(model.words).encode(), dtype=np.uint8), shape=np.frombuffer(json.dumps(asdict(model.shape)).encode(), dtype=np.uint8), **{f"p.{k}": v for k, v in model.p.items()})
    return out.getvalue()


def from_bytes(data: bytes) -> Model:
    with np.load(io.BytesIO(data)) as kept:
        shape = json.loads(kept["shape"].tobytes())
        words = kept["words"].tobytes().decode().split("\n")
        return Model(Shape(**{**shape, "grams": tuple(shape["grams"])}), {w: i + 1 for i, w in enumerate(words)}, {k[2:]: kept[k] for k in kept.files if k.startswith("p.")})
