"""Toxicity: a bidirectional gated recurrent network over overlapping windows, trained in numpy.

A token is a run of visible characters, lower-cased. Its input is a word vector (words of the training sample, one
vector for all others) beside the mean vector of its hashed character 3- to 5-grams. A forward and a backward GRU run
over windows of ``WINDOW`` tokens that overlap by a quarter; attention pools the states into one vector and a logit. A
text's logit is the largest of all its windows, so a remark is found wherever it stands in a long text.

Labels are of whole texts, so training alternates: fit on one window per toxic text and some of each clean one, then
choose the windows the network itself finds worst. The first choice is by smoothed log-odds of words and
character n-grams. At last a logistic curve over the largest logits is fitted to the observed rates.

The network is fitted on a bounded sample: about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows by hash of the id,
texts of up to ``TRAIN_CHARS`` characters, folds crc32(doc_id as text) mod 5 of 1 to 4. Scoring reads every whole text and
only the text.

A text without tokens, null texts among them, scores 0. Labels that are null, or without a document, are ignored; of
several labels of a document the largest counts. Null ids and repeated rows are scored like others. Without labels of
both kinds every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import crc_mod, free_name, ids_and_texts

FOLDS, HELD_OUT = 5, 0
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 1000, 2500, 6000
WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 12, 16, 16
CHAR_BUCKETS, VOCABULARY, LEAST_COUNT = 1 << 14, 20_000, 3
ROUNDS, EPOCHS, BATCH, RATE = 2, 3, 128, 6e-3
LEAST_STEPS = 140  # per round; small samples are gone over more often
MEMO_WORDS = 120_000
SCORE_WINDOWS = 1024


def tokens(text: str) -> list[str]:
    return text.lower().split() or [""]


def window_starts(n: int) -> np.ndarray:
    """Starts of all windows of a text of ``n`` tokens; the last reaches its end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- to 5-grams of ``<word>``, and how many each word has (at least one)."""
    framed = [f"<{w}>" if w else "<->" for w in words]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    buckets, owner = [], []
    word = np.repeat(np.arange(len(framed)), lengths)
    for n in (3, 4, 5):
        inside = at[at + n <= ends]
        h = np.full(len(inside), np.uint64(n))
        for i in range(n):
            h = (h ^ codes[inside + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        buckets.append((h % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        owner.append(word[inside])
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(framed))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) * mask
    return e / e.sum(axis=1, keepdims=True)


class Network:
    """Parameters by name, forward pass, gradients."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN

        def normal(scale: float, *shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.vocabulary = vocabulary
        self.p = {"word": normal(0.1, len(vocabulary) + 1, WORD_DIM), "char": normal(0.3, CHAR_BUCKETS, CHAR_DIM),
                  "Wa": normal((2 * h) ** -0.5, 2 * h, ATTENTION), "ba": np.zeros(ATTENTION, np.float32),
                  "va": normal(ATTENTION ** -0.5, ATTENTION), "u": normal((2 * h) ** -0.5, 2 * h),
                  "c": np.zeros(1, np.float32)}
        for way in "fb":
            # columns: update, reset, candidate
            self.p |= {f"W{way}": normal(d ** -0.5, d, 3 * h), f"U{way}": normal(h ** -0.5, h, 3 * h),
                       f"b{way}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what their gradients need."""
        number = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        buckets, sizes = char_grams(words)
        first = np.cumsum(sizes) - sizes
        means = np.add.reduceat(self.p["char"][buckets], first, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][number], means], axis=1), (number, buckets, sizes)

    def states(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) from projected inputs (T, B, 3H); ``mask`` (T, B, 1)."""
        h = HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape[:2], h), np.float32)
        weights = self.p[f"U{way}"]
        for t in range(len(x)) if way == "f" else reversed(range(len(x))):
            inner = state @ weights
            gates = sigmoid(x[t, :, :2 * h] + inner[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[t, :, 2 * h:] + r * inner[:, 2 * h:])
            new = n + z * (state - n)
            if keep is not None:
                keep.append((t, state, z, r, n, inner[:, 2 * h:]))
            state = np.where(mask[t], new, state)
            out[t] = state
        return out

    def run(self, way: str, x: np.ndarray, which: np.ndarray, mask: np.ndarray | None, out: np.ndarray) -> None:
        """The states for scoring: as ``states``, but nothing is kept and arrays are used again."""
        h, weights = HIDDEN, self.p[f"U{way}"]
        state = np.zeros((which.shape[1], h), np.float32)
        inner = np.empty((which.shape[1], 3 * h), np.float32)
        with np.errstate(over="ignore"):  # exp of a large number is infinite, and the gate 0
            for t in range(len(which)) if way == "f" else reversed(range(len(which))):
                token = x.take(which[t], axis=0)
                np.matmul(state, weights, out=inner)
                gates = token[:, :2 * h] + inner[:, :2 * h]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                n = inner[:, 2 * h:] * gates[:, h:]
                n += token[:, 2 * h:]
                np.tanh(n, out=n)
                new = state - n
                new *= gates[:, :h]
                new += n
                state = new if mask is None else np.where(mask[t], new, state)
                out[t] = state

    def logits(self, x: np.ndarray, which: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows; ``x`` holds projected inputs of distinct words for both ways, ``which`` (T, B)."""
        m = None if mask.all() else mask[:, :, None]
        states = np.empty((*which.shape, 2 * HIDDEN), np.float32)
        self.run("f", x[0], which, m, states[:, :, :HIDDEN])
        self.run("b", x[1], which, m, states[:, :, HIDDEN:])
        weights = softmax((np.tanh(states @ self.p["Wa"] + self.p["ba"]) @ self.p["va"]).T, mask.T)
        return np.einsum("bt,tbh,h->b", weights, states, self.p["u"], optimize=True) + self.p["c"][0]

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]

    def loss(self, words: list[str], which: np.ndarray, mask: np.ndarray, y: np.ndarray,
             weight: np.ndarray) -> tuple[float, dict]:
        """Weighted cross-entropy and its gradients."""
        p, h = self.p, HIDDEN
        x, (number, buckets, sizes) = self.inputs(words)
        fx, bx = self.project(x)
        m = mask[:, :, None]
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.states("f", fx[which], m, kept["f"]),
                                 self.states("b", bx[which], m, kept["b"])], axis=2)
        hidden = np.tanh(states @ p["Wa"] + p["ba"])
        a = softmax((hidden @ p["va"]).T, mask.T)
        pooled = np.einsum("bt,tbh->bh", a, states)
        logit = pooled @ p["u"] + p["c"][0]
        prob = sigmoid(logit)
        loss = -np.sum(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))) / weight.sum()

        g = {}
        d_logit = (weight * (prob - y) / weight.sum()).astype(np.float32)
        g["u"], g["c"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["u"]
        d_states = a.T[:, :, None] * d_pooled[None]
        d_a = np.einsum("tbh,bh->bt", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("bt,tbk->k", d_e, hidden)
        d_hidden = d_e.T[:, :, None] * p["va"] * (1 - hidden ** 2)
        g["Wa"], g["ba"] = np.einsum("tbh,tbk->hk", states, d_hidden), d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ p["Wa"].T

        d_x = np.zeros_like(x)
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            d_in = np.zeros((*which.shape, 3 * h), np.float32)
            d_u = np.zeros_like(p[f"U{way}"])
            carry = np.zeros((which.shape[1], h), np.float32)
            for t, state, z, r, n, inner in reversed(kept[way]):
                carry = carry + d_states[t, :, part]
                d_new = np.where(m[t], carry, 0)
                d_n = d_new * (1 - z) * (1 - n ** 2)
                d_z = d_new * (state - n) * z * (1 - z)
                d_r = d_n * inner * r * (1 - r)
                d_in[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_inner = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += state.T @ d_inner
                carry = np.where(m[t], 0, carry) + d_new * z + d_inner @ p[f"U{way}"].T
            by_word = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(by_word, which.ravel(), d_in.reshape(-1, 3 * h))
            g[f"U{way}"], g[f"W{way}"], g[f"b{way}"] = d_u, x.T @ by_word, by_word.sum(axis=0)
            d_x += by_word @ p[f"W{way}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], number, d_x[:, :WORD_DIM])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], buckets, np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        return float(loss), g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        for k, x in g.items():
            x = x * np.float32(scale)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9 ** self.t))
                          / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)).astype(np.float32)


# --- training ---------------------------------------------------------------------------

def _windows(words: list[str]) -> list[list[str]]:
    return [words[s:s + WINDOW] for s in window_starts(len(words))]


def _matrix(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, their numbers (T, B) and a mask of real tokens."""
    numbers: dict[str, int] = {}
    which = np.zeros((WINDOW, len(windows)), np.int64)
    mask = np.zeros((WINDOW, len(windows)), bool)
    for j, words in enumerate(windows):
        which[:len(words), j] = [numbers.setdefault(w, len(numbers)) for w in words]
        mask[:len(words), j] = True
    return list(numbers), which, mask


def _suspicions(docs: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """Per word the largest log-odds of itself and its n-grams, over texts that hold them."""
    numbers: dict[str, int] = {}
    ids = [np.unique([numbers.setdefault(w, len(numbers)) for w in d]) for d in docs]
    buckets, sizes = char_grams(list(numbers))
    first = np.cumsum(sizes) - sizes
    seen_words, seen_grams = np.zeros((2, len(numbers))), np.zeros((2, CHAR_BUCKETS))
    for u, y in zip(ids, labels):
        seen_words[y, u] += 1
        seen_grams[y, np.unique(np.concatenate([buckets[first[i]:first[i] + sizes[i]] for i in u]))] += 1
    n = np.bincount(labels, minlength=2)

    def odds(seen: np.ndarray) -> np.ndarray:
        value = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        return np.where(seen[1] >= LEAST_COUNT, value, -9.0)

    worst = np.maximum(np.maximum.reduceat(odds(seen_grams)[buckets], first), odds(seen_words))
    return dict(zip(numbers, worst.tolist()))


def train(texts: list[str], labels: list[int], seed: int = 1) -> Network | None:
    """Fit the network on whole texts; None without both labels."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    docs = [tokens(t) for t in texts]
    counts = Counter(w for d in docs for w in set(d))
    frequent = sorted((w for w, n in counts.items() if n >= LEAST_COUNT), key=lambda w: (-counts[w], w))
    net = Network({w: i + 1 for i, w in enumerate(frequent[:VOCABULARY])}, seed)
    windows = [_windows(d) for d in docs]
    suspicion = _suspicions(docs, y)
    looks = [np.array([max(map(suspicion.__getitem__, w)) for w in ws]) for ws in windows]
    del suspicion
    adam = Adam(net.p, RATE)
    for turn in range(ROUNDS):
        chosen: list[tuple[list[str], int]] = []
        for ws, look, label in zip(windows, looks, y):
            worst = int(look.argmax())
            chosen.append((ws[worst], int(label)))
            if not label:
                chosen.extend((ws[i], 0) for i in rng.choice(len(ws), min(2, len(ws)), replace=False))
        rate = np.array([label for _, label in chosen]).mean()
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(chosen)))):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), BATCH):
                part = [chosen[i] for i in order[at:at + BATCH]]
                # A word is hidden now and then, so that its characters must do.
                words, which, mask = _matrix([w for w, _ in part])
                target = np.array([label for _, label in part], np.float32)
                weight = np.where(target > 0, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
                hidden = {w for w in words if rng.random() < 0.3}
                vocabulary, net.vocabulary = net.vocabulary, _Without(net.vocabulary, hidden)
                _, gradients = net.loss(words, which, mask, target, weight)
                net.vocabulary = vocabulary
                adam.step(gradients)
        scorer = Scorer(net)
        looks = [scorer.window_logits([d])[0] for d in docs]
    largest = np.array([look.max() for look in looks])
    net.curve = _curve(largest, y)
    return net


class _Without(dict):
    """A vocabulary in which some words are unknown."""

    def __init__(self, vocabulary: dict[str, int], hidden: set[str]):
        super().__init__()
        self.vocabulary, self.hidden = vocabulary, hidden

    def get(self, word: str, default: int = 0) -> int:
        return default if word in self.hidden else self.vocabulary.get(word, default)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the label over the largest logit (Newton steps, slightly damped)."""
    z = np.stack([x, np.ones_like(x)], axis=1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(z @ w)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hessian, z.T @ (p - y) + 1e-2 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


# --- scoring ----------------------------------------------------------------------------

class Scorer:
    """Scores texts; keeps the projected inputs of words it has met, up to a bound."""

    def __init__(self, net: Network):
        self.net = net
        self.numbers: dict[str, int] = {}
        self.size = 0
        self.x = (np.empty((0, 3 * HIDDEN), np.float32),) * 2

    def _learn(self, docs: list[list[str]]) -> None:
        if len(self.numbers) > MEMO_WORDS:
            self.numbers, self.size = {}, 0
        known = self.numbers
        new = list(dict.fromkeys(w for d in docs for w in d if w not in known))
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            projected = self.net.project(self.net.inputs(part)[0])
            room = self.size + len(part)
            if room > len(self.x[0]):
                self.x = tuple(np.concatenate([x, np.empty((room, x.shape[1]), np.float32)]) for x in self.x)
            for x, values in zip(self.x, projected):
                x[self.size:room] = values
            known.update(zip(part, range(self.size, room)))
            self.size = room

    def window_logits(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        self._learn(docs)
        lengths = np.array([len(d) for d in docs])
        flat = np.fromiter((self.numbers[w] for d in docs for w in d), np.int64, lengths.sum())
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        firsts, sizes, many = [], [], []
        for start, n in zip(np.cumsum(lengths) - lengths, lengths):
            s = window_starts(n)
            firsts.append(start + s)
            sizes.append(np.minimum(WINDOW, n - s))
            many.append(len(s))
        first, size = np.concatenate(firsts), np.concatenate(sizes)
        out = np.empty(len(first), np.float32)
        steps = np.arange(WINDOW)[:, None]
        # Whole windows first: they need no mask.
        order = np.argsort(size < WINDOW, kind="stable")
        whole = int((size == WINDOW).sum())
        cuts = [*range(0, whole, SCORE_WINDOWS), *range(whole, len(order), SCORE_WINDOWS), len(order)]
        for at, end in zip(cuts, cuts[1:]):
            part = order[at:end]
            out[part] = self.net.logits(self.x, flat[first[part] + steps], steps < size[part])
        return np.split(out, np.cumsum(many)[:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.net.curve
        docs = [tokens(t) for t in texts]
        largest = np.array([w.max() for w in self.window_logits(docs)], np.float64)
        return np.where([d != [""] for d in docs], sigmoid(a * largest + b), 0.0)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(incoming: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    net = shared.value
    scorer = Scorer(net) if net else None
    for batch in incoming:
        texts = batch["text"].to_pylist()
        scores = np.concatenate([scorer.scores(texts[i:i + 128]) for i in range(0, len(texts), 128)]) if scorer \
            else np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores)], schema=_SCORED)


def training_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS,
                    clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """doc_id, text, toxic of the bounded sample. Rows are chosen among the labels, so texts aren't shuffled."""
    usable = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .filter((crc_mod("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull()))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {1: toxic_rows / max(1, counts.get(1, 0)), 0: clean_rows / max(1, counts.get(0, 0))}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    # About toxic_rows + clean_rows rows: this is what is broadcast.
    chosen = usable.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    texts = ids_and_texts(docs).filter(F.char_length("text") <= TRAIN_CHARS)
    # Of rows that repeat an id the first text counts; map-side combining leaves one row per task and id to shuffle.
    return (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
            .select("doc_id", "text", "toxic"))


def _fit(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for batch in incoming for r in batch.to_pylist())
    net = train([t for _, t, _ in rows], [y for _, _, y in rows])
    yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(net)]}, schema=pa.schema([("model", pa.binary())]))


def fit_network(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network, trained by one task on the bounded sample; None without labels of both kinds."""
    fitted = training_sample(docs, labels).repartition(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(bytes(fitted[0]["model"])) if fitted else None


def score_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_network(docs, labels))  # of fixed size
    scored = ids_and_texts(docs).mapInArrow(lambda it: _score(it, shared), "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_network(docs, labels))
    name = free_name(docs, "_toxicity")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(name, score_column(shared)(text)).filter(F.col(name) < 0.5).drop(name)


def score_column(shared):
    """The score as a column function, for filters that keep all columns of a table."""
    import pandas as pd

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        scorer = Scorer(net) if net else None
        for texts in batches:
            texts = texts.tolist()
            parts = [scorer.scores(texts[i:i + 128]) for i in range(0, len(texts), 128)] if scorer else []
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(len(texts)))

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")
