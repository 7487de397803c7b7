"""Toxic spans by a linear-chain conditional random field; document scores from its marginals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Substrings, mix, runs, text_blocks

BITS = 17
#: Tokens of a stretch: what runs step by step is done for all stretches together; training takes each for itself.
STRETCH = 128
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Lower-cased word tokens of a block of texts: hashed features, places, and stretches of STRETCH tokens at most."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        inside = _TOKEN[data]
        first = np.zeros(len(data) + 1, bool)
        first[off] = True
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1] | first[1:-1]
            ends[:-1] &= ~inside[1:] | first[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(off, self.start, "right") - 1
        sub = Substrings(_LOWER[data])
        n = len(self.start)
        self.word = sub.hash(self.start, self.end)
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if n > 1:
            same = self.text[1:] == self.text[:-1]
            before[1:] = np.where(same, self.word[:-1], np.uint64(0))
            after[:-1] = np.where(same, self.word[1:], np.uint64(0))
        heads = [sub.hash(self.start, np.minimum(self.start + k, self.end)) for k in (4, 5, 6)]
        self.heads = heads
        tail = sub.hash(np.maximum(self.end - 3, self.start), self.end)
        with np.errstate(over="ignore"):
            self.features = np.stack([(mix(h + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int32) for k, h in enumerate([self.word, *heads, tail, before, after])])
        at = np.arange(n) - np.concatenate([[0], np.flatnonzero(np.diff(self.text)) + 1])[np.cumsum(np.append(0, np.diff(self.text) != 0)[:n])] if n else np.zeros(0, np.int64)
        self.slot = at % STRETCH
        self.head = (at == 0)[self.slot == 0]  # whether a stretch begins its text
        self.chain = np.cumsum(self.slot == 0) - 1
        self.lengths = np.bincount(self.chain) if n else np.zeros(0, np.int64)


def marginals(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains (chains x steps) of one toxic state against one clean state.

    (probability of the toxic state, sum of pair marginals, log partition). Messages are scaled at each step. `before`
    and `after` (2 x chains) are the messages that reach a chain's first token and its last.
    """
    s, t = score.shape
    before, after = np.ones((2, s)) if before is None else before, np.ones((2, s)) if after is None else after
    e = np.exp(np.clip(score, -30, 30))
    m = np.exp(trans)
    alpha, scale = np.ones((t, 2, s)), np.ones((t, s))
    for k in range(t):
        a0, a1 = (before[0], before[1]) if k == 0 else (alpha[k - 1, 0] * m[0, 0] + alpha[k - 1, 1] * m[1, 0], alpha[k - 1, 0] * m[0, 1] + alpha[k - 1, 1] * m[1, 1])
        a1 = a1 * e[:, k]
        scale[k] = a0 + a1
        alpha[k, 0], alpha[k, 1] = a0 / scale[k], a1 / scale[k]
    beta = np.ones((t, 2, s))
    pairs = np.zeros((2, 2))
    p = np.zeros((s, t))
    for k in range(t - 1, -1, -1):
        live = k < lengths - 1
        beta[k] = after
        if k < t - 1:
            b0, b1 = beta[k + 1, 0], beta[k + 1, 1] * e[:, k + 1]
            n0, n1 = m[0, 0] * b0 + m[0, 1] * b1, m[1, 0] * b0 + m[1, 1] * b1
            z = alpha[k, 0] * n0 + alpha[k, 1] * n1
            beta[k, 0], beta[k, 1] = np.where(live, n0 / z, after[0]), np.where(live, n1 / z, after[1])
            for i in (0, 1):
                pairs[i, 0] += (alpha[k, i] * m[i, 0] * b0 / z)[live].sum()
                pairs[i, 1] += (alpha[k, i] * m[i, 1] * b1 / z)[live].sum()
        p[:, k] = alpha[k, 1] * beta[k, 1] / (alpha[k, 0] * beta[k, 0] + alpha[k, 1] * beta[k, 1])
    mask = np.arange(t)[:, None] < lengths
    return p, pairs, (np.log(scale) * mask).sum(0)


def messages(score: np.ndarray, lengths: np.ndarray, head: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of each stretch of whole chains: stretches (rows of `score`) follow each other, `head` begins one.

    Each stretch is the product of its tokens' 2 x 2 matrices, all stretches step by step together; then messages pass
    from stretch to stretch, all chains together.
    """
    n, t = score.shape
    e = np.exp(np.clip(score, -30, 30))
    m = np.exp(trans)
    u = np.zeros((n, 2, 2))
    u[:, 0, 0], u[:, 1, 1] = 1, e[:, 0]
    for k in range(1, t):
        live = k < lengths
        step = u[live] @ m
        step[:, :, 1] *= e[live, k, None]
        u[live] = step / step.sum((1, 2), keepdims=True)
    before, after = np.ones((n, 2)), np.ones((n, 2))
    first = np.flatnonzero(head)
    many = np.diff(np.append(first, n))
    for k in range(1, int(many.max(initial=0))):
        at = first[many > k] + k
        x = np.einsum("ni,nij->nj", before[at - 1], u[at - 1]) @ m
        before[at] = x / x.sum(1, keepdims=True)
    for k in range(int(many.max(initial=0)) - 2, -1, -1):
        at = first[many > k + 1] + k
        x = np.einsum("nij,nj->ni", u[at + 1], after[at + 1]) @ m.T
        after[at] = x / x.sum(1, keepdims=True)
    return before.T, after.T


class ChainField:
    """Weights of hashed token features for the toxic state, and transitions between the two states."""

    def __init__(self):
        self.weight = np.zeros(1 << BITS)
        self.trans = np.zeros((2, 2))
        self.bias = -4.0
        self.calibration = np.array([0.0, 1.0, 0.0])

    def probabilities(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros(len(tokens.start))
        if not len(out):
            return out
        score = self.weight[tokens.features].sum(0) + self.bias
        many = len(tokens.lengths)
        before, after = np.ones((2, many)), np.ones((2, many))
        parts = [(lo, min(lo + 4096, many)) for lo in range(0, many, 4096)]
        padded = np.zeros((many, int(tokens.lengths.max())), np.float64)
        padded[tokens.chain, tokens.slot] = score
        if not tokens.head.all():
            before, after = messages(padded, tokens.lengths, tokens.head, self.trans)
        for lo, hi in parts:
            mine = slice(*np.searchsorted(tokens.chain, [lo, hi]))
            p = marginals(padded[lo:hi], tokens.lengths[lo:hi], self.trans, before[:, lo:hi], after[:, lo:hi])[0]
            out[mine] = p[tokens.chain[mine] - lo, tokens.slot[mine]]
        return out

    def train(self, tokens: Tokens, tag: np.ndarray, epochs: int = 6, rate: float = 0.4, ridge: float = 1e-6, seed: int = 5) -> None:
        """Adaptive gradient steps on the conditional likelihood of the tags, over batches of stretches."""
        rng = np.random.default_rng(seed)
        first = np.searchsorted(tokens.chain, np.arange(len(tokens.lengths)))
        g_w, g_t, g_b = np.full(1 << BITS, 1e-3), np.full((2, 2), 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(tokens.lengths))
            for lo in range(0, len(order), 256):
                chains = np.sort(order[lo : lo + 256])
                lengths = tokens.lengths[chains]
                row = np.repeat(np.arange(len(chains)), lengths)
                slot = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                at = first[chains][row] + slot
                f = tokens.features[:, at]
                padded = np.zeros((len(chains), lengths.max()))
                padded[row, slot] = self.weight[f].sum(0) + self.bias
                p, pairs, _ = marginals(padded, lengths, self.trans)
                y = tag[at]
                miss = (p[row, slot] - y) / len(chains)
                link = slot[1:] > 0
                told = np.zeros((2, 2))
                np.add.at(told, (y[:-1][link], y[1:][link]), 1)
                d = np.bincount(f.ravel(), weights=np.tile(miss, len(f)), minlength=1 << BITS) + ridge * self.weight
                d_t = (pairs - told) / len(chains)
                g_w += d * d
                g_t += d_t * d_t
                g_b += miss.sum() ** 2
                self.weight -= rate * d / np.sqrt(g_w)
                self.trans -= rate * 0.2 * d_t / np.sqrt(g_t)
                self.bias -= rate * miss.sum() / np.sqrt(g_b)


def tag_tokens(tokens: Tokens, toxic: np.ndarray, least: float = 2.5) -> np.ndarray:
    """Token labels from labelled texts: in toxic texts, tokens whose word or stem is far more frequent among them.

    A toxic text without one has its most telling token labelled.
    """
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    telling = np.full(len(tokens.start), -9.0)
    for h in (tokens.word, *tokens.heads[1:]):
        _, key = np.unique(h, return_inverse=True)
        both = np.unique(key.astype(np.int64) * len(toxic) + tokens.text)
        where, text = both // len(toxic), both % len(toxic)
        seen1 = np.bincount(where, weights=toxic[text], minlength=key.max(initial=-1) + 1)
        seen0 = np.bincount(where, weights=~toxic[text], minlength=key.max(initial=-1) + 1)
        odds = np.log((seen1 + 0.1) / n1 / ((seen0 + 0.5) / n0))
        odds[seen1 < min(3, n1)] = -9
        telling = np.maximum(telling, odds[key])
    tag = (toxic[tokens.text] & (telling >= least)).astype(np.int64)
    with_tag = np.zeros(len(toxic), bool)
    with_tag[tokens.text[tag > 0]] = True
    best: dict[int, int] = {}
    for k in np.flatnonzero(toxic[tokens.text] & ~with_tag[tokens.text] & (telling > 0)):
        d = int(tokens.text[k])
        if d not in best or telling[k] > telling[best[d]]:
            best[d] = int(k)
    tag[list(best.values())] = 1
    return tag


def _evidence(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    most, total = np.full(n, 1e-6), np.zeros(n)
    np.maximum.at(most, text, np.clip(p, 1e-6, 1 - 1e-6))
    np.add.at(total, text, p)
    return np.column_stack([np.ones(n), np.log(most / (1 - most)), np.log(total + 1e-6)])


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.array([0.0, 0.5, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1.0, 1.0])
        b = b - np.linalg.solve(h, x.T @ (weight * (p - y)) + np.array([0.1, 1.0, 1.0]) * (b - [0, 0.5, 0]))
    return b


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: tuple[int, int] = (1600, 800), most_bytes: int = 32768) -> ChainField:
    """A field trained on a bounded sample: of the first `most` clean and toxic labels by hash of id, the distinct texts
    of `most_bytes` at most. Equal texts are one, with the label that most of them have (toxic where as many have either)."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    ids = None
    for k in (0, 1):
        part = one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k])
        ids = part if ids is None else ids.union(part)
    text = F.col(text_col).cast("string")
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where(F.octet_length("text") <= most_bytes)
    rows = told.join(F.broadcast(ids), "doc_id").groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("text")).limit(sum(most)).toArrow()  # 2400 ids at most
    model = ChainField()
    toxic = rows.column("label").to_numpy() == 1
    if not toxic.any():
        model.bias = -12.0
        model.calibration = np.array([-6.0, 0.0, 0.0])
        return model
    texts = [t.encode() for t in rows.column("text").to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    tokens = Tokens(np.frombuffer(b"".join(texts), np.uint8), off)
    model.train(tokens, tag_tokens(tokens, toxic))
    # the sample's classes count as often as the labels have them
    weight = np.where(toxic, counts.get(1, 0) / toxic.sum(), counts.get(0, 0) / max(1, (~toxic).sum()))
    model.calibration = _calibrate(_evidence(model.probabilities(tokens), tokens.text, len(texts)), toxic.astype(float), weight * len(toxic) / weight.sum())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_at: float = 0.5, model: ChainField | None = None) -> DataFrame:
    """Rows (doc_id, score, spans), one for each input row; spans are byte offsets [start, end) of toxic stretches.

    Every token of every text gets its marginal from forward-backward; the largest and the sum of a text's marginals
    make its score by a calibrated logistic map. A chain is as long as its text. `labels`
    (doc_id, label) follow the rules of the quality operator; without a toxic one all scores are near 0. Null, empty
    and wordless texts have the score of no evidence and no spans. Extra columns are ignored; repeated rows score
    alike; an empty table gives no rows.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, id_col, text_col))

    def score(batches):
        model = fitted.value
        for batch in batches:
            out, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, hi, data, off in text_blocks(batch.column(1), 1 << 20):
                tokens = Tokens(data, off)
                p = model.probabilities(tokens)
                z = _evidence(p, tokens.text, hi - lo) @ model.calibration
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for a, b in zip(*runs(p >= span_at), strict=True):
                    for d in range(tokens.text[a], tokens.text[b - 1] + 1):
                        mine = np.flatnonzero(tokens.text[a:b] == d) + a
                        if len(mine):
                            spans[lo + d].append({"start": int(tokens.start[mine[0]] - off[d]), "end": int(tokens.end[mine[-1]] - off[d])})
            yield pa.record_batch([batch.column(0), pa.array(out), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, spans array<struct<start: long, end: long>>")
