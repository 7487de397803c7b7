"""Language identification by multilingual mixture inference over n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_blocks

ORDER = 4
BUCKETS = 1 << 15
SMOOTH = 0.05
BLOCK = 2 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the ORDER bytes from each position on; white space counts as one space."""
    x = np.concatenate([np.where(SPACE[data], np.uint8(32), data), np.full(ORDER, 32, np.uint8)]).astype(np.uint32)
    h = x[: len(data)].copy()
    for k in range(1, ORDER):
        h = h * np.uint32(0x01000193) ^ x[k : k + len(data)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(17)).astype(np.int64)


def _own(off: np.ndarray) -> np.ndarray:
    """True where a gram lies within one text."""
    ok = np.ones(off[-1], bool)
    for k in range(1, ORDER):
        at = off[1:] - k
        ok[at[at >= off[:-1]]] = False
    return ok


def train(labelled: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods by bucket and language) from all labelled texts.

    Every task counts its own rows' grams; the counts meet in one sum by language and bucket. The driver gets
    BUCKETS numbers a language at most.
    """

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, data, off in text_blocks(batch.column(1), BLOCK):
                gram, ok = _grams(data), _own(off)
                names = sorted(set(langs[lo:hi]))
                code = np.array([names.index(x) for x in langs[lo:hi]], np.int64)
                where = np.repeat(code, np.diff(off))[ok] * BUCKETS + gram[ok]
                found = np.bincount(where, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + found[k]
        for name, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at)), at.astype(np.int32), n[at].astype(np.int64)], ["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col).cast("string")).alias("text"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((BUCKETS, max(1, len(names))), SMOOTH)
    if names:
        column = np.searchsorted(np.array(names), np.array(counts.column("lang").to_pylist()))
        np.add.at(table, (counts.column("bucket").to_numpy(), column), counts.column("n").to_numpy())
    return names, np.log(table / table.sum(0)).astype(np.float32)


def infer(like: np.ndarray, heads: np.ndarray, rounds: int = 8, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(language, its proportion) of each document, from its words' log likelihoods (words x languages).

    Expectation-maximisation fits all languages' proportions; their order gives nested language sets, each fitted
    again; the set with the best log likelihood less `penalty` * log(words) a further language is chosen. A
    document's sets grow until two in a row were no better, up to all languages.
    """
    docs, langs = len(heads), like.shape[1]
    sizes = np.diff(np.append(heads, len(like)))
    owner = np.repeat(np.arange(docs), sizes)
    top = like.max(1)
    p = np.exp(like - top[:, None])
    base = np.add.reduceat(top.astype(np.float64), heads)

    def fit(allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(n):
            r = share[owner] * p
            r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
            share = np.add.reduceat(r, heads, axis=0) / sizes[:, None]
        mix = np.maximum((share[owner] * p).sum(1), 1e-30)
        return share, np.add.reduceat(np.log(mix).astype(np.float64), heads) + base

    share, _ = fit(np.ones((docs, langs)), rounds)
    rank = np.argsort(-share, axis=1, kind="stable")
    best, chosen, worse = np.full(docs, -np.inf), share, np.zeros(docs, np.int64)
    for k in range(1, langs + 1):
        allowed = np.zeros((docs, langs))
        np.put_along_axis(allowed, rank[:, :k], 1.0, axis=1)
        fitted, score = fit(allowed, 4 if k > 1 else 0)
        score = score - penalty * (k - 1) * np.log(sizes + 1)
        better = (score > best) & (worse < 2)
        best = np.where(better, score, best)
        chosen = np.where(better[:, None], fitted, chosen)
        worse = np.where(better, 0, worse + 1)
        if (worse >= 2).all():
            break
    lang = chosen.argmax(1)
    return lang, np.clip(chosen[np.arange(docs), lang], 0, 1)


def identify(docs: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without its texts and languages, with lang_pred and score, the predicted language's proportion.

    Words are the units: a word's likelihood in a language is that of its byte n-grams. `und` (score 0) where the
    text is null or has no letter, or where nothing was labelled. Ties go to the first language in code point order.
    Texts that hold letters but no known n-gram get equal proportions. Other columns of `docs` are kept; a column
    named lang_pred or score is replaced. Repeated rows give equal rows; an empty table gives none.
    """
    names, table = train(labelled, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages

    def predict(batches):
        table = model.value
        for batch in batches:
            n = batch.num_rows
            lang, score = np.zeros(n, np.int64), np.zeros(n)
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_blocks(batch.column(0), BLOCK):
                if not len(data):
                    continue
                space = SPACE[data]
                begins = np.zeros(len(data), bool)
                begins[off[:-1][off[:-1] < off[1:]]] = True
                begins[1:] |= space[1:] & ~space[:-1]
                at = np.flatnonzero(begins)
                like = np.empty((len(at), table.shape[1]), np.float32)
                ok = _own(off)
                gram = _grams(data)
                for a in range(0, len(at), 1 << 18):  # so that a very long text needs no more memory than its words
                    b = min(len(at), a + (1 << 18))
                    x, y = at[a], at[b] if b < len(at) else len(data)
                    part = table[gram[x:y]]
                    part[~ok[x:y]] = 0
                    like[a:b] = np.add.reduceat(part, at[a:b] - x, axis=0)
                full = np.flatnonzero(np.diff(off))
                found, part = infer(like, np.searchsorted(at, off[:-1][full]))
                lang[lo + full], score[lo + full] = found, part
            known = letters & bool(names)
            pred = np.where(known, np.array([*names, "und"], object)[lang], "und") if n else np.zeros(0, object)
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.record_batch([*rest, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], [*kept, "lang_pred", "score"])

    kept = [c for c in docs.columns if c not in (text_col, lang_col, "lang_pred", "score")]
    text = F.lower(F.col(text_col).cast("string"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", lang_pred string, score double"
    fed = docs.select(text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"), *kept)
    return fed.mapInArrow(predict, schema.removeprefix(", "))
