"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed to ``BUCKETS`` embedding rows;
the words of a window are averaged and a softmax of two classes is read off. Embeddings,
softmax weights and bias are trained together in numpy by full-batch Adam. Labels are of whole
documents and a few words decide them, so a document is scored by its most toxic window of
``WINDOW`` words; training first spreads a document's label over all its windows, then follows
the deciding window. Misspelt and inflected words share n-grams with the ones learnt.

The classifier is fitted on at most ``TRAIN_DOCS`` labelled documents (clean, toxic), those with
the least hashes of their ids; class weights restore the labelled share of toxic documents. Scoring
needs one number per bucket and covers every whole text.

Edge cases: null, empty and wordless texts are one empty window (their score is the bias);
without labelled documents of both classes every score is the labelled share of toxic rows, 0 if
there is none; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.wordhash import Words, blocks, mix

TRAIN_DOCS = {0: 6000, 1: 3000}
BUCKETS = 2**18
SIZE = 12
WINDOW = 8
NGRAMS = (3, 4, 5, 6)
LEAST_DOCS = 6  # buckets in fewer training documents are not learnt
WARM_ROUNDS, ROUNDS, RATE, DECAY = 40, 120, 0.05, 2e-5
FOLLOWED, REFRESH = 8, 30  # windows of a text that may decide it, chosen anew every so many rounds
CACHE_WORDS = 1_000_000
_U = np.uint64
_TO_SPACE = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def _words(texts: list[str]) -> tuple[Words, np.ndarray, list[str], np.ndarray]:
    """Word positions of lower-cased texts, code of each word, the distinct words and their hashes."""
    w = Words([t.lower().encode().translate(_TO_SPACE) for t in texts])
    codes, found = pd.factorize(w.hash)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    data = w.data.tobytes()
    return w, codes, [data[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], found


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word, word by word, and their number."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(_U)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    past = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    rows, owners = [], []
    h = np.zeros(len(points), _U)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: max(0, len(points) - n + 1)] * _U(0x9E3779B97F4A7C15) + mix(points[n - 1 :] + _U(1))
        if n in NGRAMS:
            inside = np.arange(len(h)) + n <= past[: len(h)]
            rows.append(mix(h[inside] + _U(n)))
            owners.append(owner[: len(h)][inside])
    start = np.cumsum(size) - size
    whole = np.add.reduceat(mix(points) * _offsets(size), start) if len(words) else h[:0]
    rows.append(mix(whole))
    owners.append(np.arange(len(words)))
    row, owner = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (row[order] % _U(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


def _offsets(size: np.ndarray) -> np.ndarray:
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return mix(at.astype(_U) + _U(7)) | _U(1)


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window of each word, first window of each text (one more at the end); a text without words has one window."""
    counts = np.diff(first)
    number = np.maximum(1, -(-counts // WINDOW))
    begin = np.append(0, np.cumsum(number))
    within = np.arange(int(counts.sum())) - np.repeat(first[:-1] - first[0], counts)
    return np.repeat(begin[:-1], counts) + within // WINDOW, begin, number


class Model:
    """Logits of the two classes for each embedding row, and the bias."""

    def __init__(self, row_logits: np.ndarray, bias: np.ndarray):
        self.row_logits, self.bias = row_logits.astype(np.float32), bias
        self.cache: dict[int, float] = {}

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of the toxic class of each text's most toxic window."""
        w, codes, words, found = _words(texts)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        hashes = found.tolist()
        new = [k for k, h in enumerate(hashes) if h not in self.cache]
        if new:
            row, number = subwords([words[k] for k in new])
            edge = self.row_logits[row, 1] - self.row_logits[row, 0]
            mean = np.add.reduceat(edge.astype(np.float64), np.cumsum(number) - number) / number
            self.cache.update(zip([hashes[k] for k in new], mean.tolist(), strict=True))
        value = np.fromiter(map(self.cache.__getitem__, hashes), np.float64, len(hashes))
        window, begin, _ = _windows(w.first)
        logit = np.bincount(window, value[codes], minlength=int(begin[-1])) / WINDOW + (self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.maximum.reduceat(logit, begin[:-1]))) if len(texts) else logit


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model:
    """Joint training of embeddings and softmax on labelled texts with row weights."""
    rng = np.random.default_rng(seed)
    hashes, counts, spelt = [], [], {}
    for a, b in blocks([len(t) for t in texts]):  # block by block, as hashing takes many times a block's size
        w, part, words, found = _words(texts[a:b])
        spelt.update(zip(found.tolist(), words, strict=True))
        hashes.append(found[part])
        counts.append(np.diff(w.first))
    codes, found = pd.factorize(np.concatenate(hashes))
    codes, counts = codes.astype(np.int32), np.concatenate(counts)
    words = [spelt[h] for h in found.tolist()]
    del hashes, spelt
    parts = [subwords(words[a : a + 20_000]) for a in range(0, len(words), 20_000)]
    row = np.concatenate([r.astype(np.int32) for r, _ in parts] or [np.zeros(0, np.int32)])
    number = np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)])
    del parts
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), number)
    window, begin, many = _windows(np.append(0, np.cumsum(counts)))
    window = window.astype(np.int32)
    doc = np.repeat(np.arange(len(texts)), counts)
    # documents that hold each embedding row
    pair = np.unique(doc * len(words) + codes) if len(codes) else np.zeros(0, np.int64)
    held = np.bincount(row, np.bincount(pair % max(1, len(words)), minlength=len(words))[word_of], minlength=BUCKETS)
    del doc, pair
    live = held >= LEAST_DOCS
    on = live[row]
    row, word_of = row[on], word_of[on]
    rows = np.flatnonzero(live & (np.bincount(row, minlength=BUCKETS) > 0))
    row = np.searchsorted(rows, row).astype(np.int32)
    share = (1.0 / number[word_of]).astype(np.float32)  # a word is the mean of all its n-grams, learnt or not
    emb = rng.normal(0, 0.1, (len(rows), SIZE))
    top = rng.normal(0, 0.3, (SIZE, 2))
    bias = np.log(np.array([weight[toxic == 0].sum(), weight[toxic == 1].sum()]) / weight.sum())
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, top, bias)]
    of_window = np.repeat(np.arange(len(texts)), many)
    sides = np.array([-1.0, 1.0])

    def edges(codes: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
        row_logits = emb @ (top @ sides)
        word_logits = np.bincount(word_of, row_logits[row] * share, minlength=len(words))
        return np.bincount(window, word_logits[codes], minlength=n) / WINDOW + bias @ sides

    use, place, text = codes, window, of_window  # words, their windows and the windows' texts, as far as they are looked at
    for step in range(1, WARM_ROUNDS + ROUNDS + 1):
        late = step - WARM_ROUNDS - 1
        if late >= 0 and late % REFRESH == 0:
            edge = edges(codes, window, len(of_window))
            order = np.lexsort((-edge, of_window))
            chosen = np.zeros(len(edge), bool)
            chosen[order[np.arange(len(edge)) - np.repeat(begin[:-1], many) < FOLLOWED]] = True
            on = chosen[window]
            use, place, text = codes[on], (np.cumsum(chosen) - 1)[window[on]], of_window[chosen]
        edge = edges(use, place, len(text))
        pull = (1 / (1 + np.exp(-edge)) - toxic[text]) * weight[text] / weight.sum()
        if late < 0:
            pull /= many[text]
        else:
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            best = np.repeat(np.maximum.reduceat(edge, first), np.diff(np.append(first, len(text))))
            decides = np.flatnonzero(edge == best)
            _, one = np.unique(text[decides], return_index=True)
            mask = np.zeros(len(edge))
            mask[decides[one]] = 1
            pull = pull * mask
        on_word = np.bincount(use, pull[place], minlength=len(words)) / WINDOW
        on_row = np.bincount(row, on_word[word_of] * share, minlength=len(rows))
        grads = (np.outer(on_row, top @ sides) + DECAY * emb, np.outer(emb.T @ on_row, sides), pull.sum() * sides)
        for p, g, s in zip((emb, top, bias), grads, state, strict=True):
            s[0] += 0.1 * (g - s[0])
            s[1] += 0.001 * (g * g - s[1])
            p -= RATE * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-12)
    out = np.zeros((BUCKETS, 2))
    out[rows] = emb @ top
    return Model(out, bias)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: dict[int, int] = TRAIN_DOCS) -> Model | float:
    """A model fitted on labelled documents, or the share of toxic rows where one class is missing."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).alias("y"))
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return 1.0 if 1 in counts else 0.0
    picked = [known.filter(F.col("y") == c).orderBy(F.xxhash64("_id"), "_id").limit(train_docs[c]) for c in (0, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        sample = pd.concat(parts) if parts else pd.DataFrame({"_t": [], "y": []})
        y = sample["y"].to_numpy(dtype=np.int64)
        found = np.bincount(y, minlength=2)
        if not found.all():
            return  # labels of one class have no documents
        per_class = np.array([counts[0] / found[0], counts[1] / found[1]])
        texts = sample["_t"].tolist()
        del sample
        m = fit(texts, y.astype(float), per_class[y])
        yield pd.DataFrame({"logits": [m.row_logits.tobytes()], "clean": [m.bias[0]], "toxic": [m.bias[1]]})

    # the ids of the bounded sample are sent to the documents; the sample is fitted in one task and only the model comes back
    sample = own.join(F.broadcast(picked[0].unionByName(picked[1])), "_id").select("_t", "y").repartition(1)
    made = sample.mapInPandas(run, "logits BINARY, clean DOUBLE, toxic DOUBLE").first()
    if made is None:
        return 0.0
    return Model(np.frombuffer(made["logits"], np.float32).reshape(-1, 2), np.array([made["clean"], made["toxic"]]))


def score(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    kind = docs.schema[doc_id].dataType
    if isinstance(model, float):
        return docs.select(doc_id, F.lit(model).alias("score"))
    own = docs.select(F.col(doc_id).cast("string").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))  # a null would turn the longs of a batch into doubles
    sent = docs.sparkSession.sparkContext.broadcast((model.row_logits, model.bias))  # BUCKETS x 2 numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for b in batches:
            texts = b["_t"].tolist()
            scores = [m.score(texts[x:y]) for x, y in blocks([len(t) for t in texts])]
            yield pd.DataFrame({"_id": b["_id"], "score": np.concatenate(scores) if scores else []})

    return own.mapInPandas(run, "_id STRING, score DOUBLE").select(F.col("_id").cast(kind).alias(doc_id), "score")
