"""Quality classifier by co-training.

Two logistic models see one document each their own way: the content view the words and beginnings of words it holds, the
metadata view what its record and layout tell (language, source, lengths, lines, symbols,
repetition). Both start from the labelled sample; in each round both views score all documents, and
each view labels the unlabelled documents that it is surest of, of the whole corpus, from which the
other view learns unless it contradicts. A part of the labelled
sample that neither view has seen calibrates the views and combines them; the combination
scores every document.

The views learn from a bounded number of documents: ``labelled``, chosen by a hash of doc_id, and
``per_round`` pseudo-labels for each view and round. The texts are read once for the vocabulary of
the labelled documents and once for the features of all, which are kept as a table (places in the
vocabulary, and numbers); the rounds and the scoring read that table. Scores are a table too, from
which the surest are taken. A task trains both views; the driver has the ids and labels of those
documents, the vocabulary and the model, and never their features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import cut, keyed

LABELLED, ROUNDS, PER_ROUND = 8000, 3, 300
OUT = "doc_id long, content_score double, metadata_score double, score double, kept boolean"
_SYMBOL, _DIGIT, _UPPER = (np.isin(np.arange(256), list(s)) for s in (b"#*$%&|<>{}\\^~=_@", b"0123456789", bytes(range(65, 91))))
_HASHED = 128


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    if not len(flags):
        return np.zeros(len(off) - 1)
    sums = np.add.reduceat(flags, np.minimum(off[:-1], len(flags) - 1), dtype=np.int32)
    return np.where(off[1:] > off[:-1], sums, 0).astype(float)


def _distinct_share(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values of each document, compared by 44 bits, over all its values."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    order = np.sort((doc << np.uint64(44)) | (values[first[0] : first[-1]] >> np.uint64(20)))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    own = np.bincount((order[new] >> np.uint64(44)).astype(np.int64), minlength=len(n))
    return np.where(n > 0, own / np.maximum(n, 1), 1.0)


def _metadata(words: K.Words, h: np.ndarray) -> np.ndarray:
    n, size = words.count.astype(float), np.diff(words.off).astype(float)
    least = np.maximum(n, 1)
    lines = _per_doc(words.buf == 10, words.off) + 1
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[words.first[:-1][words.first[:-1] < len(h)]] = False
    triples = np.flatnonzero(words.room() >= 3)
    triple = K.Rolling(h, K.WORD)(triples, triples + 3)
    numeric = [
        np.log1p(n), np.log1p(lines), np.log1p(n / lines), _per_doc(~K._SPACE[words.buf], words.off) / least,
        *(_per_doc(t[words.buf], words.off) / np.maximum(size, 1) for t in (_SYMBOL, _DIGIT, _UPPER)),
        _per_doc(same, words.first) / least, _distinct_share(triple, np.searchsorted(triples, words.first)), _distinct_share(h, words.first),
    ]
    return np.column_stack(numeric)


def _hashed(part: pa.RecordBatch) -> np.ndarray:
    """A place for the language and one for the source."""
    place = lambda v: crc32((v or "").encode()) % _HASHED
    return np.column_stack([[place(v) for v in part.column("lang").to_pylist()], [_HASHED + place(v) for v in part.column("source").to_pylist()]]).astype(np.int32).reshape(-1, 2)


def _whole(meta: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """All values of the metadata view: the numbers, and a one at each place."""
    ones = np.zeros((len(meta), 2 * _HASHED))
    ones[np.arange(len(meta))[:, None], hashed] = 1
    return np.column_stack([meta, ones])


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _views(part: pa.RecordBatch) -> tuple[K.Words, list[np.ndarray], np.ndarray]:
    """The words, their hashes and those of their beginnings of 4 and 5 bytes, the metadata."""
    words = K.Words(part.column("text"), lower=True)
    roll = K.Rolling(words.buf.astype(np.uint64) + np.uint64(1), K.BYTE)
    h = roll(words.start, words.end)
    stems = [K.mix(roll(words.start, np.minimum(words.end, words.start + k)) + np.uint64(k)) for k in (4, 5)]
    return words, [h, *stems], _metadata(words, h)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches):
        words, h, _ = _views(part)
        own = [np.unique(np.concatenate([x[a:b] for x in h])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield K.as_batch(words=pa.array([K.signed(w) for w in own], pa.list_(pa.int64())))


_PLACED = "doc_id long, n long, words array<int>, meta array<double>, hashed array<int>"


def _placed_features(vocabulary: np.ndarray):
    """What both views see of each document: the ascending places in ``vocabulary`` of what it
    holds, its numbers, and the places of its language and source."""
    maybe = np.zeros(1 << 20, bool)
    maybe[vocabulary >> np.uint64(44)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            words, kinds, meta = _views(part)
            n, total = part.num_rows, max(len(vocabulary), 1)
            found = [np.zeros(0, np.int64)]
            for hashes in kinds if len(vocabulary) else ():
                some = np.flatnonzero(maybe[hashes >> np.uint64(44)])  # 20 bits tell most others
                at = np.minimum(np.searchsorted(vocabulary, hashes[some]), len(vocabulary) - 1)
                good = vocabulary[at] == hashes[some]
                found.append((np.searchsorted(words.first, some[good], "right") - 1) * total + at[good])
            pair = np.unique(np.concatenate(found))
            offsets = np.searchsorted(pair, np.arange(n + 1) * total).astype(np.int32)
            yield K.as_batch(
                doc_id=part.column("doc_id").cast(pa.int64()), n=pa.array(words.count, pa.int64()), words=pa.ListArray.from_arrays(offsets, (pair % total).astype(np.int32)),
                meta=pa.array(list(meta), pa.list_(pa.float64())), hashed=pa.array(list(_hashed(part)), pa.list_(pa.int32())),
            )

    return run


def _descend(loss_gradient, x: np.ndarray, rounds: int) -> np.ndarray:
    """Adam on the full batch."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        g = loss_gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def _sums(index: np.ndarray, size: int, weight, step: int = 1 << 17) -> np.ndarray:
    """Weights added up by index, in order; ``weight`` gives those of a slice, so that few of them are
    held at once."""
    out = np.zeros(size)
    for k in range(0, len(index), step):
        part = slice(k, k + step)
        np.add.at(out, index[part].astype(np.intp), weight(part))
    return out


class Docs:
    """Lists of vocabulary places, one after the other."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size

    def __len__(self) -> int:
        return len(self.size)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)

    def take(self, rows) -> Docs:
        rows = np.asarray(rows, int)
        first = np.append(0, np.cumsum(self.size))
        parts = [self.flat[first[i] : first[i + 1]] for i in rows]
        return Docs(np.concatenate(parts) if parts else self.flat[:0], self.size[rows])

    def __add__(self, other: Docs) -> Docs:
        return Docs(np.append(self.flat, other.flat), np.append(self.size, other.size))


def _read(rows: pa.RecordBatch | pa.Table) -> tuple[Docs, np.ndarray, np.ndarray]:
    """Rows of the feature table: the words, the numbers and the places."""
    flat = lambda c: pa.chunked_array([rows.column(c)] if isinstance(rows, pa.RecordBatch) else rows.column(c).chunks, rows.schema.field(c).type).combine_chunks()
    lists = flat("words")
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int)
    meta, hashed = (flat(c).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) for c in ("meta", "hashed"))
    return Docs(lists.flatten().to_numpy(zero_copy_only=False), size), meta, hashed


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Head:
    """Logistic model of the presence of the words that tell the classes apart (chi-square over
    ``least``, found in ``often`` documents at least). Documents are ascending places in a vocabulary
    of ``total`` words."""

    def __init__(self, total: int, docs: Docs, y: np.ndarray, least: float = 30.0, often: int = 5):
        n, good = len(y), y.sum()
        at, of = docs.flat, docs.owner()
        has = _sums(at, total, lambda k: 1.0)
        a = _sums(at, total, lambda k: y[of[k]])
        b, c, d = has - a, good - a, (n - good) - (has - a)
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
        pick = (has >= often) & (np.nan_to_num(chi) >= least)
        use = pick[at]
        at, of = (np.cumsum(pick) - 1).astype(np.int32)[at[use]], of[use]
        size = int(pick.sum())

        def gradient(x):
            err = _sigmoid(_sums(of, n, lambda k: x[at[k]]) + x[size]) - y
            return np.append(_sums(at, size, lambda k: err[of[k]]) + 0.02 * x[:size], err.sum()) / n

        self.x = _descend(gradient, np.zeros(size + 1), 300)
        self.dense = np.zeros(total)
        self.dense[pick] = self.x[:size]

    def of(self, docs: Docs) -> np.ndarray:
        return _sums(docs.owner(), len(docs), lambda k: self.dense[docs.flat[k]]) + self.x[-1]


class Content:
    """A head for each reason to reject a document, quality and toxicity; a document is as good
    as its worse reason. Unknown labels are NaN; a reason that has one class only is left out."""

    def __init__(self, total: int, docs: Docs, labels: np.ndarray):
        self.heads = []
        for y in labels.T:
            known = np.flatnonzero(~np.isnan(y))
            if len(known) and y[known].min() < y[known].max():
                self.heads.append(Head(total, docs.take(known), y[known]))

    def of(self, docs: Docs) -> np.ndarray:
        return np.min([h.of(docs) for h in self.heads], axis=0)


class Metadata:
    """Logistic model of standardised values and their squares."""

    def __init__(self, meta: np.ndarray, y: np.ndarray):
        self.mean, self.std = meta.mean(axis=0), meta.std(axis=0) + 1e-6
        z = self._wide(meta)
        gradient = lambda x: (z.T @ (_sigmoid(z @ x) - y)) / len(y) + 1e-4 * x
        self.x = _descend(gradient, np.zeros(z.shape[1]), 400)

    def _wide(self, meta: np.ndarray) -> np.ndarray:
        n, k = meta.shape
        wide = np.ones((n, 2 * k - 2 * _HASHED + 1))
        z = np.subtract(meta, self.mean, out=wide[:, :k])
        z /= self.std
        np.clip(z, -8, 8, out=z)
        np.square(z[:, : -2 * _HASHED], out=wide[:, k:-1])
        return wide

    def logit(self, meta: np.ndarray) -> np.ndarray:
        return self._wide(meta) @ self.x

    def of(self, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The same from numbers and places, without a column for each place."""
        k = numbers.shape[1]
        z = np.clip((numbers - self.mean[:k]) / self.std[:k], -8, 8)
        none, one = (np.clip((x - self.mean[k:]) / self.std[k:], -8, 8) * self.x[k : k + 2 * _HASHED] for x in (0, 1))
        return np.column_stack([z, z**2]) @ np.append(self.x[:k], self.x[-1 - k : -1]) + none.sum() + (one - none)[places].sum(axis=1) + self.x[-1]


def _scored(content: Content, metadata: Metadata):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            docs, numbers, places = _read(batch)
            yield K.as_batch(doc_id=batch.column("doc_id"), content=content.of(docs), metadata=metadata.of(numbers, places))

    return run


def surest(scores: DataFrame, view: int, share: float, taken: list[int], per_round: int) -> dict[int, float]:
    """The documents that ``view`` labels for the other one, with their labels: the surest beyond
    logits of 2 either way that the other view does not contradict and has not got yet."""
    own, other = ("content", "metadata") if view == 0 else ("metadata", "content")
    out: dict[int, float] = {}
    for sign, label, part in ((-1, 1.0, share), (1, 0.0, 1 - share)):
        sure = scores.filter((sign * F.col(own) < -2) & (sign * F.col(other) < 0) & ~F.col("doc_id").isin(taken))
        found = sure.orderBy(sign * F.col(own), "doc_id").limit(max(1, int(per_round * part))).collect()
        out.update((r.doc_id, label) for r in found)
    return out


class CoTrained:
    """Both views as trained on the labelled documents and what each has received (``given``, labels by
    row of ``docs``), calibrated on the documents that neither has learned from. What the
    metadata rejects is of low quality; it cannot tell toxicity."""

    def __init__(self, total: int, docs: Docs, meta: np.ndarray, train: np.ndarray, held: np.ndarray, labels: np.ndarray, held_labels: np.ndarray, given: list[dict[int, float]]):
        more = [(1.0, 1.0) if good else (0.0, np.nan) for good in given[0].values()]
        self.content = Content(total, docs.take([*train, *given[0]]), np.vstack([labels, np.array(more).reshape(-1, 2)]))
        self.metadata = Metadata(meta[[*train, *given[1]]], np.append(labels.min(axis=1), list(given[1].values())))
        both, y = self._joined(self.content.of(docs.take(held)), self.metadata.logit(meta[held])), held_labels.min(axis=1)
        ones = np.ones(len(y))
        fit = lambda z: _descend(lambda x: (z.T @ (_sigmoid(z @ x) - y)) / len(y) + 1e-4 * x, np.zeros(z.shape[1]), 500)
        self.calibration = [fit(np.column_stack([both[:, k], ones])) for k in (0, 1)]
        self.mixture = fit(np.column_stack([both, ones]))

    @staticmethod
    def _joined(content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        c, m = np.clip(content, -8, 8), np.clip(metadata, -8, 8)
        return np.column_stack([c, m, np.minimum(c, m)])

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        both = self._joined(content, metadata)
        views = [_sigmoid(both[:, k] * a + b) for k, (a, b) in enumerate(self.calibration)]
        return [*views, _sigmoid(both @ self.mixture[:3] + self.mixture[3])]


def _chosen(docs: DataFrame, ids: list[int]) -> DataFrame:
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")


def _vocabulary(docs: DataFrame, ids: list[int], often: int = 5) -> np.ndarray:
    """The hashes that ``often`` of the given documents have, ascending."""
    words = _chosen(docs, ids).mapInArrow(_features, "words array<long>").select(F.explode("words").alias("word"))
    found = words.groupBy("word").count().filter(F.col("count") >= often).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().view(np.uint64))


def _trained(rows: DataFrame, total: int, ids: np.ndarray, known: np.ndarray, given: list[dict[int, float]]) -> CoTrained:
    """The model, from the features of the labelled documents and of those that were received. Every third
    labelled document is left for the calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        (docs, numbers, places), at = _read(table), {i: k for k, i in enumerate(table.column("doc_id").to_pylist())}
        del table
        own, held = np.array([at[i] for i in ids.tolist()]), np.arange(len(ids)) % 3 == 2
        model = CoTrained(total, docs, _whole(numbers, places), own[~held], own[held], known[~held], known[held], [{at[i]: label for i, label in g.items()} for g in given])
        yield K.as_batch(model=[pickle.dumps(model)])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first().model)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> tuple[CoTrained | float, DataFrame]:
    """The model, or the share of good documents where the labels name fewer than 20 documents
    or one class only, and the table of all documents' features. Good is quality 1 and not toxic; a null quality is no label; of repeated
    labels the worst counts. The content view's vocabulary is that of the labelled documents."""
    judged = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.expr("if(quality = 1, 1, 0)")).alias("fine"), F.min(F.expr("if(coalesce(toxic, 0) = 0, 1, 0)")).alias("civil"))
    judged = cut(judged.join(docs.select("doc_id"), "doc_id", "left_semi"))
    sample = {r.doc_id: (r.fine, r.civil) for r in judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()}
    known = np.array(list(sample.values()), float).reshape(-1, 2)
    if len(known) < 20 or known.min(axis=1).min() == known.min(axis=1).max():
        return float(known.min(axis=1).mean()) if len(known) else 1.0, cut(docs.mapInArrow(_placed_features(np.zeros(0, np.uint64)), _PLACED))
    vocabulary, ids = _vocabulary(docs, list(sample)), np.array(list(sample))
    features, total = cut(docs.mapInArrow(_placed_features(vocabulary), _PLACED)), len(vocabulary)
    seen = ["doc_id", "words", "meta", "hashed"]
    rows = cut(_chosen(features, list(sample)).select(*seen))
    share = float(known[np.arange(len(ids)) % 3 != 2].min(axis=1).mean())
    received: set[int] = set()  # by any view
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has received
    model = _trained(rows, total, ids, known, given)
    for _ in range(rounds):
        scores = cut(features.mapInArrow(_scored(model.content, model.metadata), "doc_id long, content double, metadata double").join(judged, "doc_id", "left_anti"))
        new = [surest(scores, view, share, list(given[1 - view]), per_round) for view in (0, 1)]
        if not any(new):
            break
        for view in (0, 1):
            given[1 - view].update(new[view])
        wanted = sorted((set(new[0]) | set(new[1])) - received)
        if wanted:
            received.update(wanted)
            rows = rows.union(cut(_chosen(features, wanted).select(*seen)))
        model = _trained(rows, total, ids, known, given)
    return model, features


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """One row per document: the calibrated scores of both views, the combined score, and
    whether it reaches ``threshold``.

    A text that is null or has no word scores 0 and is not kept. Without usable labels every
    other document gets the share of good labels (1 if there is none). Rows with a null doc_id
    are left out; of rows that share a doc_id the one with the greatest (text, lang, source)
    stays; other columns are not read.
    """
    model, features = fit(keyed(docs, "doc_id", "text", "lang", "source"), labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            some = batch.column("n").to_numpy() > 0
            if isinstance(model, CoTrained):
                docs, numbers, places = _read(batch)
                scores = model.scores(model.content.of(docs), model.metadata.of(numbers, places))
            else:
                scores = [np.full(batch.num_rows, model)] * 3
            content, metadata, score = (np.where(some, s, 0.0) for s in scores)
            yield K.as_batch(doc_id=batch.column("doc_id"), content_score=content, metadata_score=metadata, score=score, kept=(score >= threshold) & some)

    return features.mapInArrow(run, OUT)
