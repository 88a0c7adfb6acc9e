"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's score is
the sum over all its segmentations into pieces, by a forward pass; a text's is the product over
its words (runs of letters, lower case, with the vocabulary's mark of a word's begin). Piece
probabilities come from expectation-maximisation over the words of a bounded sample of labelled
documents. All passes run over many words at once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import keyed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SAMPLE, ROUNDS, SMOOTH, UNKNOWN, LANGUAGES = 500, 3, 0.02, 1e-7, 200
BASE, CACHE = 0xC2B2AE3D27D4EB4F, 400_000
OUT = "doc_id long, held_out boolean, lang_pred string, score double"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray) -> K.Rolling:
    return K.Rolling(points.astype(np.uint64) + np.uint64(1), BASE)


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """All lower-case pieces of letters, with or without the mark."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    plain = lambda p: p.removeprefix(MARK)
    return sorted(p for p in pieces if p == MARK or (plain(p) and plain(p).lower() == plain(p) and all(unicodedata.category(c)[0] == "L" for c in plain(p))))


class Pieces:
    """Hash table of the vocabulary; find() gives len(vocabulary) for what is not in it."""

    def __init__(self, pieces: list[str]):
        points = _points("".join(pieces))
        ends = np.cumsum([len(p) for p in pieces])
        h = _hashes(points)(ends - [len(p) for p in pieces], ends)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.n = len(pieces)
        self.longest = max(len(p) for p in pieces)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
        return np.where(self.sorted[at] == h, self.order[at], self.n)


class Lattice:
    """The pieces of many words of similar length: piece[i][k] ends after character i and has k
    characters (rows: the words with i characters at least)."""

    def __init__(self, points: np.ndarray, start: np.ndarray, length: np.ndarray, pieces: Pieces):
        self.by = np.argsort(-length, kind="stable")
        self.start, self.length = start[self.by], length[self.by]
        self.longest, self.reach = int(self.length[0]), pieces.longest
        roll = _hashes(points)
        self.rows = [int(np.searchsorted(-self.length, -i, "right")) for i in range(self.longest + 1)]
        self.piece: list[list[np.ndarray]] = [[]]
        for i in range(1, self.longest + 1):
            s = self.start[: self.rows[i]] + i
            found = [pieces.find(roll(s - k, s)) for k in range(1, min(self.reach, i) + 1)]
            found[0] = np.where(found[0] == pieces.n, pieces.n + 1, found[0])  # any character can stand alone
            self.piece.append(found)

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each beginning (words by characters by languages, scaled) and the log
        of the scale at the end of each word; ``p`` has a row of zeros and one for an unknown
        character after the vocabulary's."""
        a = np.zeros((len(self.start), self.longest + 1, p.shape[1]))
        a[:, 0] = 1
        scale = np.zeros((len(self.start), p.shape[1]))
        for i in range(1, self.longest + 1):
            n = self.rows[i]
            for k, piece in enumerate(self.piece[i], 1):
                a[:n, i] += a[:n, i - k] * p[piece]
            if i % 16 == 0:
                top = a[:n, i]
                low = top < 1e-100
                factor = np.where(low, 1e100, 1.0)
                scale[:n] -= np.log(factor)
                a[:n, max(0, i + 1 - self.reach) : i + 1] *= factor[:, None]
        return a, scale

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, in the order given."""
        a, scale = self.forward(p)
        out = np.empty((len(self.start), p.shape[1]))
        out[self.by] = np.log(np.maximum(a[np.arange(len(self.start)), self.length], 1e-300)) + scale
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for one language. Both passes are scaled at every character
        (by c[i], so that the beginnings of i characters sum to 1 with those before), so words may have
        any length."""
        n, last = len(self.start), self.longest
        a, b, c = np.zeros((n, last + 1)), np.zeros((n, last + 1)), np.ones((n, last + 1))
        a[:, 0] = 1
        for i in range(1, last + 1):
            m = self.rows[i]
            gap = np.ones(m)  # the product of c between the two ends of a piece
            for k, piece in enumerate(self.piece[i], 1):
                a[:m, i] += a[:m, i - k] * gap * p[piece, 0]
                gap = gap / c[:m, i - k]
            c[:m, i] = np.maximum(a[:m, i], 1e-300)
            a[:m, i] /= c[:m, i]
        counts = np.zeros(len(p))
        b[np.arange(n), self.length] = 1
        w = weight[self.by]
        for i in range(last, 0, -1):
            m = self.rows[i]
            gap = 1 / c[:m, i]
            for k, piece in enumerate(self.piece[i], 1):
                through = p[piece, 0] * b[:m, i] * gap
                counts += np.bincount(piece, weights=a[:m, i - k] * through * w[:m], minlength=len(p))
                b[:m, i - k] += through
                gap = gap / c[:m, i - k]
        return counts


def lattices(points: np.ndarray, start: np.ndarray, length: np.ndarray, pieces: Pieces) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Words grouped by the power of two above their length, so that little is padded."""
    group = np.ceil(np.log2(np.maximum(length, 8))).astype(int)
    for g in np.unique(group):
        chosen = np.flatnonzero(group == g)
        step = max(1, (1 << 20) >> int(g))
        for k in range(0, len(chosen), step):
            part = chosen[k : k + step]
            yield part, Lattice(points, start[part], length[part], pieces)


def spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-case texts, begins and ends of their words, and the document of
    each word."""
    low = [(t or "").lower() for t in texts]
    points = _points("\n".join(low) + "\n")
    is_letter = letters()[points]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_letter.view(np.int8)])))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in low])
    return points, start, end, np.searchsorted(ends, start, "right")


def marked(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other, each behind the mark: code points, begins and lengths."""
    length = end - start + 1
    begin = np.append(0, np.cumsum(length))[:-1]
    at = np.arange(int(length.sum())) - np.repeat(begin - start + 1, length)
    out = points[np.maximum(at, 0)].copy()
    out[begin] = ord(MARK)
    return out, begin, length


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches):
        points, start, end, doc = spans(part.column("text").to_pylist())
        names = part.column("lang").to_pylist()
        counts: dict[tuple[str, str], int] = {}
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        for s, e, d in zip(start.tolist(), end.tolist(), doc.tolist(), strict=True):
            key = names[d], text[s:e]
            counts[key] = counts.get(key, 0) + 1
        keys = list(counts)
        yield K.as_batch(lang=pa.array([k[0] for k in keys], pa.string()), word=pa.array([k[1] for k in keys], pa.string()), n=pa.array(list(counts.values()), pa.int64()))


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str = VOCABULARY, languages: int = LANGUAGES) -> tuple[list[str], Pieces, np.ndarray]:
    """Languages, vocabulary and piece probabilities (pieces by languages, with the two rows that
    Lattice.forward wants), from about ``sample`` documents of each language that are not held
    out, chosen by a hash of doc_id. The ``languages`` with most documents are learned, so that
    dirty labels cannot make the model grow with the corpus."""
    known = docs.filter(~held_out()).filter("lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    names = vocabulary(path)
    pieces = Pieces(names)
    langs = sorted(sizes)
    p = np.zeros((pieces.n + 2, len(langs)))
    if not langs:
        return langs, pieces, p
    limit = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))))
    chosen = known.filter(F.col("lang").isin(langs)).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit[F.col("lang")] * (1 << 20)).select("lang", "text")
    words = chosen.mapInArrow(_sampled_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for k, lang in enumerate(langs):
        own = words.filter(pa.compute.equal(words.column("lang"), lang))
        text, n = own.column("word").to_pylist(), np.array(own.column("n").to_pylist(), float)
        order = sorted(range(len(text)), key=text.__getitem__)
        text, n = [text[i] for i in order], n[order] if len(order) else np.zeros(0)
        q = np.full((pieces.n + 2, 1), 1.0 / pieces.n)
        q[pieces.n :] = [[0.0], [UNKNOWN]]
        if text:
            points = _points("".join(MARK + t for t in text))
            length = np.array([len(t) + 1 for t in text])
            graph = list(lattices(points, np.cumsum(length) - length, length, pieces))
            for _ in range(rounds):
                counts = sum(g.expected(q, n[part]) for part, g in graph)[: pieces.n] + SMOOTH
                q[: pieces.n, 0] = counts / counts.sum()
        p[:, k] = q[:, 0]
    return langs, pieces, p


class Scorer:
    """Sums of word scores per text; scores of words met before are kept."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, p.shape[1]))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (texts by languages) and the number of words of each text."""
        points, start, end, doc = spans(texts)
        n = len(texts)
        out, count = np.zeros((n, self.p.shape[1])), np.bincount(doc, minlength=n)
        if not len(start):
            return out, count
        h, first, at = np.unique(_hashes(points)(start, end), return_index=True, return_inverse=True)
        logs = np.empty((len(h), self.p.shape[1]))
        place = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        met = self.keys[place] == h if len(self.keys) else np.zeros(len(h), bool)
        logs[met] = self.values[place[met]]
        new = np.flatnonzero(~met)
        if len(new):
            buffer, begin, length = marked(points, start[first[new]], end[first[new]])
            for part, graph in lattices(buffer, begin, length, self.pieces):
                logs[new[part]] = graph.logs(self.p)
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, self.p.shape[1]))
            keys, values = np.append(self.keys, h[new]), np.vstack([self.values, logs[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
        for k in range(self.p.shape[1]):
            out[:, k] = np.bincount(doc, weights=logs[at, k], minlength=n)
        return out, count


def identify(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str = VOCABULARY) -> DataFrame:
    """One row per document: whether it is held out from training, the language and its posterior
    among the learned ones (equal priors).

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Rows with a
    null doc_id are left out; of rows that share a doc_id the one with the greatest (text, lang)
    stays; other columns are not read.
    """
    rows = keyed(docs, "doc_id", "text", "lang")
    langs, pieces, p = train(rows, sample, rounds, path)
    names = np.array([*langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pieces, p)
        for part in K.slices(batches):
            logs, count = scorer(part.column("text").to_pylist())
            some = (count > 0) & bool(langs)
            best, score = np.full(len(count), len(langs)), np.zeros(len(count))
            if langs:
                best = np.where(some, logs.argmax(axis=1), len(langs))
                score = np.where(some, 1 / np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -700)).sum(axis=1), 0.0)
            yield K.as_batch(doc_id=part.column("doc_id"), held_out=part.column("held_out"), lang_pred=pa.array(names[best].tolist(), pa.string()), score=pa.array(score, pa.float64()))

    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, OUT)
