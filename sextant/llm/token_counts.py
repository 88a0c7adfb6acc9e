"""Token counts that follow edits.

A document's pre-tokens are grouped into leaves, and a segment tree over the leaves holds the
sums of characters, pre-tokens and tokens below each node. An edit re-encodes only the leaves
that it touches and what is needed on either side: on the left from the last leaf that begins two
characters before the edit or earlier (a pre-token's end depends on no more than the two
characters after it), on the right up to the first old leaf boundary at which the new
pre-tokens fall into step, since a match depends on nothing to its left. Then the sums on the
paths to the root are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import _tokens as K
from sextant.llm._shared import keyed

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the pre-token pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, CACHE = 32, 400_000


class Encoder:
    """Pre-tokens of a text and the number of tokens of each, kept for those met before."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        self.find = regex.compile(PATTERN).findall
        self.match = regex.compile(PATTERN).finditer
        self.bpe = tiktoken.Encoding("sextant", pat_str=PATTERN, mergeable_ranks=dict(ranks), special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.bpe.encode_ordinary(piece))
        return n


def read_ranks(path: str = RANKS) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


class Tree:
    """Row 1 of ``sums`` is the root, rows ``width`` on are the leaves; columns are characters,
    pre-tokens and tokens."""

    def __init__(self, leaves: np.ndarray):
        self.build(np.asarray(leaves, np.int64).reshape(-1, 3))

    def build(self, leaves: np.ndarray) -> None:
        self.n = len(leaves)
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        self.sums[self.width : self.width + self.n] = leaves
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def of(cls, text: str, encoder: Encoder) -> Tree:
        return cls(leaves_of(encoder.find(text), encoder))

    @property
    def total(self) -> np.ndarray:
        return self.sums[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one beyond the end), and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[node, 0])
            if char - begin >= left and self.sums[node + 1, 1]:
                begin, node = begin + left, node + 1
        return node - self.width, begin

    def put(self, first: int, leaves: np.ndarray) -> None:
        """New leaves in place of as many, and the sums above them."""
        a, b = self.width + first, self.width + first + len(leaves)
        self.sums[a:b] = leaves
        a, b = a // 2, (b - 1) // 2 + 1
        while a:
            self.sums[a:b] = self.sums[2 * a : 2 * b : 2] + self.sums[2 * a + 1 : 2 * b : 2]
            a, b = a // 2, (b - 1) // 2 + 1

    def edit(self, text: str, at: int, deleted: int, inserted: str, encoder: Encoder) -> tuple[str, int]:
        """The text after the edit, and how many pre-tokens were encoded for it."""
        at = min(max(at, 0), len(text))
        deleted = min(max(deleted, 0), len(text) - at)
        new = text[:at] + inserted + text[at + deleted :]
        if not self.n:
            self.build(leaves_of(encoder.find(new), encoder))
            return new, int(self.total[1])
        shift, end = len(inserted) - deleted, at + deleted
        first, begin = self.leaf_at(max(at - 2, 0))
        last, stop = first, begin + int(self.sums[self.width + first, 0])  # old end of the leaves that go
        pieces, here, done = [], begin, False
        for found in encoder.match(new, begin):
            while last + 1 < self.n and (stop < end or stop + shift < here):
                last += 1
                stop += int(self.sums[self.width + last, 0])
            if here == stop + shift and stop >= end and here > begin:
                done = True
                break
            pieces.append(found.group())
            here = found.end()
        if not done:
            last = self.n - 1
        old = last - first + 1
        if old and len(pieces) >= old and len(pieces) <= 4 * LEAF * old:
            cuts = [len(pieces) * k // old for k in range(old + 1)]
            self.put(first, np.array([leaf(pieces[a:b], encoder) for a, b in zip(cuts, cuts[1:])], np.int64))
        else:
            leaves = self.sums[self.width : self.width + self.n]
            self.build(np.vstack([leaves[:first], leaves_of(pieces, encoder), leaves[last + 1 :]]))
        return new, len(pieces)

    def to_bytes(self) -> bytes:
        return self.sums[self.width : self.width + self.n].astype("<i4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        return cls(np.frombuffer(data, "<i4").astype(np.int64))


def leaf(pieces: list[str], encoder: Encoder) -> tuple[int, int, int]:
    return sum(map(len, pieces)), len(pieces), sum(map(encoder.count, pieces))


def leaves_of(pieces: list[str], encoder: Encoder) -> np.ndarray:
    return np.array([leaf(pieces[i : i + LEAF], encoder) for i in range(0, len(pieces), LEAF)], np.int64).reshape(-1, 3)


def _build(ranks, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks)
        for part in K.slices(batches):
            trees = [Tree.of(t or "", encoder) for t in part.column("text").to_pylist()]
            yield K.as_batch(
                doc_id=part.column("doc_id"), text=part.column("text"), tree=pa.array([t.to_bytes() for t in trees], pa.binary()),
                n_pretokens=pa.array([int(t.total[1]) for t in trees], pa.int64()), n_tokens=pa.array([int(t.total[2]) for t in trees], pa.int64()), **{c: part.column(c) for c in extra},
            )

    return run


TREES = "doc_id long, text string, tree binary, n_pretokens long, n_tokens long"
EDITS = "array<struct<seq: int, at: int, deleted: int, inserted: string>>"


def trees(docs: DataFrame, ranks_path: str = RANKS, edits: str | None = None) -> DataFrame:
    """TREES of every whole text. A null or empty text has no leaf and counts 0; rows with a null
    doc_id are left out; of rows that share a doc_id the one with the greatest text stays; other
    columns are not read, but for a column of ``edits``, which is carried along."""
    extra = [edits] if edits else []
    rows = keyed(docs, "doc_id", "text", *extra)
    return rows.mapInArrow(_build(read_ranks(ranks_path), extra), TREES + "".join(f", {c} {EDITS}" for c in extra))


def _apply(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks)
        for part in K.slices(batches):
            texts, blobs, pre, n, again, before = [], [], [], [], [], []
            for text, blob, edits in zip(*(part.column(c).to_pylist() for c in ("text", "tree", "edits")), strict=True):
                encoded = 0
                before.append(int(np.frombuffer(blob, "<i4").reshape(-1, 3)[:, 2].sum()))
                if edits:
                    tree, text = Tree.from_bytes(blob), text or ""
                    for e in sorted(edits, key=lambda e: (e["seq"] or 0, e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")):
                        text, k = tree.edit(text, e["at"] or 0, e["deleted"] or 0, e["inserted"] or "", encoder)
                        encoded += k
                    blob, total = tree.to_bytes(), tree.total
                    pre.append(int(total[1]))
                    n.append(int(total[2]))
                else:
                    leaves = np.frombuffer(blob, "<i4").reshape(-1, 3).sum(axis=0)
                    pre.append(int(leaves[1]))
                    n.append(int(leaves[2]))
                texts.append(text)
                blobs.append(blob)
                again.append(encoded)
            yield K.as_batch(doc_id=part.column("doc_id"), text=pa.array(texts, pa.string()), tree=pa.array(blobs, pa.binary()), n_pretokens=pa.array(pre, pa.int64()), n_tokens=pa.array(n, pa.int64()), n_before=pa.array(before, pa.int64()), n_reencoded=pa.array(again, pa.int64()))

    return run


def edited(with_edits: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """TREES, the tokens before and the pre-tokens encoded again, after the edits in the column ``edits`` (EDITS), by ascending seq.
    Places count characters of the text as it then is and are moved into it where they lie
    beyond; null fields count as 0 or an empty text."""
    rows = with_edits.select("doc_id", "text", "tree", "edits")
    return rows.mapInArrow(_apply(read_ranks(ranks_path)), TREES + ", n_before long, n_reencoded long")


def apply_edits(tree_rows: DataFrame, edits: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``edited`` with a table of edits (doc_id, seq, at, deleted, inserted); documents without
    any stay as they are, edits of unknown documents are left out."""
    row = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("seq", "int"), ("at", "int"), ("deleted", "int"), ("inserted", "string"))))
    grouped = edits.groupBy("doc_id").agg(F.collect_list(row).alias("edits"))
    return edited(tree_rows.select("doc_id", "text", "tree").join(grouped, "doc_id", "left"), ranks_path)


def revision(docs: DataFrame) -> DataFrame:
    """The edits of the query: in each text the ten characters from the middle on are replaced,
    and a sentence is added at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    middle = F.struct(F.lit(1).alias("seq"), F.floor(n / 2).cast("int").alias("at"), F.lit(10).alias("deleted"), F.lit(" edited 42 times, it's ").alias("inserted"))
    tail = F.struct(F.lit(2).alias("seq"), (n + 100).cast("int").alias("at"), F.lit(0).alias("deleted"), F.lit("\nRevised.").alias("inserted"))
    return docs.select("doc_id", "text").withColumn("edits", F.array(middle, tail))
