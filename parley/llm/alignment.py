"""Alignment of the tokens of two vocabularies over the same bytes.

Both tokenisers read a text; the sorted ends of their tokens, in bytes, are merged. Merge-path diagonals, found by binary
search, divide the merge into independent pieces of equal work; a piece emits the offsets where both have a token's end,
and offsets of consecutive pieces are stitched into groups, so a group may reach over any number of pieces. Tokens of A
and B in one group are linked. Over the corpus, the pairs of ids that documents hold linked are counted.

A text that is null or empty, or whose tokens do not give back its bytes, has no tokens: zeros and an empty digest.
Repeated rows and rows without id are documents of their own. Strings of special tokens are plain text. An empty table
gives an empty result. Extra columns are not read. Texts are read whole: long ones are tokenised in segments that end
between a word and a blank, where no token of either vocabulary can lie across.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import tokens
from parley.llm.common import keep, text_of, texts

BYTES_PATH, PIECES_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Steps of the merge in one piece.
PIECE = 1 << 14
#: Characters after which a text is cut at the next place between a word and a blank; tokenisers slow down on long texts.
SEGMENT = 2_000
#: Groups with more links than this are counted by their distinct ids.
WIDE = 1 << 16
#: A pair of ids that makes up at least one in so many rows is looked up by broadcast: there are at most that many.
HOT_PAIRS = 200_000
_CUT = re.compile(r"(?<=\w) (?=\w)")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                     ("groups_sha256", pa.string()), ("pair", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_COLUMNS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<long>")


@dataclass(frozen=True)
class Vocabularies:
    """Readers and the bytes of every token."""

    path: str
    b: sentencepiece.SentencePieceProcessor
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    cuts: bool  # no piece of B holds a blank after another character

    def segments(self, text: str) -> list[str]:
        """Parts of a text, each without the blank that parts it from the last one."""
        out, start = [], 0
        while self.cuts and len(text) - start > SEGMENT:
            found = _CUT.search(text, start + SEGMENT)
            if not found:
                break
            out.append(text[start:found.start()])
            start = found.end()
        return [*out, text[start:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, None where they do not give back the bytes of blank and text."""
        if not text:
            return None
        parts = self.segments(text)
        a = np.concatenate([tokens.plain_ids(" " + s, self.path) for s in parts])
        b = np.array([i for ids in self.b.encode(parts, num_threads=1) for i in ids], np.uint32)
        want = b" " + text.encode()
        if not len(b) or b"".join([self.bytes_a[i] for i in a.tolist()]) != want or b"".join([self.bytes_b[i] for i in b.tolist()]) != want:
            return None
        return a, b


def _piece_bytes(piece: str) -> bytes:
    found = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()


@functools.lru_cache(maxsize=2)
def vocabularies(path_a: str = BYTES_PATH, path_b: str = PIECES_PATH) -> Vocabularies:
    with open(path_a, encoding="utf-8") as f:
        told = json.load(f)
    letters, special = tokens.bytes_of_letters(), {t["content"] for t in told.get("added_tokens", [])}
    vocabulary = told["model"]["vocab"] | {t["content"]: t["id"] for t in told.get("added_tokens", [])}
    bytes_a = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        bytes_a[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    return Vocabularies(path_a, b, bytes_a, [_piece_bytes(p) for p in pieces], not any(re.search("[^▁]▁", p) for p in pieces))


def diagonals(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted arrays stands in each of them after every `size` steps, all found at once.

    Equal values are kept on one side of a cut, so a piece may be one step longer.
    """
    steps = np.arange(0, len(a) + len(b) + size, size).clip(max=len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        # A goes first: a[mid] belongs before the cut when it is not above the last value that B would have before it
        other = steps - mid - 1
        before = (low < high) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(other, 0, len(b) - 1)])
        low, high = np.where(before, mid + 1, low), np.where(before | (low >= high), high, mid)
    i, j = low, steps - low
    split = (i > 0) & (j < len(b)) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)])
    return i, j + split


def common_ends(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many values of a and of b lie up to each common value; every piece is searched alone."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = diagonals(a, b, size)
    from_a, from_b = [], []
    for k in range(len(i) - 1):
        left, right = a[i[k]:i[k + 1]], b[j[k]:j[k + 1]]
        if not len(left) or not len(right):
            continue
        at = np.searchsorted(right, left)
        hit = np.flatnonzero(right[np.minimum(at, len(right) - 1)] == left)
        from_a.append(i[k] + hit + 1)
        from_b.append(j[k] + at[hit] + 1)
    return np.concatenate([np.zeros(0, np.int64), *from_a]), np.concatenate([np.zeros(0, np.int64), *from_b])


@dataclass(frozen=True)
class Groups:
    """Consecutive groups over several documents: first tokens, numbers of tokens, document."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    doc: np.ndarray


def grouped(sizes_a: list[np.ndarray], sizes_b: list[np.ndarray]) -> Groups:
    """Groups of documents given by the byte lengths of their tokens; both must have the same total."""
    ends_a, ends_b = np.cumsum(np.concatenate(sizes_a)), np.cumsum(np.concatenate(sizes_b))
    stop_a, stop_b = common_ends(ends_a, ends_b)
    first_a, first_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
    doc = np.searchsorted(np.cumsum([len(s) for s in sizes_a]), first_a, side="right")
    return Groups(first_a, first_b, stop_a - first_a, stop_b - first_b, doc)


def linked(a: np.ndarray, b: np.ndarray, groups: Groups, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair of ids (A id * width + B id) and number of its links, each pair once a document."""
    links = groups.n_a * groups.n_b
    narrow = links <= WIDE
    g = np.repeat(np.flatnonzero(narrow), links[narrow])
    rank = np.arange(len(g)) - np.repeat(np.cumsum(links[narrow]) - links[narrow], links[narrow])
    n_b = groups.n_b[g]
    found = [(groups.doc[g], a[groups.a[g] + rank // n_b].astype(np.int64) * width + b[groups.b[g] + rank % n_b], np.ones(len(g), np.int64))]
    for x in np.flatnonzero(~narrow):
        ua, ca = np.unique(a[groups.a[x]:groups.a[x] + groups.n_a[x]], return_counts=True)
        ub, cb = np.unique(b[groups.b[x]:groups.b[x] + groups.n_b[x]], return_counts=True)
        pairs = (ua[:, None].astype(np.int64) * width + ub[None, :]).ravel()
        found.append((np.full(len(pairs), groups.doc[x]), pairs, (ca[:, None] * cb[None, :]).ravel()))
    doc, pair, times = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], pair[first], np.add.reduceat(times, first) if len(first) else times


@functools.lru_cache(maxsize=4)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below `most`, and how many."""
    text = [str(i).encode() for i in range(most)]
    width = max(map(len, text)) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(most, width), np.array([len(t) for t in text])


def written(a: np.ndarray, b: np.ndarray, groups: Groups, docs: int) -> list[bytes]:
    """Per document its groups as text: `a1,a2|b1;a3|b2,b3`."""
    digits, lengths = _digits(int(max(a.max(), b.max())) + 1)
    ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(groups.b, groups.n_a)] = a
    ids[np.arange(len(b)) + np.repeat(groups.a + groups.n_a, groups.n_b)] = b
    ends = groups.a + groups.n_a + groups.b + groups.n_b
    marks[ends - groups.n_b - 1] = ord("|")
    marks[ends - 1] = ord(";")
    cells, size = digits[ids].copy(), lengths[ids]
    cells[np.arange(len(ids)), size] = marks
    text = cells[np.arange(cells.shape[1])[None, :] <= size[:, None]].tobytes()
    stops = np.cumsum(size + 1)[ends[np.flatnonzero(np.diff(groups.doc, append=docs))] - 1]
    return [text[x:y - 1] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist())]


def _aligner(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(path_a, path_b)
        len_a, len_b = np.array([len(x) for x in both.bytes_a]), np.array([len(x) for x in both.bytes_b])
        for batch in texts(batches, 500, 2_000_000):
            keys = batch.column(0).to_pylist()
            read = [both.encode(t) for t in batch.column(1).to_pylist()]
            at = [i for i, r in enumerate(read) if r is not None]
            n = len(at)
            numbers = np.zeros((len(keys), 4), np.int64)
            digests, pairs, times = [""] * len(keys), [[]] * len(keys), [[]] * len(keys)
            if n:
                groups = grouped([len_a[read[i][0]] for i in at], [len_b[read[i][1]] for i in at])
                a, b = np.concatenate([read[i][0] for i in at]), np.concatenate([read[i][1] for i in at])
                found = [np.bincount(groups.doc, w, n).astype(np.int64) for w in (groups.n_a, groups.n_b, np.ones(len(groups.doc)), groups.n_a * groups.n_b)]
                numbers[at] = np.stack(found, axis=1)
                doc, pair, repeats = linked(a, b, groups, len(len_b))
                bounds = np.searchsorted(doc, np.arange(n + 1))
                for k, (i, text) in enumerate(zip(at, written(a, b, groups, n))):
                    digests[i] = hashlib.sha256(text).hexdigest()
                    pairs[i], times[i] = pair[bounds[k]:bounds[k + 1]], repeats[bounds[k]:bounds[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, *numbers.T, digests, pairs, times), _SCHEMA.types)], schema=_SCHEMA)

    return run


def aligned(docs: DataFrame, path_a: str = BYTES_PATH, path_b: str = PIECES_PATH) -> DataFrame:
    """Per row of `docs` (doc_id, text): numbers of tokens, groups and links, digest of the groups, and how often it links which ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(_aligner(path_a, path_b), _COLUMNS)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no other pair of its A id is held by more)."""
    counts = keep(rows.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("a", F.expr(f"pair div {width}")), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return keep(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def align(docs: DataFrame, path_a: str = BYTES_PATH, path_b: str = PIECES_PATH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`."""
    rows = keep(aligned(docs, path_a, path_b).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, len(vocabularies(path_a, path_b).bytes_b))
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_PAIRS >= total
    cells = rows.select("_row", F.explode(F.arrays_zip("pair", "times")).alias("c")).select("_row", "c.pair", "c.times")
    looked = cells.join(F.broadcast(counts.where(is_hot)), "pair", "left")
    # pairs that few documents hold are no hot keys, so that their rows may meet the counts in a shuffle
    rare = looked.where("n IS NULL").select("_row", "pair", "times").join(counts.where(~is_hot), "pair")
    sums = (looked.where("n IS NOT NULL").select("_row", "times", "n", "best").unionByName(rare.select("_row", "times", "n", "best"))
            .groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    return (rows.drop("pair", "times").join(sums, "_row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
