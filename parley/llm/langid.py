"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time: two gated recurrent layers read windows of the
UTF-8 bytes from either end, every position gets label probabilities from both states, and a document's probabilities
are the means over all its positions. Gates and states use piecewise linear squashing. A text is read to its end, in
windows of WINDOW bytes.

`und` with score 0 is predicted for null texts, texts without a letter, and everything if no row can be learned from.
Repeated rows get equal predictions. An empty table gives an empty result. Columns named lang_pred or score are
replaced, all others are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import fold, lowest, release, strings_bytes, texts

#: Hidden units of a direction, bytes of a window, windows scored at once.
UNITS, WINDOW, LANES = 8, 256, 2048
#: Learned from at most this many documents of each language, those whose ids hash lowest.
SAMPLE = 500
#: Characters of a sampled text that the fit reads; predictions read texts whole.
PASSAGE = 20_000
STEPS, BATCH, SPAN, RATE = 320, 256, 64, 0.02
#: The language stage: one labelled text in APART is kept apart to set thresholds, each for at least FEW texts, at MARGIN of the lowest
#: score but for one text in ODD.
APART, FEW, MARGIN, ODD = 10, 20, 0.7, 1000
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights of both directions: byte table (2, 3H, 256), recurrent (2, 3H, H), inner bias (2, H, 1), labels (2, K, H), bias (K)."""

    langs: list[str]
    table: np.ndarray
    recurrent: np.ndarray
    inner: np.ndarray
    label: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.inner, self.label, self.bias]


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis=axis, keepdims=True))
    return x / x.sum(axis=axis, keepdims=True)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """x: bytes (T, B); y: labels (B). Gradients of the mean cross-entropy over all positions."""
    span, lanes = x.shape
    h, k = net.recurrent.shape[2], len(net.langs)
    both = np.stack([x, x[::-1]])  # the second direction reads from the end
    state = np.zeros((2, h, lanes), np.float32)
    states, kept = [state], []
    for t in range(span):
        inputs = np.stack([net.table[d][:, both[d, t]] for d in (0, 1)])
        g = net.recurrent @ state
        z = np.clip(0.25 * (inputs[:, :h] + g[:, :h]) + 0.5, 0, 1)
        r = np.clip(0.25 * (inputs[:, h:2 * h] + g[:, h:2 * h]) + 0.5, 0, 1)
        inner = g[:, 2 * h:] + net.inner
        a = inputs[:, 2 * h:] + r * inner
        n = np.clip(a, -1, 1)
        kept.append((z, r, inner, a, n))
        state = n + z * (state - n)
        states.append(state)
    forward = np.stack([s[0] for s in states[1:]])
    backward = np.stack([s[1] for s in states[1:]])[::-1]
    p = _softmax(net.label[0] @ forward + net.label[1] @ backward + net.bias[:, None], axis=1)
    p[:, y, np.arange(lanes)] -= 1
    p = (p / (span * lanes)).astype(np.float32)
    d_label = np.stack([np.einsum("tkb,thb->kh", p, forward), np.einsum("tkb,thb->kh", p, backward)])
    d_bias = p.sum(axis=(0, 2))
    push = np.stack([net.label[0].T @ p, (net.label[1].T @ p)[::-1]])
    d_recurrent, d_inner = np.zeros_like(net.recurrent), np.zeros_like(net.inner)
    d_inputs = np.zeros((2, span, 3 * h, lanes), np.float32)
    d = np.zeros((2, h, lanes), np.float32)
    for t in range(span - 1, -1, -1):
        z, r, inner, a, n = kept[t]
        d = d + push[:, t]
        d_n = d * (1 - z) * (np.abs(a) < 1)
        d_z = 0.25 * d * (states[t] - n) * ((z > 0) & (z < 1))
        d_r = 0.25 * d_n * inner * ((r > 0) & (r < 1))
        d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_inputs[:, t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_inner += d_g[:, 2 * h:].sum(axis=2, keepdims=True)
        d_recurrent += d_g @ states[t].transpose(0, 2, 1)
        d = d * z + net.recurrent.transpose(0, 2, 1) @ d_g
    d_table = np.zeros_like(net.table)
    for way in (0, 1):
        seen = both[way].ravel()
        for row in range(3 * h):
            d_table[way, row] = np.bincount(seen, weights=d_inputs[way, :, row].ravel(), minlength=256)
    return [d_table, d_recurrent, d_inner, d_label, d_bias]


def train(samples: list[tuple[str, str]], units: int = UNITS, steps: int = STEPS) -> Network | None:
    """Fit the network to (text, language) pairs by Adam over random spans, languages in equal parts."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(7)
    k = len(langs)
    net = Network(langs, rng.normal(0, 0.3, (2, 3 * units, 256)).astype(np.float32), rng.normal(0, 0.35, (2, 3 * units, units)).astype(np.float32),
                  np.zeros((2, units, 1), np.float32), rng.normal(0, 0.3, (2, k, units)).astype(np.float32), np.zeros(k, np.float32))
    raw = {lang: [np.frombuffer(t.encode(), np.uint8) for t, x in samples if x == lang and t] for lang in langs}
    raw = {lang: [np.resize(t, max(len(t), SPAN)) for t in found] for lang, found in raw.items() if found}
    if not raw:
        return None
    names = sorted(raw)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), BATCH)
        spans = []
        for i in y:
            found = raw[names[i]]
            text = found[rng.integers(len(found))]
            at = rng.integers(len(text) - SPAN + 1)
            spans.append(text[at:at + SPAN])
        labels = np.array([langs.index(names[i]) for i in y])
        found = _gradients(net, np.stack(spans).T, labels)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), found, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def _scorer(net: Network):
    """Function of windows (bytes, starts, lengths sorted falling) -> sums of label probabilities over their positions."""
    h, k = net.recurrent.shape[2], len(net.langs)
    table, recurrent = net.table.copy(), net.recurrent.copy()
    table[:, :2 * h] = 0.25 * table[:, :2 * h] + 0.5  # the gates' squashing is folded into the weights
    recurrent[:, :2 * h] *= 0.25
    label = np.ascontiguousarray(net.label)

    def score(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        longest = int(lengths[0])
        logits = np.empty((longest, k, len(starts)), np.float32)
        logits[:] = net.bias[:, None]
        state = np.zeros((2, h, len(starts)), np.float32)
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # windows longer than t
        steps = np.arange(longest)[:, None]
        ahead = raw[np.minimum(starts + steps, len(raw) - 1)]
        ends = starts + lengths - 1
        behind = raw[np.maximum(ends - steps, 0)]
        for t in range(longest):
            n = int(active[t])
            state = state[:, :, :n]
            g = recurrent @ state
            inputs = np.empty((2, 3 * h, n), np.float32)
            np.take(table[0], ahead[t, :n], axis=1, out=inputs[0], mode="clip")
            np.take(table[1], behind[t, :n], axis=1, out=inputs[1], mode="clip")
            gates = g[:, :2 * h]
            gates += inputs[:, :2 * h]
            np.clip(gates, 0, 1, out=gates)
            fresh = g[:, 2 * h:]
            fresh += net.inner
            fresh *= gates[:, h:]
            fresh += inputs[:, 2 * h:]
            np.clip(fresh, -1, 1, out=fresh)
            state = state - fresh
            state *= gates[:, :h]
            state += fresh
            seen = label @ state
            logits[t, :, :n] += seen[0]
            full = int(np.searchsorted(-lengths[:n], -longest, side="right"))
            logits[longest - 1 - t, :, :full] += seen[1, :, :full]
            if full < n:  # windows at the ends of texts are shorter: they end at other positions
                logits[lengths[full:n] - 1 - t, :, np.arange(full, n)] += seen[1, :, full:n].T
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits *= (steps < lengths)[:, None, :]
        return logits.sum(axis=0)

    return score


def probabilities(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities (rows, K) of texts given as bytes and offsets; zero for empty texts."""
    score = _scorer(net)
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + inside * WINDOW
    lengths = np.minimum(WINDOW, offsets[owner + 1] - starts)
    total = np.zeros((len(sizes), len(net.langs)))
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), LANES):
        part = order[at:at + LANES]
        np.add.at(total, owner[part], score(raw, starts[part], lengths[part]).T)
    return total / np.maximum(sizes, 1)[:, None]


def labelled() -> Column:
    """Whether a document may be learned from."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(4) != 2)


def samples(docs: DataFrame) -> list[tuple[str, str]]:
    """The documents to learn from: outside the held-out fold, at most SAMPLE a language, PASSAGE characters of each."""
    known = docs.where(labelled())
    chosen = lowest(known.select("lang", "doc_id"), "lang", SAMPLE, "langid").distinct()
    # at most SAMPLE ids a language are broadcast
    rows = known.select("doc_id", "lang", F.substring("text", 1, PASSAGE).alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang").collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def identify(docs: DataFrame, net: Network | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its score, in columns of the given names."""
    kept = [c for c in docs.columns if c not in names]
    order = [c for c in kept if c != "text"] + ["text"]
    source = docs.select(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 8192):
            column = batch.column(batch.num_columns - 1)
            known = np.array([t is not None and LETTER.search(t) is not None for t in column.to_pylist()])
            if net is None:
                known[:] = False
                best, score = np.zeros(len(known), int), np.zeros(len(known))
            else:
                p = probabilities(net, *strings_bytes(column))
                best, score = p.argmax(axis=1), p.max(axis=1)
            langs = net.langs if net else ["und"]
            pred = [langs[b] if ok else "und" for b, ok in zip(best, known)]
            value = np.where(known, np.clip(score, 0, 1).round(5), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(value, pa.float64())],
                                             names=[*order, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{names[0]}` string, `{names[1]}` double"
    return source.mapInArrow(run, schema).select(*kept, *names)


def least_scores(net: Network, apart: list[tuple[str, str]]) -> list[float]:
    """By length class (texts of at least 4**c bytes), the score below which a text counts as in no learned language.

    It is MARGIN of the lowest score among texts kept apart from training that are at least as long, but for one text in
    ODD, so that it does not fall as the table grows; classes that fewer than FEW of them reach share the threshold of the
    last one that enough do. [0.0] if there is none.
    """
    raw, offsets = strings_bytes(pa.array([t for t, _ in apart if LETTER.search(t)], pa.string()))
    scores, sizes = probabilities(net, raw, offsets).max(axis=1), np.diff(offsets)
    least = []
    while (sizes >= 4 ** len(least)).sum() >= FEW:
        found = np.sort(scores[sizes >= 4 ** len(least)])
        least.append(MARGIN * float(found[(len(found) - 1) // ODD]))
    return least or [0.0]


def is_apart() -> Column:
    """Whether a labelled text is kept apart from training."""
    return F.crc32(F.substring("text", 1, PASSAGE).cast("binary")) % F.lit(APART) == 0


def table_least_scores(net: Network, docs: DataFrame) -> list[float]:
    """`least_scores` over every labelled text of the table that is kept apart, each read whole.

    Scores have five digits, so a length class is counted in at most 100,001 rows, whatever the table's size; the driver
    sees a row a class.
    """
    apart = docs.where(labelled() & is_apart()).select("text")
    told = identify(apart, net, ("_lang_pred", "_score")).where("_lang_pred <> 'und'")
    reached = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda c: F.octet_length("text") >= F.pow(F.lit(4), c))
    counts = told.select("_score", F.explode(reached).alias("_c")).groupBy("_c", "_score").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_c")
    ranked = counts.withColumn("_all", F.sum("_n").over(whole)).withColumn("_upto", F.sum("_n").over(whole.orderBy("_score")))
    rows = (ranked.where((F.col("_all") >= FEW) & (F.col("_upto") > F.floor((F.col("_all") - 1) / ODD)))
            .groupBy("_c").agg(F.min("_score").alias("_least")).collect())
    return [MARGIN * r["_least"] for r in sorted(rows, key=lambda r: r["_c"])] or [0.0]


def accepted(docs: DataFrame) -> DataFrame:
    """The documents in a learned language: those predicted `und` go, and those that score below what labelled texts of
    their length do. A tenth of the labelled texts, by checksum, is kept apart from training to tell that."""
    known = samples(docs)
    net = train([x for x in known if zlib.crc32(x[0].encode()) % APART] or known)
    least = table_least_scores(net, docs) if net else [0.0]
    del known
    release()  # the driver's process goes on with the later stages
    told = identify(docs, net, ("_lang_pred", "_score")).where("_lang_pred <> 'und'")
    level = sum((F.when(F.octet_length("text") >= 4 ** c, 1).otherwise(0) for c in range(1, len(least))), F.lit(0))
    return told.where(F.col("_score") >= F.get(F.array(*map(F.lit, least)), level)).select(*docs.columns)
