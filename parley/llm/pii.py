"""Personal data by candidate gradient boosting.

Four patterns with checks give the base spans, which always stay. Beside them, generous generators propose overlapping
spans: every run of digit groups that could be a card, phone or address, also inside longer runs that a pattern took
whole and dropped, and mail addresses with other letters or spelled-out signs. Boosted trees over format and context
(neighbouring characters, cue words before the span) tell real ones.

There are no labels, so the trees learn from all texts, with numbers and addresses planted into them:
in formats that no base pattern knows (right), and look-alikes such as book numbers, dates and versions (wrong).
Proposals equal to base spans are right too, other plain numbers wrong, and what is shaped like a planted format without
being one is unknown, as is what lies inside dropped matches. A threshold per kind, set on passages kept apart, selects
what is added; added spans overlap neither base spans nor each other.

Null texts are empty. Repeated rows get equal spans. Texts are read whole. An empty table gives an empty result. Columns
other than doc_id and text are not read by `find`; `redacted` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import boosting
from parley.llm.common import fold, keep, lowest, text_of, texts

KINDS = ("email", "ip", "card", "phone")
#: A threshold needs this precision, at least a half. Up to so many different vectors of features are learned from in the driver.
PRECISION, VECTORS = 0.98, 100_000
#: `sample`: at most so many documents with an @ or digits, so many characters of each. `find` learns from all texts, read whole.
SAMPLE, PASSAGE = 3000, 20_000
#: Words before a span that speak for or against personal data.
FOR = frozenset("call phone tel telephone mobile cell fax ring dial whatsapp contact number reach mail email e-mail write card visa paid".split())
AGAINST = frozenset("isbn issn order invoice no nr id ref version page item part model serial article look meet at see date on".split())
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_LOOSE = re.compile(r"[^\s@<>\"',;:()\[\]]+@[^\s@<>\"',;:()\[\]]+\.[^\W\d_]{2,}")
_SPELLED = re.compile(r"[\[(]\x20?at\x20?[\])]", re.I)
_WORDED = re.compile(r"(?<=[\w])\x20at\x20(?=[\w])")
_MARK = re.compile(r"[\w.%+-]")
_WORD_BEFORE = re.compile(r"([A-Za-z-]+)[^A-Za-z0-9]{0,3}$")
_SPELLED_RIGHT = re.compile(r"\x20?[\w-]+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[\w-]+)+", re.I)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def _card(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def _phone(s: str) -> bool:
    return 10 <= len(_digits(s)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, looked for from every @ on."""
    end, at = 0, text.find("@")
    while at >= 0:
        # the local part is the run of its letters before the sign, after the previous match
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        told = _DOMAIN.match(text, at + 1) if start < at else None
        if told:
            end = told.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans in order, and the places of matches with too many digits, which may hold several numbers."""
    spans, dropped = list(_emails(text)), []
    if _GROUP.search(text):
        for kind, pattern, check, most in (("ip", _IP, _octets, None), ("card", _CARD, _card, 19), ("phone", _PHONE, _phone, 15)):
            for m in pattern.finditer(text):
                if check(m[0]):
                    spans.append((*m.span(), kind))
                elif most and len(_digits(m[0])) > most:
                    dropped.append(m.span())
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])), dropped


def _kind_of(text: str, i: int) -> int:
    """Class of the character at a place: 0 none or white space, 1 letter, 2 digit, 3 other."""
    if not 0 <= i < len(text) or text[i].isspace():
        return 0
    return 1 if text[i].isalpha() else 2 if text[i].isdigit() else 3


def _cue(text: str, a: int) -> int:
    """1 where the word before a span speaks for personal data, 2 against it, 0 neither."""
    found = _WORD_BEFORE.search(text[max(0, a - 24):a])  # cue words are shorter than that
    word = found[1].lower() if found else ""
    return 1 if word in FOR else 2 if word in AGAINST else 0


def _context(text: str, a: int, b: int) -> list[int]:
    return [_kind_of(text, a - 1), _kind_of(text, b), _cue(text, a)]


def _local_start(text: str, end: int) -> int:
    """Where the run of mail characters that ends here starts, however long it is."""
    while end and _MARK.match(text[end - 1]):
        end -= 1
    return end


def proposals(text: str) -> list[tuple[Span, list[int]]]:
    """Overlapping spans that may be personal data, with their features."""
    out: list[tuple[Span, list[int]]] = []
    for m in _LOOSE.finditer(text) if "@" in text else ():
        out.append(_mail(text, m.start(), m.end(), m[0], 0))
    for form, signs in ((1, _SPELLED), (2, _WORDED)):
        for m in signs.finditer(text):
            stop = m.start() - (form == 1 and text[m.start() - 1:m.start()] == " ")
            start, right = _local_start(text, stop), _SPELLED_RIGHT.match(text, m.end())
            if start < stop and right:
                plain = re.sub(r"\x20?[\[(]\x20?dot\x20?[\])]\x20?", ".", f"{text[start:stop]}@{right[0].strip()}", flags=re.I)
                out.append(_mail(text, start, right.end(), plain, form))
    for run in _RUN.finditer(text):
        groups = [(g.start() + run.start(), g.end() + run.start()) for g in _GROUP.finditer(run[0])]
        if groups[-1][1] - groups[0][0] < 7:
            continue
        for i in range(len(groups)):
            count = 0
            for j in range(i, len(groups)):
                count += groups[j][1] - groups[j][0]
                if count > 19:
                    break
                if count >= 7 or j - i == 3:
                    out.extend(_numbers(text, run.span(), groups, i, j))
    return out


def _mail(text: str, a: int, b: int, plain: str, form: int) -> tuple[Span, list[int]]:
    local, _, domain = plain.rpartition("@")
    labels = domain.split(".")
    shape = [len(local), sum(c.isdigit() for c in local), sum(c in "._%+-" for c in local), len(labels), len(labels[0]), len(labels[-1]),
             sum(c.isdigit() for c in domain), int(labels[-1].isalpha()), int(plain.isascii()), form, 0, 0, 0]
    return (a, b, "email"), [0, *_clip(shape + _context(text, a, b))]


def _numbers(text: str, run: tuple[int, int], groups: list[tuple[int, int]], i: int, j: int) -> Iterator[tuple[Span, list[int]]]:
    a, b = groups[i][0], groups[j][1]
    floor = groups[i - 1][1] if i else run[0]
    marks = 0
    while a > floor and text[a - 1] in "+(" and marks < 2:
        a, marks = a - 1, marks + 1
    inner = text[a:b]
    digits = _digits(inner)
    sizes = [e - s for s, e in groups[i:j + 1]]
    shape = [len(digits), len(sizes), *(sizes + [0] * 4)[:4], sizes[-1], inner.count(" "), inner.count("-"), inner.count("."),
             2 * inner.startswith("+") + inner.count("("), int(digits[0]), inner.count("/")]
    features = _clip(shape + _context(text, a, b))
    if len(sizes) == 4 and inner.count(".") == 3 and len(inner) == len(digits) + 3 and _octets(inner):
        yield (a, b, "ip"), [1, *features]
    if 14 <= len(digits) <= 19 and luhn(digits) and a == groups[i][0]:
        yield (a, b, "card"), [2, *features]
    if 10 <= len(digits) <= 15:
        yield (a, b, "phone"), [3, *features]


def _clip(values: list[int]) -> list[int]:
    return [min(max(v, 0), boosting.LEVELS - 1) for v in values]


#: Forms that no base pattern finds (right) and look-alikes (wrong); # is a digit, L a digit chosen to pass the Luhn check.
RIGHT = {"phone": ("(###) ###-####", "###-###-####", "###.###.####", "00## ## #######", "00## ### ######", "0### ### ####"),
         "email": ("{w}.{v} [at] {u}.com", "{w}{d}(at){u}(dot)org", "{w}.{v} at {u}.com", "{w}_{d} at {u}.net", "{w}@{u}ä{v}.com"),
         "card": ("####.####.####.###L", "####/####/####/###L")}
WRONG = ("978-3-##-######-#", "20##-0#-1# 1#:##:##", "20## 20## 20##", "#.####.####", "############", "##.##.20## - ##.##.20##", "{w} at {u}.com",
         "####-####-###", "1#:00 - 1#:30 - 2#:00", "0.############")
_SHAPED = re.compile(r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}|00\d\d? \d\d\d? \d{6,7}|0\d{3} \d{3} \d{4}")
_LEADS = {"phone": ("call ", "phone: ", "tel. ", "", "", "and "), "email": ("write to ", "mail ", "contact ", "", ""), "card": ("card ", "paid with ", "")}
_LEADS_WRONG = ("ISBN ", "order ", "no. ", "version ", "see ", "", "", "and ")


def _filled(form: str, rnd: random.Random) -> str:
    """A form with its marks replaced."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8)))
    text = form.format(w=word(), v=word(), u=word(), d=rnd.randint(1, 99))
    out = "".join(str(rnd.randint(i == 0, 9)) if c == "#" else c for i, c in enumerate(text))
    return next((t for t in (out.replace("L", str(k)) for k in range(10)) if luhn(_digits(t))), out) if "L" in form else out


def planted(text: str, rnd: random.Random, forms: int = 3) -> tuple[str, set[Span], list[tuple[int, int]]]:
    """The text with planted forms between its words: the new text, the right spans, and the places of the wrong ones."""
    blanks = [m.start() for m in re.finditer(" ", text)]
    gaps = sorted(rnd.sample(blanks, min(2 * forms, len(blanks))))
    out, at, size, right, wrong = [], 0, 0, set(), []
    for k, gap in enumerate(gaps):
        kind = rnd.choice(sorted(RIGHT))
        good = k % 2 == 0
        lead, form = (rnd.choice(_LEADS[kind]), rnd.choice(RIGHT[kind])) if good else (rnd.choice(_LEADS_WRONG), rnd.choice(WRONG))
        put = _filled(form, rnd)
        out += [text[at:gap], " ", lead, put]
        size += gap - at + 1 + len(lead)
        if good:
            right.add((size, size + len(put), kind))
        else:
            wrong.append((size, size + len(put)))
        size, at = size + len(put), gap
    return "".join([*out, text[at:]]), right, wrong


@dataclass
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]


def examples(passage: str) -> Iterator[tuple[list[int], int]]:
    """Features and labels of the proposals in a passage with planted forms."""
    text, right, wrong = planted(passage, random.Random(zlib.crc32(passage.encode())))
    own, dropped = base(text)
    right = right | {s for s in own if not any(a < s[1] and s[0] < b for a, b in wrong)}
    for span, features in proposals(text):
        if span in right:
            yield features, 1
        elif any(s[0] < span[1] and span[0] < s[1] for s in right) or any(a < span[1] and span[0] < b for a, b in wrong):
            yield features, 0
        elif not any(a < span[1] and span[0] < b for a, b in dropped) and not _SHAPED.search(text[span[0]:span[1]]):
            yield features, 0


def counted(passages: Iterable[tuple[str, bool]], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows (x, apart, n0, n1): how often a vector of features is wrong and right, in passages to learn from and those apart.

    Equal vectors are counted together as long as no more than `most` are held.
    """
    found: dict[tuple[bytes, bool], list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.binary()), pa.array([k[1] for k in found], pa.bool_()),
                                           *(pa.array([n[i] for n in found.values()], pa.int64()) for i in (0, 1))], names=["x", "apart", "n0", "n1"])

    for passage, apart in passages:
        for features, label in examples(passage):
            found.setdefault((bytes(features), apart), [0, 0])[label] += 1
        if len(found) > most:
            yield out()
            found.clear()
    yield out()


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The least score with enough precision, from (score in ten-thousandths, wrong, right); halfway to the next lower score.

    Rows of equal score have no order, so precision is told at their middle.
    """
    no = yes = 0
    rows, best = sorted(bins, reverse=True), 2.0  # nothing is added without right ones to measure by
    if not any(n1 for *_, n1 in rows):
        return best
    for i, (score, n0, n1) in enumerate(rows):
        if score >= 5000 and yes + n1 / 2 >= PRECISION * (no + yes + (n0 + n1) / 2):
            best = max(0.5, (score + (rows[i + 1][0] + 1 if i + 1 < len(rows) else 0)) / 20_000)
        no, yes = no + n0, yes + n1
    return best


def _binned(trees: boosting.Trees, x: np.ndarray, no: np.ndarray, yes: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """(kind, score in ten-thousandths) -> counts of wrong and right."""
    out: dict[tuple[int, int], list[int]] = {}
    for kind, score, n0, n1 in zip(x[:, 0].tolist(), np.floor(trees.probability(x) * 10_000).astype(int).tolist(), no.tolist(), yes.tolist()):
        told = out.setdefault((kind, score), [0, 0])
        told[0], told[1] = told[0] + int(n0), told[1] + int(n1)
    return out


#: The first feature of a proposal is the place of its kind here.
_FEATURE_KINDS = ("email", "ip", "card", "phone")


def _model(trees: boosting.Trees, bins: dict[tuple[int, int], list[int]]) -> Model:
    return Model(trees, {k: threshold([(s, *n) for (kind, s), n in bins.items() if _FEATURE_KINDS[kind] == k]) for k in KINDS})


def _learned(rows: pa.Table) -> Model:
    """Fit to counted vectors in memory."""
    if not rows.num_rows:
        return Model(boosting.Trees(start=-30.0), {k: 2.0 for k in KINDS})
    (x, no, yes), apart = boosting.arrays(rows), np.asarray(rows.column("apart"))
    own = np.concatenate([x[~apart], x[~apart]]), np.repeat([0.0, 1.0], (~apart).sum()), np.concatenate([no[~apart], yes[~apart]])
    trees = boosting.fit(*own)
    return _model(trees, _binned(trees, x[apart], no[apart], yes[apart]))


def learn(found: list[str]) -> Model:
    """Fit the trees on three quarters of the passages and the thresholds on the rest."""
    return _learned(pa.Table.from_batches(counted((passage, k % 4 == 3) for k, passage in enumerate(found))))


def _parted(found: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Texts and whether they are kept apart: one in four, by checksum."""
    return ((t, zlib.crc32(t.encode()) % 4 == 3) for t in found if t)


def learn_table(docs: DataFrame) -> Model:
    """`learn` over every whole text of a table.

    Each task counts the vectors of its texts, equal vectors are added up, and the trees grow from the counts: in the driver
    where at most VECTORS are left, else by a pass over the stored counts for every depth of a tree. The results are equal.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(_parted(t for batch in texts(batches, 1024) for t in batch.column(0).to_pylist()))

    rows = keep(docs.select("text").where("text is not null").mapInArrow(run, "x binary, apart boolean, n0 long, n1 long")
                .groupBy("x", "apart").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "vectors")
    if rows.limit(VECTORS + 1).count() <= VECTORS:
        return _learned(rows.toArrow())
    trees = boosting.fit_table(rows.where("not apart"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                told = _binned(trees, *boosting.arrays(batch))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((*k, *n) for k, n in told.items()))], names=["kind", "score", "n0", "n1"])

    # scores have four digits: at most 40,004 rows
    bins = rows.where("apart").mapInArrow(score, "kind long, score long, n0 long, n1 long").groupBy("kind", "score").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return _model(trees, {(r["kind"], r["score"]): [r["n0"], r["n1"]] for r in bins.collect()})


def spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, by start, then kind."""
    found, _ = base(text)
    told = [(s, f) for s, f in proposals(text) if not any(s[0] < b and a < s[1] for a, b, _ in found)]
    if not told:
        return found, found
    p = model.trees.probability(np.array([f for _, f in told], np.int64))
    chosen: list[Span] = []
    for k in sorted(range(len(told)), key=lambda k: (-p[k], told[k][0][0] - told[k][0][1], told[k][0])):
        (a, b, kind), _ = told[k]
        if p[k] >= model.thresholds[kind] and not any(a < y and x < b for x, y, _ in chosen):
            chosen.append((a, b, kind))
    return found, sorted(found + chosen, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def sample(docs: DataFrame) -> list[str]:
    """Texts to learn from: at most SAMPLE documents with an @ or a digit pair, those whose ids hash lowest."""
    likely = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("@|[0-9][ ().-]{0,2}[0-9]"))
    chosen = lowest(likely.select("doc_id").withColumn("_g", fold(1)), "_g", SAMPLE, "pii").select("doc_id").distinct()
    rows = likely.select("doc_id", F.substring("text", 1, PASSAGE).alias("text")).join(F.broadcast(chosen), "doc_id").collect()
    return [r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def _joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of `docs`."""
    known = model or learn_table(docs)
    columns = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, 4096):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, every = spans(text, known)
                counts = [sum(s[2] == k for s in own) for k in KINDS]
                rows.append((i, *counts, hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(every), len(every) - len(own)))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in columns.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, columns)


def redact(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, end = [], 0
    for a, b, kind in spans(text, model)[1]:
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])
