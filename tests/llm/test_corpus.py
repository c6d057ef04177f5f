"""Importance resampling, archives and token alignment against plain versions."""

import base64
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import alignment, importance, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, "!!! ...", "İstanbul ÄÖ\x00x\x7fy", "one", "a-b_c d", "x " * 5000, "y" * 30_000, "中文 " * 1500 + "end" * 3000, "A1b2 " * 40]


# ------------------------------------------------------------------ importance resampling
def plain_features(text, widths):
    words = re.findall(importance.WORD, (text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in range(widths[0], widths[1] + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, target, widths, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *plain_features(t, widths)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x, widths)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, words, fs in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("text", [t or "" for t in ODD])
@pytest.mark.parametrize("widths", [(1, 1), (1, 3), (2, 2)])
def test_windows(text, widths):
    lowered = text.encode().lower().decode()
    told = list(importance.windows(lowered, widths))
    words, features = plain_features(text, widths)
    assert sum(n for n, _ in told) == words
    assert Counter(f for _, fs in told for f in fs) == Counter(features)


@pytest.mark.parametrize("widths, percent", [((1, 1), 10), ((1, 2), 55)])
def test_resample(spark, rows, odd, widths, percent):
    given = [(i, t) for i, t, *_ in rows] + [(None, "null id " * 12), (7, rows[7][1])] + [(900 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(7).withColumn("score", F.lit("x")).withColumn("_row", F.lit(1))
    target = spark.createDataFrame([(1, rows[3][1]), (2, rows[210][1]), (3, None)], "item_id long, text string")
    told = importance.resample(docs, target, widths=widths, percent=percent)
    assert told.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample(given, [rows[3][1], rows[210][1]], widths, importance.BUCKETS, importance.LEAST_WORDS, percent, importance.SEED)
    assert sorted((tuple(r) for r in told.collect()), key=str) == want


def test_resample_of_repeated_rows_and_empty_tables(spark, empty, docs):
    many = spark.range(900).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same words here " * 10).alias("text"))
    none = spark.createDataFrame([], "item_id long, text string")
    told = importance.resample(many, none).collect()
    assert len(told) == 900 and sorted(r.rank for r in told if r.rank) == list(range(1, 91))
    assert all(r.weight == told[0].weight and r.n_features == 30 for r in told)
    best = sorted(told, key=lambda r: (-r.score, r.doc_id))[:90]
    assert sorted(r.doc_id for r in told if r.rank) == sorted(r.doc_id for r in best)
    assert importance.resample(empty, none).count() == 0


# ------------------------------------------------------------------ archives
PAGES = "page_id long, url string, html string, size string, row string"


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(5)
    body = ["<p>" + " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(30)) + "</p>" for _ in range(60)]
    rows = [(i, f"http://a.example/{i}?q=ü x\r\nX-Bad: 1", f"<html>{rnd.choice(body)}{i % 90}</html>") for i in range(400)]
    rows += [(1000 + i, None, "<html>copy</html>") for i in range(300)]  # a hot group
    rows += [(2000, "u", None), (2001, "u", ""), (None, "n", "<html>copy</html>"), (None, None, "alone"), (None, "x", "pair"), (None, "y", "pair"),
             (2002, "u", "é" * 300_000), (2003, "u", "WARC/1.1\r\n\r\n\r\n\r\nx\r\n\r\n"), (1299, "z", "<html>copy</html>")] + [(1299, None, "<html>copy</html>")] * 40
    rnd.shuffle(rows)
    return rows


def plain_archive(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for payload, ids in groups.items():
        raw = payload.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for place, i in enumerate(ids):
            again = place > 0 and len(raw) >= least
            out.append((i, len(raw), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_archive(spark, pages, least):
    table = spark.createDataFrame([(*r, "x", "y") for r in pages], PAGES).repartition(3)
    told = warc.archive(table, least_bytes=least)
    assert told.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in told.collect()), key=str) == plain_archive(pages, least)


def test_archives_are_standard_files(spark, pages):
    """Read without the module: a skippable frame with a dictionary, then a frame a record."""
    table = spark.createDataFrame([(*r, "x", "y") for r in pages], PAGES).coalesce(1)
    manifest = warc.write(table, archive_bytes=2_000).collect()
    assert len(manifest) > 1 and sum(r.records for r in manifest) == len(pages)
    seen, fitted = Counter(), 0
    for r in manifest:
        files, path = pafs.FileSystem.from_uri(r.archive) if "://" in r.archive else (pafs.LocalFileSystem(), r.archive)
        data = files.open_input_file(path).read()
        assert len(data) == r.bytes
        reader = zstandard.ZstdDecompressor()
        magic, size = struct.unpack_from("<II", data)
        if magic == 0x184D2A5D:
            reader, fitted = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size])), fitted + 1
            data = data[8 + size:]
        text = reader.stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        seen.update(re.findall(rb"\r\nWARC-Type: (\w+)\r\n", text))
        assert b"\r\nX-Bad" not in text
    assert fitted and seen[b"response"] + seen[b"revisit"] >= len(pages)
    back = {r.page_id: r for r in warc.read(spark.createDataFrame(manifest)).collect()}
    assert back[2002].payload == "é" * 300_000 and back[2003].payload == "WARC/1.1\r\n\r\n\r\n\r\nx\r\n\r\n"
    assert back[1000].payload is None and back[1000].refers_to == 1299 and back[2001].payload == "" and back[2000].refers_to == 2001
    assert back[3].url == "http://a.example/3?q=%C3%BC%20x%0D%0AX-Bad:%201"


def test_records_read_alone_and_damage_is_seen(spark):
    samples = [f"<html>{'common furniture ' * 20}{i}</html>".encode() for i in range(300)]
    found = warc.dictionary(samples)
    assert found is not None and warc.dictionary(samples[:3]) is None and warc.dictionary([b"x"] * 100) is None
    press = zstandard.ZstdCompressor(level=3, dict_data=found, write_checksum=True)
    raw = found.as_bytes()
    file = struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw + b"".join(press.compress(s) for s in samples)
    for chunk in (7, 1000, 1 << 18):
        assert list(warc.frames(io.BytesIO(file), max(chunk, 8))) == samples
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(file[:-3])))
    good = warc.record({"page_id": 1, "row": 0, "url": "u", "size": 3, "sha1": hashlib.sha1(b"abc").hexdigest(), "lead_id": None, "lead_row": None, "payload": "abc"})
    assert warc.parsed(good)["payload"] == "abc"
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        warc.parsed(good[:-1])


def test_archive_of_nothing(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


# ------------------------------------------------------------------ token alignment
def plain_merge(a, b):
    """How many values of each lie up to each common value."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i + 1, j + 1))
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1 << 14])
def test_merge_path(size):
    rng = np.random.default_rng(size)
    for na, nb, top in ((0, 0, 5), (0, 4, 5), (5, 0, 9), (1, 1, 1), (40, 40, 60), (300, 20, 900), (20, 300, 310), (200, 200, 200)):
        a, b = np.sort(rng.choice(top, na, replace=False)) + 1 if na else np.zeros(0, int), np.sort(rng.choice(top, nb, replace=False)) + 1 if nb else np.zeros(0, int)
        i, j = alignment.common_ends(a, b, size)
        assert list(zip(i.tolist(), j.tolist())) == plain_merge(a.tolist(), b.tolist())
        if na and nb:
            x, y = alignment.diagonals(a, b, size)
            work = np.diff(x + y)
            assert (x[-1], y[-1]) == (na, nb) and (work >= 0).all() and work.max() <= size + 1  # equal work, ties on one side


@pytest.fixture(scope="module")
def readers():
    a = Tokenizer.from_file(alignment.BYTES_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_PATH)
    return a, b


def plain_tokens(text, readers):
    a, b = readers
    if not text:
        return None
    found = a.encode(" " + text, add_special_tokens=False).ids
    own = sorted([*range(33, 127), *range(161, 173), *range(174, 256)])
    letter = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in found]
    pieces = b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, pieces)]
    want = (" " + text).encode()
    return (found, pieces, bytes_a, bytes_b) if b"".join(bytes_a) == b"".join(bytes_b) == want else None


def plain_align(rows, readers):
    docs = []
    for i, text in rows:
        read = plain_tokens(text, readers)
        if read is None:
            docs.append((i, 0, 0, [], Counter()))
            continue
        a, b, bytes_a, bytes_b = read
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, x, y = [], 0, 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(stop, x) + 1, ends_b.index(stop, y) + 1
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        docs.append((i, len(a), len(b), groups, Counter((u, v) for g, h in groups for u in g for v in h)))
    held = Counter(pair for d in docs for pair in d[4])
    most = Counter()
    for (u, _), n in held.items():
        most[u] = max(most[u], n)
    out = []
    for i, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, na, nb, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


TEXTS = ["plain words here", " leading  blanks", "<|endoftext|> and <s> </s> <unk> <0x41>", "ﬁ ligature ①", "中文字符测试 日本語テキスト", "😀😀 emoji 👩‍👩‍👧",
         "▁ is a blank there", "tab\tand\nnewline\r\n", "naïve café ÀÉÎ", "=" * 300, "don't we'll 1234567890 3.14159", "\x00\x01 control", " ", "\n", "x",
         "Россия и Україна", "مرحبا بالعالم", "word " * 3000 + "end", "ab" * 4000, "long " + "w" * 2500 + " tail and more " * 400, "é" * 700, "कखग घङ"]


@pytest.mark.parametrize("wide, hot", [(1 << 16, 200_000), (3, 20), (0, 1)])
def test_alignment(spark, rows, readers, monkeypatch, wide, hot):
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    given = [(i, t) for i, t, *_ in rows if i < 400 or i > 490] + [(900 + k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (None, "null id")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4).withColumn("pair", F.lit("x")).withColumn("n", F.lit(1))
    told = alignment.align(docs)
    assert told.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in told.collect()), key=str) == plain_align(given, readers)


def test_segments_change_no_token(spark, readers):
    both = alignment.vocabularies()
    assert both.cuts
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in given + TEXTS:
        read, plain = both.encode(text or ""), plain_tokens(text, readers)
        assert (read is None) == (plain is None)
        if read is not None:
            assert read[0].tolist() == plain[0] and read[1].tolist() == plain[1]


def test_alignment_of_nothing(empty):
    assert alignment.align(empty).count() == 0
