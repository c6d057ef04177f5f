"""The operators over documents against plain versions, on a small table with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from parley.llm import edit_embedding as ee
from parley.llm import exact_dedup, jaccard_join, langid, mixing, packing, sharding, shingles, tokens
from tests.llm.brute import linked_components, shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 9), (1, 1 << 48), (1, 1), (500, 600), (3000, 1 << 48)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        assert (exact_dedup.decode(exact_dedup.encode(values), len(values)) == values).all()


def test_exact_dedup(docs, rows, odd):
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[t or ""].append(i)
    told = exact_dedup.exact_dedup(docs).collect()
    assert len(told) == len(rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in told:
        ids = digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max(ids), len(ids))
    assert Counter(r.text_sha256 for r in told if r.kept) == Counter(digest.keys())
    stay = exact_dedup.survivors(odd).collect()
    assert sorted((r.doc_id, r.text or "") for r in stay) == sorted((max(ids), t) for t, ids in want.items())
    assert stay[0].asDict().keys() == set(odd.columns)


def test_shingle_sets_and_sketches(rows):
    import pyarrow as pa

    texts = [t for _, t, *_ in rows]
    found = shingles.sets(pa.array(texts, pa.string()))
    plain = [shingle_set(t) for t in texts]
    assert [len(x) for x in found] == [len(s) for s in plain]
    names = shingles.set_ids(found)
    for i in range(0, len(texts), 7):
        for j in range(0, len(texts), 5):
            assert len(np.intersect1d(found[i], found[j])) == len(plain[i] & plain[j])
            assert (names[i] == names[j]) == (plain[i] == plain[j])
            assert shingles.least_difference(shingles.parity(found[i]), shingles.parity(found[j])) <= len(plain[i] ^ plain[j])


@pytest.mark.parametrize("light", [None, 0, 7])
def test_jaccard_join(docs, rows, light, monkeypatch):
    if light is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda sizes: light)
        monkeypatch.setattr(jaccard_join, "COMMON", 4)
        monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    want = linked_components([(i, t) for i, t, *_ in rows])
    told = jaccard_join.jaccard_join(docs).collect()
    assert len(told) == len(rows)
    assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in told)


def test_near_copies_without_an_id_link(spark):
    """Null-id texts that no row with an id has: as near copies of one, and as the middle of a chain."""
    rnd = random.Random(3)
    words = [f"v{rnd.randrange(10 ** 6)}" for _ in range(90)]
    chain = [" ".join(words[k:k + 60]) for k in (0, 5, 10, 15)]
    rows = [(5, chain[0]), (None, chain[1]), (None, chain[2]), (9, chain[3]), (None, "alone " * 3), (None, None), (None, "")]
    want = {t or "": c for (_, t), c in zip([(i, t) for i, t in rows], [5, 5, 5, 5, None, None, None])}
    plain = linked_components([(k, t) for k, (_, t) in enumerate(rows)])
    assert [plain[k][1] for k in range(4)] == [0] * 4
    told = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(told) == len(rows)
    assert sorted((r.n_shingles, str(r.doc_id), str(r.component_id)) for r in told) == sorted((plain[k][0], str(i), str(want[t or ""])) for k, (i, t) in enumerate(rows))


def test_light_boundary_follows_cost():
    assert jaccard_join.boundary({100: 50}) == 0
    assert jaccard_join.boundary({1: 1000, 2: 1000, 300: 5}) >= 2


def test_near_copies_leave_one(docs, odd):
    unique = odd.dropDuplicates(["doc_id"])
    want = {r.component_id for r in jaccard_join.jaccard_join(unique).collect()}
    assert sorted(r.doc_id for r in jaccard_join.survivors(unique).collect()) == sorted(want)


def test_tokens_are_those_of_the_tokenizer(rows, spark):
    own, plain = Tokenizer.from_file(tokens.VOCABULARY), Tokenizer.from_file(tokens.VOCABULARY)
    plain.encode_special_tokens = True
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [t or "" for _, t, *_ in rows] + given + ["a" * 3000, "x\x85y \x1c z", "don't  stop\n\n\n  now"]:
        assert tokens.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids
        assert tokens.plain_ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert tokens.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_packing(docs, rows):
    cut = packing.pack(docs, with_ids=True)
    told = cut.collect()
    by_doc = defaultdict(list)
    for r in told:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048
        by_doc[r.doc_id, r.start].append(r)
    for i, t, *_ in rows:
        want = [*tokens.ids(t or "").tolist(), 0]
        got, at = [], 0
        while at < len(want):
            r = by_doc[i, at][0]
            assert r.start == 0 or by_doc[i, at][0].length == 2048
            got += r.ids
            at += r.length
        assert got == want
    used = defaultdict(list)
    for r in told:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(used) <= -(-sum(r.length for r in told) // 2048) + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(cut).collect()}
    assert all(whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids for r in told)


def test_fitted_patterns_do_not_lose_to_plain_best_fit():
    rng = np.random.default_rng(3)
    for spread in (300, 900, 2048):
        counts = Counter(int(x) for x in np.clip(rng.gamma(2.0, spread / 2, 3000), 1, 2048))
        spaces, plain = Counter(), 0
        for length in sorted(counts.elements(), reverse=True):
            fit = min((s for s in spaces if s >= length and spaces[s]), default=None)
            plain += fit is None
            if fit:
                spaces[fit] -= 1
            spaces[(fit or 2048) - length] += 1
        made = packing.plan(dict(counts))
        assert made.sequences <= plain * 1.01 + 1
        assert not made.left.any()


def test_language_of_unseen_texts(spark):
    rng = np.random.default_rng(1)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "er", "ei"], "cc": ["ção", "ão", "ñe", "lh"]}
    make = lambda p: " ".join("".join(rng.choice(p, rng.integers(2, 5))) for _ in range(int(rng.integers(3, 200))))
    rows = [(i, make(parts[k]), k if i % 50 else None, "s", 0) for i in range(600) for k in [sorted(parts)[i % 3]]]
    rows += [(9001, None, "aa", "s", 0), (9002, "12 !", "aa", "s", 0), (9003, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    net = langid.train(langid.samples(docs), steps=150)
    told = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert [told[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3
    right = [told[i].lang_pred == sorted(parts)[i % 3] for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(right) > 0.97
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 600


def test_texts_in_no_learned_language_go(spark):
    """Long texts half in one language and half in another score near a half: below what labelled long texts do, unlike short ones."""
    rng = np.random.default_rng(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "er", "ei"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k], rng.integers(2, 5))) for _ in range(n))
    rows = [(i, make(k, int(rng.integers(1, 200))), k) for i in range(800) for k in [sorted(parts)[i % 2]]]
    rows += [(2000 + i, make("aa", 300) + " " + make("bb", 300 * 11 // 15), None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert kept == {i for i, *_ in rows if i < 2000}


def test_least_scores_follow_length():
    """Thresholds rise with length, end with the last class that enough texts reach, and are open without any text."""
    net = langid.train([("lolo kami tuka", "aa"), ("schung erei ung", "bb")], steps=5)
    apart = [("kalo " * (4 ** (i % 5)), "aa") for i in range(5 * langid.FEW)] + [("12", "aa")]
    least = langid.least_scores(net, apart)
    score = lambda t: float(langid.probabilities(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).max())
    for c, found in enumerate(least):
        assert found == pytest.approx(langid.MARGIN * min(score(t) for t, _ in apart if len(t) >= 4 ** c and t != "12"))
    assert len(least) == 6 and least == sorted(least)
    assert langid.least_scores(net, apart[:3]) == [0.0] and langid.least_scores(net, []) == [0.0]


def test_thresholds_count_every_labelled_text(spark, monkeypatch):
    """Thresholds come from all labelled texts kept apart, not from those of the sample, and are those of the plain list."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(langid, "SAMPLE", 60)  # a sample of which too few are kept apart
    rng = np.random.default_rng(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "er", "ei"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k], rng.integers(2, 5))) for _ in range(n))
    rows = [(i, make(k, int(rng.integers(1, 200))), k) for i in range(800) for k in [sorted(parts)[i % 2]]]
    rows += [(2000 + i, make("aa", 300) + " " + make("bb", 300 * 11 // 15), None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.samples(docs)
    assert sum(zlib.crc32(t.encode()) % langid.APART == 0 for t, _ in known) < langid.FEW
    net = langid.train(known, steps=150)
    apart = [(t, k) for i, t, k in rows if k and zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(t.encode()) % langid.APART == 0]
    assert langid.table_least_scores(net, docs) == pytest.approx(langid.least_scores(net, apart), abs=1e-5)
    assert langid.table_least_scores(net, docs.where("lang is null")) == [0.0]
    assert {r.doc_id for r in langid.accepted(docs).collect()} == {i for i, *_ in rows if i < 2000}
    again = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))  # equal texts again move no threshold far
    assert langid.table_least_scores(net, again)[0] > 0


def test_language_without_labels(docs, empty):
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in langid.identify(docs, langid.train(langid.samples(docs.withColumn("lang", F.lit(None).cast("string"))))).collect()} == {"und"}
    assert langid.identify(empty, None).count() == 0


def test_mixing_targets_and_takes(docs, rows):
    told = mixing.mix(docs).collect()
    assert len(told) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in told:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    own = Counter()
    for _, t, _, s, _ in rows:
        own[s] += len(WORD.findall(t or ""))
    assert sizes == own
    # the targets, by filling a level step by step
    names = sorted((s for s in own if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, total = set(), sum(own.values())
    while True:
        level = (total - sum(3 * own[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * weight[s] > 3 * own[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert target[s] == pytest.approx(3 * own[s] if s in full else level * weight[s])
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK + 1
    assert sorted(map(tuple, told), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_apportionment_gives_the_highest_quotients(spark):
    votes = {("g", i): v for i, v in enumerate([53.0, 24.0, 23.0, 7.5, 0.0, 120.25])} | {("h", i): v for i, v in enumerate([1.0, 1.0, 1.0])}
    df = spark.createDataFrame([(g, i, v, {"g": 41, "h": 2}[g]) for (g, i), v in votes.items()], "g string, i int, v double, s long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "i", "v", "s").collect()}
    for g, seats in (("g", 41), ("h", 2)):
        quotients = sorted(((-v / (2 * k + 1), i) for (x, i), v in votes.items() if x == g and v for k in range(seats)))[:seats]
        want = Counter(i for _, i in quotients)
        assert all(got[g, i] == want[i] for x, i in votes if x == g)


def test_mixing_deals_rows_without_id_and_empty_texts(spark, monkeypatch):
    rows = [(None, f"word{k} " * (50 * (k % 5)), "web") for k in range(300)] + [(k, f"text {k}", "book") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)  # four shards of the larger source
    told = mixing.mix(docs).collect()
    assert len(told) == len(rows) and sum(r.size == 0 for r in told) == 60
    assert all(r.taken == 0 for r in told if r.size == 0)
    taken, target = Counter(), {}
    for r in told:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 * 3 * mixing.BLOCK for s in target)
    from pyspark.sql import functions as F

    narrow = docs.withColumns({"size": mixing.words(F.col("text")), "print": mixing.print_of(F.col("text"))}).drop("text")
    assert mixing.laid(narrow).where("size > 0").count() == 280


def test_mixed_texts_follow_the_takes(docs, odd):
    unique = odd.dropDuplicates(["doc_id"])
    takes = {r.doc_id: r.taken for r in mixing.mix(unique).collect()}
    out = mixing.mixed_texts(unique)
    assert out.columns == unique.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(got[i] == n for i, n in takes.items())


def test_sharding(docs, rows):
    told = sharding.shard(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in told) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    load, places = Counter(), defaultdict(list)
    for r in told:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.shard for r in told} == set(range(16)) and {r.law for r in told} == {"bytes"}
    biggest = max(r.size for r in told)
    assert max(load.values()) - min(load.values()) <= biggest


def test_growing_moves_whole_slots_into_the_new_shard(docs):
    rows = sharding.sized(docs, 64).cache()
    old = sharding.slot_map(rows, 4, 64)
    new = sharding.rebalanced(rows, old, 5, 64)
    before, after = ({r.virtual_slot: r.shard for r in m.collect()} for m in (old, new))
    moved = {s for s in before if before[s] != after[s]}
    assert moved and {after[s] for s in moved} == {4}
    assert {r.version for r in new.collect()} == {2}


def test_edit_embedding(docs, rows):
    order = sorted(rows, key=lambda r: (-r[0], (r[1] or "").encode()))
    told = defaultdict(list)
    for r in ee.describe(docs).collect():
        told[r.doc_id].append(r)
    assert sum(map(len, told.values())) == len(rows)
    prints = {}
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[:len(t) - half] + after[:half]
        digest = hashlib.sha256(changed.encode()).hexdigest()
        match = [r for r in told[i] if r.edited_sha256 == digest and r.n_chars == len(t)]
        assert match
        assert prints.setdefault(t, match[0].fingerprint) == match[0].fingerprint
        assert 0 <= match[0].near_edited <= 1 and 0 <= match[0].near_next <= 1
        assert match[0].near_edited == ee.likeness(match[0].fingerprint, match[0].edited_fingerprint)


def test_likeness_follows_edits():
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghij klmnop"))
    base = "".join(rng.choice(letters, 4000))
    one = base[:1000] + "x" + base[1003:]
    other = "".join(rng.choice(letters, 4000))
    p, q, r, s = ee.fingerprints([base, one, base[:2000] + other[2000:], other])
    assert ee.likeness(p, p) == 1
    assert ee.likeness(p, q) > 0.75 > ee.likeness(p, r) > 0.25 > ee.likeness(p, s)


def test_similar_documents_by_bands(docs):
    prints = ee.describe(docs).select("doc_id", "fingerprint")
    found = {r.doc_id for r in ee.similar(prints).collect()}
    assert set(range(201, 230)) <= found


def test_similar_reads_whole_walks_and_all_of_a_band(spark):
    """Long texts edited at their start, and texts behind one common opening, against the likeness of all pairs."""
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefghij klmnop"), n))
    opening, found = text(1500), []
    for _ in range(8):
        body = text(9000)
        found += [text(1200) + body, text(1200) + body]
    for _ in range(8):
        body = text(9000)
        found += [opening + body, opening + body[:4000] + "x" + body[4000:]]
    prints = ee.fingerprints(found)
    want = {(j, i) for i in range(len(found)) for j in range(i + 1, len(found)) if ee.likeness(prints[i], prints[j]) >= 0.8}
    assert len(want) >= 10
    told = ee.similar(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()
    assert {(r.doc_id, r.head_id) for r in told} == want
    # one band for all: a head that is unlike the rest hides nothing
    told = ee.similar(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string"), bands=1, width=1).collect()
    same = [(r.doc_id, r.head_id) for r in told]
    keys = [set(ee.band_keys(p, 0.8, 1, 1)) for p in prints]
    assert set(same) == {(j, i) for j, i in want if keys[i] & keys[j]}


def test_empty_tables(empty, spark):
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert ee.describe(empty).count() == 0


def test_common_shingles_of_few_sets_still_link(spark):
    """Copied texts whose shingles are all common, each with one longer variant: their lists are dealt out by salt, mostly one set a cell."""
    rnd = random.Random(7)
    rows = []
    for family in range(24):
        words = [f"f{family}x{k}" for k in range(4)]
        while len(words) < 13:
            words.append(f"f{family}y{rnd.randrange(10 ** 6)}")
        first = 1000 * family
        rows += [(first + k, " ".join(words[:-1])) for k in range(70)] + [(first + 500, " ".join(words))]
    want = linked_components(rows)
    assert all(want[1000 * f + 500] == (9, 1000 * f) for f in range(24))
    told = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(told) == len(rows)
    assert [r for r in told if want[r.doc_id] != (r.n_shingles, r.component_id)] == []


def _boilerplate(n, common, own, seed):
    """n texts of one shared passage and own words; every tenth is a near copy of the one before."""
    rnd = random.Random(seed)
    shared, rows, words = [f"b{k}" for k in range(common)], [], []
    for i in range(n):
        if i % 10 != 9:
            words = shared + [f"o{i}x{k}" for k in range(own)]
        else:
            words = [*words[:-1], f"z{rnd.randrange(10 ** 6)}"]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("common,own", [(150, 80), (205, 25), (215, 12)])
def test_boilerplate_texts_link_as_brute_force(spark, monkeypatch, common, own):
    """Texts that share from two fifths to nearly all of their words: apart up to eight ninths, then one component."""
    monkeypatch.setattr(jaccard_join, "COMMON", 8)
    rows = _boilerplate(120, common, own, common)
    want = linked_components(rows)
    told = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in told} == want


def test_boilerplate_lists_are_dealt_out_and_open_no_pairs(spark):
    """Shingles that all texts share are listed last, in parts, and no set lists them as the smaller one of a pair."""
    n = 2000
    docs = spark.createDataFrame(_boilerplate(n, 195, 35, 1), "doc_id long, text string")
    spread = spark.sparkContext.broadcast(jaccard_join.common_cells(docs, n))
    told = jaccard_join.entries(docs, spread, 0).selectExpr("g", "meta >> 40 AS salt", "(meta & 1) = 1 AS flag")
    assert told.groupBy("g", "salt").count().agg({"count": "max"}).first()[0] < n / 10
    shared = told.groupBy("g").agg({"salt": "count", "flag": "max"}).where("`count(salt)` > 100").collect()
    assert shared and not any(r["max(flag)"] for r in shared)


def test_shards_are_balanced_without_ids(spark):
    """A third of the rows without id, a third with one id: bytes stay near equal."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * 8) for i in range(6000)]
    told = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg({"size": "sum"}).collect()
    sums = [r[1] for r in told]
    assert len(sums) == 16 and max(sums) <= 1.05 * min(sums)


@pytest.mark.parametrize("large", [10_000, 2])
def test_lowest_of_every_group(spark, large, monkeypatch):
    """Large groups are cut where they are read: no exchange of all their rows by group."""
    from parley.llm import common
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "LARGE_GROUPS", large)
    rows = spark.range(4000).select(F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "mid").when(F.col("id") < 100, None).otherwise("low").alias("g"), F.col("id").alias("doc_id"))
    got = defaultdict(set)
    for r in common.lowest(rows, "g", 5, "seed").collect():
        got[r.g].add(r.doc_id)
    chance = {r.doc_id: (r.c, r.doc_id) for r in rows.select("doc_id", F.pmod(F.xxhash64(F.lit("seed"), "doc_id"), F.lit(1 << 40)).alias("c")).collect()}
    own = defaultdict(list)
    for r in rows.collect():
        own[r.g].append(r.doc_id)
    for g in ("big", "mid", "low"):
        assert got[g] == set(sorted(own[g], key=chance.get)[:5])
    plan = common.lowest(rows, "g", 5, "seed")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(g") < plan.index("BroadcastHashJoin")  # the join with the counts lies below the exchange
