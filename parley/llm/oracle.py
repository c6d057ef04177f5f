"""Checking SQL (DuckDB) of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from parley.llm import importance, mixing, sharding, warc

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hashed(seed: str, text: str) -> str:
    """60 bits of an MD5, as a whole number."""
    return f"CAST('0x' || substr(md5('{seed}|' || {text}), 1, 15) AS BIGINT)"


JACCARD = rf"""WITH RECURSIVE split AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM split),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.g"""

DEDUP = """SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
ON coalesce(d.text, '') = g.t"""

MIXING = rf"""WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
 coalesce(CAST(doc_id AS VARCHAR), '') || '|' || substr(md5(coalesce(text, '')), 1, 16) AS name FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM docs GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM sources),
weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight, {mixing.MOST} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM placed),
levels AS (SELECT a.place, CAST(a.total - coalesce((SELECT sum(b.cap) FROM weighed b WHERE (b.cap / b.weight, b.place) < (a.cap / a.weight, a.place)), 0) AS DOUBLE)
 / (SELECT sum(b.weight) FROM weighed b WHERE (b.cap / b.weight, b.place) >= (a.cap / a.weight, a.place)) AS level FROM weighed a),
common AS (SELECT max(l.level) AS level FROM levels l JOIN weighed w ON l.place = w.place WHERE l.level * w.weight <= w.cap),
goals AS (SELECT w.*, least(CAST(cap AS DOUBLE), coalesce(c.level * weight, CAST(cap AS DOUBLE))) AS target FROM weighed w CROSS JOIN common c),
seats AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r FROM (
 SELECT place, target, total, unnest(range(0, CAST(round(total / {mixing.BLOCK}) AS BIGINT) + 1)) AS k FROM goals WHERE target > 0) x),
quotas AS (SELECT place, count(*) AS quota FROM seats WHERE r <= round(total / {mixing.BLOCK}) GROUP BY place),
lines AS (SELECT d.*, g.source_size, g.target, coalesce(q.quota, 0) AS source_quota, g.place,
 {_hashed(mixing.SEED + '/shard', "d.name")} % (g.source_size // {mixing.SHARD_WORDS} + g.source_rows // {mixing.SHARD_ROWS} + 1) AS shard,
 {_hashed(mixing.SEED, "d.name")} AS h
 FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN quotas q ON q.place = g.place),
shards AS (SELECT place, shard, source_quota, min(source) AS source, CAST(sum(size) AS BIGINT) AS words FROM lines GROUP BY place, shard, source_quota),
shard_seats AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY words / (2 * k + 1) DESC, shard, k) AS r FROM (
 SELECT place, shard, words, source_quota, unnest(range(0, source_quota + 1)) AS k FROM shards WHERE words > 0) x),
shard_quotas AS (SELECT s.place, s.shard, s.words, s.source, CAST(ceil(s.words / {mixing.BLOCK}) AS BIGINT) AS blocks,
 least(coalesce(q.quota, 0), {mixing.MOST} * CAST(ceil(s.words / {mixing.BLOCK}) AS BIGINT)) AS quota FROM shards s LEFT JOIN (
 SELECT place, shard, count(*) AS quota FROM shard_seats WHERE r <= source_quota GROUP BY place, shard) q ON q.place = s.place AND q.shard = s.shard),
runs AS (SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS times, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS rest,
 CASE WHEN blocks > 0 THEN {_hashed(mixing.SEED + '/first', "coalesce('=' || source, '') || '|' || CAST(shard AS VARCHAR)")} % blocks ELSE 0 END AS first FROM shard_quotas),
ended AS (SELECT l.*, r.times, r.rest, r.first, r.blocks, sum(l.size) OVER (PARTITION BY l.place, l.shard ORDER BY l.h, l.doc_id, l.size
 ROWS UNBOUNDED PRECEDING) AS stop FROM lines l JOIN runs r ON r.place = l.place AND r.shard = l.shard),
cut AS (SELECT *, least(size, greatest(0, least(first + rest, blocks) * {mixing.BLOCK} - (stop - size))) - least(size, greatest(0, first * {mixing.BLOCK} - (stop - size)))
 + least(size, greatest(0, greatest(0, first + rest - blocks) * {mixing.BLOCK} - (stop - size))) AS part FROM ended)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(times * size + part AS BIGINT) AS taken FROM cut"""

SHARDING = f"""WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
 FROM (SELECT unnest(range(256)) AS n) x),
rows AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS MATERIALIZED (SELECT r.*, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM rows r CROSS JOIN crc_table),
sums AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % {sharding.SLOTS} AS virtual_slot FROM crcs),
loads AS (SELECT s.slot AS virtual_slot, coalesce(sum(r.size), 0) AS bytes FROM (SELECT unnest(range({sharding.SLOTS})) AS slot) s LEFT JOIN sums r ON r.virtual_slot = s.slot GROUP BY s.slot),
ordered AS MATERIALIZED (SELECT virtual_slot, CAST(bytes AS BIGINT) AS bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS i FROM loads),
dealt AS (SELECT CAST(0 AS BIGINT) AS i, CAST(list_transform(range({sharding.SHARDS}), lambda x: 0) AS BIGINT[]) AS held, CAST(-1 AS BIGINT) AS virtual_slot, CAST(0 AS BIGINT) AS shard
 UNION ALL SELECT o.i, list_transform(d.held, lambda x, k: CASE WHEN k = list_position(d.held, list_min(d.held)) THEN x + o.bytes ELSE x END), o.virtual_slot,
 list_position(d.held, list_min(d.held)) - 1 FROM dealt d JOIN ordered o ON o.i = d.i + 1)
SELECT s.doc_id, s.size, CAST(s.text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(d.shard AS INTEGER) AS shard,
 row_number() OVER (PARTITION BY d.shard ORDER BY s.virtual_slot, s.doc_id, s.text_crc32, s.size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard,
 CAST(s.virtual_slot AS INTEGER) AS virtual_slot FROM sums s JOIN dealt d ON d.virtual_slot = s.virtual_slot"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{importance.WORD}')"
IMPORTANCE = rf"""WITH crc_table AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
 FROM (SELECT unnest(range(256)) AS n) x),
raw AS (SELECT doc_id, row_number() OVER () AS line, {_WORDS} AS w FROM documents),
told AS (SELECT line, unnest(w) AS word FROM raw), wanted AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM told UNION SELECT word FROM wanted) x),
bucketed AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {importance.BUCKETS} AS bucket FROM vocabulary CROSS JOIN crc_table),
s AS (SELECT bucket, count(*) AS n FROM told JOIN bucketed USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM wanted JOIN bucketed USING (word) GROUP BY bucket),
sums AS (SELECT CAST((SELECT count(*) FROM told) AS DOUBLE) AS all_s, CAST((SELECT count(*) FROM wanted) AS DOUBLE) AS all_t),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * (all_s + {importance.BUCKETS}) / (CAST(s.n + 1 AS DOUBLE) * (all_t + {importance.BUCKETS})))) AS BIGINT) AS gain
 FROM s LEFT JOIN t ON t.bucket = s.bucket CROSS JOIN sums),
weights AS (SELECT line, CAST(sum(gain) AS BIGINT) AS weight FROM told JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY line),
scored AS (SELECT doc_id, raw.line, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
 (CAST(CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM raw LEFT JOIN weights USING (line)),
placed AS (SELECT line, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {importance.PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (line)"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS size,
 sha1(coalesce(html, '')) AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place,
 max(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages),
d AS (SELECT *, place > 1 AND size >= {warc.LEAST_BYTES} AS again FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
 lambda s: substr('{_BASE32}', CAST((CAST('0x' || substr(h, 5 * CAST(i AS INTEGER) + 1, 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
 CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to FROM d"""

ORACLES = {"op1_jaccard_join": JACCARD, "op5_exact_dedup": DEDUP, "op6_mixing": MIXING, "op9_sharding": SHARDING,
           "op11_importance": IMPORTANCE, "op12_warc": WARC}
