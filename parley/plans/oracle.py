"""SQL text of the checking engine: the derived inputs and small expression builders."""

from __future__ import annotations

from parley import fixed
from parley.settings import DEFAULTS as C
from parley.sources import tables as tb


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def join(x: str) -> str:
    return f"array_to_string({x}, ' ')"


SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def clean(x: str, n: int = C.value_chars) -> str:
    return f"rtrim(substr(trim(regexp_replace({x}, '{SPACES}', ' ', 'g'), ' -;,.'), 1, {n}), ' ')"


def distinct(x: str) -> str:
    """Distinct list elements in first-appearance order."""
    return f"list_filter({x}, lambda dv, di: list_position({x}, dv) = di)"


def fam(x: str) -> str:
    low = f"lower({x})"
    out = f"CASE WHEN contains({low}, 'budget') OR regexp_matches({low}, '{fixed.BUDGET_PATTERN}') THEN 'budget'"
    for name, cues in fixed.FAMILY_WORDS:
        out += " WHEN " + " OR ".join(f"contains({low}, {lit(c)})" for c in cues) + f" THEN '{name}'"
    return out + " ELSE 'feature' END"


# --- derived inputs -------------------------------------------------------------------------------
VIEWS = {
    "fx_items": """SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title,
 substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, lang AS categories,
 source AS store, n_chars AS rating_number FROM documents""",
    "fx_products": f"""SELECT p.p_partkey AS item_id, p.p_name AS title, p.p_name || ' ' || p.p_type AS features,
 p.p_name, p.p_type, p.p_size, split_part(p.p_name, ' ', 2) AS noun,
 '{tb.ROOT_CATEGORY} ' || p.p_type || ' ' || split_part(p.p_name, ' ', 2) AS categories,
 'size ' || p.p_size || ' department ' || p.p_type AS details, p.p_brand AS store,
 p.p_retailprice AS price, coalesce(c.n, 0) AS rating_number
 FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) c
 ON p.p_partkey = c.l_partkey""",
    "fx_lines": f"""SELECT CAST(l_orderkey + (line - 1) // {tb.TURNS} * {tb.PART} AS BIGINT) AS session_id, item_id, price,
 (line - 1) % {tb.TURNS} + 1 AS turn FROM (SELECT l_orderkey, l_partkey AS item_id, l_extendedprice AS price,
 row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS line FROM lineitem) numbered""",
    "fx_talks": """SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS turn,
 text AS user_message FROM conversations WHERE role = 'user'""",
    "fx_sessions": f"""SELECT session_id, item_id AS target, {tb.SCENARIO} AS scenario_type,
 {tb.OVERRIDE_TURN} AS override_turn FROM (SELECT session_id, item_id,
 row_number() OVER (PARTITION BY session_id ORDER BY price DESC, item_id, turn) AS r FROM fx_lines) t WHERE r = 1""",
    "fx_turns": """SELECT session_id, turn, 1 AS pos, CAST(-1 AS BIGINT) AS item_id FROM fx_lines
 UNION ALL SELECT session_id, turn, 2, item_id FROM fx_lines
 UNION ALL SELECT session_id, turn, 3, item_id FROM fx_lines
 UNION ALL SELECT session_id, turn - 1, 4, item_id FROM fx_lines WHERE turn >= 2""",
    "fx_messages": f"""SELECT session_id, turn, {tb.MESSAGE} AS user_message
 FROM fx_lines JOIN fx_sessions USING (session_id) JOIN part ON item_id = p_partkey""",
    "fx_free": "SELECT item_id AS message_id, text AS user_message FROM benchmark",
    # token lists of the index fields
    "pfields": " UNION ALL ".join(
        f"SELECT item_id, '{f}' AS field, {i} AS ord, CAST({fixed.FIELD_WEIGHTS[f]} AS DOUBLE) AS weight, "
        f"{tok(f)} AS toks FROM fx_products"
        for i, f in enumerate(("title", "categories", "features", "details", "store"))),
    "dfields": " UNION ALL ".join(
        f"SELECT item_id, '{f}' AS field, {i} AS ord, CAST({fixed.FIELD_WEIGHTS[f]} AS DOUBLE) AS weight, "
        f"{tok(f)} AS toks FROM fx_items"
        for i, f in enumerate(("title", "categories", "store", "description"))),
}
for _p in ("p", "d"):
    VIEWS[f"{_p}text"] = (f"SELECT item_id, field, weight, ' ' || {join('toks')} || ' ' AS ftext FROM {_p}fields")
    VIEWS[f"{_p}blob"] = (
        "SELECT item_id, ' ' || string_agg(array_to_string(toks, ' '), ' ' ORDER BY ord) || ' ' AS blob, "
        f"sum(len(toks)) AS n_toks FROM {_p}fields WHERE len(toks) > 0 GROUP BY item_id")
NEEDS = {
    "fx_sessions": ["fx_lines"], "fx_turns": ["fx_lines"], "fx_messages": ["fx_lines", "fx_sessions"],
    "pfields": ["fx_products"], "dfields": ["fx_items"], "ptext": ["fx_products", "pfields"],
    "dtext": ["fx_items", "dfields"], "pblob": ["fx_products", "pfields"], "dblob": ["fx_items", "dfields"],
}


def sql(uses: str, body: str, **ctes: str) -> str:
    """WITH text: the named inputs with what they need, then extra CTEs in order, then the query."""
    order: list[str] = []
    for name in uses.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [
        f"{n.lstrip('_')} AS ({q})" if not n.startswith("recursive_") else f"{n[10:]} AS ({q})"
        for n, q in ctes.items()]
    head = "WITH RECURSIVE " if any(n.startswith("recursive_") for n in ctes) else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


# --- disclosed values of the product catalogue ---------------------------------------------------
_corpus = "title || ' ' || features || ' ' || details || ' ' || categories || ' ' || store"
_mat = f"nullif(lower(regexp_extract({_corpus}, '(?i)\\b({'|'.join(fixed.MATERIALS)})\\b', 1)), '')"
_col = f"nullif(lower(regexp_extract({_corpus}, '(?i)\\b({'|'.join(fixed.COLOURS)})\\b', 1)), '')"
VALUES = dict(
    vraw=f"""SELECT item_id, title, price, {_mat} AS mat, {_col} AS col,
 [p_name, p_type, 'size: ' || p_size, 'department: ' || p_type] AS base FROM fx_products""",
    vmat="SELECT *, CASE WHEN mat IS NOT NULL THEN list_prepend(mat, base) ELSE base END AS l1 FROM vraw",
    vcol="""SELECT *, CASE WHEN col IS NOT NULL THEN list_concat(list_concat(l1[1:1], ['color: ' || col]), l1[2:])
 ELSE l1 END AS l2 FROM vmat""",
    vall="SELECT *, list_concat(l2, ['budget around $' || CAST(price AS VARCHAR)]) AS l3 FROM vcol",
    vclean=f"""SELECT item_id, {clean('title')} AS card_title,
 list_filter(list_transform(l3, lambda v: {clean('v')}), lambda v: v <> '') AS l4 FROM vall""",
    vuniq=f"SELECT item_id, card_title, {distinct('l4')} AS l5 FROM vclean",
    vcard="""SELECT item_id, card_title, l5[1:2] AS hard,
 CASE WHEN len(l5[3:4]) > 0 THEN l5[3:4] ELSE l5[1:1] END AS soft FROM vuniq""",
    pvals=f"SELECT item_id, {distinct('list_concat(hard, soft)')} AS vals FROM vcard",
)

# --- message understanding over fx_messages -------------------------------------------------------
_known = " OR ".join(f"regexp_matches(trim(user_message), {lit(p)})" for p in fixed.KNOWN_SHAPES)
NOINFO = f"regexp_matches(user_message, {lit(fixed.P_NO_PREFERENCE)})"
KNOWN = f"({_known})"
OVERRIDE = (f"(regexp_matches(user_message, {lit(fixed.P_OVERRIDE)}) OR "
            f"regexp_matches(user_message, {lit(fixed.P_OVERRIDE_CUE)}))")
CLAUSE = f"trim(regexp_extract(user_message, {lit(fixed.P_LOOKING)}, 1))"
CONS = ("list_filter(list_transform(list_concat(" + "list_concat(" + ", ".join(
    f"string_split(regexp_extract(user_message, {lit(p)}, 1), ';')"
    for p in (fixed.P_REQUIREMENT, fixed.P_MATTERS)) + "), "
    f"string_split(regexp_extract(user_message, {lit(fixed.P_OVERRIDE)}, 1), ';')), lambda v: trim(v)), lambda v: v <> '')")


def value_phrase(x: str, cap: int = C.resolve_tokens) -> str:
    label = lit(fixed.P_COLOUR_LABEL)
    bare = f"CASE WHEN regexp_matches({x}, {label}) THEN trim(regexp_extract({x}, {label}, 1)) ELSE {x} END"
    return join(f"({tok(bare)})[1:{cap}]")


MESSAGES = dict(
    texts="SELECT DISTINCT user_message FROM fx_messages",
    flags=f"""SELECT user_message, {NOINFO} AS noinfo, {KNOWN} AS known, {OVERRIDE} AS override,
 {CLAUSE} AS clause, {CONS} AS cons FROM texts""",
    # tail of an override opening: split at every ". " and take the first tail that is no requirement
    pieces="""SELECT user_message, string_split(substr(trim(user_message), 17), '. ') AS ps
 FROM texts WHERE starts_with(lower(trim(user_message)), 'i''m looking for ')""",
    tails="""SELECT user_message, trim(min_by(tail, i)) AS tail FROM (
 SELECT user_message, i, array_to_string(ps[i + 1:], '. ') AS tail, array_to_string(ps[1:i], '. ') AS head
 FROM (SELECT user_message, ps, unnest(range(1, len(ps))) AS i FROM pieces) u) v
 WHERE head <> '' AND tail <> '' AND NOT starts_with(lower(tail), 'a key requirement is:') GROUP BY user_message""",
    said="SELECT * FROM flags WHERE NOT noinfo",
    parts0=f"""SELECT user_message, clause, list_filter({tok('clause')}, lambda t: length(t) > 2) AS parts
 FROM said WHERE len({tok('clause')}) >= 2""",
    stated=f"""SELECT user_message, 0 AS seq, {value_phrase('clause')} AS phrase, 'cat' AS tier,
 CASE WHEN len(parts) >= 2 THEN {join('parts')} END AS needs FROM parts0
 UNION ALL SELECT user_message, 1 * (1::BIGINT << 40) + i - 1, parts[i], 'cat', NULL
 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM parts0) a
 UNION ALL SELECT user_message, 2 * (1::BIGINT << 40) + i - 1, {value_phrase('cons[i]')}, 'con', NULL
 FROM (SELECT *, unnest(range(1, len(cons) + 1)) AS i FROM said) b
 UNION ALL SELECT t.user_message, 8 * (1::BIGINT << 40), {value_phrase('tail')}, 'con', NULL
 FROM tails t JOIN said USING (user_message) WHERE len({tok('tail')}) > 0""",
    # exact category phrases and short values in messages of unknown wording
    vocab=f"""SELECT DISTINCT {join(tok('v'))} AS phrase FROM (SELECT unnest(vals) AS v FROM pvals) z
 WHERE len({tok('v')}) BETWEEN 1 AND 3 AND {join(tok('v'))} NOT IN ({', '.join(lit(f) for f in fixed.FACET_NAMES)})""",
    cats=f"SELECT DISTINCT {join(tok('p_type || chr(32) || noun'))} AS phrase FROM fx_products",
    stoks=f"SELECT user_message, {tok('user_message')} AS toks FROM said WHERE NOT known",
    cgrams="""SELECT user_message, i, array_to_string(toks[i:i + 1], ' ') AS phrase FROM (
 SELECT user_message, toks, unnest(range(1, len(toks))) AS i FROM stoks) x""",
    chit="SELECT user_message, min(phrase) AS category FROM cgrams WHERE phrase IN (SELECT phrase FROM cats) GROUP BY user_message",
    cat1="""SELECT c.user_message, c.category, min(g.i) AS at_tok FROM chit c JOIN cgrams g
 ON c.user_message = g.user_message AND c.category = g.phrase GROUP BY c.user_message, c.category""",
    rest="""SELECT t.user_message, c.category, CASE WHEN c.category IS NULL THEN t.toks
 ELSE list_concat(t.toks[1:c.at_tok - 1], t.toks[c.at_tok + 2:]) END AS toks FROM stoks t LEFT JOIN cat1 c ON t.user_message = c.user_message""",
    agrams="""SELECT user_message, i, n, array_to_string(toks[i:i + n - 1], ' ') AS phrase FROM (
 SELECT user_message, toks, i, unnest([1, 2, 3]) AS n FROM (SELECT user_message, toks, unnest(range(1, len(toks) + 1)) AS i
 FROM rest) x) y WHERE i + n - 1 <= len(toks)""",
    ahit="""SELECT user_message, phrase, n, min(i) AS start FROM agrams WHERE phrase IN (SELECT phrase FROM vocab)
 GROUP BY user_message, phrase, n""",
    spans="""SELECT user_message, 3 * (1::BIGINT << 40) AS seq, category AS phrase, 'cat' AS tier FROM cat1
 UNION ALL SELECT user_message, 4 * (1::BIGINT << 40) + i, string_split(category, ' ')[i + 1], 'cat' FROM (SELECT *, unnest([0, 1]) AS i FROM cat1) z
 UNION ALL SELECT user_message, 5 * (1::BIGINT << 40) + start * 4 + n, phrase, 'mined' FROM ahit""",
    wanted="""SELECT phrase FROM stated WHERE phrase <> '' UNION SELECT needs FROM stated WHERE needs IS NOT NULL
 UNION SELECT phrase FROM spans""",
    pdf=f"""SELECT w.phrase, least(count(DISTINCT t.item_id), {C.df_cap + 1}) AS df FROM wanted w
 LEFT JOIN ptext t ON contains(t.ftext, ' ' || w.phrase || ' ') GROUP BY w.phrase""",
    tev="""SELECT user_message, phrase, min(seq) AS seq, min_by(tier, seq) AS tier, min_by(df, seq) AS df FROM (
 SELECT s.user_message, s.seq, s.phrase, s.tier, d.df FROM stated s JOIN pdf d ON s.phrase = d.phrase
 LEFT JOIN pdf n ON s.needs = n.phrase WHERE d.df > 0 AND (s.needs IS NULL OR n.df > 0)
 UNION ALL SELECT a.user_message, a.seq, a.phrase, a.tier, CASE WHEN d.df > 0 THEN d.df ELSE 5430 END
 FROM spans a JOIN pdf d ON a.phrase = d.phrase) q GROUP BY user_message, phrase""",
    rows0="""SELECT m.session_id, m.turn, e.seq, e.phrase, e.tier, e.df FROM fx_messages m
 JOIN tev e ON m.user_message = e.user_message""",
    ledger="""SELECT session_id, phrase, turn, seq, tier, df FROM (SELECT *, row_number() OVER (
 PARTITION BY session_id, phrase ORDER BY turn, seq) AS r FROM rows0) x WHERE r = 1""",
)
STATES = dict(
    obs="""SELECT m.session_id, m.turn, f.noinfo, f.known, f.override,
 CASE WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.session_id = m.session_id AND l.turn = m.turn AND l.seq < 8 * (1::BIGINT << 40))
 THEN 1 ELSE 0 END AS grew FROM fx_messages m JOIN flags f ON m.user_message = f.user_message""",
    isl="""SELECT *, sum(grew) OVER w AS island, CAST(sum(CASE WHEN NOT noinfo AND NOT known THEN 1 ELSE 0 END) OVER w AS BIGINT) AS lost,
 CAST(sum(CASE WHEN override THEN 1 ELSE 0 END) OVER w AS BIGINT) AS epoch FROM obs
 WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    states="""SELECT session_id, turn, grew, lost, epoch, CAST(sum(CASE WHEN NOT noinfo AND grew = 0 THEN 1 ELSE 0 END)
 OVER (PARTITION BY session_id, island ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stale FROM isl""",
)
