"""Session ledger in batch form: evidence, staleness, loss, rejections, carried rankings.

A session holds at most `max_turns` turns, so windows by session are bounded; everything that could be
larger (phrases, items, texts) is grouped with mergeable aggregates instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import messages as ms
from parley.functions import text as tx
from parley.operators import mining, phrases as ph
from parley.operators.index import PhraseIndex
from parley.plans import scale
from parley.settings import DEFAULTS, Settings

# Order of a text's evidence: source number * GROUP + place. A string has fewer than 2**31 bytes, so no place reaches GROUP.
GROUP = 1 << 40
LATE = 8 * GROUP
EVIDENCE = "array<struct<seq:bigint,phrase:string,tier:string,df:bigint>>"


def said_text() -> Column:
    """The message text; a null message is an empty one, which says nothing and is of unknown wording."""
    return F.coalesce("user_message", F.lit(""))


def message_flags(texts: DataFrame) -> DataFrame:
    """Per text: no-preference, recognised and override flags, and whether a template states a constraint."""
    m = F.col("user_message")
    return texts.select("*", ms.no_preference(m).alias("noinfo"), ms.recognised(m).alias("known"),
                        ms.override(m).alias("override"), (F.size(ms.constraints(m)) > 0).alias("states_con"))


def template_candidates(texts: DataFrame, cfg: Settings = DEFAULTS, key: str = "user_message") -> DataFrame:
    """(key, seq, phrase, tier, deparaphrase, needs) from the category clause, the constraint
    templates and the override opening. `needs` is a second phrase that must be attested too."""
    m = F.col("user_message")
    clause = ms.looking_for(m)
    parts = ms.category_parts(clause)
    null = F.lit(None).cast("string")

    def entry(seq, phrase, tier, deparaphrase, needs=null):
        return F.struct(seq.cast("bigint").alias("seq"), phrase.alias("phrase"), F.lit(tier).alias("tier"),
                        F.lit(deparaphrase).alias("deparaphrase"), needs.alias("needs"))

    staged = texts.select(
        key, clause.alias("clause"), parts.alias("parts"),
        ms.constraints(m).alias("cons"), ms.override_tail(m).alias("tail"))
    whole = F.when(F.col("clause").isNotNull(), F.array(entry(
        F.lit(0), ms.value_phrase(F.col("clause"), cfg.resolve_tokens), "cat", False,
        F.when(F.size("parts") >= 2, tx.phrase_of(F.col("parts"))))))
    split = F.when(F.col("clause").isNotNull(), F.transform(
        "parts", lambda p, i: entry(i + F.lit(GROUP), p, "cat", False)))
    cons = F.transform("cons", lambda c, i: entry(
        i + F.lit(2 * GROUP), ms.value_phrase(c, cfg.resolve_tokens), "con", True))
    tail = F.when(F.col("tail").isNotNull(), F.array(entry(
        F.lit(LATE), ms.value_phrase(F.col("tail"), cfg.resolve_tokens), "con", False)))
    none = F.expr("cast(array() as array<struct<seq:bigint,phrase:string,tier:string,"
                  "deparaphrase:boolean,needs:string>>)")
    rows = F.concat(*[F.coalesce(x, none) for x in (whole, split, cons, tail)])
    return staged.select(key, F.inline(rows)).filter(F.col("phrase") != "")


def text_evidence(messages: DataFrame, indexed: DataFrame | PhraseIndex, categories: DataFrame | None = None,
                  attributes: DataFrame | None = None, proposals: DataFrame | None = None,
                  cleaned: DataFrame | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per distinct message text: its flags and its evidence in order.

    Repeated texts are analysed once, and what is derived from one carries its digest (text_id). `cleaned` holds (user_message, kept_text) of a tagger;
    `categories`/`attributes` switch span lookup on; `proposals` feed admission.
    """
    texts = scale.keep(message_flags(messages.select(said_text().alias("user_message")).distinct())
                       .withColumn("text_id", tx.digest(F.col("user_message"))))
    said = texts.filter(~F.col("noinfo"))
    stated = scale.keep(template_candidates(said, cfg, "text_id"))
    wanted = stated.select("phrase").unionByName(
        stated.filter("needs is not null").select(F.col("needs").alias("phrase")))
    if proposals is not None:
        wanted = wanted.unionByName(proposals.select(ph.proposal_phrase().alias("phrase")))
    freq = scale.keep(ph.document_frequency(indexed, wanted, 1, cfg))
    ok = freq.filter("df > 0").select(F.col("phrase").alias("needs"), F.lit(True).alias("_ok"))
    stated_ok = stated.join(ok, "needs", "left").filter("needs is null or _ok").drop("needs", "_ok")
    parts = [ph.admit(stated_ok, freq, proposals, cfg).select("text_id", "seq", "phrase", "tier", "df")]

    base = said.select("text_id", "user_message", "known", "states_con")
    if cleaned is not None:
        base = base.join(cleaned.select("user_message", "kept_text"), "user_message", "left")
    else:
        base = base.withColumn("kept_text", F.lit(None).cast("string"))
    base = base.withColumn("mine_text", F.when(F.col("known"), F.col("user_message")).otherwise(
        F.coalesce("kept_text", "user_message")))

    if categories is not None and attributes is not None:
        unknown = base.filter(~F.col("known")).select("text_id", tx.tokens(F.col("mine_text")).alias("toks"))
        cats = scale.keep(mining.span_category(unknown, "text_id", categories, cfg=cfg))
        attrs = mining.span_attributes(
            cats.select("text_id", F.col("rest").alias("toks")), "text_id", attributes, cfg)
        named = cats.filter("category is not null")
        toks = F.split("category", " ")
        span = named.select("text_id", F.lit(3 * GROUP).alias("seq"), F.col("category").alias("phrase"),
                            F.lit("cat").alias("tier"))
        span = span.unionByName(named.select("text_id", F.posexplode(toks).alias("seq", "phrase"))
                                .select("text_id", (F.col("seq") + F.lit(4 * GROUP)).alias("seq"), "phrase",
                                        F.lit("cat").alias("tier")))
        at = (F.lit(5 * GROUP) + F.col("start") * (cfg.attribute_tokens + 1) + F.col("n")).alias("seq")
        span = scale.keep(span.unionByName(attrs.select("text_id", at, "phrase",
                                                        F.lit("mined").alias("tier"))))
        sfreq = ph.document_frequency(indexed, span, 1, cfg)
        parts.append(span.join(sfreq.select("phrase", "df"), "phrase").select(
            "text_id", "seq", "phrase", "tier", "df"))

    # mining runs where the templates stated no constraint, attested or not
    free = base.filter(~F.col("states_con"))
    both = free.select("text_id", F.col("mine_text").alias("text"), F.lit(6 * GROUP).alias("at"))
    if cleaned is not None:
        both = both.unionByName(free.filter("mine_text <> user_message").select(
            "text_id", F.col("user_message").alias("text"), F.lit(7 * GROUP).alias("at")))
    both = scale.keep(both.withColumn("mined_id", tx.digest(F.col("text"))))
    mined = mining.mined_rows(mining.mine(both.select(F.col("text").alias("user_message")), indexed, cfg), "text_id")
    parts.append(both.select("text_id", "mined_id", "at").join(mined.withColumnRenamed("text_id", "mined_id"), "mined_id").select(
        "text_id", (F.col("at") + F.col("i")).alias("seq"), "phrase",
        F.lit("mined").alias("tier"), "df"))

    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    stored = F.when(F.col("df") > 0, F.col("df")).otherwise(2 * cfg.df_cap).cast("bigint")
    # a phrase enters once per text, at its first place
    first = rows.groupBy("text_id", "phrase").agg(
        F.min(F.struct("seq", "tier", stored.alias("df"))).alias("e"))
    lists = first.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("e.seq").alias("seq"), F.col("phrase"), F.col("e.tier").alias("tier"),
        F.col("e.df").alias("df")))).cast(EVIDENCE).alias("evidence"))
    return texts.join(lists, "text_id", "left").withColumn(
        "evidence", F.coalesce("evidence", F.expr(f"cast(array() as {EVIDENCE})")))


def observe(messages: DataFrame, evidence: DataFrame, acts: DataFrame | None = None,
            cfg: Settings = DEFAULTS) -> DataFrame:
    """Messages of every session joined with what their text says. `acts` holds (session_id, turn, act)."""
    rows = messages.filter(F.col("turn").between(1, cfg.max_turns)).select(
        "session_id", "turn", tx.digest(said_text()).alias("text_id"))
    rows = rows.join(evidence.drop("user_message"), "text_id", "left")
    act = F.lit(None).cast("string")
    if acts is not None:
        rows = rows.join(acts.select("session_id", "turn", F.col("act").alias("_act")), ["session_id", "turn"], "left")
        # a dialogue act counts only where the wording was unknown
        act = F.when(~F.col("known") & ~F.col("noinfo"), F.col("_act"))
    rows = rows.withColumn("act", act)
    mute = F.coalesce(F.col("act") == fixed.ACT_WITHOUT_EVIDENCE, F.lit(False))
    clears = F.coalesce(F.col("act").isin(*fixed.ACTS_CLEARING_REJECTIONS), F.lit(False))
    noinfo = F.coalesce("noinfo", F.lit(True))
    return rows.select(
        "session_id", "turn", noinfo.alias("noinfo"), F.coalesce("known", F.lit(False)).alias("known"),
        (F.coalesce("override", F.lit(False)) | clears).alias("override"),
        (~noinfo & ~mute).alias("counted"),
        (F.coalesce("states_con", F.lit(False)) & ~noinfo & ~mute).alias("states_con"),
        F.when(mute, F.expr(f"cast(array() as {EVIDENCE})")).otherwise(
            F.coalesce("evidence", F.expr(f"cast(array() as {EVIDENCE})"))).alias("evidence"))


def first_wins(observed: DataFrame) -> DataFrame:
    """Evidence table: the first (turn, seq) to claim a phrase keeps it for the whole session."""
    rows = observed.select("session_id", "turn", F.inline("evidence"))
    best = rows.groupBy("session_id", "phrase").agg(
        F.min(F.struct("turn", "seq", "tier", "df")).alias("e"))
    return best.select("session_id", "e.turn", "e.seq", "phrase", "e.tier", "e.df")


def wording_states(observed: DataFrame) -> DataFrame:
    """Per (session, turn), beside its flags: what follows from the wording alone, lost count, override epoch and buying flag."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return (observed.withColumn("lost", F.sum(F.when(~F.col("noinfo") & ~F.col("known"), 1).otherwise(0)).over(w))
            .withColumn("epoch", F.sum(F.col("override").cast("int")).over(w))
            .withColumn("buying", F.max(F.when((F.col("turn") == 1) & F.col("states_con"), 1).otherwise(0)).over(w)))


def wording(messages: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """`wording_states` of a ledger without dialogue acts. No phrase is looked for in the catalogue; repeated texts are read once."""
    said = said_text()
    texts = message_flags(messages.select(said.alias("user_message")).distinct()).withColumn("text_id", tx.digest(F.col("user_message")))
    none = texts.withColumn("evidence", F.expr(f"cast(array() as {EVIDENCE})"))
    return wording_states(observe(messages, none, cfg=cfg).drop("evidence"))


def turn_states(observed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per (session, turn): grew, stale run length, lost count, override epoch, buying flag."""
    grew = (evidence.filter(F.col("seq") < LATE).groupBy("session_id", "turn")
            .agg(F.lit(1).alias("grew")))
    rows = observed.select(
        "session_id", "turn", "noinfo", "known", "override", "counted", "states_con")
    rows = rows.join(grew, ["session_id", "turn"], "left").withColumn("grew", F.coalesce("grew", F.lit(0)))
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    idle = F.when(F.col("counted") & (F.col("grew") == 0), 1).otherwise(0)
    rows = wording_states(rows.withColumn("island", F.sum("grew").over(w)))
    wi = Window.partitionBy("session_id", "island").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("stale", F.sum(idle).over(wi)).drop("island", "states_con")


def rejected_intervals(shown: DataFrame, turns: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(session, item, from_turn, to_turn): turns at which a shown item counts as rejected.

    An item shown at turn s is rejected from s+1 until the next override clears it. Intervals stand
    for the whole rejected set of every turn without pairing turns with items.
    `turns` holds (session_id, turn, epoch); the epoch of a turn includes its own override.
    """
    ends = turns.groupBy("session_id", "epoch").agg(F.max("turn").alias("to_turn"))
    return (shown.join(turns.select("session_id", "turn", "epoch"), ["session_id", "turn"])
            .groupBy("session_id", "epoch", "item_id").agg((F.min("turn") + 1).alias("from_turn"))
            .join(ends, ["session_id", "epoch"]).filter("from_turn <= to_turn")
            .select("session_id", "item_id", "from_turn", "to_turn"))


def askable(turns: DataFrame, asked: DataFrame) -> DataFrame:
    """(session, turn, attribute) that may be asked: typed ones once, the repeatable one always."""
    options = F.array(*[F.lit(a) for a in fixed.QUESTION_ORDER if a not in fixed.NEVER_ASKED])
    first = (asked.filter("attribute is not null").groupBy("session_id", "attribute").agg(F.min("turn").alias("asked_at"))
             .groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "asked_at"))).alias("m")))
    # met by session, a turn becomes a row an attribute only then
    rows = (turns.select("session_id", "turn").join(first.hint("merge"), "session_id", "left")
            .withColumn("attribute", F.explode(options)).withColumn("asked_at", F.try_element_at("m", F.col("attribute"))))
    return (rows
            .filter((F.col("attribute") == fixed.REPEATABLE) | F.col("asked_at").isNull()
                    | (F.col("asked_at") >= F.col("turn")))
            .select("session_id", "turn", "attribute"))


def last_good(rankings: DataFrame) -> DataFrame:
    """Carry the last non-empty ranking of a session forward."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.size("ranked") > 0, F.col("ranked"))
    return rankings.select("session_id", "turn", F.last(value, ignorenulls=True).over(w).alias("ranked"))


def add_recovered(evidence: DataFrame, recovered: DataFrame, indexed: DataFrame | PhraseIndex,
                  proposals: DataFrame | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Rescue answers join the ledger after everything their turn said, at tier `sem`."""
    rows = recovered.select("session_id", "turn", (F.col("i") + F.lit(LATE + GROUP)).alias("seq"),
                            ms.value_phrase(F.col("phrase"), cfg.resolve_tokens).alias("phrase"),
                            F.lit("sem").alias("tier"), F.lit(True).alias("deparaphrase"))
    rows = scale.keep(rows.filter("phrase <> ''"))
    wanted = rows.select("phrase")
    if proposals is not None:
        wanted = wanted.unionByName(proposals.select(ph.proposal_phrase().alias("phrase")))
    freq = scale.keep(ph.document_frequency(indexed, wanted, 1, cfg))
    got = ph.admit(rows, freq, proposals, cfg).select(*evidence.columns)
    return evidence.unionByName(got).groupBy("session_id", "phrase").agg(
        F.min(F.struct("turn", "seq", "tier", "df")).alias("e")).select(
        "session_id", "e.turn", "e.seq", "phrase", "e.tier", "e.df")
