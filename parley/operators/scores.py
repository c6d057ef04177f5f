"""Decoding and verification of model outputs that are held in tables.

The scores themselves come from any scorer the user runs with `mapInPandas`; only rows that a cheap
lexical test did not settle should be sent to it, so filter first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley import fixed
from parley.functions import text as tx
from parley.operators import phrases as ph
from parley.plans import scale
from parley.settings import DEFAULTS, Settings


def decode_act(scores: DataFrame) -> DataFrame:
    """(message_id, turn, label, score) -> best allowed act; turn 1 allows openings only, later turns the rest."""
    opening = F.col("label").isin(*fixed.OPENING_ACTS)
    rank = F.array_position(F.array(*[F.lit(a) for a in fixed.ACTS]), F.col("label"))
    return (scores.filter(F.col("label").isin(*fixed.ACTS))
            .filter(F.when(F.col("turn") == 1, opening).otherwise(~opening))
            .groupBy("message_id", "turn")
            .agg(F.max_by("label", F.struct(F.col("score"), -rank)).alias("act")))


def decode_keep(messages: DataFrame, probabilities: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Words kept by a token tagger, as text; null when the result would be degenerate.

    `messages` holds (message_id, user_message); `probabilities` (message_id, word, piece, p) with
    0-based word numbers and sub-word pieces. Only the first piece of a word decides.
    """
    cut = F.slice(tx.tokens(F.col("user_message")), 1, cfg.keep_words)
    first = (probabilities.filter(F.col("word") < cfg.keep_words)
             .groupBy("message_id", "word").agg(F.min_by("p", "piece").alias("p"))
             .filter(F.col("p") >= cfg.keep_threshold)
             .groupBy("message_id").agg(F.sort_array(F.collect_list("word")).alias("at")))
    rows = messages.select("message_id", cut.alias("toks")).join(first, "message_id", "left")
    at = F.filter(F.coalesce("at", F.expr("cast(array() as array<int>)")), lambda i: i < F.size("toks"))
    rows = rows.withColumn("kept", F.transform(at, lambda i: F.try_element_at("toks", i + 1)))
    n_in, n_out = F.size("toks"), F.size("kept")
    ok = (n_in >= cfg.keep_min_in) & (n_out >= cfg.keep_min_out) & (n_out >= cfg.keep_min_share * n_in)
    return rows.select("message_id", n_in.alias("n_words"), n_out.alias("n_kept"),
                       F.when(ok, F.array_join("kept", " ")).alias("kept_text"))


def verify_proposals(answers: DataFrame, freq: DataFrame) -> DataFrame:
    """(source_phrase, raw) -> proposal and outcome: failed, abstained, unattested or accepted.

    `freq` holds the proposals' tokens as phrases (`proposal_phrase`).
    """
    rows = answers.withColumn("proposal", tx.normalise_proposal(F.col("raw"), ".")).withColumn("_toks", ph.proposal_phrase())
    known = freq.filter("df > 0").select(F.col("phrase").alias("_toks"), F.lit(True).alias("known"))
    blank = F.col("raw").isNull() | (F.btrim(tx.collapse(F.col("raw"))) == "")
    outcome = (F.when(blank, "failed").when(F.col("proposal") == "none", "abstained")
               .when(F.col("known"), "accepted").otherwise("unattested"))
    return rows.join(known, "_toks", "left").select("source_phrase", "proposal", outcome.alias("outcome"))


def outcome_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("outcome").agg(F.count("*").alias("n"))


def parse_recovered(answers: DataFrame) -> DataFrame:
    """(session_id, raw) -> (session_id, i, phrase): values of the first JSON object in the answer.

    Order: requirements, material, color, category. Anything that is not a string is dropped.
    """
    block = F.nullif(F.regexp_extract("raw", r"(?s)\{.*\}", 0), F.lit(""))
    v = F.try_parse_json(block)
    rows = answers.select("session_id", v.alias("v")).filter(
        F.try_variant_get("v", "$", "map<string,variant>").isNotNull())

    def text(x):
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))

    single = [text(F.try_variant_get("v", f"$.{name}", "variant"))
              for name in ("material", "color", "category")]
    listed = F.coalesce(F.transform(F.try_variant_get("v", "$.requirements", "array<variant>"), text),
                        F.expr("cast(array() as array<string>)"))
    values = F.concat(listed, F.array(*single))
    normal = F.transform(values, lambda x: tx.normalise_proposal(x, ".,;:"))
    kept = F.filter(normal, lambda x: x.isNotNull() & (x != ""))
    return rows.select("session_id", F.posexplode(kept).alias("i", "phrase"))


def rescue_eligible(states: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """(session_id, turn, lost, stale) -> the one turn per session at which a rescue may run."""
    return (states.filter((F.col("turn") >= cfg.rescue_turn) & (F.col("lost") > 0)
                          & (F.col("stale") >= cfg.rescue_stale))
            .groupBy("session_id").agg(F.min("turn").alias("rescue_turn")))


def transcripts(messages: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One text per session, a line per turn; every message is in it, a null one as an empty line."""
    line = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(", shopper: "), F.coalesce("user_message", F.lit("")))
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def request_cache(requests: DataFrame) -> DataFrame:
    """(request_order, body, ok) -> per distinct body: requests, calls made, hits, first success.

    A request is a hit when an earlier one with the same body succeeded; failures are never kept.
    """
    keyed = scale.by_range(requests.select(F.sha2("body", 256).alias("request_key"), "request_order", "ok"), ["request_order"])
    # a body's requests are summed up by ranges of the order: how many, the first success, how many up to it
    own = Window.partitionBy("request_key", "_range")
    success = F.min(F.when(F.col("ok"), F.col("request_order"))).over(own)
    ranges = (keyed.withColumn("first", success).groupBy("request_key", "_range", "first").agg(
        F.count("*").alias("n"), F.count_if(F.col("request_order") <= F.col("first")).alias("upto")))
    # one row a range and body: whole ranges before the first success count, then what is up to it
    body = Window.partitionBy("request_key")
    found = ranges.withColumn("found", F.min(F.when(F.col("first").isNotNull(), F.col("_range"))).over(body))
    calls = (F.when(F.col("found").isNull() | (F.col("_range") < F.col("found")), F.col("n"))
             .when(F.col("_range") == F.col("found"), F.col("upto")).otherwise(0))
    whole = found.groupBy("request_key").agg(F.sum("n").alias("n_requests"), F.sum(calls).alias("n_calls"), F.min("first").alias("first_success"))
    return whole.select(
        "request_key", "n_requests", "n_calls", (F.col("n_requests") - F.col("n_calls")).alias("n_hits"),
        "first_success")
