"""Tunable parameters of every operator, with the values results are compared under."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # disclosed values
    value_chars: int = 180
    hard_values: int = 2
    soft_values: int = 2
    # phrase document frequency and mining
    df_cap: int = 2715
    mine_max: int = 12
    mine_min: int = 4
    resolve_tokens: int = 22
    proposal_tokens: int = 8
    attribute_tokens: int = 3
    category_min_tokens: int = 2
    head_tokens: int = 4
    # token-keep decoding
    keep_threshold: float = 0.30
    keep_words: int = 96
    keep_min_in: int = 3
    keep_min_out: int = 2
    keep_min_share: float = 0.15
    # transcript rescue
    rescue_turn: int = 5
    rescue_stale: int = 2
    # retrieval
    pool: int = 1200
    strong_df: int = 400
    strong_phrases: int = 13
    or_phrases: int = 8
    bag_words: int = 40
    k1: float = 1.2
    b: float = 0.75
    idf_floor: float = 1e-6
    # ranking
    w_con: float = 1.00
    w_cat: float = 0.4541399437579685
    w_mined: float = 0.47960403849856215
    w_sem: float = 0.15
    mined_length: float = 7.067577463426672
    df_power: float = 0.08825136552256256
    w_pop: float = 0.5114555220952501
    w_title: float = 0.0
    w_profile: float = 0.0
    pop_low: float = 2.70
    pop_high: float = 3.10
    pop_warmup: int = 40
    pop_turn: int = 3
    pop_head: int = 100
    score_digits: int = 6
    # session
    top_k: int = 10
    max_turns: int = 10
    miss_turn: int = 11
    # scale
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64_000_000
    part_places: int = 1_000_000
    impact_steps: int = 4
    impact_levels: int = 40


DEFAULTS = Settings()
