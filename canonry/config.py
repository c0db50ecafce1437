"""Tunable values of matching, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    # Thresholds, half-lives and weights that results depend on.
    max_km: float = 0.35
    half_life_km: float = 0.15
    accept: float = 0.55
    near_miss: float = 0.30
    least_name: float = 0.45
    number_veto_name: float = 0.85
    rescue_name: float = 0.95
    rescue_km: float = 1.5
    rescue_half_life_km: float = 0.75
    weight_geo: float = 0.45
    weight_name: float = 0.45
    weight_stars: float = 0.10
    rescue_weight_name: float = 0.70
    rescue_weight_geo: float = 0.20
    rescue_weight_stars: float = 0.10
    candidates: int = 50
    room_accept: float = 0.55
    hard_geo: float = 0.45
    hard_name_low: float = 0.30
    hard_name_high: float = 0.85
    hard_pairs: int = 200
    batch_pairs: int = 20
    reason_chars: int = 200
    near_misses_shown: int = 10
    # Of a million tokens, in dollars.
    prompt_price: float = 0.0
    completion_price: float = 0.0
    # Cosine of embeddings is stretched from [floor, floor + span] to [0, 1].
    similarity_floor: float = 0.75
    similarity_span: float = 0.25


DEFAULT = MatchConfig()
EARTH_KM = 6371.0
