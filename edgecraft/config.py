"""Frozen configuration passed to operators.

``min_shared_tags`` is ours: a problem that shares that many tags (or all of its
own, if it has fewer) with one the user attempted is a candidate (H7).

Fixed values: these must equal the reference behaviour for identical results.
    user id salt ............ "lrs_v1"
    edge band ............... 0.35 .. 0.65
    blind-spot threshold .... 0.15
    confidence minimum ...... 0.75
    tier size ............... 5
    ensemble weights ........ ALS 0.7, content 0.3
    graph boost alpha ....... 0.05
    peer rating band ........ 0.1 (rank-percentile units, i.e. 300 rating points)
    peer group window ....... 100.0 rating points
    finish-time cap quantile  0.90
    median fallbacks ........ time 30.0, penalty 1.0
    difficulty clip ......... 0.1 .. 3.0, missing finish time -> 2.0
    difficulty buckets ...... < 0.8 easy, < 1.5 medium, else hard
    variance gate ........... population std >= 0.015 and > 2 distinct values at 3 decimals
    spread ranges ........... calibrate fallback 0.25 .. 0.85, ensemble guard 0.3 .. 0.8
    max picks per tag ....... 2
    ALS ..................... rank 64, reg 0.1, 15 iterations, seed 42 (backtest 32 / 10)
    roadmap p_solve base .... Easy 0.72, Medium 0.52, Hard 0.38, other 0.5; bonus 0.08; cap 0.85
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    user_salt: str = "lrs_v1"

    edge_p_low: float = 0.35
    edge_p_high: float = 0.65
    blind_spot_threshold: float = 0.15
    confidence_p_min: float = 0.75
    tier_size: int = 5
    confidence_speed_factor: float = 1.2

    w_als: float = 0.7
    w_content: float = 0.3
    graph_alpha: float = 0.05

    peer_band: float = 0.1
    peer_window_points: float = 100.0
    default_peer_rate: float = 0.5

    min_shared_tags: int = 2
    max_per_tag: int = 2

    finish_cap_quantile: float = 0.90
    default_median_time: float = 30.0
    default_median_penalty: float = 1.0
    missing_finish_proxy: float = 2.0
    proxy_min: float = 0.1
    proxy_max: float = 3.0

    min_std: float = 0.015
    fallback_low: float = 0.25
    fallback_high: float = 0.85
    ensemble_spread_low: float = 0.3
    ensemble_spread_high: float = 0.8

    als_rank: int = 64
    als_reg: float = 0.1
    als_iters: int = 15
    als_alpha: float = 1.0
    seed: int = 42

    struggle_min_penalty: int = 1
    rating_scale: float = 3000.0


DEFAULT = Config()
