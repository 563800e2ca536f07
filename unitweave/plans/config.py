"""All thresholds and switches of the pipeline, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # attribution
    org_match_score: float = 75.0
    right_org_distance: int = 64
    right_org_window: int = 3
    # canonical names
    min_frequency: int = 1
    institution_ids: tuple[int, ...] = ()
    limit_institutions: int | None = None
    min_suffix_frequency: int = 3
    max_prefixed_ratio: float = 0.25
    max_full_frequency: int = 5
    min_suffix_variant_frequency: int = 500
    min_prefix_variants: int = 2
    min_core_group_frequency: int = 200
    prefix_words: int = 3
    variant_prefix_words: int = 4
    distance_threshold: float = 0.15
    borderline_margin: float = 0.05
    linkage: str = "average"
    # hierarchy
    top_coverage: float = 0.95
    min_pair_count: int = 2
    min_association: float = 0.01
    score_floor: float = 0.0
    score_quantile: float = 0.5
    parents_per_child: int = 3
    weight_coverage: float = 0.4
    weight_frequency: float = 0.2
    weight_degree: float = 0.1
    weight_position: float = 0.3
    position_average: float = 0.5
    position_consistency: float = 0.5
    lexical_cap: float = 0.25
    rank_gap_penalty: float = 0.15
    # tagging
    max_rows: int | None = None
    keep_language: str = "ENGLISH"
    max_tokens: int = 128

    def __post_init__(self):
        if not 0 < self.top_coverage <= 1:
            raise ValueError("top_coverage lies above 0 and not above 1")
        if self.linkage not in ("average", "complete"):
            raise ValueError("linkage is average or complete")
