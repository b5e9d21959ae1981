"""Parameters of the engine and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


# The parameters' defaults.
@dataclass(frozen=True)
class Config:
    max_nodes: int = 200
    semantic_edge_threshold: float = 0.75
    max_path_depth: int = 5
    beam_width: int = 10
    top_k_paths: int = 5
    top_k_anchors: int = 3
    sem_alpha: float = 0.4
    sem_decay_rate: float = 0.5
    sem_radius: int = 2
    sem_anchor_threshold: float = 0.25
    sem_anchors: int = 4  # five minus the speculation itself, which a search right after its insertion would find first
    spec_initial_activation: float = 0.3
    spec_confirmed_activation: float = 0.7
    stability_threshold: float = 0.80
    stability_sample_queries: int = 5
    observation_merge_threshold: float = 0.88
    structural_match_threshold: float = 0.75
    min_confirmations: int = 5
    stabilisation_threshold: float = 0.40
    reactivation_low: float = 0.45
    reactivation_high: float = 0.75
    refinement_alpha: float = 0.05
    max_observation_sessions: int = 20
    entity_specificity_threshold: float = 0.60
    activation_boost: float = 0.15
    target_chars: int = 3000
    min_chars: int = 50
    max_chars: int = 6000
    debounce_seconds: int = 10


# The default weight of each edge type.
EDGE_TYPE_WEIGHTS = {
    "causal": 0.85,
    "constitutive": 0.80,
    "evidential": 0.80,
    "sequential": 0.70,
    "contrastive": 0.65,
    "analogical": 0.60,
    "semantic": 0.55,
    "speculative": 0.40,
}
