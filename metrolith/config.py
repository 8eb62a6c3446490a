"""Parameters of training and decoding, validated once."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    """Defaults are the effective ones of the tracker whose results are matched."""

    inference_method: str = "HMM_viterbi"  # or "PF"
    frame_length: float = 0.02
    whole_note_div: int = 64
    pattern_size: str = "bar"  # or "beat"
    min_tempo: float = 60.0
    max_tempo: float = 220.0
    learn_tempo_ranges: bool = True
    tempo_outlier_percentile: float = 5.0
    same_tempo_per_meter: bool = False
    transition_model_type: str = "2015"  # or "2006"
    tempo_lambda: float = 100.0
    pn: float = 0.01
    n_tempi: int | None = None
    max_positions: int = 1600
    p2s: float = 0.0
    pfs: float = 0.0
    use_silence_state: bool = False
    use_meter_prior: bool = False
    correct_beats: bool = False
    frame_shift: float = 0.0
    n_particles: int = 1000
    tempo_std: float = 0.02
    ratio_neff: float = 0.001
    res_int: int = 30
    resampling_scheme: int = 3  # 0 SISR, 1 warped, 2 grouped, 3 grouped and warped
    warp_exponent: float = 0.25
    state_distance: tuple[float, float, float] = (30.0, 1100.0, 100.0)
    merge_threshold: float = 20.0
    split_threshold: float = 30.0
    n_initial_clusters: int = 16
    n_max_clusters: int = 48
    feat_type: tuple[str, ...] = ("lo230_superflux.mvavg", "hi250_superflux.mvavg")
    observation_model: str = "MOG"  # or "RNN"
    cluster_type: str = "meter"  # meter, rhythm, none or kmeans
    dist_cluster: str = "data"  # or "equal"
    n_clusters: int = 1
    pattern_scope: str = "bar"  # or "song": k-means over the means of a file's bars
    validation: str = "holdout"  # cross_validation or leave_one_out
    max_shift: int = 1
    update_interval: int = 200
    obs_lik_floor: float = 1e-7
    seed: int = 1
    save: frozenset[str] = field(default_factory=lambda: frozenset({"beats"}))

    def __post_init__(self):
        for name, allowed in (
            ("inference_method", ("HMM_viterbi", "HMM_forward", "PF")), ("pattern_size", ("bar", "beat")), ("transition_model_type", ("2015", "2006")), ("observation_model", ("MOG", "RNN")),
            ("cluster_type", ("meter", "rhythm", "none", "kmeans")), ("dist_cluster", ("data", "equal")), ("pattern_scope", ("bar", "song")), ("validation", ("holdout", "cross_validation", "leave_one_out")), ("resampling_scheme", (0, 1, 2, 3)),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.max_shift < 0 or self.update_interval < 1 or self.obs_lik_floor < 0:
            raise ValueError("the settings of online decoding must not be negative")
        if not 0 < self.min_tempo <= self.max_tempo or self.frame_length <= 0:
            raise ValueError("tempi and frame length must be positive, and the tempi in order")
