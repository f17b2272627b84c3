"""Settings of a detection run, with the defaults of the public command line."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class DetectConfig:
    # fixed values: defaults that results depend on
    patch_radius: float = 1.78
    min_galactic_b: float = 20.0
    sr_width: float = 0.5
    sr_step: float = 0.25
    roi_width: float = 0.5
    pm_min: float = -30.0
    pm_max: float = 30.0
    min_stars_patch: int = 50
    min_stars_sr: int = 10
    max_stars_sr: int = 100_000
    min_stars_roi: int = 5
    max_roi_stars: int = 500
    max_rois_per_patch: int = 1000
    roi_sigma_cut: float = 4.0
    significance_cut: float = 8.0
    n_theta: int = 90
    n_rho: int = 100
    edge_rho: float = 1.5
    pm_compat: float = 5.0
    duplicate_overlap: float = 0.4
    merge_overlap: float = 0.2
    theta_merge: float = 10.0 * (3.14159265 / 180.0)
    rho_merge: float = 0.5
    min_candidate_stars: int = 10
    max_candidate_stars: int = 2000
    max_rv_dispersion: float = 20.0
    knn_k: int = 15
    min_sky_bandwidth: float = 2.0
    #: optional caps on the distinct stars of a cluster and of a candidate, and protostreams of a candidate; None keeps all
    cluster_star_cap: int | None = None
    candidate_star_cap: int | None = None
    protostream_cap: int | None = None
    #: average lines after turning them to the side of the strongest one
    wrap_safe: bool = False
    use_distance: bool = False
    use_rv: bool = False
    ra_min: float = 0.0
    ra_max: float = 360.0
    dec_min: float = -90.0
    dec_max: float = 90.0
    dist_min: float = 0.0
    dist_max: float = 1000.0

    @property
    def n_windows(self) -> int:
        """Windows that begin below pm_max - sr_width."""
        return math.ceil((self.pm_max - self.sr_width - self.pm_min) / self.sr_step - 1e-9)

    @property
    def rho_max(self) -> float:
        return 1.5 * self.patch_radius
