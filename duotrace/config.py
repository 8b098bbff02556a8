"""Parameters of a search, in one place."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Seconds in a year.
YEAR_S = 3.1557e7


@dataclass(frozen=True)
class SearchConfig:
    """Defaults are those of a whole search; the registered queries use FIXTURE and, those named _full, FULL."""

    stride_s: float = 1.0
    #: Foreground cut on the network statistic (strict), and the gap in windows that separates clusters.
    net_cut: float = 4.0
    cluster_gap: int = 4
    #: Floor of the likelihood ratio for background rows (strict), and of the network statistic for families (inclusive).
    lr_floor: float = 4.5
    net_floor: float = 4.0
    #: No coherence lies above this; the tripwire refuses a table that has one.
    coh_ceiling: float = 0.85
    #: Windows on either side of a known event that are left out.
    excision_windows: int = 2
    #: Offsets: their step, the least for pairs of one segment with itself, and the most kept for a pair of segments.
    offset_step: int = 4
    min_self_offset: int = 3600
    max_offsets: int = 400
    #: Noise rows kept of each fold.
    noise_cap: int = 15_000
    #: Width in seconds of a family of second-stream windows.
    family_s: float = 4.0
    #: A score below it marks a glitch in the foreground; background rows are kept strictly above it.
    glitch_cut: float = 0.5
    #: Detections: false alarms a year below this.
    far_threshold: float = 1.0
    candidates: int = 120
    #: The floor of the likelihood ratio falls to the quietest known event, unless this holds.
    blind_floor: bool = False
    #: The detection statistic: false alarms by each arm's rank (else by the absolute glitch cut).
    per_arm: bool = True
    #: Standard deviations of a Gumbel tail that the coherence ceiling keeps above the noise.
    ceiling_sigmas: float = 6.0
    #: The likelihood ratio's seven means, scales, and intercept with seven slopes.
    lr_mean: tuple[float, ...] = (0.0, 0.0, 0.3, 50.0, 50.0, 0.0, 0.0)
    lr_scale: tuple[float, ...] = (1.0, 1.0, 0.17, 29.0, 29.0, 2.0, 2.0)
    lr_beta: tuple[float, ...] = (-3.0, 1.2, 1.2, 0.8, -0.1, -0.1, 0.3, 0.3)
    #: Models of a search that fits its own: (means, scales, intercept and slopes) for the rows of either fold; None for the fixed values.
    fold_models: tuple | None = None
    #: Known events: name, segment, time.
    known_events: tuple[tuple[str, int, float], ...] = (("EV0", 0, 100.3), ("EV3", 3, 3000250.7))


#: The stand-ins' search: short segments, many triggers, few offsets.
FIXTURE = SearchConfig(net_cut=2.0, offset_step=16, min_self_offset=64, max_offsets=10, noise_cap=500, far_threshold=500_000.0)
#: The same with the caps of a whole search.
FULL = replace(FIXTURE, max_offsets=400, noise_cap=15_000)
