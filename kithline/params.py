"""Every tunable of the analysis as one immutable value, passed to each transform."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

INTERACTING, AVAILABLE, ALONE = 1, 2, 3
STATE_NAMES = {INTERACTING: "Interacting", AVAILABLE: "Available", ALONE: "Alone"}


@dataclass(frozen=True)
class Params:
    fps: int = 30
    step: int = 10  # every step-th frame is analysed
    turn_gap_sec: float = 8.0  # between different speakers
    same_gap_sec: float = 1.5  # between turns of one speaker
    presence_sec: float = 1.0
    short_memory_sec: float = 2.0
    long_memory_sec: float = 0.0  # 0: no long memory
    sustained_sec: float = 1.0
    kcds_share: float = 0.8
    ohs_share: float = 0.03
    instant_confidence: float = 0.4
    proximity: float = 0.8
    gate: float = 0.18
    anchor_proximity: float = 0.5
    anchor_face: float = 0.6
    rules: tuple[int, ...] = (1, 2, 3)
    least_interacting_sec: float = 2.0
    least_available_sec: float = 12.0
    least_alone_sec: float = 30.0
    gap_stretch_sec: float = 0.1
    # Change-point smoothing. No published values exist for these four; they are this library's own.
    cpd_penalty: float = 1.0
    cpd_interacting: float = 0.5
    cpd_interacting_low: float = 0.2
    cpd_presence: float = 0.3
    margin_sec: int = 30  # left out of the evaluation at both ends of a video

    @property
    def per_second(self) -> float:
        return self.fps / self.step

    def window(self, seconds: float) -> int:
        return int(seconds * self.per_second)

    def least_frames(self, state_name: str) -> float:
        """Shortest segment of a state, in frames; unknown states as Alone."""
        sec = {"Interacting": self.least_interacting_sec, "Available": self.least_available_sec}.get(state_name, self.least_alone_sec)
        return sec * self.fps

    def but(self, **changes) -> Params:
        """These parameters with some changed; names that don't exist are refused."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"no such parameters: {sorted(unknown)}")
        return replace(self, **changes)
