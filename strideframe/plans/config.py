"""Settings of the clip pipeline: nested, typed, and strict about unknown names."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

from strideframe.schema import ConfigError

# Names of the settings and their defaults are an interface that users' files follow.


@dataclass
class Video:
    device_preset: str = "generic"
    profile: str | None = None
    apply_rotation: bool = True
    start_s: float | None = None
    end_s: float | None = None
    decoder: str = "auto"


@dataclass
class Pose:
    backend: str = "mediapipe"
    min_joint_confidence: float = 0.3
    min_person_confidence: float = 0.4
    backend_options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Tracking:
    enabled: bool = True
    method: str = "iou"
    iou_threshold: float = 0.3
    max_age: int = 30
    min_hits: int = 3
    duplicate_iou: float = 0.6


@dataclass
class Calibration:
    enabled: bool = False
    method: str = "manual"
    image_points: list[list[float]] = field(default_factory=list)
    pitch_points: list[list[float]] = field(default_factory=list)
    assumed_player_height_m: float = 1.80


@dataclass
class Goalkeeper:
    enabled: bool = False
    identification: str = "auto"
    track_id: int | None = None
    goal_posts: list[list[float]] | None = None
    goal_width_m: float = 7.32
    goal_height_m: float = 2.44
    dive_speed_threshold: float = 1.2
    min_dive_frames: int = 4
    dive_lean_threshold_deg: float = 25.0


@dataclass
class Analysis:
    filter_cutoff_hz: float | None = 6.0
    filter_order: int = 4
    kinematics: bool = True
    events: bool = True
    #: Of this engine: the low-pass goes by the clock, over gaps and strides, instead of by rows.
    even_time: bool = False


@dataclass
class Output:
    directory: str = "outputs"
    formats: list[str] = field(default_factory=lambda: ["json"])
    overlay_video: bool = False
    report: bool = True


@dataclass
class Config:
    """All sections. Settings that the engine could only ignore are refused unless they ask for what it does anyway."""

    name: str = "default"
    video: Video = field(default_factory=Video)
    pose: Pose = field(default_factory=Pose)
    tracking: Tracking = field(default_factory=Tracking)
    calibration: Calibration = field(default_factory=Calibration)
    analysis: Analysis = field(default_factory=Analysis)
    goalkeeper: Goalkeeper = field(default_factory=Goalkeeper)
    output: Output = field(default_factory=Output)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Config:
        return _filled(cls(), values, "").checked()

    def checked(self) -> Config:
        """Itself, or ConfigError."""
        for path, allowed in ONLY.items():
            section, name = path.split(".")
            value = getattr(getattr(self, section), name)
            if value not in allowed:
                raise ConfigError(f"{path} must be {' or '.join(map(repr, allowed))}, not {value!r}")
        if self.goalkeeper.goal_width_m <= 0 or self.goalkeeper.goal_height_m <= 0:
            raise ConfigError("a goal has a width and a height")
        if self.goalkeeper.identification == "manual" and self.goalkeeper.track_id is None:
            raise ConfigError("goalkeeper.identification 'manual' needs goalkeeper.track_id")
        return self

    def to_yaml(self) -> str:
        return _yaml().safe_dump(self.to_dict(), sort_keys=False)

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        return cls.from_dict(_yaml().safe_load(text) or {})

    @classmethod
    def load(cls, path: str) -> Config:
        """A settings file: YAML, or JSON by its name."""
        with open(path) as f:
            return cls.from_dict(json.load(f)) if path.endswith(".json") else cls.from_yaml(f.read())


#: What these settings may say: detections come as tables, so what decoding, inference or drawing would do is as it is.
ONLY = {
    "video.apply_rotation": (True,),
    "video.decoder": ("auto",),
    "pose.backend": ("mediapipe",),
    "pose.backend_options": ({},),
    "pose.min_joint_confidence": (0.3,),
    "calibration.assumed_player_height_m": (1.80,),
    "tracking.method": ("iou",),
    "calibration.method": ("manual",),
    "analysis.filter_order": (4,),
    "analysis.kinematics": (True,),
    "output.overlay_video": (False,),
    "goalkeeper.identification": ("auto", "manual", "geometry", "colour"),
}


def _yaml() -> Any:
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML settings need PyYAML; JSON works without") from e
    return yaml


def _filled(section: Any, values: Any, path: str) -> Any:
    if not isinstance(values, dict):
        raise ConfigError(f"{path or 'the settings'} must be a mapping")
    known = {f.name for f in fields(section)}
    if unknown := sorted(set(values) - known):
        raise ConfigError(f"unknown settings: {', '.join(f'{path}{u}' for u in unknown)}; known: {', '.join(sorted(known))}")
    for name, value in values.items():
        inner = getattr(section, name)
        setattr(section, name, _filled(inner, value, f"{path}{name}.") if is_dataclass(inner) else value)
    return section
