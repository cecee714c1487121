"""Configuration trees with their defaults.  Missing keys take defaults, unknown keys are ignored, wrong types raise."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

RGB = tuple[int, int, int]


@dataclass(frozen=True)
class Rip:
    frame_skip: int = 1
    pixel_difference: int = 20
    ignore_change_percent: float = 0.5
    diff_threshold: int = 24
    gap_frames: int = 5
    force_merge: bool = False
    better_quality: bool = False


@dataclass(frozen=True)
class Region:
    up: int = 0
    down: int = 0
    left: int = 0
    right: int = 0
    scale: float = 0.0
    sharpen: bool = False


@dataclass(frozen=True)
class ColorSegment:
    hue: int = 0
    hue_diff: int = 10
    rgb: RGB = (255, 255, 255)
    rgb_diff: int = 40
    lum_min: int = 0
    lum_max: int = 255
    sat_min: int = 0
    sat_max: int = 255
    enable_hue: bool = False
    enable_rgb: bool = True
    enable_lum_min: bool = False
    enable_lum_max: bool = False
    enable_sat_min: bool = False
    enable_sat_max: bool = False

    def enabled(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self) if f.name.startswith("enable_"))


def _segments() -> dict[str, ColorSegment]:
    return {"outline": ColorSegment(rgb=(0, 0, 0), rgb_diff=30), "pass1": ColorSegment(), "final": ColorSegment()}


@dataclass(frozen=True)
class Filter:
    method: str = "color_outline"
    subtitle_color: RGB = (255, 255, 255)
    outline_color: RGB = (0, 0, 0)
    pixel_compensate: int = 1
    segments: dict[str, ColorSegment] = field(default_factory=_segments)

    def active_segments(self) -> list[ColorSegment]:
        """Outline and final, or (by any other method) pass1 when only that is enabled, else final."""
        get = lambda name: self.segments.get(name, ColorSegment())
        on = lambda name: name in self.segments and self.segments[name].enabled()
        if self.method == "color_outline":
            return [get("outline"), get("final")]
        return [get("pass1") if on("pass1") and not on("final") else get("final")]

    def active_kinds(self) -> list[str]:
        return sorted({name for name, s in self.segments.items() if s in self.active_segments()})

    def tuned(self, main: RGB, outline: RGB) -> Filter:
        """The filter with detected colours; hues follow them."""
        to = {"pass1": main, "final": main, "outline": outline}
        new = {n: replace(s, rgb=to[n], hue=hue_of(to[n]), enable_rgb=True) if n in to else s for n, s in self.segments.items()}
        return replace(self, subtitle_color=main, outline_color=outline, segments=new)


def hue_of(rgb: RGB) -> int:
    r, g, b = rgb
    top, spread = max(rgb), max(rgb) - min(rgb)
    if not spread:
        return 0
    part, base = (g - b, 0) if r == top else (b - r, 120) if g == top else (r - g, 240)
    hue = int(part * 60 / spread) + base
    return hue + 360 if hue < 0 else hue


@dataclass(frozen=True)
class Postprocess:
    single_dot: bool = True
    single_line: bool = True
    large_block: int = 0
    touch_edge: bool = False
    pass_center: bool = True
    center_tolerance: float = 0.12


@dataclass(frozen=True)
class Style:
    time_shift_10ms: int = 0
    font_name: str = "Arial"
    primary_color: str = "&H00FFFFFF"
    secondary_color: str = "&H000000FF"
    outline_color_ssa: str = "&H00000000"
    shadow_color: str = "&H80000000"
    outline_width: int = 2
    shadow_depth: int = 0
    no_default_style: bool = False


@dataclass(frozen=True)
class Ocr:
    per_image: int = 1
    scale: float = 1.0
    divid_into_2_lines: bool = False
    color_mode: str = "gray"
    antialias: bool = True
    supersample: int = 3
    stroke_dilate: int = 0
    coverage_gamma: float = 0.85
    binary_threshold: float = 0.5
    despeckle_min_area: int = 4
    text_color: str = "#000000"
    bg_color: str = "#FFFFFF"
    format: str = "png"
    quality: int = 95
    scale_filter: str = "lanczos3"
    max_width: int = 0
    padding: int = 0
    crop_top: int = 0
    crop_bottom: int = 0
    crop_left: int = 0
    crop_right: int = 0
    rotate: int = 0
    flip_h: bool = False
    flip_v: bool = False
    brightness: int = 0
    contrast: int = 0
    grayscale: bool = False


@dataclass(frozen=True)
class Output:
    ssa: bool = True
    vobsub: bool = True
    ocr_png: bool = True
    srt: bool = True
    json_timeline: bool = True
    srt_bitmap: bool = False
    ocr: Ocr = field(default_factory=Ocr)

    def kinds(self) -> list[str]:
        """The kinds of artifacts that are written, in this order."""
        return [k for k in ("ssa", "vobsub", "ocr_png", "srt", "json_timeline") if getattr(self, k)]


@dataclass(frozen=True)
class Preview:
    scale_video: float = 1.0
    sharpen_video: bool = False


@dataclass(frozen=True)
class Config:
    start_seconds: float = 0.0
    end_seconds: float = 0.0
    rip: Rip = field(default_factory=Rip)
    region: Region = field(default_factory=Region)
    filter: Filter = field(default_factory=Filter)
    postprocess: Postprocess = field(default_factory=Postprocess)
    style: Style = field(default_factory=Style)
    output: Output = field(default_factory=Output)
    preview: Preview = field(default_factory=Preview)

    def roi_scale(self) -> float:
        """The scaling that is applied; no scaling counts as 1."""
        s = self.region.scale * max(self.preview.scale_video, 0.05)
        return s if s > 1e-6 else 1.0

    def frame_range(self, fps: float, total: int) -> tuple[int, int]:
        """[first, end) frames of the configured seconds; an end of 0 is the video's."""
        nearest = lambda v: int(v + 0.5)
        start = nearest(self.start_seconds * fps)
        end = nearest(self.end_seconds * fps) if self.end_seconds > 0 else total
        return start, min(max(end, start + 1), max(total, 1))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Config:
        return _build(Config, json.loads(text))


_NESTED = {"rip": Rip, "region": Region, "filter": Filter, "postprocess": Postprocess, "style": Style, "output": Output, "preview": Preview, "ocr": Ocr}


def _build(kind, data):
    if not isinstance(data, dict):
        raise TypeError(f"{kind.__name__} must be an object")
    values, base = {}, kind()
    for f in fields(kind):
        if f.name not in data:
            continue
        value, default = data[f.name], getattr(base, f.name)
        if is_dataclass(default):
            value = _build(_NESTED[f.name], value)
        elif f.name == "segments":
            value = {name: _build(ColorSegment, s) for name, s in value.items()}
        elif isinstance(default, tuple):
            value = tuple(int(v) for v in value)
            if len(value) != 3:
                raise TypeError(f"{f.name} must have three channels")
        elif isinstance(default, bool) != isinstance(value, bool) or isinstance(default, (int, float)) != isinstance(value, (int, float)):
            raise TypeError(f"{f.name} has the wrong type")
        values[f.name] = value
    return kind(**values)
