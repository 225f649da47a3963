"""Profiles and environment files: TOML over defaults, strict about keys; dotenv with the environment first."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Ingest:
    # Fixed values. Defaults of the profile, here and below.
    target_dpi: int = 400
    native_image_coverage: float = 0.55
    low_dpi_warning: float = 150.0
    blank_page_ink_ratio: float = 0.002
    ink_level: int = 200


@dataclass(frozen=True)
class Segment:
    block_size: int = 31
    c: int = 10
    min_gap_px: int = 3
    min_height_px: int = 5
    threshold_scale: float = 0.30
    smooth_window: int = 3
    tall_factor: float = 1.6
    gap_factor: float = 1.5
    stranded_ink_frac: float = 0.08
    max_pitch_cv: float = 0.35
    min_rows_for_assessment: int = 4
    min_rows: int = 2
    align_overlap_px: float = 4.0
    min_gutter_ratio: float = 3.0
    min_gutter_frac_of_height: float = 0.4
    edge_margin_px: int = 5
    margin_note_ratio: float = 0.35


@dataclass(frozen=True)
class Order:
    band_overlap_frac: float = 0.5
    column_read_order: str = "column_major"
    min_column_purity: float = 0.8
    min_lines_for_purity: int = 3


@dataclass(frozen=True)
class Route:
    w_urdu: float = 1.0
    w_tashkeel: float = 1.0
    w_ornament: float = 1.0
    tashkeel_arabic: float = 0.25
    urdu_cut: float = 0.2
    arabic_cut: float = -0.2


@dataclass(frozen=True)
class Extract:
    min_script_purity: float = 0.55
    max_repeat_rate: float = 0.25
    repeat_ngram: int = 12
    min_line_coverage: float = 0.95
    max_empty_line_frac: float = 0.10
    max_capacity_overrun: float = 2.5


@dataclass(frozen=True)
class Profile:
    ingest: Ingest = field(default_factory=Ingest)
    segment: Segment = field(default_factory=Segment)
    order: Order = field(default_factory=Order)
    route: Route = field(default_factory=Route)
    extract: Extract = field(default_factory=Extract)


def overridden(base, given: dict, where: str = ""):
    """``base`` with the given values; an unknown key or a value of another kind is an error."""
    known = {f.name for f in fields(base)}
    changes = {}
    for key, value in given.items():
        if key not in known:
            raise KeyError(f"unknown setting {where}{key}")
        now = getattr(base, key)
        if is_dataclass(now):
            changes[key] = overridden(now, value, f"{where}{key}.")
        elif isinstance(now, float) and isinstance(value, int | float) and not isinstance(value, bool):
            changes[key] = float(value)
        elif type(value) is type(now):
            changes[key] = value
        else:
            raise TypeError(f"{where}{key} has to be {type(now).__name__}")
    return replace(base, **changes)


def load_profile(name: str | None, folder: str | Path = "config") -> Profile:
    """Defaults, or a TOML file over them; a bare name is looked up in ``folder``."""
    if name is None:
        return Profile()
    path = Path(name) if "/" in name or name.endswith(".toml") else Path(folder, f"{name}.toml")
    return overridden(Profile(), tomllib.loads(path.read_text(encoding="utf-8")))


def to_toml(profile: Profile) -> str:
    """Text that ``load_profile`` reads back to an equal profile."""
    out = []
    for section, values in asdict(profile).items():
        out.append(f"[{section}]")
        out += [f'{k} = "{v}"' if isinstance(v, str) else f"{k} = {str(v).lower() if isinstance(v, bool) else v}" for k, v in values.items()]
        out.append("")
    return "\n".join(out)


_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")


def parse_dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; ``export``, quotes and `` #`` comments as shells have them."""
    out = {}
    for line in text.splitlines():
        m = None if line.lstrip().startswith("#") else _LINE.match(line)
        if not m:
            continue
        value = m[2]
        quoted = re.match(r"""("([^"]*)"|'([^']*)')\s*(?:#.*)?$""", value)
        out[m[1]] = (quoted[2] if quoted[2] is not None else quoted[3]) if quoted else re.split(r"\s#|^#", value)[0].strip()
    return out


def load_dotenv(start: str | Path = ".", override: bool = False, levels: int = 4) -> dict[str, str]:
    """Values of the nearest ``.env`` up to ``levels`` folders above; what is set already wins unless ``override``."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][: levels + 1]:
        if (path := folder / ".env").is_file():
            got = parse_dotenv(path.read_text(encoding="utf-8"))
            for k, v in got.items():
                if override or k not in os.environ:
                    os.environ[k] = v
            return got
    return {}
