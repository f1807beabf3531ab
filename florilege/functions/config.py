"""Settings, scoring weights and summary labels."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields
from pathlib import Path

DEFAULT_LABELS = """\
[literature]
description = "Reports what earlier work has found."
color = "#7f8c8d"
[method]
description = "Says how the study was done."
color = "#2980b9"
[goal]
description = "States what the study sets out to learn."
color = "#f39c12"
[result]
description = "Reports what was found."
color = "#27ae60"
[conclusion]
description = "Says what follows from the findings."
color = "#c0392b"
[contribution]
description = "Names what is new here."
color = "#16a085"
[take-away]
description = "Sums up the one message to remember."
color = "#8e44ad"
"""


@dataclass(frozen=True)
class Scoring:
    """Weights of importance and selection."""

    summary_similarity: float = 0.85
    sentence_length: float = 0.15
    importance: float = 0.65
    redundancy: float = 0.35
    section_penalty: float = 0.06

    @classmethod
    def read(cls, path: str) -> Scoring:
        raw = json.loads(Path(path).read_text())
        return cls(raw["initial"]["summarySimilarity"], raw["initial"]["sentenceLength"], raw["selection"]["importance"], raw["selection"]["redundancy"], raw["selection"]["sectionPenalty"])

    @property
    def selection(self) -> dict[str, float]:
        return {"importance": self.importance, "redundancy": self.redundancy, "section": self.section_penalty}


@dataclass(frozen=True)
class Settings:
    compression_ratio: float = 10.0
    summary_source: str = "local"
    summary_labels: bool = False
    local_relevance: bool = False
    map_reduce: bool = False
    map_reduce_sentences: int = 10
    map_reduce_input_tokens: int = 4096
    label_config: str = DEFAULT_LABELS
    endpoint: str = ""
    api_key: str = ""
    summary_model: str = ""
    embedding_model: str = ""

    @classmethod
    def valid(cls, raw: dict) -> bool:
        kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        if set(raw) - set(kinds):
            return False
        s = asdict(cls()) | raw
        typed = all(isinstance(s[k], bool) if t is bool else isinstance(s[k], (int, float)) and not isinstance(s[k], bool) if t in (int, float) else isinstance(s[k], t) for k, t in kinds.items())
        return typed and s["compression_ratio"] >= 1.5 and s["summary_source"] in ("local", "remote") and s["map_reduce_sentences"] >= 2 and s["map_reduce_input_tokens"] >= 256

    @classmethod
    def read(cls, raw: dict | None) -> Settings:
        """Settings from raw values; all defaults if any is invalid."""
        return cls(**raw) if raw and cls.valid(raw) else cls()

    def remote_problems(self) -> list[str]:
        out = [f"{k} is missing" for k in ("api_key", "endpoint", "summary_model") if not getattr(self, k)]
        return out + ["endpoint is no URL"] * bool(self.endpoint and not re.match(r"https?://[^/\s]+", self.endpoint))


def toml_string(raw: str) -> str:
    """A quoted value without its quotes and escapes (quote, backslash, line, tab in turn); a bare one trimmed."""
    s = raw.strip()
    if len(s) < 2 or s[0] != '"' or s[-1] != '"':
        return s
    s = s[1:-1]
    for escape, sign in (('\\"', '"'), ("\\\\", "\\"), ("\\n", "\n"), ("\\t", "\t")):
        s = s.replace(escape, sign)
    return s


def parse_labels(text: str) -> list[dict]:
    """[{name: "[label]", description, color}] of a label file; ValueError says what is wrong. Names may repeat."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("labels: an empty text")
    out: list[dict] = []
    for no, line in enumerate((x.strip() for x in text.splitlines()), 1):
        if not line or line[0] == "#":
            continue
        if m := re.fullmatch(r"\[([A-Za-z][A-Za-z0-9-]*)\]", line):
            out.append({"name": f"[{m[1]}]", "description": "", "color": None})
            continue
        m = re.fullmatch(r"([A-Za-z][A-Za-z-]*)\s*=\s*(.+)", line)
        if not out or not m:
            raise ValueError(f"labels, line {no}: {'unexpected' if out else 'outside any label'}: {line}")
        key, value, label = m[1], toml_string(m[2]), out[-1]
        if key not in ("description", "color") or label[key] or not value or key == "color" and not re.fullmatch("#[0-9A-Fa-f]{6}", value):
            raise ValueError(f"labels, line {no}: {label['name']} has an unknown, empty, invalid or second {key}")
        label[key] = value
    missing = [x["name"] for x in out if not x["description"]]
    if missing or not out:
        raise ValueError(f"labels: no description of {', '.join(missing)}" if missing else "labels: none")
    return out


def labels_file(path: str) -> list[dict]:
    """Labels of a file; one that is missing or invalid is replaced with the defaults."""
    p = Path(path)
    try:
        return parse_labels(p.read_text())
    except (OSError, ValueError):
        p.write_text(DEFAULT_LABELS)
        return parse_labels(DEFAULT_LABELS)
