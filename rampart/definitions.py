"""Source definitions: what a log source looks like and how its fields map to OCSF.

A definition is plain driver-side configuration. It can be written in Python (see
``catalog.py``) or loaded from a YAML mapping with the keys ``name, version, vendor,
product, product_version, detect, parse, normalize, validate, enabled, priority``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

FIELD_TYPES = ("str", "int", "float", "bool", "ip", "timestamp")
DETECT_KEYS = ("contains", "regex", "starts_with", "all", "any", "field_equals", "field_count")


@dataclass(frozen=True)
class Field:
    """One target path fed by one or more parsed fields.

    Several sources are a coalesce, or one text when ``join`` is set. ``values``
    translates source text to target values; ``default`` is used as it stands.
    """

    path: str
    sources: tuple[str, ...]
    type: str = "str"
    values: dict[str, Any] | None = None
    default: Any = None
    format: str | None = None
    tz: str | None = None
    join: str | None = None
    required: bool = False

    def __post_init__(self):
        if not self.sources or any(not s.strip() for s in self.sources):
            raise ValueError(f"{self.path}: 'from' must name at least one field")
        if self.type not in FIELD_TYPES:
            raise ValueError(f"{self.path}: unknown type {self.type!r}")
        if self.type != "timestamp" and (self.format or self.tz):
            raise ValueError(f"{self.path}: 'format' and 'tz' need type timestamp")

    @property
    def result_type(self) -> str:
        if self.values is None:
            return self.type
        known = [v for v in [*self.values.values(), self.default] if v is not None]
        if known and all(isinstance(v, bool) for v in known):
            return "bool"
        return "int" if known and all(isinstance(v, int) and not isinstance(v, bool) for v in known) else "str"


@dataclass(frozen=True)
class Activity:
    """``activity_id`` read from a field through a lookup."""

    source: str
    values: dict[str, int]
    default: int | None = None


@dataclass(frozen=True)
class Definition:
    name: str
    version: str
    vendor: str
    product: str
    product_version: str
    detect: dict
    engine: str
    class_uid: int
    category_uid: int
    activity: int | Activity
    fields: tuple[Field, ...] = ()
    constants: dict[str, Any] = field(default_factory=dict)
    unmapped: str | tuple[str, ...] = "drop"
    envelope: str = "none"
    options: dict = field(default_factory=dict)
    required: tuple[str, ...] = ()
    on_failure: str = "dead_letter"
    enabled: bool = True
    priority: int = 100

    def __post_init__(self):
        if not re.match(r"^[a-z0-9][a-z0-9_-]*$", self.name):
            raise ValueError("source name must be a lowercase slug of [a-z0-9_-]")
        check_detect(self.detect)
        if self.engine in ("grok", "dissect") and not str(self.options.get("pattern") or "").strip():
            raise ValueError(f"engine {self.engine!r} requires a non-empty options.pattern")
        if self.envelope not in ("none", "syslog") or self.on_failure not in ("dead_letter", "warn"):
            raise ValueError(f"{self.name}: bad envelope or on_failure")


def check_detect(rule: dict) -> None:
    """Exactly one known alternative per rule, children likewise."""
    if not isinstance(rule, dict) or len(rule) != 1 or next(iter(rule)) not in DETECT_KEYS:
        raise ValueError(f"a detect rule must set exactly one of {'/'.join(DETECT_KEYS)}; got {rule!r}")
    (key, value), = rule.items()
    if key in ("all", "any"):
        if not value:
            raise ValueError(f"{key!r} must contain at least one rule")
        for child in value:
            check_detect(child)
    if key == "field_count" and not {"equals", "min", "max"} & set(value):
        raise ValueError("field_count needs one of 'equals' / 'min' / 'max'")


def _take(block: dict, where: str, *names: str) -> dict:
    unknown = set(block) - set(names)
    if unknown:
        raise ValueError(f"unknown keys in {where}: {sorted(unknown)}")
    return block


def from_mapping(doc: dict) -> Definition:
    """A definition from a parsed YAML document; unknown keys are refused."""
    _take(doc, "definition", "name", "version", "vendor", "product", "product_version", "detect", "parse",
          "normalize", "validate", "enabled", "priority")
    parse = _take(doc["parse"], "parse", "envelope", "engine", "options")
    norm = _take(doc["normalize"], "normalize", "class_uid", "category_uid", "activity_id", "fields", "constants", "unmapped")
    check = _take(doc.get("validate") or {}, "validate", "required", "on_failure")
    activity = norm["activity_id"]
    if isinstance(activity, dict):
        _take(activity, "activity_id", "from", "map", "default")
        activity = Activity(activity["from"], {str(k): v for k, v in activity["map"].items()}, activity.get("default"))
    fields = []
    for path, spec in (norm.get("fields") or {}).items():
        _take(spec, path, "from", "type", "map", "default", "format", "tz", "join", "required")
        many = isinstance(spec["from"], list)
        if spec.get("join") is not None and not many:
            raise ValueError(f"{path}: 'join' only applies when 'from' is a list")
        values = {str(k): v for k, v in spec["map"].items()} if spec.get("map") is not None else None
        fields.append(Field(path, tuple(spec["from"]) if many else (spec["from"],), spec.get("type", "str"), values,
                            spec.get("default"), spec.get("format"), spec.get("tz"), spec.get("join"), bool(spec.get("required"))))
    unmapped = norm.get("unmapped", "drop")
    return Definition(
        name=doc["name"], version=str(doc["version"]), vendor=doc["vendor"], product=doc["product"],
        product_version=str(doc["product_version"]), detect=doc["detect"], engine=parse["engine"],
        class_uid=norm["class_uid"], category_uid=norm["category_uid"], activity=activity, fields=tuple(fields),
        constants=norm.get("constants") or {}, unmapped=unmapped if isinstance(unmapped, str) else tuple(unmapped),
        envelope=parse.get("envelope", "none"), options=parse.get("options") or {},
        required=tuple(check.get("required") or ()), on_failure=check.get("on_failure", "dead_letter"),
        enabled=doc.get("enabled", True), priority=doc.get("priority", 100),
    )


def to_mapping(d: Definition) -> dict:
    """The YAML-shaped mapping of a definition; the inverse of :func:`from_mapping`."""
    fields = {}
    for f in d.fields:
        spec: dict[str, Any] = {"from": list(f.sources) if len(f.sources) > 1 or f.join is not None else f.sources[0]}
        if f.values is not None:
            spec |= {"map": dict(f.values), "default": f.default}
        else:
            spec["type"] = f.type
            spec |= {"default": f.default} if f.default is not None else {}
        spec |= {k: v for k, v in (("format", f.format), ("tz", f.tz), ("join", f.join)) if v is not None}
        fields[f.path] = spec | ({"required": True} if f.required else {})
    activity = d.activity
    if isinstance(activity, Activity):
        activity = {"from": activity.source, "map": dict(activity.values), "default": activity.default}
    return {
        "name": d.name, "version": d.version, "vendor": d.vendor, "product": d.product, "product_version": d.product_version,
        "priority": d.priority, "enabled": d.enabled, "detect": d.detect,
        "parse": {"envelope": d.envelope, "engine": d.engine, "options": d.options},
        "normalize": {
            "class_uid": d.class_uid, "category_uid": d.category_uid, "activity_id": activity, "constants": dict(d.constants),
            "fields": fields, "unmapped": d.unmapped if isinstance(d.unmapped, str) else list(d.unmapped),
        },
        "validate": {"required": list(d.required), "on_failure": d.on_failure},
    }


def load_yaml(text: str) -> Definition:
    return from_mapping(yaml.safe_load(text))


def load_folder(folder: str | Path) -> list[Definition]:
    """Every ``*.yaml`` of a folder."""
    return ordered([load_yaml(p.read_text("utf-8")) for p in sorted(Path(folder).glob("*.yaml"))])


def ordered(defs: list[Definition]) -> list[Definition]:
    """Enabled definitions in match order: priority, then name."""
    return sorted((d for d in defs if d.enabled), key=lambda d: (d.priority, d.name))
