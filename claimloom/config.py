"""Run-time output configuration: which fields, under which names, of which type, and what if they are missing."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

# The words of the configuration.
TYPES = ("string", "string[]", "number", "integer", "boolean", "object", "object[]", "any")
NORMALIZERS = ("E164", "canonical", "YYYY-MM", "lower", "upper", "trim")
MISSING = ("null", "omit", "error")


class ConfigError(ValueError):
    """A configuration that cannot be used."""


def _check(obj: object, known: dict[str, type | tuple], where: str) -> dict:
    if not isinstance(obj, dict):
        raise ConfigError(f"{where} must be an object")
    for key, value in obj.items():
        if key not in known:
            raise ConfigError(f"{where} has an unknown key {key!r}")
        if value is not None and not isinstance(value, known[key]):
            raise ConfigError(f"{key!r} in {where} has a wrong type")
    return obj


@dataclass(frozen=True)
class FieldSpec:
    path: str
    source: str | None = None
    type: str = "any"
    required: bool = False
    normalize: str | None = None
    on_missing: str | None = None

    @property
    def source_path(self) -> str:
        return self.path if self.source is None else self.source

    @classmethod
    def from_obj(cls, obj: object) -> FieldSpec:
        known = {"path": str, "from": str, "type": str, "required": bool, "normalize": str, "on_missing": str}
        o = _check(obj, known, "a field")
        if not isinstance(o.get("path"), str):
            raise ConfigError("a field needs a path")
        out = cls(o["path"], o.get("from"), o.get("type") or "any", bool(o.get("required")), o.get("normalize"), o.get("on_missing"))
        for value, allowed in ((out.type, TYPES), (out.normalize, NORMALIZERS), (out.on_missing, MISSING)):
            if value is not None and value not in allowed:
                raise ConfigError(f"{value!r} is not one of {', '.join(allowed)}")
        return out


@dataclass(frozen=True)
class EnrichmentConfig:
    enabled: bool = False
    provider: str = "none"
    model: str = "none"
    fields: tuple[str, ...] = ("headline", "summary")


@dataclass(frozen=True)
class OutputConfig:
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)
    include_confidence: bool = False
    include_provenance: bool = False
    on_missing: str = "null"
    enrichment: EnrichmentConfig | None = None

    @classmethod
    def from_obj(cls, obj: object) -> OutputConfig:
        known = {"fields": list, "include_confidence": bool, "include_provenance": bool, "on_missing": str, "enrichment": dict}
        o = _check(obj, known, "the configuration")
        if not isinstance(o.get("fields"), list):
            raise ConfigError("the configuration needs a list of fields")
        missing = o.get("on_missing") or "null"
        if missing not in MISSING:
            raise ConfigError(f"{missing!r} is not one of {', '.join(MISSING)}")
        enrichment = None
        if o.get("enrichment") is not None:
            e = _check(o["enrichment"], {"enabled": bool, "provider": str, "model": str, "fields": list}, "enrichment")
            enrichment = EnrichmentConfig(**{k: tuple(v) if k == "fields" else v for k, v in e.items()})
        specs = tuple(map(FieldSpec.from_obj, o["fields"]))
        return cls(specs, bool(o.get("include_confidence")), bool(o.get("include_provenance")), missing, enrichment)

    def to_obj(self) -> dict:
        """The configuration as JSON values that :meth:`from_obj` takes."""
        fields = [{"path": f.path, "from": f.source_path, "type": f.type, "required": f.required} | {k: v for k, v in (("normalize", f.normalize), ("on_missing", f.on_missing)) if v} for f in self.fields]
        out = {"fields": fields, "include_confidence": self.include_confidence, "include_provenance": self.include_provenance, "on_missing": self.on_missing}
        if self.enrichment:
            out["enrichment"] = {"enabled": self.enrichment.enabled, "model": self.enrichment.model, "fields": list(self.enrichment.fields)}
        return out

    @classmethod
    def from_file(cls, path: str | Path) -> OutputConfig:
        try:
            return cls.from_obj(json.loads(Path(path).read_text(encoding="utf-8")))
        except (OSError, json.JSONDecodeError) as e:
            raise ConfigError(str(e)) from e


def default_config() -> OutputConfig:
    """All fields of the profile under their own names, with confidence and provenance."""
    kinds = {
        "candidate_id": "string", "full_name": "string", "emails": "string[]", "phones": "string[]", "location": "object",
        "links": "object", "headline": "string", "years_experience": "number", "skills": "object[]",
        "experience": "object[]", "education": "object[]",
    }
    specs = tuple(FieldSpec(p, type=t, required=p == "candidate_id") for p, t in kinds.items())
    return OutputConfig(specs, include_confidence=True, include_provenance=True)
