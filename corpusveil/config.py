"""Settings of a run, fixed when the plan is built, and the validators of its vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from .functions import fixed


@dataclass(frozen=True)
class SanitizeConfig:
    level: str = "standard"
    style: str = "black"
    response: str = "file"
    redact_entities: tuple[str, ...] | None = None
    score_threshold: float = 0.5
    context_boost: float = 0.35
    context_floor: float = 0.4
    context_tokens: int = 5
    max_file_size: int = 20 * 1024 * 1024
    max_batch_size: int = 10
    rate_limit: int = 30
    rate_window_s: int = 60
    ner_threshold: float = 0.5

    def __post_init__(self):
        one_of("level", self.level, fixed.LEVELS)
        one_of("style", self.style, fixed.STYLES)
        one_of("response", self.response, fixed.RESPONSES)
        for e in self.redact_entities or ():
            one_of("entity", e, fixed.ENTITIES)


def one_of(what: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"Invalid {what} '{value}'. Allowed: {', '.join(allowed)}")
    return value


def parse_entities(value: str | None, lenient: bool = False) -> tuple[str, ...] | None:
    """A comma-separated list of entity types; blank means all (None). An unknown name raises,
    or, if lenient, makes the whole list mean all."""
    names = tuple(n.strip() for n in (value or "").split(",") if n.strip())
    unknown = [n for n in names if n not in fixed.ENTITIES]
    if unknown and not lenient:
        raise ValueError(f"Unknown entity types: {', '.join(unknown)}. Allowed: {', '.join(fixed.ENTITIES)}")
    return names if names and not unknown else None


def lenient_config(level: str = "", style: str = "", response: str = "", entities: str | None = None) -> SanitizeConfig:
    """The tool interface's reading: what is not allowed falls back to the default."""
    pick = lambda v, allowed, default: v if v in allowed else default
    return SanitizeConfig(pick(level, fixed.LEVELS, "standard"), pick(style, fixed.STYLES, "black"), pick(response, fixed.RESPONSES, "file"), parse_entities(entities, lenient=True))
