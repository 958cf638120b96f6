"""Engine configuration: frozen settings with overrides and validation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from types import MappingProxyType

# Orders and spellings are part of the results.
ANCHOR_ATTRIBUTES = ("data-testid", "data-test", "data-qa", "data-cy", "data-automation-id", "data-key", "data-record-id", "data-component-id", "data-row-key-value")
CRITICAL = (
    "display", "visibility", "position", "z-index"
)
HIGH = (
    "width", "height", "max-width", "max-height", "min-width", "min-height", "color", "background-color", "opacity", "font-size", "font-family",
    "font-weight"
)
SIDES = (
    "top", "right", "bottom", "left"
)
MEDIUM = (
    "margin-top", "margin-right", "margin-bottom", "margin-left", "padding-top", "padding-right", "padding-bottom", "padding-left", "border-top-width",
    "border-right-width", "border-bottom-width", "border-left-width", "border-top-color", "border-right-color", "border-bottom-color",
    "border-left-color", "line-height", "text-align", "font-style"
)
CATEGORIES = MappingProxyType(
    {
        "layout": (
            "display", "position", "float", "clear", "width", "height", "min-width", "max-width", "min-height", "max-height"
        ),
        "visual": (
            "color", "background-color", "border-top-color", "border-right-color", "border-bottom-color", "border-left-color", "opacity", "visibility",
            "box-shadow", "text-shadow"
        ),
        "typography": (
            "font-family", "font-size", "font-weight", "font-style", "line-height", "text-align", "text-decoration", "letter-spacing", "word-spacing"
        ),
        "spacing": (
            "margin-top", "margin-right", "margin-bottom", "margin-left", "padding-top", "padding-right", "padding-bottom", "padding-left"
        ),
        "position": (
            "top", "right", "bottom", "left", "z-index"
        ),
    }
)
DYNAMIC_PROPERTIES = (
    "font-family", "font-size", "font-weight", "font-style", "line-height", "letter-spacing", "text-align", "text-decoration", "text-transform", "color",
    "background-color", "opacity", "visibility", "display", "position", "float", "width", "height", "max-width", "max-height", "min-width", "min-height",
    "top", "right", "bottom", "left", "z-index", "padding", "padding-top", "padding-right", "padding-bottom", "padding-left", "margin", "margin-top",
    "margin-right", "margin-bottom", "margin-left", "gap", "flex-direction", "flex-wrap", "flex-grow", "flex-shrink", "flex-basis", "justify-content",
    "align-items", "align-self", "grid-template-columns", "grid-template-rows", "border-width", "border-style", "border-color", "border-radius",
    "box-shadow"
)
STRUCTURAL_ATTRIBUTES = (
    "role", "aria-label", "aria-labelledby", "aria-describedby", "type", "name", "data-testid", "data-test", "data-qa", "data-cy"
)
IRRELEVANT_TAGS = tuple("script style meta link noscript br hr head title base template slot wbr param track source area col colgroup".split())
# End of fixed values.


@dataclass(frozen=True)
class Mode:
    """How a comparison mode looks at a pair: which properties and attributes, whether at text, with which tolerances."""

    name: str
    properties: tuple[str, ...] | None
    attributes: tuple[str, ...] | None
    text: bool
    color: float
    size: float
    opacity: float


STATIC = Mode("static", None, None, True, 5, 3, 0.01)
DYNAMIC = Mode("dynamic", DYNAMIC_PROPERTIES, STRUCTURAL_ATTRIBUTES, False, 8, 5, 0.05)


@dataclass(frozen=True)
class EngineConfig:
    strategies: tuple[tuple[str, float], ...] = (
        ("test-attribute", 1.0),
        ("absolute-hpid", 0.95),
        ("id", 0.90),
        ("css-selector", 0.80),
        ("xpath", 0.78),
        ("position", 0.30),
    )
    alignment: bool = True
    #: True drops elements that alignment leaves over; False passes them on to the later strategies.
    drop_alignment_orphans: bool = True
    look_ahead: int = 5
    suffix_depth: int = 5
    in_sequence: float = 0.99
    suffix_confidence: float = 0.85
    min_match: float = 0.70
    min_position: float = 0.5
    cell_px: int = 50
    max_elements: int = 10_000
    max_reports: int = 50
    max_comparisons: int = 20
    stability_ms: int = 500
    hard_timeout_ms: int = 1_000
    modes: dict[str, Mode] = field(default_factory=lambda: {"static": STATIC, "dynamic": DYNAMIC})

    def merge(self, **overrides) -> EngineConfig:
        """A copy with other values; unknown names are an error."""
        known = {f.name for f in fields(self)}
        if unknown := set(overrides) - known:
            raise KeyError(f"no such setting: {', '.join(sorted(unknown))}")
        return replace(self, **overrides).validate()

    def mode(self, name: str) -> Mode:
        """An unknown mode is the static one."""
        return self.modes.get(name, self.modes["static"])

    def validate(self) -> EngineConfig:
        ranges = {"look_ahead": (1, 100), "suffix_depth": (1, 50), "in_sequence": (0, 1), "suffix_confidence": (0, 1), "min_match": (0, 1), "min_position": (0, 1),
                  "cell_px": (1, 10_000), "max_elements": (1, 1_000_000), "max_reports": (1, 1_000_000), "max_comparisons": (1, 1_000_000), "stability_ms": (1, 60_000),
                  "hard_timeout_ms": (1_000, 600_000)}
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if not isinstance(value, (int, float)) or not low <= value <= high:
                raise ValueError(f"{name} must be between {low} and {high}: {value!r}")
        if not self.strategies or any(not 0 <= c <= 1 for _, c in self.strategies):
            raise ValueError("strategies need confidences between 0 and 1")
        if len({s for s, _ in self.strategies}) < len(self.strategies):
            raise ValueError("strategies are listed twice")
        return self


DEFAULT = EngineConfig()
