"""Validated policy of the correlation engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

WARN, ERROR = "exact_only_and_warn", "error"


class ConfigError(ValueError):
    """``code``: ScoreOutOfRange, ThresholdOrder, BlockSize or UnknownField."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Config:
    """Thresholds are basis points (0 to 10,000)."""

    duplicate_threshold: int = 8500
    review_threshold: int = 6500
    subject_similarity_threshold: int = 9000
    cross_source_only: bool = True
    issue_only_exact: bool = False
    max_block_size: int = 1000
    oversized_block_policy: str = WARN

    def __post_init__(self):
        for name in ("duplicate_threshold", "review_threshold", "subject_similarity_threshold"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= 10_000:
                raise ConfigError("ScoreOutOfRange", name)
        if self.review_threshold > self.duplicate_threshold:
            raise ConfigError("ThresholdOrder")
        if isinstance(self.max_block_size, bool) or not isinstance(self.max_block_size, int) or self.max_block_size < 2:
            raise ConfigError("BlockSize")
        if self.oversized_block_policy not in (WARN, ERROR):
            raise ConfigError("UnknownField", "oversized_block_policy")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        """All seven fields are required and no other is allowed."""
        data = json.loads(text)
        names = {f.name for f in fields(cls)}
        if not isinstance(data, dict) or set(data) != names:
            raise ConfigError("UnknownField", str(sorted(set(data) ^ names)) if isinstance(data, dict) else "not an object")
        return cls(**data)
