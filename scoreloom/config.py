"""Reward configuration: a validated, immutable value that compiles into literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from types import MappingProxyType

from scoreloom import constants as K

SCRIPT_MODES = ("ranges", "literal")

# keys a plain mapping has to bring along; the others fall back to the defaults
REQUIRED_KEYS = (
    "weights",
    "arabic_penalty_factor",
    "reward_keywords_value",
    "forbidden_penalty_value",
    "q_words_penalty_value",
    "keywords_to_reward",
    "keywords_to_penalize",
    "arabic_question_words",
)


@dataclass(frozen=True)
class RewardConfig:
    """Weights, scalars, word lists and clamp bounds of the reward.

    ``script_mode='ranges'`` counts characters of the four Arabic blocks.
    ``'literal'`` gives every completion the full penalty, as totals computed
    with a character test that never succeeds do.
    """

    weights: Mapping[str, float] = field(default_factory=lambda: dict(K.DEFAULT_WEIGHTS))
    target_length: float = 70
    length_penalty_per_char: float = 0.05
    length_positive_exact: float = 0.5
    length_positive_close: float = 0.2
    arabic_penalty_factor: float = 10.0
    reward_keywords_value: float = 1.0
    forbidden_penalty_value: float = 2.0
    q_words_penalty_value: float = 1.0
    keywords_to_reward: Sequence[str] = K.REWARD_KEYWORDS
    keywords_to_penalize: Sequence[str] = K.FORBIDDEN_KEYWORDS
    arabic_question_words: Sequence[str] = K.QUESTION_WORDS
    think_answer_reward_value: float = 1.0
    think_answer_penalty_value: float = -1.0
    think_answer_order_penalty: float = -0.5
    think_tags: tuple[str, str] = K.THINK_TAGS
    answer_tags: tuple[str, str] = K.ANSWER_TAGS
    clamp_rewards: Mapping[str, float | None] | None = field(
        default_factory=lambda: {"min": -5.0, "max": 5.0}
    )
    script_mode: str = "ranges"

    def __post_init__(self) -> None:
        missing = [name for name in K.DEFAULT_WEIGHTS if name not in self.weights]
        if missing:
            raise KeyError(f"weights lack {missing}")
        if self.script_mode not in SCRIPT_MODES:
            raise ValueError(f"script_mode must be one of {SCRIPT_MODES}, not {self.script_mode!r}")
        if self.clamp_rewards:
            for bound in ("min", "max"):
                if bound not in self.clamp_rewards:
                    raise KeyError(f"clamp_rewards lacks {bound!r}")
        for name in ("keywords_to_reward", "keywords_to_penalize", "arabic_question_words"):
            words = getattr(self, name)
            if isinstance(words, str) or not all(isinstance(w, str) for w in words):
                raise TypeError(f"{name} must be a sequence of strings")
            object.__setattr__(self, name, tuple(words))
        for name in ("think_tags", "answer_tags"):
            tags = tuple(getattr(self, name))
            if len(tags) != 2 or not all(isinstance(t, str) and t for t in tags):
                raise ValueError(f"{name} must be an opening and a closing tag, not {tags!r}")
            object.__setattr__(self, name, tags)
        object.__setattr__(self, "weights", MappingProxyType(dict(self.weights)))
        if self.clamp_rewards is not None:
            object.__setattr__(self, "clamp_rewards", MappingProxyType(dict(self.clamp_rewards)))

    @classmethod
    def from_mapping(cls, values: Mapping) -> RewardConfig:
        """Read a nested dict; a missing required key raises ``KeyError``.

        Without ``clamp_rewards`` (or with a falsy one) totals are not clamped.
        """
        missing = [key for key in REQUIRED_KEYS if key not in values]
        if missing:
            raise KeyError(f"reward configuration lacks {missing}")
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown reward configuration keys {unknown}")
        return cls(**{"clamp_rewards": None, **values})

    def with_(self, **changes) -> RewardConfig:
        return replace(self, **changes)

    def reweighted(self, **weights: float) -> RewardConfig:
        return replace(self, weights={**self.weights, **weights})

    @property
    def lexicon(self) -> dict[str, tuple[str, ...]]:
        return {
            "reward": self.keywords_to_reward,
            "forbidden": self.keywords_to_penalize,
            "question": self.arabic_question_words,
        }


DEFAULT = RewardConfig()
