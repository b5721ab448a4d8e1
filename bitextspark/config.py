"""Plain configuration objects and the fixed symbols used in the text."""

from __future__ import annotations

from dataclasses import dataclass

# Markers that appear verbatim in produced or consumed text.
MASK = "★"
GENUINE_MARK = "◸"
SYNTHETIC_MARK = "◹"
SENTENCE_BREAK = "Ɛ"
JOINER = "@@"
NULL_WORD = "NULL"
TAG_PREFIX = "TO_"

# Ids of the special symbols at the head of every vocabulary.
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>")

# Fixed value: name of the symbols that fill a vocabulary up to a round size.
FILLER = "madeupword"

# Task names. Resampled tasks get a new version in each precomputed epoch; the
# others keep that of epoch 1, those drawn at random included, unless a task asks for it.
FIXED_TASKS = (
    "base", "src", "copy", "rev", "alpha", "invalpha", "length", "invlength", "mono", "shuf", "replace_tgt",
)
RESAMPLED_TASKS = ("wrdp", "wrdp2", "swap", "replace")
REJECTED_TASKS = ("bpe", "rev2")
NEEDS_ALPHA = ("wrdp", "wrdp2", "swap", "replace", "replace_tgt")
BILINGUAL_TASKS = ("mono", "replace", "replace_tgt")

DEFAULT_SEED = 17


@dataclass(frozen=True)
class CleanConfig:
    """Limits of the pair cleaner; `max_ratio=None` switches the ratio test off."""

    min_tokens: int = 5
    max_tokens: int = 100
    max_ratio: float | None = 9.0
    drop_urls: bool = True
    drop_identical: bool = True
    awk_numeric: bool = True


@dataclass(frozen=True)
class TaskSpec:
    """One auxiliary task of a mixture; `resample` overrides the schedule of its name."""

    name: str
    alpha: float | None = None
    resample: bool | None = None

    def __post_init__(self) -> None:
        if self.name in REJECTED_TASKS:
            raise ValueError(f"task {self.name!r} is not supported")
        if self.name not in FIXED_TASKS + RESAMPLED_TASKS + ("none",):
            raise ValueError(f"unknown task {self.name!r}")
        if self.name in NEEDS_ALPHA:
            if self.alpha is None or not 0.0 <= self.alpha <= 1.0:
                raise ValueError(f"task {self.name!r} needs alpha in [0, 1], got {self.alpha!r}")

    @property
    def resampled(self) -> bool:
        return self.name in RESAMPLED_TASKS if self.resample is None else self.resample


def parse_tasks(names: str, alphas: str | None = None) -> list[TaskSpec]:
    """`"rev+wrdp"`, `"0.3"` or `"0+0.3"` -> task specs (one alpha may serve all tasks)."""
    parts = [n for n in names.split("+") if n]
    values = alphas.split("+") if alphas else [None]
    if len(values) == 1:
        values = values * len(parts)
    if len(values) != len(parts):
        raise ValueError("give one alpha, or one per task")
    return [
        TaskSpec(n, float(a) if a is not None and n in NEEDS_ALPHA else None)
        for n, a in zip(parts, values)
    ]
