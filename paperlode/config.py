"""Parameters of the jobs, as frozen dataclasses passed to operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class WindowConfig:
    """Token-budget windows over the sentences of a paper."""

    max_tokens: int = 512
    min_sentences: int = 3
    context: int = 2
    positive_step_div: int = 3
    chunk: int = 4096


@dataclass(frozen=True)
class PackConfig:
    """Character-budget packing of sentences into requests."""

    budget: int = 9000
    max_items: int = 160
    cut: int = 480
    header_chars: int = 400
    chunk: int = 4096


@dataclass(frozen=True)
class LinkConfig:
    """Selection of the primary link of a paper."""

    mode: str = "hybrid"  # rule | llm | hybrid
    preferred_top: int = 5
    fallback_top1: bool = True
    strict: bool = False
    context_sentences: int = 6
    context_chars: int = 2000
    probe_sentences: int = 6  # on each side of a link
    window_tokens: int = 10000
    min_sentences: int = 3
    pivot_context: int = 2


@dataclass(frozen=True)
class FeedConfig:
    """Continuous intake of landed metadata."""

    categories: tuple = ("cs.IR", "cs.DB", "cs.AI", "cs.CL", "cs.CV", "cs.MA")
    gate_threshold: float = 0.5
    look_back_days: int | None = 3
    target_day: str | None = None
    min_description_chars: int = 1
    trigger: str = "30 minutes"
