"""Search and indexing knobs as a frozen dataclass (validated on creation)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's defaults.
DEFAULT_KEYWORD_WEIGHT = 0.3
DEFAULT_TOP_K = 10
DEFAULT_NAME_MATCH_BOOST = 2.0
DEFAULT_DOC_MATCH_BOOST = 1.5
DEFAULT_FILE_KEYWORDS = ("lemmas", "specs", "field.rs", "scalar.rs")
DEFAULT_FUNCTION_PREFIXES = ("lemma_", "axiom_", "spec_", "proof_")
FUNCTION_KIND = 17
DEFINITION_ROLE = 1


@dataclass(frozen=True)
class SearchConfig:
    keyword_weight: float = DEFAULT_KEYWORD_WEIGHT
    top_k: int = DEFAULT_TOP_K
    name_match_boost: float = DEFAULT_NAME_MATCH_BOOST
    doc_match_boost: float = DEFAULT_DOC_MATCH_BOOST
    # hashing-encoder width (our encoder, see functions.encode)
    dims: int = 256

    def __post_init__(self) -> None:
        if not 0.0 <= self.keyword_weight <= 1.0:
            raise ValueError("keyword_weight must be in [0, 1]")
        if self.top_k < 1:
            raise ValueError("top_k must be >= 1")
        if self.name_match_boost < 0 or self.doc_match_boost < 0:
            raise ValueError("boosts must be >= 0")
        if self.dims < 1:
            raise ValueError("dims must be >= 1")


@dataclass(frozen=True)
class IndexConfig:
    file_keywords: tuple[str, ...] = field(default=DEFAULT_FILE_KEYWORDS)
    function_prefixes: tuple[str, ...] = field(default=DEFAULT_FUNCTION_PREFIXES)
    function_kind: int = FUNCTION_KIND
    definition_role: int = DEFINITION_ROLE

    def __post_init__(self) -> None:
        if not self.file_keywords:
            raise ValueError("file_keywords must not be empty")
        if not self.function_prefixes:
            raise ValueError("function_prefixes must not be empty")
