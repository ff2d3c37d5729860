"""All parameters of retrieval, answers and evaluation, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By confidence level, the least score of a supporting chunk and how many of them an answer needs.
THRESHOLDS = {"low": 0.15, "medium": 0.35, "high": 0.55}
SUPPORTING = {"low": 1, "medium": 1, "high": 2}


#: Names and defaults of the settings below.
@dataclass(frozen=True)
class Config:
    """One assistant's settings; everything else takes them from here."""

    instructions: str = ""
    on_missing_information: str = "no_information"
    confidence_required: str = "medium"
    answer_language: str = "match_question"
    always_cite_pages: bool = True
    dense_top_k: int = 60
    sparse_top_k: int = 60
    rerank_top_k: int = 50
    final_top_k: int = 5
    max_per_document: int = 2
    min_distinct_documents: int = 2
    relative_score_floor: float = 0.6
    rrf_k: int = 60
    weight_dense: float = 1.0
    weight_sparse: float = 0.6
    weight_char_ngram: float = 0.4
    anchored_sparse_weight: float = 1.0
    selectivity_exact: float = 0.15
    max_overfetch: int = 20
    context_chars: int = 8000
    ngram_pool: int = 200
    ngram_text_chars: int = 800
    ngram_query_chars: int = 120
    max_hamming: int = 3
    min_cosine: float = 0.93
    temperature: float = 0.2
    max_tokens: int = 2200
    repeat_penalty: float = 1.08
    prompt_tier: str = "compact"
    system_tokens: int = 180
    persona_tokens: int = 250
    reserve_tokens: int = 250
    eval_depth: int = 50
    calibration_features: int = 10
    ridge_lambda: float = 0.1
    min_calibration_queries: int = 38
    min_useful_ndcg: float = 0.30

    @property
    def threshold(self) -> float:
        return THRESHOLDS[self.confidence_required]

    @property
    def supporting(self) -> int:
        return SUPPORTING[self.confidence_required]

    def answer_tokens(self, detailed: bool = False) -> int:
        """A detailed answer may take twice as many."""
        return self.max_tokens * (2 if detailed else 1)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, raw: str | None) -> Config:
        """The settings that raw names; unknown ones are dropped, absent ones keep their default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (json.loads(raw) if raw else {}).items() if k in known})


def schema() -> str:
    kinds = {"str": "string", "bool": "boolean", "int": "int", "float": "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Config))


def settings(raw: Column) -> Column:
    """A column of JSON settings as a struct; unknown keys are dropped, absent ones null."""
    return F.from_json(raw, schema())


def level_threshold(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), level)


def level_supporting(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUPPORTING.items() for x in kv]), level)
