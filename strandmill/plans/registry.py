"""Named components by family. What a name stands for is a builder of plans, columns or clients."""

from __future__ import annotations

from typing import Any


class Registry:
    def __init__(self, family: str):
        self.family, self._held = family, {}

    def register(self, name: str, value: Any) -> Any:
        if name in self._held:
            raise ValueError(f"{self.family} component {name!r} is registered already")
        self._held[name] = value
        return value

    def get(self, name: str) -> Any:
        if name not in self._held:
            raise ValueError(f"unknown {self.family} component {name!r}; available: {', '.join(self.names())}")
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)


#: The component names that experiment files use.
NAMES = {
    "dataset": ("locomo",), "construction": ("amem", "turn_rag"), "chunker": ("turn",), "retrieval": ("staged",), "context": ("amem", "records"),
    "qa": ("extractive", "failing", "robust"), "metric": ("bleu1", "exact_match", "f1"), "llm_provider": ("fake", "ollama", "openai", "sglang", "vllm"),
    "retrieval_stage": ("bm25", "cross_encoder", "embedding", "embedding_rerank", "limit", "query_transform"),
}
HIDDEN = {("qa", "failing")}


def catalog() -> dict[str, Registry]:
    """All families with their components."""
    from strandmill.functions import metrics, providers
    from strandmill.operators import construct, context
    from strandmill.plans import stages
    from strandmill.sources import conversations, dialogues

    values = {("dataset", "locomo"): dialogues.load, ("construction", "amem"): construct.build_notes, ("construction", "turn_rag"): conversations.records, ("chunker", "turn"): conversations.records, ("retrieval", "staged"): stages.retrieve, ("context", "amem"): context.graph_lines, ("context", "records"): context.line, ("qa", "robust"): context.qa_prompt}
    out = {}
    for family, names in NAMES.items():
        out[family] = Registry(family)
        for name in names:
            default = {"metric": metrics.METRICS.get(name), "llm_provider": providers.client, "retrieval_stage": stages.STAGES.get(name), "qa": context.extractive}.get(family)
            out[family].register(name, values.get((family, name), default))
    return out


def public_names() -> dict[str, list[str]]:
    return {family: [n for n in held.names() if (family, n) not in HIDDEN] for family, held in catalog().items()}
