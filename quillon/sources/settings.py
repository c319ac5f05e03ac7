"""Settings of an engine and of experiments: typed values from the environment, and matrices from TOML files."""

from __future__ import annotations

import ipaddress
import os
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of search and chunking; a variable ``QUILLON_<NAME>`` sets one."""

    top_k: int = 30
    context_budget: int = 12_000
    max_chunks: int = 12
    max_chunks_per_file: int = 4
    mode: str = "vector"
    keyword_weight: float = 1.0
    test_penalty: float = 0.5
    changelog_penalty: float = 1.0
    rerank_top: int = 30
    fusion_k: int = 60
    map_tokens: int = 1_500
    history_turns: int = 3
    chunk_lines: int = 120
    window_lines: int = 60
    window_overlap: int = 10
    embed_batch: int = 64

    @staticmethod
    def from_environment(environment: dict[str, str] | None = None) -> "Settings":
        env = os.environ if environment is None else environment
        kinds = {"int": int, "float": float, "str": str}
        values = {f.name: kinds[str(f.type)](env[f"QUILLON_{f.name.upper()}"]) for f in fields(Settings) if f"QUILLON_{f.name.upper()}" in env}
        out = Settings(**values)
        if out.mode not in ("vector", "keyword", "hybrid") or out.window_overlap >= out.window_lines or min(out.top_k, out.max_chunks, out.chunk_lines) < 1:
            raise ValueError("settings out of range")
        return out


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``models(model)``, ``repos(repo)`` and ``conditions(prompt, context, models)`` of an experiment file."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    for key in ("models", "repos", "conditions"):
        if not data.get(key):
            raise ValueError(f"{path}: no {key}")
    name = lambda x: x["name"] if isinstance(x, dict) else x
    return (
        spark.createDataFrame([(name(m),) for m in data["models"]], "model string"),
        spark.createDataFrame([(name(r),) for r in data["repos"]], "repo string"),
        spark.createDataFrame([(c["prompt"], c["context"], c.get("models")) for c in data["conditions"]], "prompt string, context string, models array<string>"),
    )


def is_local_host(host: str) -> bool:
    """Whether an address stays on this machine."""
    bare = host.split("://")[-1].split("/")[0].rsplit("@", 1)[-1]
    bare = bare[1 : bare.index("]")] if bare.startswith("[") else bare.split(":")[0] if bare.count(":") <= 1 else bare
    if bare.lower() in ("localhost", ""):
        return True
    try:
        return ipaddress.ip_address(bare).is_loopback or bare == "0.0.0.0"
    except ValueError:
        return False
