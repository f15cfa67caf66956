"""Prompts that ask a model for labels: taxonomy, instructions and message arrays."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.schemas import PROMPTS
from tessella.sources.taxonomy import lines


@dataclass(frozen=True)
class Prompt:
    """One kind of labelling: what is asked, the answer's key for a label, guidelines, and worked examples (code, expected answer)."""

    system: str
    label_key: str
    guidelines: tuple[str, ...]
    template: str = "Label this code. Its lines are numbered.\n\n{code}"
    whole_file: bool = False
    examples: tuple[tuple[str, dict], ...] = field(default=())

    def schema(self) -> dict:
        label = {self.label_key: "name from the taxonomy", "category": "its category", "confidence": "low | medium | high", "evidence": "one sentence"}
        if not self.whole_file:
            label["code_elements"] = [{"start_line": 1, "end_line": 1, "snippet": "the lines as they stand"}]
        return {"labels": [label], "no_pattern_detected": False}


_COMMON = ("Use only names of the taxonomy.", "Give each label once, with the evidence for it.", "If nothing fits, return no labels and set no_pattern_detected.")
REGISTRY: dict[str, Prompt] = {
    "design_pattern": Prompt("You label design patterns in source code.", "pattern", (*_COMMON, "Mark the smallest lines that show the pattern.")),
    "idiom": Prompt("You label idioms and language constructs in source code.", "idiom", (*_COMMON, "Mark the lines of each use.")),
    "algorithmic_paradigm": Prompt("You label algorithmic paradigms in source code.", "paradigm", (*_COMMON, "Mark the lines that carry the algorithm.")),
    "programming_paradigm": Prompt("You label programming paradigms of whole source files.", "paradigm", (*_COMMON, "Judge the file as a whole."), whole_file=True),
}


def instructions(p: Prompt) -> str:
    out = ["Guidelines:", *(f"- {g}" for g in p.guidelines), "", "Answer with one JSON object of this form:", json.dumps(p.schema(), indent=4)]
    for code, answer in p.examples:
        out += ["", "Example code:", code, "Example answer:", json.dumps(answer, indent=4)]
    return "\n".join(out)


def build_prompt(kind: str, tree: dict, registry: dict[str, Prompt] | None = None) -> tuple[str, str, str, str, str]:
    """A schemas.PROMPTS row; an unknown kind raises ValueError."""
    known = registry or REGISTRY
    if kind not in known:
        raise ValueError(f"prompt type {kind!r} is none of {sorted(known)}")
    p = known[kind]
    return kind, p.system, "\n".join(lines(tree)), instructions(p), p.template


def prompt_parts(spark: SparkSession, trees: dict[str, dict], registry: dict[str, Prompt] | None = None) -> DataFrame:
    return spark.createDataFrame([build_prompt(k, t, registry) for k, t in trees.items()], PROMPTS)


def messages(files: DataFrame, prompts: DataFrame) -> DataFrame:
    """path, prompt_type, messages for every file (path, code) and every prompt: there are a handful of prompts, one row each."""
    d = files.select("path", "code").crossJoin(F.broadcast(prompts))
    return d.select("path", "prompt_type", X.chat_messages(F.col("system_prompt"), F.col("taxonomy"), F.col("annotation_instructions"), F.col("user_prompt_template"), F.col("code")).alias("messages"))
