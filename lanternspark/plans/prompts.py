"""Prompts for a chat model, and where a model is called."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternspark.functions import constants as C
from lanternspark.operators.grounding import grounded_prompt, user_content

FAMILIES = ("raw", "chatml", "llama3", "tinyllama")
#: The tags that end a turn.
STOPS = {"chatml": ("<|im_end|>",), "llama3": ("<|eot_id|>",), "tinyllama": ("</s>",)}


@dataclass(frozen=True)
class ChatMeta:
    chat_family: str = ""
    has_chat_template: bool = False
    default_system: str = ""


def load_meta(spark: SparkSession, model_path: str, meta_path: str = "") -> ChatMeta:
    """What the key=value file beside a model (its path with .meta.txt for the ending), or at ``meta_path``,
    says of its chats. Without such a file the raw family is taken; unknown keys are ignored."""
    path = meta_path or re.sub(r"\.[^./]*$", "", model_path) + ".meta.txt"
    folder, _, name = path.rpartition("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder or ".").select(F.decode("content", "UTF-8").alias("t")).head()
    if found is None:
        return ChatMeta(chat_family="raw")
    own = dict(line.split("=", 1) for line in found.t.splitlines() if "=" in line and not line.startswith("#"))
    return ChatMeta(own.get("chat_family", ""), own.get("has_chat_template", "0").strip().lower() in ("1", "true"), own.get("default_system", ""))


@dataclass(frozen=True)
class ChatOptions:
    chat_family: str = ""
    allow_approx_chat: bool = False
    use_model_default_system: bool = False
    system_extra: str = ""
    max_new_tokens: int = 64
    temperature: float = 0.0
    stop: tuple[str, ...] = ()
    prompt_override: str = ""


def generation_settings(o: ChatOptions, m: ChatMeta = ChatMeta()) -> dict:
    """What a model is called with: its family after the policy's check, its length, temperature and stops."""
    family = chat_family(o, m)
    enforce_policy(family, m, o.allow_approx_chat)
    return {"chat_family": family, "max_new_tokens": o.max_new_tokens, "temperature": o.temperature, "stop": [*o.stop, *STOPS.get(family, ())]}


def system_content(o: ChatOptions, m: ChatMeta = ChatMeta()) -> str:
    out = C.SYSTEM_RULES
    if o.use_model_default_system and m.default_system:
        out += f"\nModel default system (secondary):\n{m.default_system}\n"
    return out + (f"\n{o.system_extra}\n" if o.system_extra else "")


def chat_family(o: ChatOptions, m: ChatMeta) -> str:
    return o.chat_family or m.chat_family or "chatml"


def enforce_policy(family: str, m: ChatMeta, allow_approx: bool) -> None:
    if not allow_approx and (family == "hf_jinja" or (m.has_chat_template and family not in FAMILIES)):
        raise ValueError(f"chat family {family!r} needs the model's own template: render the prompt elsewhere and pass it on, or allow an approximate family")


def format_chat(family: str, system: str, user: Column) -> Column:
    """Both turns in the tags of a family, open for the assistant's turn."""
    around = {
        "chatml": (f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
        "llama3": (f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"),
        "tinyllama": (f"<|system|>\n{system}</s>\n<|user|>\n", "</s>\n<|assistant|>\n"),
    }
    if family not in around:
        raise ValueError(f"unknown chat family {family!r}")
    before, after = around[family]
    return F.concat(F.lit(before), user, F.lit(after))


def generate_prompt(query: Column, used: Column, o: ChatOptions = ChatOptions(), m: ChatMeta = ChatMeta()) -> Column:
    if o.prompt_override:
        return F.lit(o.prompt_override)
    family = chat_family(o, m)
    enforce_policy(family, m, o.allow_approx_chat)
    if family == "raw":
        return grounded_prompt(query, used)
    return format_chat("chatml" if family == "hf_jinja" else family, system_content(o, m), user_content(query, used))


def generated(collected: DataFrame, generate: Callable[[list[str]], list[str]], o: ChatOptions = ChatOptions(), m: ChatMeta = ChatMeta()) -> DataFrame:
    """``collected`` with a ``model_text``; the model is called on workers, for queries with a context."""
    asked = collected.where(F.size("used") > 0).select("qid", generate_prompt(F.col("query"), F.col("used"), o, m).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = generate(batch.column(1).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["qid", "model_text"])

    return collected.join(asked.mapInArrow(run, "qid bigint, model_text string"), "qid", "left")
