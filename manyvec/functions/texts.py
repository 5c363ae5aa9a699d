"""String columns: prompts, names, tags, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query augmentation tokens and visual prompts by model family
AUGMENTATION_TOKENS = {
    "gemma3": "<eos>",
    "idefics3": "<end_of_utterance>",
    "modernvbert": "<end_of_utterance>",
    "paligemma": "<pad>",
    "qwen2": "<|endoftext|>",
    "qwen2_5": "<|endoftext|>",
    "qwen3": "<|endoftext|>",
    "qwen3_5": "<|endoftext|>",
    "qwen_omni": "<|endoftext|>",
}
VISUAL_PROMPTS = {
    "idefics3": "<|im_start|>User:<image>Describe the image.<end_of_utterance>\nAssistant:",
    "modernvbert": "<|begin_of_text|>User:<image>Describe the image.<end_of_utterance>\nAssistant:",
    "paligemma": "<image><bos>Describe the image.",
    "qwen2": "<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>Describe the image.<|im_end|><|endoftext|>",
    "qwen2_5": "<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>Describe the image.<|im_end|><|endoftext|>",
    "qwen3": "<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>Describe the image.<|im_end|><|endoftext|>",
    "qwen3_5": "<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>Describe the image.<|im_end|><|endoftext|>",
}
IMAGE_TOKENS = {"idefics3": "<image>", "modernvbert": "<image>", "paligemma": "<image>", "qwen2": "<|image_pad|>", "qwen2_5": "<|image_pad|>", "qwen3": "<|image_pad|>", "qwen3_5": "<|image_pad|>"}
QUERY_PREFIXES = {"qwen_omni": "Query: "}


def augment_query(text: Column, token: str, prefix: str = "", suffix: str | None = None, times: int = 10) -> Column:
    """prefix + text + suffix, the suffix being ``times`` augmentation tokens unless given."""
    return F.concat(F.lit(prefix), text, F.lit(token * times if suffix is None else suffix))


def exclusive(texts, queries):
    """Exactly one of the two names of the input."""
    if (texts is None) == (queries is None):
        raise ValueError("give either texts or queries")
    return texts if queries is None else queries


def with_bos(text: Column, bos: str = "<bos>") -> Column:
    return F.concat(F.lit(bos), text, F.lit("\n"))


def page_name(number: Column) -> Column:
    return F.concat(F.lit("page_"), F.lpad(number.cast("string"), 3, "0"))


def variant_name(path: Column) -> Column:
    """The degradation tag in ``page_001_<tag>.<ending>``; null elsewhere."""
    tag = F.regexp_extract(path, r"page_001_([A-Z_]+)\.[A-Za-z]+$", 1)
    return F.when(tag != "", tag)


def components(variant: Column) -> Column:
    return F.filter(F.split(variant, "_"), lambda x: x != "")


def pretty_token(token: Column) -> Column:
    return F.regexp_replace(token, "[Ġ▁]", " ")


def cache_key(doc_id: Column, mode: Column, variant: Column) -> Column:
    return F.concat_ws("__", doc_id, mode, F.coalesce(variant, F.lit("clean")))


def stable_hash(value: Column, seed: int) -> Column:
    """Hex SHA-1 of "seed:value"."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"))


def message(role: str, kind: str, text: Column) -> Column:
    """A one-part chat message."""
    return F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit(kind).alias("type"), text.alias("text"))).alias("content"))


def conversation(kind: str, content: Column, prompt: str | None = None) -> Column:
    """Messages for one text, image, audio or video input."""
    if kind not in ("text", "image", "audio", "video"):
        raise ValueError(f"unknown kind {kind!r}")
    parts = [message("system", "text", F.lit(prompt))] if prompt else []
    return F.array(*parts, message("user", kind, content))


def chat_query(text: Column) -> Column:
    return F.concat(F.lit("Query: "), text)


def plain_base64(data: Column) -> Column:
    """Base64 in one line; Spark's own breaks it after every 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def payload(images: Column | None, queries: Column | None, most: int = 8) -> Column:
    """The request body of exactly one kind of input, or its error."""
    if (images is None) == (queries is None):
        raise ValueError("give either images or queries")
    if queries is not None:
        return F.to_json(F.struct(queries.alias("queries")))
    body = F.to_json(F.struct(F.transform(images, plain_base64).alias("images")))
    return F.when(F.size(images) <= most, body).otherwise(F.to_json(F.struct(F.lit(f"at most {most} images").alias("error"))))


def run_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def result_name(stamp: Column, mode: Column, variant: Column) -> Column:
    return F.concat(stamp, F.lit("_"), mode, F.lit("_singleview_"), F.coalesce(variant, F.lit("clean")), F.lit(".json"))


def analysis_name(stamp: Column, variant: Column) -> Column:
    return F.concat(stamp, F.lit("_restoration_analysis_"), variant, F.lit(".json"))


def without_special(tokens: Column, special: list[int]) -> Column:
    """(index, id) of the tokens of a list that are not special."""
    tagged = F.transform(tokens, lambda t, i: F.struct(i.alias("index"), t.alias("id")))
    return F.filter(tagged, lambda x: ~x["id"].isin(special))
