"""Conversations and their rendering as one text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompts the model is trained and evaluated with.
SYSTEM_PROMPT = (
    "You are an expert plant pathologist AI assistant specializing in agricultural "
    "visual diagnosis."
)
USER_PROMPT = (
    "Given this crop image, identify the crop disease. Respond with only the disease "
    "name from the official vocabulary."
)
CROP_PROMPT = (
    "Given this %s crop image, identify the crop disease. Respond with only the disease "
    "name from the official vocabulary."
)


@dataclass(frozen=True)
class ChatTemplate:
    """How a checkpoint writes a conversation; it belongs to the checkpoint."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    role_end: str = "\n"
    image: str = "<|vision_start|><|image_pad|><|vision_end|>"
    open_role: str = "assistant"


def prompt_text(crop: Column | None = None) -> Column:
    """The user's question; it names the crop when there is one."""
    if crop is None:
        return F.lit(USER_PROMPT)
    return F.when(crop != "", F.format_string(CROP_PROMPT, crop)).otherwise(F.lit(USER_PROMPT))


def _part(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def conversation(crop: Column | None = None, answer: Column | None = None) -> Column:
    """System message, user message with image and question, and the answer if given.

    ``array<struct<role, content: array<struct<type, text>>>>``. The image part has
    no text: the image stays in its own column. A null answer gives no answer turn.
    """
    nothing = F.lit(None).cast("string")
    asked = F.array(
        _message("system", _part("text", F.lit(SYSTEM_PROMPT))),
        _message("user", _part("image", nothing), _part("text", prompt_text(crop))),
    )
    if answer is None:
        return asked
    answered = F.concat(asked, F.array(_message("assistant", _part("text", answer))))
    return F.when(answer.isNull(), asked).otherwise(answered)


def render(
    messages: Column, template: ChatTemplate = ChatTemplate(), open_turn: bool = False
) -> Column:
    """All messages as one text; ``open_turn`` ends it where the answer begins."""

    def one(message: Column) -> Column:
        parts = F.transform(
            message["content"],
            lambda p: F.when(p["type"] == "image", F.lit(template.image)).otherwise(p["text"]),
        )
        return F.concat(
            F.lit(template.start),
            message["role"],
            F.lit(template.role_end),
            F.array_join(parts, ""),
            F.lit(template.end),
        )

    text = F.array_join(F.transform(messages, one), "")
    if open_turn:
        text = F.concat(text, F.lit(template.start + template.open_role + template.role_end))
    return text
