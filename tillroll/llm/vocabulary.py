"""Loading of public tokenizer files, once per Python worker."""

from __future__ import annotations

import functools
import json
import os


def resolve(name: str) -> str:
    """A path as it is; a bare name is looked up on the machine that uses it."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(resolve(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=4)
def description(name: str) -> dict:
    with open(resolve(name), encoding="utf-8") as f:
        return json.load(f)


def specials(name: str) -> list[str]:
    return [t["content"] for t in description(name)["added_tokens"]]


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]
