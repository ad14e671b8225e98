"""Byte-level BPE ids.

Texts of common Latin characters are encoded from the rank file of the vocabulary, which
is several times as fast; the tokenizer itself encodes all others, and those with special
tokens. Both give the same ids (``tests/llm``).
"""

from __future__ import annotations

import base64
import re
import sys
import types

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed pattern of this vocabulary's pre-tokens, in Python's character classes.
PRE_TOKEN = re.compile(
    r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
PRE_TOKEN_RUST = (
    r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Characters for which those classes may differ from the tokenizer's.
OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ‐-‧€]")
SPECIAL = "<|endoftext|>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str, plain: bool):
        self.tokenizer = Tokenizer.from_file(path)
        #: Whether special tokens' strings in a text are ordinary text.
        self.plain = plain
        self.tokenizer.encode_special_tokens = plain
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(
            "ranks", pat_str=PRE_TOKEN_RUST, mergeable_ranks=ranks, special_tokens={}
        )

    def pre_tokens(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return PRE_TOKEN.findall(text)
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[i:j] for _, (i, j) in cuts]

    def id_list(self, text: str) -> list[int]:
        if (SPECIAL in text and not self.plain) or OTHER.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return np.array(self.id_list(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self.id_list(text))


def encoder(path: str, plain: bool = False) -> Encoder:
    """The worker's encoder; ``path`` is the tokenizer's file, with the rank file of the
    same name beside it. It is kept in a module of its own, as functions sent to
    tasks carry fresh globals each time."""
    store = sys.modules.setdefault("fitgrain_worker", types.ModuleType("fitgrain_worker"))
    made = store.__dict__.setdefault("encoders", {})
    if (path, plain) not in made:
        made[path, plain] = Encoder(path, plain)
    return made[path, plain]
