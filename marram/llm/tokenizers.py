"""Public tokenizers: which one, and how many tokens a text has."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from marram.llm.words import WORD

#: Where vocabulary files lie unless a path is given.
FOLDER = "/opt/tokenizers"


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary of ranks (``.tiktoken``), or a tokenizer or piece model file."""

    path: str = f"{FOLDER}/byte_bpe_50k.tiktoken"
    #: How ranks split text before merging; fixed value of the public vocabulary.
    pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    @cached_property
    def data(self) -> bytes:
        """The vocabulary file, read by the driver; executors get it by broadcast, so they need no path."""
        return Path(self.path).read_bytes()

    @cached_property
    def key(self) -> str:
        """Hash of the vocabulary and the pattern: the identity of its counts."""
        return hashlib.md5(self.data + self.pattern.encode()).hexdigest()

    def counter(self, data: bytes | None = None) -> Callable[[str], int]:
        """A function from a text to its number of tokens; load it once per task."""
        data = self.data if data is None else data
        if self.path.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            encode = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return lambda text: len(encode(text))
        if self.path.endswith(".model"):
            import sentencepiece

            encode = sentencepiece.SentencePieceProcessor(model_proto=data).encode
            return lambda text: len(encode(text, num_threads=1))
        from tokenizers import Tokenizer as Loaded

        t = Loaded.from_buffer(data)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern}  # the vocabulary travels by broadcast only


@dataclass(frozen=True)
class Words:
    """Words as tokens: a tokenizer without a vocabulary."""

    key: str = "words"
    data: bytes = b""

    def counter(self, data: bytes | None = None) -> Callable[[str], int]:
        return lambda text: len(WORD.findall(text))
