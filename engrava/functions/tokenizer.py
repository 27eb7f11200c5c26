"""Tokens of a public byte-level vocabulary and where they start in a text."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from pathlib import Path

#: Pre-tokenisation of the byte-level vocabularies (the usual published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_spans: dict[str, Callable] = {}


def tokenizer_path() -> str:
    """The vocabulary that is used unless another is named; executors need it at the same path."""
    return os.environ.get("ENGRAVA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def token_spans(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """A function that gives the (start, end) of each token of a text, in characters; a token that begins inside a
    character begins where that does."""
    if path not in _spans:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        e = tiktoken.Encoding(re.sub(r"\W", "_", path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def spans(text: str) -> list[tuple[int, int]]:
            _, at = e.decode_with_offsets(e.encode_ordinary(text))
            return list(zip(at, [*at[1:], len(text)]))

        _spans[path] = spans
    return _spans[path]
