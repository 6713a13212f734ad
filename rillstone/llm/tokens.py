"""Public tokenizers, loaded once per Python worker; their path is a parameter."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files.
FOLDER = "/opt/tokenizers"
#: How the byte-level vocabularies split text before merging (a fixed value of their format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k", folder: str = FOLDER):
    """The tiktoken encoding of a rank file; it knows no special tokens, so that their strings are plain text."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
