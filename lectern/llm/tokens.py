"""Token ids of a public byte-level BPE vocabulary, one call per text.

The ids are those of ``tokenizers`` for the vocabulary file, without special tokens.  The
merges run in ``tiktoken`` over the same vocabulary, which gives the same ids at a third
of the CPU time; what it cannot take (special tokens spelled out, endless runs of
white space) goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
END = 1  # the id that ends a document
_RUN = re.compile(r"\s{2000}|\S{20000}")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as they are, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def _load(path: str) -> tuple[Tokenizer, tiktoken.Encoding, re.Pattern | None]:
    slow = Tokenizer.from_file(path)
    byte, special = _byte_of(), {t.content for t in slow.get_added_tokens_decoder().values()}
    ranks = {bytes(byte[c] for c in k): v for k, v in slow.get_vocab().items() if k not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, re.compile("|".join(map(re.escape, special))) if special else None


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text as uint32, and ``END``."""
    slow, fast, special = _load(path)
    if not text:
        return np.array([END], np.uint32)
    if (special and special.search(text)) or _RUN.search(text):
        ids = slow.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    ids.append(END)
    return np.array(ids, np.uint32)


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def id_type(path: str) -> str:
    """The narrowest little-endian type that holds every id."""
    return "<u2" if _load(path)[0].get_vocab_size() <= 1 << 16 else "<u4"
