"""Token ids of a published byte-level BPE vocabulary.

``tokenizers`` defines the ids.  ``tiktoken`` reads the same vocabulary and is
several times faster; both split texts by the same pattern, but their regular
expression engines may class rare characters differently.  So ``tiktoken``
serves texts of letters, digits, punctuation and plain white space up to
U+024F, where the classes are settled, and ``tokenizers`` all others.  It also
serves texts with a run of more than ``LONG_BLANK`` white-space characters: the
pattern looks ahead there, and ``tiktoken``'s engine takes a stack frame per
character for it, up to the end of the stack near a million.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Longest run of white space for ``tiktoken``.
LONG_BLANK = 10_000
_UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-ɏ]")
_BLANKS = re.compile(r"[\t\n\r ]{64,}")


def _long_blank(text: str) -> bool:
    return len(text) > LONG_BLANK and any(m.end() - m.start() > LONG_BLANK for m in _BLANKS.finditer(text))


@lru_cache(maxsize=2)
def _exact(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@lru_cache(maxsize=2)
def _fast(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit numbers."""
    import public_tokenizers
    if _UNUSUAL.search(text) or _long_blank(text):
        ids = _exact(public_tokenizers.path(f"{vocabulary}.json")).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN).encode_ordinary(text)
    return np.array(ids, dtype="<u4")
