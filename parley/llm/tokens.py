"""Token ids of a public byte-level BPE vocabulary.

Two libraries read the same vocabulary file. Texts of plain Latin letters go through the faster one; any other text goes
through `tokenizers`, so that classes of rare characters are decided by it alone. Both give the same ids (tested).

The string of a special token inside a text is that token for `ids`, which is what `tokenizers` gives for the file as it
is, and ordinary text for `plain_ids`.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")


def bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _readers(path: str) -> tuple[tiktoken.Encoding, Tokenizer, Tokenizer, re.Pattern | None]:
    """The fast reader, the slow one with and without special tokens in texts, and what finds their strings."""
    own, slow = Tokenizer.from_file(path), Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told.get("added_tokens", [])}
    letters = bytes_of_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    marks = re.compile("|".join(re.escape(c) for c in sorted(special, key=len, reverse=True))) if special else None
    return fast, own, slow, marks


def plain_ids(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Token ids of a text in which the strings of special tokens are ordinary text; none are added."""
    fast, _, slow, _ = _readers(path)
    if _PLAIN.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def ids(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Token ids of a text as `tokenizers` reads it, no special tokens added."""
    _, own, _, marks = _readers(path)
    if marks is not None and marks.search(text):
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")
    return plain_ids(text, path)
