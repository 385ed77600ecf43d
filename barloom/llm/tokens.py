"""Token ids of a public word-end BPE tokenizer, given as the path of its tokenizer file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Texts of these characters alone need no Unicode normalisation, so the quick route gives the same ids.
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
END = "</w>"


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEndBpe:
    """ids of texts as the tokenizer file gives them without special tokens added.

    A word's end is a zero byte here, so a merge table of byte strings can hold the word-end tokens; ranks are the ids,
    as merges are numbered in order. Texts outside PLAIN, or that may hold a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))
        special = {t["id"] for t in model["added_tokens"]}
        alphabet, ranks = _byte_alphabet(), {}
        for token, number in model["model"]["vocab"].items():
            if number not in special:
                end = token.endswith(END)
                ranks[bytes(alphabet[c] for c in (token[:-len(END)] if end else token)) + b"\0" * end] = number
        self.quick = tiktoken.Encoding("word-end", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or not PLAIN.fullmatch(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        words = WORDS.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint32)
        return self.quick.encode_to_numpy("\0".join(words) + "\0", disallowed_special=()).astype(np.uint32)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordEndBpe:
    """One per Python worker."""
    return WordEndBpe(path)
