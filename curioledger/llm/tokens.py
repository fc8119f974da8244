"""Byte-level BPE ids of whole texts, as packed 32-bit integers.

The vocabulary comes from a public tokenizer file given by its path. Its merges are ordered like its
ids, so the ids are the ranks of the faster of the two installed encoders; texts that hold a special
token go through the other.
"""

import json
from array import array

import tiktoken
from tokenizers import Tokenizer

# The pre-token rule of byte-level BPE files of this family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in parts["added_tokens"]]
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in token): rank
            for token, rank in parts["model"]["vocab"].items()
            if token not in self.special
        }
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def packed(self, text: str) -> bytes:
        """Little-endian 32-bit ids, one after the other."""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
