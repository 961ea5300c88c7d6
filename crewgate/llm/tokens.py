"""Public tokenizer files as byte-pair encoders inside Python workers.

``json_encoder`` reads the vocabulary of a byte-level BPE file of the
``tokenizers`` library, ``rank_encoder`` a rank file of ``tiktoken``.  In such a
vocabulary the id of a merged token grows with the order of its merge, so the
ids themselves are the ranks that ``tiktoken`` merges by; both give the same
ids (``tests/llm/test_tokens.py``), ``tiktoken`` several times faster.  Texts
are ordinary text throughout: a control string inside one is encoded by its
characters and never becomes a control token.
"""

from __future__ import annotations

import numpy as np


def byte_alphabet() -> dict:
    """Character -> byte of byte-level BPE files: printable Latin-1 stands for
    itself, every other byte for the next character from 256 on."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


def json_ranks(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    at = byte_alphabet()
    return {bytes(at[c] for c in token): i for token, i in spec["model"]["vocab"].items()
            if token not in special}


def rank_file(path: str) -> dict:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def assigned():
    """By code point: whether Python's tables have a character there."""
    import unicodedata

    return np.array([unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)])


def splitter(pattern: str):
    """Text -> its pre-tokens, as ``tiktoken`` splits it.

    The ``regex`` module does so except where a text holds a character of a newer
    Unicode version than both know; a text with a character that Python's own, older
    tables do not know is split by the ``tokenizers`` library, whose tables are those of
    ``tiktoken`` (``tests/llm/test_bpe.py`` compares all three).
    """
    import regex
    from tokenizers import Regex, pre_tokenizers

    findall = regex.compile(pattern).findall
    known = assigned()
    whole = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str

    def split(text: str) -> list[str]:
        if text.isascii() or known[np.frombuffer(text.encode("utf-32-le"), "<u4")].all():
            return findall(text)
        return [piece for piece, _ in whole(text)]
    return split


LONG = 500_000      # beyond it one run of white space could exhaust the splitter's stack


def encode(enc, text: str) -> list[int]:
    """Ids of a text of any length; a long one is split outside the library."""
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    out = []
    for piece in splitter(enc._pat_str)(text):
        out += enc._encode_single_piece(piece.encode())
    return out
