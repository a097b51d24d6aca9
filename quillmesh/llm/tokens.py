"""Token ids of public tokenizers: what stands between white space has ids of its own, so each such word is encoded once."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Words whose ids a worker remembers; beyond, it starts anew.
MEMORY = 400_000
#: Words that need the tokenizer's own tables (normal forms, special tokens) or hold the mark that ends a word here.
ODD = re.compile("[^\x01-ɏ]|<\\|")
#: Fixed by the tokenizer: how it cuts a word into pre-tokens, and how it ends one.
PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SUFFIX = "</w>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_pieces(path: str) -> tiktoken.Encoding:
    """The byte pair merges of a word-end vocabulary, for single pre-tokens that end in NUL: merges in the order of ids."""
    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    letters, ranks = byte_letters(), {}
    for token, i in vocab.items():
        if not token.startswith("<|"):
            end = token.endswith(SUFFIX) and token != SUFFIX
            body = token.removesuffix(SUFFIX) if end else token
            ranks[bytes(letters[c] for c in body) + b"\x00" * end] = i
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of a lower-casing word-level BPE, as little-endian unsigned 32-bit bytes; equal to Tokenizer.encode()."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        self.pieces = word_pieces(path).encode_ordinary
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, word: str) -> bytes:
        if ODD.search(word):
            return self.whole(word)
        ids = [i for part in PRE.findall(word.lower()) for i in self.pieces(part + "\x00")]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), symbols to the tokenizer
            return self.whole(text)
        out, words = [], text.split()
        for at in range(0, len(words), MEMORY // 4):
            part = words[at : at + MEMORY // 4]
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known.update((w, self.learn(w)) for w in set(part) if w not in self.known)
            out.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(out)
