"""Byte-level BPE: whole texts, or pre-tokens that are each encoded once per worker.

The library's file gives vocabulary and merges. Where every merge's result has the next id, merging by
lowest id is the same as merging by the file's order, and the compiled rank encoder gives the library's
ids; texts with a special string, and files of another kind, go to the library itself.

Merges never cross the pre-tokens that a pattern cuts a text into, so a text has as many tokens as its
pre-tokens together, and each distinct one is encoded once.
"""

from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

PATTERN = regex.compile(public_tokenizers.PATTERN)
# Code points that are letters or numbers to the pattern's engine and not to the library's, or the other way round, as their tables are of different years; all rare ones beyond 16 bits count with them.
DISPUTED = regex.compile("[\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D\U00010000-\U0001EFFF\U0001FB00-\U0010FFFF]")
#: A space that a text may not be cut before: the pattern never lets a pre-token run from another character into white space, and gives one space to the pre-token after it, but keeps longer white space together.
TIED = regex.compile(r"\s (?=\s|\Z)")
#: Longer pre-tokens are encoded each time, not kept.
LONGEST = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def in_rank_order(path: str):
    """The rank encoder for a library file, or None where its merges aren't in the order of ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    vocab, letters = model["vocab"], byte_letters()
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The library's ids of texts, without added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = in_rank_order(path)

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        if self.ranks is not None and self.plain(text):
            try:
                return self.ranks.encode_ordinary(text)
            except Exception:  # a run that its pattern engine gives up on; the library takes it
                pass
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def id_bytes(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return np.asarray(self.ids(text), "<u4").tobytes()


class PreTokens:
    """Numbers of tokens by pre-tokens, from a table, else from the encoder; what that gave is kept, up to `room` of them."""

    def __init__(self, path: str, known: dict[str, int] | None = None, room: int = 400_000):
        self.encoder = Encoder(path)
        self.known, self.room = known or {}, room
        self.held = dict(self.known)
        self.sums: dict[str, int] = {}

    def told(self, text: str) -> bool:
        """Whether the pattern gives the text's pre-tokens; else only the library can tell them."""
        return self.encoder.ranks is not None and self.encoder.plain(text) and (text.isascii() or not DISPUTED.search(text))

    def encode(self, text: str) -> int:
        return len(self.encoder.ids(text))

    def lengths(self, text: str) -> int:
        """Tokens of all pre-tokens of a text."""
        total = 0
        for p in PATTERN.findall(text):
            v = self.held.get(p)
            if v is None:
                v = self.encode(p)
                if len(p) <= LONGEST:
                    if len(self.held) >= self.room:
                        self.held = dict(self.known)
                    self.held[p] = v
            total += v
        return total

    def count(self, text: str) -> int:
        if not self.told(text):
            return len(self.encoder.tokenizer.encode(text, add_special_tokens=False).ids)
        if TIED.search(text):
            return self.lengths(text)
        first, *rest = text.split(" ")  # what stands between spaces is cut into pre-tokens once, while it is remembered
        values = list(map(self.sums.get, rest))
        if None in values:
            for k, v in enumerate(values):
                if v is None:
                    p = rest[k]
                    v = self.sums.get(p)
                    if v is None:
                        v = self.lengths(" " + p)
                        if len(p) <= LONGEST:
                            if len(self.sums) >= self.room:
                                self.sums.clear()
                            self.sums[p] = v
                    values[k] = v
        return self.lengths(first) + sum(values)


def parts(text: str) -> list[str]:
    """The text in pieces whose pre-tokens are together the text's: cut before spaces, where that is safe."""
    if TIED.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *(" " + p for p in rest)]
