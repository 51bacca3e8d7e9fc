"""Public tokenizers on executors, with what they said about recurring words kept for the worker's life."""

from __future__ import annotations

import json
import os

import numpy as np

#: Words remembered by a worker; when so many are known, it starts anew.
REMEMBERED = 600_000

_LOADED: dict[str, object] = {}


def loaded(version: str, content: str):
    """The tokenizer of a .json file's content, once a worker."""
    if version not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(content)
        made.no_truncation()
        made.no_padding()
        _LOADED[version] = made
    return _LOADED[version]


def forget(version: str) -> None:
    """The worker no longer keeps this tokenizer; who holds it still can use it."""
    _LOADED.pop(version, None)


def specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


# Steps that treat a word alike wherever it stands, and a pattern that matches no white space.
_LOCAL = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")
_SPACELESS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def drops_white_space(content: str) -> bool:
    """Whether a .json tokenizer surely drops white space and never joins what it separates, so that a text's tokens are
    those of its words: it cuts texts there first, and no step before that looks beyond a word."""
    made = json.loads(content)
    normal, cut = made.get("normalizer"), made.get("pre_tokenizer") or {}
    steps = normal["normalizers"] if normal and normal["type"] == "Sequence" else [normal] if normal else []
    one_blank = lambda x: x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "
    first = cut["pretokenizers"][0] if cut.get("type") == "Sequence" and cut["pretokenizers"] else cut
    removed = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in _SPACELESS
    added = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in made.get("added_tokens", []))
    return added and all(x["type"] in _LOCAL or one_blank(x) for x in steps) and (removed or first.get("type") in ("Whitespace", "WhitespaceSplit")) and not made.get("post_processor")


class WordCounts(dict):
    """Token counts of whole texts for tokenizers that drop white space: the sum over their words, each encoded once."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def of(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self))
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(set().union(*split))
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)
        self.update(zip(new, map(len, encoded)))
        return [sum(map(self.__getitem__, words)) for words in split]


# Fixed value: the pattern by which byte-level tokenizers cut texts into units.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as the character of the same code point where it can be seen, else, in
    order, as those from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteIds:
    """Ids of byte-level BPE as little-endian 32-bit bytes.

    Where merges are ranked as their ids, a rank-based encoder built from the same file gives the same ids, several times
    as fast. It is used for texts of Latin-1 characters without special tokens, where both libraries' character classes
    are the same; other texts and other tokenizers go through the tokenizer itself.
    """

    def __init__(self, tokenizer, content: str):
        self.tokenizer = tokenizer
        self.specials = specials(tokenizer)
        self.fast = self._ranked(json.loads(content))

    def _ranked(self, made: dict):
        unit = made.get("pre_tokenizer") or {}
        plain = made["model"]["type"] == "BPE" and not made.get("normalizer") and not any(made["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or unit.get("type") != "ByteLevel" or unit.get("add_prefix_space") or not unit.get("use_regex", True):
            return None
        vocab, merges = made["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        byte_of, own = _byte_of(), {t["content"] for t in made.get("added_tokens", [])}
        if ids != sorted(ids) or ids and ids[0] < 256:
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in own}
        return tiktoken.Encoding("own", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.specials):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
