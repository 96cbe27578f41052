"""Token ids and counts from a cache of pre-tokens, equal to the tokenizers library's own."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Ranges where this module's pattern engine and the library's agree on classes, case and normal forms: Latin,
#: Greek (without the capital that has two small ones) and Cyrillic letters, kana, Han and Hangul, and punctuation;
#: no combining marks. A text with any other character goes to the library as a whole. Tests compare all of them.
_FURTHER = "Α-ΡΤ-Ωα-ωЀ-ҁҊ-ԯぁ-ゖァ-ヺー一-龥가-힣"
_PLAIN = re.compile(rf"[\x00-ſ‐-‧‰-⁞₠-₿、。〈-】！，：；？（）{_FURTHER}]*\Z")
#: Letters, numbers and white space of those ranges as the library's patterns class them.
_L, _N, _S = f"A-Za-zªµºÀ-ÖØ-öø-ſ{_FURTHER}", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_MOST = 600_000  # cached pre-tokens in a Python worker
_LONGEST = 200  # characters of a pre-token that is kept


class _Memo(dict):
    """Values by pre-token; starts anew when full, so a worker's memory is bounded."""

    def __init__(self, make, base=()):
        super().__init__(base)
        self.make, self.base = make, dict(base)

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= _LONGEST:
            if len(self) >= _MOST:
                self.clear()
                self.update(self.base)
            self[key] = value
        return value


@lru_cache(4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _classes(pattern: str) -> str:
    """A published split pattern with its properties spelled out for the ranges above."""
    for short, plain in ((r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]"), (r"[\p{L}]", f"[{_L}]"), (r"[\p{N}]", f"[{_N}]"), (r"\p{L}", f"[{_L}]"), (r"\p{N}", f"[{_N}]"), (r"\S", f"[^{_S}]"), (r"\s", f"[{_S}]")):
        pattern = pattern.replace(short, plain)
    return pattern


class WordCounter:
    """Tokens of a text under a lower-casing word BPE (NFC, white space folded, words with an end mark).

    Every vocabulary string that ends a word is encoded once alone; those that come back as one token
    are whole tokens, and a pre-token among them counts 1 without merging. Others are merged once each.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.find = re.compile(_classes(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = _library(path)
        self.model = self.library.model
        self.end = spec["model"]["end_of_word_suffix"]
        self.alphabet = byte_alphabet()
        whole = self.proved(spec["model"]["vocab"])
        self.cost = _Memo(self.merged, dict.fromkeys(whole, 1))
        self.whole = whole

    def proved(self, vocab: dict[str, int]) -> set[str]:
        """Strings that are one pre-token and encode alone as one token."""
        back = {c: b for b, c in byte_alphabet().items()}
        words = []
        for v in vocab:
            if v.endswith(self.end) and all(c in back for c in v[: -len(self.end)]):
                try:
                    words.append(bytes(back[c] for c in v[: -len(self.end)]).decode())
                except UnicodeDecodeError:
                    continue
        words = [w for w in words if w and self.find(w) == [w] and w == w.lower() and _PLAIN.match(w)]
        coded = self.library.encode_batch(words, add_special_tokens=False)
        return {w for w, e in zip(words, coded) if len(e.ids) == 1}

    def merged(self, word: str) -> int:
        return len(self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet)))

    def count(self, text: str) -> int:
        if not _PLAIN.match(text) or any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.cost.__getitem__, self.find(text.lower())))


class ByteCoder:
    """Ids of a text under a byte-level BPE as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.find = re.compile(_classes(BYTE_SPLIT)).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = _library(path)
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(map(back.__getitem__, v)): k for v, k in spec["model"]["vocab"].items() if v not in self.special}
        # ids of a byte-level vocabulary follow its merges' order, which is what ranks mean
        self.ordinary = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.packed = _Memo(self.merged)

    def merged(self, word: str) -> bytes:
        return array("I", self.ordinary(word)).tobytes()

    def ids(self, text: str) -> bytes:
        if not _PLAIN.match(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.packed.__getitem__, self.find(text)))


#: Fixed value: the published split pattern of byte-level BPE.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(4)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)


@lru_cache(4)
def byte_coder(path: str) -> ByteCoder:
    return ByteCoder(path)
