"""Token ids of whole texts, word by word.

The vocabulary's pre-tokenizer never joins characters across ASCII white space and its
normalizer works inside such words, so a text's ids are the ids of its words in order.
Words repeat, so each worker remembers the ids of words it has met. Words of plain
letters go straight to the merge model; all others pass through the whole tokenizer.
``tests/llm`` compares the result with the tokenizer run over whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

# Words remembered by a worker; beyond that it starts anew (bounded memory, same result).
REMEMBERED = 400_000

# Letters up to U+024F: in normal form already, and lower-cased one by one except U+0130.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:;=?@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes in byte-level vocabularies, by rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """word (UTF-8 bytes without white space) -> its ids as little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain:
            letters = plain[1].lower().encode().decode("latin-1").translate(self.letters)
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.merge(letters))
            if plain[2]:
                ids += self[plain[2].encode()]  # a run of marks: never plain itself
        else:
            ids = self._whole(text)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def ids(self, text: bytes | None) -> bytes:
        """All ids of a whole text, as bytes."""
        return b"".join(map(self.__getitem__, text.split())) if text else b""


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The worker's own copy for this vocabulary file."""
    return WordIds(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
