"""Token ids of a word-level BPE tokenizer file, computed once per distinct word.

The tokenizer composes characters (NFC), lower-cases, drops white space and splits
a text into pre-tokens, none of which spans white space, and BPE never looks
beyond a pre-token. So a text's ids are those of its lower-cased words one after
the other, and a word met before needs no BPE. New words of Latin letters, perhaps
with marks at the end, are pre-tokens already and go to the BPE model itself; other
new words are encoded together and told apart by offsets. A text with special
tokens, with characters on which notions of white space or lower case differ, or
not composed, is encoded whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, takewhile

import numpy as np
from tokenizers import Tokenizer

#: Words, and characters in them, kept at most per Python worker; beyond either the table starts anew.
MOST_WORDS, MOST_CHARS = 1_200_000, 16_000_000
#: Words, and characters in them, that a Python worker keeps when a task ends: the first met, so the frequent ones.
KEPT_WORDS, KEPT_CHARS = 100_000, 1_300_000
#: White space other than the four common ones, controls and format characters, capitals with contextual lower case.
_ODD = re.compile(
    "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\u0130\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
)
#: Letters that are a pre-token, and marks after them that are another.
_SIMPLE = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,;:!?#$%&*|)]*)")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: b if b in printable else next(others) for b in range(256)}


class WordIds:
    """Ids of texts by a tokenizer file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.known: dict[str, bytes] = {}
        self.chars = 0
        self.letters = _byte_letters()
        self.code = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bool:
        return not (_ODD.search(text) or self.special.search(text)) and unicodedata.is_normalized("NFC", text)

    def _learn(self, words: list[str]) -> None:
        known, code, tokenize, others = self.known, self.code, self.tokenizer.model.tokenize, []
        for word in words:
            simple = _SIMPLE.fullmatch(word)
            if not simple:
                others.append(word)
                continue
            ids = b""
            for part in simple.groups():
                if not part:
                    continue
                own = known.get(part)
                if own is None:
                    spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                    own = known[part] = b"".join([code[t.id] for t in tokenize(spelled)])
                ids += own
            known[word] = ids
            self.chars += len(word)
        if others:
            self._learn_together(others)

    def _learn_together(self, words: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(found))
        begins = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = (4 * np.searchsorted(starts, begins)).tolist()
        raw = np.array(found.ids, dtype="<u4").tobytes()
        for i, word in enumerate(words):
            self.known[word] = raw[cuts[i] : cuts[i + 1]]
        self.chars += int(begins[-1])

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Ids of each text; give a few dozen texts at a time."""
        known = self.known
        if len(known) > MOST_WORDS or self.chars > MOST_CHARS:
            known.clear()
            self.chars = 0
        split = [text.lower().split() if self._plain(text) else None for text in texts]
        new: set[str] = set()
        for words in split:
            if words:
                new.update(words)
        if missing := [w for w in new if w not in known]:
            self._learn(missing)
        for text, words in zip(texts, split, strict=True):
            yield self._whole(text) if words is None else b"".join(map(known.__getitem__, words))

    def trim(self) -> None:
        """Forget all words but the first; workers outlive the task, and each that is at hand may have had one."""
        if len(self.known) > KEPT_WORDS or self.chars > KEPT_CHARS:
            sums = accumulate(map(len, self.known))
            n = min(KEPT_WORDS, sum(1 for _ in takewhile(lambda x: x <= KEPT_CHARS, sums)))
            self.known = {word: self.known[word] for word, _ in zip(self.known, range(n), strict=False)}
            self.chars = sum(map(len, self.known))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The encoder of a file, kept with its words between the tasks of a Python worker."""
    return WordIds(path)
