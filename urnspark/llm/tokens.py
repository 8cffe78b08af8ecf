"""Token ids from the vocabulary files of public tokenizers, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 1
#: Words, and runs of words without a blank, that a worker remembers in each of two generations.
WORDS, RUNS = 200_000, 600_000

L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters are split here as the files' own patterns split them.
_plain = re.compile(rf"[\t\n\r -~¡-©«-±´¶-¸»¿×÷{L}]*")
#: The file's pattern, for such texts.
_split = {
    WORD_BPE: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[0-9]|[^\s0-9{L}]+"),
}
#: The printable stand-ins of bytes in byte-level vocabularies.
_same = [*range(33, 127), *range(161, 173), *range(174, 256)]
_stand_in = dict(zip([b for b in range(256) if b not in _same], range(256, 512)))

_encoders: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranked(path: str):
    """The same vocabulary in the file of its ranks, whose library merges new words faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Memory(dict):
    """What is made of a text that was met before; the older of two generations goes when the newer one is full.

    A key that is there is found without a call of Python's.
    """

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size = make, size
        self.old: dict[str, bytes] = {}

    def __missing__(self, k: str) -> bytes:
        if (v := self.old.get(k)) is None:
            v = self.make(k)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[k] = v
        return v

    def all(self, keys: list[str]) -> list[bytes]:
        return list(map(self.__getitem__, keys))


class Encoder:
    """Encodes whole texts; equal to the library's encoding of each, special tokens in the text included.

    Texts of plain Latin characters are split at blanks where the vocabulary drops them, and a run that was met before
    isn't encoded again; or, where the vocabulary has a file of ranks, are encoded from that. Other texts, and those with
    a special token's string, are left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        name = os.path.basename(path)
        self.tok = Tokenizer.from_file(path)
        self.split = _split.get(name)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.ranked = _ranked(ranks) if name == BYTE_BPE and os.path.exists(ranks) else None
        self.words = Memory(self._word, WORDS)
        self.runs = Memory(self._run, RUNS)

    def _word(self, word: str) -> bytes:
        y = word if word.isascii() else word.encode().decode("latin-1").translate(_stand_in)
        ids = array("I", [t.id for t in self.tok.model.tokenize(y)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _run(self, run: str) -> bytes:
        # A run of letters is one word, which isn't kept twice.
        return self._word(run) if run.isalpha() else b"".join(self.words.all(self.split.findall(run)))

    def __call__(self, text: str) -> np.ndarray:
        if (self.split is None and not self.ranked) or not _plain.fullmatch(text) or (self.special and self.special.search(text)):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if self.ranked:
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        runs = text.lower().split()
        # In parts, so that no text outgrows the memory.
        parts = [b"".join(self.runs.all(runs[a : a + 100_000])) for a in range(0, len(runs), 100_000)]
        return np.frombuffer(b"".join(parts), dtype="<u4")


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
