"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library.

Texts repeat their words, and neither the normaliser nor the pre-tokeniser of the BPE files
here looks beyond the words of a plain text, so ids are looked up word by word in a bounded
cache of the Python worker and only unseen words go to the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Plain texts are split here as the tokenizer file's own pattern splits them; of others, words go to the library.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\r\na-zß-öø-ÿ0-9]+")
#: The normaliser and pre-tokeniser for which the above holds, as the library writes them.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENISER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Texts of these characters, as Arrow's pattern.
WORD_PLAIN = "^[ \\t\\r\\n!-~À-ÖØ-öø-ÿ]*$"
WORD_ODD = "<\\|"


def byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible bytes for themselves, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in visible else next(others) for b in range(256)}


class CachedWords:
    """Ids of texts by looking their words up: what stands between two spaces, whose ids don't depend on the rest.

    Arrow finds the distinct words of many texts; each is looked up once in a bounded cache of
    the Python worker, and only unseen ones go to the library's BPE model, piece by piece
    (``pieces_of``). The cache is emptied when it holds more than ``words``.
    """

    #: Put before a text, so that its first word is told from others.
    first = ""

    def __init__(self, path: str, words: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.kind = (file["normalizer"], file["pre_tokenizer"], file["model"]["type"])  # vocabulary and merges are the library's to hold
        self.model, self.letters, self.limit = self.tokenizer.model, byte_letters(), words
        self._forget()

    def pieces_of(self, word: str) -> list[str]:
        raise NotImplementedError

    def _forget(self) -> None:
        """Empties the cache: word to number, and each number's ids in one array."""
        self.known: dict[str, int] = {}
        self.flat, self.begins = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        tokenize, letters, ids, ends = self.model.tokenize, self.letters, [], []
        for word in new:
            for piece in self.pieces_of(word):
                ids += [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]
            ends.append(len(ids))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.array(ends, np.int64)])
        self.flat = np.concatenate([self.flat, np.array(ids, "<u4")])

    def look_up(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of an Arrow array of large strings without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.first:
            texts = pc.binary_join_element_wise(pa.scalar(self.first, pa.large_string()), texts, pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(texts, " ")
        coded = cut.values.dictionary_encode()
        asked = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.limit:
            self._forget()
        known = self.known
        if new := [w for w in asked if w not in known]:
            self._learn(new)
        number = np.fromiter(map(known.__getitem__, asked), np.int64, len(asked))[coded.indices.to_numpy(zero_copy_only=False)]
        begins = self.begins[number]
        each = self.begins[number + 1] - begins
        ends = np.cumsum(each)
        at = np.repeat(begins - (ends - each), each)
        at += np.arange(len(at))
        return self.flat[at], np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]


class WordCachedTokenizer(CachedWords):
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The cache serves tokenizer files that normalise and split as above
    (``word_bpe_49k.json``); with any other file whole texts go to the library. Texts with
    other characters go there word by word, through a cache of their own.
    """

    def __init__(self, path: str, pieces: int = 500_000, words: int = 100_000):
        super().__init__(path, pieces)
        self.by_piece = self.kind == (NORMALISER, PRE_TOKENISER, "BPE")
        self.word_limit = words
        self.words: dict[str, bytes] = {"": b""}

    def pieces_of(self, word: str) -> list[str]:
        word = word.lower()
        return [word] if word.isascii() and word.isalpha() else PIECE.findall(word)

    def _by_words(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(self.words) > self.word_limit:
            self.words = {"": b""}
        for w in set(words) - self.words.keys():
            self.words[w] = self._library(w).tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_piece:
            return [self._library(t or "").tobytes() for t in texts]
        array = pc.fill_null(pa.array(texts, pa.large_string()), "")
        plain = pc.and_not(pc.match_substring_regex(array, WORD_PLAIN), pc.match_substring_regex(array, WORD_ODD))
        found = iter(())
        if pc.any(plain).as_py():
            ids, offsets = self.look_up(array.filter(plain))
            raw, ends = ids.tobytes(), (offsets * 4).tolist()
            found = (raw[a:b] for a, b in zip(ends, ends[1:]))
        return [next(found) if is_plain else self._by_words(t) for t, is_plain in zip(texts, plain.to_pylist())]


@lru_cache(maxsize=2)
def cached_tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer a Python worker."""
    return WordCachedTokenizer(path)


#: Texts of these characters, with single spaces between words, are split at the spaces; others go to the library whole.
BYTE_PLAIN = "^[\\t\\n\\r -~À-ÖØ-öø-ÿ]*$"
BYTE_ODD = "  | [\\t\\n\\r]| $|<\\|"
#: The file's own pre-tokeniser, and its pattern for the characters above.
BYTE_PRE_TOKENISER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BYTE_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t\n\rA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


class ByteCachedTokenizer(CachedWords):
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``, for byte-level BPE files.

    A space before a visible character always begins a piece and no piece depends on what
    stands beyond its ends, so plain texts are cut at their spaces. With files that
    normalise or split in another way, and for other texts, whole texts go to the library.
    """

    first = "\0"

    def __init__(self, path: str, words: int = 1_000_000):
        super().__init__(path, words)
        self.by_word = self.kind == (None, BYTE_PRE_TOKENISER, "BPE")

    def pieces_of(self, word: str) -> list[str]:
        if word.isascii() and word.isalpha():
            return [f" {word}"]
        return BYTE_PIECE.findall(word[1:] if word.startswith(self.first) else f" {word}")

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of an Arrow array of texts: those of text i are ``ids[offsets[i] : offsets[i + 1]]``; null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.and_not(pc.match_substring_regex(texts, BYTE_PLAIN), pc.match_substring_regex(texts, BYTE_ODD)).to_numpy(zero_copy_only=False).astype(bool)
        plain &= self.by_word
        if plain.all() and len(texts):
            return self.look_up(texts)
        ids, offsets = self.look_up(texts.filter(pa.array(plain))) if plain.any() else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        place, parts = 0, []
        for text, is_plain in zip(texts.to_pylist(), plain.tolist()):
            parts.append(ids[offsets[place] : offsets[place + 1]] if is_plain else self._library(text))
            place += is_plain
        return np.concatenate(parts or [ids]), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


@lru_cache(maxsize=2)
def cached_byte_tokenizer(path: str) -> ByteCachedTokenizer:
    """One tokenizer a Python worker."""
    return ByteCachedTokenizer(path)


def by_size(texts: list, limit: int = 8_000_000):
    """Slices of ``texts`` with about ``limit`` characters each."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= limit:
            yield slice(at, i + 1)
            at, n = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
