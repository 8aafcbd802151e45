"""Public vocabularies inside tasks, and the split of a text into chunks that tokenize independently.

Both byte-level splitting patterns used here never match across the start of a white-space run, so a text whose white
space consists of single spaces and single line ends is the concatenation of chunks (a word with the one white-space
character before it) that can be tokenized one by one and remembered. Any other text is split by the full pattern.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered chunks per Python worker; when full, the memory is emptied. Bounds memory only, never results.
MEMO = 150_000
#: White space other than the space and the line end, or two of these in a row.
_IRREGULAR = "[\\t\\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \\n][ \\n]"
#: Bytes of text that are split and gathered at a time.
SLICE = 4_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start:start + size]`` of all entries, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    return flat[np.arange(total, dtype=kind) + np.repeat((start - ends + size).astype(kind), size)]


class WordEncoder:
    """Ids of whole Arrow columns of texts, word by word: texts are split at their white space and dictionary-encoded by
    Arrow, each distinct word of a slice is encoded once (or remembered), and the ids are gathered by position.

    ``whole``: text to ids (little-endian 32-bit); ``words``: the same for a list of words with the space before each, or
    that begin with their line end. Texts with irregular white space, or with one of ``special``, go to ``whole``."""

    def __init__(self, whole: Callable[[str], bytes], words: Callable[[list[str]], list[bytes]], special: Sequence[str] = (), chunked: bool = True):
        self.whole, self.words, self.special, self.chunked = whole, words, special, chunked
        # words met lately, and those met before; when the first is full it takes the place of the second
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _odd(self, texts: pa.Array) -> np.ndarray:
        if not self.chunked:
            return np.ones(len(texts), bool)
        odd = pc.match_substring_regex(texts, _IRREGULAR)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        return odd.to_numpy(zero_copy_only=False)

    def _words(self, words: list[str]) -> list[bytes]:
        known, older = self.known, self.older
        out = list(map(known.get, words))
        missing = [k for k, got in enumerate(out) if got is None]
        again = list(map(older.get, [words[k] for k in missing]))
        new = [k for k, got in zip(missing, again) if got is None]
        for k, got in zip(new, self.words([words[k] for k in new]) if new else ()):
            out[k] = got
        for k, got in zip(missing, again):
            if got is not None:
                out[k] = got
        if len(known) + len(missing) > MEMO:
            self.older, self.known = known, {}
            known = self.known
        known.update((words[k], out[k]) for k in missing if len(words[k]) <= 64)
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd(texts)
        whole = [self.whole(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " \n"), " ")
        ends = parts.offsets.to_numpy()
        flat = parts.values
        first = ends[:-1]
        words = flat.dictionary_encode()
        firsts = flat.take(pa.array(first)).dictionary_encode()
        number = words.indices.to_numpy().copy()
        n = len(words.dictionary)
        number[first] = n + firsts.indices.to_numpy()
        number[first[odd]] = n + len(firsts.dictionary) + np.arange(len(whole))
        del parts, flat
        table = self._words(words.dictionary.to_pylist()) + [self.whole(t) for t in firsts.dictionary.to_pylist()] + whole
        del words, firsts
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        start = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(table), "<i4")
        del table
        each = size[number]
        return gathered(ids, start[number], each), np.r_[0, np.cumsum(each)][ends]

    def __call__(self, texts: pa.Array, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends of the texts' ids, from 0) of consecutive slices of about ``most`` bytes; a null text is empty."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            # a copy begins at offset 0
            yield self._slice(pa.concat_arrays([texts.slice(at, stop - at)]))
            at = stop


def together(batches: Iterator[pa.Array], most: int = SLICE) -> Iterator[pa.Array]:
    """Batches of about ``most`` bytes."""
    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def as_chunk(part: str) -> str:
    return part if part.startswith("\n") else " " + part
