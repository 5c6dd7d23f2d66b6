"""Byte-level BPE ids of Arrow text batches, one encoding per distinct word of a slice.

The vocabulary's pattern never joins characters across a single space between
two words, so a text is cut there, distinct words are encoded once, and the ids
of a text are its words' ids on end.  Texts with other runs of white space
around a space, or with the text of a special token, are encoded whole by the
tokenizer file itself; tests hold both ways against each other.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skyloom.llm.words import ranges

#: Distinct words whose ids a worker keeps.
CACHED_WORDS = 60_000

_WHITE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A space between white space and white space or the end: where cutting could change ids.
_UNSAFE = rf"[{_WHITE}] (?:[{_WHITE}]|$)"

_ENCODERS: dict[str, "Encoder"] = {}


def special_tokens(path: str) -> tuple[str, ...]:
    """The texts of a tokenizer file's special tokens, for the driver to hand to its tasks."""
    from tokenizers import Tokenizer

    return tuple(t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values())


def encoder(path: str, special: tuple[str, ...]) -> Encoder:
    """The worker's encoder of a tokenizer file; its rank file lies beside it under the same stem."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, special)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str, special: tuple[str, ...]) -> None:
        import public_tokenizers
        import tiktoken

        self.path, self.special, self._whole = path, special, None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, list[int]] = {}

    @property
    def whole(self):
        """The tokenizer file itself, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _ids_of(self, words: list[str]) -> list[list[int]]:
        encode, cache = self.words.encode_ordinary, self.cache
        out = [cache.get(w) for w in words]
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = ids = encode(words[i])
                if len(cache) < CACHED_WORDS:
                    cache[words[i]] = ids
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, _Ids]:
        """Lengths of the texts' ids, and the ids themselves on demand; null is empty, ``end`` closes each text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        strange = np.flatnonzero(odd)
        rest = [self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in strange]
        if len(strange):
            texts = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        index = flat.indices.to_numpy().astype(np.int64)
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        heads = np.append(0, np.cumsum(counts))[:-1]
        names = flat.dictionary.to_pylist()
        firsts = [names[i] for i in index[heads].tolist()]
        ids = self._ids_of([" " + w for w in names]) + self._ids_of(firsts)
        index[heads] = len(names) + np.arange(len(heads))
        for i, own in zip(strange, rest):
            ids[len(names) + i] = own
        ids.append([] if end is None else [end])
        index = np.insert(index, np.append(heads[1:], len(index)), len(ids) - 1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        words = np.append(0, np.cumsum(counts + 1))
        ends = np.append(0, np.cumsum(sizes[index]))
        return np.diff(ends[words]), _Ids(ids, sizes, index)


class _Ids:
    def __init__(self, ids: list[list[int]], sizes: np.ndarray, index: np.ndarray) -> None:
        self._parts = ids, sizes, index

    def flat(self) -> np.ndarray:
        ids, sizes, index = self._parts
        table = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        at = np.append(0, np.cumsum(sizes))[:-1]
        return table[ranges(at[index], sizes[index])]
