"""Encoding and decoding with a unigram vocabulary of sentence pieces.

A text's best segmentation is the path of highest total log score over its
pieces.  No piece has a space marker after another character, so paths never
cross the start of a word and each distinct word of a slice is segmented once.
Words of like length go through the Viterbi recursion together: numpy walks the
double-array trie from one position of all of them at a time.  Characters that
no piece covers become one piece for each of their bytes.

Decoding puts the pieces' bytes on end, turns markers into spaces and drops the
one that encoding put in front.

Defined results
    null or empty text    no ids, and no ids give the empty text
    the marker itself in a text   is read as a space, and so decoded
    bytes that are no UTF-8 when decoded   the replacement character
    unknown, control or out-of-range ids   nothing when decoded
    very long words       segmented whole
    ties                  the piece that starts earlier
    repeated rows, null ids       row by row
    extra columns         carried through
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyloom.llm.words import ranges, slices

MARKER = "▁"
#: How far below the lowest ordinary score an uncovered character is; scores below the floor are no ordinary ones.
UNKNOWN_PENALTY, FLOOR = 10.0, -1e8
#: Distinct words whose ids a worker keeps; words, and cells of their matrix, that are segmented at once.
CACHED_WORDS, TOGETHER, CELLS = 100_000, 8_000, 400_000


class Trie:
    """A double array: the child of state s by byte c is base[s] + c if check has s there; ``piece`` is its id or -1."""

    def __init__(self, pieces: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for text, number in pieces:
            node = 0
            for c in text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][c]
            ids[node] = number
        size = 2 * len(children) + 1024
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        place = {0: 0}
        # where to look for room for so many children; only ever moves on, so that building takes linear time
        hint = [1] * 257
        for node, below in enumerate(children):  # children come after their parents
            if not below:
                continue
            codes = sorted(below)
            slot = hint[len(codes)]
            while taken[slot] or slot <= codes[0] or any(taken[slot - codes[0] + c] for c in codes):
                slot += 1
                if slot + 256 >= len(taken):
                    taken.extend(bytes(len(taken)))
            hint[len(codes)] = slot
            at = slot - codes[0]
            if at + 256 >= len(base):
                base, check, piece = (np.concatenate([x, np.full(len(taken) - len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (piece, -1)))
            base[place[node]] = at
            for c in codes:
                taken[at + c] = 1
                check[at + c] = place[node]
                piece[at + c] = ids[below[c]]
                place[below[c]] = at + c
        end = len(check)
        # walking off the end is walking to a state that nobody owns
        self.base, self.check, self.piece = base, np.append(check, np.full(256, -1, np.int32)), np.append(piece, np.full(256, -1, np.int32))
        self.base = np.append(self.base[:end], np.zeros(256, np.int32))


class Vocabulary:
    """The pieces of a model file, whichever way it was trained, with their log scores."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        ordinary = [i for i in numbers if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {i: model.id_to_piece(i) for i in ordinary}
        if any(MARKER in p.lstrip(MARKER) for p in pieces.values()):
            raise ValueError("a piece has a space marker after another character")
        self.scores = np.array([model.get_score(i) for i in numbers], np.float64)
        self.unknown = self.scores[[i for i in ordinary if self.scores[i] > FLOOR]].min() - UNKNOWN_PENALTY
        self.trie = Trie([(p.encode(), i) for i, p in pieces.items()])
        self.byte_ids = np.full(256, -1, np.int64)
        surface = [b""] * len(numbers)
        for i in numbers:
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], surface[i] = i, bytes([value])
            elif i in pieces:
                surface[i] = pieces[i].replace(MARKER, " ").encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.append(0, np.cumsum([len(s) for s in surface]))
        self.cache: dict[str, list[int]] = {}

    def segmented(self, words: list[str]) -> list[list[int]]:
        """Ids of each word on its own."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw])
        out: list[list[int]] = [[]] * len(words)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # words up to a quarter longer share a matrix of bounded size
            longest = max(8, sizes[order[at]] + sizes[order[at]] // 4)
            end = int(np.searchsorted(sizes[order], longest, "right"))
            end = min(end, at + max(1, min(TOGETHER, CELLS // max(1, int(longest)))))
            some = order[at:end]
            for i, ids in zip(some.tolist(), self._viterbi([raw[i] for i in some], sizes[some])):
                out[i] = ids
            at = end
        return out

    def _viterbi(self, raw: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        n, width = len(raw), int(sizes.max(initial=0))
        text = np.full((n, width + 1), 0xFF, np.int32)
        text[np.arange(width + 1)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        step, token = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, piece, scores = self.trie.base, self.trie.check, self.trie.piece, self.scores
        lead = text[:, :width]
        length = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        for i in range(width):
            rows = np.flatnonzero((i < sizes) & (best[:, i] > -np.inf))
            own = length[rows, i] if len(rows) else np.zeros(0, np.int64)
            single = np.zeros(n, bool)
            live, state, depth = rows, np.zeros(len(rows), np.int32), 0
            while len(live):
                target = base[state] + text[live, i + depth]
                hit = check[target] == state
                live, state, depth = live[hit], target[hit], depth + 1
                ids = piece[state]
                found = ids >= 0
                ending, ids = live[found], ids[found]
                score = best[ending, i] + scores[ids]
                better = score > best[ending, i + depth]
                ending, ids = ending[better], ids[better]
                best[ending, i + depth], step[ending, i + depth], token[ending, i + depth] = score[better], depth, ids
                whole = live[found]
                single[whole[length[whole, i] == depth]] = True
                inside = i + depth < sizes[live]
                live, state = live[inside], state[inside]
            bare = ~single[rows]
            rows, own = rows[bare], own[bare]
            score = best[rows, i] + self.unknown
            better = score > best[rows, i + own]
            rows, own = rows[better], own[better]
            best[rows, i + own], step[rows, i + own], token[rows, i + own] = score[better], own, -1
        # back along the best paths, all words at once
        at, trail, live = sizes.astype(np.int64).copy(), [], np.flatnonzero(sizes)
        while len(live):
            trail.append((live, token[live, at[live]], at[live], step[live, at[live]]))
            at[live] -= step[live, at[live]]
            live = live[at[live] > 0]
        out: list[list[int]] = [[] for _ in raw]
        for rows, ids, ends, steps in reversed(trail):
            if (ids >= 0).all():
                for r, i in zip(rows.tolist(), ids.tolist()):
                    out[r].append(i)
            else:
                for r, i, e, s in zip(rows.tolist(), ids.tolist(), ends.tolist(), steps.tolist()):
                    out[r].extend([i] if i >= 0 else self.byte_ids[list(raw[r][e - s : e])].tolist())
        return out

    def _ids_of(self, words: list[str]) -> list[list[int]]:
        found = [self.cache.get(w) for w in words]
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = [words[i] for i in missing]
        for i, w, ids in zip(missing, new, self.segmented(new)):
            found[i] = ids
            if len(self.cache) < CACHED_WORDS:
                self.cache[w] = ids
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """Lists of ids of a slice's texts."""
        texts = pc.fill_null(texts, "")
        # where spaces stand alone between words, each word with its space in front is segmented by itself
        odd = pc.match_substring_regex(texts, f"^ | $|  |{MARKER}").to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd | empty), "", texts)
        lists = pc.split_pattern(plain, " ")
        flat = lists.flatten().dictionary_encode()
        index, counts = flat.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)
        units = [MARKER + w for w in flat.dictionary.to_pylist()]
        heads = np.append(0, np.cumsum(counts))[:-1]
        strange = [_units(texts[int(i)].as_py()) for i in np.flatnonzero(odd)]
        more = list(dict.fromkeys(chain.from_iterable(strange)))
        names = {w: len(units) + k for k, w in enumerate(more)}
        none = len(units) + len(more)
        ids = [*self._ids_of(units), *self._ids_of(more), []]
        index[heads[empty | odd]] = none
        if strange:
            parts = np.split(index, heads[1:])
            for i, own in zip(np.flatnonzero(odd), strange):
                parts[i] = np.array([names[w] for w in own], np.int64)
            index, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        table = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        begins = np.append(0, np.cumsum(sizes))[:-1]
        values = table[ranges(begins[index], sizes[index])]
        ends = np.append(0, np.cumsum(sizes[index]))[np.append(0, np.cumsum(counts))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    def decode(self, lists: pa.Array) -> list[str]:
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        known = (ids >= 0) & (ids < len(self.surface_at) - 1)
        at = np.where(known, ids, 0)
        sizes = np.where(known, self.surface_at[at + 1] - self.surface_at[at], 0)
        data = self.surface[ranges(self.surface_at[at], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def _units(text: str) -> list[str]:
    """Words with the markers in front of them, and markers that end the text."""
    marked = (MARKER + text.replace(" ", MARKER)).split(MARKER)
    out, markers = [], ""
    for word in marked[1:]:
        markers += MARKER
        if word:
            out.append(markers + word)
            markers = ""
    return [*out, markers] if markers else out


def _encoded(vocabulary: Vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, _, _ in slices(batch.column("text")):
                part = batch.slice(at, end - at)
                yield pa.record_batch([*part.columns, vocabulary.encode(part.column("text"))], names=[*part.schema.names, "ids"])

    return encode


def _decoded(vocabulary: Vocabulary):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(vocabulary.decode(batch.column("ids")), pa.string())
            yield pa.record_batch([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return decode


def _both(vocabulary: Vocabulary):
    encode, decode = _encoded(vocabulary), _decoded(vocabulary)
    return lambda batches: decode(encode(batches))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the ``ids`` of ``text``."""
    return docs.mapInArrow(_encoded(Vocabulary(path)), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with the text that ``ids`` stand for as ``decoded``."""
    return rows.mapInArrow(_decoded(Vocabulary(path)), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` and the text ``decoded`` from them, by one worker for both ways."""
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return docs.mapInArrow(_both(Vocabulary(path)), T.StructType([*docs.schema.fields, *more]))
