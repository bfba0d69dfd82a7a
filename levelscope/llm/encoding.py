"""Ids of whole texts by the tokenizers library, each distinct word encoded once.

Both vocabularies in use split at every single space between two visible characters, and
before every single line feed between two, and carry nothing across. So a text's ids are its
pieces' ids in turn; ``tests/llm`` holds this against encoding the text at once. Arrow cuts
and numbers the pieces of some millions of characters at a time; only pieces that the worker
doesn't know go to the library, many in one string, and numpy lays the ids out. Where a piece
ends among the ids of such a string is told by how many bytes each id stands for; pieces whose
bytes the vocabulary's normalizer may change have a separator after them instead. Texts with
other runs of white space are cut around those.

Special tokens: as the vocabularies' own description has it, their strings in a text are
ordinary text. With ``special=True`` they are the special tokens, as is the library's
default; texts that hold one are then encoded at once.

Nulls: a null text is empty and has no ids. What a worker keeps is bounded in bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of known pieces and their ids that a worker keeps within a task, and from one task to the next.
CACHED_BYTES, RESTING_BYTES = 48_000_000, 6_000_000
#: Characters of texts that are cut up at once; a longer text is a slice of its own.
SLICE_CHARS = 1_500_000
#: Pieces that go to the library in one string, and such strings at once.
TOGETHER, STRINGS = 50, 200
#: The bytes that the characters of a byte-level token stand for: those that print are themselves.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {*map(chr, _PRINTED), *map(chr, range(0x100, 0x200 - len(_PRINTED)))}
#: Bytes that a known piece takes besides its characters and ids.
_OVERHEAD = 150
#: A word that stands for the end of a piece; pieces that hold it are encoded alone.
_SEPARATOR = "0"
_BAD = -2

#: Pieces whose ids stand for as many bytes as they have, whatever the vocabulary's normalizer: no white space
#: but a line feed before, and no letter that NFC or lowering may make longer, shorter or part of another.
_STEADY = r"^\n?[\x21-\x7E\x{A1}-\x{12F}\x{131}-\x{17F}\x{2010}-\x{2027}]+$"

_cuts = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[pa.Array]:
    """Runs of texts of at most ``most`` characters in all, or one longer text."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield texts.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < len(texts):
        yield texts.slice(at)


def _inner(piece: str) -> bool:
    """Whether a piece may stand inside a text: cut on both sides, no white space at its ends."""
    if not piece or piece[-1].isspace():
        return False
    return not piece[0].isspace() or piece[0] == "\n" and not piece[1].isspace()


def _in_place(piece: str) -> str:
    return piece if piece[0] == "\n" else " " + piece


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with those starts and lengths, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    shift += np.arange(total)
    return flat[shift]


class WordwiseEncoder:
    """A worker's encoder for one vocabulary file."""

    def __init__(self, path: str, most_bytes: int = CACHED_BYTES, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.most_bytes = most_bytes
        one = self._ids([" " + _SEPARATOR, f" {_SEPARATOR} {_SEPARATOR}"])
        alone = len(one[0]) == 1 and one[1].tolist() == one[0].tolist() * 2
        self.separator = int(one[0][0]) if alone else None
        self.sizes = self._token_bytes()
        self.spaces = int(self.sizes[one[0]].sum()) == 2  # whether ids stand for a piece's white space too
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.uint32), 0
        self.seen = np.zeros(1024, np.int32)  # slices that held the piece

    def _thin(self, most: int) -> None:
        """Forget the pieces that came up least until ``most`` bytes are left.

        What stays is copied, so that it lies together and the memory round it is free.
        """
        n = len(self.known)
        cost, seen, least = 4 * self.lengths[:n].astype(np.int64) + _OVERHEAD, self.seen[:n], 2
        while int(cost[seen >= least].sum()) > most:
            least *= 2
        keep = seen >= least
        known = [p.encode("utf-8", "surrogatepass").decode("utf-8", "surrogatepass") for p, k in zip(self.known, keep.tolist(), strict=True) if k]
        starts, lengths, flat = self.starts[:n][keep], self.lengths[:n][keep], self.flat
        self._forget()
        self._add(known, _gather(flat, starts, lengths.astype(np.int64)), lengths)

    def rest(self, most: int = RESTING_BYTES) -> None:
        """Give back what the next task need not find: what is known beyond ``most`` bytes, and Arrow's free memory."""
        if self.held > most:
            self._thin(most)
        pa.default_memory_pool().release_unused()

    def _add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        end = first + len(pieces)
        while end > len(self.starts):
            self.starts, self.lengths, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[first:end] = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.lengths[first:end] = lengths
        self.seen[first:end] = 1
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(pieces, range(first, end), strict=True))
        self.held += 4 * len(ids) + _OVERHEAD * len(pieces) + sum(map(len, pieces))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _token_bytes(self) -> np.ndarray:
        """How many bytes of text each id stands for; a number that no text has where that isn't known."""
        model, ids = self.tokenizer.model, self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(model, "end_of_word_suffix", None) or ""
        sizes = np.full(max(ids.values(), default=0) + 1024, 1 << 40, np.int64)
        for token, k in ids.items():
            body = token[: len(token) - len(suffix)] if suffix and token.endswith(suffix) else token
            if _BYTE_CHARS.issuperset(body):
                sizes[k] = len(body)
        return sizes

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces (each as it stands in a text), and how many each has."""
        return self._pieces_of(pieces, pc.match_substring_regex(pa.array(pieces, pa.large_string()), _STEADY).to_numpy(zero_copy_only=False))

    def _pieces_of(self, pieces: list[str], steady: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steady = steady.copy()
        places = np.flatnonzero(steady)
        own, lengths, missed = self._by_bytes([pieces[k] for k in places.tolist()])
        steady[places[missed]] = False
        if steady.all():
            return own, lengths
        rest, more = self._by_separator([pieces[k] for k in np.flatnonzero(~steady).tolist()])
        every = np.empty(len(pieces), np.int32)
        every[steady], every[~steady] = lengths, more
        starts = np.empty(len(pieces), np.int64)
        starts[steady], starts[~steady] = np.cumsum(lengths, dtype=np.int64) - lengths, len(own) + np.cumsum(more, dtype=np.int64) - more
        return _gather(np.concatenate([own, rest]), starts, every.astype(np.int64)), every

    def _by_bytes(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of steady pieces in a row, how many each has, and the numbers of those that were left out.

        Pieces count if an id ends where each of them ends; else all that went together are left out.
        """
        found, lengths, missed = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), TOGETHER * STRINGS):
            part = pieces[at : at + TOGETHER * STRINGS]
            groups = [part[k : k + TOGETHER] for k in range(0, len(part), TOGETHER)]
            ids = self._ids([(" " + " ".join(g)).replace(" \n", "\n") for g in groups])
            data = pa.array(part, pa.large_string())
            sizes = pc.binary_length(data).to_numpy() - pc.starts_with(data, "\n").to_numpy(zero_copy_only=False) + self.spaces
            first = np.arange(0, len(part), TOGETHER)
            ends = np.cumsum(np.concatenate([self.sizes[np.minimum(x, len(self.sizes) - 1)] for x in ids]))
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            due = np.cumsum(sizes)
            if ends[-1:].tolist() == due[-1:].tolist():
                place = np.minimum(np.searchsorted(ends, due), len(ends) - 1)
                right = ends[place] == due
                right[first[1:] - 1] &= place[first[1:] - 1] + 1 == np.cumsum(counts)[:-1]
            else:
                place, right = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
            if not right.all():
                missed.append(at + np.arange(len(part)))
                continue
            found.append(np.concatenate(ids))
            lengths.append(np.diff(place, prepend=-1).astype(np.int32))
        return np.concatenate(found), np.concatenate(lengths), np.concatenate(missed)

    def _by_separator(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups: list[list[int]] = [[]]
        for k, piece in enumerate(pieces):
            if self.separator is None or _SEPARATOR in piece:
                groups.insert(0, [k])
            elif len(groups[-1]) < TOGETHER:
                groups[-1].append(k)
            else:
                groups.append([k])
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        for at in range(0, len(groups), STRINGS):
            part = [g for g in groups[at : at + STRINGS] if g]
            end = " " + _SEPARATOR
            ids = self._ids([_in_place(pieces[g[0]]) if len(g) == 1 else "".join(_in_place(pieces[k]) + end for k in g) for g in part])
            for g, own in zip(part, ids, strict=True):
                if len(g) == 1:
                    found[g[0]] = own
                    continue
                ends = np.flatnonzero(own == self.separator)
                if len(ends) == len(g):
                    for k, a, b in zip(g, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                        found[k] = own[a:b]
                else:  # a piece spells the separator in another way
                    for k, x in zip(g, self._ids([_in_place(pieces[k]) for k in g]), strict=True):
                        found[k] = x
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), lengths

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Each distinct piece's number among the known ones; what isn't known is learnt.

        Pieces that may not stand inside a text get a number below zero.
        """
        known = self.known
        numbers = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.seen[numbers[numbers >= 0]] += 1
        places = np.flatnonzero(numbers < 0)
        numbers[places] = _BAD
        new = [pieces[k] for k in places.tolist()]
        steady = pc.match_substring_regex(pa.array(new, pa.large_string()), _STEADY).to_numpy(zero_copy_only=False)
        inner = steady.copy()
        for k in np.flatnonzero(~steady).tolist():
            inner[k] = _inner(new[k])
        if inner.any():
            places, steady, new = places[inner], steady[inner], [p for p, k in zip(new, inner.tolist(), strict=True) if k]
            numbers[places] = np.arange(len(known), len(known) + len(new))
            self._add(new, *self._pieces_of(new, steady))
        return numbers

    def _around_white_space(self, text: str) -> np.ndarray:
        """Ids of a text with runs of white space that are neither one space nor one line feed."""
        if self.special and any(s in text for s in self.special):
            return self._ids([text])[0]
        head, *pieces = _cuts.split(text)
        last = pieces.pop() if pieces else None
        out = self._ids([head] if last is None else [head, _in_place(last)])
        if pieces:
            distinct = list(dict.fromkeys(pieces))
            at = dict(zip(distinct, self._numbers(distinct).tolist(), strict=True))
            numbers = np.fromiter((at[p] for p in pieces), np.int64, len(pieces))
            out.insert(1, _gather(self.flat, self.starts[numbers], self.lengths[numbers]))
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts in a row, and the place where each text's begin and end."""
        if self.held > self.most_bytes:
            self._thin(self.most_bytes // 2)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        begins = np.asarray(cut.offsets, np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # ten times as fast as to_pylist
        numbers = self._numbers(words)
        heads = index[begins[:-1]]
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = np.add.reduceat((numbers[index] < 0).astype(np.int64), begins[:-1]) > 0
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd &= ~empty
        starts, lengths, flat = self.starts[numbers], self.lengths[numbers].astype(np.int64), self.flat[: self.used]
        lengths[numbers < 0] = 0
        starts, lengths = starts[index], lengths[index]
        # a text's first word has no space before it; what is odd stands whole in its first word's place
        first, which = np.unique(heads[~odd], return_inverse=True)
        own = self._ids([words[k] for k in first.tolist()])
        if odd.any():
            lengths[np.repeat(odd, np.diff(begins))] = 0
            own += [self._around_white_space(x) for x in texts.filter(pa.array(odd)).to_pylist()]
            flat = self.flat[: self.used]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        places = len(flat) + np.cumsum(sizes) - sizes
        at = np.empty(len(texts), np.int64)
        at[~odd] = which
        at[odd] = np.arange(len(first), len(own))
        starts[begins[:-1]], lengths[begins[:-1]] = places[at], sizes[at]
        ids = _gather(np.concatenate([flat, *own]), starts, lengths)
        return ids, np.concatenate([[0], np.cumsum(np.add.reduceat(lengths, begins[:-1]))])

    def many(self, texts) -> list[bytes]:
        """Little-endian uint32 ids of each text, as bytes; of a null, none."""
        out = []
        for part in slices(pa.array(texts, pa.large_string(), from_pandas=True)):
            ids, ends = self.encode(part)
            data = ids.astype("<u4").tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out


_encoders: dict[tuple[str, int], WordwiseEncoder] = {}


def encoder(path: str, most_bytes: int = CACHED_BYTES) -> WordwiseEncoder:
    """The worker's encoder for a vocabulary file; kept while the worker lives."""
    if (path, most_bytes) not in _encoders:
        _encoders[path, most_bytes] = WordwiseEncoder(path, most_bytes)
    return _encoders[path, most_bytes]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
