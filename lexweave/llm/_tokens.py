"""Token ids of texts by the public tokenizers' files, each distinct stretch of text encoded once in a worker.

Stretches are cut only where no token can reach across, so that the ids of a text are those of its
stretches one after the other, as ``tests/llm`` hold against the libraries' own answers for whole texts.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches that a worker remembers, by the columns of what it keeps of each, 100 to 300 bytes in all; beyond it, it starts anew.
REMEMBERED = {1: 500_000, 5: 150_000}
#: Stretches encoded at a time, as the libraries need much memory for each.
LEARNT = 20_000
#: Characters of a stretch that counts as long: few of these are remembered.
LONG = 64
#: Bytes of texts that are encoded at a time, in the same way; a longer text is encoded alone.
PIECE = {1: 8 << 20, 5: 2 << 20}

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters, single digits, and signs: each a word of its own where no apostrophe joins them.
_UNIT = re.compile(f"[{_LETTERS}]+|[0-9]|[^ \t\n\v\f\r{_LETTERS}0-9]+")
#: A character that may join what stands beside it, or change with it: all but white space, signs, digits and letters of Latin-1.
_ODD = re.compile(r"[^\x00-&(-\x7fÀ-ÖØ-öø-ÿ]")
#: What the byte-level BPE takes for words. A fixed value.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond ASCII and the letters of Latin-1.
_FOREIGN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
#: A space after what isn't white space.
_CUT = re.compile(r" (?<=\S )")
#: Texts with other spaces, or a character before one that may be white space.
_UNEVEN = r"^ |[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def kept(key: str, make: Callable):
    """``make()`` of the first call with ``key`` in this process, as workers serve many tasks."""
    held = sys.modules.setdefault("_lexweave_kept", types.ModuleType("_lexweave_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Memory:
    """Arrays by stretch of text. For stretches not met before, ``learn`` gives by column all their values, and how many each has."""

    def __init__(self, learn: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], columns: int):
        self.learn, self.columns = learn, columns
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat = [np.zeros(1024, np.int32) for _ in range(self.columns)]
        self.ends = [np.zeros(1024, np.int64) for _ in range(self.columns)]
        self.long = 0

    def _add(self, new: list[str]) -> None:
        first = len(self.places)
        last = first + len(new)
        for c, (values, sizes) in enumerate(self.learn(new)):
            begin = int(self.ends[c][first - 1]) if first else 0
            stop = begin + len(values)
            for own, need in ((self.flat, stop), (self.ends, last)):
                if need > len(own[c]):
                    own[c] = np.concatenate([own[c], np.zeros(max(need - len(own[c]), len(own[c])), own[c].dtype)])
            self.flat[c][begin:stop] = values
            self.ends[c][first:last] = begin + np.cumsum(sizes)
        self.places.update(zip(new, range(first, last), strict=True))
        self.long += sum(len(s) for s in new if len(s) > LONG)

    def arrays(self, stretches: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each column the arrays of the stretches one after the other, and their sizes."""
        if len(self.places) > REMEMBERED[self.columns] or self.long > 1 << 22:
            self.clear()
        coded = stretches.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.places.get, names))
        if None in known:
            new = [s for s, k in zip(names, known, strict=True) if k is None]
            for lo in range(0, len(new), LEARNT):
                self._add(new[lo : lo + LEARNT])
            known = list(map(self.places.get, names))
        at = np.array(known, np.int64)[coded.indices.to_numpy()]
        out = []
        for flat, ends in zip(self.flat, self.ends, strict=True):
            stop = ends[at]
            sizes = stop - np.where(at > 0, ends[at - 1], 0)
            total = np.cumsum(sizes)
            where = np.arange(int(sizes.sum())) + np.repeat(stop - total, sizes)
            out.append((flat[where], sizes))
        return out


def gathered(column: pa.Array, memory: Memory, split: Callable[[pa.Array], pa.Array]) -> Iterator[list[np.ndarray]]:
    """For each text of a column, null being empty, its arrays by column of ``memory``; ``split`` gives lists of stretches."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE[memory.columns], side="right")))
        lists = split(column.slice(lo, hi - lo))
        first = np.asarray(lists.offsets)
        by_column = []
        for values, sizes in memory.arrays(lists.flatten()):
            ends = np.concatenate([[0], np.cumsum(sizes)])[first - first[0]]
            by_column.append(np.split(values, ends[1:-1]))
        yield from (list(own) for own in zip(*by_column, strict=True))
        lo = hi


class WordIds:
    """Ids by the word-level BPE: lower case, white space dropped, each word's last token known by its ending."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.array([(self.whole.id_to_token(k) or "").endswith("</w>") for k in range(self.whole.get_vocab_size())])
        self.units, self.memory = Memory(self._learn_units, 1), Memory(self._learn, 1)

    def _learn(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [[s] if "<|" in s or _ODD.search(s) else _UNIT.findall(s.lower()) for s in stretches]
        count = np.array(list(map(len, parts)), np.int64)
        ((ids, sizes),) = self.units.arrays(pa.array(list(chain.from_iterable(parts)), pa.large_string()))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(count)]
        return [(ids, np.diff(ends, prepend=0))]

    def _learn_units(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        odd = [u for u in units if "<|" in u or _ODD.search(u)]
        own = dict(zip(odd, (e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)), strict=True)) if odd else {}
        plain = [u for u in units if u not in own] if own else units
        ids = np.array(self.words.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(ends) != len(plain):
            raise ValueError("a unit is not one word of the tokenizer")
        if not own:
            return [(ids, np.diff(ends, prepend=0))]
        words = iter(np.split(ids, ends[:-1]) if len(ends) else ())
        both = [np.array(own[u], np.int32) if u in own else next(words) for u in units]
        return [(np.concatenate(both), np.array(list(map(len, both)), np.int64))]

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Words between ASCII white space are encoded each by itself: the tokenizer drops it, and nothing reaches across."""
        return (ids for (ids,) in gathered(texts, self.memory, pc.ascii_split_whitespace))


class TokenPairs:
    """Ids and byte lengths of tokens by the byte-level BPE, for a space and the text, and by the pieces, which add it."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        shown = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or k >= 174]
        shown = dict(zip(map(chr, shown), shown, strict=True)) | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(shown[c] for c in token)
        special = set(self.a.get_added_tokens_decoder())
        #: The same vocabulary, whose ids are the ranks of its merges, in a library that takes less time for it.
        self.fast = tiktoken.Encoding("bytes", pat_str=_BYTE_WORDS, mergeable_ranks={x: k for k, x in enumerate(self.a_bytes) if k not in special}, special_tokens={})
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes], np.int32), np.array([len(x) for x in self.b_bytes], np.int32)
        pieces = (self.b.id_to_piece(k) for k in range(self.b.get_piece_size()))
        #: Whether no piece holds a space after anything else, so that none reaches across a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.memory = Memory(self._learn, 5)

    def _learn(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By stretch: ids and byte lengths of both, and one element if its bytes come out otherwise."""
        whole = [(" " + s).encode() for s in stretches]
        lengths = np.array([len(x) for x in whole], np.int64)
        # Stretches of characters on whose classes all libraries agree go in one go, as no token reaches from one to the next.
        plain = [bool(s) and not s[-1].isspace() and not _FOREIGN.search(s) for s in stretches]
        joined = [s for s, p in zip(stretches, plain, strict=True) if p]
        a = np.array(self.fast.encode_ordinary(" " + " ".join(joined)) if joined else [], np.int32)
        ends = np.searchsorted(np.cumsum(self.a_sizes[a]), np.cumsum(lengths[np.array(plain, bool)])) + 1
        na = np.diff(ends, prepend=0)
        if len(joined) < len(stretches):
            rest = iter([e.ids for e in self.a.encode_batch_fast([" " + s for s, p in zip(stretches, plain, strict=True) if not p], add_special_tokens=False)])
            own = iter(np.split(a, ends[:-1]) if len(ends) else ())
            both = [next(own) if p else np.array(next(rest), np.int32) for p in plain]
            a, na = np.concatenate(both), np.array(list(map(len, both)))
        found = [b or [self.space] for b in self.b.encode(stretches, num_threads=1)]
        b, nb = np.array(list(chain.from_iterable(found)), np.int32), np.array([len(x) for x in found])
        odd = np.zeros(len(stretches), np.int64)
        for ids, n, names, sizes in ((a, na, self.a_bytes, self.a_sizes), (b, nb, self.b_bytes, self.b_sizes)):
            if b"".join([names[k] for k in ids.tolist()]) != b"".join(whole) or (np.add.reduceat(sizes[ids], np.cumsum(n) - n) != lengths).any():
                cut = np.cumsum(n)
                odd |= [b"".join([names[k] for k in ids[stop - m : stop].tolist()]) != x for stop, m, x in zip(cut.tolist(), n.tolist(), whole, strict=True)]
        return [(a, na), (self.a_sizes[a], na), (b, nb), (self.b_sizes[b], nb), (np.zeros(int(odd.sum()), np.int32), odd)]

    def _split(self, texts: pa.Array) -> pa.Array:
        if not self.cuts:
            return pc.split_pattern(texts, "\0\0no text\0\0", max_splits=0)
        if not pc.any(pc.match_substring_regex(texts, _UNEVEN)).as_py():
            return pc.split_pattern(texts, " ")
        return pa.array([_CUT.split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids and byte ends of both, empty if the text is or if its bytes come out otherwise."""
        none = np.zeros(0, np.int32)
        for k, (a, la, b, lb, odd) in enumerate(gathered(texts, self.memory, self._split)):
            text = texts[k].as_py() if len(odd) else "."
            if len(odd) and any(b"".join([t[k] for k in ids]) != (" " + text).encode() for t, ids in ((self.a_bytes, a), (self.b_bytes, b))) or not texts[k].is_valid or not len(a):
                yield none, none, none, none
            elif len(a) == 1 and not texts[k].as_py():
                yield none, none, none, none
            else:
                yield a, np.cumsum(la, dtype=np.int32), b, np.cumsum(lb, dtype=np.int32)
