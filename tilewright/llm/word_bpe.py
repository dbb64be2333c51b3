"""Token ids of the public word-end BPE file by the tokenizers library, each word once.

The file's pre-tokenizer drops white space and never joins characters across it, its
normaliser (NFC, lower case by character, white space runs to a space) never reaches
across it either, and its special tokens hold none. So the ids of a text are those of
its white-space separated chunks, put one after another. A chunk of lower-case letters
that ends in marks is in turn its letters, then its marks (where all are below U+0240:
none of these composes, or has a lower case that depends on its place; U+0130, whose lower
case is two characters, is left out).

A batch of texts is cut into chunks, these into different ones, and these into different
words, column by column; ids of words come from a bounded table or from the library, and ids
of chunks and texts are gathered from them.

``Encoder.checked`` proves these conditions on the file; a file that does not meet them
is encoded text by text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and other chunks, kept between batches by one Python worker: those met lately, and as many that were
#: met before them. What is dropped costs time when it is met again, never a result.
KEPT = 500_000
#: Longer ones aren't kept.
LONG = 40
#: Marks that may end a chunk of letters; a run of them is one piece to the file's pattern.
MARKS = ".,;:!?|#$%&*)"
#: White space to Python's split but not to the file's pattern.
_ODD = "[\x1c-\x1f]"
#: What compositions and lower case aren't proven for.
_BEYOND = r"[^\x00-\x{23F}]|\x{130}"


class _Table:
    """A bounded table of ids, as bytes: what is met moves to the young half, and a full young half becomes the old one."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        out = list(map(self.young.get, keys))
        if self.old:
            for i, x in enumerate(out):
                if x is None and (x := self.old.get(keys[i])) is not None:
                    out[i] = self.young[keys[i]] = x
        return out

    def keep(self, keys: list[str], ids: list[bytes]) -> None:
        self.young.update((k, x) for k, x in zip(keys, ids, strict=True) if len(k) <= LONG)
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young


def _gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the runs that begin at ``begin`` and have ``size`` places, one run after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - before, size)


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes; the same as the library's, text by text."""

    def __init__(self, definition: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_chunk = self.checked(json.loads(definition))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.words, self.others = _Table(), _Table()

    @staticmethod
    def checked(definition: dict) -> bool:
        """Whether ids of a text are those of its white-space separated chunks in order."""
        kind = lambda part, k: [part.get("type")] + [x.get("type") for x in part.get(k, [])]
        normal = definition.get("normalizer") or {}
        split = definition.get("pre_tokenizer") or {}
        first = (split.get("pretokenizers") or [{}])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        return (
            kind(normal, "normalizers") == ["Sequence", "NFC", "Replace", "Lowercase"]
            and kind(split, "pretokenizers") == ["Sequence", "Split", "ByteLevel"]
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and definition["model"].get("end_of_word_suffix") == "</w>"
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in definition.get("added_tokens", []))
        )

    def whole(self, text: str) -> bytes:
        """The library's own ids of one text."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _bulk(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many to a call; each ends with the one token that ends a word."""
        out: list[bytes] = []
        for a in range(0, len(words), 200):
            some = words[a : a + 200]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                begins, raw = [0, *stops.tolist()], ids.tobytes()
                out += [raw[4 * i : 4 * j] for i, j in zip(begins, begins[1:], strict=False)]
            else:  # letters that this library's tables don't take for letters
                out += map(self.whole, some)
        return out

    def _known(self, table: _Table, keys: list[str], make) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys, one after another, and how many each has."""
        found = table.find(keys)
        fresh = [i for i, x in enumerate(found) if x is None]
        if fresh:
            new = [keys[i] for i in fresh]
            made = make(new)
            for i, x in zip(fresh, made, strict=True):
                found[i] = x
            table.keep(new, made)
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2

    def _others(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, one after another, and how many each has."""
        low = pc.utf8_lower(chunks)
        word = pc.utf8_rtrim(low, characters=MARKS)
        n_mark = _sizes(low) - _sizes(word)
        simple = pc.and_(pc.utf8_is_alpha(word), pc.invert(pc.match_substring_regex(chunks, _BEYOND)))
        is_simple = simple.to_numpy(zero_copy_only=False)
        # three runs of ids: of words, of marks, of other chunks; each chunk is one of the first and one of the second, or one of the third
        coded = pc.dictionary_encode(word.filter(simple))
        words, n_words = self._known(self.words, coded.dictionary.to_pylist(), self._bulk)
        marked = is_simple & (n_mark > 0)
        one, more = pc.utf8_slice_codeunits(low.filter(pa.array(marked & (n_mark == 1))), -1), marked & (n_mark > 1)
        tails = np.empty(len(chunks), object)
        tails[marked & (n_mark == 1)] = one.to_numpy(zero_copy_only=False)
        tails[more] = [x[-n:] for x, n in zip(low.filter(pa.array(more)).to_pylist(), n_mark[more].tolist(), strict=True)]
        tails = pc.dictionary_encode(pa.array(tails[marked], pa.string()))
        marks, n_marks = self._known(self.others, tails.dictionary.to_pylist(), self._others)
        others, n_others = self._known(self.others, chunks.filter(pa.array(~is_simple)).to_pylist(), self._others)
        begin, size = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        for where, column, at, sizes, base in (
            (is_simple, 0, coded.indices.to_numpy(), n_words, 0),
            (marked, 1, tails.indices.to_numpy(), n_marks, len(words)),
            (~is_simple, 0, np.arange(len(n_others)), n_others, len(words) + len(marks)),
        ):
            begin[where, column] = (np.cumsum(sizes) - sizes)[at] + base
            size[where, column] = sizes[at]
        return np.concatenate([words, marks, others])[_gathered(begin.reshape(-1), size.reshape(-1))], size.sum(1)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = np.ones(len(texts), bool) if not self.by_chunk else pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(texts if not odd.any() else pc.if_else(pa.array(odd), "", texts))
        chunks = lists.flatten()
        full = pc.greater(pc.binary_length(chunks), 0)
        at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        coded = pc.dictionary_encode(chunks.filter(full))
        ids, n = self._chunks(coded.dictionary)
        kind = coded.indices.to_numpy()
        size = n[kind]
        ids = ids[_gathered((np.cumsum(n) - n)[kind], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        if not odd.any():
            return ids, np.diff(ends)
        parts = [ids[a:b] if not o else np.frombuffer(self.whole(t.as_py()), "<u4") for o, t, a, b in zip(odd.tolist(), texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return np.concatenate(parts), np.asarray([len(x) for x in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes; a null text has none."""
        if not texts:
            return []
        ids, n = self.flat(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), np.cumsum(n).tolist()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]


_MADE: dict[int, Encoder] = {}


def encoder(definition: bytes) -> Encoder:
    """This worker's encoder for a tokenizer file's bytes."""
    key = hash(definition)
    if key not in _MADE:
        _MADE[key] = Encoder(definition)
    return _MADE[key]
