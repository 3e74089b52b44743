"""Encoding whole columns of text with a public tokenizer, word by word, with results equal to the library's."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: Words with these letters go to the library as they are: there lower case and normal form may depend on neighbours.
_RARE = r"[^\x{00}-\x{17F}]|\x{130}"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class WordEncoder:
    """Encodes white-space separated words once and keeps their ids; at most about `most` words of `most_bytes` in all, and as many ids,
    are kept from one batch to the next.

    The tokenizer must lower-case, drop white space, end each piece of letters with one token in </w>, and never join
    words across white space, as word_bpe_49k.json does. Words of letters share an entry with their
    forms with punctuation behind, which is a piece of its own; all others are encoded by the library as they stand.
    """

    def __init__(self, path: str, most: int = 400_000, most_bytes: int = 16 << 20):
        # a task has one core: threads of the library's own only cost memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most, self.most_bytes = Tokenizer.from_file(path), most, most_bytes
        end = [i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[end] = True
        self.clear()

    def clear(self) -> None:
        self.plain, self.other, self.bytes = {}, {}, 0
        self.starts, self.lens, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self._keep([0], np.zeros(0, np.uint32))  # entry 0 has no ids

    def _keep(self, lens, flat: np.ndarray) -> int:
        """Store words' ids; the number of the first of them."""
        k, m = len(lens), len(flat)
        while self.n + k > len(self.starts):
            self.starts, self.lens = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.lens, self.lens * 0])
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.starts[self.n : self.n + k] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : self.n + k] = lens
        self.flat[self.used : self.used + m] = flat
        self.n, self.used, first = self.n + k, self.used + m, self.n
        return first

    def _learn_plain(self, words: list[str]) -> int:
        lines = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer does not end each word with one word-end token")
        return self._keep(np.diff(stops, prepend=0), ids)

    def _learn_other(self, words: list[str]) -> int:
        found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return self._keep(np.array([len(x) for x in found]), np.concatenate(found))

    def _find(self, known: dict[str, int], words: list[str], learn) -> np.ndarray:
        """The entry of each word; unknown ones are learned."""
        found = list(map(known.get, words))
        miss = [k for k, x in enumerate(found) if x is None]
        if miss:
            new = [words[k] for k in miss]
            self.bytes += sum(map(len, new))
            first = learn(new)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            for j, k in enumerate(miss):
                found[k] = first + j
        return np.array(found, np.int64)

    def _entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two entries for each distinct word: of the word, and of the punctuation behind its letters."""
        body = pc.utf8_rtrim(words, characters=_MARKS)
        offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        behind = np.diff(offs) - pc.binary_length(body).to_numpy(zero_copy_only=False)
        plain = pc.and_not(pc.utf8_is_alpha(body), pc.match_substring_regex(body, _RARE)).to_numpy(zero_copy_only=False) & (behind <= 8)
        low = pc.utf8_lower(body.filter(pa.array(plain))).dictionary_encode()
        one, two = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(low):
            one[plain] = self._find(self.plain, low.dictionary.to_pylist(), self._learn_plain)[low.indices.to_numpy()]
        rest = words.filter(pa.array(~plain)).to_pylist()
        if rest:
            one[~plain] = self._find(self.other, rest, self._learn_other)
        marked = np.flatnonzero(plain & (behind > 0))
        if len(marked):  # the last bytes of a word, as a number
            data = np.frombuffer(words.buffers()[2], np.uint8)
            place = np.arange(8)
            last = np.where(place < behind[marked, None], data[np.maximum(offs[1:][marked, None] - 1 - place, 0)], 0).astype(np.uint64)
            codes, which = np.unique((last << (8 * place).astype(np.uint64)).sum(1, dtype=np.uint64), return_inverse=True)
            tails = [int(c).to_bytes(8, "big").lstrip(b"\0").decode() for c in codes]
            two[marked] = self._find(self.other, tails, self._learn_other)[which]
        return one, two

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and each text's number of them, `end` included; a null text counts as empty.

        Arrow splits the texts and numbers their distinct words, so Python meets each word of a batch once.
        """
        if self.n > self.most or self.bytes > self.most_bytes or self.used > self.most_bytes:
            self.clear()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        cuts = split.offsets.to_numpy()
        coded = split.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        cuts = np.asarray(cuts[1:] - cuts[0], np.int64)
        mark = self._find(self.other, [f"\n{end}"], lambda _: self._keep([1], np.array([end], np.uint32)))[0]
        which = np.zeros((len(coded) + len(cuts), 2), np.int64)
        closing = cuts + np.arange(len(cuts))
        which[closing, 0] = mark
        if len(coded):
            inside = np.ones(len(which), bool)
            inside[closing] = False
            one, two = self._entries(coded.dictionary)
            at = coded.indices.to_numpy()
            which[inside, 0], which[inside, 1] = one[at], two[at]
        which = which.ravel()
        lens = self.lens[which]
        ends = np.cumsum(lens)
        idx = np.repeat(self.starts[which] - (ends - lens), lens)
        idx += np.arange(len(idx))
        return self.flat[idx], np.diff(ends[2 * closing + 1], prepend=0)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return worker_state(f"encoder {path}", lambda: WordEncoder(path))
