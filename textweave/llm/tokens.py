"""Token ids of whole texts with a public tokenizer file, word by word with a memory of the words seen.

White space separates pre-tokens in the tokenizers used here, so a text's ids are its words' ids in a row. Words are
told apart by 64-bit hashes of a whole batch at once, which a second hash confirms; where the two disagree the tokenizer
gets the texts themselves. Otherwise it only sees words that the worker has not met before. `encode` checks on load that
the file splits at white space.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from textweave.llm.wordhash import WordHash, word_spans

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "word_bpe_49k.json"
MEMORY = 1_000_000  # words a worker remembers; about 45 MB
STEMS = 300_000  # the same for word stems, which are Python objects
TEXT_BYTES = 1 << 20
JOINED = 500  # stems that are encoded as one text

HASH, CHECK = WordHash(11), WordHash(12, bare=True)  # independent of each other


def public_file(name: str) -> str:
    """Place of an installed public tokenizer file, or the path itself."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of batches of texts; keeps the ids of the words it has met."""

    def __init__(self, file: str = VOCABULARY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_file(file))
        probe = "Ab cd,\nef  gh\t3."
        apart = [i for w in probe.split() for i in self._ids([w])[0]]
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != apart:
            raise ValueError(f"{file} does not split at white space")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a pre-token, where the file marks them
        if suffix:
            self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.check = np.empty(0, np.uint64)  # second hashes, in the same order
        self.slot = np.empty(0, np.int64)  # their place in start
        self.start = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.stems: dict[str, list[int]] = {}

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> list[list[int]]:
        """Ids of each stem; plain ones go through the tokenizer many at a time and are cut at the ids that end a word."""
        out: dict[str, list[int]] = {}
        plain = [s for s in stems if s.isalpha() and s < "ƀ" and max(s) < "ƀ"] if self.closes.any() else []
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) == len(group) and ends[-1] == len(ids) - 1:
                cuts = [0, *(ends + 1).tolist()]
                out.update((s, ids[a:b]) for s, a, b in zip(group, cuts, cuts[1:]))
        rest = [s for s in stems if s not in out]
        out.update(zip(rest, self._ids(rest)))
        return [out[s] for s in stems]

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        """Remember the ids of words that are new."""
        if len(self.known) + len(words) > MEMORY:
            self._forget()
        # a closing comma or full stop after a letter is a pre-token of its own, and case does not count: fewer stems
        stems, tails = [], []
        for w in words:
            tail = w[-1]
            if (tail == "," or tail == ".") and len(w) > 1 and "ƀ" > w[-2] and w[-2].isalpha():
                w = w[:-1]
            else:
                tail = ""
            stems.append(w.lower() if w.isascii() and "<|" not in w else w)
            tails.append(tail)
        known = self.stems
        fresh = [s for s in {*stems, *tails} if s and s not in known]
        known.update(zip(fresh, self._stems(fresh)))
        lists = [known[a] + known[b] if b else known[a] for a, b in zip(stems, tails)]
        if len(known) > STEMS:
            self.stems = {}
        sizes = np.array(list(map(len, lists)), np.int64)
        slots = len(self.start) - 1 + np.arange(len(words))
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(sizes)]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))]
        known, slot, check = np.r_[self.known, hashes], np.r_[self.slot, slots], np.r_[self.check, checks]
        order = np.argsort(known, kind="stable")
        self.known, self.slot, self.check = known[order], slot[order], check[order]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry than texts). Null texts have none."""
        ids, counts, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < TEXT_BYTES):
                size += len(texts[end] or "")
                end += 1
            part, n = self._encode([(t or "").encode() for t in texts[at:end]])
            ids.append(part)
            counts.append(n)
            at = end
        counts = np.concatenate([*counts, np.empty(0, np.int64)])
        return np.concatenate([*ids, np.empty(0, np.uint32)]), np.r_[0, np.cumsum(counts)]

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = b"\n".join(texts)
        data = np.frombuffer(whole, np.uint8)
        start, end = word_spans(data)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes, checks = HASH(data, start, end), CHECK(data, start, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if (checks != checks[first][which]).any():
            return self._whole(texts)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > MEMORY:  # start afresh with the words of this batch
                self._forget()
                new[:] = True
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            self._learn(distinct[new], checks[first[new]], [whole[a:b].decode() for a, b in spans])
            place = np.searchsorted(self.known, distinct)
        if (self.check[place] != checks[first]).any():
            return self._whole(texts)
        slot = self.slot[place][which]
        sizes = self.start[slot + 1] - self.start[slot]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[slot] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        # tokens of each text: tokens up to its last word less those before its first
        limits = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        upto = np.r_[0, ends][limits]
        return ids, np.diff(np.r_[0, upto])


    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's ids of whole texts, for words that one hash cannot tell apart."""
        lists = self._ids([t.decode() for t in texts])
        return np.array([i for ids in lists for i in ids], np.uint32), np.array([len(ids) for ids in lists], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(file: str = VOCABULARY) -> Encoder:
    """The worker's encoder for a file; lives as long as the worker."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]
