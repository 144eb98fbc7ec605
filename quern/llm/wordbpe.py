"""Ids of a tokenizer file whose words end at white space: many words at once, the odd ones by the library."""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np

from .common import LOWER

#: Words that a Python worker remembers the ids of.
WORDS = 400_000
#: Words are merged in groups of up to so many bytes; longer ones go to the library.
WIDTHS = (5, 8, 11, 14, 18, 26, 64)
#: No id, and no pair of ids; multiplier of a pair's hash, and bits that it drops.
PAD, NO_KEY, TIMES, HASHED = np.uint32(0xFFFF), np.uint32(0xFFFFFFFF), np.uint32(0x9E3779B1), np.uint32(14)
#: Kinds of bytes, as the file's splitting rule has them; of the two-byte letters, those whose first byte is LEAD take part.
ODD, LETTER, DIGIT, SIGN, LEAD = 0, 1, 2, 3, 0xC3


def _kinds() -> np.ndarray:
    out = np.full(256, ODD, np.int8)
    out[33:127] = SIGN
    out[48:58] = DIGIT
    out[97:123] = LETTER
    out[ord("'")] = ODD  # it may start a contraction
    return out


KIND = _kinds()


def parsed(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in UTF-8, each with a line end after it, in lower case; and the kinds of their bytes."""
    kind, blob = KIND[blob], blob.copy()
    lead = np.flatnonzero(blob[:-1] == LEAD)
    after = blob[lead + 1]
    capital = (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
    blob[lead[capital] + 1] += 0x20
    letter = lead[capital | (after >= 0x9F) & (after <= 0xBF) & (after != 0xB7)]
    kind[letter] = kind[letter + 1] = LETTER
    return blob, kind


class Merges:
    """A tokenizer file's merge rules on many words at once, one merge a word and round."""

    def __init__(self, shape: dict):
        vocab, suffix = shape["model"]["vocab"], shape["model"]["end_of_word_suffix"]
        # byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[signs[b]] for b in range(256)], np.uint32)
        self.last = np.array([vocab[signs[b] + suffix] for b in range(256)], np.uint32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in shape["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.none, rank = len(pairs), np.arange(len(pairs), dtype=np.int32)
        self.union = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        # the pairs by hash; those that fall on others' places are looked up in order
        place, first = np.unique(keys * TIMES >> HASHED, return_index=True)
        self.keys, self.rules = np.full(1 << (32 - int(HASHED)), NO_KEY, np.uint32), np.full(1 << (32 - int(HASHED)), self.none, np.int32)
        self.keys[place], self.rules[place] = keys[first], rank[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_rules = np.append(keys[rest], NO_KEY), np.append(rank[rest], np.int32(self.none))

    @staticmethod
    def fits(shape: dict) -> bool:
        """Whether the file's rules are those that this class applies: no merge crosses what the splitting rule parts."""
        model, split = shape["model"], shape.get("pre_tokenizer") or {}
        kinds = [x.get("type") for x in split.get("pretokenizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or len(model["vocab"]) >= 1 << 16 or kinds != ["Split", "ByteLevel"]:
            return False
        rule = split["pretokenizers"][0]["pattern"].get("Regex", "")
        crossing = any((x if isinstance(x, list) else x.split(" "))[0].endswith(model["end_of_word_suffix"]) for x in model["merges"])
        return rule.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not crossing and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix"))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rule of each pair, by rank; none where there is no rule."""
        key = left << np.uint32(16) | right
        place = key * TIMES >> HASHED
        seen = self.keys[place]
        out = np.where(seen == key, self.rules[place], np.int32(self.none))
        other = (seen != key) & (seen != NO_KEY)
        if other.any():
            asked = key[other]
            at = np.minimum(np.searchsorted(self.more_keys, asked), len(self.more_keys) - 1)
            out[other] = np.where(self.more_keys[at] == asked, self.more_rules[at], np.int32(self.none))
        return out

    def merged(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The order in which words come out, and their ids, two bytes each; ids has a row for each word, filled up with PAD.

        In each round every word that isn't done merges its best pair, the leftmost of equal ones, so that all rows at work lose one place.
        """
        rows, ranks, rounds = np.arange(len(ids)), self.ranks(ids[:, :-1], ids[:, 1:]), 0
        order, out = [], []
        while len(rows):
            width = ids.shape[1]
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), self.none)
            done = best == self.none
            if done.any():
                order.append(rows[done])
                blob = ids[done].astype("<u2").tobytes()
                out += [blob[i : i + n] for i, n in zip(range(0, len(blob), 2 * width), (2 * (size[rows[done]] - rounds)).tolist())]
                going = ~done
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
            if not len(rows):
                break
            each, columns, rounds = np.arange(len(rows)), np.arange(width - 1), rounds + 1
            ids[each, at] = self.union[best]
            ids = ids.ravel()[(each * width)[:, None] + columns + (columns > at[:, None])]
            ranks = ranks.ravel()[(each * (width - 1))[:, None] + columns[:-1] + (columns[:-1] >= at[:, None])]
            for shift in (-1, 0):
                touched = np.flatnonzero((at + shift >= 0) & (at + shift < width - 2))
                if len(touched):
                    place = at[touched] + shift
                    ranks[touched, place] = self.ranks(ids[touched, place], ids[touched, place + 1])
        return np.concatenate(order), out

    def of(self, words: list[bytes]) -> tuple[dict[bytes, bytes], list[bytes]]:
        """Ids of words with A-Z lower-cased, and those words that this class doesn't take."""
        blob, kind = parsed(np.frombuffer(b"\n".join(words) + b"\n", np.uint8))
        ends = np.flatnonzero(blob == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        odd = np.add.reduceat(kind == ODD, starts) > 1  # each has its line end
        size = ends - starts
        closed = np.ones(len(blob), bool)
        closed[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == DIGIT)
        ids = np.where(closed, self.last[blob], self.inner[blob])
        takes = ~odd & (size > 0) & (size <= WIDTHS[-1])
        out: dict[bytes, bytes] = {}
        for least, most in zip([0, *WIDTHS], WIDTHS):
            which = np.flatnonzero(takes & (size > least) & (size <= most))
            if len(which):
                place = np.arange(most)
                inside = place < size[which][:, None]
                order, found = self.merged(np.where(inside, ids[np.minimum(starts[which][:, None] + place, len(ids) - 1)], PAD), size[which])
                out.update(zip([words[i] for i in which[order].tolist()], found))
        return out, [words[i] for i in np.flatnonzero(~takes).tolist()]


class WordEncoder:
    """Ids of texts by a tokenizer file that lower-cases, splits at white space and drops it.

    So a text's ids are those of its words with A-Z lower-cased. Strings of special tokens are these tokens, as in the library's plain call, unless as_text.
    """

    def __init__(self, path: str, as_text: bool = False, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = as_text
        shape = json.loads(self.library.to_str())
        self.special = [] if as_text else [t["content"].encode() for t in shape["added_tokens"]]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.rules = Merges(shape) if self.width == 2 and Merges.fits(shape) else None
        self.known: dict[bytes, bytes] = {}
        self.words = words

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def by_library(self, texts: list[bytes]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        found, other = self.rules.of(new) if self.rules else ({}, new)
        self.known.update(found)
        self.known.update(zip(other, self.by_library(other)))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, width bytes each, little-endian."""
        odd = {i for s in self.special for i, t in enumerate(texts) if s in t}
        split = [[] if i in odd else t.translate(LOWER).split() for i, t in enumerate(texts)]
        used = set().union(*split)
        if len(self.known) > self.words:
            # the older words go down to three quarters of the bound, but for those in use here
            for w in list(itertools.islice((w for w in self.known if w not in used), len(self.known) - self.words * 3 // 4)):
                del self.known[w]
        new = used.difference(self.known)
        if new:
            self.learn(list(new))
        ids_of = self.known.__getitem__
        return [self.by_library([texts[i]])[0] if i in odd else b"".join(map(ids_of, words)) for i, words in enumerate(split)]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, as_text: bool, words: int) -> WordEncoder:
    return WordEncoder(path, as_text, words)
