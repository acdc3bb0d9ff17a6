"""Byte-level BPE over many texts with the tokenizers library.

The library's model encodes each distinct piece of text once (kept in a bounded cache); cutting the texts into pieces and
joining the ids again is done for a whole batch in numpy. The cut follows the pre-tokenizer's pattern (PATTERN); which
characters are letters, numbers or white space is asked of the library's own pre-tokenizer, once for each character. A
text that holds the string of an added token goes through the library as a whole.
"""

from __future__ import annotations

import json

import numpy as np

from sparkseek.llm.common import grouped_order, mix, separated

#: Fixed value: the pre-tokenizer's pattern that `pieces` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE, END = range(5)
CACHE_PIECES = 400_000

_seeded = np.random.Generator(np.random.PCG64(7))
_BY_PLACE = _seeded.integers(0, 1 << 64, 1024, dtype=np.uint64) | np.uint64(1)
_BEYOND = _seeded.integers(0, 1 << 64, 1 << 14, dtype=np.uint64) | np.uint64(1)
_BEYOND[0] = 1


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + n))
        n += b not in plain
    return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["model"].get("type") != "BPE":
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.model, self.letters = self.tokenizer.model, {b: c for b, c in enumerate(byte_letters())}
        self.n_vocab = self.tokenizer.get_vocab_size()
        self.kinds = np.full(0x110000, 255, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.sizes, self.offsets, self.n_ids = [], [], [], 0
        self.flat = np.zeros(0, np.uint32)

    def _kind(self, c: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return LETTER if len(cut("a" + c)) == 1 else NUMBER if len(cut("1" + c)) == 1 else OTHER if len(cut("!" + c)) == 1 else SPACE

    def classes(self, cps: np.ndarray) -> np.ndarray:
        kinds = self.kinds[cps]
        if (kinds == 255).any():
            seen = np.zeros(0x110000, bool)
            seen[cps[kinds == 255]] = True
            for c in np.flatnonzero(seen).tolist():
                self.kinds[c] = self._kind(chr(c))
            kinds = self.kinds[cps]
        return kinds

    def pieces(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pieces start. cps: the texts, a character after each (at `ends`) that is a piece of its own."""
        kind = self.classes(cps)
        kind[ends] = END
        n = len(cps)
        change = np.flatnonzero(np.diff(kind)) + 1
        begin = np.concatenate(([0], change))
        end = np.append(change, n)
        run = kind[begin]
        starts = np.zeros(n + 1, bool)
        starts[begin] = True
        starts[ends] = True
        # white space before a piece: its last character is cut off; a blank then belongs to that piece
        i = np.flatnonzero(run == SPACE)
        i = i[i + 1 < len(run)]
        i = i[run[i + 1] != END]
        last = end[i] - 1
        starts[last] = True
        blank = cps[last] == 32
        starts[end[i][blank]] = False
        # contractions: a lone ' that no blank precedes, and the letters behind it
        i = np.flatnonzero((run[:-1] == OTHER) & (end[:-1] - begin[:-1] == 1) & (run[1:] == LETTER)) if len(run) > 1 else np.zeros(0, np.int64)
        i = i[(cps[begin[i]] == 39) & starts[begin[i]]]
        if len(i):
            a = cps[end[i]]
            two = end[i + 1] - end[i] >= 2
            b = np.where(two, cps[np.minimum(end[i] + 1, n - 1)], 0)
            ord_ = {c: ord(c) for c in "stmdrevl"}
            one = (a == ord_["s"]) | (a == ord_["t"]) | (a == ord_["m"]) | (a == ord_["d"])
            pair = ((a == ord_["r"]) & (b == ord_["e"])) | ((a == ord_["v"]) & (b == ord_["e"])) | ((a == ord_["l"]) & (b == ord_["l"]))
            size = np.where(one, 1, np.where(pair, 2, 0))
            i, size = i[size > 0], size[size > 0]
            starts[end[i]] = False
            starts[end[i] + size] = True
        return np.flatnonzero(starts[:n])

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        letters, tokenize = self.letters, self.model.tokenize
        for h, w in zip(hashes, words):
            ids = [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]
            self.place[h] = len(self.sizes)
            self.sizes.append(len(ids))
            self.offsets.append(self.n_ids)
            self.ids.append(ids)
            self.n_ids += len(ids)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and, last, end)."""
        n = len(offs) - 1
        raw = data.tobytes()
        whole = [i for i in range(n) if any(raw.find(a, int(offs[i]), int(offs[i + 1])) >= 0 for a in self.added)] if any(a in raw for a in self.added) else []
        buf, _ = separated(data, offs, fill=10)
        lead = (buf & 0xC0) != 0x80
        ends = np.cumsum(lead)[offs[1:] + np.arange(n)] - 1
        text = buf.tobytes().decode()
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = self.pieces(cps, ends)
        size = np.diff(np.append(starts, len(cps)))
        at = np.arange(len(cps)) - np.repeat(starts, size)
        part = (cps.astype(np.uint64) + np.uint64(1)) * _BY_PLACE[at & 1023]
        if size.max() > 1024:
            part *= _BEYOND[(at >> 10) & 16383]
        h = mix(np.add.reduceat(part, starts) + size.astype(np.uint64))
        is_end = np.zeros(len(cps), bool)
        is_end[ends] = True
        real = ~is_end[starts]
        h, starts, size = h[real], starts[real], size[real]
        counts_before = np.searchsorted(starts, ends)  # pieces before each text's end
        if len(h):
            order = grouped_order(h)
            sorted_h = h[order]
            new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
            first = order[new]
            if len(self.place) + len(first) > CACHE_PIECES:
                self._forget()
            keys = sorted_h[new].tolist()
            missing = [k for k, key in enumerate(keys) if key not in self.place]
            self._learn([keys[k] for k in missing], [text[a: a + m] for a, m in zip(starts[first[missing]].tolist(), size[first[missing]].tolist())])
            index = np.empty(len(h), np.int64)
            index[order] = np.array([self.place[k] for k in keys], np.int64)[np.cumsum(new) - 1]
            sizes, flat = np.array(self.sizes, np.int64), self._flat()
            per = sizes[index]
            total = np.concatenate(([0], np.cumsum(per)))
            where = np.repeat(np.array(self.offsets, np.int64)[index] - total[:-1], per) + np.arange(total[-1])
            ids = flat[where]
        else:
            total, ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        bounds = np.concatenate(([0], total[counts_before]))
        if whole:
            parts = np.split(ids, bounds[1:-1])
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(raw[offs[i]: offs[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds

    def _flat(self) -> np.ndarray:
        if self.ids:
            self.flat = np.concatenate((self.flat, np.fromiter((x for p in self.ids for x in p), np.uint32)))
            self.ids = []
        return self.flat
