"""Media columns: lossless WebP (VP8L) written and read in numpy, after the public bitstream specification.

`Decoder` reads the whole format: prefix codes (simple and normal), meta prefix codes, LZ77 back-references with the
two-dimensional distance codes, the colour cache, and the predictor, cross-colour, subtract-green and palette (colour
indexing) transforms. Streams in which only the green channel carries bits (grey images, which the columns here hold) are
decoded side by side, one symbol of every stream a step; all others go through the scalar reader. `encode` can use every
feature, `encode_grey` is its vectorised form for grey samples.

A payload (text in UTF-8, padded with bytes 255 to a positive multiple of ROW) is stored as grey samples in rows of ROW,
as one image for every TILE_ROWS rows, the images one after another; so any length fits and memory is bounded by a step.

Edge cases: null and empty texts have the payload of one row of 255. Equal texts have equal media. Rows are independent,
so an empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import slices, strings

ROW = 576
TILE_ROWS = 16
MAX_CODE = 10  # bits of the longest code that encode_grey writes
SHORTEST = 7  # samples of a back-reference: its codes and extra bits take about those of five
WORTH = 24  # an image has references where they save one in so many of its samples; fewer don't pay their reading
CACHE_BITS = 10
STEP = 32 << 20

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (x, y) of the distance codes from 1; distance = x + y * width.
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


# --- prefix codes ---------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `limit` bits; a lone symbol gets length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    weights, floor, total = counts[used].tolist(), 1, int(counts.sum())
    while True:
        heap = [(w if w > floor else floor, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        above = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            above[a[1]] = above[b[1]] = new
            heapq.heapreplace(heap, (a[0] + b[0], new))
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[:n]) <= limit:
            lengths[used] = depth[:n]
            return lengths
        floor = max(2 * floor, total >> (limit + 1))


_REVERSED = np.zeros(1 << 15, np.int64)
for _bit in range(15):
    _REVERSED |= (np.arange(1 << 15) >> _bit & 1) << (14 - _bit)


def _ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols in the order of their codes, their lengths, and the codes as the first of 15 bits."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[used]
    width = np.int64(1) << (15 - sizes)
    return used, sizes, np.cumsum(width) - width


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of the symbols, first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    used, _, begin = _ordered(lengths)
    codes[used] = _REVERSED[begin]
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(entries symbol << 4 | length for every value of the next `bits` bits, bits); a lone symbol takes no bits."""
    return _table(lengths.astype(np.uint8).tobytes())


@lru_cache(1 << 10)
def _table(lengths: bytes) -> tuple[np.ndarray, int]:
    used, sizes, _ = _ordered(np.frombuffer(lengths, np.uint8).astype(np.int64))
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.int32), 0
    if not len(used) or int((np.int64(1) << (15 - sizes)).sum()) != 1 << 15:
        raise ValueError("not a whole prefix code")
    bits = int(sizes[-1])
    by_first = np.repeat((used << 4 | sizes).astype(np.int32), np.int64(1) << (bits - sizes))
    return by_first[_REVERSED[: 1 << bits] >> (15 - bits)], bits


@lru_cache(1 << 8)
def _lone(symbol: int) -> tuple[np.ndarray, int]:
    return np.array([symbol << 4], np.int32), 0


def value_code(v: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their value) of a length or distance code."""
    if v <= 4:
        return v - 1, 0, 0
    n = (v - 1).bit_length() - 2
    return 2 * n + 2 + ((v - 1) >> n & 1), n, (v - 1) & ((1 << n) - 1)


# --- writing --------------------------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values of at most 24 bits, first bit lowest, one after another."""
    values, lengths = values[lengths > 0].astype(np.uint64), lengths[lengths > 0].astype(np.int64)
    if not len(values):
        return b""
    end = np.cumsum(lengths)
    begin = end - lengths
    word = begin >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(values << (begin & 31).astype(np.uint64), first)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] = sums & np.uint64(0xFFFFFFFF)
    out[word[first] + 1] |= sums >> np.uint64(32)
    return out.astype("<u4").tobytes()[: (int(end[-1]) + 7) // 8]


class _Bits:
    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.small: list[tuple[int, int]] = []

    def put(self, value: int, bits: int) -> None:
        self.small.append((value, bits))

    def puts(self, pairs: list[tuple[int, int]]) -> None:
        self.small += pairs

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.small:
            both = np.array(self.small, np.int64)
            self.parts.append((both[:, 0], both[:, 1]))
            self.small = []
        self.parts.append((values, sizes))

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code: simple with one or two symbols below 256, else normal."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and all(s < 256 for s in used):
            a, *b = used or [0]
            self.puts([(1, 1), (len(b), 1), (1, 1), (a, 8)] + [(s, 8) for s in b])
            return
        tokens = []
        ends = np.append(np.flatnonzero(np.diff(lengths)) + 1, len(lengths)).tolist()
        for i, j, v in zip([0, *ends], ends, lengths[[e - 1 for e in ends]].tolist()):
            run = j - i
            while v == 0 and run >= 3:
                k = min(run, 138)
                tokens.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                run -= k
            if v and run >= 4:
                tokens.append((v, 0, 0))
                run -= 1
                while run >= 3:
                    k = min(run, 6)
                    tokens.append((16, k - 3, 2))
                    run -= k
            tokens += [(v, 0, 0)] * run
        inner = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
        codes = canonical(inner)
        most = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if inner[s] or i < 4) + 1
        lone = np.count_nonzero(inner) == 1
        self.puts([(0, 1), (most - 4, 4)] + [(int(inner[s]), 3) for s in CODE_LENGTH_ORDER[:most]] + [(0, 1)])
        code, size = codes.tolist(), [0] * 19 if lone else inner.tolist()
        self.puts([x for t, v, k in tokens for x in ((code[t], size[t]), (v, k))])

    def bytes(self) -> bytes:
        self.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pack_bits(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def _header(bits: _Bits, width: int, height: int, alpha: int) -> None:
    bits.puts([(0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)])


#: Symbol, extra bits and their value of the length and distance codes from 1.
_VALUES = np.array([(0, 0, 0)] + [value_code(v) for v in range(1, ROW * TILE_ROWS + 121)], np.int64)


@lru_cache(16)
def plane_codes(width: int) -> np.ndarray:
    """The distance code of each distance in an image of that width."""
    out = np.arange(ROW * TILE_ROWS + 1) + 120
    for i, (x, y) in reversed(list(enumerate(DISTANCES))):
        if 1 <= x + y * width < len(out):
            out[x + y * width] = i + 1
    return out


def references(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references, greedily. A place's match is with the last place of the same four
    samples; where neighbours have matches at one distance, they are one match."""
    n = len(samples)
    if n < SHORTEST:
        return []
    grams = np.ndarray((n - 3,), "<u4", buffer=samples.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.sort(grams << np.uint64(20) | np.arange(n - 3, dtype=np.uint64))  # place in the low bits
    place = (order & np.uint64(0xFFFFF)).astype(np.int64)
    same = np.flatnonzero(order[1:] >> np.uint64(20) == order[:-1] >> np.uint64(20))
    distance = np.zeros(n - 3, np.int64)
    distance[place[same + 1]] = place[same + 1] - place[same]
    begin = np.flatnonzero(np.diff(distance, prepend=-1))
    end = np.append(begin[1:], n - 3)
    real = np.flatnonzero((distance[begin] > 0) & (end - begin > SHORTEST - 4))
    out, at = [], 0
    for i, j, d in zip(begin[real].tolist(), end[real].tolist(), distance[begin[real]].tolist()):
        i, j = max(i, at), j + 3
        while j - i >= SHORTEST:
            size = min(j - i, 4096)
            out.append((i, size, d))
            i += size
            at = i
    return out if WORTH * sum(size - 5 for _, size, _ in out) >= n else []


#: All images have one distance code, 5 bits for each of the first 32 symbols: the best code for an image's own distances
#: saves less than it takes to write it.
_AWAY = np.array([5] * 32 + [0] * 8, np.int64)
_AWAY_CODES = canonical(_AWAY)
_AWAY_BITS = (lambda b: (b.code(_AWAY), b.small)[1])(_Bits())


def _grey_code(bits: _Bits, green: np.ndarray, width: int, cache_bits: int = 0, alpha: int = 255) -> None:
    """The main image of grey samples, one group of codes. Without a cache all other channels are fixed (red and blue 0);
    with one, the pixels are grey in all channels, and a colour that was there before is named by its slot, if no other
    colour of the image has that slot."""
    bits.puts([(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)])
    bits.put(0, 1)  # no meta prefix codes
    refs = references(green)
    literal = np.ones(len(green), bool)
    for i, size, _ in refs:
        literal[i: i + size] = False
    at = np.flatnonzero(literal)
    symbols = green[at].astype(np.int64)
    first = symbols
    if cache_bits:
        shade = np.arange(256, dtype=np.int64)
        slot = (CACHE_FACTOR * (255 << 24 | shade * 0x010101) & 0xFFFFFFFF) >> (32 - cache_bits)
        shades, before = np.unique(green, return_index=True)
        alone = np.bincount(slot[shades], minlength=1 << cache_bits) == 1
        known = np.zeros(256, np.int64)
        known[shades] = before
        symbols = np.where((at > known[symbols]) & alone[slot[symbols]], 280 + slot[symbols], symbols)
        first = symbols[symbols < 256]
    where = np.searchsorted(at, [r[0] for r in refs])
    sizes = _VALUES[[r[1] for r in refs]].reshape(-1, 3)
    far = _VALUES[plane_codes(width)[[r[2] for r in refs]]].reshape(-1, 3)
    counts = np.bincount(np.concatenate((symbols, 256 + sizes[:, 0])), minlength=280 + (1 << cache_bits if cache_bits else 0))
    plain = code_lengths(counts, MAX_CODE)
    shades = code_lengths(np.bincount(first, minlength=256), MAX_CODE) if cache_bits else None
    bits.code(plain)
    for value in (0, 0, alpha):  # red, blue, alpha
        if cache_bits and value != alpha:
            bits.code(shades)
        else:
            bits.puts([(1, 1), (0, 1), (1, 1), (value, 8)])
    if refs:
        bits.puts(_AWAY_BITS)
    else:
        bits.puts([(1, 1), (0, 1), (1, 1), (0, 8)])

    def coded(lengths: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return canonical(lengths)[found], np.zeros(len(found), np.int64) if np.count_nonzero(lengths) == 1 else lengths[found]

    values, widths = coded(plain, symbols)
    if cache_bits:  # green, red and blue of a pixel that the cache doesn't give
        own = symbols < 256
        v, w = coded(shades, np.where(own, symbols, first[0] if len(first) else 0))
        values, widths = np.stack((values, v, v), 1).ravel(), np.stack((widths, np.where(own, w, 0), np.where(own, w, 0)), 1).ravel()
        where = where * 3
    if refs:
        a, b = coded(plain, 256 + sizes[:, 0]), (_AWAY_CODES[far[:, 0]], np.full(len(refs), 5))
        values = np.insert(values, np.repeat(where, 4), np.stack((a[0], sizes[:, 2], b[0], far[:, 2]), 1).ravel())
        widths = np.insert(widths, np.repeat(where, 4), np.stack((a[1], sizes[:, 1], b[1], far[:, 1]), 1).ravel())
    bits.many(values, widths)


#: Forms of an image of grey samples.
PLAIN, CROSSED, PREDICTED, CACHED, INDEXED = range(5)
BLOCK_SIZE = 6  # bits of the side of a predictor's block
SIDES = (1, 2, 3, 4, 8, 9)  # predictors that are undone a row of a block at a time


def form_of(samples: np.ndarray) -> int:
    """The form an image is written in, a rule on its content: a palette where it has 16 shades at most, whose indices
    share bytes; else subtract-green for most by their checksum; one of 16 each is in one of the other forms, which are
    seldom shorter for text, so that all of them are written and read. The cache, which only the scalar reader takes, has
    one image of 64."""
    if len(np.flatnonzero(np.bincount(samples, minlength=256))) <= 16:
        return INDEXED
    mark = zlib.crc32(samples.tobytes()) & 63
    return CACHED if mark == 3 else {1: CROSSED, 2: PREDICTED, 4: INDEXED}.get(mark & 15, PLAIN)


def _blocks(h: int, w: int, size: int) -> tuple[int, int]:
    return -(-h >> size), -(-w >> size)


def _best_sides(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Modes of the blocks with the smallest residuals, and the residuals."""
    h, w = grey.shape
    left, top, top_right, top_left = (x[..., 0] for x in _neighbours(np.repeat(grey[..., None], 4, 2)))
    guesses = np.stack([_predict(m, left, top, top_right, top_left) for m in SIDES])
    guesses[:, 0, 1:], guesses[:, 1:, 0], guesses[:, 0, 0] = left[0, 1:], top[1:, 0], 0
    rest = (grey - guesses).astype(np.uint8)
    cost = np.abs(rest.astype(np.int8).astype(np.int64))
    bh, bw = _blocks(h, w, BLOCK_SIZE)
    at = (np.arange(h)[:, None] >> BLOCK_SIZE) * bw + (np.arange(w)[None, :] >> BLOCK_SIZE)
    costs = np.stack([np.bincount(at.ravel(), c.ravel(), bh * bw) for c in cost])
    best = costs.argmin(0)
    return np.array(SIDES)[best].reshape(bh, bw), np.take_along_axis(rest, best[at][None], 0)[0]


def encode_grey(samples: np.ndarray, width: int, form: int | None = None) -> bytes:
    """Grey samples, row by row, with back-references, in the given form or in that of `form_of`."""
    form = form_of(samples) if form is None else form
    bits = _Bits()
    h = len(samples) // width
    _header(bits, width, h, 0)
    green, coded = samples, width
    if form == CROSSED:  # 32 / 32 of green off red and blue
        size = 9
        bits.puts([(1, 1), (CROSS, 2), (size - 2, 3)])
        bits.puts([(0, 1)] + [x for value in (32, 0, 32, 255, 0) for x in ((1, 1), (0, 1), (1, 1), (value, 8))])  # all blocks alike
    elif form == PREDICTED:
        modes, rest = _best_sides(samples.reshape(h, width))
        bits.puts([(1, 1), (PREDICTOR, 2), (BLOCK_SIZE - 2, 3)])
        image = np.zeros((*modes.shape, 4), np.uint8)
        image[..., 2] = modes
        _image(bits, image, 0, False, main=False)
        green = rest.ravel()
        bits.puts([(1, 1), (GREEN, 2)])
    elif form == INDEXED:
        shades, index = np.unique(samples, return_inverse=True)
        bits.puts([(1, 1), (PALETTE, 2), (len(shades) - 1, 8)])
        image = np.zeros((1, len(shades), 4), np.uint8)
        image[0, :, 1:] = np.diff(shades, prepend=np.uint8(0))[:, None]
        image[0, 0, 0] = 255
        _image(bits, image, 0, False, main=False)
        packed = 3 if len(shades) <= 2 else 2 if len(shades) <= 4 else 1 if len(shades) <= 16 else 0
        coded = -(-width >> packed)
        full = np.zeros((h, coded << packed), np.uint8)
        full[:, :width] = index.reshape(h, width)
        green = np.zeros((h, coded), np.uint8)
        for k in range(1 << packed):
            green |= full[:, k:: 1 << packed] << np.uint8((8 >> packed) * k)
        green = green.ravel()
    elif form == PLAIN:
        bits.puts([(1, 1), (GREEN, 2)])
    bits.put(0, 1)
    _grey_code(bits, green, coded, CACHE_BITS if form == CACHED else 0, 0 if form == PREDICTED else 255)
    return container(bits.bytes())


def _neighbours(px: np.ndarray) -> tuple[np.ndarray, ...]:
    """L, T, TR, TL of every pixel of an h x w x 4 image; what lies outside is never used."""
    h, w, _ = px.shape
    flat = np.concatenate((np.zeros((w + 1, 4), np.uint8), px.reshape(-1, 4), np.zeros((1, 4), np.uint8)))
    n = h * w
    return tuple(flat[w + 1 - d: w + 1 - d + n].reshape(h, w, 4).astype(np.int32) for d in (1, w, w - 1, w + 1))


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_right, top_left):
    """Arrays of shape (..., 4), channels in the order alpha, red, green, blue."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), top.shape)
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode <= 9:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        by_left = np.abs(top - top_left).sum(-1, keepdims=True)  # the distance of left + top - top_left from left
        by_top = np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(by_left < by_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _average(left, top)
    diff = mean - top_left
    return np.clip(mean + np.where(diff < 0, -(-diff // 2), diff // 2), 0, 255)


def _modes(h: int, w: int, bits: int, blocks: np.ndarray) -> np.ndarray:
    """The value of each pixel's block."""
    return blocks[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.uint8).astype(np.int8).astype(np.int32) * c.astype(np.uint8).astype(np.int8).astype(np.int32)) >> 5


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = True) -> bytes:
    """An h x w x 4 image (alpha, red, green, blue) with the given transforms in this order, each a tuple:
    (PREDICTOR, size bits, modes of the blocks), (CROSS, size bits, blocks x 3 of red-to-blue, green-to-blue,
    green-to-red), (GREEN,) or (PALETTE,)."""
    bits = _Bits()
    h, w, _ = pixels.shape
    _header(bits, w, h, int((pixels[..., 0] != 255).any()))
    px = pixels.astype(np.uint8)
    for kind, *rest in transforms:
        bits.puts([(1, 1), (kind, 2)])
        w = px.shape[1]
        if kind == PREDICTOR:
            size, blocks = rest
            bits.put(size - 2, 3)
            image = np.zeros((*blocks.shape, 4), np.uint8)
            image[..., 2] = blocks
            _image(bits, image, 0, references, main=False)
            sides, mode = _neighbours(px), _modes(h, w, size, blocks)
            guess = np.zeros((h, w, 4), np.int32)
            for m in np.unique(blocks).tolist():
                guess = np.where((mode == m)[..., None], _predict(m, *sides), guess)
            guess[0, 1:], guess[1:, 0], guess[0, 0] = sides[0][0, 1:], sides[1][1:, 0], (255, 0, 0, 0)
            px = (px - guess).astype(np.uint8)
        elif kind == CROSS:
            size, blocks = rest
            bits.put(size - 2, 3)
            _image(bits, np.concatenate((np.full((*blocks.shape[:2], 1), 255), blocks), -1).astype(np.uint8), 0, references, main=False)
            to = _modes(h, w, size, blocks)
            a, r, g, b = (px[..., i].astype(np.int32) for i in range(4))
            px = np.stack((a, r - _delta(to[..., 2], g), g, b - _delta(to[..., 1], g) - _delta(to[..., 0], r)), -1).astype(np.uint8)
        elif kind == GREEN:
            px = px.copy()
            px[..., 1] -= px[..., 2]
            px[..., 3] -= px[..., 2]
        else:
            flat = px.reshape(-1, 4).view(">u4").ravel()
            colours, index = np.unique(flat, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette has at most 256 colours")
            bits.put(len(colours) - 1, 8)
            plain = colours.astype(">u4").view(np.uint8).reshape(1, -1, 4)
            _image(bits, np.concatenate((plain[:, :1], plain[:, 1:] - plain[:, :-1]), 1), 0, references, main=False)
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            each, wide = 8 >> packed, -(-w >> packed)
            full = np.zeros((h, wide << packed), np.int64)
            full[:, :w] = index.reshape(h, w)
            px = np.zeros((h, wide, 4), np.uint8)
            px[..., 0] = 255
            px[..., 2] = sum(full[:, k:: 1 << packed] << (each * k) for k in range(1 << packed))
    bits.put(0, 1)
    _image(bits, px, cache_bits, references, main=True)
    return container(bits.bytes())


def _image(bits: _Bits, px: np.ndarray, cache_bits: int, references: bool, main: bool) -> None:
    """An entropy-coded image with one group of prefix codes."""
    h, w, _ = px.shape
    argb = px.reshape(-1, 4).copy().view(">u4").ravel().astype(np.int64).tolist()
    bits.put(int(cache_bits > 0), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)
    near = {x + y * w: i + 1 for i, (x, y) in reversed(list(enumerate(DISTANCES))) if x + y * w >= 1}
    cache: list[int | None] = [None] * (1 << cache_bits if cache_bits else 0)
    last: dict[tuple[int, ...], int] = {}
    tokens, i, n = [], 0, len(argb)
    while i < n:
        key = tuple(argb[i: i + 3])
        j = last.get(key) if references and len(key) == 3 else None
        size = 0
        if j is not None:
            while i + size < n and size < 4096 and argb[i + size] == argb[j + size]:
                size += 1
        if size >= 3:
            tokens.append(("copy", value_code(size), value_code(near.get(i - j, i - j + 120))))
        else:
            size, v = 1, argb[i]
            slot = (CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append(("cache", slot) if cache_bits and cache[slot] == v else ("pixel", v))
        for p in range(i, i + size):
            last[tuple(argb[p: p + 3])] = p
            if cache_bits:
                cache[(CACHE_FACTOR * argb[p] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[p]
        i += size
    counts = [np.zeros(280 + len(cache), np.int64), *(np.zeros(256, np.int64) for _ in range(3)), np.zeros(40, np.int64)]
    stream: list[list[tuple[int, int, int, int]]] = []  # (code, symbol, extra, bits)
    for t in tokens:
        if t[0] == "pixel":
            part = [(k, t[1] >> s & 255, 0, 0) for k, s in enumerate((8, 16, 0, 24))]
        elif t[0] == "cache":
            part = [(0, 280 + t[1], 0, 0)]
        else:
            (a, an, av), (b, bn, bv) = t[1:]
            part = [(0, 256 + a, av, an), (4, b, bv, bn)]
        for k, s, _, _ in part:
            counts[k][s] += 1
        stream.append(part)
    lengths = [code_lengths(c) for c in counts]
    for x in lengths:
        bits.code(x)
    codes, lone = [canonical(x) for x in lengths], [np.count_nonzero(x) == 1 for x in lengths]
    bits.puts([x for part in stream for k, s, v, m in part for x in ((int(codes[k][s]), 0 if lone[k] else int(lengths[k][s])), (v, m))])


# --- reading --------------------------------------------------------------------------------------------------


class _Reader:
    """Bits of a stream, first bit lowest."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3: (self.at >> 3) + 5], "little") >> (self.at & 7)

    def read(self, bits: int) -> int:
        v = self.peek() & ((1 << bits) - 1)
        self.at += bits
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return v

    def skip(self, bits: int) -> None:
        self.at += bits
        if self.at > self.end:
            raise ValueError("the stream ends early")

    def symbol(self, code: tuple[np.ndarray, int]) -> int:
        entries, bits = code
        if not bits:
            return entries.item(0) >> 4
        at = self.at
        e = entries.item((int.from_bytes(self.data[at >> 3: (at >> 3) + 3], "little") >> (at & 7)) & ((1 << bits) - 1))
        self.skip(e & 15)
        return e >> 4

    def value(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        n = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << n) + self.read(n) + 1

    def code(self, size: int) -> tuple[np.ndarray, int]:
        v = self.peek()
        if v & 1:
            wide = 8 if v & 4 else 1
            one = v >> 3 & ((1 << wide) - 1)
            if not v & 2:
                self.skip(3 + wide)
                return _lone(one)
            self.skip(11 + wide)
            lengths = np.zeros(size, np.int64)
            lengths[[one, v >> (3 + wide) & 255]] = 1
            return table(lengths)
        lengths, inner = np.zeros(size, np.int64), np.zeros(19, np.int64)
        order = CODE_LENGTH_ORDER[: 4 + (v >> 1 & 15)]
        self.skip(5)
        v = int.from_bytes(self.data[self.at >> 3: (self.at >> 3) + 8], "little") >> (self.at & 7)
        inner[list(order)] = [v >> 3 * i & 7 for i in range(len(order))]
        self.skip(3 * len(order))
        (entries, bits), most = table(inner), size
        if self.read(1):
            most = 2 + self.read(2 + 2 * self.read(3))
        # at most 14 bits for each length: read as one number
        pool, used, mask, entries = int.from_bytes(self.data[self.at >> 3: (self.at >> 3) + 2 * most + 2], "little") >> (self.at & 7), 0, (1 << bits) - 1, entries.tolist()
        found, before = [], 8
        while len(found) < size and most:
            most -= 1
            e = entries[pool & mask]
            pool >>= e & 15
            used += e & 15
            s = e >> 4
            if s < 16:
                found.append(s)
                before = s or before
            else:
                more = (2, 3, 7)[s - 16]
                found += [before if s == 16 else 0] * ((pool & ((1 << more) - 1)) + (3, 3, 11)[s - 16])
                pool >>= more
                used += more
        if len(found) > size:
            raise ValueError("too many code lengths")
        self.read(used)
        lengths[: len(found)] = found
        return table(lengths)


def copy_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = DISTANCES[code - 1]
    return max(1, x + y * width)


class Decoder:
    """One VP8L stream: the header and codes are read at once; `finish` takes the main image's pixels."""

    def __init__(self, stream: bytes):
        r = self.reader = _Reader(stream)
        if r.read(8) != 0x2F:
            raise ValueError("no lossless stream")
        self.width, self.height = r.read(14) + 1, r.read(14) + 1
        r.read(1)
        if r.read(3):
            raise ValueError("unknown version")
        self.transforms: list[tuple] = []
        w = self.width
        while r.read(1):
            kind = r.read(2)
            if any(t[0] == kind for t in self.transforms):
                raise ValueError("a transform occurs twice")
            if kind in (PREDICTOR, CROSS):
                size = r.read(3) + 2
                bw, bh = -(-w >> size), -(-self.height >> size)
                self.transforms.append((kind, w, size, self._argb(self._pixels(bw, bh, False), bh, bw)))
            elif kind == GREEN:
                self.transforms.append((kind, w))
            else:
                n = r.read(8) + 1
                colours = np.cumsum(self._argb(self._pixels(n, 1, False), 1, n)[0], 0, dtype=np.uint8)
                packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, w, packed, colours))
                w = -(-w >> packed)
        self.coded_width = w
        self._codes(w, self.height, True)

    @staticmethod
    def _argb(px: np.ndarray, h: int, w: int) -> np.ndarray:
        return px.astype(">u4").view(np.uint8).reshape(h, w, 4)

    def _codes(self, w: int, h: int, main: bool) -> None:
        r = self.reader
        self.cache_bits = r.read(4) if r.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("the colour cache is too large")
        self.groups_bits, self.groups_of, groups = 0, None, 1
        if main and r.read(1):
            size = r.read(3) + 2
            kept = self.cache_bits
            bw, bh = -(-w >> size), -(-h >> size)
            self.groups_of = (self._pixels(bw, bh, False) >> 8 & 0xFFFF).reshape(bh, bw)
            self.groups_bits, self.cache_bits, groups = size, kept, int(self.groups_of.max()) + 1
        cache = 1 << self.cache_bits if self.cache_bits else 0
        self.groups = [tuple(r.code(n) for n in (280 + cache, 256, 256, 256, 40)) for _ in range(groups)]

    def _pixels(self, w: int, h: int, main: bool) -> np.ndarray:
        if not main:
            self._codes(w, h, False)
        r, n, out, i = self.reader, w * h, [], 0
        cache = [0] * (1 << self.cache_bits if self.cache_bits else 0)
        shift, group, cached = 32 - self.cache_bits, self.groups[0], 0
        choose = self.groups_of if main else None
        while i < n:
            if choose is not None:
                group = self.groups[int(choose[(i // w) >> self.groups_bits, (i % w) >> self.groups_bits])]
            s = r.symbol(group[0])
            if s < 256:
                red, blue, alpha = r.symbol(group[1]), r.symbol(group[2]), r.symbol(group[3])
                out.append(alpha << 24 | red << 16 | s << 8 | blue)
            elif s < 280:
                size = r.value(s - 256)
                back = copy_distance(r.value(r.symbol(group[4])), w)
                if back > i or i + size > n:
                    raise ValueError("a back-reference leaves the image")
                for _ in range(size):
                    out.append(out[-back])
            else:
                while cached < i:  # the cache holds all pixels before this one
                    cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                    cached += 1
                out.append(cache[s - 280])
            i = len(out)
        return np.array(out, np.int64)

    @property
    def grey(self) -> bool:
        """Whether only the first code takes bits, back-references apart."""
        return len(self.groups) == 1 and not self.cache_bits and all(self.groups[0][k][1] == 0 for k in (1, 2, 3))

    def pixels(self) -> np.ndarray:
        """The image, h x w x 4 (alpha, red, green, blue)."""
        return self.finish(self._pixels(self.coded_width, self.height, True))

    def finish(self, argb: np.ndarray) -> np.ndarray:
        px = self._argb(argb, self.height, self.coded_width)
        for t in reversed(self.transforms):
            px = _UNDO[t[0]](px, *t[1:])
        return px

    def grey_samples(self, green: np.ndarray) -> np.ndarray | None:
        """The samples where all that is left to undo is subtract-green on equal channels."""
        fixed = [int(self.groups[0][k][0][0]) >> 4 for k in (1, 2, 3)]
        return green if [t[0] for t in self.transforms] == [GREEN] and fixed == [0, 0, 255] else None


def _undo_predictor(px: np.ndarray, w: int, size: int, blocks: np.ndarray) -> np.ndarray:
    h = px.shape[0]
    out = np.zeros((h * w + 1, 4), np.int32)
    rest = px.reshape(-1, 4).astype(np.int32)
    out[0] = (rest[0] + (255, 0, 0, 0)) & 255
    out[1:w] = (out[0] + np.cumsum(rest[1:w], 0)) & 255
    for y in range(1, h):
        row = y * w
        out[row] = (rest[row] + out[row - w]) & 255
        x = 1
        while x < w:
            mode = int(blocks[y >> size, x >> size, 2]) & 15
            end = min(w, ((x >> size) + 1) << size)
            a, b = row + x, row + end
            if mode == 1:
                out[a:b] = (out[a - 1] + np.cumsum(rest[a:b], 0)) & 255
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):  # nothing here needs the pixel to the left
                out[a:b] = (rest[a:b] + _predict(mode, None, out[a - w: b - w], out[a - w + 1: b - w + 1], out[a - w - 1: b - w - 1])) & 255
            else:
                for i in range(a, b):
                    out[i] = (rest[i] + _predict(mode, out[i - 1], out[i - w], out[i - w + 1], out[i - w - 1])) & 255
            x = end
    return out[:-1].astype(np.uint8).reshape(h, w, 4)


def _undo_cross(px: np.ndarray, w: int, size: int, blocks: np.ndarray) -> np.ndarray:
    to = _modes(px.shape[0], w, size, blocks)
    a, r, g, b = (px[..., i].astype(np.int32) for i in range(4))
    r = r + _delta(to[..., 3], g)
    return np.stack((a, r, g, b + _delta(to[..., 2], g) + _delta(to[..., 1], r)), -1).astype(np.uint8)


def _undo_green(px: np.ndarray, w: int) -> np.ndarray:
    px = px.copy()
    px[..., 1] += px[..., 2]
    px[..., 3] += px[..., 2]
    return px


def _undo_palette(px: np.ndarray, w: int, packed: int, colours: np.ndarray) -> np.ndarray:
    each = 8 >> packed
    x = np.arange(w)
    index = px[:, x >> packed, 2].astype(np.int64) >> (each * (x & ((1 << packed) - 1))) & ((1 << each) - 1)
    full = np.zeros((256, 4), np.uint8)
    full[: len(colours)] = colours
    return full[index]


_UNDO = {PREDICTOR: _undo_predictor, CROSS: _undo_cross, GREEN: _undo_green, PALETTE: _undo_palette}


def split(media: bytes) -> list[bytes]:
    """The streams of images that stand one after another."""
    out, at = [], 0
    while at < len(media):
        if media[at: at + 4] != b"RIFF" or media[at + 8: at + 16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP image")
        out.append(media[at + 20: at + 20 + int.from_bytes(media[at + 16: at + 20], "little")])
        at += 8 + int.from_bytes(media[at + 4: at + 8], "little")
    return out


_AROUND = np.array([*DISTANCES, (0, 0)], np.int64)


#: Of each length or distance symbol: its extra bits, their mask, and its least value.
_EXTRA = np.array([0] * 4 + [(p - 2) >> 1 for p in range(4, 40)], np.int64)
_EXTRA_MASK = ((np.int64(1) << _EXTRA) - 1).astype(np.uint32)
_LEAST = np.array([1, 2, 3, 4] + [((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, 40)], np.int64)


def _tables(tables: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of `table` one after another: entries, and the mask and the first entry of each."""
    begin = np.concatenate(([0], np.cumsum([len(t[0]) for t in tables])))[:-1]
    return np.concatenate([t[0] for t in tables]).astype(np.uint16), np.array([(1 << t[1]) - 1 for t in tables], np.uint32), begin


def decode_greens(decoders: list[Decoder]) -> list[np.ndarray]:
    """The green channel of grey streams, all streams a symbol at a time."""
    order = sorted(range(len(decoders)), key=lambda i: -decoders[i].coded_width * decoders[i].height)
    ds = [decoders[i] for i in order]
    sizes = np.array([d.coded_width * d.height for d in ds])
    base = np.concatenate(([0], np.cumsum([len(d.reader.data) for d in ds])))
    raw = np.frombuffer(b"".join(d.reader.data for d in ds) + b"\0" * 8, np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    del raw
    green, away = (_tables([d.groups[0][k] for d in ds]) for k in (0, 4))
    width = np.array([d.coded_width for d in ds])
    bit = base[:-1] * 8 + np.array([d.reader.at for d in ds])
    pos = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    end = pos + sizes
    first, mask, entry_at, far_mask, far_at = pos.copy(), green[1], green[2], away[1], away[2]
    out = np.zeros(int(sizes.sum()), np.uint8)

    def bits_at(where: np.ndarray) -> np.ndarray:
        return words[where >> 3] >> (where & 7).astype(np.uint32)

    def value(prefix: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of length or distance codes, their extra bits)"""
        return _LEAST[prefix] + (bits_at(where) & _EXTRA_MASK[prefix]), _EXTRA[prefix]

    while len(pos):
        code = green[0][(bits_at(bit) & mask) + entry_at]
        out[pos] = code >> 4
        bit += code & 15
        pos += 1
        if code.max() >= 256 << 4:
            i = np.flatnonzero(code >= 256 << 4)
            at, k = bit[i], pos[i] - 1
            size, n = value((code[i] >> 4).astype(np.int64) - 256, at)
            at += n
            symbol = away[0][(bits_at(at) & far_mask[i]) + far_at[i]]
            at += symbol & 15
            far, n = value((symbol >> 4).astype(np.int64), at)
            bit[i] = at + n
            near = _AROUND[np.minimum(far, 121) - 1]
            back = np.where(far > 120, far - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[i]))
            if (k - back < first[i]).any() or (k + size > end[i]).any():
                raise ValueError("a back-reference leaves the image")
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(k, size) + step] = out[np.repeat(k - back, size) + step % np.repeat(back, size)]
            pos[i] = k + size
        if (pos >= end).any():
            live = np.flatnonzero(pos < end)
            bit, pos, end, mask, entry_at, far_mask, far_at, first, width = (x[live] for x in (bit, pos, end, mask, entry_at, far_mask, far_at, first, width))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    back_to = {i: out[begin[k]: begin[k + 1]] for k, i in enumerate(order)}
    return [back_to[i] for i in range(len(decoders))]


def decode_samples(medias: list[bytes]) -> list[np.ndarray]:
    """The grey samples of each media value, its images joined."""
    parts = [[Decoder(s) for s in split(m)] for m in medias]
    greys = [d for p in parts for d in p if d.grey]
    found = dict(zip(map(id, greys), decode_greens(greys))) if greys else {}
    out = []
    for p in parts:
        images = []
        for d in p:
            green = found.get(id(d))
            samples = None if green is None else d.grey_samples(green)
            if samples is None:
                argb = None if green is None else green.astype(np.int64) << 8 | sum((int(d.groups[0][k][0][0]) >> 4) << s for k, s in ((1, 16), (2, 0), (3, 24)))
                samples = (d.pixels() if argb is None else d.finish(argb))[..., 2].ravel()
            images.append(samples)
        out.append(np.concatenate(images) if images else np.zeros(0, np.uint8))
    return out


# --- columns --------------------------------------------------------------------------------------------------

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("pixels", pa.binary())])


def to_media(payload: np.ndarray) -> bytes:
    return b"".join(encode_grey(payload[i: i + ROW * TILE_ROWS], ROW) for i in range(0, len(payload), ROW * TILE_ROWS))


def padded(text: np.ndarray) -> np.ndarray:
    out = np.full(max(1, -(-len(text) // ROW)) * ROW, 255, np.uint8)
    out[: len(text)] = text
    return out


def feature(pixels: np.ndarray) -> str:
    """Rows, mean and mean square in 1/1000, and the brightest of 16 levels: all from integer sums."""
    x = pixels.astype(np.int64)
    levels = np.bincount(pixels >> 4, minlength=16)
    return f"rows={len(x) // ROW};mean={int(x.sum()) * 1000 // len(x)};square={int((x * x).sum()) * 1000 // len(x)};levels={'.'.join(map(str, (levels * 100 // len(x)).tolist()))}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", STEP):
        data, offs = strings(batch.column(1))
        media = [to_media(padded(data[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], schema=_MEDIA)


def _decode(with_pixels: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", STEP // 2):
            media = batch.column(2).to_pylist()
            rows = []
            for doc, n, m, px in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), media, decode_samples(media)):
                raw = px.tobytes()
                rows.append({"doc_id": doc, "n_bytes": n, "payload_bytes": len(raw), "payload_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-32:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": feature(px), "width": ROW, "height": len(raw) // ROW, "pixels": raw if with_pixels else None})
            yield pa.RecordBatch.from_pylist(rows, _FEATURES)

    return decode


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the text's payload as a media column."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, with_pixels: bool = True) -> DataFrame:
    """The media column decoded: digests, features and the pixel array (grey samples, row by row)."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, pixels binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode(with_pixels), fields)
