"""Similarity of texts by the letters that they share in order (longest common subsequence), in bit-parallel steps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np

# The share of a score that a part of a text can give, and the least score of a text within another.
PART_SHARE = 0.9
CONTAINED = 0.85
#: The least ratio of the lengths of two rows' texts that are compared.
LENGTH_RATIO = 0.70


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence: a bit for each letter of ``a``, a step for each letter of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = left = (1 << len(a)) - 1
    for c in b:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & full
    return len(a) - left.bit_count()


def letters_in_common(a: str, b: str) -> int:
    """The letters that both texts have, wherever they stand: no less than common() gives."""
    return sum(min(a.count(c), b.count(c)) for c in set(a))


def ratio(a: str, b: str) -> float:
    """Twice the letters in common over all letters; 1 for two empty texts."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text and a stretch of the longer one that is as long, or shorter at either end.

    0 if none reaches ``least``.
    """
    best = 0.0
    for short, long in ((a, b), (b, a)) if len(a) == len(b) else [sorted((a, b), key=len)]:
        n = len(short)
        if not n:
            continue
        whole = common(short, long)
        if 2 * whole / (n + whole) < least:
            continue
        for size in range(n, 0, -1):
            if 2 * min(size, whole) / (n + size) < max(least, best):
                if size <= whole:
                    break  # shorter ones give less
                continue
            starts = range(len(long) - n + 1) if size == n else {0, len(long) - size}
            best = max(best, max(2 * common(short, long[i : i + size]) / (n + size) for i in starts))
    return best if best >= least else 0.0


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_score(a: str, b: str, least: float = 0.0) -> float:
    """1 for equal texts and at least CONTAINED if one holds the other (both trimmed, in lower case); else the ratio of the
    sorted words, or PART_SHARE of the partial ratio if that is more. Scores below ``least`` may come out lower."""
    if a == b:
        return 1.0
    if a in b or b in a:
        return max(CONTAINED, min(len(a), len(b)) / max(len(a), len(b), 1))
    one, two = sorted_words(a), sorted_words(b)
    if least and 2 * letters_in_common(one, two) < least * (len(one) + len(two)) - 1e-9:
        most = letters_in_common(a, b)
        if PART_SHARE * 2 * most < least * (min(len(a), len(b)) + most) - 1e-9:
            return 0.0
    whole = ratio(one, two)
    return max(whole, PART_SHARE * partial_ratio(a, b, max(least, whole) / PART_SHARE))


#: Columns of letters that are counted, rarer letters sharing them, and groups of them.
_LETTERS, _GROUPS = 64, 3
#: Texts of one side that meet the other at a time, values in a box, comparisons at a time, and pairs looked at closer at a time.
_ROWS, _BOX, _BLOCK, _BATCH = 32, 8, 1 << 17, 1 << 18
#: The longest texts whose letters in common are computed for many pairs at once, and the most texts of the same words in one.
_SHORT, _SAME = 63, 256


def _pair_bits(texts: list[str], words: int) -> np.ndarray:
    """A bit for the hash of each two letters in a row, in ``words`` 64-bit numbers a text."""
    out, held = np.zeros((len(texts), words), np.uint64), {}
    for i, text in enumerate(texts):
        bits = 0
        for pair in {text[j : j + 2] for j in range(len(text) - 1)}:
            if (bit := held.get(pair)) is None:
                bit = held[pair] = 1 << zlib.crc32(pair.encode("utf-8", "surrogatepass")) % (64 * words)
            bits |= bit
        out[i] = np.frombuffer(bits.to_bytes(8 * words, "little"), "<u8")
    return out


def _missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(a[..., w] & ~b[..., w]).astype(np.int64) for w in range(a.shape[-1]))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts one after another, the text of each, and the letters of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.repeat(np.arange(len(texts)), sizes), sizes


def _columns(points: np.ndarray, spaces: bool) -> np.ndarray:
    """The column of each code point, the frequent ones having one to themselves; -1 for whitespace without ``spaces``."""
    times = np.bincount(points, minlength=1)
    used = np.flatnonzero(times)
    used = used[np.argsort(-times[used], kind="stable")]
    if not spaces:
        used = used[[not chr(x).isspace() for x in used]]
    column = np.full(len(times), -1, np.int16)
    column[used] = np.arange(len(used)) % _LETTERS
    return column


class _Common:
    """Letters in common of pairs of texts of up to _SHORT letters; rarer letters share columns, which can only add some."""

    def __init__(self, texts: list[str]) -> None:
        points, who, sizes = _points([x if len(x) <= _SHORT else "" for x in texts])
        at = np.arange(len(points)) - (np.cumsum(sizes) - sizes)[who]
        self.sizes = sizes.astype(np.uint64)
        self.codes = np.full((int(sizes.max(initial=0)), len(texts)), _LETTERS, np.uint8)
        self.codes[at, who] = _columns(points, True)[points]
        self.places = np.zeros((len(texts), _LETTERS + 1), np.uint64)
        rows = np.arange(len(texts))
        for k, code in enumerate(self.codes):
            self.places[rows, code] |= np.uint64(1 << k)
        self.places[:, _LETTERS] = 0

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sizes = self.sizes[i]
        full = (np.uint64(1) << sizes) - np.uint64(1)
        left, flat, base = full.copy(), self.places.ravel(), i * (_LETTERS + 1)
        for code in self.codes[: int(self.sizes[j].max(initial=0))]:
            hit = left & flat[base + code[j]]
            left = ((left + hit) | (left - hit)) & full
        return (sizes - np.bitwise_count(left)).astype(np.int64)


class _Kinds:
    """Texts of the same sorted words, _SAME at most, are one kind; a kind's letters are counted without whitespace.

    ``signs`` has for each group of letters 64 bits a kind, and ``sign`` 64 bits of all letters; a bit says that a letter is
    there so often. Two kinds differ in no more bits than letters are in one and not in the other.
    """

    def __init__(self, texts: list[str], one: int) -> None:
        """The first ``one`` texts are one side, which shares no kinds with the others."""
        self.texts, kinds, held = texts, np.empty(len(texts), np.int64), {}
        self.words: list[str] = []
        for k, text in enumerate(texts):
            words = sorted_words(text)
            kind, n = held.get((k < one, words), (-1, _SAME))
            if n == _SAME:
                kind, n = len(self.words), 0
                self.words.append(words)
            held[k < one, words] = kind, n + 1
            kinds[k] = kind
        self.members = np.argsort(kinds, kind="stable")
        self.times = np.bincount(kinds, minlength=len(self.words))
        self.starts = np.cumsum(self.times) - self.times
        self.one = int(kinds[:one].max(initial=-1)) + 1
        self.m = np.fromiter(map(len, texts), np.int64, len(texts))
        self.longest = np.maximum.reduceat(self.m[self.members], self.starts) if len(texts) else self.m
        self._count()

    def _count(self) -> None:
        points, who, self.n = _points(self.words)
        column = _columns(points, False)[points]
        letter = column >= 0
        column, who = column[letter].astype(np.int64), who[letter]
        self.c = np.bincount(who, minlength=len(self.words))
        ends = np.cumsum(self.c)
        counts = np.empty((_LETTERS, len(self.words)), np.uint8)
        for a in range(0, len(self.words), _BATCH // 8):
            b = min(a + _BATCH // 8, len(self.words))
            x = slice(ends[a] - self.c[a], ends[b - 1])
            times = np.bincount((who[x] - a) * _LETTERS + column[x], minlength=(b - a) * _LETTERS).reshape(-1, _LETTERS)
            counts[:, a:b] = np.minimum(times, 255).T
        # What splits the texts of a sample best tells them apart; groups of letters get about the same of it.
        some = counts[:, :: max(1, len(self.words) // 2048)]
        splits = [((p := np.mean(some >= k, axis=1)) * (1 - p)) for k in range(1, int(some.max(initial=0)) + 1)]
        worth = np.array(splits) if splits else np.zeros((1, _LETTERS))
        group, load = np.zeros(_LETTERS, np.int64), np.zeros(_GROUPS)
        for letter in np.argsort(-worth.sum(0), kind="stable"):
            group[letter] = np.argmin(load)
            load[group[letter]] += worth[:, letter].sum()
        best = [divmod(int(x), _LETTERS) for x in np.argsort(-worth, axis=None, kind="stable")]
        self.sign = self._bits(counts, best)
        self.signs = [self._bits(counts, [x for x in best if group[x[1]] == g]) for g in range(_GROUPS)]

    def _bits(self, counts: np.ndarray, best: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(counts.shape[1], np.uint64)
        for bit, (k, letter) in enumerate(best[:64]):
            out |= (counts[letter] > k).astype(np.uint64) << np.uint64(63 - bit)
        return out

    @cached_property
    def common(self) -> _Common:
        return _Common(self.words)

    @cached_property
    def pairs_of_words(self) -> np.ndarray:
        # Words of half of _SHORT letters have no ratio of two thirds with longer ones than it.
        return _pair_bits([x if len(x) > _SHORT // 2 else "" for x in self.words], 8)


class _Bands:
    """The kinds of one side by group of letters: sorted by band (of like lengths) and bits, equal ones being one value."""

    def __init__(self, kinds: _Kinds, band: np.ndarray, chosen: np.ndarray, g: int) -> None:
        self.kinds = chosen[np.lexsort((kinds.signs[g][chosen], band[chosen]))]
        self.band, sign = band[self.kinds], kinds.signs[g][self.kinds]
        new = np.ones(len(sign), bool)
        new[1:] = (sign[1:] != sign[:-1]) | (self.band[1:] != self.band[:-1])
        self.value = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(sign)))
        self.values, self.bands, self.sign = sign[self.starts], self.band[self.starts], kinds.sign[self.kinds]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _differing(rows: np.ndarray, columns: np.ndarray, below: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Where rows and columns (first row, first column, matrix) differ in fewer bits than the column's ``below``."""
    width = min(len(columns), _BLOCK)
    height = max(1, _BLOCK // max(1, width))
    for x in range(0, len(columns), max(1, width)):
        for y in range(0, len(rows), height):
            bits = np.bitwise_count(rows[y : y + height, None] ^ columns[None, x : x + width])
            yield y, x, bits < below[None, x : x + width]


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix that is almost all False, which is looked at by eights."""
    flat = found.ravel()
    eights = len(flat) // 8 * 8
    hot = np.flatnonzero(flat[:eights].view(np.uint64))
    k, e = np.nonzero(flat[:eights].reshape(-1, 8)[hot])
    at = np.concatenate([hot[k] * 8 + e, np.flatnonzero(flat[eights:]) + eights])
    return np.divmod(at, found.shape[1])


def _near(kinds: _Kinds, same: bool, least: float, sizes: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different kinds of the two sides (of one with itself, each pair once) that letters don't rule out.

    Between close texts at most a number R of letters is in one and not in the other, R + 1 is dealt to the groups of
    letters, and in some group the difference is below its share. So the different values of a group's bits are compared
    first, and the kinds of near values by the bits of all letters. A pair comes from the first group that finds it.
    """
    if not len(kinds.words):
        return
    band = np.unique(np.floor(np.log(np.maximum(kinds.n, 1)) / np.log(1.03)), return_inverse=True)[1]
    order = np.argsort(band, kind="stable")
    first = np.flatnonzero(np.diff(band[order], prepend=-1))
    high = lambda x: np.maximum.reduceat(x[order], first).astype(float)
    low = lambda x: np.minimum.reduceat(x[order], first).astype(float)
    n, m, c, d = high(kinds.n), high(kinds.longest), high(kinds.c), low(kinds.c)
    most = np.floor((1 - least) * (n[:, None] + n) + 1e-6)
    share = min(1.0, least / PART_SHARE)
    parts = 2 * np.floor(_lost(np.minimum(m[:, None], m), share)) + np.maximum(c[:, None] - d, c - d[:, None])
    most = np.maximum(most, parts).astype(np.int64)
    fits = np.ones(most.shape, bool)
    if sizes is not None:
        sized = sizes[kinds.members]
        short, long = low(np.minimum.reduceat(sized, kinds.starts)), high(np.maximum.reduceat(sized, kinds.starts))
        fits = (long[:, None] >= LENGTH_RATIO * short - 1e-6) & (long >= LENGTH_RATIO * short[:, None] - 1e-6)
    shares = [np.where(fits, np.minimum((most + 1 + g) // _GROUPS, 65), 0).astype(np.uint8) for g in range(_GROUPS)]
    whole = np.where(fits, np.minimum(most + 1, 65), 0).astype(np.uint8)
    mine = np.arange(len(kinds.words) if same else kinds.one)
    other = mine if same else np.arange(kinds.one, len(kinds.words))

    def settled(g: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = band[i], band[j]
        keep = (x < y) | ((x == y) & (i < j)) if same else np.ones(len(i), bool)
        total = np.zeros(len(i), np.int64)
        for k in range(_GROUPS):
            bits = np.bitwise_count(kinds.signs[k][i] ^ kinds.signs[k][j])
            total += bits
            if k <= g:
                keep &= (bits < shares[k][x, y]) == (k == g)
        keep &= total <= most[x, y]
        return i[keep], j[keep]

    for g in range(_GROUPS):
        one = _Bands(kinds, band, mine, g)
        two = one if same else _Bands(kinds, band, other, g)
        held, pairs = [], 0
        for b in np.unique(one.band):
            reach = np.flatnonzero(shares[g][b])
            if same:
                reach = reach[reach >= b]
            if not len(reach):
                continue
            begin, end = np.searchsorted(two.bands, [reach[0], reach[-1] + 1])
            values, below = two.values[begin:end], shares[g][b][two.bands[begin:end]]
            box = np.arange(0, len(values), _BOX)
            all_of, any_of, most_below = np.bitwise_and.reduceat(values, box), np.bitwise_or.reduceat(values, box), np.maximum.reduceat(below, box)
            last = np.searchsorted(one.band, b + 1)
            for row in range(np.searchsorted(one.band, b), last, _ROWS):
                stop = min(row + _ROWS, last)
                some = one.values[one.value[row] : one.value[stop - 1] + 1]
                gap = np.bitwise_count(np.bitwise_and.reduce(some) & ~any_of) + np.bitwise_count(all_of & ~np.bitwise_or.reduce(some))
                maybe = (box[gap < most_below][:, None] + np.arange(_BOX)).ravel()
                maybe = maybe[: np.searchsorted(maybe, len(values))]
                near = np.zeros(len(maybe), bool)
                for _, x, found in _differing(some, values[maybe], below[maybe]):
                    near[x : x + found.shape[1]] |= found.any(axis=0)
                near = maybe[near] + begin
                columns = _ranges(two.starts[near], two.sizes[near])
                for y, x, found in _differing(one.sign[row:stop], two.sign[columns], whole[b][two.band[columns]]):
                    i, j = _places(found)
                    held.append((one.kinds[row + y + i], two.kinds[columns[x + j]]))
                    pairs += len(i)
                    if pairs >= _BATCH:
                        yield settled(g, *(np.concatenate(x) for x in zip(*held)))
                        held, pairs = [], 0
        if held:
            yield settled(g, *(np.concatenate(x) for x in zip(*held)))


def _lost(n: np.ndarray, share: float) -> np.ndarray:
    """Most letters of a text of n letters that the ratio ``share`` with a stretch of a longer one leaves unmatched."""
    return n * (2 - 2 * share) / (2 - share) + 1e-6


def _members(kinds: _Kinds, i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of texts of pairs of kinds, of a kind with itself each once."""
    counts = kinds.times[i] * kinds.times[j]
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // _BATCH, prepend=0))
    for a, b in zip([0, *cuts], [*cuts, len(i)]):
        which = np.repeat(np.arange(a, b), counts[a:b])
        k = np.arange(len(which)) - np.repeat(np.cumsum(counts[a:b]) - counts[a:b], counts[a:b])
        x, y = np.divmod(k, kinds.times[j[which]])
        keep = (i[which] != j[which]) | (x < y)
        which, x, y = which[keep], x[keep], y[keep]
        yield kinds.members[kinds.starts[i[which]] + x], kinds.members[kinds.starts[j[which]] + y], sure[which]


def close_pairs(a: list[str], b: list[str] | None, least: float, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Places of texts of ``a`` and of ``b`` (of two texts of ``a`` without it, the first place smaller) and their
    token_score, where that is ``least`` or more; the texts are trimmed and in lower case. With ``sizes`` (of all texts)
    pairs whose smaller size is below LENGTH_RATIO of the other may be left out.

    Pairs that counts of letters don't rule out are held by their letters in common: of the sorted words, or, where the
    shorter text can be within the longer one, of the texts. For texts of over _SHORT letters hashed pairs of letters take
    that place: of a text's letters x and another's y that stay unmatched, at most 2x + y of its pairs of letters can be
    missing in the other.
    """
    texts = a if b is None else a + b
    kinds = _Kinds(texts, len(a))
    share = min(1.0, least / PART_SHARE)
    # Most unmatched pairs of letters of a shorter text within a longer one; the worst window is the shortest that fits.
    lost = lambda n: n * (2 - 1.5 * share + (1 - 1.5 * share) * share / (2 - share)) + 1e-6
    held: dict[int, np.ndarray] = {}

    def by_words(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n1, n2 = kinds.n[i], kinds.n[j]
        long = (n1 > _SHORT) | (n2 > _SHORT)
        x, y = i[~long], j[~long]
        out = np.ones(len(i), bool)
        out[~long] = 2 * kinds.common.of(x, y) >= least * (n1 + n2)[~long] - 1e-9
        if long.any():
            x, y = kinds.pairs_of_words[i[long]], kinds.pairs_of_words[j[long]]
            out[long] = _missing(x, y) <= 2 * n1[long] + n2[long] - 1.5 * least * (n1 + n2)[long] + 1e-6
        return out

    def can_hold(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether texts of one kind can be within those of the other, by counts of letters."""
        out = np.zeros(len(i), bool)
        for x, y in ((i, j), (j, i)):
            gone = sum(np.bitwise_count(s[x] & ~s[y]).astype(np.int64) for s in kinds.signs)
            out |= gone <= _lost(np.minimum(kinds.longest[x], kinds.longest[y]), share)
        return out

    def by_parts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m1, m2 = kinds.m[i], kinds.m[j]
        small = np.minimum(m1, m2)
        out, short = np.ones(len(i), bool), (m1 <= _SHORT) & (m2 <= _SHORT)
        if short.any():
            used, at = np.unique(np.concatenate([i[short], j[short]]), return_inverse=True)
            x, y = np.split(at, 2)
            out[short] = _Common([texts[k] for k in used]).of(x, y) >= small[short] - _lost(small[short], share)
        for k in np.flatnonzero(~short):
            x, y = (i[k], j[k]) if m1[k] <= m2[k] else (j[k], i[k])
            for z in (x, y):
                if z not in held:
                    held[z] = _pair_bits([texts[z]], 8)
            gone = _missing(held[x], held[y])[0]
            out[k] = gone <= lost(m1[k] if m1[k] <= m2[k] else m2[k]) or (m1[k] == m2[k] and _missing(held[y], held[x])[0] <= lost(m1[k]))
        return out

    found = []
    several = np.flatnonzero(kinds.times > 1) if b is None else np.empty(0, np.int64)
    batches = [(several, several)] if len(several) else []
    for i, j in chain(batches, _near(kinds, b is None, least, sizes)):
        words = by_words(i, j)
        some = words | can_hold(i, j)
        for x, y, sure in _members(kinds, i[some], j[some], words[some]):
            sure[~sure] = by_parts(x[~sure], y[~sure])
            for k, q in zip(x[sure].tolist(), y[sure].tolist()):
                if (score := token_score(texts[k], texts[q], least)) >= least:
                    found.append((min(k, q), max(k, q) if b is None else q - len(a), score))
    return found
