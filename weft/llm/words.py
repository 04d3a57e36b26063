"""Words, shingles and their 64-bit names, straight from UTF-8 bytes with numpy."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    return _powers(size)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which ``span_names`` names any span of the bytes."""
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


#: Bytes that stand behind each place of ``mixed_sums``.
EIGHT = 8


def mixed_sums(raw: np.ndarray) -> np.ndarray:
    """As ``prefix_sums``, of the mixed ``EIGHT`` bytes from each place on instead of the byte: a span's names by the two are
    independent. ``span_names`` takes ends that lie EIGHT - 1 places before the span's own."""
    out = np.zeros(len(raw) + 1, _U)
    padded = np.zeros(len(raw) + EIGHT, np.uint8)
    padded[: len(raw)] = raw
    values = np.ndarray((len(raw),), "<u8", padded.data, 0, (1,))
    np.cumsum(mix(values + _U(0x9E3779B97F4A7C15)) * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def span_names(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte spans [start, end): equal bytes, equal names.

    For spans that overlap and features; where unequal bytes must not share a name whatever they are, take ``hashed``.
    """
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


#: Spans above so many bytes are hashed one at a time.
_LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit names of byte spans by hashing eight bytes after another; unlike ``span_names`` no sum, so that no
    two texts share a name under every seed. Costs a step for each eight bytes of the longest span up to 64 bytes."""
    size = ends - starts
    out = mix(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    at = np.flatnonzero(size <= _LONG)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    done = 0
    while len(at := at[size[at] > done]):
        word = eight[starts[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]
        out[at] = mix(out[at] * _U(0xA24BAED4963EE407) ^ word)
        done += 8
    return out


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs outside white space (0x20, 0x09 to 0x0D)."""
    ins = ~_SPACE[raw] if inside is None else inside
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = ins.copy()
    start[1:] &= ~ins[:-1] | edge[1:-1]
    end = ins.copy()
    end[:-1] &= ~ins[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def normalised(column: pa.Array) -> pa.Array:
    """Lower-case texts whose words (letters, marks, digits) stand between single spaces."""
    column = pc.utf8_lower(column.fill_null("").cast(pa.string()))
    return pc.replace_substring_regex(column, r"[^\pL\pM\pN]+", " ")


def word_names(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts, ends and text numbers of the words."""
    starts, ends, doc = spans(raw, offsets)
    return hashed(raw, starts, ends), starts, ends, doc


def chain(names: np.ndarray, n: int) -> np.ndarray:
    """Names of the n-grams that start at each name but the last n-1; text bounds are the caller's matter."""
    size = len(names) - n + 1
    if size <= 0:
        return np.zeros(0, _U)
    h = np.zeros(size, _U)
    for k in range(n):
        h = h * _U(0xA24BAED4963EE407) + names[k : k + size]
    return mix(h)


def shingle_sets(names: np.ndarray, doc: np.ndarray, texts: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The set of n-word shingles of each text, end to end, with texts+1 offsets.

    A text of fewer than n words, but at least one, has the shingle of all its words.
    """
    grams = chain(names, n)
    whole = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    grams, of = grams[whole], doc[: len(whole)][whole]
    count = np.bincount(doc, minlength=texts)
    if (short := np.flatnonzero((count > 0) & (count < n))).size:
        first = np.searchsorted(doc, short)
        extra = np.array([chain(names[a : a + count[d]], int(count[d]))[0] for a, d in zip(first, short, strict=True)], _U)
        grams, of = np.concatenate([grams, extra]), np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(texts + 1))


def per_text(values: np.ndarray, offsets: np.ndarray, ufunc=np.add) -> np.ndarray:
    """Reduce the values of each text; a text without values gives 0."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if full.size:
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out
