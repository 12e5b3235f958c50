"""Fuzzy line dedup: one occurrence of each group of equal or nearly equal lines stays.

Lines are normalised (lower case, words only) and hashed; equal ones are one row from then on.
A distinct line's sketch has a byte for each of HASHES hashes: of the least of its shingles
under that hash. An edit changes few shingles, so similar lines agree on many bytes; lines are
grouped by blocks of three bytes, as a pigeonhole join does, and those of a group that agree on
enough bytes, and whose lengths allow it, are candidates. Lines of medium length have sketches of
shorter shingles, which an edit spoils less; lines of up to SHORT characters are grouped by what
deletions leave of them, which misses none. Lines that candidates' links connect come together
with their texts, and pairs whose edit similarity reaches SIMILARITY are linked. Of each
connected group the occurrence with the smallest (doc_id, text hash, line number) stays.

SimHashes in these blocks would find too little: at edit similarity 0.8 they differ in up to 12
bits of 64, whose exact pigeonhole join takes 455 tables of 13-bit keys (14 + 1 blocks, three alike).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import Forest, components, dealt_parts, dropped, merged, packed, pair_of_parts, probably_in, slices, stored, surely_out, tidy, unpacked
from lexispark.llm.simhash_dedup import _shared_groups

SIMILARITY = 0.8
#: Hashes of a sketch; beside them a byte has the length.
HASHES = 31


@dataclass(frozen=True)
class Class:
    """Lines of `least` to `most` characters: their shingles' bytes, tables, and on how many hashes candidates agree:

    on `nibbles` of 30 halves of bytes in a table, on `agree` whole bytes before texts are compared.

    Classes overlap by the factor SIMILARITY, so that two similar lines are together in one.
    """

    least: int
    most: int
    gram: int
    tables: int
    nibbles: int
    agree: int


#: Lines up to SHORT characters meet by deletions, longer ones by the sketches of their classes.
SHORT = 14
CLASSES = (Class(12, 48, 4, 20, 14, 11), Class(39, 1 << 31, 6, 12, 14, 13))
#: Groups up to this size are compared by shifts over the sorted stream.
SMALL = 128
#: Groups of candidates are verified in pairs of parts of SOME lines each; above CROWD lines by the keys that bring candidates together.
SOME, CROWD = 300, 3000

_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normalised(line: bytes) -> bytes:
    """A line, lower-cased before, as its words with single spaces: ASCII punctuation parts words."""
    return b" ".join(line.translate(_WORDS).split())


def _triples() -> np.ndarray:
    """Triples of places in a sketch for the class with the most tables; no two have more than one place in common."""
    rng, out = np.random.default_rng(24), []
    while len(out) < max(c.tables for c in CLASSES):
        new = set(rng.choice(HASHES, 3, replace=False).tolist())
        if all(len(new & x) < 2 for x in out):
            out.append(new)
    return np.array([sorted(x) for x in out])


_FACTORS = np.random.default_rng(42).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TRIPLES = _triples()


#: Bytes of lines that are sketched at a time: their hashes stay in a core's cache.
STRETCH = 1 << 16


def sketches(lines: list[bytes], gram: int) -> np.ndarray:
    """A row for each line: HASHES bytes for its set of `gram`-byte shingles, one for its length; 0 for less than a shingle."""
    out = np.zeros((len(lines), HASHES + 1), np.uint8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    full = np.flatnonzero(size >= gram)
    stretch = np.cumsum(size[full]) // STRETCH
    for some in np.split(full, np.flatnonzero(np.diff(stretch)) + 1) if len(full) else ():
        _sketch([lines[i] for i in some.tolist()], size[some], gram, out, some)
    return out


def _sketch(lines: list[bytes], size: np.ndarray, gram: int, out: np.ndarray, rows: np.ndarray) -> None:
    octets = np.frombuffer(b"".join(lines) + bytes(gram), np.uint8)
    heads = np.concatenate(([0], np.cumsum(octets & 0xC0 != 0x80)))
    octets = octets.astype(np.uint32)
    n = len(octets) - gram + 1
    h = octets[:n].copy()
    for k in range(1, gram):
        h *= np.uint32(0x01000193)
        h += octets[k : k + n]
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(15)
    start = np.cumsum(size) - size
    out[rows, HASHES] = np.minimum(16 * np.log2(np.maximum(heads[start + size] - heads[start], 1)), 255)  # in characters
    inside = np.ones(n, bool)  # not those that end in the next line
    for k in range(1, gram):
        inside[start[1:] - k] = False
    inside[start[-1] + size[-1] - gram + 1 :] = False
    h = h[inside]
    cuts = np.cumsum(size - gram + 1) - (size - gram + 1)
    mixed, least = np.empty_like(h), np.empty((HASHES, len(rows)), np.uint32)
    for k, factor in enumerate(_FACTORS):
        np.multiply(h, factor, out=mixed)
        np.minimum.reduceat(mixed, cuts, out=least[k])
    out[rows, :HASHES] = least.astype(np.uint8).T


def remainders(line: str) -> set[str]:
    """What is left of a short line when up to as many characters go as edits are allowed.

    Lines within d edits have a remainder in common after d deletions at most from each; of the
    shorter one so many fewer go as it is shorter, which its own length allows.
    """
    most = int((1 - SIMILARITY) * len(line) + 1e-9)
    return {"".join(line[i] for i in range(len(line)) if i not in gone) for k in range(most + 1) for gone in combinations(range(len(line)), k)}


def _stripped(a: str, b: str) -> tuple[str, str]:
    """Two texts without what they begin and end with in common, the shorter first."""
    n = min(len(a), len(b))
    low, high = 0, n + 1  # the common start is at least low, and less than high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid)
    a, b = a[: len(a) - low], b[: len(b) - low]
    return (b, a) if len(a) > len(b) else (a, b)


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


#: After these shares of a text's steps it is seen whether distances can still be small enough, if it has as many steps.
_LOOKS, _LONG = (0.5, 0.625, 0.75, 0.875), 64
#: Texts from so many characters on are first compared by their longest common subsequence, whose steps are four times
#: cheaper: a distance is at least what it leaves of the longer text.
_PLAIN = 24


def _bits(x: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)


def edit_distances(text: str, others: list[str], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of a text to several others.

    The others' bit vectors stand in one number, with a spare bit after each that takes carries:
    a step of the text is a few operations on that number, however many there are. With `most`
    the steps end when all distances are seen to be over it: then lower bounds over it are given.
    """
    size = np.fromiter(map(len, others), np.int64, len(others))
    codes = np.frombuffer("".join(x + "\0" for x in others).encode("utf-32-le", "surrogatepass"), np.uint32)
    spare = np.cumsum(size + 1) - 1
    field = np.ones(len(codes), bool)
    field[spare] = False
    first = np.zeros(len(codes), bool)
    first[spare - size] = size > 0
    full, low = _number(field), _number(first)
    where = {c: _number((codes == ord(c)) & field) for c in set(text)}
    if most is not None and len(text) >= _PLAIN:
        left = full
        for c in text:
            both = left & where[c]
            left = (left + both | left - both) & full
        ends = np.append(0, np.cumsum(_bits(left, len(codes))))
        least = np.maximum(len(text), size) - size + (ends[spare] - ends[spare - size])
        some = np.flatnonzero(least <= most)
        if len(some) < len(others):
            least[some] = edit_distances(text, [others[k] for k in some.tolist()], most[some]) if len(some) else 0
            return least
    up, down = full, 0
    looks = {int(len(text) * x) for x in _LOOKS} if most is not None and len(text) >= _LONG else ()
    for done, c in enumerate(text):
        if done in looks:  # a distance is at least the least of its column, and of what the lengths that are left differ by
            ends = np.cumsum(_bits(up, len(codes)) - _bits(down, len(codes)))
            heads = spare - size
            at = np.arange(len(codes)) - np.repeat(heads, size + 1) + 1
            least = ends - np.repeat(np.append(0, ends)[heads], size + 1) + np.abs(np.repeat(size, size + 1) - at - (len(text) - done))
            least[spare] = np.abs(size - (len(text) - done))
            if ((least := np.minimum.reduceat(least, heads) + done) > most).all():
                return least
        eq = where[c]
        same = (((eq & up) + up) ^ up) | eq | down
        h_up = down | full ^ (same | up) & full
        h_down = (up & same) << 1
        h_up = h_up << 1 | low
        eq |= down
        up = h_down & full | full ^ (eq | h_up) & full
        down = h_up & eq
    change = np.zeros(len(codes) + 1, np.int64)
    for x, sign in ((up, 1), (down, -1)):
        change[1:] += sign * np.cumsum(_bits(x, len(codes)))
    return len(text) + change[spare] - change[spare - size]


def edit_distance(a: str, b: str, most: float | None = None) -> int:
    """Levenshtein distance of two texts, by bit vectors as long as the shorter one's part that differs.

    With `most` a lower bound over it is given as soon as one is seen.
    """
    a, b = _stripped(a, b)
    where = _places(a)
    if most is not None and len(b) >= _PLAIN:
        if (least := len(b) - len(a) + _unmatched(len(a), b, where)) > most:
            return least
    return _steps(a, b, where, most)


def _places(text: str) -> dict[str, int]:
    """A number for each character of a text, with a bit for each of its places."""
    if len(text) > 1000:  # where adding a bit takes as long as the number
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return {c: _number(codes == ord(c)) for c in set(text)}
    where: dict[str, int] = {}
    for k, c in enumerate(text):
        where[c] = where.get(c, 0) | 1 << k
    return where


def _unmatched(size: int, b: str, where: dict[str, int], most: float | None = None) -> int | None:
    """How many characters of the text in `where` a longest common subsequence with b leaves.

    None as soon as it is seen to leave over `most` of b, each of which is an edit.
    """
    left = full = (1 << size) - 1
    for start, end in pairwise(int(len(b) * x) for x in ((0, 1) if most is None else (0, *_LOOKS, 1))):
        for c in b[start:end]:
            both = left & where.get(c, 0)
            left = left + both | left - both
        left &= full
        if most is not None and end - size + left.bit_count() > most:
            return None
    return left.bit_count()


def _within(a: str, b: str, most: float) -> bool:
    """Whether the distance of two texts is `most` at most.

    It is at least what a longest common subsequence leaves of the longer text, and at most what it
    leaves of both: only between the two are a distance's own steps taken.
    """
    a, b = _stripped(a, b)
    where = _places(a)
    if len(b) >= _PLAIN:
        left = _unmatched(len(a), b, where, most)
        if left is None or len(b) - len(a) + 2 * left <= most:
            return left is not None
    return _steps(a, b, where, most) <= most


def _steps(a: str, b: str, where: dict[str, int], most: float | None) -> int:
    """The distance of the text in `where` and one that is not shorter, with `most` as `edit_distance`."""
    full = (1 << len(a)) - 1
    up, down = full, 0
    looks = {int(len(b) * x) for x in _LOOKS} if most is not None and len(b) >= _LONG else ()
    for done, c in enumerate(b):
        if done in looks:
            column = np.append(0, np.cumsum(_bits(up, len(a)) - _bits(down, len(a)))) + done
            least = int((column + np.abs(len(a) - np.arange(len(a) + 1) - (len(b) - done))).min())
            if least > most:
                return least
        eq = where.get(c, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        h_up = (down | full ^ (same | up) & full) << 1 | 1
        eq |= down
        up, down = (up & same) << 1 & full | full ^ (eq | h_up) & full, h_up & eq & full
    return len(b) + up.bit_count() - down.bit_count()


#: Characters of an anchor, at which two texts are cut to bound their distance.
ANCHOR = 8


def _at_most(a: str, b: str, most: float) -> bool:
    """Whether cuts at common anchors show that the distance is `most` at most; False says nothing."""
    total, todo = 0, [(a, b)]
    while todo and total <= most:
        a, b = _stripped(*todo.pop())
        if len(a) <= 2 * ANCHOR:
            total += len(b)
            continue
        for share in (0.5, 0.25, 0.75):
            at = int(len(a) * share) - ANCHOR // 2
            anchor, near = a[at : at + ANCHOR], at + int((len(b) - len(a)) * share)
            after, before = b.find(anchor, max(near, 0)), b.rfind(anchor, 0, near + ANCHOR)
            if after >= 0 or before >= 0:
                k = after if before < 0 or 0 <= after - near < near - before else before
                todo += [(a[:at], b[:k]), (a[at + ANCHOR :], b[k + ANCHOR :])]
                break
        else:
            total += len(b)
    return total <= most


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    if abs(len(a) - len(b)) > (1 - least) * longest:
        return False
    most = (1 - least) * longest + 1e-9
    return longest == 0 or _at_most(a, b, most) or _within(a, b, most)


#: Lines that a line is compared with at a time.
TOGETHER = 64


def similar_links(lines: list[str], close: Callable[[int], tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the similar lines among the candidates: close(i) gives earlier lines, and how alike each seems.

    The likeliest candidate comes first and often joins two groups by cheap cuts; those that
    are left after it are compared together. What is in the line's own group by then is not.
    """
    forest, out = Forest(), []
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    for i in range(1, len(lines)):
        other, seems = close(i)
        if not len(other):
            continue
        most = (1 - least) * np.maximum(size[other], size[i]) + 1e-9
        fits = np.abs(size[other] - size[i]) <= most
        order = np.argsort(-seems[fits], kind="stable")
        todo, most, at, step = other[fits][order], most[fits][order], 0, 1
        while at < len(todo):
            own = forest.find(i)
            now = []
            while at < len(todo) and len(now) < step:
                if forest.find(j := int(todo[at])) != own:
                    now.append(at)
                at += 1
            if len(now) == 1:
                found = now if similar(lines[i], lines[int(todo[now[0]])], least) else []
            elif now:
                found = np.array(now)[edit_distances(lines[i], [lines[int(todo[k])] for k in now], most[now]) <= most[now]].tolist()
            else:
                found = []
            for k in found:
                if forest.join(i, int(todo[k])):
                    out.append((i, int(todo[k])))
            step = 1 if found else min(4 * step, TOGETHER)
    return out


def _lines(with_text: bool):
    """An Arrow function: a row for each line with words, with its place and hashes, or its normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                marks, counts, places, joined = [], [], [], []
                for text in part.column("text").to_pylist():
                    mark, lines = 0, []
                    if text:
                        mark = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
                        lines = _normalised_lines(text.lower().encode("utf-8", "surrogatepass"))
                    found = [i for i, line in enumerate(lines) if line]
                    marks.append(mark - ((mark >> 63) << 64))
                    counts.append(len(found))
                    places += found
                    joined += filter(None, lines)
                keys = np.frombuffer(b"".join(map(_digest, joined)), np.int64).reshape(-1, 2)
                columns, rows = [pa.array(keys[:, 0]), pa.array(keys[:, 1])], pa.array(np.repeat(np.arange(len(part)), counts))
                if with_text:
                    texts = pa.array(joined, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, texts, part.column("doc_id").take(rows)], names=["k1", "k2", "line", "doc_id"])
                else:
                    texts = [x.decode("utf-8", "surrogatepass") if len(x) <= 4 * SHORT else None for x in joined]
                    short = pa.array([x if x and len(x) <= SHORT else None for x in texts], pa.string())
                    columns += _sketched(joined)
                    columns += [short, part.column("doc_id").take(rows), pa.array(marks, pa.int64()).take(rows), pa.array(places, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", *SKETCH, "short", "doc_id", "mark", "line_no"])

    return run


#: Bytes of a character after its first.
_LATER = bytes(range(0x80, 0xC0))
#: As _WORDS, but line ends stay.
_WORDS_KEEP = _WORDS[:10] + b"\n" + _WORDS[11:]


def _normalised_lines(text: bytes) -> list[bytes]:
    """`normalised` of each line of a text, for all lines at once."""
    text = text.translate(_WORDS_KEEP)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


#: Columns of the sketches of each class, eight bytes each, null for a line that isn't of the class; and of the rows of tables.
_OF = tuple(tuple(f"s{c}{i}" for i in range((HASHES + 1) // 8)) for c in range(len(CLASSES)))
SKETCH = tuple(chain.from_iterable(_OF))
_SKETCH = ", ".join(f"{c} long" for c in SKETCH)


def _sketched(lines: list[bytes]) -> list[pa.Array]:
    """The columns SKETCH of lines."""
    chars = np.fromiter((len(x) if x.isascii() else len(x.translate(None, _LATER)) for x in lines), np.int64, len(lines))
    out = []
    for c in CLASSES:
        some = np.flatnonzero((chars >= c.least) & (chars <= c.most))
        codes = np.zeros((len(lines), HASHES + 1), np.uint8)
        codes[some] = sketches([lines[i] for i in some.tolist()], c.gram)
        none = np.ones(len(lines), bool)
        none[some] = False
        out += [pa.array(np.ascontiguousarray(x), mask=none) for x in codes.view(np.int64).T]
    return out


def _digest(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


#: A row of a table, as it is packed with others for the shuffle; and the bits of buckets of keys, which are what is shuffled by.
_ROW = np.dtype([("key", "<i4"), ("node", "<i8"), ("low", "<i8"), ("high", "<i8")])
_PACKED = "bucket int, rows binary"
BUCKETS = 12
#: Buckets are compared together up to so many rows.
AT_ONCE = 1 << 17


def _in_buckets(parts: list[tuple]) -> pa.RecordBatch:
    """A row for each bucket: the rows (key, node, low, high) whose keys are in it, packed. As rows of their own they'd take Spark longer than the search."""
    rows = np.empty(sum(len(x[0]) for x in parts), _ROW)
    for name, pieces in zip(_ROW.names, zip(*parts, strict=True), strict=True) if parts else ():
        rows[name] = np.concatenate(pieces)
    bucket = (rows["key"].astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    ends = pa.array(np.append(cuts, len(bucket)).astype(np.int64) * _ROW.itemsize, pa.int64())
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, ends.buffers()[1], pa.py_buffer(rows[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), held.cast(pa.binary())], names=["bucket", "rows"])


def _to_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line's row in each table of its classes, with its sketch; keys from 0 on, as remainders' are negative."""
    for whole in batches:
        first, parts = 0, []
        for kind, names in zip(CLASSES, _OF, strict=True):
            batch = whole.filter(whole.column(names[0]).is_valid())
            codes = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]).view(np.uint8)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            parts += [((t << 24) | key, node, *_nibbles(codes)) for t, key in enumerate(_keys(codes, kind.tables).T, first)]
            first += kind.tables
        yield _in_buckets(parts)


def _keys(codes: np.ndarray, tables: int) -> np.ndarray:
    """A column for each table: the three bytes of a sketch that are the key in it."""
    a, b, c = (codes[:, x].astype(np.int32) for x in _TRIPLES[:tables].T)
    return a << 16 | b << 8 | c


def _nibbles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches for the rows of tables: four bits of all hashes but one, the length's eight on top."""
    half = (codes.view(np.uint64) & np.uint64(0x0F0F0F0F0F0F0F0F)).reshape(-1, (HASHES + 1) // 8)
    low, high = half[:, 0] | half[:, 1] << np.uint64(4), half[:, 2] | half[:, 3] << np.uint64(4)
    mask, size = np.uint64((1 << 60) - 1), codes[:, HASHES].astype(np.uint64)
    # The last hash's nibble is the length's place in one number, and makes way for it; in the other the top one does.
    return ((low & mask) | size << np.uint64(60)).view(np.int64), ((high & mask) | (size >> np.uint64(4)) << np.uint64(60)).view(np.int64)


def _sizes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return ((low.view(np.uint64) >> np.uint64(60)) | (high.view(np.uint64) >> np.uint64(60)) << np.uint64(4)).astype(np.int16)


def _near(low: np.ndarray, high: np.ndarray, i, j, agree) -> np.ndarray:
    """Which rows i agree with rows j (or one row) on `agree` of 30 nibbles, their lengths not too far apart."""
    return _alike(*(x[k] for k in (i, j) for x in (low, high, _sizes(low, high))), agree)


def _alike(low: np.ndarray, high: np.ndarray, size: np.ndarray, low_: np.ndarray, high_: np.ndarray, size_: np.ndarray, agree) -> np.ndarray:
    """As `_near`, of rows beside each other."""
    differ = None
    for x, y in ((low, low_), (high, high_)):
        x = (x ^ y).view(np.uint64)
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        x &= np.uint64(0x0111111111111111)
        differ = x if differ is None else differ << np.uint64(1) | x
    return (30 - np.bitwise_count(differ).astype(np.int8) >= agree) & (np.abs(size - size_) <= _STEPS)


def _to_remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each remainder of a short line; the remainder's hash stands for the sketch, so that only equal ones are alike."""
    for batch in batches:
        nodes, hashes = [], []
        for node, line in zip(batch.column("node").to_pylist(), batch.column("short").to_pylist(), strict=True):
            found = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in remainders(line)]
            nodes += [node] * len(found)
            hashes += found
        name = np.array(hashes, np.uint64)
        key = -1 - (name >> np.uint64(33)).astype(np.int32)
        yield _in_buckets([(key, np.array(nodes, np.int64), *[name.view(np.int64)] * 2)])


#: How far length bytes may be apart: 0.8 is 5.2 of their steps, and both are rounded down.
_STEPS = int(np.ceil(-16 * np.log2(SIMILARITY)))


#: On how many hashes candidates agree, by the table that leads their key; remainders are equal or not.
_AGREE = np.array([c.nibbles for c in CLASSES for _ in range(c.tables)] + [30], np.int8)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The packed rows of whole buckets (sorted by bucket) as columns, sorted by key."""
    now, held, size = None, [], 0

    def unpack() -> list[np.ndarray]:
        rows = np.frombuffer(b"".join(held), _ROW)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        return [np.ascontiguousarray(rows[c]) for c in _ROW.names]

    for batch in batches:
        for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            if bucket != now and size >= AT_ONCE:
                yield unpack()
                held, size = [], 0
            now = bucket
            held.append(rows.as_py())
            size += len(held[-1]) // _ROW.itemsize
    if held:
        yield unpack()


def _stars(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Links of the nodes that links between places i and j connect, all to the least of them: `components` settles these soonest."""
    label = merged(np.arange(len(node)), i, j)[0]
    some = np.unique(np.concatenate([i, j]))
    some = some[np.lexsort((node[some], label[some]))]
    first = np.append(True, label[some[1:]] != label[some[:-1]])[: len(some)]
    least = node[some[first]][np.cumsum(first) - 1]
    away = node[some] != least
    return pa.RecordBatch.from_arrays([pa.array(node[some[away]]), pa.array(least[away])], names=["src", "dst"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the candidates in each group (sorted by bucket)."""
    for columns in _by_key(batches):
        places, starts = _shared_groups(columns[:1])
        if not len(places):
            continue
        key, node, low, high = (x[places] for x in columns)
        agree = _AGREE[np.maximum(key >> 24, -1)]
        ends = np.append(starts[1:], len(key))
        sizes = ends - starts
        size = _sizes(low, high)
        g = np.repeat(np.arange(len(starts)), sizes)
        label, found, held, out = np.arange(len(key)), [], 0, []
        left, last = np.flatnonzero(sizes[g] <= SMALL), ends[g]
        for d in range(1, SMALL):  # each row with the d-th after it in its group
            left = left[left + d < last[left]]
            if not len(left):
                break
            other = left + d
            at = left[_alike(low[left], high[left], size[left], low[other], high[other], size[other], agree[left])]
            found.append((at, at + d))
            held += len(at)
            if held >= AT_ONCE:
                label, *taken = merged(label, *map(np.concatenate, zip(*found, strict=True)))
                out.append(taken)
                found, held = [], 0
        if held:
            out.append(merged(label, *map(np.concatenate, zip(*found, strict=True)))[1:])
        for k in np.flatnonzero(sizes > SMALL):
            left, todo = np.arange(starts[k], ends[k]), []
            while len(left) or todo:
                if not todo:
                    todo.append(int(left[0]))
                    left = left[1:]
                i = todo.pop()
                hit = _alike(low[left], high[left], size[left], low[i], high[i], size[i], agree[i])
                near, left = left[hit], left[~hit]
                out.append((np.full(len(near), i), near))
                todo.extend(near.tolist())
        if out:
            yield _stars(node, *map(np.concatenate, zip(*out, strict=True)))


def candidate_links(lines: DataFrame, shorts: DataFrame) -> DataFrame:
    """(src, dst) links that connect candidates among lines (node, sketches) and short ones (node, short)."""
    ranks = lines.mapInArrow(tidy(_to_bands), _PACKED).unionByName(shorts.mapInArrow(tidy(_to_remainders), _PACKED))
    return ranks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_candidates), "src long, dst long")


def _to_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of a line (root, node, sketches, line): the keys under which `candidate_links` groups it.

    `part` is the key, `met` its table in both classes' order, -1 for remainders.
    """
    for whole in batches:
        for batch in (whole.slice(a, b - a) for a, b in slices(whole.column("line"), 1 << 17)):
            names, first = [c for c in batch.schema.names if c not in ("part", "met")], 0
            for kind, own in zip(CLASSES, _OF, strict=True):
                some = batch.filter(batch.column(own[0]).is_valid())
                if len(some):
                    codes = np.column_stack([some.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in own]).view(np.uint8)
                    for t, key in enumerate(_keys(codes, kind.tables).T, first):
                        part, met = pa.array(t << 24 | key.astype(np.int64)), pa.array(np.full(len(some), t, np.int32))
                        yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), part, met], names=[*names, "part", "met"])
                first += kind.tables
            where, part = [], []
            for i, line in enumerate(batch.column("line").to_pylist()):
                if len(line) <= SHORT:
                    found = [-1 - (xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1) for x in remainders(line)]
                    where += [i] * len(found)
                    part += found
            if where:
                some = batch.take(pa.array(where))
                met = pa.array(np.full(len(where), -1, np.int32))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(part, pa.int64()), met], names=[*names, "part", "met"])


def meetings(crowd: DataFrame) -> DataFrame:
    """A row for each key of the lines of large groups (root, node, sketches, line): as many for a line as it has tables, however large its group."""
    made = f"root long, node long, {_SKETCH}, line string, part long, met int"
    return crowd.select("root", "node", *SKETCH, "line").mapInArrow(tidy(_to_meetings), made).withColumn("own", F.lit(0))


#: The class of each table, and its place among those of its class.
_TABLES = [(k, t) for k, c in enumerate(CLASSES) for t in range(c.tables)]


def _same(codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """On how many hashes each sketch (a row of 64-bit numbers) agrees with each of others, or with its own of as many."""
    differ, most = codes ^ others, np.uint64(0x7F7F7F7F7F7F7F7F)
    differ |= (differ & most) + most
    differ &= ~most
    differ[..., -1] &= np.uint64((1 << 56) - 1)  # the last byte is the length's
    return HASHES - np.bitwise_count(differ).sum(axis=-1, dtype=np.int16)


#: Pairs of lines whose sketches are compared at a time.
PAIRS = 1 << 14


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the similar lines in each part of a group (sorted by group and part).

    In pairs of parts (`met` is null) all pairs are compared that agree on enough bytes. In a part
    of a large group, which is a key, only those that no earlier table brings together.
    """

    def solve(lines: list[str], size: np.ndarray, part: np.ndarray, met: int | None, sketched: list[tuple]) -> list[tuple[int, int]]:
        several = (part != part[0]).any()
        if met is not None:
            sketched = [sketched[_TABLES[met][0]]] if met >= 0 else []
        before = _keys(np.ascontiguousarray(sketched[0][2]).view(np.uint8), _TABLES[met][1]) if met is not None and met >= 0 else None
        shorts = met is None or met < 0
        seems, first = np.empty((0, 0), np.int16), 0

        def close(i: int) -> tuple[np.ndarray, np.ndarray]:
            nonlocal seems, first
            if i >= first + len(seems):  # of as many lines at once as PAIRS allows
                first, end = i, min(len(lines), i + max(1, PAIRS // len(lines)))
                brief = size[:end] <= SHORT
                seems = (brief[first:, None] & brief if shorts else np.zeros((end - first, end), bool)).astype(np.int16)
                for agree, has, codes in sketched:
                    same = _same(codes[first:end, None], codes[None, :end])
                    same[(same < agree) | ~(has[first:end, None] & has[:end])] = 0
                    seems = np.maximum(seems, same)
            row = seems[i - first, :i]
            other = np.flatnonzero(row)
            if several:  # pairs inside a part are compared where it meets itself
                other = other[part[other] != part[i]]
            if before is not None:
                other = other[~(before[other] == before[i]).any(axis=1)]
            return other, row[other]

        return similar_links(lines, close)

    def solved(whole: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(whole)
        group, part, own, node = (table.column(c).to_numpy() for c in ("root", "part", "own", "node"))
        lines, met = table.column("line").to_pylist(), table.column("met").to_pylist()
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        sketched = []
        for kind, names in zip(CLASSES, _OF, strict=True):
            codes = np.column_stack([table.column(c).fill_null(0).to_numpy() for c in names]).view(np.uint64)
            sketched.append((kind.agree, table.column(names[0]).is_valid().to_numpy(), codes))
        starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
        ends = np.append(starts[1:], len(lines))
        two = starts[ends - starts == 2]  # most groups: whether they are to be compared is seen for all at once
        near = (size[two] <= SHORT) & (size[two + 1] <= SHORT)
        for agree, has, codes in sketched:
            near |= has[two] & has[two + 1] & (_same(codes[two], codes[two + 1]) >= agree)
        near, out = dict(zip(two.tolist(), near.tolist(), strict=True)), []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a == 2 and met[a] is None:
                if near[a] and similar(lines[a], lines[a + 1]):
                    out.append((a + 1, a))
            elif b - a > 1:
                links = solve(lines[a:b], size[a:b], own[a:b], met[a], [(agree, has[a:b], codes[a:b]) for agree, has, codes in sketched])
                out += [(a + i, a + j) for i, j in links]
        return _stars(node, *np.array(out, np.int64).reshape(-1, 2).T)

    now, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        group, part = (batch.column(c).to_numpy() for c in ("root", "part"))
        first = np.flatnonzero(np.append((group[0], part[0]) != now, (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
        if len(first):  # the last group may go on in the next batch
            if whole := [x for x in (*held, batch.slice(0, first[-1])) if len(x)]:
                yield solved(whole)
            held, batch = [], batch.slice(first[-1])
        held.append(batch)
        now = group[-1], part[-1]
    if held:
        yield solved(held)


def occurrences(docs: DataFrame) -> DataFrame:
    """(k1, k2, sketches, short, doc_id, mark, line_no) of every line that has words; short is its text if that is short."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidy(_lines(False)), f"k1 long, k2 long, {_SKETCH}, short string, doc_id long, mark long, line_no int")


def similar_groups(docs: DataFrame, distinct: DataFrame, shorts: DataFrame) -> DataFrame:
    """(node, component) of distinct lines (k1, k2, sketches, holder) that similar lines connect.

    A line's node is 64 bits of its 128-bit key; `holder` is the id of a document that has it.
    `shorts` has the short lines (node, short).
    """
    links = candidate_links(distinct.select(F.col("k1").alias("node"), *SKETCH), shorts)
    near = stored(components(links).select("node", F.col("component").alias("root")), "line-roots")
    nodes = probably_in(distinct, F.col("k1"), near, F.col("node")).join(near, F.col("k1") == F.col("node"))
    nodes = stored(nodes.select("k1", "k2", *SKETCH, "root", "holder"), "line-candidates")
    parts = nodes.groupBy("root").agg(F.when(F.count("*") <= CROWD, F.ceil(F.count("*") / SOME).cast("int")).alias("parts"))
    # The lines' texts come from one document each: only those are split again.
    holders = probably_in(docs.select(F.col("doc_id").cast("long"), "text"), F.col("doc_id"), nodes, F.col("holder"))
    texts = holders.mapInArrow(tidy(_lines(True)), "k1 long, k2 long, line string, doc_id long")
    texts = probably_in(texts, F.struct("k1", "doc_id"), nodes, F.struct("k1", F.col("holder").alias("doc_id")))
    # No semi-join here: Spark would make it before the bitmap, and shuffle all lines of the holders.
    texts = texts.groupBy("k1", "k2").agg(F.first("line").alias("line"))
    known = stored(nodes.join(texts, ["k1", "k2"]).join(parts, "root").select("root", F.col("k1").alias("node"), "k2", *SKETCH, "line", "parts"), "line-texts")
    dealt = known.where("parts is not null").select("root", "node", *SKETCH, "line", *dealt_parts(F.col("k2")))
    dealt = dealt.select("root", pair_of_parts().cast("long"), "own", "node", *SKETCH, "line", F.lit(None).cast("int").alias("met")).unionByName(meetings(known.where("parts is null")))
    dealt = dealt.repartition("root", "part").sortWithinPartitions("root", "part", "node")
    found = components(dealt.mapInArrow(tidy(_verify), "src long, dst long"))
    dropped(near, nodes, known)
    return found


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, drop, again) of each text that is not whole and single.

    drop holds the numbers of the lines that go; again says that rows repeat the id with its text.
    """
    rows = stored(occurrences(docs), "lines")
    same = [F.first(c).alias(c) for c in SKETCH]  # equal in all rows of a key
    distinct = rows.groupBy("k1", "k2").agg(*same, F.min("doc_id").alias("holder"), F.count("*").alias("n"))
    distinct = stored(distinct, "distinct-lines")
    shorts = rows.where("short is not null").select(F.col("k1").alias("node"), "short").distinct()
    found = similar_groups(docs, distinct, shorts)
    found = stored(found, "similar-lines")
    fuzzy = probably_in(distinct, F.col("k1"), found, F.col("node")).join(found, F.col("k1") == F.col("node")).select("k1", "k2", F.col("component").alias("line_group"))
    exact = distinct.where("n > 1").join(found, F.col("k1") == F.col("node"), "left_anti").select("k1", "k2", F.col("k1").alias("line_group"))
    groups = stored(fuzzy.unionByName(exact), "line-groups")
    dropped(distinct, found)
    some = probably_in(rows.select("k1", "k2", "doc_id", "mark", "line_no"), F.col("k1"), groups, F.col("k1"))
    members = stored(some.join(groups, ["k1", "k2"]).select("line_group", "doc_id", "mark", "line_no"), "line-members")
    dropped(rows, groups)
    place = F.struct("doc_id", "mark", "line_no")
    # Stored, so that the join below deals both sides anew and can split a line with very many occurrences.
    best = stored(members.groupBy("line_group").agg(F.min(place).alias("best")), "line-firsts")
    gone = members.join(best, "line_group").groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.when(~place.eqNullSafe(F.col("best")), F.col("line_no")))).alias("drop"),
        (F.count("*") > F.size(F.collect_set("line_no"))).alias("again"),
    )
    gone = stored(gone.where("again or size(drop) > 0"), "line-drops")
    dropped(members, best)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with its text less the repeated lines, and n_lines, n_dropped (long) beside it.

    Lines are parted by line feeds. Lines without words are no repeats and stay. Null and empty
    texts stay as they are (no lines, one line). Columns called n_lines or n_dropped are replaced. Of rows that repeat an id with its text, the
    first is the document and the others lose every line that has words. Other columns stay;
    an empty table gives no rows.
    """
    # Structs are equal where both lack an id, and joining and numbering by the same column takes one shuffle of the texts,
    # if both sides' structs have the same type: else one is cast for the join, and the texts are shuffled again.
    gone = repeats(docs).select(F.struct("doc_id", "mark").alias("gone_place"), F.col("mark").alias("gone_mark"), "drop", "again")
    keyed = packed(docs, "doc_id", "text").withColumn("mark_", F.xxhash64("text"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Texts that keep all their lines pass by the shuffle.
    whole = surely_out(keyed, F.col("mark_"), gone, F.col("gone_mark"))
    whole = whole.select(*unpacked(columns, doc_id=F.col("doc_id"), text=F.col("text")), _n_lines(F.col("text")).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    some = probably_in(keyed, F.col("mark_"), gone, F.col("gone_mark"))
    some = some.withColumn("place_", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("mark_").alias("mark")).cast("struct<doc_id:bigint,mark:bigint>"))
    joined = some.join(gone, F.col("place_") == F.col("gone_place"), "left")
    w = Window.partitionBy("place_").orderBy("place_")
    lines = F.split("text", "\n", -1)
    has_words = F.filter(F.sequence(F.lit(0), F.size("lines_") - 1), lambda i: _wordy(F.get("lines_", i)))
    drop = F.when(F.col("again") & (F.col("copy_") > 1), has_words).otherwise(F.coalesce("drop", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), "drop_")
    text = F.when(F.size("drop_") > 0, F.array_join(F.transform(kept, lambda i: F.get("lines_", i)), "\n")).otherwise(F.col("text"))
    changed = joined.withColumn("copy_", F.row_number().over(w)).withColumn("lines_", lines).withColumn("drop_", drop)
    changed = changed.select(*unpacked(columns, doc_id=F.col("doc_id"), text=text), _n_lines(F.col("text")).alias("n_lines"), F.size("drop_").cast("long").alias("n_dropped"))
    return whole.unionByName(changed)


def _n_lines(text: Column) -> Column:
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce(feeds + 1, F.lit(0)).cast("long")


def _wordy(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[A-Za-z0-9]|[^\x00-\x7F]"))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with its texts less the repeated lines; rows of which no words are left go.

    A column n_chars, if there is one, counts the code points that are left in a changed text.
    """
    out = dedup_lines(packed(docs, "doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])))
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long") if "n_chars" in docs.columns else None
    kept = out.where((F.col("n_dropped") == 0) | _wordy(F.col("text")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | ({} if changed is None else {"n_chars": changed})
    return kept.select(*unpacked(docs.columns, **own))
