"""Benchmark decontamination by canonical templates.

Words become lower-case literals without outer punctuation, or typed placeholders: numbers, units that
follow a number, and names (capitalised words; those that begin a sentence are literals as well). Windows of the canonical
words are hash-joined with those of the benchmark, and so are windows of the plain words, which find
verbatim passages of few literals; an item shorter than a window is one window. Matching windows on one diagonal form an alignment;
it counts when it is consistent: equal slot values of the item meet equal values in the document, and
different names different names. So a question with other numbers or names is found, and two texts that
only share a frame of placeholders are not.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, store

ITEMS_AT_ONCE = 512  # items that a text is aligned with together
WINDOW = 12
LEAST_LITERALS = 8  # in a window
FEWEST_LITERALS = 4  # in a window of an item none of whose windows has more
PART_BITS = 17
# Bits for each place of a window in the filter that is broadcast, and 2**30 (128 MB) at most: one window in a million that
# isn't the benchmark's passes, up to a million windows. Of pairs, which only spare work, there are 2**26 at most.
WINDOW_ROOM, WINDOW_BITS = 512, 30
PAIR_ROOM, PAIR_BITS = 16, 26
CHUNK = 1 << 15  # windows whose choices of names are worked out at once
GAPS = (1, 2, 3)
NUMBER, UNIT, NAME = np.uint64(11), np.uint64(13), np.uint64(17)
UNITS = "% km m cm mm mi ft in kg g mg lb oz l ml s sec min h hr hrs hours minutes seconds days weeks months years miles meters metres feet inches grams pounds euros dollars cents usd eur gbp percent degrees kmh mph kb mb gb tb".split()
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _unit_codes() -> np.ndarray:
    part = next(blocks.slices(pa.array([" ".join(u for u in UNITS if u != "%")])))
    return np.sort(blocks.word_hashes(part.data, blocks.words(part)))


@dataclass
class Canonical:
    codes: np.ndarray  # literal hashes, or NUMBER, UNIT, NAME
    values: np.ndarray  # hashes of the words as they stand, outer punctuation apart
    plain: np.ndarray  # hashes of the lower-case words, whatever they stand for
    either: np.ndarray  # capitalised words that begin a sentence: coded as literals, and names as well
    of: np.ndarray

    def pairs(self, gap: int) -> np.ndarray:
        """A hash of each word and the one gap words on."""
        return blocks.mix(self.codes[:-gap] * np.uint64(2 * gap + 1) + blocks.mix(self.codes[gap:]))

    def settled(self, known: np.ndarray) -> Canonical:
        """The same with words that are no word of the benchmark as names only, where they may be names."""
        only = self.either & ~known[(blocks.mix(self.codes) & np.uint64(len(known) - 1)).astype(np.int64)]
        return Canonical(np.where(only, NAME, self.codes), self.values, self.plain, self.either & ~only, self.of)

    def foreign(self, known: np.ndarray) -> list[np.ndarray]:
        """For each gap, running counts of pairs that no passage of the benchmark can have; names are left open."""
        fixed = ~self.either & (self.codes != NAME)
        return [np.r_[0, np.cumsum(fixed[:-gap] & fixed[gap:] & ~known[(self.pairs(gap) & np.uint64(len(known) - 1)).astype(np.int64)])] for gap in GAPS]

    def literals(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window lies inside a row, and how many of its words are literals."""
        literal = np.r_[0, np.cumsum(self.codes > NAME)]
        return blocks.whole(self.of, len(self.codes), size), literal[size:] - literal[:-size]

    def windows(self, size: int, least: int, fewest: int, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, hash) of the windows inside a row: plain ones, and canonical ones with at least `fewest` literals.

        A window comes again for each choice of its words that may be names and leaves `least` literals. With
        known, the pairs of the benchmark, windows with a pair that is not among them are not tried further.
        """
        n = len(self.codes) - size + 1
        if n <= 0:
            return
        whole, literals = self.literals(size)
        plain = np.flatnonzero(whole & (literals < size))  # without slots it is the canonical one
        yield plain, blocks.window_hashes(self.plain, size)[plain]
        many = np.flatnonzero(whole & (literals >= fewest))
        yield many, blocks.window_hashes(self.codes, size)[many]
        many = many[literals[many] >= least]
        either = np.r_[0, np.cumsum(self.either)]
        free = np.minimum(either[size:] - either[:-size], literals - least)
        place = np.flatnonzero(self.either)
        many = many[free[many] > 0]
        if known is not None and len(many):
            for gap, count in zip(GAPS, self.foreign(known), strict=True):
                if gap < size:
                    many = many[count[many + size - gap] == count[many]]
        for at in range(0, len(many), CHUNK):
            start = many[at : at + CHUNK]
            count = either[start + size] - either[start]
            for k in np.unique(count).tolist():
                own = start[count == k]
                where = place[either[own][:, None] + np.arange(k)] - own[:, None]
                for names in range(1, int(free[own].max()) + 1):
                    some = free[own] >= names
                    codes = self.codes[own[some][:, None] + np.arange(size)]
                    for chosen in combinations(range(k), names):
                        changed = codes.copy()
                        changed[np.arange(len(codes))[:, None], where[some][:, chosen]] = NAME
                        yield own[some], blocks.window_hashes(changed.ravel(), size)[::size]

    def cut(self, low: int, high: int) -> Canonical:
        return Canonical(self.codes[low:high], self.values[low:high], self.plain[low:high], self.either[low:high], np.array([0, high - low]))


def canonical(part: blocks.Slice) -> Canonical:
    found = blocks.words(part)
    if not len(found.start):
        return Canonical(*[np.zeros(0, np.uint64)] * 3, np.zeros(0, bool), found.of)
    data, low = part.data, blocks.lowered(part.data)
    # Outer punctuation goes; of a word of nothing else its last character stays.
    solid = np.flatnonzero(~_PUNCT[data])
    ahead, behind = np.searchsorted(solid, found.start), np.searchsorted(solid, found.end) - 1
    some = behind >= ahead
    start, end = found.end - 1, found.end.copy()
    start[some], end[some] = solid[ahead[some]], solid[behind[some]] + 1
    plain = blocks.range_hashes(blocks.byte_codes(low), start, end)
    codes = plain.copy()
    values = blocks.range_hashes(blocks.byte_codes(data), start, end)
    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    number = digits[end] > digits[start]
    stops = np.r_[0, np.cumsum(_STOP[data])]
    opens = np.ones(len(start), bool)  # words that begin a row or a sentence
    opens[1:] = stops[found.end[:-1]] > stops[end[:-1]]
    first = found.of[:-1]
    opens[first[first < len(start)]] = True
    # upper-case letters of two bytes in UTF-8: C3 80 to C3 9E
    wide = (data[start] == 0xC3) & (data[np.minimum(start + 1, len(data) - 1)] >= 0x80) & (data[np.minimum(start + 1, len(data) - 1)] <= 0x9E)
    capital = _UPPER[data[start]] | wide
    name = capital & ~opens
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & np.isin(codes[1:], _unit_codes())
    codes[name] = NAME
    codes[unit] = UNIT
    codes[number] = NUMBER
    return Canonical(codes, values, plain, capital & opens & (codes > NAME), found.of)


@dataclass
class Table:
    """Windows of benchmark items: by size, their sorted hashes with item and start. Short items have their own size."""

    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    items: list[Canonical]
    pairs: np.ndarray  # by the low bits of its hash, whether a code or a pair of codes may occur


def _literals(own: int, size: int, least: int) -> int:
    """The literals that a window of own words needs: the same part of it."""
    return -(-least * own // size)


def _windows(can: Canonical, size: int, least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(size, start, hash) of an item's windows; an item shorter than a window is one window."""
    own = min(size, len(can.codes))
    if not own:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    enough, fewest = _literals(own, size, least), _literals(own, size, min(least, FEWEST_LITERALS))
    most = int(can.literals(own)[1].max())  # of an item of many numbers and names the windows with most literals stand for it
    return own, *map(np.concatenate, zip(*can.windows(own, enough, enough if most >= enough else max(fewest, most)), strict=True))


def _pairs(can: Canonical) -> np.ndarray:
    return np.concatenate([blocks.mix(can.codes), *[can.pairs(gap) for gap in GAPS]])


def _table(items: list[Canonical], size: int, least: int) -> Table:
    held = [(i, *_windows(can, size, least)) for i, can in enumerate(items)]
    sizes = {}
    for own in sorted({h[1] for h in held} - {0}):
        some = [(i, start, hashes) for i, n, start, hashes in held if n == own]
        hashes = np.concatenate([h for _, _, h in some])
        order = np.argsort(hashes, kind="stable")
        sizes[own] = hashes[order], np.repeat([i for i, _, _ in some], [len(h) for _, _, h in some])[order], np.concatenate([s for _, s, _ in some])[order]
    seen = np.concatenate([_pairs(can) for can in items])
    pairs = np.zeros(max(1 << 10, 1 << (8 * len(seen)).bit_length()), bool)
    pairs[(seen & np.uint64(len(pairs) - 1)).astype(np.int64)] = True
    return Table(sizes, items, pairs)


def _key(hashes: np.ndarray, own: int) -> np.ndarray:
    """One key for a window's hash, which is mixed well, and size."""
    return hashes + np.uint64(own) * np.uint64(0x9E3779B97F4A7C15)


def _met(can: Canonical, sizes: list[int], pairs: np.ndarray, size: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, start, hash) of the windows of a text that may be the benchmark's, given its pairs."""
    sought = can.settled(pairs)
    for own in sizes:
        for start, hashes in sought.windows(own, _literals(own, size, least), _literals(own, size, min(least, FEWEST_LITERALS)), pairs):
            yield own, start, hashes


def _bitmap(values: DataFrame, room: int, most: int) -> np.ndarray:
    """Packed bits, a power of two of them: those at the low bits of the values (value long) are set.

    `room` bits for each value, 2**most in all at most: beyond that more passes that isn't there, never less.
    """
    bits = min(most, max(PART_BITS, (room * values.count()).bit_length()))
    part = 1 << PART_BITS

    def packed(group: pa.Table) -> pa.Table:
        seen = np.zeros(part, bool)
        seen[group.column("place").to_numpy() & (part - 1)] = True
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    places = values.select(F.col(values.columns[0]).bitwiseAND((1 << bits) - 1).alias("place"))
    places = places.select("place", F.shiftright("place", PART_BITS).cast("int").alias("part")).distinct()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in places.groupBy("part").applyInArrow(packed, "part int, bits binary").toLocalIterator():  # 2**most bits at most
        out[row["part"] * part // 8 : (row["part"] + 1) * part // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _second(keys: np.ndarray) -> np.ndarray:
    """The other place of a key in the filter of windows; the first is the key's own."""
    return blocks.mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def _passing(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which keys have both their bits set; few have the first, so the second is worked out for those only."""

    def there(places: np.ndarray) -> np.ndarray:
        at = places & np.uint64(8 * len(packed) - 1)
        return np.flatnonzero((packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)

    some = there(keys)
    return some[there(_second(keys[some]))]


def _slots(item: Canonical, own: Canonical) -> tuple[np.ndarray, np.ndarray]:
    """Word by word: the kind of slot that both have there or 0, and whether the words fit each other."""
    kinds = np.where((item.codes == own.codes) & (item.codes <= NAME), item.codes, np.uint64(0))
    same = item.plain == own.plain
    names = ((item.codes == NAME) | item.either) & ((own.codes == NAME) | own.either)
    kinds[names & ~(same & item.either & own.either)] = NAME  # equal words that begin sentences are literals
    return kinds, (kinds > 0) | same


def _longest(item: Canonical, own: Canonical, places: list[int], size: int) -> tuple[int, int, int]:
    """(words, slots, slots of equal value) of the longest consistent stretch that holds one of the windows at places.

    A stretch is consistent when its slots map item values to document values one to one by type.
    Different numbers may become equal numbers; different names may not.
    """
    kinds, fits = _slots(item, own)
    slots = np.r_[0, np.cumsum(kinds > 0)].tolist()
    equal = np.r_[0, np.cumsum((kinds > 0) & (item.values == own.values))].tolist()
    pairs = list(zip(kinds.tolist(), item.values.tolist(), own.values.tolist(), strict=True))
    seen: Counter = Counter()  # pairs of the stretch
    there: Counter = Counter()  # different document values of an item value
    back: Counter = Counter()  # and the reverse
    best, low, k, last = (0, 0, 0), 0, 0, -1
    for at, (kind, a, b) in enumerate(pairs):
        if not fits[at]:
            seen.clear(), there.clear(), back.clear()
            low = at + 1
        elif kind:
            seen[kind, a, b] += 1
            if seen[kind, a, b] == 1:
                there[kind, a] += 1
                back[kind, b] += 1
            while there[kind, a] > 1 or (kind == NAME and back[kind, b] > 1):
                old = pairs[low]
                if old[0]:
                    seen[old] -= 1
                    if not seen[old]:
                        there[old[0], old[1]] -= 1
                        back[old[0], old[2]] -= 1
                low += 1
        while k < len(places) and places[k] + size <= at + 1:
            last, k = places[k], k + 1
        if last >= low and at + 1 - low >= best[0]:
            best = max(best, (at + 1 - low, slots[at + 1] - slots[low], equal[at + 1] - equal[low]))
    return best


def _aligned(table: Table, text: Canonical, met: list[tuple[int, np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[int, int, int, int]]:
    """(item number, words, slots, slots of equal value) of the best consistent alignment with each item met.

    met: (size, start, hash) of the windows of the text that are in the table.
    """
    diagonals: dict[tuple[int, int], set[int]] = defaultdict(set)
    for own, start, hashes in met:
        known, item, begin = table.sizes[own]
        left, right = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
        for at, a, b in zip(start.tolist(), left.tolist(), right.tolist(), strict=True):
            for k in range(a, b):
                diagonals[int(item[k]), at - int(begin[k])].add(at)
    best: dict[int, tuple[int, int, int]] = {}
    for (item, shift), places in diagonals.items():
        theirs = table.items[item]
        own = min(size, len(theirs.codes))
        run: list[int] = []
        for at in [*sorted(places), None]:
            if run and (at is None or at > run[-1] + own):
                a, b = run[0], run[-1] + own
                best[item] = max(best.get(item, (0, 0, 0)), _longest(theirs.cut(a - shift, b - shift), text.cut(a, b), [p - a for p in run], own))
                run = []
            if at is not None:
                run.append(at)
    for item, (n, slots, equal) in sorted(best.items()):
        if n:
            yield item, n, slots, equal


def contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, least: int = LEAST_LITERALS) -> DataFrame:
    """(doc_id, item_id, n_words, n_slots, n_equal): documents that hold a passage of a benchmark item.

    n_words: of the longest consistent alignment; n_slots and n_equal: its slots, and those whose value
    is the item's own. An item of fewer than `size` words is looked for as a whole, so one of a single word
    is found wherever the word stands. Windows with fewer than `least` literals (short items: the same part
    of their words) count where the words are the item's own; where no window of an item has so many, those
    with the most stand for it, if that is FEWEST_LITERALS at least. Null and empty texts and items hold and give
    no passage; null ids are left out. Each pair of ids appears once, also for repeated rows.

    One pass over the documents leaves those with a window that may be the benchmark's; their windows are
    joined with the items' by hash. A text is then told once, followed by the items that it may hold, and aligned with
    ITEMS_AT_ONCE of them together, however many there are.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id is not null and item is not null").distinct()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                can = canonical(next(blocks.slices(pa.array([text.as_py()]))))
                own, _, hashes = _windows(can, size, least)
                if own:
                    keys, pairs = np.unique(_key(hashes, own)).view(np.int64), np.unique(_pairs(can)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[row : row + 1], pa.array([own], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([pairs], pa.list_(pa.int64()))], names=["item_id", "own", "keys", "pairs"])

    windows = store.table(items.mapInArrow(known, "item_id long, own int, keys array<long>, pairs array<long>"), "items")
    keys = windows.select("item_id", F.explode("keys").alias("key"))
    sizes = sorted(r["own"] for r in windows.select("own").distinct().collect())  # `size` at most

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own := batch.column(0).to_numpy().view(np.uint64), _second(own)]).view(np.int64))], names=["place"])

    filters = _bitmap(keys.select("key").distinct().mapInArrow(places, "place long"), WINDOW_ROOM, WINDOW_BITS), _bitmap(windows.select(F.explode("pairs").alias("pair")).distinct(), PAIR_ROOM, PAIR_BITS)
    share = spark.sparkContext.broadcast(filters)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pairs = share.value[0], np.unpackbits(share.value[1], bitorder="little").view(bool)
        for batch in batches:
            for part in blocks.slices(batch.column(1)):
                can = canonical(part)
                rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for own, start, hashes in _met(can, sizes, pairs, size, least):
                    key = _key(hashes, own)
                    hit = _passing(key, seen)
                    rows.append(np.searchsorted(can.of, start[hit], side="right") - 1)
                    found.append(key[hit])
                row, key = np.concatenate(rows), np.concatenate(found).view(np.int64)
                some = np.unique(row)
                if len(some):
                    taken = batch.take(pa.array(some + part.first))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([np.unique(key[row == i]) for i in some], pa.list_(pa.int64()))], names=["doc_id", "text", "keys"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = rows.mapInArrow(suspects, "doc_id long, text string, keys array<long>").withColumn("row", F.monotonically_increasing_id())
    rows = store.table(rows, "suspects")
    pairs = rows.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item_id").distinct()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: a text, then the items that it may hold."""
        doc = own = text = None
        held: list[tuple[int, str]] = []
        got: list[tuple[int, int, int, int, int]] = []

        def align() -> None:
            nonlocal own
            own = own or canonical(next(blocks.slices(pa.array([text]))))
            table = _table([canonical(next(blocks.slices(pa.array([item])))) for _, item in held], size, least)
            met = [(n, start[hit], hashes[hit]) for n, start, hashes in _met(own, list(table.sizes), table.pairs, size, least) if len(hit := np.flatnonzero(np.isin(hashes, table.sizes[n][0])))]
            got.extend((doc, held[k][0], *rest) for k, *rest in _aligned(table, own, met, size))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*got, strict=True)) or [()] * 5
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_words", "n_slots", "n_equal"])

        for batch in batches:
            for kind, number, said in zip(*(batch.column(c) for c in ("kind", "number", "said")), strict=True):
                if kind.as_py() == 0:
                    if held:
                        align()
                    doc, own, text = number.as_py(), None, said.as_py()
                else:
                    held.append((number.as_py(), said.as_py()))
                    if len(held) == ITEMS_AT_ONCE:
                        align()
            if len(got) > 1 << 14:
                yield batch_of()
        if held:
            align()
        yield batch_of()

    texts = rows.select("row", F.lit(0).alias("kind"), F.col("doc_id").alias("number"), F.col("text").alias("said"))
    asked = pairs.join(items, "item_id").select("row", F.lit(1).alias("kind"), F.col("item_id").alias("number"), F.col("item").alias("said"))
    both = texts.unionByName(asked).repartition("row").sortWithinPartitions("row", "kind", "number")
    out = both.mapInArrow(aligned, "doc_id long, item_id long, n_words long, n_slots long, n_equal long")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_slots", "n_equal")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_words", "x.n_slots", "x.n_equal")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no passage of the benchmark; rows without an id stay.

    Rows are told apart by id and text, so a clean text that shares its id with another one stays.
    """
    own = "row_code"
    while own in documents.columns:
        own += "_"
    code = F.xxhash64("doc_id", "text")
    found = contaminated(documents.where("doc_id is not null").select(code.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("found_code")).distinct()
    rows = documents.withColumn(own, F.when(F.col("doc_id").isNotNull(), code))
    return rows.join(found, F.col(own) == F.col("found_code"), "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
