"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches the threshold.
The n-grams of a set are ordered from rare to frequent. Sets that link share at least l of their
prefixes of size - ceil(threshold * size) + l n-grams, for every l. Each document picks the l of least
estimated cost: what reading the lists of its prefix costs, and what verifying the candidates that
can still reach l shared n-grams costs. A pair goes to verification when its prefixes share
min(l, l') n-grams.

Groups are never paired off. Every list of a prefix n-gram first compares its members with one hub,
the member whose n-grams are most shared; what links becomes a component. Only lists with several
components are looked at again, in bounded blocks, and there only pairs of different components whose
parity bitmaps leave the similarity possible are verified, exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, shared_codes, store

WORDS = 5
PERCENT = 75
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16)
VERIFY_COST = 20  # list entries that one verification costs
BITMAP_BITS = 1024
SHARD_BYTES = 32 << 20  # of list entries in a group
BLOCK = 1024  # list entries on either side of a block of a long list
_PROFILE = "key long, size long, need long, center double, prefix array<long>, codes array<long>, bitmap binary"


def shingles(words: int):
    """Featuriser: distinct n-grams of words after A-Z became a-z; shorter texts give their whole sequence."""

    def make(part: blocks.Slice) -> shared_codes.Coded:
        data = blocks.lowered(part.data)
        found = blocks.words(part)
        sets = blocks.shingle_sets(blocks.word_hashes(data, found), found.of, words)
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.array([np.bitwise_xor.reduce(s) ^ np.sum(s * np.uint64(0x9FB21C651E98DF25), dtype=np.uint64) for s in sets], np.uint64)
        return shared_codes.Coded(blocks.mix(keys + sizes.astype(np.uint64)), sizes, [s & ~np.uint64(1) for s in sets])

    return make


def _bitmap(codes: np.ndarray, size: int) -> bytes:
    bits = BITMAP_BITS
    while bits < size // 2:
        bits *= 2
    hits = np.bincount((blocks.mix(codes.copy()) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8)).tobytes()


def profiles(counted: DataFrame, percent: int) -> DataFrame:
    """Of each distinct text that can have a partner: prefix, number of matches it needs, shared n-grams, bitmap."""

    def run(group: pa.Table) -> pa.Table:
        got = shared_codes.gather(group)
        rows = []
        for i, (key, size) in enumerate(zip(got.keys.view(np.int64).tolist(), got.sizes.tolist(), strict=True)):
            a, b = int(got.of[i]), int(got.of[i + 1])
            least = -(-percent * size // 100)
            base = size - least + 1 - (size - (b - a))  # shared n-grams in the shortest prefix
            if base <= 0 or not size:
                continue
            codes, df = got.codes[a:b], got.df[a:b]
            order = np.lexsort((codes, df))
            reading = np.cumsum(df[order] - 1)
            options = [(reading[min(base + n - 1, b - a) - 1] * (1 + VERIFY_COST / n), n) for n in LENGTHS if n <= least]
            need = min(options)[1]
            prefix = codes[order[: base + need - 1]]
            rows.append((key, size, need, float(df.sum() + size - (b - a)) / size, prefix.view(np.int64), codes.view(np.int64), _bitmap(codes, size)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["key", "size", "need", "center", "prefix", "codes", "bitmap"])

    return counted.groupBy("target").applyInArrow(run, _PROFILE)


def verified(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with enough shared prefix n-grams and the similarity asked for."""
    side = lambda x: profile.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "need", "prefix", "codes")])
    both = F.size(F.array_intersect("codes_a", "codes_b")).cast("long")
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("need_a", "need_b"))
    return near.where(100 * both >= percent * (F.col("size_a") + F.col("size_b") - both)).select("a", "b")


def _across(percent: int):
    """Pairs of a block of lists whose labels differ and whose sizes and bitmaps allow the similarity."""

    def folded(maps: list[bytes]) -> np.ndarray:
        width = min(map(len, maps))
        out = np.empty((len(maps), width // 8), np.uint64)
        for i, m in enumerate(maps):
            bits = np.frombuffer(m, np.uint8)
            if len(m) > width:  # bit x of a longer map counts at x modulo the shorter length
                bits = np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)
            out[i] = bits.view(np.uint64)
        return out

    def run(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("token", "class", "low", "high", "part", "key", "label", "size", "own")}
        maps = group.column("bitmap").to_pylist()
        order = np.lexsort((cols["high"], cols["low"], cols["class"], cols["token"]))
        changed = np.zeros(len(order), bool)
        for c in ("token", "class", "low", "high"):
            changed[1:] |= np.diff(cols[c][order]) != 0
        found = [np.zeros((0, 2), np.int64)]
        for rows in np.split(order, np.flatnonzero(changed)):
            label = cols["label"][rows]
            if len(rows) < 2 or (label == label[0]).all():
                continue
            size, own, key, part = (cols[c][rows] for c in ("size", "own", "key", "part"))
            bits = folded([maps[i] for i in rows])
            left = np.flatnonzero(part == cols["low"][rows[0]])
            right = np.flatnonzero(part == cols["high"][rows[0]])
            step = max(1, (1 << 19) // max(1, len(right) * bits.shape[1]))
            for at in range(0, len(left), step):
                a = left[at : at + step, None]
                total = size[a] + size[right]
                able = (label[a] != label[right]) & (100 * np.minimum(size[a], size[right]) >= percent * np.maximum(size[a], size[right]))
                i, j = np.nonzero(able)
                if not len(i):
                    continue
                x, y = left[at + i], right[j]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) + size[x] - own[x] + size[y] - own[y]
                near = (100 + percent) * apart <= (100 - percent) * total[i, j]
                found.append(np.unique(np.sort(np.stack([key[x[near]], key[y[near]]], axis=1), axis=1), axis=0))
        pairs = np.concatenate(found)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def blocks_of_lists(lists: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """lists (token, key, size, label, ...) of several labels, with class, part, low and high: their blocks.

    Only pairs of different labels and of sizes near each other matter. So a list of more than a block is
    split into classes of size, each with the next smaller one, and in a class into the members of its most
    common label, which no block pairs off, and the others. A block takes a part of either (low) with one
    of the others (high); parts of the common label have numbers below zero. A list in which one
    component prevails costs its own length and that of the others, not its square.
    """
    mixed = lists.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("token", (F.col("n") > block).alias("long"))
    step = math.log(100 / percent)
    rows = lists.join(mixed, "token")
    own = F.when(F.col("long"), F.floor(F.log(F.col("size").cast("double")) / step + 1e-9)).otherwise(0).cast("int")
    rows = rows.withColumn("own_class", own).withColumn("class", F.explode(F.when(F.col("long"), F.array("own_class", F.col("own_class") + 1)).otherwise(F.array("own_class"))))
    counts = rows.groupBy("token", "class", "label").agg(F.count("*").alias("n"))
    counts = counts.groupBy("token", "class").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    counts = counts.select("token", "class", F.col("top.label").alias("common"), parts(F.col("top.n")).alias("commons"), parts(F.col("n") - F.col("top.n")).alias("others"))
    rows = rows.join(counts, ["token", "class"])
    hashed = F.xxhash64("key")
    is_common = F.col("label") == F.col("common")
    rows = rows.withColumn("part", F.when(is_common, -1 - F.pmod(hashed, F.col("commons"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
    # One short list: a single block of all. Else a common part meets each other part, and these each other.
    single = (F.col("commons") == 1) & (F.col("others") == 1)
    every = F.sequence(F.lit(0), F.col("others") - 1)
    low_high = lambda x: F.struct(F.least("part", x).alias("low"), F.greatest("part", x).alias("high"))
    met = F.transform(every, low_high)
    met = F.when(is_common, met).otherwise(F.concat(met, F.transform(F.sequence(F.lit(-1), -F.col("commons"), F.lit(-1)), low_high)))
    alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    rows = rows.withColumn("x", F.explode(F.when(single, alone).otherwise(met))).withColumn("part", F.when(single, 0).otherwise(F.col("part")))
    return rows.select("token", "class", "key", "label", "size", "own", "bitmap", "part", F.col("x.low").alias("low"), F.col("x.high").alias("high"))


def links(profile: DataFrame, percent: int) -> DataFrame:
    """(node, label): components of the profiles' keys under the similarity."""
    spark = profile.sparkSession
    lists = profile.select("key", "size", "center", F.explode("prefix").alias("token"))
    hubs = lists.groupBy("token").agg(F.count("*").alias("n"), F.max(F.struct("center", "key", "size")).alias("hub")).where("n > 1")
    star = lists.join(hubs, "token").where((F.col("key") != F.col("hub.key")) & (100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size")))
    star = star.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()
    first = store.table(verified(star, profile, percent), "star")
    label = store.table(components(first), "labels")

    lists = profile.join(label, F.col("key") == F.col("node"), "left").select("key", "size", F.coalesce("label", "key").alias("label"), F.size("codes").cast("long").alias("own"), "bitmap", F.explode("prefix").alias("token"))
    dealt = blocks_of_lists(lists, percent)
    # Groups follow the bytes of all list entries, before the blocks of long lists of several labels repeat some of them.
    size = profile.agg(F.sum(F.size("prefix") * (64 + F.length("bitmap")))).first()[0] or 0
    shards = max(store.parallelism(spark) * 2, int(size // SHARD_BYTES) + 1)
    lists = dealt.withColumn("shard", F.pmod(F.xxhash64("token", "class", "low", "high"), F.lit(shards)).cast("int"))
    rest = lists.groupBy("shard").applyInArrow(_across(percent), "a long, b long").distinct()
    second = verified(rest, profile, percent)
    return components(first.unionByName(second))


components = store.components


def ngram_join(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document with an id.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Repeated
    rows come back as often as they came. Rows whose id is null are left out: nothing can name them.
    Sets are compared by 64-bit hashes of which at least 51 bits are carried.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null")
    counted, _ = shared_codes.count(rows, shingles(words), "shingles")
    profile = store.table(profiles(counted, percent), "profiles")
    label = links(profile, percent)
    docs = shared_codes.members(counted).join(label, F.col("key") == F.col("node"), "left").select("doc_id", "size", F.coalesce("label", "key").alias("label"))
    # Written, so that the join has two fresh exchanges and a large component can be split.
    least = store.table(docs.groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    return docs.join(least, "label").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one row of each component: of its least doc_id, and of equal ids that of least text hash.

    Rows are told apart by id and text, so an id on several texts costs none of them its place. Equal rows
    are copies, of which one stays. Rows without shingles or without an id stay, all of them.
    """
    taken = set(documents.columns)
    own = "row_code"
    while own in taken:
        own += "_"
    code = F.xxhash64("doc_id", "text")
    narrow = documents.where("doc_id is not null").select("doc_id", "text", code.alias("code"))
    found = store.table(ngram_join(narrow.select("code", "text"), "code"), "components")
    # Of the codes of one component the first by (doc_id, code) stays; the others, and repeated rows, go.
    ids = narrow.select("code", F.col("doc_id").alias("id")).distinct()
    rows = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("code"), "component_id").agg(F.count("*").alias("rows")).join(ids, "code")
    best = store.table(rows.groupBy("component_id").agg(F.min(F.struct("id", "code")).alias("best")), "best")  # so the join can split a large component
    dropped = store.table(rows.join(best, "component_id").select("code", "rows", (F.col("code") != F.col("best.code")).alias("gone")).where("gone or rows > 1"), "dropped")
    gone = dropped.where("gone").select(F.col("code").alias(own))
    rest = documents.withColumn(own, F.when(F.col("doc_id").isNotNull(), code)).join(gone.hint("shuffle_hash"), own, "left_anti")
    twice = dropped.where("not gone and rows > 1").select(F.col("code").alias(own))
    if not twice.isEmpty():
        rest = rest.join(twice, own, "left_anti").unionByName(rest.join(twice, own, "left_semi").dropDuplicates([own]))
    return rest.select(*documents.columns)
