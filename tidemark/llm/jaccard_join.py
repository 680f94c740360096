"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text becomes a set of k-word shingles. Equal sets share one 64-bit set id
and are handled once. Shingles are ordered from rare to frequent: by what a
fixed-size count sketch over all texts shows above its noise, and below that by
how often their words would meet by chance. The shingles that are then still
shared by many prefixes, as those of a passage that a few dozen texts quote, are
counted exactly and moved back in the order. Two sets of similarity t share at least l shingles
among the first ``n - ceil(t n) + l`` of each, for any l. Each set picks its l by
estimated cost: a longer prefix reads more postings, but asks for more shared
shingles before a pair is verified.

Groups of very many near copies are not expanded into pairs: in a few rounds
the members of each posting list are compared with one hub, and what is found
linked is one component. The exhaustive join then only builds pairs between
different components, so no link that could join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import U64, Words, lower_table, scramble, signed, text_slices, white_space
from tidemark.llm.frames import components, small_batches, with_small
from tidemark.session import materialised

#: Text bytes whose shingles are made at once (or one longer text).
SLICE = 1 << 18
SKETCH_BITS = 20
SKETCH_CHUNK = 1 << 14
MAX_MATCHES = 4
#: Cost of verifying one pair, in postings read.
VERIFY_COST = 40.0
HUB_ROUNDS = 3
#: Prefixes that share a shingle for it to be moved back, and how many are moved.
FREQUENT_LEAST = 4
FREQUENT_MOST = 1_000_000


class Shingles:
    """Per text of a slice: its distinct shingle hashes, ascending."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.lower = k, white_space(), lower_table()

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        return Words(self.lower[data], offsets, self.parts)

    def __call__(self, words: Words) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The sets, and where in the slice's shingles each member stands first."""
        shingles, first = words.shingles(self.k)
        sets, places = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            one, at = np.unique(shingles[a:b], return_index=True)
            sets.append(one)
            places.append(at + a)
        return sets, places

    def sums(self, words: Words, each: np.ndarray) -> np.ndarray:
        """For each shingle of the slice, the sum of whole numbers ``each`` over its words."""
        total = np.concatenate([[0], np.cumsum(each)])
        _, first = words.shingles(self.k)
        text = np.repeat(np.arange(len(words.count)), np.diff(first))
        start = words.first[text] + np.arange(len(text)) - first[text]
        return total[np.minimum(start + self.k, words.first[text + 1])] - total[start]


def _set_id(one: np.ndarray) -> np.uint64:
    return scramble(scramble(one ^ U64(0x2545F4914F6CDD1D)).sum(dtype=U64, keepdims=True) + U64(len(one)))[0]


def _bucket(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes & U64(width - 1)).astype(np.int64)


def _id_of_empty(rows: int, salt: int) -> np.ndarray:
    return scramble(np.arange(rows, dtype=U64) + U64(salt << 32))


def _read_sets(k: int, bits: int):
    """Map: texts to (doc_id, n_shingles, set_id), and each task's part of the sketch.

    The sketch counts shingles once for each text, and in its second half words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        width = 1 << bits
        counts = np.zeros(2 * width, dtype=np.int32)
        names = ["doc_id", "n_shingles", "set_id", "chunk", "counts"]
        salt = 0
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            words = shingles.words(data, offsets)
            sets, _ = shingles(words)
            ids = _id_of_empty(len(sets), salt)
            salt += 1
            for i, one in enumerate(sets):
                if len(one):
                    ids[i] = _set_id(one)
            if sets:
                counts[:width] += np.bincount(_bucket(np.concatenate(sets), width), minlength=width).astype(np.int32)
                counts[width:] += np.bincount(_bucket(words.hash, width), minlength=width).astype(np.int32)
            none = pa.nulls(len(sets))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), sizes, signed(ids), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if counts.any():
            for c in range(len(counts) // SKETCH_CHUNK):
                part = counts[c * SKETCH_CHUNK : (c + 1) * SKETCH_CHUNK].tobytes()
                null = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([null, null, null, pa.array([c], pa.int32()), pa.array([part], pa.binary())], names)

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the sketch chunks of a partition as they stream by."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, part in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            got = np.frombuffer(part.as_buffer(), dtype=np.int32).astype(np.int64)
            sums[c] = sums[c] + got if c in sums else got
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])


def prefix_choice(weights: np.ndarray, n: int, percent: int, most: int = MAX_MATCHES) -> int:
    """The number of shared prefix shingles to ask for, by estimated cost.

    ``weights`` are the estimated list lengths of the ordered shingles. With l
    matches asked for, all lists of the prefix are read, and at most a l-th of
    what they hold can be candidates.
    """
    need = -(-percent * n // 100)
    best, chosen = None, 1
    for matches in range(1, min(most, need) + 1):
        read = float(weights[: n - need + matches].sum())
        cost = read + VERIFY_COST * read / matches
        if best is None or cost < best:
            best, chosen = cost, matches
    return chosen


def _most_frequent(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with the highest counts, ascending, and their counts.

    All that reach the least count at which not more than ``FREQUENT_MOST`` are
    left, so what the driver gets is bounded by that number.
    """
    counts = materialised(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT_LEAST), "frequent")
    sizes = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.col("n").desc()).collect()
    least, total = None, 0
    for row in sizes:
        if (total := total + row["tokens"]) > FREQUENT_MOST:
            break
        least = row["n"]
    if least is None:
        return np.zeros(0, dtype=U64), np.zeros(0)
    table = counts.filter(F.col("n") >= least).toArrow()
    token = table.column("token").to_numpy().view(U64)
    order = np.argsort(token)
    return token[order], table.column("n").to_numpy()[order].astype(np.float64)


def _prefixes(k: int, percent: int, sketch: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None):
    """Map: texts to postings (token, set_id, meta, reader) of their longest prefix.

    Without ``frequent``, only to the tokens of their shortest prefix.

    ``meta`` packs the set size, the token's position in the order, and the
    set's own l. ``reader`` is the doc_id. A task emits a set once.
    """
    width = len(sketch) // 2
    mean = float(sketch[:width].mean())
    floor = mean + 5.0 * mean**0.5 + 1.0
    total = max(float(sketch[width:].sum()), 1.0)
    # In 64ths and whole, so that sums do not depend on what stands before.
    chance = np.round(64 * np.log(np.maximum(sketch[width:], 1) / total)).astype(np.int32)
    heavy = np.where(sketch[:width] > floor, sketch[:width] - mean, 0.0).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        seen: set[int] = set()
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            words = shingles.words(data, offsets)
            rarity = shingles.sums(words, chance[_bucket(words.hash, width)])
            tokens, owners, metas, readers = [], [], [], []
            for i, (one, at) in enumerate(zip(*shingles(words))):
                n = len(one)
                if not n or (own := int(_set_id(one))) in seen:
                    continue
                seen.add(own)
                need = -(-percent * n // 100)
                often = heavy[_bucket(one, width)]
                length = min(n, n - need + (min(MAX_MATCHES, need) if frequent else 1))
                if frequent and len(frequent[0]):
                    place = np.minimum(np.searchsorted(frequent[0], one), len(frequent[0]) - 1)
                    often = np.maximum(often, np.where(frequent[0][place] == one, frequent[1][place], 0.0))
                # Chance is a negative logarithm, far smaller than the factor.
                order = np.argsort(often * 1e6 + rarity[at], kind="stable")[:length]
                tokens.append(one[order])
                if not frequent:
                    continue
                expected = often[order] + total * np.exp(rarity[at[order]] / 64)
                matches = prefix_choice(expected, n, percent)
                owners.append(np.full(length, own, dtype=U64))
                metas.append((np.int64(n) << 34) | (np.arange(length) << 4) | matches)
                readers.append(np.full(length, i))
            if tokens and not frequent:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(tokens))], ["token"])
            elif tokens:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(tokens)), signed(np.concatenate(owners)), pa.array(np.concatenate(metas)),
                     rows.column("doc_id").take(pa.array(np.concatenate(readers)))], ["token", "set_id", "meta", "reader"],
                )

    return run


def parities(one: np.ndarray) -> np.ndarray:
    """A bit for each bucket of a set's tokens, packed: whether it holds an odd number. About one bit for each token.

    Two sets differ in at least as many tokens as bits.
    """
    width = 1 << max(9, int(len(one) - 1).bit_length())
    return np.packbits(np.bincount(_bucket(one, width), minlength=width).astype(np.uint8) & 1, bitorder="little")


def most_shared(x: np.ndarray, y: np.ndarray, sizes: int) -> int:
    """The most tokens that two sets of these parities, with ``sizes`` tokens together, can share."""
    if len(x) > len(y):
        x, y = y, x
    # Halves fold: a narrower bucket holds what both of its wider ones hold.
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return (sizes - int(np.bitwise_count(x ^ y).sum())) // 2


def _set_tokens(k: int):
    """Map: texts to (set_id, n, parities, tokens) for verification, each set once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        seen: set[int] = set()
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            ids, sizes, bits, tokens = [], [], [], []
            for one in shingles(shingles.words(data, offsets))[0]:
                if len(one) and (own := int(_set_id(one))) not in seen:
                    seen.add(own)
                    ids.append(own)
                    sizes.append(len(one))
                    bits.append(parities(one).tobytes())
                    tokens.append(one.tobytes())
            if ids:
                columns = [signed(np.array(ids, dtype=U64)), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["set_id", "n", "bits", "tokens"])

    return run


_PAIR = "a long, b long, a_comp long, b_comp long"


def _possible(percent: int):
    """Map: pairs with the parities of both sets to those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            sizes = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
            for i, (x, y) in enumerate(zip(batch.column("a_bits"), batch.column("b_bits"))):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint8), np.frombuffer(y.as_buffer(), dtype=np.uint8)
                shared = most_shared(x, y, int(sizes[i]))
                keep[i] = 100 * shared >= percent * (int(sizes[i]) - shared)
            yield batch.select(["a", "b", "a_comp", "b_comp"]).filter(pa.array(keep))

    return run


def _verify(percent: int):
    """Map: pairs with both token sets to those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("a_tokens"), batch.column("b_tokens"))):
                x, y = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum())
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b", "a_comp", "b_comp"]).filter(pa.array(keep))

    return run


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of sets that are similar enough, checked exactly.

    A pair has the ids of both sets, their present components, and the doc_ids
    of texts to read them from.
    """
    readers = materialised(pairs.select(F.explode(F.array("a_reader", "b_reader")).alias("doc_id")).distinct(), "readers")
    sets = with_small(docs, readers, ["doc_id"], "left_semi").mapInArrow(_set_tokens(k), "set_id long, n long, bits binary, tokens binary")
    sets = materialised(sets, "sets")

    def both(rows: DataFrame, table: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            rows = rows.join(table.toDF(side, *[f"{side}_{c}" for c in table.columns[1:]]), side)
        return rows

    # Whole sets are only moved for the pairs that their parities leave.
    pairs = both(pairs.select("a", "b", "a_comp", "b_comp"), sets.select("set_id", "n", "bits").dropDuplicates(["set_id"]))
    pairs = materialised(pairs.mapInArrow(_possible(percent), _PAIR), "possible")
    needed = materialised(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "possible_sets")
    checked = both(pairs, with_small(sets.select("set_id", "tokens"), needed, ["set_id"], "left_semi"))
    return materialised(checked.mapInArrow(_verify(percent), _PAIR), "links")


def _fitting(percent: int, a: str, b: str) -> str:
    """Condition on two packed metas of one token: the pair can still be similar.

    Sets of these sizes must share ``need`` shingles, so at least l of them
    within the first ``size - need + l`` of either set.
    """
    n_a, n_b = (f"shiftright({m}, 34)" for m in (a, b))
    need = f"(({percent} * ({n_a} + {n_b}) + {99 + percent}) div {100 + percent})"
    asked = f"greatest({a} & 15, {b} & 15)"
    at_a, at_b = (f"(shiftright({m}, 4) & {(1 << 30) - 1})" for m in (a, b))
    sizes = f"{percent} * greatest({n_a}, {n_b}) <= 100 * least({n_a}, {n_b})"
    return f"{sizes} AND {at_a} < {n_a} - {need} + {asked} AND {at_b} < {n_b} - {need} + {asked}"


def similar_texts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Texts are lower-cased (A-Z) and parted at white space; a set holds the
    distinct k-word shingles, or the whole sequence of a shorter text. Sets link
    when ``100 * shared >= percent * union``. ``component_id`` is the least
    doc_id reachable by links, itself included.

    Null or empty texts have no shingles and link with nothing; their
    ``component_id`` is their own doc_id. Rows with a null doc_id link with
    nothing and have a null component. Repeated rows give repeated rows. Extra
    columns are left out. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set_id long, chunk int, counts binary"
    read = materialised(docs.mapInArrow(_read_sets(k, SKETCH_BITS), schema), "set_ids")
    owners = read.filter("chunk IS NULL").select("doc_id", "n_shingles", "set_id")
    parts = read.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    sketch = np.zeros(2 << SKETCH_BITS, dtype=np.float64)
    for row in parts.mapInArrow(_add_sketches, "chunk int, counts binary").collect():  # a fixed number of chunks
        sketch[row["chunk"] * SKETCH_CHUNK : (row["chunk"] + 1) * SKETCH_CHUNK] += np.frombuffer(row["counts"], dtype=np.int64)

    docs = docs.filter("doc_id IS NOT NULL")
    per_token = Window.partitionBy("token")
    frequent = _most_frequent(docs.mapInArrow(_prefixes(k, percent, sketch), "token long"))
    postings = docs.mapInArrow(_prefixes(k, percent, sketch, frequent), "token long, set_id long, meta long, reader long")
    groups = postings.withColumn("low", F.min("set_id").over(per_token)).withColumn("high", F.max("set_id").over(per_token))
    groups = groups.withColumn("size", F.count(F.lit(1)).over(per_token)).filter("low <> high")
    groups = groups.groupBy("token", "set_id", "meta").agg(F.min("reader").alias("reader"), F.max("size").alias("size")).withColumn("comp", F.col("set_id"))
    groups = materialised(groups, "postings")
    # Where the other sets of its lists gather around a set, it is the better hub. A set's postings meet once, without a join.
    per_set = Window.partitionBy("set_id")
    ranked = groups.withColumn("rank", F.sum("size").over(per_set) / F.shiftright(F.max("meta").over(per_set), 34)).drop("size")

    links = []
    for turn in range(HUB_ROUNDS):
        many = groups.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
        load = many.agg((F.sum(F.col("n").cast("double") * F.col("n") - F.col("q")) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
        if not load["pairs"] or load["pairs"] <= 4 * load["rows"]:
            break
        if turn == 0:
            groups = materialised(ranked, "ranked")
        pairs = materialised(_star_pairs(groups, percent, turn), "star_pairs")
        found = _linked(pairs, docs, k, percent)
        links.append(found.select("a", "b"))
        linked, tried = found.count(), pairs.count()
        groups = materialised(_merged(groups, found.join(pairs.select("a", "b", "rank"), ["a", "b"]), turn), "groups")
        if 10 * linked < tried:
            break

    links.append(_linked(materialised(_open_pairs(groups, percent), "pairs"), docs, k, percent).select("a", "b"))
    joined = components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "set_id")
    classes = materialised(owners.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least")), "classes")
    # Written before they are joined, so that a large component can be split.
    members = materialised(joined.join(classes, "set_id"), "members")
    lowest = materialised(members.groupBy("component").agg(F.min("least").alias("lowest")), "components")
    named = members.select("set_id", "component").join(lowest, "component").select("set_id", "lowest")
    final = materialised(classes.join(named, "set_id", "left").select("set_id", F.coalesce("lowest", "least").alias("component_id")), "named")
    out = owners.join(final, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _star_pairs(groups: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each posting list's sets with one hub of the list, if of another component.

    The first hub of a list is its most central set, later ones are any.
    """
    first = F.struct("rank", "set_id") if turn == 0 else F.struct(-F.xxhash64("set_id", F.lit(turn)).cast("double"), "set_id")
    hub = F.max_by(F.struct("set_id", "meta", "comp", "reader", "rank"), first)
    hubs = groups.groupBy("token").agg(hub.alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    hubs = hubs.filter("low <> high").select("token", "hub", F.col("hub.meta").alias("hub_meta"))
    star = groups.join(hubs, "token").filter("comp <> hub.comp").filter(_fitting(percent, "meta", "hub_meta"))
    return star.select(
        F.col("set_id").alias("a"), F.col("reader").alias("a_reader"), F.col("comp").alias("a_comp"),
        F.col("hub.set_id").alias("b"), F.col("hub.reader").alias("b_reader"), F.col("hub.comp").alias("b_comp"), F.col("hub.rank").alias("rank"),
    ).distinct()


def _merged(groups: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """Give linked components one name.

    At first each set takes the name of its most central hub, and then that
    hub's. Later a component takes the linked name that comes first by a hash.
    Both orders are strict, so no two names can swap. What shares a name is
    linked; what is linked need not share one yet.
    """
    if turn == 0:
        moves = found.groupBy(F.col("a_comp").alias("comp")).agg(F.max_by("b_comp", F.struct("rank", "b")).alias("new"))
        jump = moves.select(F.col("comp").alias("new"), F.col("new").alias("next"))
        moves = moves.join(jump, "new", "left").select("comp", F.coalesce("next", "new").alias("new"))
    else:
        a, b = F.xxhash64("a_comp", F.lit(turn)), F.xxhash64("b_comp", F.lit(turn))
        low, high = (F.when(a < b, F.col(x)).otherwise(F.col(y)) for x, y in (("a_comp", "b_comp"), ("b_comp", "a_comp")))
        moves = found.select(high.alias("comp"), low.alias("new")).groupBy("comp").agg(F.min_by("new", F.xxhash64("new", F.lit(turn))).alias("new"))
    return groups.join(moves, "comp", "left").select("token", "set_id", "meta", "reader", "rank", F.coalesce("new", "comp").alias("comp"))


def _open_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """All pairs between components that share as many prefix shingles as they must."""
    open_tokens = groups.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    rest = groups.join(open_tokens, "token")
    names = ("set_id", "meta", "comp")
    x = rest.select("token", *[F.col(c).alias(f"a_{c}") for c in names])
    y = rest.select("token", *[F.col(c).alias(f"b_{c}") for c in names])
    asked = F.expr("greatest(a_meta & 15, b_meta & 15)")
    pairs = x.join(y, "token").filter("a_set_id < b_set_id AND a_comp <> b_comp").filter(_fitting(percent, "a_meta", "b_meta"))
    # Only the ids move for each shared shingle; the rest is brought to the few pairs that share enough.
    pairs = pairs.groupBy(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b")).agg(F.count(F.lit(1)).cast("int").alias("matches"), F.max(asked.cast("int")).alias("asked"))
    pairs = materialised(pairs.filter("matches >= asked").select("a", "b"), "open_pairs")
    about = groups.groupBy("set_id").agg(F.min("comp").alias("comp"), F.min("reader").alias("reader"))
    needed = materialised(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "open_sets")
    about = materialised(with_small(about, needed, ["set_id"], "left_semi"), "open_readers")
    for side in ("a", "b"):
        pairs = with_small(pairs, about.toDF(side, f"{side}_comp", f"{side}_reader"), [side], "inner")
    return pairs.select("a", "b", "a_comp", "b_comp", "a_reader", "b_reader")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that represent their group of near copies.

    The document with the least doc_id of a group stays; rows repeated under
    that doc_id are the same document. Rows without a doc_id, and texts without
    words, stay as they are.
    """
    found = materialised(similar_texts(docs, k, percent), "near_copies")
    gone = found.filter("n_shingles > 0 AND doc_id IS NOT NULL AND component_id < doc_id").select("doc_id").distinct()
    left = with_small(docs, materialised(gone, "near_copies_gone"), ["doc_id"], "left_anti")
    return left.select(docs.columns)
