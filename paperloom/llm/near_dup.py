"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

SuperMinHash (Ertl, 2017): each element spreads correlated ranks over the signature, one slot a
round in the order of its own permutation; rounds stop once every slot holds a rank of an earlier
round. Rounds run over all elements of many documents at once.

* Equal shingle sets are one class from the start (a digest groups them with map-side combining).
* ``BANDS`` bands of ``ROWS`` ranks propose buckets: a pair at the threshold of 0.8 shares none with
  a probability of (1 - 0.8**6)**32, about 6 in 100,000. Nothing after banding loses a link.
* In each bucket, members are first held against its most central member. Components follow.
* What is left are members of one bucket in different components. Buckets of at most ``DIRECT``
  classes compare them with each other. A larger one is split: of two sets that are linked while one
  of them isn't linked with the central member, both differ from that member by a common shingle. So
  shingles that several differ by make smaller buckets, which are treated alike (``_split``). Where
  a round would not make much less of what is to be compared (edits that very many members share),
  its buckets, or those before it, are compared directly, in blocks (``_met``): all pairs of a bucket, by
  sizes and parities first. So rows don't grow from round to round.
* Before full sets are compared, sizes and parities rule pairs out. The parities count shingles in
  512 slots by one bit each; where they differ the sets differ, so this bound is exact.
* Every link is confirmed on full sets, of 64-bit shingle codes. Components come from star
  contraction rather than from a union-find structure in one place.

Defined results: a text without words, or a null one, has no shingles and stays alone; rows that
share an id are one node; a row without an id stands with its copies but is never the one kept; an
empty table gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, extended
from .shared import SENT_KEYS, Scratch, in_small_batches, materialize, sent_if_few
from .words import mixed, sets_of

BANDS, ROWS = 32, 6
SIZE = BANDS * ROWS
#: Buckets of so many classes compare all that is undecided; larger ones are split.
DIRECT = 512
#: So many comparisons of sizes and parities take less time than a round of splitting.
CHEAP = 2**26
#: Beyond, buckets made by splitting are compared up to so many times ``DIRECT`` classes; rows would grow from round to round.
LATER = 8
#: Rounds of splitting where what is left is cheap to compare.
ROUNDS = 3
#: Classes of a bucket that are held against as many others in one place.
BLOCK = 2048
BROADCAST_IDS = SENT_KEYS
#: Sets that one task holds against the same set, at most.
SHARE = 2048
#: 64-bit columns that hold the parities of a set.
PARITY = [f"p{k}" for k in range(8)]
#: Elements whose signatures are made together, about; an order of ``SIZE`` bytes is held for each.
TOGETHER = 16_384
#: Bytes of texts whose words are hashed together, about.
PIECE = 4 * 2**20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def super_minhash(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The signature of a set of 64-bit codes: for each slot the round (high byte) and rank of its least element."""
    return super_minhashes(elements, np.array([0, len(elements)]), size)[0]


def super_minhashes(elements: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The signature of each set; sets lie one after the other in ``elements``, from starts[k] to starts[k + 1]."""
    counts = np.diff(starts)
    out = np.full((len(counts), size), np.iinfo(np.uint64).max, np.uint64)
    # sets of about one size need about as many rounds
    by_size = np.argsort(counts, kind="stable")
    by_size = by_size[counts[by_size] > 0]
    for sets in np.split(by_size, np.flatnonzero(np.diff(np.cumsum(counts[by_size]) // TOGETHER)) + 1):
        if len(sets):
            n = counts[sets]
            at = np.arange(n.sum()) + np.repeat(starts[sets] - (np.cumsum(n) - n), n)
            out[sets] = _rounds(elements[at], n, size)
    return out


def _rounds(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The signatures of sets of so many elements each, none empty."""
    sig = np.full((len(counts), size), np.iinfo(np.uint64).max, np.uint64)
    flat, sets = sig.reshape(-1), np.arange(len(counts))
    of = np.repeat(sets * size, counts)  # where in ``flat`` an element's signature begins
    order = None
    for j in range(size):
        draw = mixed(elements + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        high = (draw >> np.uint64(40)).astype(np.uint32)
        pick = j + (high - high // np.uint32(size - j) * np.uint32(size - j)).astype(np.intp)
        if j == 0:
            slot = first = pick
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.uint8), len(elements))
                row = np.arange(len(elements)) * size
                order[row + first] = 0
            pick += row
            slot = order[pick].astype(np.intp)
            order[pick] = order[row + j]
        slot = slot + of
        # only slots without a rank of an earlier round take one
        free = np.flatnonzero(flat[slot] >= np.uint64(j) << np.uint64(56))
        np.minimum.at(flat, slot[free], (np.uint64(j) << np.uint64(56)) | (mixed(draw[free]) >> np.uint64(8)))
        if j > 3 and j % 4:
            continue
        open_sets = sig[sets].max(axis=1) >> np.uint64(56) > j  # later rounds rank higher
        if not open_sets.any():
            break
        stays = np.repeat(open_sets, counts)
        if 4 * np.count_nonzero(stays) <= 3 * len(stays):
            sets, counts, elements, of = sets[open_sets], counts[open_sets], elements[stays], of[stays]
            if order is None:
                first = first[stays]
            else:
                order = order.reshape(-1, size)[stays].reshape(-1)
                row = np.arange(len(elements)) * size
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature (a row); bands never share keys but by chance."""
    sig = sig.reshape(len(sig), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(ROWS):
        key = mixed(key * _GOLDEN + sig[:, :, k])
    return key


def parity_of(codes: np.ndarray) -> np.ndarray:
    """Whether each of 512 slots holds an odd number of the codes, as eight 64-bit values."""
    return parities(codes, np.array([0, len(codes)]))[0]


def parities(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The parities of each set, a row for each; sets lie in ``codes`` as for ``super_minhashes``."""
    counts = np.diff(starts)
    slot = (codes >> np.uint64(55)).astype(np.intp) + np.repeat(np.arange(len(counts)) * 512, counts)
    odd = (np.bincount(slot, minlength=512 * len(counts)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 512), axis=1).view(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (the second column) have about ``PIECE`` bytes together."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = [*(np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1), len(size)]
    for k, end in enumerate(ends):
        at = ends[k - 1] if k else 0
        if end > at:
            yield batch.slice(at, end - at)


def _lists(values: np.ndarray, starts: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """Lists of longs from one array and where each begins; null where ``nulls`` says so."""
    mask = None if nulls is None else pa.array(nulls)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)), mask=mask)


_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, parity array<long>"


def signatures(docs: DataFrame, words: int, hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and parities; null digest: no words.

    ``hashed`` adds text_hash, by which rows without an id can be told apart (null for all others).
    """
    schema = f"{_SIGNED}, text_hash binary" if hashed else _SIGNED

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (piece for batch in batches for piece in _pieces(batch)):
            codes, starts = sets_of(some.column(1), words)
            n = np.diff(starts)
            digest = [xxhash.xxh3_128_digest(codes[at:end]) if end > at else None for at, end in zip(starts[:-1].tolist(), starts[1:].tolist())]
            bands, parity = bands_of(super_minhashes(codes, starts)), parities(codes, starts)
            lists = (_lists(x.reshape(-1), np.arange(len(n) + 1) * x.shape[1], n == 0) for x in (bands, parity))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists, *some.columns[2:]], names=[x.split()[0] for x in schema.split(", ")])

    return in_small_batches(docs).mapInArrow(sign, schema)


def _possible(threshold: int) -> str:
    """Whether sets of n and m codes with parities p and q can reach the threshold (percent)."""
    apart = " + ".join(f"bit_count({p} ^ q{k})" for k, p in enumerate(PARITY))
    return f"100 * least(n, m) >= {threshold} * greatest(n, m) and {100 + threshold} * ({apart}) <= {100 - threshold} * (n + m)"


def _other(facts: DataFrame, **names: str) -> DataFrame:
    """facts (a, n, p...) as (b, m, q...), for the other end of a pair."""
    return facts.select(*(F.col(c).alias({"a": "b", "n": "m"}.get(c, names.get(c, c.replace("p", "q")))) for c in facts.columns))


def _sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(a, codes): full sets of the asked documents (a, distinct). Texts of all others are left behind."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (piece for batch in batches for piece in _pieces(batch)):
            yield pa.RecordBatch.from_arrays([some.column(0), _lists(*sets_of(some.column(1), words))], names=["a", "codes"])

    asked = sent_if_few(asked, BROADCAST_IDS)
    return in_small_batches(docs.select(F.col("doc_id").alias("a"), "text").join(asked, "a", "left_semi")).mapInArrow(sets, "a long, codes array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sets x of a and y of b; a set that many ask for goes to several tasks."""
    most = max(SHARE, pairs.count() // SENT_KEYS)
    asked = pairs.groupBy("b").agg(F.ceil(F.count("*") / most).cast("int").alias("shares"))
    y = sets.select(F.col("a").alias("b"), F.col("codes").alias("y")).join(asked, "b").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    # more than ``most`` pairs each, so at most SENT_KEYS rows: pairs don't meet them by a shuffle on b
    several = F.broadcast(asked.where("shares > 1"))
    x = pairs.join(several, "b", "left").withColumn("share", F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares").join(sets.withColumnRenamed("codes", "x"), "a")
    return x.join(y, ["b", "share"]).drop("share")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the threshold."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(len(batch)):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return _with_sets(pairs.select("a", "b"), sets).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def _central(rows: DataFrame) -> DataFrame:
    """(key, b): of each bucket the class that meets most classes over all its buckets.

    In a group of near copies this is one close to the text they were copied from: the others are
    linked with it more likely than with each other.
    """
    met = rows.groupBy("a").agg(F.sum("members").alias("met"))
    return rows.join(met, "a").groupBy("key").agg(F.max_by("a", F.struct("met", -F.col("a"))).alias("b"))


_DIFFERENCES = "a long, b long, linked boolean, t long, extra array<long>, lost array<long>, d long"


def _differences(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b): whether they are linked, b's size, the codes that only a holds, and those that only b holds.

    The latter only where a link of a with a set that shares no extra code is possible (see ``_split``).
    """
    # sets x and y with Jaccard at least h differ in at most far * (|x| + |y|) codes
    far = (100 - threshold) / (100 + threshold)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, t, extras, losses, d = [], [], [], [], []
            for k in range(len(batch)):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                extra, lost = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                both = len(x) - len(extra)
                linked.append(100 * both >= threshold * (len(x) + len(y) - both))
                t.append(len(y))
                extras.append(extra)
                d.append(len(lost))
                losses.append(lost if (1 - far) * len(extra) + 2 * far * len(lost) <= 2 * far * len(y) + 1e-6 else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(linked, pa.bool_()), pa.array(t, pa.int64()), pa.array(extras, pa.list_(pa.int64())), pa.array(losses, pa.list_(pa.int64())), pa.array(d, pa.int64())],
                names=[x.split()[0] for x in _DIFFERENCES.split(", ")],
            )

    return _with_sets(pairs.select("a", "b"), sets).select("a", "b", "x", "y").mapInArrow(compare, _DIFFERENCES)


def _shared_first(rows: DataFrame, codes: str, need: str) -> DataFrame:
    """(key, a): new buckets from codes (an array of each row (key, a, component, stray)).

    Two rows that are to meet share at least ``need`` (of either row) of the codes that several rows
    hold. In one order of all codes, the rarest first, the first of those they share is among the
    first ``size - need + 1`` of both, so only these make buckets.
    """
    each = rows.select("key", "a", "component", "stray", F.expr(need).alias("need"), F.explode(codes).alias("code"))
    held = each.groupBy("key", "code").agg(F.count("*").alias("holders"), F.max("stray").alias("strays"), F.min("component").alias("low"), F.max("component").alias("high"))
    held = held.where("holders > 1 and strays and low < high").select("key", "code", "holders")
    ranked = each.join(held, ["key", "code"]).groupBy("key", "a", "need").agg(F.array_sort(F.collect_list(F.struct("holders", "code"))).alias("by"))
    first = F.greatest(F.lit(0), F.size("by") - F.greatest(F.lit(1), F.col("need")) + 1).cast("int")
    made = ranked.select("key", "a", F.explode(F.slice("by", F.lit(1), first)).alias("one"))
    return made.select(F.xxhash64("key", F.lit(codes), "one.code").alias("key"), "a")


def _split(members: DataFrame, differences: DataFrame, threshold: int) -> DataFrame:
    """(key, a): smaller buckets for what is undecided in the buckets of ``members`` (key, a, component, b, center).

    b is a bucket's central set of t codes, center its component. A set is a stray if it is neither
    linked with b nor in its component; undecided pairs hold a stray x. Let x and y be linked: they
    differ in at most r * (|x| + |y|) codes, with r = (1 - h) / (1 + h) at a Jaccard index of h. With e
    the number of extra codes over b and d of lost ones, |x| = t - d + e, and so, if k extra codes are
    common to both, (1 - r)(ex + ey) - 2k + |dx - dy| + r(dx + dy) <= 2rt. The left side is least for
    ey = k and dy = dx, which bounds k from below by x alone:

        k >= ((1 - r) ex + 2r dx - 2rt) / (1 + r)

    Where this allows k = 0, x and y may share lost codes alone, then at least
    ((1 - r) ex + (1 + r) dx - 2rt) / (1 - r), which is above 0 for a stray. There must also be a set in
    the bucket whose numbers fit the inequality for k = 0; numbers are kept in steps of t / 64.
    """
    r = (100 - threshold) / (100 + threshold)
    rows = members.join(differences, ["a", "b"]).withColumn("stray", ~F.col("linked") & (F.col("component") != F.col("center")))
    rows = rows.select("key", "a", "t", "stray", F.when(F.col("linked"), F.col("center")).otherwise(F.col("component")).alias("component"), "extra", "lost", F.size("extra").alias("e"), "d")
    by_extra = f"cast(ceil(({1 - r} * e + {2 * r} * d - {2 * r} * t) / {1 + r} - 1e-6) as int)"
    extra = _shared_first(rows, "extra", by_extra)
    step = "greatest(1L, t div 64)"
    kinds = rows.where("lost is not null").groupBy("key").agg(F.collect_set(F.struct("stray", F.expr(f"(e div {step}) * {step}").alias("e"), F.expr(f"(d div {step}) * {step}").alias("d"))).alias("kinds"))
    # of the other set: e is at least kind.e, d from kind.d to kind.d + step - 1
    fits = f"""exists(kinds, kind -> (stray or kind.stray) and
        {1 - r} * (e + kind.e) + greatest(0, d - kind.d - {step} + 1, kind.d - d) + {r} * (d + kind.d) <= {2 * r} * t + 1e-6)"""
    by_lost = f"cast(ceil(({1 - r} * e + {1 + r} * d - {2 * r} * t) / {1 - r} - 1e-6) as int)"
    lost = _shared_first(rows.where("lost is not null").join(kinds, "key").where(fits), "lost", by_lost)
    return extra.unionByName(lost)


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """(key, a, members) of rows (key, a): of buckets with the same members one, and none with a single member."""
    made = rows.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("a")).alias("h1"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("h2"))
    kept = made.where("members > 1").groupBy("members", "h1", "h2").agg(F.min("key").alias("key")).select("key", "members")
    return rows.join(kept, "key").select("key", "a", "members")


def _undecided(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, a, ...) with their component, of buckets that hold several components."""
    placed = rows.join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return placed.join(several, "key")


def _comparisons(rows: DataFrame) -> int:
    """Comparisons that buckets of rows (key, ...) take if each member is held against all others, twice over."""
    n = F.count("*").cast("double")
    return int(rows.groupBy("key").agg((n * n).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0])


def _met(left: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members (key, a, component, n, p...) of one bucket, in different components, that may be linked.

    A bucket of many members is dealt out in cells: some of its members against some, each pair in one cell.
    """
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = left.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    across = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = dealt.withColumn("other", across).drop("blocks")
    y = _other(left, key="key", component="second").join(sizes, "key").withColumn("other", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    y = y.withColumn("block", across).drop("blocks")
    return x.join(y, ["key", "block", "other"]).where(f"a < b and component <> second and {_possible(threshold)}").select("a", "b").distinct()


def near_duplicates(documents: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``documents`` (doc_id, text).

    Links join documents whose sets of ``words``-word shingles have a Jaccard similarity of at
    least ``threshold`` percent; a component is named by its least doc_id.
    """
    return _judged(documents, words, threshold, False).select("doc_id", "n_shingles", "component_id", "kept")


def _by_digest(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` (digest, ...) with what their class is ``named`` (digest, copies, named), null for those without one.

    Classes of very many rows are sent to the rows: each has more than ``most`` copies, so there are at
    most ``SENT_KEYS`` of them. Rows of all other classes meet theirs by a shuffle, rows without one by none.
    """
    most = max(SHARE, rows.count() // SENT_KEYS)
    large = F.broadcast(named.where(F.col("copies") > most).select("digest", "named"))
    others = named.where(F.col("copies") <= most).select("digest", "named")
    held = rows.where("digest is not null")
    of_large = held.join(large, "digest")
    of_others = held.join(large, "digest", "left_anti").join(others, "digest", "left")
    none = rows.where("digest is null").withColumn("named", F.lit(None).cast("long"))
    return of_large.unionByName(of_others).unionByName(none)


def _text_hash() -> Column:
    return F.unhex(F.sha2(F.encode(F.col("text").cast("string"), "UTF-8"), 256))


def _judged(documents: DataFrame, words: int, threshold: int, hashed: bool) -> DataFrame:
    """What ``near_duplicates`` gives, with the digests of the sets and, if ``hashed``, of the texts without an id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if hashed:
        docs = docs.withColumn("text_hash", F.when(F.col("doc_id").isNull(), _text_hash()))
    scratch = Scratch(docs.sparkSession)
    table = scratch.table
    signed = table(signatures(docs, words, hashed), "signatures")
    classes = table(
        signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("a"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity")),
        "classes",
    )
    facts = classes.select("a", "n", *(F.col("parity")[k].alias(p) for k, p in enumerate(PARITY)))
    # dealt out once, for the count and for the rows
    rows = classes.select("a", F.explode("bands").alias("key")).repartition("key")
    shared_keys = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = table(rows.join(shared_keys, "key"), "buckets")  # of buckets that hold more than one class
    rows = table(met.join(_central(met), "key"), "starred")
    scratch.drop(met)

    star = rows.where("a <> b").select("a", "b").distinct()
    star = table(star.join(facts, "a").join(_other(facts), "b").where(_possible(threshold)).select("a", "b"), "pairs")
    sets = table(_sets(docs, star.select("a").union(star.select("b")).distinct(), words), "sets")
    links = table(_verified(star, sets, threshold), "links")
    scratch.drop(sets)
    found = components(links)

    starred = rows
    rows = table(_undecided(rows, found), "undecided")
    scratch.drop(starred)
    small = rows.where(F.col("members") <= DIRECT).select("key", "a", "component")
    large = rows.where(F.col("members") > DIRECT)
    # buckets with one central member are one from here on
    large = table(large.select(F.col("b").alias("key"), "a", "component", "b").distinct(), "large")
    asked, rounds, cost = None, 0, _comparisons(large)
    while cost:
        center = large.select("b").distinct().join(found.withColumnRenamed("node", "b"), "b", "left").select("b", F.coalesce("component", "b").alias("center"))
        members = table(large.where("a <> b").join(center, "b"), "members")
        held, of = asked, members.select("a").union(members.select("b")).distinct()
        # a round's members are among those of the round before, so texts are read for the first round alone
        asked = table(_sets(docs, of, words) if held is None else held.join(sent_if_few(of, BROADCAST_IDS), "a", "left_semi"), "sets")
        scratch.drop(held)
        differences = table(_differences(members.select("a", "b").distinct(), asked, threshold), "differences")
        found = extended(found, differences.where("linked").select("a", "b"))
        split = table(_split(members, differences, threshold), "split")
        scratch.drop(differences, members)
        made = table(_undecided(_distinct_buckets(split), found), "undecided")
        scratch.drop(split)
        limit, rounds, before, cost = DIRECT, rounds + 1, cost, _comparisons(made.where(F.col("members") > DIRECT))
        if cost > max(CHEAP, before):
            # members meet more often in the new buckets than in those these were made from
            made, cost = _undecided(large.select("key", "a"), found), 0
        elif cost > CHEAP:
            limit = LATER * DIRECT
            cost = _comparisons(made.where(F.col("members") > limit))
            cost = cost if 4 * cost <= before else 0
        elif rounds >= ROUNDS:
            cost = 0
        if not cost:
            small = small.unionByName(made.select("key", "a", "component"))
            break
        small = small.unionByName(made.where(F.col("members") <= limit).select("key", "a", "component"))
        scratch.drop(large)
        further = made.where(F.col("members") > limit)
        large = table(further.join(_central(further), "key").select("key", "a", "component", "b"), "large")

    scratch.drop(asked)

    left = table(small.join(facts, "a"), "small")
    more = _met(left, threshold)
    # both ways round the star's pairs, which have been judged
    judged = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = table(more.join(judged, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        sets = table(_sets(docs, more.select("a").union(more.select("b")).distinct(), words), "sets")
        found = extended(found, table(_verified(more, sets, threshold), "links"))
    named = classes.select("digest", "a", "copies").join(found.withColumnRenamed("node", "a"), "a", "left").select("digest", "copies", F.coalesce("component", "a").alias("named"))
    extra = ["text_hash"] if hashed else []
    placed = _by_digest(signed.select("digest", *extra, "doc_id", "n_shingles"), table(named, "named"))
    judged = placed.select("digest", *extra, "doc_id", "n_shingles", F.coalesce("named", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("named", "doc_id"), F.lit(False)).alias("kept"))
    return scratch.only(judged, "judged")


def one_of_each(documents: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``documents``, all columns, that stay when one document of each group is kept.

    Repeated rows (same id, same text) are one row. Rows without an id go if a document with an id has
    their shingle set; of those left with one set a single row stays. Near copies among rows without
    an id, and such rows without words, all stay.
    """
    judged = _judged(documents, words, threshold, True)
    doc_id = F.col("doc_id").cast("long")
    gone = judged.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_paperloom_id")).distinct()
    known = documents.where(doc_id.isNotNull()).join(sent_if_few(gone, BROADCAST_IDS), doc_id == F.col("_paperloom_id"), "left_anti")
    loose = judged.where("doc_id is null and digest is not null").select("digest", "component_id", "text_hash").distinct()
    first = loose.groupBy("digest").agg(F.min("text_hash").alias("first"))
    settled = loose.join(first, "digest").where("component_id is not null or text_hash <> first").select(F.col("text_hash").alias("_paperloom_text")).distinct()
    unknown = documents.where(doc_id.isNull()).join(sent_if_few(settled, BROADCAST_IDS), _text_hash() == F.col("_paperloom_text"), "left_anti")

    has_words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.when(doc_id.isNotNull() | has_words, F.struct(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.coalesce(_text_hash(), F.lit(b"")).alias("text")))
    # only digests are grouped over all rows; texts of repeated rows alone
    repeated = materialize(documents.select(key.alias("_paperloom_key")).where("_paperloom_key is not null").groupBy("_paperloom_key").agg(F.count("*").alias("n")).where("n > 1").select("_paperloom_key"), "repeated")
    rows = known.unionByName(unknown)
    if repeated.isEmpty():
        return rows
    rows, repeated = rows.withColumn("_paperloom_key", key), sent_if_few(repeated, BROADCAST_IDS)
    single = rows.join(repeated, "_paperloom_key", "left_anti")
    several = rows.join(repeated, "_paperloom_key", "left_semi").dropDuplicates(["_paperloom_key"])
    return single.unionByName(several).drop("_paperloom_key")
