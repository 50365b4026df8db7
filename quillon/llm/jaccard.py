"""N-gram Jaccard self-join by vertical partitioning.

The shingles of a document are 64-bit hashes, and their global order is that of the hashes.

* Shared shingles. The order is cut into fragments of about `FRAGMENT_ROWS` shingles each. Every
  fragment counts by itself which of the shingles of half the hash space occur once only; the counts are
  summed per document. A set with more such shingles than a linked set may have for itself is left
  out; it has no partner. Few sets of most corpora are left.
* Candidates. Two sets that link differ in at most D shingles, and D follows from their sizes. The
  order is cut into D + 1 + spare fragments, so at least `spare` + 1 fragments hold the same
  shingles in both sets. Each set that is left has one signature per fragment that is not empty, in
  its own class of sizes and in a smaller class from which a partner may come. A set with more
  empty fragments than `spare` has others under another order of the hashes; two such sets share
  that order too, so no pair is lost. In classes of few shingles the first shingles of a set in the
  global order (as many as a linked partner cannot all lack) are its signatures instead.
* Copies. Documents with the same set form one class; only classes are compared.
* Pairs. Groups of classes with the same signature are compared hub by hub (see `hubs`); a very
  large group that its hub does not connect is split by signatures under further orders, which
  linked pairs share as well. A pair whose parity sketches (one bit per residue of the hashes)
  differ in more bits than linked sets differ in shingles cannot link and is left out.
* Overlap. The order is cut into `FRAGMENTS`; the overlap of a pair is counted per fragment with
  a join on (class, fragment) and summed per pair.

What is broadcast has a fixed size: a bitmap of `BITMAP_BITS` that tells which documents to read
again, which can only let too much through. Joins on names that may be hot have plain shuffles on
both sides, which Spark splits. A class is named by a 64-bit hash of its set.

Defined results: documents without words (or null) have an empty set and are linked with nothing;
fewer words than the shingle size give one shingle; null doc_ids take part, but a component is
named by its smallest doc_id that is not null; repeated rows are copies of each other; doc_ids are
integers, or text of integers.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACED, U64, bounded_batches, free_name, mix64, release_memory, run_hashes, slices, small_or_not, stage, table, text_bytes, tidy, unstage, word_hashes, words
from .hubs import link_groups

FRAGMENTS = 8
FRAGMENT_ROWS = 1 << 21
SIZE_RATIO = 1.25
ORDERS = 6
SMALL_SET = 24
BITMAP_BITS = 25
SKETCH_LONGS = 16
#: Text handled at once in a worker, as each word takes several times its bytes.
TEXT_BYTES = 1 << 20


@lru_cache(maxsize=None)
def size_class(k: int) -> tuple[int, int]:
    """Class k holds the sizes [low, high)."""
    low = 1 if k == 0 else size_class(k - 1)[1]
    return low, max(low + 1, math.ceil(low * SIZE_RATIO))


@lru_cache(maxsize=None)
def fragments_of(k: int, num: int, den: int) -> tuple[int, int]:
    """(fragments, spare) for pairs whose smaller set is in class k; one fragment means equal sets only."""
    low, high = size_class(k)
    most = high - 1 + (high - 1) * den // num
    # of sizes that sum to t, the overlap must be num * t / (num + den), rounded up
    differ = max(t - 2 * -(-num * t // (num + den)) for t in range(max(2, most - 4 * (num + den) // num - 40), most + 1))
    if differ <= 0:
        return 1, 0
    spare = 0
    for _ in range(4):  # as many as are empty in a set of the least size, with some to spare
        empty = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
        spare = math.ceil(empty + 2 * math.sqrt(empty)) if empty > 0.05 else 0
    return differ + 1 + spare, spare


@lru_cache(maxsize=None)
def classes_of(size: int, num: int, den: int) -> tuple[int, ...]:
    """The classes in which a set of this size meets partners: its own, and those of smaller partners."""
    k = 0
    while size_class(k)[1] <= size:
        k += 1
    least, out = -(-size * num // den), []
    while k >= 0 and size_class(k)[1] > least:
        if fragments_of(k, num, den)[0] > 1:
            out.append(k)
        k -= 1
    return tuple(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles of all rows one after another, number of each row)."""
    rows = len(offsets) - 1
    s, e, row = words(data, offsets, SPACED)
    h = word_hashes(LOWER[data], s, e)
    counts = np.bincount(row, minlength=rows)
    runs = run_hashes(h, n)
    keep = row[: len(runs)] == row[n - 1 :][: len(runs)]
    runs, of = runs[keep], row[: len(runs)][keep]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        whole = [run_hashes(h[first[i] : first[i] + counts[i]], int(counts[i]))[0] for i in short]
        runs, of = np.concatenate([runs, np.array(whole, U64)]), np.concatenate([of, short])
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    return runs[new], np.bincount(of[new], minlength=rows)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[ends], prepend=U64(0))


def set_names(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix64(_sums(mix64(shingles ^ U64(0x5851F42D4C957F2D)), np.cumsum(sizes)) + sizes.astype(U64))


def signatures(shingles: np.ndarray, num: int, den: int, level: int = 0) -> np.ndarray:
    """The signatures of one set, given sorted; their low 8 bits are the class of sizes. Every level
    has orders of its own, and linked sets share a signature in each."""
    out, n = [], len(shingles)
    turned = np.sort(mix64(shingles + U64((level * ORDERS) * 0x9E3779B97F4A7C15 % (1 << 64)))) if level else shingles
    for k in classes_of(n, num, den):
        if size_class(k)[1] <= SMALL_SET:
            found = mix64(turned[: n - -(-n * num // den) + 1] + U64(k))
            out.append((found & ~U64(255)) | U64(k))
            continue
        count, spare = fragments_of(k, num, den)
        for order in range(ORDERS):
            h = turned if order == 0 else np.sort(mix64(shingles + U64((level * ORDERS + order) * 0x9E3779B97F4A7C15 % (1 << 64))))
            fragment = ((h >> U64(32)) * U64(count)) >> U64(32)
            ends = np.append(np.flatnonzero(fragment[1:] != fragment[:-1]) + 1, n)
            part = fragment[ends - 1]
            sums = _sums(mix64(h), ends)
            if order == ORDERS - 1 and count - len(ends) > spare:
                absent = np.setdiff1d(np.arange(count, dtype=U64), part)
                part, sums = np.append(part, absent), np.append(sums, np.zeros(len(absent), U64))
            found = mix64(sums + mix64(part + U64((k * ORDERS + order) << 32)))
            out.append((found & ~U64(255)) | U64(k))
            if count - len(ends) <= spare:
                break
    return np.concatenate(out) if out else np.zeros(0, U64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles per residue: in at most as many bits as the sets differ."""
    odd = np.bincount((shingles & U64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _rows(docs: DataFrame, schema: str, n: int, make, bitmap=None) -> DataFrame:
    """A pass over docs: make(batch slice, shingles, sizes) gives the columns of the schema. With a
    bitmap only of the rows whose place has a bit set."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    made = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                at = batch.column("place").to_numpy()
                batch = batch.filter(pa.array((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(batch, "text", TEXT_BYTES):
                columns = make(part, *shingle_sets(*text_bytes(part.column("text")), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(tidy(run), made)


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs: doc_id, text_hash, text. Returns doc_id, text_hash, n_shingles, class."""
    def make(part, shingles, sizes):
        return part.column("doc_id"), part.column("text_hash"), sizes, set_names(shingles, sizes).view(np.int64)

    return _rows(docs, "doc_id bigint, text_hash bigint, n_shingles bigint, class bigint", n, make)


def _cut(n: int, fragments: int):
    """One row per slice of documents and fragment: the shingles of half the hash space in the
    fragment (their next 32 bits) and the places of their sets in the slice. One row of a slice also
    names its sets and their sizes. Of shingles that occur often in a slice, two are enough."""

    def make(part, shingles, sizes):
        names = set_names(shingles, sizes)
        some = np.flatnonzero(sizes > 0)
        _, first = np.unique(names[some], return_index=True)
        one = np.zeros(len(sizes), bool)
        one[some[first]] = True
        place = np.cumsum(one) - 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        use = one[row] & (shingles & U64(1) == 0)
        of, h = place[row[use]].astype(np.uint32), shingles[use]
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        often = np.zeros(len(h), bool)
        often[2:] = h[2:] == h[:-2]
        h, of = h[~often], of[~often]
        fragment = (((h >> U64(32)) * U64(fragments)) >> U64(32)).astype(np.int64)
        low = (h >> U64(1)).astype(np.uint32)
        mine, sizes_of = names[one], sizes[one].astype(np.uint32)
        batch = int(mix64(_sums(mix64(mine + np.arange(len(mine), dtype=U64)), np.array([len(mine)])))[0].view(np.int64)) if len(mine) else 0
        narrow = np.uint16 if len(mine) <= 1 << 16 else np.uint32
        starts = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1])) if len(h) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(h)).astype(np.int64)
        rows = [(int(fragment[a]), batch, low[a:b].tobytes(), of[a:b].astype(narrow).tobytes(), None, None) for a, b in zip(starts.tolist(), ends.tolist())]
        if len(mine):
            rows.append((batch % fragments, batch, b"", b"", mine.tobytes(), sizes_of.tobytes()))
        return tuple(zip(*rows)) if rows else ([],) * 6

    return make


def _single(rows: pa.Table) -> pa.Table:
    """For one fragment: per slice, the places of the sets and how many of their shingles occur once."""
    heads = rows.filter(rows.column("names").is_valid()).select(["batch", "names", "sizes"])
    rows = rows.filter(rows.column("names").is_null())
    low = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("low")]
    of = [np.frombuffer(x.as_buffer(), np.uint16 if len(x.as_buffer()) == 2 * len(y) else np.uint32) for x, y in zip(rows.column("of"), low)]
    counts = np.array([len(x) for x in low], np.int64)
    ends, places, times = np.cumsum(counts), [], []
    if len(low):
        all_low = np.concatenate(low)
        order = np.argsort(all_low, kind="stable")
        sorted_low = all_low[order]
        other = np.ones(len(order), bool)
        other[1:] = sorted_low[1:] != sorted_low[:-1]
        alone = np.zeros(len(order), bool)
        alone[order] = other & np.append(other[1:], True)[: len(order)]
        for x, b, k in zip(of, ends.tolist(), counts.tolist()):
            found = np.bincount(x[alone[b - k : b]]) if k else np.zeros(0, np.int64)
            at = np.flatnonzero(found)
            places.append(at.astype(np.uint32).tobytes())
            times.append(found[at].astype(np.uint32).tobytes())
    none = pa.nulls(len(low), pa.binary())
    out = pa.table({"batch": rows.column("batch").combine_chunks(), "places": pa.array(places, pa.binary()), "times": pa.array(times, pa.binary()), "names": none, "sizes": none})
    blank = pa.nulls(heads.num_rows, pa.binary())
    return pa.concat_tables([out, pa.table({"batch": heads.column("batch"), "places": blank, "times": blank, "names": heads.column("names"), "sizes": heads.column("sizes")})])


def _lonely(num: int, den: int):
    """For one slice: the classes with more shingles of their own than a linked set may have."""

    def run(rows: pa.Table) -> pa.Table:
        head = rows.filter(rows.column("names").is_valid())
        out = np.zeros(0, np.int64)
        if head.num_rows:
            names, sizes = (np.frombuffer(head.column(c)[0].as_buffer(), t) for c, t in (("names", np.int64), ("sizes", np.uint32)))
            total, sizes = np.zeros(len(names), np.int64), sizes.astype(np.int64)
            for at, times in zip(rows.column("places").to_pylist(), rows.column("times").to_pylist()):
                if at:
                    np.add.at(total, np.frombuffer(at, np.uint32).astype(np.int64), np.frombuffer(times, np.uint32).astype(np.int64))
            out = names[total > sizes - -(-sizes * num // den)]
        return pa.table({"class": pa.array(out, pa.int64())})

    return run


def partnered_sets(docs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """class, n_shingles, doc_id, text_hash (of one document) of the sets that may link with another."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(16, -(-total // (2 * FRAGMENT_ROWS)))
    cut = _rows(docs, "fragment int, batch bigint, low binary, of binary, names binary, sizes binary", n, _cut(n, fragments))
    single = cut.groupBy("fragment").applyInArrow(_single, "batch bigint, places binary, times binary, names binary, sizes binary")
    lonely = stage(single.groupBy("batch").applyInArrow(_lonely(num, den), "class bigint").distinct(), "jaccard-lonely")
    one = sets.where(F.col("n_shingles") > 0).groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("n_shingles").alias("n_shingles"))
    out = stage(one.join(lonely, "class", "left_anti").select("class", "n_shingles", "one.*"), "jaccard-partnered")
    unstage(lonely)
    return out


def _place(*columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITMAP_BITS)


def bitmap_of(rows: DataFrame, *columns: str) -> np.ndarray:
    """One bit for the hash of the columns of each row: 2 ** BITMAP_BITS bits in bytes, whatever the input."""
    place = _place(*columns)
    word = rows.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    word = word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    got = word.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def kept_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class and sorted shingles of the wanted sets, each read again from one document."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "doc_id", "text_hash"))
    release_memory()
    placed = docs.select("text", _place("doc_id", "text_hash").alias("place"))

    def make(part, shingles, sizes):
        ends = np.cumsum(sizes)
        names = set_names(shingles, sizes).view(np.int64)
        use = np.flatnonzero(sizes > 0)
        _, first = np.unique(names[use], return_index=True)
        use = np.sort(use[first])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[use])).astype(np.int32)), pa.array(np.concatenate([shingles[ends[i] - sizes[i] : ends[i]] for i in use.tolist()]).view(np.int64) if len(use) else np.zeros(0, np.int64)))
        return names[use], lists

    found = _rows(placed, "class bigint, shingles array<bigint>", n, make, bitmap)
    return found.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles"))


def _of_sets(kept: DataFrame, schema: str, make) -> DataFrame:
    """A pass over kept sets: make(class, shingles) gives the columns of one set's rows."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(kept.sparkSession)
    made = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            values, offsets = lists.values.to_numpy().view(U64), lists.offsets.to_numpy()
            for at in range(0, batch.num_rows, 512):
                found = [make(values[a:b]) for a, b in zip(offsets[at : at + 512].tolist(), offsets[at + 1 : at + 513].tolist())]
                times = [len(x[0]) for x in found]
                names = np.repeat(batch.column("class").to_numpy()[at : at + 512], times)
                columns = [names, *(pa.concat_arrays([pa.array(y, f.type) for y in x]) if x else pa.array([], f.type) for x, f in zip(zip(*found), list(arrow)[1:]))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.select("class", "shingles").mapInArrow(tidy(run), made)


def set_signatures(kept: DataFrame, num: int, den: int, level: int = 0) -> DataFrame:
    def make(x):
        found = np.unique(signatures(x, num, den, level)).view(np.int64)
        return found, np.full(len(found), len(x))

    return _of_sets(kept, "class bigint, sig bigint, n bigint", make)


def set_sketches(kept: DataFrame) -> DataFrame:
    return _of_sets(kept, "class bigint, sketch array<bigint>", lambda x: ([sketch(x)],))


def set_fragments(kept: DataFrame) -> DataFrame:
    """class, n, fragment and its shingles."""
    def make(x):
        fragment = (((x >> U64(32)) * U64(FRAGMENTS)) >> U64(32)).astype(np.int64)
        there = np.unique(fragment)
        return np.full(len(there), len(x)), there, [x[fragment == f].view(np.int64) for f in there]

    return _of_sets(kept, "class bigint, n bigint, fragment int, shingles array<bigint>", make)


def _differ(total: Column, num: int, den: int) -> Column:
    """The most in which linked sets of these sizes differ."""
    return total - 2 * F.ceil(total * num / (num + den))


def _apart(x: str, y: str) -> Column:
    return reduce(operator.add, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_LONGS)])


def _links(pairs: DataFrame, sketches: DataFrame, fragments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b that link, by overlaps counted per fragment."""
    of = lambda x: sketches.select(F.col("class").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(_apart("a_sketch", "b_sketch") <= _differ(F.col("a_n") + F.col("b_n"), num, den)).select("a", "b", "a_n", "b_n")
    left = fragments.select(F.col("class").alias("a"), "fragment", F.col("shingles").alias("of_a"))
    right = fragments.select(F.col("class").alias("b"), "fragment", F.col("shingles").alias("of_b"))
    partial = near.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "a_n", "b_n", F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    total = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("common").alias("common"))
    return total.where(F.col("common") * den >= (F.col("a_n") + F.col("b_n") - F.col("common")) * num).select("a", "b")


def link_classes(docs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """class, root: the components of different sets that link; classes linked with none are absent (None: all are)."""
    wanted = partnered_sets(docs, sets, n, num, den)
    kept = stage(kept_sets(docs, wanted, n), "jaccard-kept")
    sizes = wanted.select("class", F.col("n_shingles").alias("n"))
    found = stage(set_signatures(kept, num, den), "jaccard-found")
    shared = stage(found.groupBy("sig").agg(F.count("*").alias("times")).where("times > 1").select("sig"), "jaccard-shared")
    groups = stage(found.join(shared, "sig"), "jaccard-groups")
    unstage(found, shared)
    linked = groups.select("class").distinct()
    some = kept.join(linked, "class", "left_semi")
    fragments = stage(set_fragments(some), "jaccard-fragments")
    sketches = stage(set_sketches(some).join(sizes, "class"), "jaccard-sketches")
    # the more signatures a class shares, the likelier it is the middle of its group
    shares = stage(groups.groupBy("class").agg(F.count("*").alias("shares")), "jaccard-shares")
    members = groups.join(shares, "class").select("sig", "class", "n", "shares")
    near = F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num
    close = near & (_apart("sketch", "hub_sketch") <= _differ(F.col("n") + F.col("hub_n"), num, den))

    def with_sketches(rest: DataFrame) -> tuple[DataFrame, list[str], Column]:
        return rest.join(sketches.select("class", "sketch"), "class"), ["sketch"], close

    def split(classes: DataFrame, level: int) -> DataFrame:
        return set_signatures(kept.join(classes, "class", "left_semi"), num, den, level).select("class", F.col("sig").alias("sig2"))

    labels = link_groups(members, ["n"], near, lambda pairs: _links(pairs, sketches, fragments, num, den), "jaccard", with_sketches, split)
    unstage(wanted, kept, groups, fragments, sketches, shares)
    return labels


def jaccard_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (null for empty sets) and root, the class that names the component. A staged table."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sets = stage(document_sets(keyed, n), "jaccard-sets")
    labels = link_classes(keyed, sets, n, num, den)
    rows = sets.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class"))
    rows = rows.withColumn("root", F.col("class")) if labels is None else rows.join(labels, "class", "left").select(*rows.columns, F.coalesce("root", "class").alias("root"))
    out = stage(rows, "jaccard-roots")
    unstage(sets, labels)
    return out


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id: documents link when
    den * intersection >= num * union of their distinct n-word shingles."""
    rows = jaccard_sets(docs, n, num, den)
    named = stage(rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-named")
    return rows.join(named, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), then the
    smallest text hash; of rows that share both, any one. Rows without words all stay, repeated or
    not, as they are linked with nothing. Other columns may have any names and are not compared."""
    number, at = free_name(docs, "jaccard_row"), free_name(docs, "jaccard_at")
    rows = jaccard_sets(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), n, num, den)
    linked = rows.where(F.col("root").isNotNull())
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = linked.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows"))
    # of each component with several rows: the place that stays; all other places of it go
    kept = stage(kept.where("rows > 1").select("root", "first"), "jaccard-first")
    marked = linked.join(kept, "root").groupBy("doc_id", "text_hash").agg(F.max((place == F.col("first")).cast("int")).alias("stays"), F.count("*").alias("rows"))
    marked = stage(marked.where("stays = 0 OR rows > 1"), "jaccard-marked")
    gone = marked.where("stays = 0").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    keyed = docs.withColumn(number, F.col(f"`{doc_id}`").cast("bigint")).withColumn(at, F.xxhash64(F.col(f"`{text}`")))
    gone = small_or_not(gone, 64)
    out = keyed.join(gone, F.col(number).eqNullSafe(F.col("gone_id")) & (F.col(at) == F.col("gone_hash")), "left_anti")
    again = marked.where("stays = 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))
    if again.take(1):  # rows that share doc_id and text
        same = F.col(number).eqNullSafe(F.col("again_id")) & (F.col(at) == F.col("again_hash"))
        again = small_or_not(again, 64)
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([number, at]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)


ORACLE_SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS k FROM doc_words WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM doc_words
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM doc_words d LEFT JOIN size s USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id
"""
