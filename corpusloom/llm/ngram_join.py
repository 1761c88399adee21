"""Near-duplicate components by a grouped prefix join on word shingles.

A document is the set of hashes of its distinct shingles. All sets are sorted by one order, frequent
shingles last; two sets with Jaccard similarity ``t`` or more share a shingle among their first
``n - ceil(t n) + 1``, their prefixes. The steps:

1. Shingles that repeat inside Arrow batches are summed up; the frequent ones form a filter of fixed
   size. It only decides the order, and any order gives the same result.
2. Documents with the same prefix and set size are one group, so thousands of copies are one row.
3. Groups that share a prefix shingle are candidates. A prefix is all of a set below its last shingle, so two
   prefixes bound the difference of the sets from below: first by counts that ride along with each shingle, then
   on the prefixes themselves. Pairs beyond the bound are dropped before any set is read.
4. The remaining pairs are expanded to classes (documents with equal sets) and verified on whole sets.

Steps 3 and 4 run twice. First only one group of each prefix shingle, its hub, is paired with the others, each group by
one of its sets, which joins a family of copies by a star instead of all its pairs. The hub is the group with most frequent shingles in its prefix: of
a family it is a copy that was edited little. Then pairs of groups that still lie in different components are tried, and
the other sets of the groups of a star pair, so no link between components is lost. What two sets share with the same hub bounds their difference once more, which
proves most members of a family that are too far from its hub too far from each other as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm import bitmaps, blocks
from corpusloom.llm.components import components
from corpusloom.llm.registry import fresh
from corpusloom.llm.stored import small, stored

WORDS = 5
PERCENT = 80
FREQUENT = 20
_LAST = np.uint64(1 << 62)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hashes of each row's distinct shingles, sorted, and the n + 1 bounds of the rows."""
    starts, ends, bounds = blocks.spans(data, offsets, blocks.NOT_SPACE)
    hashed = blocks.hashes(data, starts, ends, lower=True)
    size = np.diff(bounds)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    values = np.empty(at[-1], dtype=np.uint64)
    grams = blocks.grams(hashed, words)
    values[np.repeat(size >= words, count)] = grams[blocks.inner(bounds, words, len(grams))]
    for m in np.unique(size[(size > 0) & (size < words)]):
        rows = np.flatnonzero(size == m)
        whole = np.full(len(rows), m, dtype=np.uint64)
        for k in range(m):
            whole = whole * np.uint64(0x2545F4914F6CDD1D) + hashed[bounds[rows] + k]
        values[at[rows]] = blocks.mix(whole)
    values >>= np.uint64(2)
    return _distinct(values, at)


def _distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    begins = at[:-1][at[:-1] < len(values)]
    new[begins] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[at]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash per row of a flat array of sets."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(blocks.mix(values + np.uint64(1)), dtype=np.uint64)])
    return blocks.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _repeated(words: int):
    """Shingles that occur in two documents of a batch or more, with that number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_sets(data, offsets, words)[0] for _, _, data, offsets in blocks.blocks(batch.column(0))]
            values = np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)
            count = np.diff(np.append(first, len(values)))
            many = count > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[first[many]].view(np.int64)), pa.array(count[many])], names=["s", "c"])

    return rows


def _prefixes(frequent: Broadcast, words: int, percent: int):
    """Per document: set size, hash of the set, prefix and hash of the prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = frequent.value
        for batch in batches:
            for first, end, data, offsets in blocks.blocks(batch.column(4)):
                values, bounds = shingle_sets(data, offsets, words)
                key, n = _sums(values, bounds), np.diff(bounds)
                values[bitmaps.maybe(packed, values)] |= _LAST
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    values[a:b].sort()
                length = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                inside = np.arange(len(values)) - np.repeat(bounds[:-1], n) < np.repeat(length, n)
                prefix, at = values[inside], np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, end - first) for i in range(4)),
                        pa.array(n),
                        pa.array(key.view(np.int64)),
                        blocks.list_array(prefix.view(np.int64), at, pa.int64()),
                        pa.array((_sums(prefix, at) ^ n.astype(np.uint64)).view(np.int64)),
                    ],
                    names=["rid", "id", "ra", "rb", "n", "key", "prefix", "gid"],
                )

    return rows


def _shared(twice: Broadcast):
    """Of each prefix the shingles that another group's prefix may hold, too.

    With each go the counts that bound differences: us, the shingles before it that no other prefix holds; us_all, those of
    the whole prefix; last, its last shingle; rare, how many of its shingles aren't frequent.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            at = at - at[0]
            keep = bitmaps.maybe(twice.value, values)
            row = np.repeat(np.arange(len(lists)), np.diff(at))
            alone = np.concatenate([[0], np.cumsum(~keep)])
            rare = np.concatenate([[0], np.cumsum(values < _LAST)])
            before = alone[:-1] - alone[at[:-1]][row]
            per_row = [alone[at[1:]] - alone[at[:-1]], values[at[1:] - 1].view(np.int64), rare[at[1:]] - rare[at[:-1]]] if len(lists) else [at[:0]] * 3
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(values[keep].view(np.int64)), pa.array(before[keep]),
                    *(pa.array(c[row[keep]]) for c in per_row),
                ],
                names=["gid", "n", "s", "us", "us_all", "last", "rare"],
            )

    return rows


def _sets(keys: Broadcast, rows_of: Broadcast, words: int):
    """Whole sets of the documents asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = np.flatnonzero(bitmaps.maybe(rows_of.value, batch.column(0).to_numpy()))
            for _, _, data, offsets in blocks.blocks(batch.column(1).take(pa.array(asked))):
                values, bounds = shingle_sets(data, offsets, words)
                key = _sums(values, bounds)
                some = np.flatnonzero(bitmaps.maybe(keys.value, key))
                lists = blocks.list_array(values.view(np.int64), bounds, pa.int64()).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), lists], names=["key", "shingles"])

    return rows


def _with_both(pairs: DataFrame, count: int, rows: DataFrame, key: str, a: str, b: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Pairs with columns of ``rows`` (one row per key) for both ends.

    The arrays in ``rows`` move at most once for each pair: the ends b meet theirs first, where the pairs are
    small without a shuffle, and then the rows of the ends a, which no other row joins. ``pairs`` is a stored table of ``count`` rows.
    """
    ends = rows.select(F.col(key).alias(b), *(F.col(c).alias(to) for c, (_, to) in columns.items()))
    ends = ends.join(small(pairs, count), b)
    heads = rows.select(F.col(key).alias(a), *(F.col(c).alias(to) for c, (to, _) in columns.items()))
    heads = heads.join(small(pairs.select(a).distinct(), count), a, "left_semi")
    return ends.join(heads, a)


def _named(pairs: DataFrame, count: int, head: DataFrame) -> DataFrame:
    """Pairs of groups with the sets that stand for them, a and b."""
    a = head.select(F.col("gid").alias("ga"), F.col("head").alias("a"))
    b = head.select(F.col("gid").alias("gb"), F.col("head").alias("b"))
    return small(pairs, count).join(a, "ga").join(b, "gb")


def _mark(label: str, gid: str) -> Column:
    """The component of a group, or the group itself where it is alone or lies in several."""
    own = F.struct(F.lit(1).alias("x"), F.col(gid).alias("y"))
    return F.when(F.col(label).isNotNull(), F.struct(F.lit(0).alias("x"), F.col(label).alias("y"))).otherwise(own)


class _Join:
    """The steps over one table of documents."""

    def __init__(self, documents: DataFrame, id_: str, text: str, words: int, percent: int):
        self.words, self.percent = words, percent
        whole = F.col(text).cast("string")
        self.source = documents.select(
            F.monotonically_increasing_id().alias("rid"), F.col(id_).alias("id"), F.xxhash64(F.col(id_), whole).alias("ra"), F.xxhash64(F.lit("second"), F.col(id_), whole).alias("rb"), whole.alias("text")
        )
        repeated = self.source.select("text").mapInArrow(_repeated(words), "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
        frequent, seen = stored(repeated.filter(F.col("c") >= FREQUENT))
        room, total = bitmaps.BITS // 16, seen["rows"]
        if total > room:  # the filter stays selective: the most frequent shingles go last
            frequent = frequent.filter(F.col("c") > frequent.approxQuantile("c", [1 - room / total], 0.001)[0])
        kind = dict(self.source.dtypes)["id"]
        self.rows, seen = stored(self.source.mapInArrow(
            _prefixes(bitmaps.build(frequent, "s", bitmaps.bits_for(total)), words, percent),
            f"rid long, id {kind}, ra long, rb long, n long, key long, prefix array<long>, gid long",
        ))
        some = self.rows.filter("n > 0")
        #: One row per set: its group, size and the document that stands for it.
        self.classes = some.groupBy("key", "gid", "n").agg(F.min("ra").alias("ra")).checkpoint()
        self.repeated = self.rows.select("ra").distinct().count() < seen["rows"]
        one, seen = stored(some.groupBy("gid").agg(F.min("rid").alias("rid")).select("rid"))
        one = small(one, seen["rows"])
        self.groups = some.select("rid", "gid", "n", "prefix").join(one, "rid", "left_semi").drop("rid")

    def buckets(self) -> DataFrame:
        """One row per group and prefix shingle that several groups have (and a few more), with the counts of ``_shared``."""
        twice = self.groups.select(F.explode("prefix").alias("s")).groupBy("s").count().filter("count > 1")
        schema = "gid long, n long, s long, us long, us_all long, last long, rare long"
        return self.groups.select("gid", "n", "prefix").mapInArrow(_shared(bitmaps.build(twice, "s")), schema).checkpoint()

    def possible(self, apart: Column, na: Column, nb: Column) -> Column:
        """Sets that differ in ``apart`` shingles at least can be similar: at most (1 - t) / (1 + t) of their sizes."""
        return (apart * (100 + self.percent) <= (na + nb) * (100 - self.percent)) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * self.percent)

    def measured(self, pairs: DataFrame, count: int) -> DataFrame:
        """(ga, gb, lo, hi, near): bounds of what the sets of two groups share, and whether they can be similar, by their prefixes."""
        both = _with_both(pairs, count, self.groups, "gid", "ga", "gb", {"n": ("na", "nb"), "prefix": ("pa", "pb")})
        last = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
        shared = F.size(F.array_intersect("pa", "pb"))
        apart = sum((F.size(F.filter(p, lambda x: x <= last)) for p in ("pa", "pb")), -2 * shared)
        both = both.select("ga", "gb", "na", "nb", shared.cast("long").alias("lo"), apart.alias("apart"))
        hi = F.floor((F.col("na") + F.col("nb") - F.col("apart")) / 2)
        return both.select("ga", "gb", "lo", hi.alias("hi"), self.possible(F.col("apart"), F.col("na"), F.col("nb")).alias("near"))

    def verified(self, pairs: DataFrame, count: int) -> DataFrame:
        """(a, b, shared, similar) of pairs (a, b) of set keys, on whole sets."""
        asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        asked, seen = stored(asked.join(self.classes, "key").select("key", "ra"))
        bits = bitmaps.bits_for(seen["rows"])
        found = self.source.select("ra", "text").mapInArrow(
            _sets(bitmaps.build(asked, "key", bits), bitmaps.build(asked, "ra", bits), self.words), "key long, shingles array<long>"
        )
        if self.repeated:
            found = found.join(small(asked.select("key"), 2 * count), "key", "left_semi").dropDuplicates(["key"])
        both = _with_both(pairs, count, found, "key", "a", "b", {"shingles": ("sa", "sb")})
        both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("sizes"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))
        return both.select("a", "b", "shared", (F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * self.percent).alias("similar")).distinct()

    def labels(self, links: DataFrame) -> DataFrame:
        """(key, gid, n, linked, label) of every set."""
        found, count = components(links)
        found = small(found.withColumnRenamed("node", "key"), count)
        return self.classes.join(found, "key", "left").withColumn("linked", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "key"))

    def others(self, pairs: DataFrame, tried: DataFrame, inside: DataFrame, several: DataFrame, moved: DataFrame, labelled: DataFrame) -> DataFrame:
        """(a, b): of star pairs, whose heads alone were tried, the other sets that lie in different components.

        Two sets differ at least by what their heads differ in, less what each differs from its own head.
        """
        close = pairs.join(tried.select("a", "b", "shared"), ["a", "b"]).select("ga", "gb", "shared")
        close = close.join(several.withColumnRenamed("gid", "ga"), "ga", "left_semi").union(
            close.join(several.withColumnRenamed("gid", "gb"), "gb", "left_semi").select("ga", "gb", "shared")
        )
        for x in "ab":
            close = close.join(moved.select(F.col("gid").alias(f"g{x}"), F.col("label").alias(f"l{x}")), f"g{x}", "left")
        close, seen = stored(close.filter("la is null or lb is null or la != lb").select("ga", "gb", "shared").distinct())
        own = inside.join(tried, ["a", "b"]).select(F.col("b").alias("key"), F.col("shared").alias("own"))
        sets = labelled.join(own, "key", "left").withColumn("off", F.coalesce(2 * (F.col("n") - F.col("own")), F.lit(0)))
        one, two = (sets.select(*(F.col(c).alias(to + x) for c, to in (("gid", "g"), ("key", ""), ("n", "n"), ("label", "l"), ("off", "o")))) for x in "ab")
        found = small(close, seen["rows"]).join(one, "ga").join(two, "gb").filter("la != lb and oa + ob > 0")
        least = F.col("na") + F.col("nb") - 2 * F.col("shared") - F.col("oa") - F.col("ob")
        return found.filter(self.possible(least, F.col("na"), F.col("nb"))).select("a", "b")

    def links(self) -> DataFrame:
        """(a, b): similar sets, enough of them to join every component."""
        rows = self.buckets()
        hub = F.min(F.struct("rare", "gid", "n", "us", "us_all", "last")).alias("hub")
        hubs = rows.groupBy("s").agg(hub, F.count("*").alias("groups")).filter("groups > 1")
        starred = rows.join(hubs, "s").filter("gid != hub.gid")
        head, seen = stored(self.classes.groupBy("gid").agg(F.min("key").alias("head"), F.count("*").alias("sets")))
        heads, several = small(head.filter("sets = 1").select("gid"), seen["rows"]), small(head.filter("sets > 1").select("gid"), seen["rows"])

        def apart(a: str, b: str) -> Column:
            # A shingle of one prefix that no other holds lacks in the other set, if that one's prefix reaches so far.
            sides = (F.when(F.col(f"{x}last") <= F.col(f"{y}last"), F.col(f"{x}us_all")).otherwise(F.col(f"{x}us")) for x, y in ((a, b), (b, a)))
            return sum(sides, F.lit(0))

        stars = starred.filter(self.possible(apart("", "hub."), F.col("n"), F.col("hub.n")))
        stars, star_count = stored(stars.select(F.col("hub.gid").alias("ga"), F.col("gid").alias("gb")).distinct())
        measured, seen = stored(self.measured(stars, star_count["rows"]), near=F.sum(F.col("near").cast("long")))
        pairs = _named(measured.filter("near").select("ga", "gb"), seen["near"], head)
        inside = self.classes.join(head.filter("sets > 1"), "gid").filter("key != head").select(F.col("head").alias("a"), F.col("key").alias("b"))
        asked, seen = stored(pairs.select("a", "b").union(inside))
        tried = self.verified(asked, seen["rows"]).checkpoint()
        first = tried.filter("similar").select("a", "b")
        labelled = self.labels(first).checkpoint()

        # A group whose sets lie in several components counts as apart from every other group.
        group = labelled.groupBy("gid").agg(F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("mixed"), F.max("linked").alias("linked"))
        group, seen = stored(group.filter("linked or mixed"), mixed=F.sum(F.col("mixed").cast("long")))
        moved, mixed = small(group.filter("not mixed").select("gid", "label"), seen["rows"]), small(group.filter("mixed").select("gid"), seen["mixed"])
        exact = pairs.join(tried.select("a", "b", "shared"), ["a", "b"]).join(heads.withColumnRenamed("gid", "ga"), "ga").join(heads.withColumnRenamed("gid", "gb"), "gb")
        shared = measured.join(exact.select("ga", "gb", "shared"), ["ga", "gb"], "left")
        shared = shared.join(heads.withColumnRenamed("gid", "gb"), "gb", "left_semi").join(heads.withColumnRenamed("gid", "ga"), "ga", "left_semi")
        shared, seen = stored(shared.select(F.col("ga").alias("hub_gid"), F.col("gb").alias("gid"), F.coalesce("shared", "lo").alias("lo"), F.coalesce("shared", "hi").alias("hi")))
        shared = small(shared, seen["rows"])
        # Two groups that share shingles of one hub meet once; before the first of them, the counts hold for all.
        star = [F.col("hub.gid").alias("hub_gid"), "gid", "n", "us_all", "last"]
        rest = starred.filter("groups > 2").select(*star, "us").groupBy("hub_gid", *star[1:]).agg(F.min("us").alias("us"))
        rest = rest.join(moved, "gid", "left").join(moved.select(F.col("gid").alias("hub_gid"), F.col("label").alias("hub_label")), "hub_gid", "left")
        rest = rest.join(shared, ["hub_gid", "gid"], "left")
        rest = rest.withColumn("mark", _mark("label", "gid")).withColumn("main", _mark("hub_label", "hub_gid"))
        rest = rest.select("hub_gid", "gid", "n", "us", "us_all", "last", "mark", "main", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", "n").alias("hi"))
        left = rest.filter("mark != main").select("hub_gid", *(F.col(c).alias(f"l_{c}") for c in rest.columns[1:]))
        right = rest.select("hub_gid", *(F.col(c).alias(f"r_{c}") for c in rest.columns[1:]))
        differ = (F.col("l_mark") != F.col("r_mark")) & ((F.col("r_mark") == F.col("r_main")) | (F.col("l_gid") < F.col("r_gid")))
        gap = F.greatest(F.lit(0), F.col("l_lo") - F.col("r_hi"), F.col("r_lo") - F.col("l_hi"))
        least = F.greatest(apart("l_", "r_"), F.col("l_us") + F.col("r_us") + gap)
        across = left.join(right, "hub_gid").filter(differ & self.possible(least, F.col("l_n"), F.col("r_n")))
        across = across.select(F.col("l_gid").alias("ga"), F.col("r_gid").alias("gb"))
        across, seen = stored(across.distinct())
        across = self.measured(across, seen["rows"]).filter("near").select("ga", "gb")
        across = across.union(mixed.select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))
        one = labelled.select(F.col("gid").alias("ga"), F.col("key").alias("a"), F.col("label").alias("la"))
        two = labelled.select(F.col("gid").alias("gb"), F.col("key").alias("b"), F.col("label").alias("lb"))
        more = across.join(one, "ga").join(two, "gb").filter("la != lb").select("a", "b").union(self.others(pairs, tried, inside, several, moved, labelled))
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more, seen = stored(more)
        return first.union(self.verified(more, seen["rows"]).filter("similar").select("a", "b")) if seen["rows"] else first


def document_components(documents: DataFrame, id_: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document row: id, row hashes ra and rb, n (set size), component (smallest id reachable by links).

    A document without words (null or empty text) has an empty set and is its own component. Null ids are
    passed over when the smallest is taken. Repeated rows keep one result row each.
    """
    join = _Join(documents, id_, text, words, percent)
    labelled = join.labels(join.links()).select("key", "label")
    members = join.rows.filter("n > 0").select("key", "id").groupBy("key").agg(F.min("id").alias("least"))
    least = members.join(labelled, "key")
    of_label = least.groupBy("label").agg(F.min("least").alias("component"))
    of_key = least.join(of_label, "label").select("key", "component")
    kept = ["id", "ra", "rb", "n"]
    some = join.rows.filter("n > 0").select(*kept, "key").join(of_key, "key", "left").select(*kept, "component")
    return some.union(join.rows.filter("n = 0").select(*kept, F.col("id").alias("component")))


def keep_one(documents: DataFrame, id_: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the one with the smallest id (null last). Documents without words all stay."""
    found = document_components(documents, id_, text, words, percent).filter("n > 0").checkpoint()
    # Rows without any id in their component share the null component; they are told apart by their rows.
    order = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("y"), F.col("ra").alias("ra"), F.col("rb").alias("rb"))
    chosen = found.filter("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    chosen = chosen.select(F.col("first.ra").alias("ra"), F.col("first.rb").alias("rb"))
    ra, rb = fresh(documents, "row_a", "row_b")
    dropped = found.filter("component is not null").select("ra", "rb").distinct().join(chosen, ["ra", "rb"], "left_anti")
    dropped, seen = stored(dropped.select(F.col("ra").alias(ra), F.col("rb").alias(rb)))
    dropped = small(dropped, seen["rows"])
    whole = F.col(text).cast("string")
    kept = documents.withColumns({ra: F.xxhash64(F.col(id_), whole), rb: F.xxhash64(F.lit("second"), F.col(id_), whole)}).join(dropped, [ra, rb], "left_anti")
    again, seen = stored(found.groupBy("ra", "rb").count().filter("count > 1").select(F.col("ra").alias(ra), F.col("rb").alias(rb)))
    if not seen["rows"]:
        return kept.select(*documents.columns)
    again = small(again, seen["rows"])
    once = kept.join(again, [ra, rb], "left_semi").dropDuplicates([ra, rb])
    return kept.join(again, [ra, rb], "left_anti").union(once).select(*documents.columns)
