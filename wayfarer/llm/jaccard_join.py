"""N-gram Jaccard self-join by vertical partitioning: the global n-gram order is cut into fragments, overlaps are counted in each and summed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wayfarer.llm.common import Tables, bounded, cut, known, release, small, unused, utf8, values, with_ids
from wayfarer.operators import graph

#: Fragments of the n-gram order: quarters by hash of the rare n-grams, then of the common ones; those counted first.
FRAGMENTS, EARLY = 8, (0, 4)
#: An n-gram that begins more documents than this goes to the end of the order; at most so many do, those in most documents.
COMMON, MOST_COMMON = 4, 1 << 21
#: N-grams of a class that tell whether a pair of it was met before.
WITNESSES = 16
#: Words whose hashes a task keeps.
VOCABULARY = 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_29, _32 = np.uint64(29), np.uint64(32)
_TOP = np.uint64(1 << 63)

_PARITIES = ("p1", "p2", "p3", "p4")

_words: dict[bytes, int] = {}


def _hash_of(word: bytes) -> int:
    if len(_words) > VOCABULARY:
        _words.clear()
    h = _words[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingles(raw: bytes, n: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles of UTF-8 bytes; of all words as one if there are fewer."""
    found = raw.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not found:
        return np.zeros(0, np.uint64)
    get = _words.get
    w = np.array([h if (h := get(x)) is not None else _hash_of(x) for x in found], np.uint64)
    width = min(n, len(w))
    mixed = np.full(len(w) - width + 1, np.uint64(width) * _C)
    for k in range(width):
        mixed = (mixed ^ (mixed >> _29)) * _A + w[k : len(w) - width + 1 + k]
        mixed = (mixed ^ (mixed >> _32)) * _B
    mixed ^= mixed >> _29
    mixed.sort()
    keep = np.ones(len(mixed), bool)
    keep[1:] = mixed[1:] != mixed[:-1]
    return mixed[keep]


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    h = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def prefix_length(n, percent: int):
    """How many first n-grams of a set of ``n`` two sets of the wanted similarity must share one of."""
    return n - -(-percent * n // 100) + 1


def _signed(a: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs of the same order."""
    return (a ^ _TOP).view(np.int64)


def _common_last(grams: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the global order (rare n-grams by hash, then common ones by hash), and the number of rare ones."""
    if not len(common) or not len(grams):
        return grams, len(grams)
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    late = common[at] == grams
    return np.concatenate([grams[~late], grams[late]]), int(len(grams) - late.sum())


def _first_grams(texts: DataFrame, n: int, percent: int, common=None) -> DataFrame:
    """gram, copies: of the rare n-grams that begin documents in the order that puts ``common`` last, counted once for each document; of half a prefix in the order of hashes where none are known yet."""

    def run(batches):
        late, share = (common.value, 1) if common else (np.zeros(0, np.uint64), 2)

        def first(g):
            ordered, rare = _common_last(g, late)
            return _signed(ordered[: min(rare, -(-prefix_length(len(g), percent) // share))])

        for batch in batches:
            parts = [first(g) for raw in values(batch.column(0)) if len(g := shingles(raw, n))]
            gram, copies = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(copies.astype(np.int64))], ["gram", "copies"])
        _words.clear()
        release()

    return texts.select("text").mapInArrow(run, "gram long, copies long")


def common_grams(texts: DataFrame, n: int, percent: int, passes: int = 1) -> np.ndarray:
    """Sorted hashes of the n-grams to put last: any set of them gives a valid order, so its size can be held down.

    Half of each prefix tells the first ones; with a second of ``passes``, prefixes in the order without these, which reach further into a text, tell more.
    """
    found = np.zeros(0, np.uint64)
    for _ in range(passes):
        order = texts.sparkSession.sparkContext.broadcast(found) if len(found) else None
        counted = cut(_first_grams(texts, n, percent, order).groupBy("gram").agg(F.sum("copies").alias("copies")).filter(F.col("copies") > COMMON))
        floor = COMMON
        while counted.filter(F.col("copies") > floor).count() > MOST_COMMON - len(found):
            floor *= 2
        rows = counted.filter(F.col("copies") > floor).select("gram").toArrow()
        more = rows.column(0).to_numpy().view(np.uint64) ^ _TOP
        found = np.sort(np.concatenate([found, more]))
        if not len(more):
            break
    return found


def _parity(grams: np.ndarray) -> tuple[int, ...]:
    """256 bits, each the parity of the n-grams whose hash falls to it: two sets' bits differ in no more places than the sets do."""
    bits = np.packbits((np.bincount((grams & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8))
    return tuple(bits.view(np.int64).tolist())


def _sets(texts: DataFrame, common, n: int, percent: int) -> DataFrame:
    """doc_id, n, the number of rare n-grams, k1, k2, the parities p1 to p4, and the first n-grams in the global order of each text."""
    names = ["n", "rare", "k1", "k2", *_PARITIES]

    def run(batches):
        late = common.value
        for batch in batches:
            facts, first = [], []
            for raw in values(batch.column(1)):
                g = shingles(raw, n)
                ordered, rare = _common_last(g, late)
                facts.append((len(g), rare, *set_key(g), *_parity(g)))
                first.append(_signed(ordered[: prefix_length(len(g), percent)]) if len(g) else np.zeros(0, np.int64))
            columns = zip(*facts, strict=True) if facts else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(first, pa.list_(pa.int64()))], ["doc_id", *names, "first"])
        _words.clear()
        release()

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{x} long' for x in names)}, first array<long>")


def _segments(texts: DataFrame, common, n: int) -> DataFrame:
    """k1, k2, fragment, grams: the fragments of each text's set, empty ones too."""

    def run(batches):
        late = common.value
        edges = np.array([i << 62 for i in (1, 2, 3)], np.uint64)
        for batch in batches:
            keys, grams = [], []
            for raw in values(batch.column(0)):
                g = shingles(raw, n)
                keys.append(set_key(g))
                ordered, rare = _common_last(g, late)
                cuts = [0, *np.searchsorted(ordered[:rare], edges).tolist(), rare, *(rare + np.searchsorted(ordered[rare:], edges)).tolist(), len(ordered)]
                grams += [_signed(ordered[cuts[f] : cuts[f + 1]]) for f in range(FRAGMENTS)]
            k1, k2 = (np.repeat(np.array(k, np.int64), FRAGMENTS) for k in (zip(*keys, strict=True) if keys else ((), ())))
            fragment = np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(fragment), pa.array(grams, pa.list_(pa.int64()))], ["k1", "k2", "fragment", "grams"])
        _words.clear()
        release()

    return texts.select("text").mapInArrow(run, "k1 long, k2 long, fragment int, grams array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least class reachable from each class that has a link."""
    found = graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select(F.col("node_id").alias("node"), F.col("component").alias("root"))


#: Pairs of a class on one side of a join of fragments; a class in more is salted over as many slices as it takes.
HOT = 10_000


class _Join:
    """The steps of one self-join. What a step hands on is a table in the shared folder, with no more columns than are read."""

    def __init__(self, docs: DataFrame, n: int, percent: int, passes: int = 1):
        bounded(docs)
        self.texts, self.n, self.percent = docs.select("doc_id", utf8().alias("text")), n, percent
        self.tables = Tables(docs.sparkSession)
        self.common = docs.sparkSession.sparkContext.broadcast(common_grams(self.texts, n, percent, passes))
        sets = self.tables.write("sets", _sets(self.texts, self.common, n, percent).withColumn("row", F.monotonically_increasing_id()))
        self.rows = self.tables.write("rows", sets.drop("first", "row", "rare", *_PARITIES))
        # one class for each set; a row of it with the least id, where one has an id, stands for it
        of_class = sets.groupBy("n", "rare", "k1", "k2", *_PARITIES).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"), F.count("*").alias("copies"))
        # of classes with as many copies the one with fewest rare n-grams comes first
        rank = F.col("rare") - F.shiftleft(F.least("copies", F.lit(1 << 30)), 32)
        self.classes = self.tables.write("classes", of_class.select("n", "k1", "k2", *_PARITIES, rank.alias("rank"), F.col("least.doc_id").alias("least"), F.col("least.row").alias("row")).withColumn("cid", F.monotonically_increasing_id()))
        entries = sets.select("row", "first").join(known(self.classes.select("row", "cid", "n")), "row").select("cid", "n", F.posexplode("first").alias("at", "gram"))
        entries = entries.select("gram", "cid", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("place"))
        # most n-grams begin one class only: they are told by themselves, before anything is carried with them
        repeated = self.tables.write("repeated", entries.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1").select("gram"))
        self.members = self.tables.write("members", entries.join(repeated, "gram", "left_semi"))
        self.tables.drop("sets", "repeated")

    def _sides(self, df: DataFrame, *sides: str) -> DataFrame:
        """``df`` with n and the parities of the classes in the columns ``sides``, under names that begin with the side's."""
        of = known(self.classes.select("cid", "n", *_PARITIES))
        for x in sides:
            df = df.join(of.select(F.col("cid").alias(x), F.col("n").alias(f"{x}n"), *[F.col(p).alias(f"{x}{p}") for p in _PARITIES]), x)
        return df

    def _alike(self):
        """Whether the parities of a and b leave it open that they are near."""
        differ = sum(F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in _PARITIES)
        return (100 + self.percent) * differ <= (100 - self.percent) * (F.col("an") + F.col("bn"))

    def _room(self, na, nb, left_a, left_b):
        """Whether two sets can be near by their sizes and by what is left of both from a shared first n-gram on."""
        p = self.percent
        return (100 * F.least(na, nb) >= p * F.greatest(na, nb)) & ((100 + p) * F.least(left_a, left_b) >= p * (na + nb))

    def star(self) -> DataFrame:
        """a, b, both: pairs of each class with two hubs of each of its n-grams that may be near, once each.

        Hubs are classes that many others are likely near to: the one that most documents copy as it is, and the one with
        fewest n-grams before the shared one.
        """
        at = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
        ranked = self.members.join(known(self.classes.select("cid", "rank")), "cid")
        groups = ranked.groupBy("gram").agg(F.min(F.struct("rank", "cid")).alias("most"), F.min(F.struct(at.alias("at"), "cid")).alias("early"))
        hubs = self.tables.write("hubs", groups.select("gram", F.array_distinct(F.array("most.cid", "early.cid")).alias("hubs")))
        tried = self.members.join(hubs, "gram").select(F.col("cid").alias("a"), F.shiftright("place", 32).alias("na"), at.alias("at"), F.explode("hubs").alias("b")).filter("a <> b")
        tried = self._sides(tried, "a", "b")
        may = self._room(F.col("na"), F.col("bn"), F.col("na") - F.col("at"), F.col("bn")) & self._alike()
        found = self.tables.write("star", tried.filter(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("bn")).alias("both")).distinct())
        self.tables.drop("hubs")
        return found

    def meetings(self, roots: DataFrame) -> DataFrame:
        """a, b, both: all pairs of classes that share a first n-gram, may be near and are not in one component of ``roots``.

        N-grams all of whose classes are in one component need no pairs. Of the others only classes outside of the
        n-gram's largest component are met with the rest, so a large group of copies is not paired with itself. Pairs meet
        by n-gram and band of sizes: sets two bands apart are not near. A pair is left to the first n-gram at which it meets
        where the classes' first n-grams tell that there was an earlier one: what holds at an n-gram holds at those before it.
        """
        reach = known(self.tables.write("reach", roots.select(F.col("node").alias("cid"), "root")))
        rooted = self.members.join(reach, "cid", "left").select("gram", "cid", "place", F.coalesce("root", "cid").alias("root"))
        counts = rooted.groupBy("gram", "root").agg(F.count("*").alias("many"))
        tops = counts.groupBy("gram").agg(F.max(F.struct("many", "root"))["root"].alias("top"), F.count("*").alias("roots"))
        mixed = self.tables.write("mixed", tops.filter("roots > 1").select("gram", "top"))
        n, at = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
        band = F.floor(F.log(n.cast("double")) / float(np.log(100 / self.percent)) * (1 - 1e-9)).cast("int")
        rooted = rooted.join(mixed, "gram").select("gram", "cid", "root", "top", n.alias("n"), (n - at).alias("left"), band.alias("band"))
        rooted = self.tables.write("met", rooted)
        first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "gram"))), 1, WITNESSES)
        firsts = self.tables.write("firsts", rooted.groupBy("cid").agg(first.alias("first")).join(known(self.classes.select("cid", *_PARITIES)), "cid"))
        earlier = F.transform(F.filter("first", lambda x: x["at"] < -F.col("left")), lambda x: x["gram"])
        rooted = self.tables.write("rooted", rooted.join(firsts, "cid").withColumn("earlier", earlier).drop("first"))
        side = lambda x: [F.col("cid").alias(x), F.col("earlier").alias(f"{x}earlier"), F.col("root").alias(f"{x}root"), F.col("n").alias(f"{x}n"), F.col("left").alias(f"{x}left"), *[F.col(p).alias(f"{x}{p}") for p in _PARITIES]]
        a = rooted.filter("root <> top").select("gram", *side("a"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
        b = rooted.select("gram", *side("b"), "top", "band")
        once = (F.col("broot") == F.col("top")) | (F.col("a") < F.col("b"))
        may = self._room(F.col("an"), F.col("bn"), F.col("aleft"), F.col("bleft")) & self._alike() & ~F.arrays_overlap("aearlier", "bearlier")
        met = a.join(b, (a["gram"] == b["gram"]) & (a["band"] == b["band"]) & once & (F.col("aroot") != F.col("broot")) & may)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("an") + F.col("bn")).alias("both"))

    def open_pairs(self, star: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs of ``meetings`` that are not in ``star``, once each."""
        pairs = self.meetings(roots).distinct()
        found = self.tables.write("pairs", pairs.join(known(star.select("a", "b")), ["a", "b"], "left_anti"))
        self.tables.drop("reach", "mixed", "met", "firsts", "rooted")
        return found

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """a, b, overlap of the pairs (a, b, both) that are near: overlaps are counted in the early fragments, then, of pairs that may still be near, in the rest."""
        p, late = self.percent, [f for f in range(FRAGMENTS) if f not in EARLY]
        parts = self._parts(pairs, f"{name}_parts")
        early = self._counted(pairs, parts.filter(F.col("fragment").isin(list(EARLY))))
        open_ = self.tables.write(f"{name}_open", early.filter((100 + p) * F.col("lost") <= (100 - p) * F.col("both")).select("a", "b", "both", F.col("overlap").alias("before")))
        rest = self._counted(open_, parts.filter(F.col("fragment").isin(late)))
        summed = rest.join(open_.select("a", "b", "before"), ["a", "b"]).withColumn("overlap", F.col("overlap") + F.col("before"))
        found = self.tables.write(f"{name}_links", summed.filter((100 + p) * F.col("overlap") >= p * F.col("both")).select("a", "b", "overlap"))
        self.tables.drop(f"{name}_parts", f"{name}_open")
        return found

    def _parts(self, pairs: DataFrame, name: str) -> DataFrame:
        """cid, fragment, grams of the classes of ``pairs``: their texts alone are read again, once for all fragments."""
        asked = self.tables.write(f"{name}_asked", pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(known(self.classes.select("cid", "k1", "k2", "least")), "cid"))
        again = with_ids(self.texts, asked.select("least"))
        parts = _segments(again, self.common, self.n).join(known(asked.select("k1", "k2", "cid")), ["k1", "k2"])
        if self._repeats(asked):  # rows that repeat an id and a text repeat their fragments: max() takes one of equal ones
            parts = parts.groupBy("cid", "fragment").agg(F.max("grams").alias("grams"))
        return self.tables.write(name, parts.select("cid", "fragment", "grams"))

    def _counted(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """a, b, both, overlap, lost: n-grams shared and not shared in the fragments, counted in each and summed.

        A class in more than HOT pairs is salted: its pairs are dealt over slices, to each of which its fragments go.
        """
        of_a, of_b = (parts.select(F.col("cid").alias(x), "fragment", F.col("grams").alias(f"g{x}"), F.lit(0).alias(f"s{x}")) for x in "ab")
        dealt = pairs.select("a", "b", "both", F.lit(0).alias("sa"), F.lit(0).alias("sb"))
        load = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("load"))
        hot = small(load.filter(F.col("load") > HOT).select("cid", F.ceil(F.col("load") / HOT).cast("int").alias("slices")))
        if hot.limit(1).count():
            dealt = pairs
            for x, y in ("ab", "ba"):
                dealt = dealt.join(hot.select(F.col("cid").alias(x), "slices"), x, "left").withColumn(f"s{x}", F.pmod(F.xxhash64(y), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
            spread = lambda of, x: of.join(hot.select(F.col("cid").alias(x), "slices"), x, "left").withColumn(f"s{x}", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
            of_a, of_b = spread(of_a, "a"), spread(of_b, "b")
        shared = F.size(F.array_intersect("ga", "gb"))
        partial = of_a.join(known(dealt), ["a", "sa"]).join(of_b, ["b", "sb", "fragment"]).select("a", "b", "both", shared.alias("shared"), (F.size("ga") + F.size("gb") - 2 * shared).alias("lost"))
        return partial.groupBy("a", "b", "both").agg(F.sum("shared").alias("overlap"), F.sum("lost").alias("lost"))

    def _repeats(self, asked: DataFrame) -> bool:
        """Whether a class is met by more than one row of the ids that are read again, those asked for other classes among them."""
        met = with_ids(self.rows, asked.select("least")).join(known(asked.select("k1", "k2", "cid")), ["k1", "k2"])
        return met.groupBy("cid").count().filter("count > 1").limit(1).count() > 0


def linked_classes(docs: DataFrame, *, n: int = 3, percent: int = 90, passes: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n, k1, k2; classes; links: a, b, overlap; components: node, root) of the self-join at Jaccard >= ``percent`` / 100.

    Texts with equal sets are one class; links are between classes. First each n-gram's classes are tried with
    its two hubs, which joins most of a large group at once; then all candidate pairs that are not yet in one
    component are tried. Links between classes already joined are not listed: the links span each component, components
    are exact, and no group's pairs are all made.
    """
    join = _Join(docs, n, percent, passes)
    star = join.star()
    links = join.links(star, "star")
    roots = components(links)
    pairs = join.open_pairs(star, roots)
    if pairs.limit(1).count():
        more = join.links(pairs, "pairs")
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = components(links)
    join.tables.drop("members", "star", "pairs")
    return join.rows, join.classes, links, roots


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """k1, k2, cid, least and root of each class."""
    return classes.join(roots, classes["cid"] == roots["node"], "left").select("k1", "k2", "cid", "least", F.coalesce("root", "cid").alias("root"))


def near_duplicates(docs: DataFrame, *, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, its own included) of every row.

    Words are runs of other than the six ASCII white-space characters, A-Z lower-cased; a set is the distinct ``n``-word
    shingles (all words as one if there are fewer). Null and blank texts have the empty set and no link: their component
    is their own doc_id. Equal rows are each returned. A null doc_id gets the least id of its component, or null.
    """
    rows, classes, _, roots = linked_classes(docs, n=n, percent=percent)
    named = _named(classes, roots)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("k1", "k2", "component")
    out = rows.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _with_set(docs: DataFrame, n: int, names: list[str]) -> DataFrame:
    """``docs`` with its texts' sets under three names: the number of shingles and the two keys."""
    bounded(docs)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            facts = [(len(g), *set_key(g)) for t in values(batch.column(place)) for g in [shingles((t or "").encode(), n)]]
            columns = zip(*facts, strict=True) if facts else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names, *names])
        _words.clear()
        release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(x, LongType()) for x in names)]))


def one_of_each(docs: DataFrame, *, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` that stand for their group, one for each: that with the least doc_id, or any one of a group without ids.

    Rows are told by their own text's set and doc_id: different texts stay also where they share an id or have none. Null
    and blank texts have no group and all stay.
    """
    rows, classes, _, roots = linked_classes(docs, n=n, percent=percent, passes=2)
    named = cut(_named(classes, roots))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "cid")).alias("first")).select(F.col("first.cid").alias("cid"), F.lit(True).alias("stands"))
    named = named.join(first, "cid", "left").select("k1", "k2", "least", F.coalesce("stands", F.lit(False)).alias("stands"))
    judged = rows.filter("n > 0").groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("rows")).join(named, ["k1", "k2"])
    judged = cut(judged.select("k1", "k2", "doc_id", "rows", (F.col("stands") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("stays")))
    size, k1, k2, a, b, c = unused(docs, "__n", "__k1", "__k2", "__a", "__b", "__c")
    keys = [k1, k2, "doc_id"]
    all_ = _with_set(docs, n, [size, k1, k2])

    def met(df, found, how):
        found = small(found.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("doc_id").alias(c)))
        return df.join(found, (df[k1] == found[a]) & (df[k2] == found[b]) & df["doc_id"].eqNullSafe(found[c]), how)

    kept = met(all_, judged.filter("not stays"), "left_anti")
    twice = judged.filter("stays and rows > 1")
    if twice.limit(1).count():  # equal ids and sets: any one of them
        kept = met(kept, twice, "left_anti").unionByName(met(kept, twice, "left_semi").dropDuplicates(keys))
    return kept.drop(size, k1, k2)
