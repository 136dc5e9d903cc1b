"""Near-duplicate vectors by product quantisation: inverted lists, residual codes looked up in tables, exact cosines of what the codes leave open."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import Tables, bounded, known
from wayfarer.operators import graph

#: Vectors that the index is fitted on, lists at most, parts that a residual is coded in, codes of a part, rounds of fitting.
FIT_ROWS, LISTS, PARTS, CODES, ROUNDS = 16_384, 1024, 8, 256, 8
#: Vectors of a list, and vectors that look into one, that a task takes at once; more are dealt over slices.
BLOCK, ASKING = 2048, 8192
#: A list is looked into if the vector is no further than REACH / sqrt(dimensions) from the plane between that list and its own.
REACH = 0.7
#: Vectors of a slice that are so near to each other that all are linked are one unit, from as many on.
UNIT = 8

_ROUNDING = 1e-9


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision."""
    v = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(1, initial=0, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _centres(raw: list[bytes], radius: np.ndarray, kind: str) -> np.ndarray:
    """Centres of units: a single vector's is its own bytes, a group's is in double precision."""
    single = radius == 0
    dim = len(raw[0]) // np.dtype(kind if single[0] else "<f8").itemsize
    out = np.empty((len(raw), dim))
    if single.any():
        out[single] = unit_vectors([r for r, x in zip(raw, single, strict=True) if x], kind)
    if not single.all():
        out[~single] = np.frombuffer(b"".join(r for r, x in zip(raw, single, strict=True) if not x)).reshape(-1, dim)
    return out


def _kind(vectors: DataFrame, column: str) -> str:
    return "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"


def _keyed(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, k1, k2 (null where a vector links with nothing), vec: the components' bytes."""

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for x in batch.column(1):
                v = np.zeros(0, kind) if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # null becomes NaN, -0 becomes 0
                fine = bool(len(v)) and bool(np.isfinite(v).all()) and bool(v.any())
                h = xxhash.xxh3_128_intdigest(v.tobytes()) if fine else 0
                keys.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)) if fine else (None, None))
                out.append(v.tobytes() if fine else None)
            k1, k2 = zip(*keys, strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "k1", "k2", "vec"])

    return vectors.mapInArrow(run, "vec_id long, k1 long, k2 long, vec binary")


def _means(rows: np.ndarray, k: int, spherical: bool) -> np.ndarray:
    """``k`` means of the rows (of length 1, if ``spherical``), from ``k`` of them on; a mean without rows stays."""
    rng = np.random.default_rng(0)
    c = rows[np.sort(rng.choice(len(rows), k, replace=False))]
    for _ in range(ROUNDS):
        near = _nearest(rows, c)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(rows[order], first)
        if spherical:
            size = np.sqrt((sums * sums).sum(1, keepdims=True))
            found, sums = found[size[:, 0] > 0], sums[size[:, 0] > 0] / size[size[:, 0] > 0]
        else:
            sums = sums / np.diff([*first, len(rows)])[:, None]
        c = c.copy()
        c[found] = sums
    return c


def _nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (rows @ c.T - (c * c).sum(1) / 2).argmax(1)


class Lists:
    """The lists and codes of vectors of one length: list centres of length 1, and a book of codes for each part of the residual."""

    def __init__(self, sample: np.ndarray, n: int, base: int):
        lists = max(1, min(LISTS, math.isqrt(n), len(sample)))
        self.base, self.centres = base, _means(sample, lists, True)
        self.parts = min(PARTS, sample.shape[1])
        self.width = -(-sample.shape[1] // self.parts)
        left = self._split(sample - self.centres[_nearest(sample, self.centres)])
        self.books = [_means(x, min(CODES, len(x)), False) for x in left]
        self.margin = min(math.sqrt(0.19), REACH / math.sqrt(sample.shape[1]))
        self.apart = np.sqrt(np.maximum(2 - 2 * self.centres @ self.centres.T, 1e-12))

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        padded = np.zeros((len(rows), self.parts * self.width))
        padded[:, : rows.shape[1]] = rows
        return [padded[:, k * self.width : (k + 1) * self.width] for k in range(self.parts)]

    def home(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows, self.centres)

    def probes(self, rows: np.ndarray, home: int, more: np.ndarray) -> np.ndarray:
        """Which lists each vector of the list ``home`` looks into, its own among them."""
        s = rows @ self.centres.T
        out = (s[:, [home]] - s) / self.apart[home] <= self.margin + more[:, None]
        out[:, home] = True
        return out

    def codes(self, rows: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far what they stand for is from the vector."""
        left = self._split(rows - self.centres[home])
        codes = np.stack([_nearest(x, book) for x, book in zip(left, self.books, strict=True)], 1).astype(np.uint8)
        off = sum(((x - book[codes[:, k]]) ** 2).sum(1) for k, (x, book) in enumerate(zip(left, self.books, strict=True)))
        return codes, np.sqrt(off)

    def looked_up(self, asking: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Dot products of ``asking`` with what the codes stand for: one table a part."""
        out = np.repeat(asking @ self.centres[[home]].T, len(codes), 1)
        for k, (x, book) in enumerate(zip(self._split(asking), self.books, strict=True)):
            out += (x @ book.T)[:, codes[:, k]]
        return out


def fit(classes: DataFrame, kind: str) -> dict[int, Lists]:
    """Lists by vector length, fitted on the FIT_ROWS vectors whose keys are least: a sample by hash, the same in every run."""
    n = classes.count()
    raw = [r.vec for r in classes.orderBy("k1", "k2").limit(FIT_ROWS).select("vec").collect()]
    by_length: dict[int, list[bytes]] = {}
    for v in raw:
        by_length.setdefault(len(v), []).append(bytes(v))
    out, base = {}, 0
    for length, of in sorted(by_length.items()):
        out[length] = Lists(unit_vectors(of, kind), n * len(of) // len(raw), base)
        base += len(out[length].centres)
    return out


def _placed(classes: DataFrame, model, kind: str) -> DataFrame:
    """cid, copies, vec, cell: the list of each vector; below 0, one for each length that the sample lacks."""

    def run(batches):
        for batch in batches:
            raw, cell = batch.column(2).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for length in {len(v) for v in raw}:
                at = [k for k, v in enumerate(raw) if len(v) == length]
                of = model.value.get(length)
                cell[at] = -length if of is None else of.base + of.home(unit_vectors([raw[k] for k in at], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["cid", "copies", "vec", "cell"])

    return classes.select("cid", "copies", "vec").mapInArrow(run, "cid long, copies long, vec binary, cell long")


def _units_of(v: np.ndarray, half: float, cosine: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(members, centre, radius as an angle) of the groups of at least UNIT vectors within ``half`` of their centre."""
    near, free, out = v @ v.T >= cosine, np.ones(len(v), bool), []
    many = near.sum(1)
    for p in np.argsort(-many, kind="stable"):
        if many[p] < UNIT:
            break
        if not free[p]:
            continue
        around = np.flatnonzero(near[p] & free)
        if len(around) < UNIT:
            continue
        centre = v[around].sum(0)
        centre /= np.sqrt((centre * centre).sum())
        angle = np.arccos(np.clip(v[around] @ centre, -1, 1))
        members = around[angle < half - _ROUNDING]
        if len(members) >= UNIT:
            free[members] = False
            out.append((members, centre, float(angle[angle < half - _ROUNDING].max()) + _ROUNDING))
    return out


_MEMBER = {"cid": pa.int64(), "uid": pa.int64(), "cell": pa.int64(), "copies": pa.int64(), "vec": pa.binary(), "lead": pa.bool_(), "centre": pa.binary(), "radius": pa.float64(), "weight": pa.int64(), "probes": pa.list_(pa.int64()), "codes": pa.binary(), "off": pa.float64()}
_MEMBERS = "cid long, uid long, cell long, copies long, vec binary, lead boolean, centre binary, radius double, weight long, probes array<long>, codes binary, off double"


def _unified(model, kind: str, cosine: float):
    """A slice of a list as members of units. The first member of a unit has its centre, radius, weight, probes and codes."""
    half = math.acos(cosine) / 2

    def run(table: pa.Table) -> pa.Table:
        raw, cid, copies, cell = table["vec"].to_pylist(), table["cid"].to_numpy(), table["copies"].to_numpy(), table["cell"][0].as_py()
        v, lists = unit_vectors(raw, kind), model.value.get(len(raw[0]))
        uid, weight, radius, centre = cid.copy(), copies.copy(), np.zeros(len(v)), v.copy()
        for members, c, r in _units_of(v, half, cosine):
            first = members[0]
            uid[members] = cid[first]
            weight[first], radius[first], centre[first] = copies[members].sum(), r, c
        lead = uid == cid
        n = len(v)
        probes, codes, off = [None] * n, [None] * n, np.zeros(n)
        if lists is None:
            probes = [[cell] if x else None for x in lead]
        else:
            at, home = np.flatnonzero(lead), cell - lists.base
            asks, (code, off[at]) = lists.probes(centre[at], home, radius[at] / 4), lists.codes(centre[at], home)
            for k, i in enumerate(at):
                probes[i], codes[i] = (np.flatnonzero(asks[k]) + lists.base).tolist(), code[k].tobytes()
        return pa.table(
            {
                "cid": table["cid"], "uid": uid, "cell": table["cell"], "copies": table["copies"], "vec": table["vec"], "lead": lead, "centre": pa.array([(c.tobytes() if r else own) if x else None for c, r, own, x in zip(centre, radius, raw, lead, strict=True)], pa.binary()),
                "radius": radius, "weight": weight, "probes": pa.array(probes, _MEMBER["probes"]), "codes": pa.array(codes, pa.binary()), "off": off,
            }, pa.schema(_MEMBER.items()),
        )

    return run


class _Links:
    """What is found in one group: links credited to either side, a spanning set of links, pairs that centres leave open."""

    def __init__(self, asked: np.ndarray):
        self.asked, self.label = asked, np.arange(len(asked))
        self.credit_asked, self.credit_asking = np.zeros(len(asked), np.int64), []
        self.edges, self.open = [], []

    def span(self, uid: int, linked: np.ndarray) -> None:
        """Links of one asking vector that join what was not joined yet."""
        roots, first = np.unique(self.label[linked], return_index=True)
        self.edges += [(uid, int(self.asked[linked[k]])) for k in first]
        for r in roots[1:]:
            self.label[self.label == r] = roots[0]

    def table(self) -> pa.Table:
        credit = [*self.credit_asking, *((int(u), int(c)) for u, c in zip(self.asked, self.credit_asked, strict=True) if c)]
        rows = [*((0, u, None, c, None) for u, c in credit), *((1, a, b, None, None) for a, b in self.edges), *((2, a, b, None, both) for a, b, both in self.open)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "a", "b", "links", "both"])


_FOUND = "kind int, a long, b long, links long, both boolean"


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536))])


def _compared(model, cosine: float, kind: str):
    """Units that look into a slice of a list against its units: codes first, exact cosines of the centres then."""
    limit = math.acos(cosine)

    def run(asking: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asking) or not len(asked):
            return _Links(np.zeros(0, np.int64)).table()
        cell = asked["home"][0].as_py()
        uid, rx, wx = asked["uid"].to_numpy(), asked["radius"].to_numpy(), asked["weight"].to_numpy()
        x = _centres(asked["centre"].to_pylist(), rx, kind)
        lists = model.value.get(x.shape[1] * np.dtype(kind).itemsize)
        if lists is not None:
            codes, off = np.frombuffer(b"".join(asked["codes"].to_pylist()), np.uint8).reshape(len(asked), -1), asked["off"].to_numpy()
            asks = np.zeros((len(asked), len(lists.centres)), bool)
            many = [len(p) for p in asked["probes"].to_pylist()]
            asks[np.repeat(np.arange(len(asked)), many), asked["probes"].combine_chunks().flatten().to_numpy() - lists.base] = True
        found = _Links(uid)
        for batch in asking.to_batches(max_chunksize=512):
            of, rq, wq, home = batch["uid"].to_numpy(), batch["radius"].to_numpy(), batch["weight"].to_numpy(), batch["home"].to_numpy()
            q = _centres(batch["centre"].to_pylist(), rq, kind)
            may = of[:, None] != uid
            if lists is not None:
                # no vector that a code's cell leaves within reach is lost: a code is off by no more than ``off``
                may &= lists.looked_up(q, cell - lists.base, codes) + off >= np.cos(np.minimum(math.pi, limit + rq[:, None] + rx)) - _ROUNDING
            i, j = np.nonzero(may)
            dot, around = _dots(q, x, i, j), rq[i] + rx[j]
            angle = np.arccos(np.clip(dot, -1, 1))
            linked = np.where(around == 0, dot >= cosine, angle + around <= limit - _ROUNDING)
            open_ = (around > 0) & ~linked & (angle - around <= limit + _ROUNDING)
            # the other side is credited here if it does not look into this one's list by itself
            back = ~asks[j, home[i] - lists.base] if lists is not None else np.zeros(len(i), bool)
            found.credit_asked += np.bincount(j[linked & back], wq[i[linked & back]], len(uid)).astype(np.int64)
            mine = np.bincount(i[linked], wx[j[linked]], len(q)).astype(np.int64)
            found.credit_asking += [(int(u), int(c)) for u, c in zip(of, mine, strict=True) if c]
            found.open += [(int(of[a]), int(uid[b]), bool(c)) for a, b, c in zip(i[open_], j[open_], back[open_], strict=True)]
            i, j = i[linked], j[linked]
            for k, js in zip(*_by_first(i, j), strict=True):
                found.span(int(of[k]), js)
        return found.table()

    return run


def _by_first(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct values of ``i`` (sorted) and the values of ``j`` beside each."""
    which, first = np.unique(i, return_index=True)
    return which, np.split(j, first[1:]) if len(which) else []


def _members_compared(cosine: float, kind: str):
    """Members of units against the members of one unit, where the centres leave links open; links are credited to members."""

    def run(asking: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asking) or not len(asked):
            return _Links(np.zeros(0, np.int64)).table()
        x, cid, copies, b = unit_vectors(asked["vec"].to_pylist(), kind), asked["cid"].to_numpy(), asked["copies"].to_numpy(), asked["b"][0].as_py()
        found = _Links(cid)
        for batch in asking.to_batches(max_chunksize=512):
            q, n, both = unit_vectors(batch["vec"].to_pylist(), kind), batch["copies"].to_numpy(), batch["both"].to_numpy(zero_copy_only=False)
            linked = q @ x.T >= cosine
            found.credit_asked += (linked * (n * both)[:, None]).sum(0)
            mine = (linked * copies).sum(1)
            found.credit_asking += [(c, int(m)) for c, m in zip(batch["cid"].to_pylist(), mine, strict=True) if m]
            found.edges += [(a, b) for a in {a for a, m in zip(batch["a"].to_pylist(), mine, strict=True) if m}]
        return found.table()

    return run


def _dealt(df: DataFrame, loads: DataFrame, own: str, other: str, key: str) -> DataFrame:
    """Rows with a slice of their own side, by hash, repeated for each slice of the other one."""
    df = df.join(known(loads), key)
    df = df.withColumn(own, F.pmod(F.xxhash64("uid"), F.col(f"n_{own}"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
    return df.select(*(F.col(c).alias(c) for c in df.columns if c not in (f"n_{own}", f"n_{other}")))  # both sides are of one table: columns of their own


def _slices(column: str, most: int):
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.col(column) / most))


def links(classes: DataFrame, tables: Tables, kind: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(cid, uid, links: of each distinct vector to others; a, b: a spanning set of links between units)."""
    spark = classes.sparkSession
    model = spark.sparkContext.broadcast(fit(classes, kind))
    placed = tables.write("placed", _placed(classes, model, kind))
    size = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", _slices("n", BLOCK).alias("n_slice"))
    sliced = placed.join(known(tables.write("size", size)), "cell").withColumn("slice", F.pmod(F.xxhash64("cid"), F.col("n_slice"))).drop("n_slice")
    members = tables.write("members", sliced.groupBy("cell", "slice").applyInArrow(_unified(model, kind, cosine), _MEMBERS))
    tables.drop("placed", "size")
    units = members.filter("lead").select("uid", F.col("cell").alias("home"), "centre", "radius", "weight", "probes", "codes", "off")
    asking = units.withColumn("cell", F.explode("probes")).select("cell", "uid", "home", "centre", "radius", "weight")
    asked = units.withColumn("cell", F.col("home"))
    load = asking.groupBy("cell").agg(F.count("*").alias("q")).join(asked.groupBy("cell").agg(F.count("*").alias("x")), "cell")
    load = tables.write("load", load.select("cell", _slices("x", BLOCK).alias("n_slice"), _slices("q", ASKING).alias("n_turn")))
    keys = ["cell", "slice", "turn"]
    met = _dealt(asking, load, "turn", "slice", "cell").groupBy(*keys).cogroup(_dealt(asked, load, "slice", "turn", "cell").groupBy(*keys)).applyInArrow(_compared(model, cosine, kind), _FOUND)
    found = tables.write("found", met)
    tables.drop("load")
    credit, edges = found.filter("kind = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links")), found.filter("kind = 1").select("a", "b")
    own = members.select("cid", "uid", "copies").join(members.filter("lead").select("uid", F.col("weight").alias("of_unit")), "uid").join(credit, "uid", "left")
    own = own.select("cid", "uid", (F.coalesce("links", F.lit(0)) + F.col("of_unit") - 1).alias("links"))
    open_ = tables.write("open", found.filter("kind = 2").groupBy("a", "b").agg(F.max("both").alias("both")))
    if open_.limit(1).count():
        turns = tables.write("turns", open_.join(members.select("uid", "cid"), F.col("a") == F.col("uid")).groupBy("b").agg(F.count("*").alias("q")).select("b", _slices("q", ASKING).alias("n_turn"), F.lit(1).cast("long").alias("n_slice")))
        few = members.select("uid", "cid", "copies", "vec")
        rows = few.withColumnRenamed("uid", "a").join(open_, "a").withColumn("uid", F.col("cid"))
        of = few.withColumn("b", F.col("uid"))
        keys = ["b", "turn"]
        met = _dealt(rows, turns, "turn", "slice", "b").groupBy(*keys).cogroup(_dealt(of, turns, "slice", "turn", "b").groupBy(*keys)).applyInArrow(_members_compared(cosine, kind), _FOUND)
        more = tables.write("more", met)
        extra = more.filter("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("more"))
        own = own.join(extra, "cid", "left").select("cid", "uid", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"))
        edges = edges.unionByName(more.filter("kind = 1").select("a", "b"))
    return own, edges


def near_vectors(vectors: DataFrame, *, column: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: rows whose vectors' cosine (in double precision) is at least ``cosine`` are linked.

    n_links counts other rows linked directly, component_id is the least vec_id reachable by links, its own included, and
    kept is vec_id = component_id (null where either is). Vectors that are null, empty, zero or hold a null or non-finite
    component, and vectors of different lengths, are not linked. Equal rows are each returned and linked with each other;
    ids may repeat or be null; other columns are ignored.

    Equal vectors are one class. Classes are put into lists by their nearest centre (fitted on FIT_ROWS of them) and coded
    by the residual's parts. A class looks into each list that it is near to; the pair of two is met if either looks into
    the other's list, once for either's count. Codes leave out what cannot be linked, with the code's own error allowed for;
    exact cosines decide, so no pair below ``cosine`` is ever linked. Pairs of which neither looks into the other's list are lost:
    README has the recall. Large groups of near vectors are units that are compared by centre and radius; their members are compared where that
    leaves a link open. Lists are dealt over slices, and links are counted, not listed.
    """
    bounded(vectors)
    tables, kind = Tables(vectors.sparkSession), _kind(vectors, column)
    rows = tables.write("rows", _keyed(vectors.select("vec_id", column), kind))
    of_class = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = tables.write("classes", of_class.withColumn("cid", F.monotonically_increasing_id()))
    if not classes.limit(1).count():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    own, edges = links(classes, tables, kind, cosine)
    own = tables.write("own", own)
    roots = graph.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node_id").alias("uid"), F.col("component").alias("root"))
    named = own.join(roots, "uid", "left").select("cid", "links", F.coalesce("root", "uid").alias("root")).join(classes.select("cid", "k1", "k2", "least"), "cid")
    named = tables.write("named", named)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of = named.join(least, "root").select("k1", "k2", "links", "component")
    out = rows.select("vec_id", "k1", "k2").join(of, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
