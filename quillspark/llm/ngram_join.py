"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order is the order of the n-grams' 64-bit hashes; cut into fragments, a document's
set becomes segments.

1. *Candidates.*  Sets of sizes n1 <= n2 with similarity t or more differ in at most
   d = n1 * (1 - t) / t elements, so with K > d fragments at least one segment is the same in
   both.  K depends on the size class; a set takes part in its own class and the one below, as
   partners are at most one class apart.  Sets with an equal segment are a group; copies of one
   set are one member, and map tasks send each of their sets once.
2. *Rounds.*  In the first, each member of a group meets the group's first one.  Then groups
   whose members aren't all connected yet are compared across their components: a member meets
   the first one, then four, sixteen and so on that it may be similar to in another component, until
   none is left.  So a family of copies costs one pair a member; all pairs are never listed.
3. *Parity filter.*  Of every set there are about n parity bits, by its elements' hashes.  Bits
   in which two sets differ can't outnumber the elements in which they differ, so pairs with too
   many are dropped.
4. *Counting.*  The elements of the sets that are left are dealt by fragment of the order; for
   every pair the partial overlaps are counted in each fragment apart and summed per pair.  The
   sum, in exact integers, decides.

Links make components; a component is named by its smallest id.  Null or blank texts have the
empty set and link with nothing.  Rows with a null id keep their row with a null component; they
join nothing.  Rows that share an id are one node, linked by any of their texts.  An empty table
gives an empty result.  Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.components import components
from quillspark.llm.shared import bound_batches, free, materialize

U64 = np.uint64
#: Signatures that a map task holds before it sends them on; bytes of text of a bucket of them; members of a block.
HELD, BUCKET_BYTES, BLOCK = 1_000_000, 24_000_000, 4096
#: Fragments of the order in which overlaps are counted, as the number of leading hash bits.
FRAGMENT_BITS = 3
FOUND = "kind int, a long, b long, n long, h1 long, h2 long, sketch binary"
KINDS = "bucket int, " + FOUND + ", keys binary, ids binary"
SET, PAIR, GROUP = 0, 1, 2
#: Orders in which a set is cut until enough segments are occupied.
TURNS = 12


def _table(schema: str, n: int, /, **cols) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], type=types[t]) if c in cols else pa.nulls(n, types[t]) for c, t in fields], names=[c for c, _ in fields])


class Sizes:
    """Size classes such that linked sets are in the same or in adjacent classes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts, self.counts = [1], {}

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def differ(self, group: int) -> int:
        """The most elements in which a linked pair differs whose smaller set is of this class."""
        while len(self.starts) < group + 2:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return (self.starts[group + 1] - 1) * (self.den - self.num) // self.num


    def fragments(self, group: int) -> int:
        """So many fragments that more of them than ``differ`` hold elements of most sets of this group.

        The mean number of occupied fragments exceeds it by a standard deviation; more fragments
        would make segments of single elements, which sets share without being alike.
        """
        if group not in self.counts:
            d, n = self.differ(group), self.starts[group]
            k = d + 1
            while k < 4 * n + 16:
                empty = math.exp(-n / k)
                if k * (1 - empty) - math.sqrt(k * empty * (1 - (1 + n / k) * empty)) >= d + 1:
                    break
                k += max(1, k // 50)
            self.counts[group] = k
        return self.counts[group]


def signatures(h: np.ndarray, sizes: Sizes) -> np.ndarray:
    """One hash for each non-empty segment of a sorted set, for both groups it belongs to.

    A set of which no more than d segments are occupied could agree with a partner in empty ones
    alone.  It is cut again, in another order; so is its partner, unless that has more than d
    occupied segments, of which one is then equal in both.
    """
    out = []
    own = sizes.of(len(h))
    mixed = tk.mix(h)
    for group in (own - 1, own):
        if group < 0 or (d := sizes.differ(group)) == 0:
            continue
        k = sizes.fragments(group)
        for turn in range(TURNS):
            order, values = h, mixed
            if turn:
                order = tk.mix(h + U64(turn))
                by = np.argsort(order)
                order, values = order[by], mixed[by]
            place = (((order >> U64(32)) * U64(k)) >> U64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            name = U64(k * 131 + group * 1_000_003 + turn * 1_000_000_007)
            out.append(tk.mix(np.add.reduceat(values, first) + (place[first].astype(U64) + name) * U64(0xC2B2AE3D27D4EB4F)))
            if len(first) > d:
                break
        else:  # hardly ever: empty segments count as well
            empty = np.setdiff1d(np.arange(k), place[first]).astype(U64)
            out.append(tk.mix((empty + name) * U64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate(out) if out else np.zeros(0, U64)


def sketch(h: np.ndarray) -> np.ndarray:
    """The parities of a set's elements in as many bits as the power of two that isn't less than its size."""
    bits = max(64, 1 << int(len(h) - 1).bit_length()) if len(h) else 64
    place = (tk.mix(h + U64(3)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(U64)


def fold(s: np.ndarray, words: int) -> np.ndarray:
    """The sketch (or rows of sketches) in fewer words, as if it had been made so."""
    while s.shape[-1] > words:
        half = s.shape[-1] // 2
        s = s[..., :half] ^ s[..., half:]
    return s


def most_apart(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most elements that stand in one of two linked sets only; less than 0 where sizes alone forbid a link."""
    apart = n + m - 2 * (((n + m) * num + num + den - 1) // (num + den))
    return np.where((n * den >= m * num) & (m * den >= n * num), apart, -1)


def _sets(k: int, num: int, den: int, buckets: int):
    """Sets of documents: a row of kind SET each; kind GROUP: signature blocks.

    Signatures are sent as the upper 48 bits of their hashes; their bucket holds lower ones.
    """

    def send(held):
        order = np.lexsort([np.array([x[c] for x in held], np.int64) for c in (0, 1, 2)])
        sets = [held[i] for i in order]  # of equal sets the smallest id's
        sets = [x for i, x in enumerate(sets) if not i or x[1:3] != sets[i - 1][1:3]]
        keys, ids = np.concatenate([x[3] for x in sets]), np.concatenate([np.full(len(x[3]), x[0], np.int64) for x in sets])
        b = (keys % U64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        b, keys, ids = b[order], keys[order], ids[order]
        cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        ends = [*cut[1:], len(b)]
        packed = {"keys": [tk.short(keys[i:j]).tobytes() for i, j in zip(cut, ends, strict=True)], "ids": [ids[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]}
        yield _table(KINDS, len(cut), bucket=b[cut].astype(np.int32), kind=np.full(len(cut), GROUP, np.int32), **packed)

    def run(batches):
        sizes, held, total = Sizes(num, den), [], 0
        for batch in batches:
            ids = batch.column(0)
            data, offs = tk.utf8(batch.column(1))
            n, h1, h2 = (np.zeros(len(ids), np.int64) for _ in range(3))
            sketches = [b""] * len(ids)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for at, to in tk.chunks(offs):
                words, first = tk.word_hashes(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
                for i in range(at, to):
                    s = tk.shingles(words[first[i - at] : first[i - at + 1]], k)
                    n[i] = len(s)
                    if not len(s) or not known[i]:
                        continue
                    h1[i], h2[i] = (np.add.reduce(tk.mix(s + U64(c))).view(np.int64) for c in (1, 2))
                    sketches[i] = sketch(s).tobytes()
                    if len(keys := signatures(s, sizes)):
                        held.append((number[i], h1[i], h2[i], keys))
                        total += len(keys)
                        if total > HELD:
                            yield from send(held)
                            held, total = [], 0
            bucket = (tk.mix(number.astype(np.int64).view(U64)) % U64(buckets)).astype(np.int32)
            yield _table(KINDS, len(ids), bucket=bucket, kind=np.full(len(ids), SET, np.int32), a=ids, n=n, h1=h1, h2=h2, sketch=sketches)
        if held:
            yield from send(held)
        held.clear()
        tk.release()

    return run


def _meet(key, table):
    """Of one bucket: each group's first member with the others, and the groups of three and more, equal ones once."""
    kind = table.column("kind").to_numpy()
    names = [x.split()[0] for x in FOUND.split(", ")]
    passed = table.filter(pa.array(kind == SET)).select(names)
    get = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), dtype=t) for x, k in zip(table.column(c), kind, strict=True) if k == GROUP)])
    keys, ids = tk.unshort(get("keys", np.uint8)), get("ids", np.int64)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    if len(first):
        named = np.stack([np.add.reduceat(tk.mix(ids.view(U64) + U64(c)), first) for c in (1, 2)], 1)
        once = np.zeros(len(first), bool)
        once[np.unique(named, axis=0, return_index=True)[1]] = True
        once &= size > 1
        group = np.repeat(np.arange(len(first)), size)
        kept = once[group]
        lead = ids[first][group]
        pairs = np.unique(np.stack((lead[kept], ids[kept]), 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        wide = kept & (size > 2)[group]
        code = (named[:, 0] ^ tk.mix(named[:, 1]))[group].view(np.int64)  # by the members, so that equal groups are one
        passed = pa.concat_tables([
            passed,
            pa.Table.from_batches([_table(FOUND, len(pairs), kind=np.full(len(pairs), PAIR, np.int32), a=pairs[:, 0], b=pairs[:, 1])]),
            pa.Table.from_batches([_table(FOUND, int(wide.sum()), kind=np.full(int(wide.sum()), GROUP, np.int32), a=ids[wide], h1=code[wide])]),
        ])
    tk.release()
    return passed


def _possible(num: int, den: int):
    """Of pairs with sizes and sketches those that may be linked."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("an", "bn"))
            apart = most_apart(n, m, num, den)
            ok = apart >= 0
            for i in np.flatnonzero(ok):
                x, y = (np.frombuffer(batch.column(c)[int(i)].as_buffer(), U64) for c in ("ask", "bsk"))
                words = min(len(x), len(y))
                ok[i] = int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()) <= apart[i]
            yield batch.select(["a", "ah", "an", "b", "bh", "bn"]).filter(pa.array(ok))

    return run


def _across(num: int, den: int, take: int):
    """Of one block of a group: for each outer member the first few that it may be linked with in each other component."""

    def run(key, table):
        ids, comp, n, side = (table.column(c).to_numpy() for c in ("id", "component", "n", "side"))
        sketches = [np.frombuffer(x.as_buffer(), U64) for x in table.column("sketch")]
        width = np.array([len(x) for x in sketches])
        inner = np.flatnonzero(side == 0)
        inner = inner[np.argsort(ids[inner], kind="stable")]
        rows = {w: inner[np.isin(width[inner], (w, 2 * w))] for w in np.unique(np.concatenate((width, width // 2)))}
        folded = {w: np.stack([fold(sketches[i], w) for i in x]) for w, x in rows.items() if w and len(x)}
        out, more = [], False
        for y in np.flatnonzero(side == 1):
            for w, only in ((int(width[y]), False), (int(width[y]) // 2, True)):
                if w not in folded:
                    continue
                x = rows[w]
                apart = most_apart(n[x], np.full(len(x), n[y]), num, den)
                ok = (comp[x] != comp[y]) & (apart >= 0)
                if only:
                    ok &= width[x] == w
                x, apart, at = x[ok], apart[ok], np.flatnonzero(ok)
                x = x[np.bitwise_count(folded[w][at] ^ fold(sketches[y], w)).sum(axis=1) <= apart]
                order = np.argsort(comp[x], kind="stable")
                x = x[order]
                new = np.concatenate(([True], comp[x][1:] != comp[x][:-1])) if len(x) else np.zeros(0, bool)
                place = np.arange(len(x)) - (np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else 0)
                more |= bool((place >= take).any())
                out += [(min(ids[i], ids[y]), max(ids[i], ids[y])) for i in x[place < take]]
        pairs = np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)
        return pa.table({"code": pa.array([key[0].as_py()] * len(pairs), pa.int64()), "a": pairs[:, 0], "b": pairs[:, 1], "more": pa.array([more] * len(pairs), pa.bool_())})

    return run


def _segments(k: int):
    """(id, h1, fragment, elements): the sets of the documents in question, dealt by leading bits of the hashes."""

    def run(batches):
        for batch in batches:
            data, offs = tk.utf8(batch.column(1))
            for at, to in tk.chunks(offs):
                words, first = tk.word_hashes(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
                owner, key, fragment, ends, parts = [], [], [], [0], []
                for i in range(to - at):
                    s = tk.shingles(words[first[i] : first[i + 1]], k)
                    h1 = int(np.add.reduce(tk.mix(s + U64(1))).view(np.int64)) if len(s) else 0
                    place = (s >> U64(64 - FRAGMENT_BITS)).astype(np.int64)
                    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(s) else []
                    owner += [i + at] * len(cut)
                    key += [h1] * len(cut)
                    fragment += place[cut].tolist() if len(s) else []
                    ends += [ends[-1] + x for x in ([*cut[1:], len(s)] if len(s) else [])]
                    parts.append(s.view(np.int64))
                elements = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(key, pa.int64()), pa.array(fragment, pa.int32()), elements], names=["id", "h1", "fragment", "elements"])
        tk.release()

    return run


class Join:
    """The state of one join: the distinct sets, their segments as far as they were needed, and the links found."""

    def __init__(self, rows: DataFrame, named: DataFrame, k: int, num: int, den: int):
        self.rows, self.named, self.k, self.num, self.den = rows, named, k, num, den
        self.segments = self.tested = None

    def _with_segments(self, near: DataFrame) -> DataFrame:
        new = near.select(F.col("a").alias("id")).unionAll(near.select(F.col("b").alias("id"))).distinct()
        if self.segments is not None:
            new = new.join(self.segments.select("id").distinct(), "id", "left_anti")
        made = self.rows.join(new, "id").select("id", "text").mapInArrow(_segments(self.k), "id long, h1 long, fragment int, elements array<long>")
        made = materialize(made, "segments")
        self.segments = made if self.segments is None else self.segments.unionAll(made)
        return self.segments

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of some pairs those that are linked: sketches first, then overlaps counted by fragment and summed."""
        pairs = pairs.select("a", "b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionAll(pairs)
        near = pairs
        for s in "ab":
            side = self.named.select(F.col("id").alias(s), F.col("h1").alias(f"{s}h"), F.col("n").alias(f"{s}n"), F.col("sketch").alias(f"{s}sk"))
            near = near.join(side, s)
        near = materialize(near.mapInArrow(_possible(self.num, self.den), "a long, ah long, an long, b long, bh long, bn long"), "near")
        segments, both = self._with_segments(near), near
        for s, on in (("a", ["a", "ah"]), ("b", ["b", "bh", "fragment"])):
            both = both.join(segments.select(F.col("id").alias(s), F.col("h1").alias(f"{s}h"), "fragment", F.col("elements").alias(f"{s}e")), on)
        counted = both.select("a", "ah", "an", "b", "bh", "bn", "fragment", F.size(F.array_intersect("ae", "be")).cast("long").alias("s"))
        pair = ["a", "ah", "an", "b", "bh", "bn"]
        partial = counted.groupBy(*pair, "fragment").agg(F.max("s").alias("s"))  # equal rows have equal segments
        summed = partial.groupBy(*pair).agg(F.sum("s").alias("s"))
        found = summed.where(F.col("s") * self.den >= (F.col("an") + F.col("bn") - F.col("s")) * self.num)
        return materialize(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def _blocks(groups: DataFrame, named: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of groups that lie in several components: outer ones (not of the smallest) against all, in bounded blocks."""
    member = groups.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = materialize(member, "members")
    several = member.groupBy("code").agg(F.min("component").alias("main"), F.max("component").alias("last"), F.count("*").alias("m")).where("main < last").drop("last")
    member = member.join(several, "code")
    outer = member.where("component <> main").groupBy("code").agg(F.count("*").alias("u"))
    member = member.join(outer, "code").join(named.select("id", "n", "sketch"), "id")
    salts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.hash("id"), salts(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0), salts(c) - 1))
    cols = ["code", "id", "component", "n", "sketch"]
    inner = member.select(*cols, upto("u").alias("i"), own("m").alias("j"), F.lit(0).alias("side"))
    outer = member.where("component <> main").select(*cols, own("u").alias("i"), upto("m").alias("j"), F.lit(1).alias("side"))
    return inner.unionAll(outer)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row: components of similarity >= num / den.

    Similarity is the Jaccard index of the sets of distinct k-word shingles, in exact integer
    arithmetic.  The component is named by its smallest id.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    made = rows.mapInArrow(_sets(k, num, den, buckets), KINDS).groupBy("bucket").applyInArrow(_meet, FOUND)
    made = materialize(made, "sets")
    free(spark)
    sets = made.where(F.col("kind") == SET).select(F.col("a").alias("id"), "n", "h1", "h2")
    full = sets.where("n > 0 and id is not null")
    rep = materialize(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "rep")
    of = materialize(full.join(rep, ["h1", "h2", "n"]).select("id", "rep").distinct(), "of")
    named = made.where((F.col("kind") == SET) & (F.col("n") > 0) & F.col("a").isNotNull()).select(F.col("a").alias("id"), "n", "h1", "h2", "sketch")
    named = named.join(rep.select(F.col("rep").alias("id"), "h1", "h2", "n"), ["id", "h1", "h2", "n"]).dropDuplicates(["id", "h1", "h2", "n"])

    def of_sets(df: DataFrame, *cols: str) -> DataFrame:
        """Ids replaced by the smallest ids of their sets."""
        for c in cols:
            df = df.join(of.select(F.col("id").alias(c), F.col("rep").alias(f"{c}_rep")), c).drop(c).withColumnRenamed(f"{c}_rep", c)
        return df

    join = Join(rows, named, k, num, den)
    pairs = of_sets(made.where(F.col("kind") == PAIR).select("a", "b"), "a", "b").where("a <> b")
    links = join.links(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # Texts of one id are one node.
    shared = of.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("id", "u")
    links = links.unionAll(of.join(shared, "id").where("rep > u").select("u", F.col("rep").alias("v")))
    linked = components(links)
    free(spark)
    groups = made.where(F.col("kind") == GROUP).select(F.col("h1").alias("code"), F.col("a").alias("id"))
    groups = materialize(of_sets(groups, "id").distinct(), "groups")
    take = 1
    while True:
        blocks = _blocks(groups, named, linked)
        found = materialize(blocks.groupBy("code", "i", "j").applyInArrow(_across(num, den, take), "code long, a long, b long, more boolean"), "across")
        if found.isEmpty():
            break
        new = join.links(found)
        # A group of which nothing was left out has had all its pairs across components tested.
        again = found.where("more").select("code").distinct()
        if again.isEmpty():
            links = links.unionAll(new)
            linked = components(links)
            break
        if not new.isEmpty():
            links = links.unionAll(new)
            linked = components(links)
        groups = materialize(groups.join(again, "code", "left_semi"), "groups")
        take *= 4

    component = rep.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(component, ["h1", "h2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """Three words, a similarity of 0.9 or more, over all documents."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2]) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * s >= 90 * (x.n + y.n - s)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.node = d.doc_id
"""
