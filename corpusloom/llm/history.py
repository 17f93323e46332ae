"""Problem 5: new batches against everything accepted before, by a pivot-distance table.

The metric between two contents is on their multisets of words: the larger of the two differences, that is, the number of words
that have to be changed, added or dropped whatever their order. A content counts as had if the distance is at most SHARE of the larger one.

Pivots are fixed, so that they hold for every batch to come: pivot 0 is the empty text, whose distance is the number of words; pivots 1 to
64*longs split all words by hash, the distance to pivot j being the words of class j (the distance to the nearest text without any). By
the triangle inequality these distances differ in sum by at most the L1 distance of the two multisets, which is at most
twice the metric; so the number of pivots whose distance has another parity is at most that as well. The parities of a row fit
into `longs` 64-bit numbers, and a pair is pruned by two range bounds on pivot 0 and one count of bits, without its words. As
the larger of two differences of n and m words is within the bound, their sum is at most twice the bound less |n - m|.

These distances concentrate, as they do for any text: over a fifth of the words, no range of a single pivot separates
anything (see the README for figures). Therefore the join is keyed besides: two contents within the bound share one of the
rarest SHARE of their words, in any fixed order of words (prefix filter, exact). The order is by how often a word's hash class
of 2^CLASS_BITS occurs in the first batch, and kept with the history. By the place of the shared word in both orders a pair is pruned
as well: no more words can be common than follow it. Postings of a word lie together in records of bytes, in order of size, so the join has one row
for many of them, most pairs of other sizes are never made, and the rest are pruned in numpy.

Equal multisets are one class, under their earliest row, before pairs are made; so copies aren't expanded into pairs.
Surviving pairs are verified by their true distance. A row's first_id is the earliest row whose class is within the bound of its own.

History keeps three tables in its folder, each stored in buckets by its key and sorted in them, one partition for each batch: classes (class,
earliest id, words), firsts (of a class that is near an earlier one, that one's id) and postings (word; size, place and pivots of each class). A batch appends its new classes and joins its own postings with
the stored ones bucket by bucket: the history is neither shuffled nor rewritten, its texts and words are never read for it. A
batch of at most ASKED different words reads only the pages of the postings that hold them, and at most ASKED candidates only those of the classes.
How many postings each word's hash class has is kept up to date with every batch. A class of words that has more than HOT is stored
from then on in that many parts by hash, and whoever asks for it asks every part, so no task takes more than about HOT stored rows of a word.

A batch is one whole: its partitions are written first and counted as accepted by the last write alone; a batch that failed before
that is written anew when it comes again, and nothing reads what it left. A batch number that was accepted can't come twice.

Unreadable JSON, null and blank contents, and contents without a word, are never cases nor history. Null ids are left out.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import words
from corpusloom.plans.lineage import shared_folder, written

SHARE, CLASS_BITS, HOT = 0.2, 18, 4000
#: Words, or candidate classes, up to which stored tables are asked for just these; more are joined with them bucket by bucket.
ASKED = 2000
#: Classes whose numbers may be sent to every executor (8 bytes each); more are joined by a shuffle.
SENT = 500_000
#: Buckets of the stored tables: as many as tasks that join a batch. Rows of a page, the least that is read of a file.
BUCKETS, PAGE = 16, 1000
#: Postings of a word in one stored row; rows that a Python task makes at once; pairs that it looks at, at once.
PACK, MADE, LOOKED = 1000, 100_000, 1_000_000


def block_content(text: str) -> str | None:
    """Question and answer of a JSON block, alone or under "block"; None if it can't be read or has no answer."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    if isinstance(found, dict) and isinstance(found.get("block"), dict):
        found = found["block"]
    if not isinstance(found, dict):
        return None
    question, answer = found.get("critical_question"), found.get("trusted_answer")
    if not isinstance(answer, str) or not answer.strip():
        return None
    return f"{question if isinstance(question, str) else ''}\n{answer}"


def body_content(text: str) -> str | None:
    return text


def _numbered(w: list[str]) -> np.ndarray:
    """A sorted set of hashes that stands for the multiset: the second occurrence of a word is another element."""
    import xxhash

    seen: dict[str, int] = {}
    get, digest, out = seen.get, xxhash.xxh3_64_intdigest, []
    for x in w:
        n = seen[x] = get(x, 0) + 1
        out.append(digest(x, n) >> 32)
    return np.sort(np.array(out, np.uint32))


def features(rows: DataFrame, id_col: str, text_col: str, content: Callable[[str], str | None]) -> DataFrame:
    """(id, class, tokens array<int>): the words of each content as a set of hashes; equal sets are one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                out: list[tuple] = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    c = content(t) if t and i is not None else None
                    w = words(c) if c else None
                    if w:
                        e = np.unique(_numbered(w))
                        out.append((i, xxhash.xxh3_64_intdigest(e.tobytes()) - (1 << 63), e.view(np.int32)))
                cols = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], names=["id", "class", "tokens"])

    src = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id bigint, class bigint, tokens array<int>")


def slot_counts(table: DataFrame, column: str) -> np.ndarray:
    """How often each hash class of words occurs in a column of words, alone or in arrays: 2^CLASS_BITS numbers whatever the corpus."""
    size = 1 << CLASS_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten() if pa.types.is_list(batch.schema.field(0).type) else batch.column(0)
            n += np.bincount(flat.to_numpy(zero_copy_only=False).view(np.uint32) >> np.uint32(32 - CLASS_BITS), minlength=size)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["slot", "n"])

    return _dense(table.select(column).mapInArrow(run, "slot int, n bigint"))


def _dense(counts: DataFrame) -> np.ndarray:
    out = np.zeros(1 << CLASS_BITS, np.int64)
    got = counts.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _record(longs: int) -> np.dtype:
    """A posting as it is stored: class, number of words, place of the word, parities."""
    return np.dtype([("class", "<i8"), ("n", "<i4"), ("place", "<i4"), ("p", "<u8", (longs,))])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie in data one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The records in a column of binary values, and how many each value has."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // kind.itemsize


def _within(n: np.ndarray) -> np.ndarray:
    """Their places among themselves, for the elements of groups of the given sizes that lie one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def postings(table: DataFrame, order: np.ndarray, longs: int) -> DataFrame:
    """(class, n, keys array<int>, parity): the rarest words of each class, as many as the bound needs, by their places in the order."""
    shared = table.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                n = pa.compute.list_value_length(part.column("tokens")).to_numpy()
                tokens = part.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                row = np.repeat(np.arange(len(n)), n)
                pivots = np.bincount(row * (64 * longs) + tokens % np.uint32(64 * longs), minlength=len(n) * 64 * longs)
                parity = np.packbits((pivots & 1).astype(np.uint8))
                by = np.lexsort((tokens, often[tokens >> np.uint32(32 - CLASS_BITS)], row))  # by row, rarest first
                need = n - np.array([math.ceil((1 - SHARE) * int(x) - 1e-9) for x in n]) + 1
                keys = tokens[by[_within(n) < need[row]]].view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(need))).astype(np.int32)), pa.array(keys))
                ends = np.arange(1, len(n) + 1) * (8 * longs)
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(n.astype(np.int32)), lists, _binary(parity, ends)], names=["class", "n", "keys", "parity"])

    return table.select("class", "tokens").mapInArrow(run, "class bigint, n int, keys array<int>, parity binary")


def packed(keyed: DataFrame, counts: np.ndarray, longs: int, buckets: int, asking: bool) -> DataFrame:
    """(key, part, rows): the postings of each word, by number of words in records of bytes; at most PACK in a row, so a word may have several.

    A hot word's are in parts: in that by which the class is stored or, asking, in each part there may be.
    """
    shared, kind = keyed.sparkSession.sparkContext.broadcast(-(-counts // HOT)), _record(longs)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                each = pa.compute.list_value_length(some.column("keys")).to_numpy()
                keys, row = some.column("keys").flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(each)), each)
                one = np.zeros(len(each), kind)
                one["class"], one["n"] = some.column("class").to_numpy(), some.column("n").to_numpy()
                one["p"] = _unpacked(some.column("parity"), np.dtype("<u8"))[0].reshape(-1, longs)
                place = _within(each)
                parts = np.maximum(1, shared.value[keys.view(np.uint32) >> np.uint32(32 - CLASS_BITS)])
                copies = parts if asking else np.ones(len(keys), np.int64)
                ends = np.cumsum(copies)
                cuts = [0, *np.searchsorted(ends, np.arange(MADE, copies.sum(), MADE)), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    at = np.repeat(np.arange(a, b), copies[a:b])
                    out = one[row[at]]
                    out["place"] = place[at]
                    part = _within(copies[a:b]) if asking else out["class"] % parts[at]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(part.astype(np.int32)), _binary(out, np.arange(1, len(at) + 1) * kind.itemsize)], names=["key", "part", "rows"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, _ = _unpacked(batch.column("rows"), kind)
                key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
                by = np.lexsort((rows["n"], part, key))
                rows, key, part = rows[by], key[by], part[by]
                starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
                sizes = np.diff(np.append(starts, len(key)))
                starts = np.flatnonzero(np.repeat(starts, sizes) + _within(sizes) // PACK * PACK == np.arange(len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(part[starts]), _binary(rows, np.append(starts[1:], len(key)) * kind.itemsize)], names=["key", "part", "rows"])

    schema = "key int, part int, rows binary"
    return keyed.mapInArrow(single, schema).repartition(buckets, "key", "part").sortWithinPartitions("key", "part").mapInArrow(together, schema)


def alike(both: DataFrame, longs: int) -> DataFrame:
    """(a, b) of rows (x, y, same): each posting of x with every one of y that sizes, places and pivots don't tell apart; same: of one batch, so each pair once."""
    kind, apart_by = _record(longs), 1 << 32

    def columns(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Class, words, words that must be common at least (which never falls with their number), words from the place on, parities."""
        n = rows["n"].astype(np.int64)
        return np.ascontiguousarray(rows["class"]), n, n - np.floor(n * SHARE + 1e-9).astype(np.int64), n - rows["place"], np.ascontiguousarray(rows["p"].T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, each), (y, others) = _unpacked(batch.column("x"), kind), _unpacked(batch.column("y"), kind)
            (a, n, need, left, p), (b, m, must, rest, q) = columns(x), columns(y)
            of, at = np.repeat(np.arange(len(each)), each), np.repeat(np.arange(len(others)), others) * apart_by
            earlier = ~batch.column("same").to_numpy(zero_copy_only=False).astype(bool)[of]
            # y is in order of m in each row: left >= must, and m >= rest >= need
            low = np.searchsorted(at + m, of * apart_by + need)
            many = np.maximum(0, np.searchsorted(at + must, of * apart_by + left, "right") - low)
            ends = np.cumsum(many)
            cuts = [0, *np.searchsorted(ends, np.arange(LOOKED, many.sum(), LOOKED)), len(many)]
            for s, e in zip(cuts, cuts[1:]):
                i = np.repeat(np.arange(s, e), many[s:e])
                j = np.repeat(low[s:e], many[s:e]) + _within(many[s:e])
                keep = np.flatnonzero((rest[j] >= need[i]) & (earlier[i] | (a[i] < b[j])))
                i, j = i[keep], j[keep]
                # with enough words in common, n + m - 2 * the larger of need and must at most are not
                free = n[i] + m[j] - 2 * np.maximum(need[i], must[j])
                for k in range(longs):
                    free -= np.bitwise_count(p[k][i] ^ q[k][j])
                    keep = np.flatnonzero(free >= 0)
                    i, j, free = i[keep], j[keep], free[keep]
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j])], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def had_before(rows: DataFrame, id_col: str, text_col: str, content: Callable[[str], str | None], longs: int) -> DataFrame:
    """(first_id, later_id) over a whole table, as one batch of an empty history."""
    store = History(rows.sparkSession, f"{shared_folder(rows.sparkSession)}/history-{uuid.uuid4().hex}", content, longs)
    return store.ingest(rows, id_col, text_col)


class History:
    """What has been accepted so far, in a folder that all executors share; batches come in the order of their ids."""

    def __init__(self, spark, folder: str, content: Callable[[str], str | None], longs: int = 2, buckets: int | None = None):
        self.spark, self.folder, self.content, self.longs = spark, folder.rstrip("/"), content, longs
        name = uuid.uuid4().hex
        self.buckets = buckets or BUCKETS
        self.tables = {}
        for table, columns, by in (("classes", "class bigint, id bigint, tokens array<int>", "class"), ("firsts", "class bigint, first bigint", "class"), ("postings", "key int, part int, rows binary", "key, part")):
            self.tables[table] = f"history_{table}_{name}"
            clustered = f"clustered by ({by}) sorted by ({by.split(',')[0]}) into {self.buckets} buckets"
            spark.sql(f"create table {self.tables[table]} ({columns}, batch int) using parquet options ('parquet.page.row.count.limit' '{PAGE}', 'parquet.enable.dictionary#rows' 'false') partitioned by (batch) {clustered} location '{self.folder}/{table}'")
            if self._there(table):
                spark.catalog.recoverPartitions(self.tables[table])

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def accepted(self) -> list[int]:
        """Numbers of the batches that were accepted whole."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/counts")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and self._there(f"counts/{n}/_SUCCESS"))

    def _counts(self, name: str) -> np.ndarray:
        return _dense(self.spark.read.schema("slot int, n bigint").parquet(f"{self.folder}/{name}"))

    def _save(self, counts: np.ndarray, name: str) -> None:
        seen = np.flatnonzero(counts)
        rows = self.spark.createDataFrame(pa.table({"slot": pa.array(seen.astype(np.int32)), "n": pa.array(counts[seen])}))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def stored(self, table: str, batches: list[int]) -> DataFrame:
        """The rows of the given batches."""
        return self.spark.table(self.tables[table]).filter(F.col("batch").isin(batches))

    def _append(self, rows: DataFrame, table: str, batch: int, placed: bool = False) -> None:
        """placed: the rows are in a partition for each bucket already."""
        name = self.tables[table]
        by = ["key", "part"] if table == "postings" else ["class"]
        columns = [c for c in self.spark.table(name).columns if c != "batch"]
        (rows if placed else rows.repartition(self.buckets, *by)).select(*columns).createOrReplaceTempView(f"{name}_more")
        self.spark.sql(f"insert overwrite table {name} partition (batch = {batch}) select * from {name}_more")  # this partition alone
        self.spark.catalog.dropTempView(f"{name}_more")

    def _asked(self, rows: DataFrame, column: str, stored: DataFrame) -> DataFrame:
        """The stored rows, without those that a small number of values can't have."""
        values = rows.select(column).distinct().limit(ASKED + 1).collect()
        return stored.filter(F.col(column).isin([v[0] for v in values])) if len(values) <= ASKED else stored

    def near(self, asking: DataFrame, stored: DataFrame, batch: int) -> DataFrame:
        """(a, b): each new class a with every class b that the keys, sizes, places and pivots don't tell apart; pairs of new ones once."""
        own, other = asking.select("key", "part", F.col("rows").alias("x")), stored.select("key", "part", F.col("rows").alias("y"), (F.col("batch") == batch).alias("same"))
        alone = F.col("same") & (F.octet_length("x") == _record(self.longs).itemsize) & (F.col("x") == F.col("y"))  # a posting with itself
        return alike(own.join(other, ["key", "part"]).filter(~alone).select("x", "y", "same"), self.longs).distinct()

    def verified(self, pairs: DataFrame, batches: list[int]) -> DataFrame:
        """(a, b) whose true distance is within the bound. Few classes are sent to the stored ones, many are joined with them."""
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "wanted")
        stored = self._asked(wanted, "class", self.stored("classes", batches).select("class", "tokens"))
        texts = written(stored.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "class", "left_semi"), "texts")
        x, y = texts.select(F.col("class").alias("a"), F.col("tokens").alias("x")), texts.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
        larger = F.greatest(F.size("x"), F.size("y"))
        distance = larger - F.size(F.array_intersect("x", "y"))
        return pairs.join(x, "a").join(y, "b").filter(distance <= F.floor(larger * SHARE + 1e-9)).select("a", "b")

    def ingest(self, batch: DataFrame, id_col: str, text_col: str, number: int | None = None) -> DataFrame:
        """(first_id, later_id) of the batch's rows; its new content becomes part of the history. Without a number the batch is the next one."""
        before = self.accepted()
        number = number if number is not None else (before[-1] + 1 if before else 0)
        if before and number <= before[-1]:
            raise ValueError(f"batch {number} comes after batch {before[-1]}")
        now = [*before, number]
        table = written(features(batch, id_col, text_col, self.content), "contents")
        heads = table.groupBy("class").agg(F.min("id").alias("id"))
        known = self._asked(heads, "class", self.stored("classes", before)).select("class", "id")
        firsts = self._asked(heads, "class", self.stored("firsts", before)).select("class", "first")
        known = known.join(firsts, "class", "left").select("class", F.coalesce("first", "id").alias("known"))
        heads = written(heads.join(known, "class", "left"), "heads")
        kept = heads.filter("known is null").select("class", F.col("id").alias("head"))  # its class's least id: an equality would be a key, and the words be sent twice
        fresh = table.repartition(self.buckets, "class").join(kept.repartition(self.buckets, "class"), "class").filter("id <= head")
        self._append(fresh, "classes", number, placed=True)
        fresh = self.stored("classes", [number])
        if not before:
            self._save(slot_counts(fresh, "tokens"), "order")
        keyed = written(postings(fresh, self._counts("order"), self.longs), "postings")
        added = slot_counts(keyed, "keys")
        counts = sum((self._counts(f"counts/batch-{n}") for n in before), added)
        self._append(packed(keyed, counts, self.longs, self.buckets, False), "postings", number, placed=True)
        if counts.max(initial=0) <= HOT:  # as they were stored: nothing is sent again
            asking = self.stored("postings", [number]).drop("batch")
        else:
            asking = packed(keyed, counts, self.longs, self.buckets, True)
        keys = keyed.select(F.explode("keys").alias("key"))
        pairs = written(self.near(asking, self._asked(keys, "key", self.stored("postings", now)), number), "pairs")
        close = written(self.verified(pairs, now), "near")
        either = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ids = self._asked(either.select(F.col("b").alias("class")), "class", self.stored("classes", now).select("class", F.col("id").alias("head")))
        earliest = either.join(ids.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.min("head").alias("near"))
        self._append(heads.filter("known is null").join(earliest, "class").filter("near < id").select("class", F.col("near").alias("first")), "firsts", number)
        firsts = self.stored("firsts", [number]).select("class", "first")
        best = heads.join(firsts, "class", "left").select("class", F.coalesce("known", "first", "id").alias("first_id"))
        found = written(table.select("id", "class").join(best, "class").filter("id > first_id").select("first_id", F.col("id").alias("later_id")), "found")
        self._save(added, f"counts/batch-{number}")  # from here on the batch is accepted
        return found
