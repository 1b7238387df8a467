"""Vector code compression by product codebooks, member-resident Lloyd (12).

Components become integers floor(1024 x); a vector is cut into ``PARTS``
consecutive parts, and every part position has a codebook of at most
``ENTRIES`` entries, at first the parts of the smallest ids.  Each round
assigns every part to its nearest entry and replaces the entries by the
floored means of their parts.  All of it is integer arithmetic, so the result
does not depend on the order of sums.

Parts live with their entry: a part is a row of the partition of its
(position, entry, salt), in tables bucketed by these three.  The owner of a
partition sums its resident members, only the sums of the partitions are
shuffled, and the new codebooks (a fixed number of entries) reach every
owner.  The owner then assigns its members anew, writes the ones that stay
where they are, without a shuffle, and hands over the ones that change
entry; only these migrate in the next shuffle.  Parts that arrive at one entry
are dealt over one salt for each ``CELL_ROWS`` of them, counted before they
move, so an entry that holds a third of all parts has many owners.

Every step ends in a written table in the shared folder; a lost executor's
tasks read the last one again.  Tables of a round go when the next one is
written.

Defined cases: vectors that are null, or hold null or non-finite components,
are dropped, and so are empty ones and those that have not the most frequent
length (of equally frequent ones the largest); a null id comes after all
others, equal ids are ordered by their components; lengths that the parts do not divide are cut as evenly as whole
components allow; fewer vectors than entries give smaller codebooks; integers
beyond 2^24 are an error, for distances would not fit 64 bits; repeated rows
have their own results; null labels are one label; an empty table gives an
empty result; other columns are kept out of the result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import new_path, scratch, stored
from changeflow.session import remove_paths

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
CELL_ROWS = 4096          # arriving parts of one entry for one salt
BUCKET_ROWS = 16_384     # parts a bucket
LARGEST = 1 << 24         # of an integer component
BLOCK_ROWS = 8192
CELL = ["position", "entry", "salt"]
MEMBER = "position int, entry int, salt int, deal int, part array<int>"
ASSIGNED = MEMBER + ", new int, moved boolean"


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, ints, deal): the kept vectors; ``deal`` spreads rows,
    repeated ones too, over salts."""
    v = F.col(column)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v.cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))
    rows = (vectors.filter(F.coalesce(good, F.lit(False)))
            .select(F.col("vec_id").cast("long"), label.alias("label"), scaled.alias("ints")))
    fits = F.coalesce(F.array_max(F.transform("ints", F.abs)), F.lit(0.0)) <= LARGEST
    return rows.select("vec_id", "label", F.when(fits, F.col("ints").cast("array<int>")).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}"))).alias("ints"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int").alias("deal"))


def _cuts(length: int) -> list[int]:
    return [length * p // PARTS for p in range(PARTS + 1)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Codebooks:
    """The entries of every position, as integers."""

    def __init__(self, books: list[np.ndarray]):
        self.books = [b.astype(np.int64) for b in books]
        self.norms = [(b * b).sum(1) for b in self.books]

    def nearest(self, position: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, ties to the lower entry."""
        book, norm = self.books[position], self.norms[position]
        entry = np.empty(len(parts), np.int64)
        error = np.empty(len(parts), np.int64)
        largest = max([int(np.abs(x).max()) for x in (book, parts) if x.size] or [0])
        kind = np.float64 if 4 * book.shape[1] * largest ** 2 < 1 << 53 else np.int64      # floats while they are exact
        turned = book.T.astype(kind)
        for a in range(0, len(parts), BLOCK_ROWS):
            x = parts[a:a + BLOCK_ROWS].astype(kind)
            apart = norm - 2 * (x @ turned)
            best = apart.argmin(1)
            entry[a:a + BLOCK_ROWS] = best
            own = parts[a:a + BLOCK_ROWS].astype(np.int64)
            error[a:a + BLOCK_ROWS] = apart[np.arange(len(x)), best].astype(np.int64) + (own * own).sum(1)
        return entry, error

    def replaced(self, sums: dict[tuple[int, int], tuple[np.ndarray, int]]) -> Codebooks:
        """Entries with members become their floored means."""
        books = [b.copy() for b in self.books]
        for (position, entry), (total, count) in sums.items():
            books[position][entry] = total // count
        return Codebooks(books)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def initial(vectors: DataFrame) -> Codebooks | None:
    """The parts of the smallest ids: ``ENTRIES`` rows at most."""
    rows = [r.ints for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(ENTRIES).collect()]
    if not rows:
        return None
    values, cuts = np.array(rows, np.int64), _cuts(len(rows[0]))
    return Codebooks([values[:, a:b] for a, b in zip(cuts, cuts[1:])])


def _first_members(vectors: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """Every part with its first entry."""
    shared, cuts = vectors.sparkSession.sparkContext.broadcast(books), _cuts(length)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                values = _matrix(piece.column("ints"), length)
                for position, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = np.ascontiguousarray(values[:, a:b])
                    entry, _ = shared.value.nearest(position, part)
                    yield _members(np.full(len(part), position), entry, np.zeros(len(part)), piece.column("deal"), part)
    return vectors.select("ints", "deal").mapInArrow(run, MEMBER)


def _parts(members: pa.Table) -> np.ndarray:
    part = members.column("part").combine_chunks()
    return part.flatten().to_numpy(zero_copy_only=False).reshape(members.num_rows, -1)


def _members(position, entry, salt, deal, part: np.ndarray) -> pa.RecordBatch:
    width = part.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(part.ravel(), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), deal, lists],
                                      ["position", "entry", "salt", "deal", "part"])


class Residents:
    """The members of all entries: two tables bucketed by (position, entry,
    salt), one of those that stayed and one of those that arrived."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.tables: dict[str, str] = {}          # table -> path
        self.stayed = self._write(spark.createDataFrame([], ASSIGNED), "moved")
        self.arrived = ""

    def _write(self, members: DataFrame, partition: str | None = None) -> str:
        path = new_path(self.spark, "members")
        name = f"members_{uuid.uuid4().hex}"
        out = members.write.bucketBy(self.buckets, *CELL).sortBy(*CELL).option("path", path)
        (out.partitionBy(partition) if partition else out).saveAsTable(name)
        self.tables[name] = path
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_paths(self.spark, [self.tables.pop(n) for n in names])

    def owners(self, run, schema: str) -> DataFrame:
        """``run(stayed, arrived)`` of every partition's resident members: no
        shuffle, both tables are bucketed by it."""
        stayed = self.spark.table(self.stayed).filter("not moved").select(*CELL, "deal", "part")
        return stayed.groupBy(*CELL).cogroup(self.spark.table(self.arrived).groupBy(*CELL)).applyInArrow(run, schema)

    def receive(self, moved: DataFrame) -> None:
        """``moved`` (MEMBER) migrates to its entries' owners, the one shuffle
        of members: one salt for each ``CELL_ROWS`` of an entry's arrivals."""
        count = stored(moved.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n")), "arrivals")
        salts = F.broadcast(count.select("position", "entry", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("salts")))   # PARTS * ENTRIES rows
        dealt = moved.drop("salt").join(salts, ["position", "entry"]).withColumn("salt", F.pmod("deal", "salts"))
        dealt = dealt.select("position", "entry", "salt", "deal", "part").repartition(self.buckets, *CELL)
        self.arrived = self._write(dealt)

    def sums(self) -> dict[tuple[int, int], tuple[np.ndarray, int]]:
        """(position, entry) -> (sum, count) of its members: summed by their
        owners, then over an entry's salts.  As large as the codebooks."""
        def run(stayed: pa.Table, arrived: pa.Table) -> pa.Table:
            held = [t for t in (stayed, arrived) if t.num_rows]
            parts = [_parts(t) for t in held]
            total = [*sum(p.sum(0, dtype=np.int64) for p in parts).tolist(), sum(map(len, parts))]
            return pa.table([held[0].column(c).slice(0, 1) for c in ("position", "entry")] + [pa.array([total], pa.list_(pa.int64()))],
                            ["position", "entry", "total"])
        own = stored(self.owners(run, "position int, entry int, total array<long>"), "sums")
        rows = (own.select("position", "entry", F.posexplode("total").alias("i", "x")).groupBy("position", "entry", "i").agg(F.sum("x").alias("x"))
                .groupBy("position", "entry").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("total"))).collect()
        return {(r.position, r.entry): (np.array([x.x for x in r.total[:-1]], np.int64), r.total[-1].x) for r in rows}

    def assign(self, books: Codebooks) -> DataFrame:
        """Members meet the new codebooks at their owners; those that stay are
        the next residents, those that change entry are returned."""
        shared = self.spark.sparkContext.broadcast(books)

        def run(stayed: pa.Table, arrived: pa.Table) -> pa.Table:
            out = []
            for t in (stayed, arrived):
                if t.num_rows:
                    new, _ = shared.value.nearest(t.column("position")[0].as_py(), _parts(t))
                    moved = new != t.column("entry").to_numpy()
                    out.append(t.select([*CELL, "deal", "part"]).append_column("new", pa.array(new, pa.int32())).append_column("moved", pa.array(moved)))
            return pa.concat_tables(out)
        before = [self.stayed, self.arrived]
        found = self.owners(run, ASSIGNED)
        self.stayed = self._write(found, "moved")
        self.drop(*before)
        rows = self.spark.table(self.stayed).filter("moved")
        return rows.select("position", F.col("new").alias("entry"), "salt", "deal", "part")


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[Codebooks | None, int]:
    """(codebooks, length of the vectors) of ``vectors`` (vec_id, ints, deal)."""
    spark = vectors.sparkSession
    most = (vectors.groupBy(F.size("ints").alias("length")).agg(F.count(F.lit(1)).alias("n")).filter("length > 0")
            .agg(F.max(F.struct("n", "length")).alias("most")).first().most)
    if most is None:
        return None, 0
    length = most.length
    held = vectors.filter(F.size("ints") == length)
    books = initial(held)
    with scratch(spark):
        residents = Residents(spark, max(1, -(-most.n * PARTS // BUCKET_ROWS)))
        try:
            moved = stored(_first_members(held, books, length), "first-members")
            for r in range(rounds):
                residents.receive(moved)
                books = books.replaced(residents.sums())
                if r + 1 < rounds:
                    moved = residents.assign(books)
        finally:
            residents.drop(*residents.tables)
    return books, length


def encode(vectors: DataFrame, books: Codebooks | None, length: int) -> DataFrame:
    """``vectors`` (vec_id, label, ints) with code and error, without a
    shuffle; other lengths are dropped."""
    shared, cuts = vectors.sparkSession.sparkContext.broadcast(books), _cuts(length)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                values = _matrix(piece.column("ints"), length)
                found = [shared.value.nearest(p, np.ascontiguousarray(values[:, a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                code = [bytes(row).hex() for row in np.stack([e for e, _ in found], 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array(code, pa.string()), pa.array(sum(e for _, e in found))],
                                                 ["vec_id", "label", "code", "error"])
    label = vectors.schema["label"].dataType.simpleString()
    held = vectors.select("vec_id", "label", "ints").filter(F.size("ints") == length if books else F.lit(False))
    return held.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every
    kept row of ``vectors`` (vec_id, label, ``column``)."""
    spark = vectors.sparkSession
    with scratch(spark):
        ints = stored(integers(vectors, column), "ints")
        books, length = train(ints)
        coded = stored(encode(ints, books, length), "codes", keep=True)
    # written before the join, so AQE may split a label that holds many rows
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "__label")
    sha = books.sha256() if books else None
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


def digest(vectors: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return compress(vectors).drop("label")
