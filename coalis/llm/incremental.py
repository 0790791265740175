"""Deduplicating batches against all history by multi-key sorted-neighbourhood runs.

Accepted records are kept as *runs*: tables sorted by a textual sort key, cut into key ranges (one
folder a range) and pages of :data:`PAGE` entries, with a sparse index of each page's first key.
Runs live in a folder with a manifest, so a later job opens them and adds one batch without
touching the history again.  There are three sort keys, each with runs of its own:

* ``exact``: partition, kind, issue, package, version and qualifiers.  One entry per key and run
  with the smallest accepted id, so a key that holds a third of all rows is one entry.
* ``package``: partition, kind, issue, package, then the words of the record, then its id.
* ``words``: partition, kind, the words of the record, then its id.

A batch

1. is sorted into a run of its own (the new run's entries are the batch's heads),
2. is merged with the page index of the stored runs, which tells the pages its heads fall into;
   only those pages (and for windows the ones beside them) are read and merged with the heads,
3. looks at the window around each head: in ``exact`` at the entries just before it, at most one a
   run, for its own key; in the others at the :data:`WINDOW` accepted entries on both sides, whose
   words are compared (multiset Jaccard of trigrams, as in nearcopies.py),
4. becomes history.

Every ``compact_every`` batches the batch runs are merged into one, and into the main run once
they reach half its size, so an entry is rewritten a logarithmic number of times.

Defined cases: rows with a null partition, kind or id, or (``exact``, ``package``) without a valid
issue or subject, repeat nothing and are repeated by nothing; null array members and members
that do not parse are ignored; rows of one batch never repeat each other; rows without batch
number come last; repeated rows count once; a record that says nothing is near nothing; an empty
history or batch table is fine; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coalis.functions.subjects import subject_names
from coalis.functions.text import normalize_issues
from coalis.operators.skew import attach
from coalis.sources.scratch import Scratch, small_or_shuffled

from .nearcopies import _verifier, bag

#: Entries of a page, and accepted neighbours looked at on either side of a new record.
PAGE, WINDOW = 64, 10
#: Ranges a run can have: their first keys are all the driver and the tasks hold of the keys.
MAX_RANGES = 1 << 16
#: Between the parts of a sort key; sorts before everything a part may hold.
_SEP = "\u0001"


def _joined(*parts: Column) -> Column:
    return F.concat_ws(_SEP, *[F.coalesce(p, F.lit("")) for p in parts])


def _block() -> list[Column]:
    return [F.col("partition"), F.col("kind.tag"), F.when(F.col("kind.value").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("kind.value")))]


def _parted(records: DataFrame) -> DataFrame:
    return records.where(F.col("partition").isNotNull() & F.col("kind.tag").isNotNull() & F.col("cand_id").isNotNull())


def _coded(records: DataFrame, *keep: Column | str) -> DataFrame:
    """One row per record and distinct (issue, subject): block, issue, s."""
    lists = _parted(records).select(*keep, _joined(*_block()).alias("block"), normalize_issues(F.col("issue_ids")).alias("issues"), subject_names(F.col("subject_ids")).alias("subjects"))
    return lists.withColumn("issue", F.explode("issues")).withColumn("s", F.explode("subjects")).drop("issues", "subjects")


def exact_keys(records: DataFrame, *keep: str) -> DataFrame:
    """(keep..., key): one row per record and distinct (issue, subject)."""
    return _coded(records, *keep).select(*keep, _joined(F.col("block"), F.col("issue"), F.col("s.coordinate"), F.col("s.canonical")).alias("key"))


def _said() -> Column:
    return bag(F.col("title"), F.array_join(F.coalesce("subject_names", F.array().cast("array<string>")), " "), F.col("location")).alias("bag")


def package_keys(records: DataFrame, *keep: str) -> DataFrame:
    """(keep..., key): one row per record, issue and package."""
    each = _coded(records, *keep, _said()).where("bag <> ''")
    key = _joined(F.col("block"), F.col("issue"), F.col("s.coordinate"), F.col("bag"), F.lpad(F.col("cand_id").cast("string"), 20, "0"))
    return each.select(*keep, key.alias("key")).distinct()


def word_keys(records: DataFrame, *keep: str) -> DataFrame:
    """(keep..., key): one row per record."""
    each = _parted(records).select(*keep, _joined(*_block()).alias("block"), _said()).where("bag <> ''")
    return each.select(*keep, _joined(F.col("block"), F.col("bag"), F.lpad(F.col("cand_id").cast("string"), 20, "0")).alias("key"))


ENTRY = "key string, first_id long, n long, page long, range_no int"


class SortedRuns:
    """Sorted, range-cut and paged runs of one sort key, kept in a folder with a manifest."""

    def __init__(self, spark: SparkSession, folder: str, range_entries: int = 1 << 18, compact_every: int = 4):
        self.spark, self.folder = spark, folder
        self.state: dict = {"range_entries": range_entries, "compact_every": compact_every, "splits": [], "runs": [], "made": 0}
        #: Entries of touched pages the last look-up read, and all it could have read.
        self.touched = self.stored = 0

    # ---------------------------------------------------------------- the manifest

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SortedRuns:
        """The runs an earlier job left in ``folder``."""
        runs = cls(spark, folder)
        stream = runs._fs().open(runs._path("manifest.json"))
        runs.state = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return runs

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self) -> None:
        """Replace the manifest; runs it does not name are leftovers of a job that died."""
        fs, new, old = self._fs(), self._path("manifest.new"), self._path("manifest.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        fs.delete(old, False)
        fs.rename(new, old)

    def _drop(self, *names: str) -> None:
        for name in names:
            self._fs().delete(self._path(name), True)
            self._fs().delete(self._path(f"{name}-index"), True)

    # ---------------------------------------------------------------- runs

    def _range(self) -> Column:
        splits = self.state["splits"]
        if len(splits) < 2:
            return F.lit(0)

        @F.arrow_udf(T.IntegerType())
        def place(keys: pa.Array) -> pa.Array:
            return pa.array([max(bisect.bisect_right(splits, k) - 1, 0) for k in keys.to_pylist()], pa.int32())

        return place(F.col("key"))

    def _store(self, cut: DataFrame, name: str) -> None:
        # the row's place in its sorted task gives its page
        page = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / PAGE)
        paged = cut.sortWithinPartitions("range_no", "key").select("key", "first_id", "n", page.alias("page"), "range_no")
        paged.write.mode("overwrite").partitionBy("range_no").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        index = self.read(name).groupBy("range_no", "page").agg(F.min("key").alias("key"), F.count("*").alias("held"))
        index.write.mode("overwrite").parquet(f"{self.folder}/{name}-index")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{name}")

    def index(self, name: str) -> DataFrame:
        return self.spark.read.schema("range_no int, page long, key string, held long").parquet(f"{self.folder}/{name}-index")

    def _new(self) -> str:
        self.state["made"] += 1
        return f"run{self.state['made']}"

    def load(self, entries: DataFrame, count: int) -> None:
        """The first run: all of history as (key, first_id, n) entries, ``count`` of them; its ranges hold for all later runs."""
        if not count:
            return
        ranges = min(max(math.ceil(count / self.state["range_entries"]), 1), MAX_RANGES)
        name = self._new()
        cut = entries.repartitionByRange(ranges, "key").withColumn("range_no", F.spark_partition_id())
        self._store(cut, name)
        first = self.index(name).groupBy("range_no").agg(F.min("key").alias("key")).sort("range_no").collect()  # at most MAX_RANGES keys
        if [r["range_no"] for r in first] != list(range(len(first))):  # a range without entries leaves a gap
            self._drop(name)
            self.state["splits"] = [r["key"] for r in first]
            self._store(entries.withColumn("range_no", self._range()).repartition("range_no"), name := self._new())
        self.state["splits"] = [r["key"] for r in first]
        self.state["runs"] = [[name, count]]
        self.save()

    def write(self, heads: DataFrame) -> str:
        """Write a batch as a sorted, paged table; it is no run until it is added."""
        name = self._new()
        self._store(heads.withColumn("range_no", self._range()).repartition("range_no"), name)
        return name

    def around(self, name: str, beside: int = 0) -> DataFrame:
        """The entries of all pages that ``name``'s heads fall into (and ``beside`` pages next to them), with their run_no."""
        heads = self.read(name).select("range_no", "key", F.lit(None).cast("long").alias("page"), F.lit(-1).alias("run_no"))
        numbers = range(len(self.state["runs"]))
        every = heads
        for number in numbers:
            every = every.unionByName(self.index(self.state["runs"][number][0]).select("range_no", "key", "page", F.lit(number).alias("run_no")))
        before = Window.partitionBy("range_no").orderBy("key", F.desc("run_no"))  # a page that starts with the head's key comes first
        found = [F.last(F.when(F.col("run_no") == i, F.col("page")), ignorenulls=True).over(before).alias(f"p{i}") for i in numbers]
        ahead = Window.partitionBy("range_no").orderBy("key", F.desc("run_no")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        found += [F.first(F.when(F.col("run_no") == i, F.col("page")), ignorenulls=True).over(ahead).alias(f"q{i}") for i in numbers if beside]
        places = every.select("range_no", "run_no", *found).where("run_no < 0")
        pages = F.array(*[F.struct(F.lit(i).alias("run_no"), F.coalesce(f"p{i}", f"q{i}" if beside else f"p{i}").alias("page")) for i in numbers])
        touched = places.select("range_no", F.explode(pages).alias("t")).select("range_no", "t.run_no", "t.page").where("page is not null")
        if beside:
            touched = touched.select("range_no", "run_no", F.explode(F.sequence(F.col("page") - beside, F.col("page") + beside)).alias("page"))
        touched = touched.distinct()
        scratch = f"{self.folder}/{name}-touched"
        touched.write.mode("overwrite").parquet(scratch)
        touched = self.spark.read.schema("range_no int, run_no int, page long").parquet(scratch)
        small = small_or_shuffled(touched)
        ranges = None
        if len(self.state["splits"]) > 1:
            ranges = [r[0] for r in touched.select("range_no").distinct().collect()]  # at most MAX_RANGES numbers
        stored = None
        for number in numbers:
            run = self.read(self.state["runs"][number][0])
            if ranges is not None and len(ranges) < len(self.state["splits"]):
                run = run.where(F.col("range_no").isin(ranges))  # whole folders are left out
            run = run.join(small.where(F.col("run_no") == number).select("range_no", "page"), ["range_no", "page"], "left_semi")
            run = run.select("key", "first_id", "range_no", F.lit(number).alias("run_no"))
            stored = run if stored is None else stored.unionByName(run)
        return stored

    def same_key(self, name: str) -> DataFrame:
        """(key, n, accepted_id): for each head with a stored entry of its key the smallest id of those."""
        runs = len(self.state["runs"])
        if not runs:
            return self.read(name).select("key", "n", F.lit(None).cast("long").alias("accepted_id")).where("false")
        heads = self.read(name).select("key", F.lit(None).cast("long").alias("first_id"), "range_no", F.lit(runs).alias("run_no"), "n")
        merged = self.around(name).select("key", "first_id", "range_no", "run_no", F.lit(None).cast("long").alias("n")).unionByName(heads)
        order = Window.partitionBy("range_no").orderBy("key", "run_no")
        # one entry a run and key: the entries of a head's key are the ones just before it
        before = [F.lag(F.struct("key", "first_id"), i).over(order).alias(f"b{i}") for i in range(1, runs + 1)]
        ids = [F.when(F.col(f"b{i}.key") == F.col("key"), F.col(f"b{i}.first_id")) for i in range(1, runs + 1)]
        seen = merged.select("key", "n", *before).where("n is not null")
        return seen.select("key", "n", F.array_min(F.array(*ids)).alias("accepted_id")).where("accepted_id is not null")

    def windows(self, name: str, window: int = WINDOW) -> DataFrame:
        """(cand_id, near_id): the accepted entries in the window around each head."""
        runs = len(self.state["runs"])
        if not runs:
            return self.read(name).select(F.col("first_id").alias("cand_id"), F.col("first_id").alias("near_id")).where("false")
        heads = self.read(name).select("key", "first_id", "range_no", F.lit(runs).alias("run_no"))
        merged = self.around(name, 1).unionByName(heads)
        accepted = F.when(F.col("run_no") < runs, F.col("first_id"))
        order = Window.partitionBy("range_no").orderBy("key")
        # other heads of the batch take places in the window too, so it is twice as wide
        beside = [F.lag(accepted, i).over(order) for i in range(1, 2 * window + 1)] + [F.lead(accepted, i).over(order) for i in range(1, 2 * window + 1)]
        seen = merged.select(F.col("first_id").alias("cand_id"), "run_no", F.array(*beside).alias("w")).where(F.col("run_no") == runs)
        return seen.select("cand_id", F.explode(F.array_compact("w")).alias("near_id")).where("cand_id <> near_id")

    def add(self, name: str, most: int) -> None:
        """Make a written table of at most ``most`` entries a run, and compact when there are many."""
        if not self.state["splits"]:
            self.state["splits"] = [""]
        self.state["runs"].append([name, most])
        late = self.state["runs"][1:]
        old = []
        if len(late) >= self.state["compact_every"]:
            whole = sum(n for _, n in late) * 2 >= self.state["runs"][0][1]
            old = self.state["runs"] if whole else late
            merged = None
            for run, _ in old:
                part = self.read(run).select("key", "first_id", "n", "range_no")
                merged = part if merged is None else merged.unionByName(part)
            smallest = merged.groupBy("range_no", "key").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
            self._store(smallest.repartition("range_no"), made := self._new())
            self.state["runs"] = ([] if whole else self.state["runs"][:1]) + [[made, sum(n for _, n in old)]]
        self.save()
        self._drop(*[run for run, _ in old])
        self._fs().delete(self._path(f"{name}-touched"), True)


def _history(runs: SortedRuns, keys: DataFrame, scratch: Scratch) -> None:
    entries = keys.groupBy("key").agg(F.min("cand_id").alias("first_id"))
    entries = scratch.write(entries.select("key", "first_id", F.lit(1).cast("long").alias("n")), "history")
    runs.load(entries, entries.count())
    scratch.drop("history")


def add_batch(runs: SortedRuns, rows: DataFrame, count: int, scratch: Scratch, label: str) -> DataFrame:
    """(cand_id, accepted_id) of the batch rows (cand_id, key) that repeat an accepted one; the batch then is history."""
    heads = rows.groupBy("key").agg(F.min("cand_id").alias("first_id"), F.count("*").alias("n"))
    name = runs.write(heads)
    hits = scratch.write(runs.same_key(name), f"hits{label}")
    matched = attach(rows, ["key"], hits, max(count // 2000, 1000)).groupBy("cand_id").agg(F.min("accepted_id").alias("accepted_id"))
    matched = scratch.write(matched, f"matched{label}")  # a small table each; no plan spans the batches
    runs.add(name, count)
    scratch.drop(f"hits{label}")
    return matched


def add_near_batch(runs: SortedRuns, rows: DataFrame, count: int, scratch: Scratch, label: str) -> DataFrame:
    """(cand_id, near_id): the accepted records in the windows around the batch rows (cand_id, key), yet to be verified; the batch then is history."""
    name = runs.write(rows.select("key", F.col("cand_id").alias("first_id"), F.lit(1).cast("long").alias("n")))
    near = scratch.write(runs.windows(name).distinct(), f"near{label}")
    runs.add(name, count)
    return near


def _batches(incoming: DataFrame) -> DataFrame:
    return incoming.withColumn("batch_no", F.coalesce(F.col("batch_no"), F.lit(2**31 - 1)))


def repeated(history: DataFrame, incoming: DataFrame, *, range_entries: int = 1 << 18, compact_every: int = 4, folder: str | None = None) -> DataFrame:
    """(cand_id, accepted_id) of the incoming rows that repeat an accepted one, batch after batch.

    With ``folder`` the runs stay there for :meth:`SortedRuns.open` and :func:`add_batch`.
    """
    spark = history.sparkSession
    scratch = Scratch(spark, "incremental")
    runs = SortedRuns(spark, folder or scratch.path("exact"), range_entries, compact_every)
    _history(runs, exact_keys(history, "cand_id"), scratch)
    arrived = scratch.write(exact_keys(_batches(incoming), "cand_id", "batch_no"), "arrived")
    per_batch = {r[0]: r[1] for r in arrived.groupBy("batch_no").count().collect()}  # one row per batch
    found = None
    for batch in sorted(per_batch):
        rows = arrived.where(F.col("batch_no") == batch).select("cand_id", "key")
        matched = add_batch(runs, rows, per_batch[batch], scratch, str(batch))
        found = matched if found is None else found.unionByName(matched)
    if folder is None:
        scratch.drop("exact")
    scratch.drop("arrived")
    return spark.createDataFrame([], "cand_id long, accepted_id long") if found is None else found


def nearly_repeated(history: DataFrame, incoming: DataFrame, *, threshold: float = 0.8, range_entries: int = 1 << 15, compact_every: int = 4) -> DataFrame:
    """(cand_id, near_id): the smallest accepted neighbour that agrees in more than ``threshold`` of the words, batch after batch.

    A batch's windows give pairs of ids; the words of all pairs are compared at the end, at once.
    """
    spark = history.sparkSession
    scratch = Scratch(spark, "incremental")
    found = None
    for kind, keys in (("package", package_keys), ("words", word_keys)):
        runs = SortedRuns(spark, scratch.path(kind), range_entries, compact_every)
        _history(runs, keys(history, "cand_id"), scratch)
        arrived = scratch.write(keys(_batches(incoming), "cand_id", "batch_no"), f"arrived-{kind}")
        per_batch = {r[0]: r[1] for r in arrived.groupBy("batch_no").count().collect()}  # one row per batch
        for batch in sorted(per_batch):
            rows = arrived.where(F.col("batch_no") == batch).select("cand_id", "key")
            near = add_near_batch(runs, rows, per_batch[batch], scratch, f"{kind}{batch}")
            found = near if found is None else found.unionByName(near)
        scratch.drop(kind, f"arrived-{kind}")
    if found is None:
        return spark.createDataFrame([], "cand_id long, near_id long")
    pairs = scratch.write(found.distinct(), "pairs")
    said = _parted(history).select("cand_id", _said()).unionByName(_parted(incoming).select("cand_id", _said()))
    said = scratch.write(said.dropDuplicates(["cand_id"]), "said")
    both = pairs.join(said, "cand_id").join(said.select(F.col("cand_id").alias("near_id"), F.col("bag").alias("near_bag")), "near_id")
    return both.where(_verifier(threshold)("bag", "near_bag")).groupBy("cand_id").agg(F.min("near_id").alias("near_id"))
