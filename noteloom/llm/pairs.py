"""Problem 3: items that occur together, as an incremental pair table.

The state is three Parquet tables cut into hash buckets, each bucket a folder of its own: the baskets
(record, item), the records of each item (marginals) and the records of each pair. New or withdrawn rows change some
baskets. A changed basket emits signed deltas, of those pairs alone that it gains or loses, and of those
items. Deltas are summed before and after their shuffle and merged into the buckets that they fall into; a
new version of the state shares all other buckets with the old one. Scores are stored too: only the
pairs whose count, or whose items' counts, changed are scored again.

A basket of more than ``max_items`` items adds no pairs but counts for its items: sizes are counted first, and the
items of longer ones never meet. :func:`skipped_baskets` lists those. Without ``max_items`` long baskets are cut into
blocks of items and pairs of blocks are joined, so no task holds a whole one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.session import folders_in, remove_folder, settings, shared_folder, table, written

#: Hash buckets of a new state.
BUCKETS = 16
#: Items of a block, where a basket has more and is to be paired whole.
BLOCK_ITEMS = 128
#: A long basket's rows are dropped in so many parts, so that none is shuffled into one task.
SALTS = 16


@dataclass(frozen=True)
class PairState:
    """One version of the pair table: the folder of each bucket ('' for an empty one) of three tables, and the folder
    of the deltas that made it. ``PairState()`` is the empty table."""

    baskets: tuple[str, ...] = ("",) * BUCKETS
    marginals: tuple[str, ...] = ("",) * BUCKETS
    pairs: tuple[str, ...] = ("",) * BUCKETS
    deltas: str = ""

    @staticmethod
    def empty(buckets: int = BUCKETS) -> PairState:
        return PairState(*[("",) * buckets] * 3)

    def folders(self) -> set[str]:
        return {f for f in (*self.baskets, *self.marginals, *self.pairs, self.deltas) if f}


MARKED = "record bigint, item string, was boolean, now boolean"
MARGINALS = "item string, records bigint"
PAIRS = "item_a string, item_b string, shared bigint"


def _read(spark: SparkSession, folders: tuple[str, ...], schema: str) -> DataFrame:
    filled = [f for f in folders if f]
    return spark.read.schema(schema).parquet(*filled) if filled else spark.createDataFrame([], schema)


def _bucket(buckets: int, *columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> dict[int, str]:
    """Write by bucket and return the folder of each bucket that has rows; the rebalance hint joins small pieces of
    a bucket and splits large ones."""
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return {int(f.rsplit("=", 1)[1]): f for f in folders_in(rows.sparkSession, path, "bucket=*")}


def _touched(rows: DataFrame) -> list[int]:
    """The buckets that rows fall into: at most as many numbers as the state has buckets."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def _merged(old: tuple[str, ...], touched: list[int], written_buckets: dict[int, str]) -> tuple[str, ...]:
    return tuple(written_buckets.get(b, "") if b in touched else f for b, f in enumerate(old))


def _pairs_of(lists: DataFrame) -> DataFrame:
    """``item_a, item_b, delta`` of baskets (``items``: ordered structs of item, was, now; ``old``, ``new``: whether
    the basket had and has pairs)."""
    had = lambda s: F.col("old") & F.col(f"{s}.was")
    has = lambda s: F.col("new") & F.col(f"{s}.now")
    pairs = lists.select("old", "new", F.posexplode("items").alias("at", "a"), "items").select("old", "new", "a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("b"))
    delta = (has("a") & has("b")).cast("long") - (had("a") & had("b")).cast("long")
    return pairs.select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"), delta.alias("delta")).where("delta <> 0")


def _pairs_of_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same for baskets of any length: blocks of items, joined two by two. ``sizes``: ``record, items, old, new``."""
    cut = rows.join(sizes.select("record", F.ceil(F.col("items") / BLOCK_ITEMS).cast("int").alias("blocks"), "old", "new"), "record")
    numbered = cut.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    lists = numbered.groupBy("record", "block", "blocks", "old", "new").agg(F.collect_list(F.struct("item", "was", "now")).alias("items"))
    left = lists.select("record", "old", "new", F.col("block").alias("first"), "items", F.explode(F.expr("sequence(block, blocks - 1)")).alias("block"))
    met = left.join(lists.select("record", "block", F.col("items").alias("others")), ["record", "block"])
    both = met.select("old", "new", (F.col("first") == F.col("block")).alias("same"), F.explode("items").alias("x"), "others").select("old", "new", "same", "x", F.explode("others").alias("y"))
    both = both.where((~F.col("same") & (F.col("x.item") != F.col("y.item"))) | (F.col("x.item") < F.col("y.item")))
    delta = (F.col("new") & F.col("x.now") & F.col("y.now")).cast("long") - (F.col("old") & F.col("x.was") & F.col("y.was")).cast("long")
    return both.select(F.least("x.item", "y.item").alias("item_a"), F.greatest("x.item", "y.item").alias("item_b"), delta.alias("delta")).where("delta <> 0")


def pair_deltas(marked: DataFrame, max_items: int | None) -> DataFrame:
    """``item_a, item_b, delta``, not summed, of the changed baskets among ``marked`` (distinct ``record, item`` with
    ``was`` and ``now``). A basket has pairs while it has 2..max_items items."""
    counted = marked.groupBy("record").agg(F.count("*").alias("items"), F.count_if("was").alias("o"), F.count_if("now").alias("n"), F.max(F.col("was") != F.col("now")).alias("changed"))
    most = F.lit(max_items) if max_items is not None else F.lit(2**62)
    sizes = counted.where("changed").select("record", "items", F.col("o").between(2, most).alias("old"), F.col("n").between(2, most).alias("new")).where("old or new")
    if max_items is None:
        whole = sizes.where(F.col("items") > BLOCK_ITEMS)
        blocks = _pairs_of_blocks(marked.join(whole.select("record"), "record", "left_semi"), whole)
        few = marked.join(sizes.where(F.col("items") <= BLOCK_ITEMS), "record")
    else:
        # items of a basket too long before and after are dropped in parts, then the rest is at most 2 * max_items
        salt = lambda: F.pmod(F.xxhash64("item"), F.lit(SALTS))
        long = counted.where((F.col("o") > max_items) & (F.col("n") > max_items) | (F.greatest("o", "n") > max_items) & (F.least("o", "n") < 2))
        parts = long.select("record", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        short = marked.withColumn("salt", salt()).join(parts, ["record", "salt"], "left_anti").drop("salt")
        few = short.join(sizes, "record").where((F.col("old") & F.col("was")) | (F.col("new") & F.col("now")))
        blocks = None
    lists = few.groupBy("record", "old", "new").agg(F.sort_array(F.collect_list(F.struct("item", "was", "now"))).alias("items"))
    return _pairs_of(lists) if blocks is None else _pairs_of(lists).unionByName(blocks)


def apply_rows(spark: SparkSession, state: PairState, rows: DataFrame, max_items: int | None, withdrawn: DataFrame | None = None) -> PairState:
    """A new version of the state with ``rows`` (``record, item``) added and those of ``withdrawn`` taken out.

    Null records and null items are ignored; repeated rows, rows that the state has and withdrawn rows that it
    hasn't change nothing; a row both added and withdrawn is out; an empty ``rows`` gives the same tables again.
    The old version stays as it was, so a run that fails half-way can be repeated; :func:`forget` removes what the new
    one doesn't share. ``max_items`` must be the same for all versions."""
    buckets = len(state.baskets)
    folder = shared_folder(spark)
    asked = rows.select(F.col("record").cast("long").alias("record"), "item", F.lit(True).alias("add"))
    if withdrawn is not None:
        asked = asked.unionByName(withdrawn.select(F.col("record").cast("long").alias("record"), "item", F.lit(False).alias("add")))
    asked = asked.where("record is not null and item is not null").groupBy("record", "item").agg(F.min("add").alias("add")).withColumn("bucket", _bucket(buckets, "record"))
    asked = written(spark, asked)
    touched = _touched(asked)
    old = _read(spark, tuple(state.baskets[b] for b in touched), MARKED).where("now").select("record", "item", F.lit(True).alias("was"), F.lit(None).cast("boolean").alias("add"))
    both = old.unionByName(asked.select("record", "item", F.lit(False).alias("was"), "add")).groupBy("record", "item").agg(F.max("was").alias("was"), F.max("add").alias("add"))
    marked = both.select("record", "item", "was", F.coalesce("add", "was").alias("now"), _bucket(buckets, "record").alias("bucket")).where("was or now")
    baskets = _write(marked, f"{folder}/baskets")
    marked = _read(spark, tuple(baskets.values()), MARKED)
    deltas = pair_deltas(marked, max_items).groupBy("item_a", "item_b").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    gained = F.col("now").cast("long") - F.col("was").cast("long")
    items = marked.where("was <> now").groupBy("item").agg(F.sum(gained).alias("delta")).where("delta <> 0")
    done = {}
    for name, df, keys, count, schema in (("pairs", deltas, ["item_a", "item_b"], "shared", PAIRS), ("marginals", items, ["item"], "records", MARGINALS)):
        fell = _write(df.withColumn("bucket", _bucket(buckets, *keys)), f"{folder}/deltas/{name}")
        before = getattr(state, name)
        was = _read(spark, tuple(before[b] for b in fell), schema).select(*keys, F.col(count).alias("delta"))
        sums = was.unionByName(_read(spark, tuple(fell.values()), ", ".join(f"{k} string" for k in keys) + ", delta bigint")).groupBy(*keys).agg(F.sum("delta").alias(count)).where(F.col(count) != 0)
        done[name] = _merged(before, sorted(fell), _write(sums.withColumn("bucket", _bucket(buckets, *keys)), f"{folder}/{name}"))
    return PairState(_merged(state.baskets, touched, baskets), done["marginals"], done["pairs"], f"{folder}/deltas")


def forget(spark: SparkSession, old: PairState, new: PairState | None = None) -> None:
    """Remove an old version but for the buckets that ``new`` shares with it."""
    for folder in sorted(old.folders() - (new.folders() if new else set())):
        remove_folder(spark, folder)


def skipped_baskets(spark: SparkSession, state: PairState, max_items: int) -> DataFrame:
    """``record, items`` of the baskets that add no pairs because they have more than ``max_items`` items."""
    return _read(spark, state.baskets, MARKED).where("now").groupBy("record").agg(F.count("*").alias("items")).where(F.col("items") > max_items)


def associations(spark: SparkSession, state: PairState, records: int, min_shared: int, affected_only: bool = False) -> DataFrame:
    """``item_a, item_b, shared, records_a, records_b, npmi`` of the pairs with at least ``min_shared``
    records, of ``records`` in all; npmi is 1 where a pair is in every record.

    With ``affected_only`` only pairs are scored whose own count or an item's count was changed by the rows that
    made this version (enough while the number of records is the same)."""
    marginals = _read(spark, state.marginals, MARGINALS).select("item", F.col("records").alias("n"))
    pairs = _read(spark, state.pairs, PAIRS).where(F.col("shared") >= min_shared)
    if affected_only:
        affected = affected_pairs(spark, state)
        pairs = reduce(DataFrame.unionByName, [pairs.join(a, list(a.columns), "left_semi") for a in affected]).distinct()
    n = F.lit(float(records))
    p_ab, p_a, p_b = F.col("shared") / n, F.col("records_a") / n, F.col("records_b") / n
    return (
        pairs.join(marginals.select(F.col("item").alias("item_a"), F.col("n").alias("records_a")), "item_a")
        .join(marginals.select(F.col("item").alias("item_b"), F.col("n").alias("records_b")), "item_b")
        .withColumn("npmi", F.when(p_ab >= 1, 1.0).otherwise(F.log(p_ab / (p_a * p_b)) / -F.log(p_ab)))
        .select("item_a", "item_b", "shared", "records_a", "records_b", "npmi")
    )


def affected_pairs(spark: SparkSession, state: PairState) -> list[DataFrame]:
    """What the rows that made this version changed: pairs, and items as either side of a pair."""
    read = lambda name, *keys: spark.read.schema(", ".join(f"{k} string" for k in keys)).parquet(f"{state.deltas}/{name}").select(*keys)
    items = read("marginals", "item").distinct()
    return [read("pairs", "item_a", "item_b"), items.withColumnRenamed("item", "item_a"), items.withColumnRenamed("item", "item_b")]


def rescored(spark: SparkSession, scores: DataFrame, state: PairState, records: int, min_shared: int) -> DataFrame:
    """The scores of a new version from those of the version before it: affected pairs are scored again (and go if
    they are too few now), all others stay."""
    names = scores.columns
    for changed in affected_pairs(spark, state):
        scores = scores.join(changed, list(changed.columns), "left_anti").select(*names)
    return scores.unionByName(associations(spark, state, records, min_shared, affected_only=True))


def coding_state(spark: SparkSession, sf_dir: str) -> tuple[PairState, DataFrame, dict[str, int]]:
    """The pair table of the codes, its scores and the limits, from an earlier run's state and the rows that came later.

    The earlier run has the rows recorded up to the 90th percentile of the recording times (rows without
    a time belong to it); the later rows come as changes. The result is the same for any such cut."""
    limits = settings(table(spark, sf_dir, "analysis_limits"))
    rows = table(spark, sf_dir, "coding_documents").select(F.col("doc_id").alias("record"), F.col("code").alias("item"), "recorded_at")
    cut = rows.agg(F.percentile_approx("recorded_at", 0.9)).first()[0]
    later = F.col("recorded_at") > F.lit(cut) if cut is not None else F.lit(False)
    largest, least, records = limits["max_association_codes_per_document"], limits["min_cell_document_count"], table(spark, sf_dir, "documents").count()
    earlier = apply_rows(spark, PairState(), rows.where(~F.coalesce(later, F.lit(False))), largest)
    scores = written(spark, associations(spark, earlier, records, least))
    state = apply_rows(spark, earlier, rows.where(later), largest)
    forget(spark, earlier, state)
    return state, rescored(spark, scores, state, records, least), limits


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_state(spark, sf_dir)[1].select(
        F.col("item_a").alias("code_a"), F.col("item_b").alias("code_b"), F.col("shared").alias("shared_documents"),
        F.col("records_a").alias("documents_a"), F.col("records_b").alias("documents_b"), F.round("npmi", 6).alias("npmi"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores, limits = coding_state(spark, sf_dir)
    strong = F.col("npmi") >= F.lit(limits["association_npmi_permille"] / 1000)
    return scores.where(strong).select(F.col("item_a").alias("code_a"), F.col("item_b").alias("code_b"))


def p3_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that add no pairs because they have too many codes."""
    state, _, limits = coding_state(spark, sf_dir)
    return skipped_baskets(spark, state, limits["max_association_codes_per_document"]).withColumnsRenamed({"record": "doc_id", "items": "codes"})


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p3_skipped": p3_skipped}

_PAIRS = """
    with l as (select max(amount) filter (setting = 'max_association_codes_per_document') as most, max(amount) filter (setting = 'min_cell_document_count') as least,
                      max(amount) filter (setting = 'association_npmi_permille') as permille from analysis_limits),
         r as (select distinct doc_id, code from coding_documents where code is not null and doc_id is not null),
         m as (select code, count(*) as n from r group by code),
         ok as (select doc_id from r group by doc_id having count(*) <= (select most from l)),
         p as (select a.code as code_a, b.code as code_b, count(*) as s from r a join r b on a.doc_id = b.doc_id and a.code < b.code
               where a.doc_id in (select doc_id from ok) group by all having count(*) >= (select least from l)),
         d as (select count(*)::double as n from documents),
         x as (select p.*, ma.n as na, mb.n as nb, case when s >= d.n then 1 else ln((s / d.n) / ((ma.n / d.n) * (mb.n / d.n))) / -ln(s / d.n) end as npmi
               from p join m ma on ma.code = code_a join m mb on mb.code = code_b, d)"""
ORACLE = {
    "p3_found": _PAIRS + " select code_a, code_b from x, l where npmi >= permille / 1000.0",
    "p3_skipped": _PAIRS + " select doc_id, count(*) as codes from r group by doc_id having count(*) > (select most from l)",
    "p3_pairs": _PAIRS + " select code_a, code_b, s as shared_documents, na as documents_a, nb as documents_b, round(npmi, 6) as npmi from x",
}
