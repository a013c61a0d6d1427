"""Problem 1: how often every term occurs and in how many records, by suffix arrays.

Records are cut into blocks by hash of (record, leading symbol), so that all occurrences in a record of
any n-gram lie in one block while neither a hot record nor a hot symbol fills one. In a block the
suffixes (cut after ``max_n`` symbols) are sorted; adjacent suffixes that share n symbols form the
common-prefix interval of an n-gram. Its size is the block's occurrence count, and that size less the
adjacencies within one record (equal suffixes are ordered by record) is the block's record count. Both
add up over blocks, so one aggregation by n-gram, combined before its shuffle, ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.session import settings, ship, spread, table

#: Rows that a block's suffix array holds at most; a longer partition is worked off in several blocks
#: that still begin at record boundaries.
BLOCK_ROWS = 200_000


def suffix_intervals(symbols: np.ndarray, record: np.ndarray, weight: np.ndarray, depths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Intervals of a suffix array: for each depth n yields n, the row of ``symbols`` that stands for each
    interval, the occurrence counts and the record counts.

    ``symbols`` has a suffix in each row, cut or padded (with -1) to the greatest depth; a row is repeated
    ``weight`` times in its record."""
    if not len(symbols):
        return
    width = symbols.shape[1]
    order = np.lexsort([record, *(symbols[:, k] for k in range(width - 1, -1, -1))])
    s, r, w = symbols[order], record[order], weight[order]
    differs = s[1:] != s[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)  # common prefix with the suffix before
    for n in depths:
        starts = np.concatenate([[True], shared < n])
        whole = s[:, n - 1] >= 0
        if not whole.any():
            continue
        interval = np.cumsum(starts) - 1
        count = interval[-1] + 1
        occurrences = np.bincount(interval, weights=w, minlength=count).astype(np.int64)
        size = np.bincount(interval, minlength=count)
        # duplicate adjacencies: neighbours of one record, once the interval is ordered by record
        if n == width:
            same = ~starts[1:] & (r[1:] == r[:-1])
            doubled = np.bincount(interval[1:][same], minlength=count)
        else:
            by = np.lexsort([r, interval])
            i, rr = interval[by], r[by]
            same = (i[1:] == i[:-1]) & (rr[1:] == rr[:-1])
            doubled = np.bincount(i[1:][same], minlength=count)
        first = np.flatnonzero(starts)
        keep = whole[first]
        yield n, order[first[keep]], occurrences[keep], (size - doubled)[keep]


def gathered(frames: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Join batches into blocks of about ``BLOCK_ROWS`` rows; rows that are alike in ``group`` (and follow
    each other) stay in one block.

    While one group fills a block, twice as many rows are awaited before it is looked at again, so the
    batches of a large group are copied a constant number of times."""
    held: list[pd.DataFrame] = []
    size, wanted = 0, BLOCK_ROWS
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size < wanted:
            continue
        block = pd.concat(held, ignore_index=True)
        last = block.iloc[-1]
        alike = np.logical_and.reduce([(block[c] == last[c]).to_numpy() for c in group])
        cut = size - int(alike[::-1].argmin() if not alike.all() else size)
        if cut:
            yield block.iloc[:cut].reset_index(drop=True)
        held = [block.iloc[cut:]] if cut < size else []
        size -= cut
        wanted = max(BLOCK_ROWS, 2 * size)
    if size:
        yield pd.concat(held, ignore_index=True)


#: A record's occurrences of one phrase come in so many counted parts at most, however many they are.
PARTS = 8


def whole_phrase_counts(mentions: DataFrame) -> DataFrame:
    """``language, folded, occurrence_count, document_frequency`` of every stored phrase.

    A phrase is one symbol, and a mention of it a suffix of its document that begins and ends with it. A
    document's mentions of a phrase stay apart (in up to ``PARTS`` parts with their counts, so that one
    phrase of one document can't fill a block); they are neighbours in the suffix array, and the
    interval's size less these adjacencies is the number of documents. ``mentions`` needs ``mention_id, doc_id, language, folded``. A mention
    counts once however often its row is repeated; a null mention_id is a mention of its own kind per document and
    phrase. Null languages or phrases are values of their own; a null doc_id adds occurrences but no
    document. Ids of any type and size are compared as they are. An empty table gives no rows; extra columns are
    ignored."""
    ship(mentions.sparkSession)
    kind = dict(mentions.dtypes)["doc_id"]
    known = F.col("doc_id").isNotNull()
    # pandas has no null integers: unknown documents are a flag, and their id some fixed value
    document = F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id")
    part = F.coalesce(F.pmod(F.xxhash64("mention_id"), F.lit(PARTS)), F.lit(0)).cast("int").alias("part")
    once = mentions.select("language", "folded", document, known.alias("known"), part, "mention_id").distinct()
    counted = once.groupBy("language", "folded", "doc_id", "known", "part").agg(F.count("*").cast("int").alias("n"))
    group = ["key", "known", "doc_id"]
    # the hash only keeps equal rows together; phrases are compared as they are
    rows = counted.withColumn("key", F.xxhash64("language", "folded")).drop("part").repartition(*group).sortWithinPartitions(*group)

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(frames, group):
            for of_known in (True, False):
                yield from count_block(frame[frame["known"] == of_known], of_known)

    def count_block(frame: pd.DataFrame, of_known: bool) -> Iterator[pd.DataFrame]:
        if frame.empty:
            return
        language = frame["language"].to_numpy(dtype=object)
        folded = frame["folded"].to_numpy(dtype=object)
        keys = pd.MultiIndex.from_arrays([pd.factorize(language, use_na_sentinel=False)[0], pd.factorize(folded, use_na_sentinel=False)[0]])
        symbol = pd.factorize(keys)[0].astype(np.int64)
        record = pd.factorize(frame["doc_id"])[0]
        for _, at, occurrences, records in suffix_intervals(symbol[:, None], record, frame["n"].to_numpy(), range(1, 2)):
            yield pd.DataFrame({"language": language[at], "folded": folded[at], "o": occurrences, "d": records if of_known else 0 * records})

    partial = rows.mapInPandas(blocks, "language string, folded string, o long, d long")
    return partial.groupBy("language", "folded").agg(F.sum("o").alias("occurrence_count"), F.sum("d").alias("document_frequency"))


def ngram_counts(records: DataFrame, id_column: str, tokens_column: str, max_n: int) -> DataFrame:
    """``ngram (array<string>), n, occurrence_count, document_frequency`` of all n-grams of 1..max_n tokens.

    ``tokens_column`` is array<string>; n-grams don't cross rows, and rows with the same id (cast to bigint) are one
    record. Null or empty arrays and null ids give no n-grams; null tokens end an n-gram."""
    ship(records.sparkSession)
    suffixes = (
        records.where(F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("record"), F.col(tokens_column).alias("t"))
        .where(F.size("t") > 0)
        .select("record", F.explode(F.expr(f"transform(sequence(1, size(t)), at -> slice(t, at, {max_n}))")).alias("suffix"))
        .select("record", F.col("suffix")[0].alias("lead"), "suffix")
        .where("lead is not null")
    )
    # equal suffixes of a record are joined before the shuffle; hot records and hot symbols are both split
    rows = suffixes.groupBy("record", "lead", "suffix").agg(F.count("*").alias("n"))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(frames, ["record", "lead"]):
            yield from count_block(frame)

    def count_block(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if frame.empty:
            return
        lists = [list(x) for x in frame["suffix"]]
        for x in lists:
            if None in x:
                del x[x.index(None) :]
        flat, _ = pd.factorize(np.array([t for x in lists for t in x], dtype=object))
        symbols = np.full((len(lists), max_n), -1, dtype=np.int64)
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        rows_of = np.repeat(np.arange(len(lists)), lengths)
        column = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        symbols[rows_of, column] = flat
        for n, at, occurrences, found in suffix_intervals(symbols, frame["record"].to_numpy(), frame["n"].to_numpy(), range(1, max_n + 1)):
            yield pd.DataFrame({"ngram": [lists[i][:n] for i in at], "n": np.int32(n), "o": occurrences, "d": found})

    blocked = rows.repartition("record", "lead").sortWithinPartitions("record", "lead")
    partial = blocked.mapInPandas(blocks, "ngram array<string>, n int, o long, d long")
    return partial.groupBy("ngram", "n").agg(F.sum("o").alias("occurrence_count"), F.sum("d").alias("document_frequency"))


def mark_terms(counts: DataFrame, documents: int, min_document_frequency: int, max_document_permille: int) -> DataFrame:
    """Add ``mark``: 'rare' below the least document frequency, else 'common' if the document frequency
    times 1000 exceeds ``max_document_permille`` times the number of documents, else null."""
    return counts.withColumn(
        "mark",
        F.when(F.col("document_frequency") < min_document_frequency, "rare").when(
            F.col("document_frequency") * 1000 > F.lit(max_document_permille * documents), "common"
        ),
    )


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases of the mentions with both counts and their mark."""
    limits = settings(table(spark, sf_dir, "analysis_limits"))
    counts = whole_phrase_counts(table(spark, sf_dir, "mentions"))
    return mark_terms(counts, table(spark, sf_dir, "documents").count(), limits["min_document_frequency"], limits["max_document_permille"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("language", "folded", "mark")


#: Where n-grams of notes end: at blank lines and before list items; other line breaks are blanks.
STRETCH = r"\n(?:[ \t]*\n)+|\n(?=[ \t]*(?:[-*•]|\p{N}+[.)])[ \t])"


def p1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams of the notes, in lower case, within a paragraph or list item, with both counts and their mark."""
    limits = settings(table(spark, sf_dir, "analysis_limits"))
    documents = table(spark, sf_dir, "documents")
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    stretches = spread(documents.select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.split(text, STRETCH)).alias("stretch"))
    tokens = stretches.select("doc_id", F.regexp_extract_all(F.lower(F.translate("stretch", "Σ", "σ")), F.lit(r"[\p{L}\p{N}]+(?:[./+\-][\p{L}\p{N}]+)*\+?"), F.lit(0)).alias("tokens"))
    counts = ngram_counts(tokens, "doc_id", "tokens", limits["max_ngram_tokens"])
    marked = mark_terms(counts, documents.count(), limits["min_document_frequency"], limits["max_document_permille"])
    return marked.select(F.concat_ws(" ", "ngram").alias("term"), "n", "occurrence_count", "document_frequency", "mark")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p1_ngrams": p1_ngrams}

ORACLE = {
    "p1_terms": """
        with c as (select language, folded, count(distinct mention_id) as occurrence_count, count(distinct doc_id) as document_frequency
                   from mentions group by language, folded),
             l as (select max(amount) filter (setting = 'min_document_frequency') as lo, max(amount) filter (setting = 'max_document_permille') as hi from analysis_limits),
             n as (select count(*) as docs from documents)
        select language, folded, occurrence_count, document_frequency,
               case when document_frequency < lo then 'rare' when document_frequency * 1000 > hi * docs then 'common' end as mark
        from c, l, n""",
    "p1_ngrams": """
        with flat as (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents),
             lines as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\n(?:[ \\t]*\\n)+', chr(2), 'g'), '\\n([ \\t]*(?:[-*•]|\\p{N}+[.)])[ \\t])', chr(2) || '\\1', 'g'), chr(2))) as line from flat),
             toks as (select doc_id, regexp_extract_all(lower(replace(line, 'Σ', 'σ')), '[\\p{L}\\p{N}]+(?:[./+\\-][\\p{L}\\p{N}]+)*\\+?') as t from lines),
             grams as (select doc_id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) as term
                       from toks, range(1, 1 + (select max(amount) from analysis_limits where setting = 'max_ngram_tokens')) r(n) where len(t) >= n),
             c as (select term, n, count(*) as occurrence_count, count(distinct doc_id) as document_frequency from grams group by term, n),
             l as (select max(amount) filter (setting = 'min_document_frequency') as lo, max(amount) filter (setting = 'max_document_permille') as hi from analysis_limits),
             d as (select count(*) as docs from documents)
        select term, n::int as n, occurrence_count, document_frequency,
               case when document_frequency < lo then 'rare' when document_frequency * 1000 > hi * docs then 'common' end as mark
        from c, l, d""",
}
ORACLE["p1_found"] = f"select language, folded, mark from ({ORACLE['p1_terms']}) where mark is not null"
