"""Sentences, tokens, n-gram mentions and phrase aggregates of a corpus, as expressions over documents.

Documents are rows of ``doc_id, language, note_type, text`` (see :func:`corpus`). The only shuffles are the
aggregations; every mention is made and counted in the stage that reads its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import CANARIES, SENTENCE_BOUNDARY, TOKEN, WORD_EDGE, six_places, with_forms
from noteloom.session import spread


def corpus(documents: DataFrame) -> DataFrame:
    """``doc_id, language, note_type, text`` of a documents table; unknown languages are 'und', unknown note
    types 'unknown', null texts empty."""
    return documents.select(
        "doc_id", F.coalesce("lang", F.lit("und")).alias("language"), F.coalesce("note_type", F.lit("unknown")).alias("note_type"), F.coalesce("text", F.lit("")).alias("text")
    )


def sentences(documents: DataFrame) -> DataFrame:
    """One row for each non-empty stretch between boundaries, numbered from 0 in the order of the text."""
    parts = F.filter(F.split("text", SENTENCE_BOUNDARY, -1), lambda s: s != "")
    return documents.select("doc_id", "language", "note_type", F.posexplode(parts).alias("sentence_number", "sentence"))


def tokens(documents: DataFrame) -> DataFrame:
    """One row for each sentence with its tokens and the gaps around them (one more than tokens)."""
    return sentences(documents).select(
        "doc_id", "language", "note_type", "sentence_number", F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)).alias("tokens"), F.split("sentence", TOKEN, -1).alias("gaps")
    )


def mentions(documents: DataFrame, shortest: int = 1, longest: int = 4) -> DataFrame:
    """``doc_id, language, note_type, surface, token_count`` of every n-gram; the surface keeps what stands
    between its tokens."""
    made = f"""flatten(transform(sequence({shortest}, least({longest}, size(tokens))), n -> transform(sequence(0, size(tokens) - n),
        i -> struct(array_join(flatten(transform(sequence(0, n - 1), j -> array(tokens[i + j], if(j < n - 1, gaps[i + j + 1], '')))), '') as surface, n as token_count))))"""
    rows = tokens(spread(documents, "doc_id")).where(F.size("tokens") >= shortest)
    return rows.select("doc_id", "language", "note_type", F.explode(F.expr(made)).alias("m")).select("doc_id", "language", "note_type", "m.surface", "m.token_count")


def counted_mentions(documents: DataFrame, shortest: int = 1, longest: int = 4) -> DataFrame:
    """Mentions with ``primary`` and ``folded``, counted (``n``) by document and surface before anything
    else is done with them."""
    counted = mentions(documents, shortest, longest).groupBy("doc_id", "language", "note_type", "surface", "token_count").agg(F.count("*").alias("n"))
    # a surface begins with a token, so its primary form is never empty; it is checked before the forms are made
    return with_forms(counted.where("surface <> ''"), "surface")


def phrase_aggregates(counted: DataFrame, documents: int, min_document_frequency: int = 1) -> DataFrame:
    """Aggregates of each ``language, primary, token_count`` in at least so many documents: occurrences,
    documents, the most frequent surface (of equals the least), occurrences by note type, and the greatest
    sublinear tf-idf over documents as text with six decimals."""
    key = ["language", "primary", "token_count"]
    by_document = counted.groupBy(*key, "doc_id").agg(F.sum("n").alias("n"), F.max("folded").alias("folded"))
    totals = (
        by_document.groupBy(*key)
        .agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("document_frequency"), F.max("n").alias("most"), F.max("folded").alias("folded"))
        .where(F.col("document_frequency") >= min_document_frequency)
    )
    # surfaces and note types are only looked at for phrases that stay, from one exchange
    cells = counted.join(totals.select(*key), key, "left_semi").groupBy(*key, "surface", "note_type").agg(F.sum("n").alias("n"))
    note_types = cells.groupBy(*key, "note_type").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("note_type", "n")))).alias("note_type_counts"))
    display = cells.groupBy(*key, "surface").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.min_by("surface", F.struct(-F.col("n"), F.col("surface"))).alias("display"))
    score = (1 + F.log("most")) * (F.log((F.lit(documents) + 1) / (F.col("document_frequency") + 1)) + 1)
    return (
        totals.join(note_types, key).join(display, key)
        .select(*key, "folded", "display", "occurrence_count", "document_frequency", "note_type_counts", six_places(score).alias("max_sublinear_tf_idf"))
    )


def corpus_totals(documents: DataFrame, shortest: int = 1, longest: int = 4) -> DataFrame:
    """One row: documents, bytes, characters, tokens and n-grams of a corpus, without making the n-grams."""
    made = F.expr(f"aggregate(sequence({shortest}, {longest}), 0L, (a, n) -> a + greatest(0, size(tokens) - n + 1))")
    zero = F.lit(0).cast("long")
    names = ["document_count", "byte_count", "character_count", "token_count", "ngram_count"]
    whole = documents.select(F.lit(1).cast("long"), F.octet_length("text").cast("long"), F.length("text").cast("long"), zero, zero).toDF(*names)
    mined = tokens(documents).select(zero, zero, zero, F.size("tokens").cast("long"), made).toDF(*names)
    return whole.unionByName(mined).agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])


def corpus_profile(documents: DataFrame) -> DataFrame:
    """Counts by note type and by language: ``dimension, value, documents, characters``."""
    parts = [
        documents.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters")).select(F.lit(c).alias("dimension"), "value", "documents", "characters")
        for c in ("note_type", "language")
    ]
    return parts[0].unionByName(parts[1])


def repeated(df: DataFrame, *key: str | F.Column) -> DataFrame:
    """Key values that more than one row has, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def canaries(documents: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, canary`` for each pattern of personal data that a text matches."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p.replace(r"\b", WORD_EDGE)), F.lit(name)) for name, p in (patterns or CANARIES).items()]))
    return documents.select("doc_id", F.explode(found).alias("canary"))


def content_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row ``digest, rows``: a digest that doesn't depend on the order of rows.

    Every row is hashed on its own and the hashes are added as numbers modulo 2^128, halves apart, so no
    task ever holds all rows. Two tables agree if they hold the same rows as often."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substr(row, F.lit(1 + 12 * i), F.lit(12)), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"h{i}"), F.lit(0).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws(":", *[F.col(f"h{i}").cast("string") for i in range(4)], F.col("rows").cast("string")), 256).alias("digest"), "rows")
