"""Problem 6: map freely typed values to the canonical list, by a pigeonhole join. SQL only.

Both sides are brought to one skeleton (look-alike letters, accents, invisible characters), cut into words
and freed of words that add nothing to a concept. The words of the list are qualifiers (in many
codes of a language: sides, courses, types) or roots. A typed word that is no word of the list, nor its
plural or abbreviation, is looked up within k edits: each word of the list is cut into k + 1 segments, a
word within k edits contains one of them unchanged near its place, so an equality join of the segments with the
positional substrings of the typed words finds all candidates, and built-in ``levenshtein`` verifies
them. The roots, all of a name's, and the qualifiers then name the code; other values are compared with the whole
names, blanks left out; what no row of the list matches is reported through an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.lookalike import skeleton, skeleton_sql
from noteloom.session import join_counted, sql_over, table, written

#: A word that is in so many codes of a language is a qualifier, as numbers and eponym words are; else a root.
QUALIFIER_CODES = 10
#: Letters edited at most (a transposition is two of them).
MAX_EDITS = 4
#: Slips allowed (a transposition of neighbours is one): two, one in words of under eight letters and none in
#: words of under four (but one in words of two or three Chinese or Japanese characters), three in longer ones
#: if one of them is a transposition.
MAX_SLIPS = 2
#: A word of Chinese or Japanese characters alone.
CJK_WORD = r"^[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー]+$"
# Words around a concept that don't change it (after folding to the skeleton).
IDLE_WORDS = """
    the a an of de du des la le les el los las der die das del d l und y et of for with in on
    type typ tipo tp t tipa типа тип τυπου
    known hx history suspected susp sosp poss possible possibly probable prob dx diagnosis query ant atcd bek bekannt zn va nos unspecified ne sai ona old new current
    подозр подозрение б у неуточненный πιθ πιθανη am pm clinic ward
    z n v o
""".split()
#: Words of the eponymous kind: they stand for each other.
EPONYM_WORDS = "syndrome syndrom sindrome complex complexe complejo komplex disease krankheit maladie enfermedad sequence sequenz синдром συνδρομο synd".split()


def _list(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sounds(column: str) -> str:
    """SQL: spellings that sound alike ('ph', 'y') are one."""
    return f"replace(replace({column}, 'ph', 'f'), 'y', 'i')"


def _folded_words(words: list[str]) -> str:
    """SQL: fixed words, passed through the same skeleton as the values."""
    return _list(sorted({skeleton(w).replace("ph", "f").replace("y", "i") for w in words}))


def _words(column: str) -> str:
    """SQL: the skeleton's words; Roman numbers of types are digits; idle words stay out.

    The idle words pass through the same skeleton as the values, so they are equal to it letter by letter."""
    idle = _folded_words(IDLE_WORDS)
    cut = f"split(trim(regexp_replace({_sounds(skeleton_sql(column))}, '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+', ' ')), ' ')"
    numbers = "case when t in ('i', '1') then '1' when t in ('ii', '2') then '2' when t in ('iii', '3') then '3' else t end"
    return f"array_distinct(filter(transform({cut}, t -> {numbers}), t -> t <> '' and not array_contains({idle}, t)))"


def match_words(spark: SparkSession, listed: DataFrame, typed: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """``language, word, listed_word, edits``: every word of ``listed`` (``language, word``) within the allowed
    slips of a word of ``typed`` (``language, word``), both distinct; ``edits`` counts the slips. Words that
    are alike have 0. Numbers are never slips of each other."""
    # letters edited at most in a listed word of n letters: words of up to 6 have one slip, so two letters at most
    # (longer typed words within their two slips are longer by two letters); there is always one segment more
    edits = lambda n: f"least({{k}}, if({n} > 6, {{k}}, least(2, {n} - 1)))"
    # each word makes many substrings of few bytes: they are made where the words are, spread over all cores
    typed = typed.repartition(2 * spark.sparkContext.defaultParallelism, "language", "word")
    segments = sql_over(
        spark,
        f"""
        select language, word as listed_word, n, i, substr(word, start + 1, length) as segment from (
          select language, word, n, i, i * div(n, k + 1) + greatest(0, i - (k + 1 - n % (k + 1))) as start,
                 div(n, k + 1) + int(i >= k + 1 - n % (k + 1)) as length
          from (select *, explode(sequence(0, k)) as i
                from (select language, word, length(word) as n, {edits("length(word)")} as k from {{listed}} where length(word) > 1 and not word rlike '^[0-9]+$')))
        """.replace("div(n, k + 1)", "int(floor(n / (k + 1)))"),
        listed=listed, k=max_edits,
    )
    probes = sql_over(
        spark,
        f"""
        select distinct language, word, n, i, substr(word, start + shift + 1, length) as segment from (
          select language, word, n, i, m, start, length, explode(sequence(low, high)) as shift from (
            select *, int(floor(n / (k + 1))) + int(i >= k + 1 - n % (k + 1)) as length,
                   i * int(floor(n / (k + 1))) + greatest(0, i - (k + 1 - n % (k + 1))) as start,
                   greatest(-i, m - n - (k - i)) as low, least(i, m - n + (k - i)) as high
            from (select *, explode(sequence(0, k)) as i
                  from (select *, {edits("n")} as k
                        from (select language, word, length(word) as m, explode(sequence(greatest(2, length(word) - {{k}}), length(word) + {{k}})) as n
                              from {{typed}} where length(word) > 1))
                  where abs(m - n) <= k))
          where low <= high)
        where start + shift >= 0 and start + shift + length <= m
        """,
        typed=typed, k=max_edits,
    )
    # candidates are few bytes and much work: they are dealt to all cores before they are verified
    candidates = sql_over(spark, "select distinct p.language, p.word, s.listed_word from {probes} p join {segments} s using (language, n, i, segment)", probes=probes, segments=segments)
    near = sql_over(
        spark,
        "select * from (select language, word, listed_word, levenshtein(word, listed_word, {k}) as letters from {c}) where letters >= 0",
        c=candidates.repartition(4 * spark.sparkContext.defaultParallelism, "language", "word", "listed_word"), k=max_edits,
    )
    # a swap of neighbours that is the first or the last difference stands where the words part or meet again; only in
    # words with room for three slips may it lie between two others, where every place is tried
    parts = "array_position(transform(sequence(1, length({a})), p -> substr({a}, p, 1) = substr({b}, p, 1)), false)"
    swapped = "concat(substr({w}, 1, {p} - 1), substr({w}, {p} + 1, 1), substr({w}, {p}, 1), substr({w}, {p} + 2))"
    every = "array_min(transform(sequence(1, length(word) - 1), p -> levenshtein(" + swapped.replace("{w}", "word").replace("{p}", "p") + ", listed_word)))"
    placed = sql_over(
        spark,
        f"""
        select *, if(letters > 1, int({parts.replace("{a}", "word").replace("{b}", "listed_word")}), 0) as first,
               if(letters > 1, int({parts.replace("{a}", "reverse(word)").replace("{b}", "reverse(listed_word)")}), 0) as last from {{n}}
        """,
        n=near,
    )
    pairs = sql_over(
        spark,
        f"""
        select language, word, listed_word, letters,
               case when letters <= 1 then letters
                    else least(letters, if(first > 0, 1 + levenshtein({swapped.replace("{w}", "word").replace("{p}", "first")}, listed_word), 99),
                               if(last > 0 and length(word) > last, 1 + levenshtein({swapped.replace("{w}", "word").replace("{p}", "(length(word) - last)")}, listed_word), 99),
                               if(first > 0 and last > 0 and length(listed_word) > last and {swapped.replace("{w}", "word").replace("{p}", "first")} = {swapped.replace("{w}", "listed_word").replace("{p}", "(length(listed_word) - last)")}, 2, 99),
                               if(letters = 4 and length(word) > 8, 1 + {every}, 99)) end as slips
        from {{p}}
        """,
        p=placed,
    )
    return sql_over(
        spark,
        f"select language, word, listed_word, int(slips) as edits from {{p}} where slips <= least({MAX_SLIPS}, int(greatest(length(word), length(listed_word)) / 4)) or (slips = 1 and word rlike '{CJK_WORD}' and listed_word rlike '{CJK_WORD}') or (slips = {MAX_SLIPS + 1} and letters > slips and length(word) > 8)",
        p=pairs,
    )


def map_values(spark: SparkSession, typed: DataFrame, designations: DataFrame) -> DataFrame:
    """``language, folded, code, edits, door, times`` of each distinct typed value: the code it means, or 'UNMATCHED'
    (with null edits and door), and how many rows it has. ``door`` names how its words were read: 'word' as listed, 'plural',
    'abbreviation' of a qualifier, 'edit' within the bound, joined by '+', or 'whole' by the whole name within the bound.

    ``typed`` needs ``language, folded``; ``designations`` ``language, code, normalized_folded``. Null or
    empty values mean nothing and are unmatched; so is a value whose root is listed for several codes that
    fit equally well, unless one of their designations is nearer in letters than all others. Repeated rows
    and extra columns don't matter; an empty list leaves everything unmatched."""
    squeezed = f"regexp_replace({_sounds(skeleton_sql('{x}'))}, '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]', '')"
    names = written(spark, sql_over(
        spark,
        f"select distinct language, code, normalized_folded as name, {_words('normalized_folded')} as words, {squeezed.replace('{x}', 'normalized_folded')} as squeezed from {{d}} where normalized_folded is not null and language is not null and code is not null",
        d=designations,
    ))
    # both sides pass the skeleton once; all later steps start from these two small tables
    values = written(spark, sql_over(
        spark,
        f"select language, folded, times, {_words('folded')} as words, {squeezed.replace('{x}', 'folded')} as squeezed from {{v}}",
        v=typed.groupBy("language", "folded").agg(F.count("*").alias("times")),
    ))
    kinds = written(spark, sql_over(
        spark,
        f"select language, word, count(distinct code) >= {QUALIFIER_CODES} or word rlike '^[0-9]+$' or array_contains({_folded_words(EPONYM_WORDS)}, word) as qualifier from (select language, code, explode(words) as word from {{n}}) group by language, word",
        n=names,
    ))
    eponyms = _folded_words(EPONYM_WORDS)
    # every name with its roots; a name of qualifiers alone has none and is met by the same qualifiers alone
    listed = written(spark, sql_over(
        spark,
        f"""
        select language, code, name, collect_set(case when not qualifier then word end) as roots,
               array_sort(collect_set(case when qualifier and not array_contains({eponyms}, word) then word end)) as qualifiers
        from (select n.language, n.code, n.name, k.word, k.qualifier from (select language, code, name, explode(words) as word from {{n}}) n join {{k}} k using (language, word))
        group by language, code, name""",
        n=names, k=kinds,
    ))
    words = sql_over(spark, "select language, folded, times, words, explode(words) as word from {v} where folded is not null", v=values)
    distinct_words = sql_over(spark, "select language, word, sum(times) as times from {w} group by language, word", w=words)
    unknown = sql_over(spark, "select language, word, regexp_replace(word, '(?<=.{4})s$', '') as singular, times from (select w.* from {w} w left anti join {k} k using (language, word)) where length(word) > 1", w=distinct_words, k=kinds)
    looked_up = sql_over(spark, "select language, word from {u} union select language, singular from {u}", u=unknown)
    matched = match_words(spark, sql_over(spark, "select distinct language, word from {k} where length(word) > 1", k=kinds), looked_up)
    near = written(spark, sql_over(
        spark,
        """
        select /*+ merge(m) */ u.language, u.word, m.listed_word, min(m.edits) as edits from (select language, word, explode(array_distinct(array(word, singular))) as asked from {u}) u
        join {m} m on m.language = u.language and m.word = u.asked group by u.language, u.word, m.listed_word
        """,
        u=unknown, m=matched,
    ))
    # a word as it is, its singular, an abbreviated qualifier, or a word within the allowed edits
    means = written(spark, sql_over(
        spark,
        """
        select language, word, listed_word, edits, qualifier, door from (
          select *, rank() over (partition by language, word order by edits) as place from (
            select /*+ merge(w) */ w.language, w.word, k.word as listed_word, 0 as edits, k.qualifier, 'word' as door from {w} w join {k} k using (language, word)
            union all
            select /*+ merge(w) */ w.language, w.word, k.word, 0, k.qualifier, 'plural' from (select language, word, explode(array(regexp_replace(word, 's$', ''), regexp_replace(word, 'es$', ''))) as singular from {w} where word rlike '.{3}s$') w
              join {k} k on k.language = w.language and k.word = w.singular
            union all
            select /*+ merge(w) */ w.language, w.word, max(k.word), 0, true, 'abbreviation' from {w} w join (select *, explode(sequence(2, length(word) - 1)) as cut from {k} where qualifier and length(word) > 3) k
              on k.language = w.language and substr(k.word, 1, k.cut) = w.word group by w.language, w.word having count(*) = 1
            union all
            select /*+ merge(n) */ n.language, n.word, n.listed_word, n.edits, k.qualifier, 'edit' from {n} n join {k} k on k.language = n.language and k.word = n.listed_word))
        where place = 1
        """,
        w=distinct_words, k=kinds, n=near,
    ))
    # for each value: the words that could be read, those of them that are roots, and the qualifiers
    read = written(spark, sql_over(
        spark,
        f"""
        select /*+ merge(m) */ w.language, w.folded, concat_ws('+', array_sort(collect_set(m.door))) as doors, max(size(w.words)) = count(distinct w.word) as all_read, count(distinct case when not m.qualifier then w.word end) as root_words,
               collect_set(case when not m.qualifier then struct(w.word, m.listed_word, m.edits) end) as roots,
               array_sort(collect_set(case when m.qualifier and not array_contains({eponyms}, m.listed_word) then m.listed_word end)) as qualifiers
        from {{w}} w join {{m}} m using (language, word) group by w.language, w.folded""",
        w=words, m=means,
    ))
    # all roots of a name are in the value, each by a word of its own; the value's other roots differ from the
    # name. An abbreviation gives way to a longer root, and to a word that can't be read (it may be that word's qualifier).
    candidates = sql_over(
        spark,
        """
        select language, folded, code, doors, edits, letters, unlike + root_words - rooted as differing, int(longest <= 4) as short from (
          select /*+ merge(r) */ r.language, any_value(r.doors) as doors, r.folded, l.code, size(l.roots) as asked, max(r.root_words) as root_words, count(distinct r.root.listed_word) as roots, count(distinct r.root.word) as rooted,
                 max(r.root.edits) as worst, max(length(r.root.listed_word)) as longest, max(r.all_read) as all_read, sum(r.root.edits) as edits, levenshtein(r.folded, l.name) as letters,
                 size(array_except(r.qualifiers, l.qualifiers)) + size(array_except(l.qualifiers, r.qualifiers)) as unlike
          from (select language, folded, doors, all_read, root_words, qualifiers, explode(roots) as root from {r}) r
          join (select *, explode(roots) as root from {l}) l on l.language = r.language and l.root = r.root.listed_word
          group by r.language, r.folded, r.qualifiers, l.code, l.name, l.roots, l.qualifiers)
        where roots = asked and rooted >= asked and (worst < 2 or unlike = 0) and (longest > 4 or all_read)
        union all
        select /*+ merge(r) */ r.language, r.folded, l.code, r.doors, 0L as edits, levenshtein(r.folded, l.name) as letters, 0 as differing, 0 as short
        from {r} r join {l} l on l.language = r.language and l.qualifiers = r.qualifiers
        where l.roots = array() and l.qualifiers <> array() and r.root_words = 0 and r.all_read
        """,
        r=read, l=listed,
    )
    by_word = written(spark, sql_over(
        spark,
        """
        select language, folded, min(code) as code, int(min(edits)) as edits, min(doors) as door from (
          select *, rank() over (partition by language, folded order by differing, short, edits, letters) as place from {c})
        where place = 1 group by language, folded having count(distinct code) = 1
        """,
        c=candidates,
    ))
    # all other values are compared with the whole names, blanks left out
    glued = sql_over(
        spark,
        "select /*+ merge(v) */ v.language, v.folded, v.squeezed as word from {v} v left anti join {c} c on c.language = v.language and c.folded = v.folded where v.squeezed <> ''",
        v=values, c=by_word,
    )
    spaced = sql_over(spark, "select language, code, squeezed as word from {n} where squeezed <> ''", n=names)
    whole = match_words(spark, sql_over(spark, "select distinct language, word from {s}", s=spaced), sql_over(spark, "select distinct language, word from {g}", g=glued))
    by_whole = sql_over(
        spark,
        """
        select language, folded, min(code) as code, min(edits) as edits, 'whole' as door from (
          select /*+ merge(g) */ g.language, g.folded, s.code, m.edits, rank() over (partition by g.language, g.folded order by m.edits) as place
          from {g} g join {m} m on m.language = g.language and m.word = g.word join {s} s on s.language = m.language and s.word = m.listed_word)
        where place = 1 group by language, folded having count(distinct code) = 1
        """,
        g=glued, m=whole, s=spaced,
    )
    chosen = written(spark, by_word.unionByName(by_whole))
    return sql_over(
        spark,
        """
        select /*+ merge(c) */ c.language, c.folded, c.code, c.edits, c.door, v.times from {c} c join {v} v on c.language <=> v.language and c.folded <=> v.folded
        union all
        select /*+ merge(v) */ v.language, v.folded, 'UNMATCHED' as code, cast(null as int) as edits, cast(null as string) as door, v.times from {v} v left anti join {c} c on c.language <=> v.language and c.folded <=> v.folded
        """,
        c=chosen, v=values,
    )


def map_mentions(spark: SparkSession, mentions: DataFrame, designations: DataFrame) -> DataFrame:
    """``mention_id, language, folded, code, edits, door`` of each typed mention that equals no designation of its language."""
    typed = sql_over(
        spark,
        """
        select m.mention_id, m.language, m.folded from (select distinct mention_id, language, folded from {m} where origin = 'typed') m
        left anti join {d} d on d.language = m.language and d.normalized_folded = m.folded
        """,
        m=mentions, d=designations,
    )
    mapped = map_values(spark, typed, designations)
    return join_counted(typed, written(spark, mapped), ["language", "folded"], "times").select("mention_id", "language", "folded", "code", "edits", "door")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_mentions(spark, table(spark, sf_dir, "mentions"), table(spark, sf_dir, "designation")).select("mention_id", "code")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct typed values with their code and how they were read."""
    mapped = map_mentions(spark, table(spark, sf_dir, "mentions"), table(spark, sf_dir, "designation"))
    return mapped.groupBy("language", "folded", "code", "edits", "door").agg(F.count("*").alias("mentions"))


QUERIES = {"p6_found": p6_found, "p6_values": p6_values}
