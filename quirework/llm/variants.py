"""Spelling variants by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the word has the letter an odd number of times. One
inserted or deleted letter flips one bit, one replaced letter two at most, so that of three bands of
the mask at least one stays as it was. Words are joined on an equal band. As the edit also leaves
one half of the word alone, and changes the length by one at most, half and length are parts of the
key: buckets then grow with the words that share half of their letters, not with all words that
share a band. What a key brings together is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import checkpointed

#: Letters of a word after A-Z are in lower case, and how many there are: a-z, then U+00C0 to U+00FF.
LETTER, CAPITALS, SMALL = "[a-zÀ-ÿ]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS = 3
LEAST_LETTERS, LEAST_PLACES, DROPPED_ONE_IN = 5, 3, 97


def vocabulary(documents: DataFrame, least_letters: int = LEAST_LETTERS, least_places: int = LEAST_PLACES, dropped: int | None = DROPPED_ONE_IN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of the words of whole texts: runs of letters in lower case with their number of places.

    With dropped, a run loses the letter at h % length where dropped divides h, the checksum of its
    document's id, a colon and the run. A null text has no words, a null id counts as an empty text,
    and rows that repeat an id count each by itself.
    """
    lowered = F.translate(F.col(text_column).cast("string"), CAPITALS, SMALL)
    runs = documents.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("document"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"{LETTER}+"), F.lit(0))).alias("word"),
    ).where(F.length("word") >= least_letters)  # a run only gets shorter
    if dropped:
        runs = runs.withColumn("h", F.crc32(F.concat("document", F.lit(":"), "word").cast("binary")))
        place = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % dropped == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_places)


def bands(word: Column) -> list[Column]:
    """The mask in three parts; letters are dealt to them in turn, so that each gets some of the frequent ones."""
    code = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
    place = F.transform(code, lambda x: F.when(x < 0xC0, x - ord("a")).otherwise(x - 0xC0 + len(SMALL)))

    def band(k: int) -> Column:
        own = F.filter(place, lambda p: p % BANDS == k)
        return F.aggregate(own, F.lit(0), lambda mask, p: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.floor(p / BANDS).cast("int"))))

    return [band(k) for k in range(BANDS)]


def halves(word: Column, missing: int) -> tuple[Column, Column]:
    """The first and the second half of a word as if it had so many letters fewer in the other half."""
    half = F.floor((F.length(word) - missing) / 2).cast("int")
    return F.substring(word, F.lit(1), half), F.substring(word, half + 1 + missing, F.length(word))


def near(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once for each pair of words that differ by exactly one inserted, deleted or replaced letter; a is the shorter one or else the smaller."""
    masked = words.where("word is not null").select("word", "n", *(m.alias(f"m{k}") for k, m in enumerate(bands(F.col("word")))))

    def keys(missing: int, side: str) -> DataFrame:
        """Each band of each half once, as a word of its own length less missing."""
        entries = [
            F.struct(F.xxhash64(F.lit(2 * k + s), f"m{k}", F.length("word") - missing, half).alias("key"), F.lit(2 * k + s).alias("entry"))
            for k in range(BANDS)
            for s, half in enumerate(halves(F.col("word"), missing))
        ]
        columns = [F.col(c).alias(f"{c}_{side}") for c in ("word", "n", "m0", "m1", "m2")]
        return masked.select(F.explode(F.array(*entries)).alias("e"), *columns).select("e.*", *columns_of(side), F.lit(missing).alias("missing"))

    def columns_of(side: str) -> list[str]:
        return [f"{c}_{side}" for c in ("word", "n", "m0", "m1", "m2")]

    left = keys(0, "a").drop("missing")
    right = keys(0, "b").unionByName(keys(1, "b"))
    met = left.join(right, ["key", "entry"])
    flipped = sum((F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(BANDS)), F.lit(0))
    # A pair that meets at several keys counts at the first: its first equal band, with the first half if that is equal.
    band = F.when(F.col("m0_a") == F.col("m0_b"), 0).when(F.col("m1_a") == F.col("m1_b"), 1).otherwise(2)
    half = F.floor(F.length("word_a") / 2).cast("int")
    side = F.when(F.substring("word_a", F.lit(1), half) == F.substring("word_b", F.lit(1), half), 0).otherwise(1)
    once = (F.col("entry") == 2 * band + side) & ((F.col("missing") == 1) | (F.col("word_a") < F.col("word_b")))
    found = met.where(once & (flipped <= 2) & (F.levenshtein("word_a", "word_b", 1) == 1))
    return found.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) ends. Each round halves the chains, which have no cycles."""
    parent = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        above = parent.select(F.col("word").alias("root"), F.col("root").alias("above"))
        parent = checkpointed(parent.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        moved = parent.where("moved").limit(1).count()
        parent = parent.select("word", "root")
        if not moved:
            return parent


def group(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each of the words (word, n).

    A word's form is its near word with the largest n (of several the smallest in code-point order), if
    that n is at least times the word's own; else it is null. The root is the last of the word's chain of
    forms, or the word itself. A word has one row; a null word has none; no words, no rows.
    """
    words = checkpointed(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = near(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("p"))
    best = both.select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    form_n = -F.col("best.less")
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form_n >= times * F.col("n"), F.col("best.other")).alias("form"),
        F.when(form_n >= times * F.col("n"), form_n).alias("form_n"),
    )
    found = checkpointed(found)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def _crc_table() -> list[int]:
    """The byte table of the checksum from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def oracle_sql() -> str:
    """The same by an all-pairs comparison in DuckDB; letters beyond ASCII are put into one byte each, as its distance counts bytes."""
    wide, narrow = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, (*range(48, 58), *range(65, 91), *range(33, 48), *range(58, 65), *range(91, 97))))
    narrow = narrow.replace("'", "''")[: len(wide) + 1]
    assert len(narrow.replace("''", "'")) == len(wide)
    return f"""
    with recursive runs as (
        select coalesce(doc_id::varchar, '') || ':' as document, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '{LETTER}+')) as run from documents
    ), distinct_runs as (
        select document, run, count(*) as places from runs where length(run) >= {LEAST_LETTERS} group by all
    ), hashed as (
        select run, places, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(document || run)), '..'), lambda x: ('0x' || x)::bigint)),
            lambda c, b: xor(({_crc_table()}::bigint[])[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) as h from distinct_runs
    ), changed as (
        select case when h % {DROPPED_ONE_IN} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, places from hashed
    ), words as (
        select word, sum(places)::bigint as n, translate(word, '{wide}', '{narrow}') as short from changed where length(word) >= {LEAST_LETTERS} group by word having sum(places) >= {LEAST_PLACES}
    ), pairs as (
        select a.word, b.word as other, b.n as other_n from words a join words b on length(b.short) between length(a.short) - 1 and length(a.short) + 1 and a.short <> b.short and levenshtein(a.short, b.short) = 1
    ), best as (
        select word, count(*) as n_near, first(other order by other_n desc, encode(other)) as other, max(other_n) as other_n from pairs group by word
    ), found as (
        select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n from words w left join best using (word)
    ), chain(word, root) as (
        select word, word from found union all select c.word, f.form from chain c join found f on f.word = c.root where f.form is not null
    ), ends as (
        select c.word, c.root from chain c join found f on f.word = c.root where f.form is null
    )
    select word, form, root, n, n_near, form_n from found join ends using (word)"""
