"""Quality rules: counts of each text and the frequency of its lines across documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import SPACES, row_key, stored, words_of

#: A line is boilerplate of its host if more distinct documents hold it than both limits allow.
MIN_DOCS, HOST_SHARE = 20, 0.02
#: A document is depleted if less than this share of its words is left without such lines.
LEFT_SHARE = 0.3
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"
#: Up to this many boilerplate lines (rows of 40 bytes and a host name) are broadcast, more are joined by shuffle.
BROADCAST_LINES = 50_000


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def normal_lines(text: Column) -> Column:
    """Array of struct(h, n) beside the lines of a text: hash of the normalised line, its words (0: no word).

    Normalised: lower case, every digit 0, runs of other white space one space, trimmed.
    """
    zeros = F.regexp_replace(F.lower(text), "[1-9]", "0")
    plain = F.regexp_replace(zeros, r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")
    one = lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    return F.transform(F.split(plain, "\n"), lambda x: one(F.trim(x)))


#: Up to this many different repeated windows are looked up one by one, more by sorting places beside hashes.
_FEW = 24


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.

    Windows of three words are hashed; equal neighbours of the sorted hashes are the repeated ones. The places of
    few repeated hashes are found by look-up, those of many by sorting hash and place packed into one number, where
    equal neighbours are compared again by the full hash: n log n for any text.
    """
    body = _text(text)
    kept = [F.col(f"`{c}`") for c in df.columns]
    with_word = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    first = df.select(*kept, words_of(F.col(text)).alias("__w"), with_word.alias("__l"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    hashes = F.expr("transform(slice(__w, 1, greatest(size(__w) - 2, 0)), (x, i) -> xxhash64(x, get(__w, i + 1), get(__w, i + 2)))")
    second = first.select(
        *kept, F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), hashes.alias("__h"))
    names = [F.col(f"`{c}`") for c in (*df.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines")]
    none = F.array().cast("array<bigint>")
    third = second.select(*names, "__h", F.when(F.size(F.array_distinct("__h")) == F.size("__h"), none).otherwise(F.sort_array("__h")).alias("__s"))
    fourth = third.select(*names, "__h", F.expr("array_distinct(filter(__s, (x, i) -> x = get(__s, i + 1)))").alias("__d"))
    bits = F.when(F.size("__h") < (1 << 24), 24).otherwise(31)
    packed = F.expr("sort_array(transform(__h, (x, i) -> shiftleft(shiftright(x, __b), __b) | cast(i as bigint)))")
    fifth = fourth.withColumn("__b", bits).select(*names, "__h", "__d", "__b", F.when(F.size("__d") <= _FEW, none).otherwise(packed).alias("__p"))
    place = "cast({0} - shiftleft(shiftright({0}, __b), __b) as int)"
    same = f"(shiftright(x, __b) = shiftright({{0}}, __b) and get(__h, {place.format('x')}) = get(__h, {place.format('{0}')}))"
    places = F.expr(f"""
        case when size(__d) = 0 then cast(array() as array<int>)
        when size(__d) <= {_FEW} then filter(transform(__h, (x, i) -> if(array_contains(__d, x), i, null)), x -> x is not null)
        else sort_array(transform(filter(__p, (x, i) ->
            coalesce({same.format('get(__p, i + 1)')}, false) or (i > 0 and coalesce({same.format('get(__p, i - 1)')}, false))), x -> {place.format('x')})) end""")
    covered = F.expr("aggregate(transform(__r, (p, i) -> least(3, coalesce(get(__r, i + 1) - p, 3))), 0L, (s, x) -> s + x)")
    out = fifth.select(*names, places.alias("__r")).select(*names, covered.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def boilerplate(pages: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(__host, h): lines that too many distinct documents of a host hold.

    ``pages`` has ``__host``, ``__text`` (a digest of the text) and ``__lines``. Equal texts of a host are one
    document, so exact copies do not turn a text into boilerplate. The limit is the larger of ``min_docs`` and
    ``host_share`` of the host's documents; a line above it goes.
    """
    texts = pages.groupBy("__host", "__text").agg(F.any_value(F.array_distinct(F.expr("transform(filter(__lines, x -> x.n > 0), x -> x.h)"))).alias("__hs"))
    hosts = texts.groupBy("__host").agg(F.count("*").alias("__docs"))
    lines = texts.select("__host", F.explode("__hs").alias("h")).groupBy("__host", "h").agg(F.count("*").alias("__n")).filter(F.col("__n") > min_docs)
    return lines.join(hosts, "__host").filter(F.col("__n") > F.col("__docs") * host_share).select("__host", "h")


def _hot_lines(pages: DataFrame, min_docs: int, host_share: float) -> DataFrame:
    """(__key, __hot): the boilerplate line hashes of every document that has any."""
    hot = stored(boilerplate(pages, min_docs, host_share), "boilerplate")
    hot = hot.hint("broadcast" if hot.count() <= BROADCAST_LINES else "merge")
    held = pages.select("__key", "__host", F.explode(F.array_distinct(F.expr("transform(filter(__lines, x -> x.n > 0), x -> x.h)"))).alias("h"))
    return held.join(hot, ["__host", "h"], "left_semi").groupBy("__key").agg(F.collect_set("h").alias("__hot"))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\x00"))


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per document with its counts, the words left without boilerplate lines and the verdict.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words, kept.
    A NULL text has no words and fails; NULL hosts are one host; repeated rows are judged alike; no rows give none.
    """
    source = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__body"), _host(host).alias("__host"), row_key(doc_id, text, host).alias("__key"))
    counted = base_counts(source.withColumn("__lines", normal_lines(_text("__body"))), "__body")
    pages = stored(counted.select("*", F.md5(_text("__body")).alias("__text")).drop("__body"), "quality")
    joined = pages.join(_hot_lines(pages, min_docs, host_share), "__key", "left")
    gone = F.expr("aggregate(filter(__lines, x -> array_contains(__hot, x.h)), 0L, (s, x) -> s + x.n)")
    left = F.col("n_words") - F.coalesce(gone, F.lit(0))
    return joined.withColumn("n_left_words", left).select(
        F.col("__id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words",
        (~F.col("base_failed") & (F.col("n_left_words") >= F.col("n_words") * left_share)).alias("kept"))


def clean(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str | None = "n_chars",
          min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """The columns of ``df``: boilerplate lines removed from the texts, failed and depleted documents gone."""
    names = df.columns
    keyed = df.withColumn("__key", row_key(doc_id, text, host))
    source = keyed.select("__key", F.col(text).alias("__body"), _host(host).alias("__host"))
    counted = base_counts(source.withColumn("__lines", normal_lines(_text("__body"))), "__body")
    pages = stored(counted.select("__key", "__host", "__lines", "n_words", "base_failed", F.md5(_text("__body")).alias("__text")), "quality")
    hot = _hot_lines(pages, min_docs, host_share)
    gone = F.expr("aggregate(filter(__lines, x -> array_contains(__hot, x.h)), 0L, (s, x) -> s + x.n)")
    verdict = pages.join(hot, "__key", "left").filter(
        ~F.col("base_failed") & (F.col("n_words") - F.coalesce(gone, F.lit(0)) >= F.col("n_words") * left_share)
    ).groupBy("__key").agg(F.any_value("__hot").alias("__hot"))
    kept = keyed.join(verdict, "__key")
    body = F.col(f"`{text}`")
    stay = F.filter(F.arrays_zip(F.split(body, "\n").alias("line"), normal_lines(body).alias("mark")), lambda x: ~F.array_contains("__hot", x["mark"]["h"]))
    cleaned = F.when(F.col("__hot").isNull(), body).otherwise(F.array_join(F.transform(stay, lambda x: x["line"]), "\n"))
    out = kept.withColumn(text, cleaned)
    if n_chars and n_chars in names:
        out = out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast(df.schema[n_chars].dataType))
    return out.select(*(F.col(f"`{c}`") for c in names))
