"""Line-first quality rules (operator 7), in DataFrame functions only.

Every line with a word is judged alone and removed if one of these holds:

* symbols: a tenth or more of its characters are among `#*$%&|<>`, or it has at least one of them for every two words;
* shouting: it has 20 or more upper-case letters, and they are 70 % or more of its cased letters;
* navigation: three or more items of at most `MAX_ITEM` words on average are joined by bars, bullets or breadcrumb arrows;
  guillemets around a quotation are no arrows;
* boilerplate: a phrase of `BOILERPLATE` is in it and it has at most 40 words;
* stutter: it has 8 or more words, and half or more of them repeat the word before;
* punctuation: it has 8 or more words and no full stop, question or exclamation mark, ellipsis, colon or their like.

A document is rejected when it fails the base rule of the contract, when it has no line left, or when the lines removed
hold more than `MAX_LOSS` of its word characters. Lines that repeat count in `n_dup_lines` and aren't removed: passages
may repeat in a good document.

Windows of eight words are compared by a 64-bit hash of the eight words within one text; everything is computed in the
row of the document, so there is no shuffle, and memory is that of one document.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated rows are judged one by
one; an empty table gives an empty table; other columns are not read (`clean`: are returned as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, words

MIN_WORDS, MAX_REPEAT_PCT, WINDOW, MAX_LOSS, MAX_ITEM = 20, 30, 8, 0.4, 5
SYMBOLS = "#*$%&|<>"
MARKS = "|•»›→"
#: Quotations: «so», ‹so›, »so«, ›so‹.
QUOTED = (r"«([^«»]*)»", r"‹([^‹›]*)›", r"»((?=\S)[^«»]*)(?<=\S)«", r"›((?=\S)[^‹›]*)(?<=\S)‹")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_left")
#: Fixed phrases of menus and notices, as text.
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies", "uses cookies", "enable javascript", "javascript is disabled", "click here", "read more", "sign in", "log in", "subscribe to our", "share this", "skip to content", "back to top", "lorem ipsum", "powered by")


def let(value: Column, body) -> Column:
    """`body(x)` with x evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only(text: Column, chars: str) -> Column:
    """How many characters are among `chars`, none of which has a meaning in a class of a pattern."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more, the first included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            marked = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | ((k + 1 < n) & (F.get(s, k + 1)["h"] == x["h"])), x["i"]))
            return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

        def union_length(p: Column) -> Column:
            n = F.size(p)
            gaps = F.transform(p, lambda x, k: F.when(k + 1 < n, F.least(F.get(p, k + 1) - x, F.lit(window))).otherwise(F.lit(window)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, starts), union_length))

    return F.when(F.size(ws) <= window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def unquoted(line: Column) -> Column:
    """The line without guillemets around quotations."""
    for pattern in QUOTED:
        line = F.regexp_replace(line, pattern, "$1")
    return line


def menu(line: Column) -> Column:
    """Three items or more, short ones on average."""
    return let(only(line, MARKS), lambda n: (n >= 2) & (F.size(words(F.regexp_replace(line, f"[{MARKS}]", " "))) <= MAX_ITEM * (n + 1)))


def good_line(line: Column) -> Column:
    """True unless a rule removes the line. What is used twice is bound by `let`, and the cheaper rules come first."""

    def phrase(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | F.contains(low, F.lit(p))
        return found

    def judge(ws: Column) -> Column:
        n_words = F.size(ws)
        symbol_heavy = let(only(line, SYMBOLS), lambda n: (n * 10 >= F.length(line)) | ((n * 2 >= n_words) & (n >= 2)))
        upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        cased = F.length(F.regexp_replace(line, r"[^\p{Lu}\p{Ll}]+", ""))
        shouting = let(upper, lambda n: (n >= 20) & (n * 10 >= cased * 7))
        navigation = (only(line, MARKS) >= 2) & let(unquoted(line), menu)
        echoes = F.size(F.filter(ws, lambda x, i: (i > 0) & (x == F.get(ws, i - 1))))
        stutter = (n_words >= 8) & (echoes * 2 >= n_words)
        bare = (n_words >= 8) & ~line.rlike(r"[.!?:;…。！？]")
        return ~(bare | symbol_heavy | navigation | ((n_words <= 40) & let(F.lower(line), phrase)) | shouting | stutter)

    return let(words(line), judge)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def verdict(text: Column) -> Column:
    """A struct of the counts and verdicts. Every intermediate is bound by `let`: a filter on a field that is pushed down
    takes the whole expression with it, and must not evaluate the words once for each window."""

    def measure(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: word_chars(x) > 0)
        counts = let(
            words(t),
            lambda w: let(
                lines,
                lambda ls: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    word_chars(t).cast("long").alias("word_chars"),
                    only(t, SYMBOLS).cast("long").alias("n_symbols"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    repeat_words(w).alias("n_repeat_words"),
                    F.aggregate(F.filter(ls, good_line), F.lit(0).cast("long"), lambda a, x: a + word_chars(x)).alias("chars_left"),
                ),
            ),
        )

        def judge(m: Column) -> Column:
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])
            kept = ~failed & (m["chars_left"] > 0) & (m["chars_left"] >= (1 - MAX_LOSS) * m["word_chars"])
            return F.struct(*[m[c].alias(c) for c in COUNTS], failed.alias("base_failed"), kept.alias("kept"))

        return let(counts, judge)

    return let(F.coalesce(text, F.lit("")), measure)


def with_rules(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The columns `keep` with the counts and verdicts of the rules."""
    return docs.select(*keep, verdict(F.col("text")).alias("__v")).select(*keep, "__v.*")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, as they were: whole texts, all columns."""
    return docs.where(verdict(F.col("text"))["kept"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rules(table(spark, sf_dir, "documents"), ["doc_id"])


_ANY = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(ws[i:i+7], chr(31))) AS n
      FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
p AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nx FROM g WHERE n > 1),
r AS (SELECT k, sum(least(coalesce(nx - i, 8), 8))::BIGINT AS n_repeat_words FROM p GROUP BY k),
lines AS (SELECT k, unnest(ls) AS l FROM w),
measured AS (
  SELECT k, l, list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw, len(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS wc, len(l) AS n,
         len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw,
         len(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) AS sy, len(regexp_replace(l, '[^\p{{Lu}}]+', '', 'g')) AS up,
         len(regexp_replace(l, '[^\p{{Lu}}\p{{Ll}}]+', '', 'g')) AS ca,
         len(regexp_replace(l, '[^|\x{{2022}}\x{{bb}}\x{{203a}}\x{{2192}}]+', '', 'g')) AS nav FROM lines),
c AS (
  SELECT k, sum(wc)::BIGINT AS chars_left FROM measured
  WHERE NOT (sy * 10 >= n OR (sy * 2 >= nw AND sy >= 2) OR (up >= 20 AND up * 10 >= ca * 7) OR nav >= 2 OR (nw <= 40 AND ({_ANY}))
             OR (nw >= 8 AND len(list_filter(range(2, nw + 1), lambda i: lw[i] = lw[i - 1])) * 2 >= nw) OR (nw >= 8 AND NOT regexp_matches(l, '[.!?:;\x{{2026}}\x{{3002}}\x{{ff01}}\x{{ff1f}}]'))) GROUP BY k),
a AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(chars_left, 0)::BIGINT AS chars_left
  FROM w LEFT JOIN r USING (k) LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND chars_left > 0 AND chars_left >= {1 - MAX_LOSS} * word_chars AS kept FROM b
"""
