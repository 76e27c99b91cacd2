r"""Line-first cleaning with DataFrame functions only.

Every line of a text is judged alone by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document is rejected when it loses more than `max_lost_percent` of its
word characters, or when it fails the base rules. All work is per row: no shuffle, no Python.

Words are runs without ASCII white space (``[^\x20\x09-\x0D]+``), lines are cut at line breaks.

Defined cases: a null text has no words, all counts are 0, it fails the base rules and its cleaned
text is null; a line without a word is never removed; repeated rows are judged alike; an empty
table stays empty; columns of the added names are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50

PLAIN = r"[\p{L}\p{N}\p{M}\s]+"
NAVIGATION = (r"(?i)^\W*(?:home|menu|search|next|prev(?:ious)?|back(?: to top)?|log ?in|log ?out|sign (?:in|up)|register"
              r"|share|print|skip to (?:main )?content|read more|click here|contact(?: us)?|about(?: us)?|sitemap)\b")
SEPARATORS = "|»«›‹•·→←>"
BOILERPLATE = ["all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service",
               "enable javascript", "subscribe to our", "subscribe to the", "sign up for our", "sign up for the",
               "powered by wordpress", "lorem ipsum", "follow us on", "share this", "share on "]


def _without(text: Column, characters: str) -> Column:
    """The text without some characters; a plain byte search for each."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _phrase(low: Column) -> Column:
    """Whether a phrase of site notices stands in a text in lower case."""
    found = F.contains(low, F.lit(BOILERPLATE[0]))
    for phrase in BOILERPLATE[1:]:
        found = found | F.contains(low, F.lit(phrase))
    return found


def line_facts(line: Column) -> list[Column]:
    """A line's characters outside white space, and the string of those that are no letters or digits."""
    return [F.length(_without(line, WHITE)).alias("size"), F.regexp_replace(line, PLAIN, "").alias("odd")]


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def line_fails(line: Column, size: Column, odd: Column, notices: bool, share_from: int | None = None) -> Column:
    """Whether one line is to go; False for lines without words. `size` and `odd` are its `line_facts`.

    * punctuation: over 30 % of its characters outside white space (12 or more) are no letters or
      digits, or it has no letter at all;
    * symbols: over 8 % of them are among ``#*$%&|<>``;
    * navigation: it has at most 8 blanks and begins like a menu entry, or it has three or more
      separators of a menu or a table;
    * boilerplate: a phrase of site notices (not sought unless `notices`, the whole text has one).

    In lines of `share_from` characters or more, separators must also be over 2 % of the characters
    and phrases over 10 %; one of either says nothing about a long line.
    """
    boilerplate = _phrase(F.lower(line)) if notices else F.lit(False)
    separators = _count(odd, SEPARATORS) >= 3
    if share_from is not None:
        short = size < share_from
        separators = separators & (short | (_count(odd, SEPARATORS) * 50 > size))
        if notices:
            low = F.lower(line)
            spoken = sum((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit(""))) for x in BOILERPLATE), F.lit(0))
            boilerplate = boilerplate & (short | (spoken * 10 > size))
    return (size > 0) & (((size >= 12) & (F.length(odd) * 10 > size * 3)) | ~line.rlike(r"\p{L}")
                         | (_count(odd, SYMBOLS) * 100 > size * 8) | separators
                         | ((_count(line, " ") <= 8) & line.rlike(NAVIGATION)) | boilerplate)


def repeated_words(windows: Column) -> Column:
    """The words inside any run of three that occurs twice or more; `windows` has a hash per run.

    Equal hashes are brought together by sorting (hash, place), so the cost is n log n a text.
    """
    def repeated(row, at):
        before, after = F.get(windows, at - 1), F.get(windows, at + 1)
        return F.coalesce(before["h"] == row["h"], F.lit(False)) | F.coalesce(after["h"] == row["h"], F.lit(False))

    places = F.transform(F.filter(windows, repeated), lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
    return F.size(F.array_distinct(F.flatten(places)))


def line_quality(docs: DataFrame, text: str = "text", cleaned: str = "cleaned",
                 min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                 max_lost_percent: int = MAX_LOST_PERCENT, share_from: int | None = None) -> DataFrame:
    """Adds the base counts, base_failed, lost_chars, kept and the text of the lines that stay.

    Without `share_from` the rules are those of the comparison SQL, whatever a line's length.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "lost_chars", "kept", cleaned]
    # Work in a struct column beside the row, so no name of the input can clash.
    rest = [column(docs, c) for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    work = docs.select(F.struct(*rest).alias("r") if rest else F.struct(F.lit(0).alias("_")).alias("r"),
                       column(docs, text).cast("string").alias("raw"))
    full = F.coalesce(F.col("raw"), F.lit(""))
    work = work.select("r", "raw", full.alias("t"), F.lower(full).alias("low"),
                       F.array_remove(F.split(full, r"[\x20\x09-\x0D]+"), "").alias("w"),
                       F.split(full, "\n").alias("lines"))
    count = F.size("w")
    runs = F.when(count >= 3, F.transform(F.sequence(F.lit(0), count - 3), lambda i: F.xxhash64(
        F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    # Each line with its facts, so that rules don't scan it again.
    facts = F.transform("lines", lambda x: F.struct(x.alias("x"), *line_facts(x)))
    work = work.select("r", "raw", "t", count.cast("long").alias("n_words"), F.col("w"), runs.alias("runs"),
                       facts.alias("lines"), _phrase(F.col("low")).alias("notices"))

    def judged(notices: bool) -> Column:
        return F.transform("lines", lambda x: F.struct(
            x["x"].alias("x"), x["size"].alias("size"), _count(x["odd"], SYMBOLS).alias("symbols"),
            line_fails(x["x"], x["size"], x["odd"], notices, share_from).alias("fails")))

    work = work.select("r", "raw", "t", "n_words", "w", "runs", F.when(
        F.col("notices"), judged(True)).otherwise(judged(False)).alias("lines"))
    worded = F.transform(F.filter("lines", lambda x: x["size"] > 0), lambda x: x["x"])
    # Only texts with some repeated run pay for the sort.
    twice = F.size(F.array_distinct("runs")) < F.size("runs")
    work = work.select("r", "raw", "t", "n_words", "w", "lines", worded.alias("worded"), F.when(
        twice, F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("windows"))
    bad = F.filter("lines", lambda x: x["fails"])
    work = work.select(
        "r", "raw", "n_words", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["symbols"]).alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("windows").isNull(), 0).otherwise(
            repeated_words(F.col("windows"))).cast("long").alias("n_repeat_words"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["x"]), "\n").alias("left"),
        F.aggregate(bad, F.lit(0).cast("long"), lambda n, x: n + x["size"]).alias("lost"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    kept = ~failed & (F.col("lost") * 100 <= F.col("word_chars") * max_lost_percent)
    values = [F.col("n_words"), F.col("word_chars"), F.col("n_symbols"), F.col("n_dup_lines"),
              F.col("n_repeat_words"), failed, F.col("lost"), kept,
              F.when(F.col("raw").isNotNull(), F.col("left"))]
    names = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    return work.select(*(F.col("r").getField(c).alias(c) for c in names),
                       *(v.alias(n) for v, n in zip(values, added, strict=True)))
