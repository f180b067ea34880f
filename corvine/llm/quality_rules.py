"""Quality rules with verdicts on hosts, in DataFrame operations only.

Each document gets its counts and the rules it fails.  Failures are summed by host (``source``);
a beta prior fitted to all hosts by moments shrinks each host's failure rate, so that a host of few
documents is judged by what is usual; hosts whose shrunk rate passes ``HOST_LIMIT`` are rejected with
all their documents.  A document that fails a base rule is rejected whatever its host.

All counts of a text are made inside its row with array functions, so texts are neither exploded nor
shuffled; sums by host combine before their shuffle; what is joined back are the rejected hosts.

Defined results: a null text has no words and fails the base rule; a null source is a host of its own;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept

#: The white space between words, and the characters that count as symbols.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
HOST_LIMIT = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_cover(words: Column, n: int = 3) -> Column:
    """Words that lie in an ``n``-word window found twice or more.

    Windows are hashed and sorted with their places; those equal to a neighbour are repeats, and the
    sorted places of the repeats say how many words they cover together.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(n)]).alias("h"), i.alias("i")),
    )

    def cover(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda w, k: (w["h"] == F.get(sorted_, k - 1)["h"]) | (w["h"] == F.get(sorted_, k + 1)["h"]))
        return _with(F.array_sort(F.transform(again, lambda w: w["i"])), _covered)

    def _covered(places: Column) -> Column:
        return F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(n), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])

    return F.when(F.size(words) > n, _with(F.sort_array(windows), cover)).otherwise(0)


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[host].cast("string").alias("host"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: without(x, BLANKS) != "")
    counted = docs.select(
        "doc_id",
        "host",
        F.length(without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _with(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(h).alias("n"), (F.size(h) - F.size(F.array_distinct(h))).alias("dup"))).alias("lines"),
        _with(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeated_cover(w).alias("again"))).alias("words"),
    )
    return counted.select(
        "doc_id", "host", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.again").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
    )


def failures(row: DataFrame) -> dict[str, Column]:
    """The rules, by name; true is a failure."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_size": ~(F.col("word_chars") / n).between(3, 12),
    }


def host_verdicts(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``host, docs, failed, rate, host_ok`` from rows with ``host`` and ``bad``.

    The prior's mean and strength come from the hosts' rates by moments: strength
    ``m (1 - m) / v - 1``, 1 at least, and 1 where the rates do not vary.
    """
    hosts = stats.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("bad").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"))
    strength = F.when(F.col("var") > 0, F.greatest(F.lit(1.0), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1)).otherwise(1.0)
    prior = prior.select("mean", strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    # the prior is one row
    return hosts.join(F.broadcast(prior)).select("host", "docs", "failed", shrunk.alias("rate"), (shrunk <= limit).alias("host_ok"))


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, failed rules and verdict of every row of ``docs``."""
    stats = document_counts(docs, doc_id, text, host)
    rules = failures(stats)
    stats = stats.select("*", *[c.alias(f"fails_{k}") for k, c in rules.items()])
    stats = stats.withColumn("bad", F.greatest(*[F.col(f"fails_{k}") for k in rules]))
    stats = kept(stats.withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats")))
    rejected = host_verdicts(stats, limit).where(~F.col("host_ok")).select(F.col("host").alias("bad_host"), F.lit(False).alias("host_ok"))
    judged = stats.join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left").drop("bad_host")
    judged = judged.withColumn("host_ok", F.coalesce("host_ok", F.lit(True)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
