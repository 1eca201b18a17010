"""Quality rules with host-level verdicts.

Per document: counts over the whole text, a base rule (too few words, or too many words in repeated
five-word windows), hard rules that no prose meets, and soft rules (RULES) that single good documents may
meet by chance. Per host (the source) and soft rule: failures are summed, pre-aggregated so that a host with
a third of all rows moves as one row per task. The rates of a rule are shrunk towards an empirical beta
prior, whose two parameters are fitted to the hosts' rates by moments, with the binomial noise of small hosts taken off
the variance. A host is strict about a rule if its shrunk rate exceeds EXCESS times the prior's mean and FLOOR, or HOST_LIMIT.
Joined back to the documents, the verdict removes those that fail a soft rule about which their host is strict.
Elsewhere only base and hard rules remove documents; a document that fails no rule stays whatever its host.

Hard rules: symbols above 5 % of the word characters; capitals above half of them; exclamation marks above 3 for 10
words; over half of the lines repeats; over 3 in 10 words equal to the word before.
Soft rules: symbols above 2 %; capitals above 25 %; exclamation marks above 1 for 10 words; over 3 in
10 lines repeats; over 1 in 10 words equal to the word before; mean word length outside 2 to 12.

Only DataFrame functions. Repeated windows are looked for by hash; a text where hashes repeat is then
decided on the windows themselves, so the counts are exact.

Cases: null or blank text has no words and fails the base rule. A null source is a host. Rows that repeat an
id are judged each. An empty table gives an empty result. Very long texts cost n log n of their own
length. Extra columns are ignored, and kept by ``passing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.columns import let, small
from larkspan.llm.common import SPACE, words
from larkspan.scratch import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The soft rules, in the order of their bits.
RULES = ("symbols", "capitals", "calls", "dup_lines", "stutter", "word_length")
#: A host is strict about a rule if its shrunk rate exceeds the lesser of HOST_LIMIT and EXCESS * mean + FLOOR.
HOST_LIMIT = 0.5
EXCESS = 1.5
FLOOR = 0.05
#: Bounds of the prior's strength a + b; the upper one holds where the hosts' rates differ by noise alone.
LEAST, MOST = 1.0, 10_000.0
#: Rows of the host table that may be broadcast.
HOSTS_BROADCAST = 100_000


def _times(text: Column, chars: str) -> Column:
    """How often ASCII characters occur."""
    total = F.octet_length(text)
    out = F.lit(0)
    for c in chars:
        out = out + (total - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return out.cast("long")


def _repeated(w: Column, n: Column) -> Column:
    """Words in windows that occur twice or more, by the windows themselves."""
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)),
            lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("s"), i.alias("i")),
        )
    )

    def starts(sorted_windows: Column) -> Column:
        def same(x: Column, k: Column, step: int) -> Column:
            return F.get(sorted_windows, k + step)["s"].eqNullSafe(x["s"])

        twice = F.filter(sorted_windows, lambda x, k: same(x, k, -1) | same(x, k, 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    # transform over a one-element array names an intermediate result, which is then computed once.
    found = F.transform(F.array(windows), starts)
    return F.get(F.transform(found, covered), F.lit(0))


def judged(text: Column) -> Column:
    """A struct of counts and rule failures of a text; ``soft`` has bit i set where RULES[i] fails."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        stutter = F.size(F.filter(w, lambda x, i: (i > 0) & F.get(w, i - 1).eqNullSafe(x)))

        def windows(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        repeat = F.when((n > WINDOW) & twice, _repeated(w, n)).otherwise(F.lit(0).cast("long"))
        return F.struct(n.cast("long").alias("n"), stutter.cast("long").alias("stutter"), repeat.alias("repeat"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    counted = F.struct(
        let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"),
        (F.length(text) - _times(text, SPACE)).cast("long").alias("word_chars"), _times(text, SYMBOLS).alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"), _times(text, "!").alias("n_calls"),
    )

    def ruled(c: Column) -> Column:
        n, chars, symbols, capitals, calls = c["w"]["n"], c["word_chars"], c["n_symbols"], c["n_capitals"], c["n_calls"]
        hard = (
            (symbols * 100 > chars * 5) | (capitals * 2 > chars) | (calls * 10 > n * 3)
            | (c["l"]["dup"] * 2 > c["l"]["n"]) | (c["w"]["stutter"] * 10 > n * 3)
        )
        soft = (
            symbols * 50 > chars, capitals * 4 > chars, calls * 10 > n, c["l"]["dup"] * 10 > c["l"]["n"] * 3,
            c["w"]["stutter"] * 10 > n, (chars < n * 2) | (chars > n * 12),
        )
        bits = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(soft)), F.lit(0))
        base = (n < 10) | (c["w"]["repeat"] * 100 > n * 20)
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), c["l"]["dup"].alias("n_dup_lines"),
            c["w"]["repeat"].alias("n_repeat_words"), base.alias("base_failed"), hard.alias("hard_failed"), bits.alias("soft"),
        )

    return let(counted, ruled)


def host_rates(judged: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, rule, n, failed, rate, strict) from rows with ``soft``: a row for every host and soft rule.

    A rule's prior beta(a, b) has the mean of the hosts' rates, and their variance less its binomial part.
    """
    fails = [F.sum(F.shiftright("soft", i).bitwiseAND(1).cast("long")).alias(r) for i, r in enumerate(RULES)]
    hosts = judged.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"), *fails)
    hosts = materialize(hosts, "hosts")
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES])
    rows = hosts.select("source", "n", F.explode(each).alias("x")).select("source", "x.rule", "n", "x.failed")
    rate = F.col("failed") / F.col("n")
    prior = rows.groupBy("rule").agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("each"))
    spread, between = F.col("mean") * (1 - F.col("mean")), F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("each")
    strength = F.when(between > 0, F.least(F.greatest(spread / F.nullif(between, F.lit(0.0)) - 1, F.lit(LEAST)), F.lit(MOST))).otherwise(MOST)
    prior = prior.select("rule", "mean", strength.alias("strength"))  # a row per rule
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    strict = F.col("rate") > F.least(F.lit(HOST_LIMIT), F.col("mean") * EXCESS + FLOOR)
    rated = rows.join(F.broadcast(prior), "rule").withColumn("rate", shrunk)
    return rated.select("source", "rule", "n", "failed", "rate", strict.alias("strict"))


def with_verdict(rows: DataFrame, rates: DataFrame, source_col: str = "source") -> DataFrame:
    """Add ``strict`` to rows: the bits of the rules about which their host is strict. Only hosts that are strict about any rule are
    joined: by broadcast when they are few, else by shuffle."""
    bits = F.bit_or(F.element_at(F.create_map(*[F.lit(v) for i, r in enumerate(RULES) for v in (r, 1 << i)]), F.col("rule")))
    bad = rates.where("strict").groupBy(F.col("source").alias("__host")).agg(bits.alias("__bits"))
    out = rows.join(small(bad, HOSTS_BROADCAST), F.col(source_col).eqNullSafe(F.col("__host")), "left")
    return out.withColumn("strict", F.coalesce("__bits", F.lit(0))).drop("__host", "__bits")


#: What decides about a row with ``q`` and ``strict``.
def _kept() -> Column:
    q = F.col("q")
    return ~(q["base_failed"] | q["hard_failed"] | (q["soft"].bitwiseAND(F.col("strict")) != 0))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per document: (id, source, q, strict, kept); q holds the counts and failures, strict the host's verdict."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), judged(F.col(text_col)).alias("q"))
    rows = materialize(rows, "judged")
    out = with_verdict(rows, host_rates(rows.select("source", "q.soft")))
    return out.withColumn("kept", _kept()).withColumnRenamed("id", id_col)


def passing(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever their names. Texts are judged once, and written beside the counts."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("host"), judged(F.col(text_col)).alias("q"))
    rows = materialize(rows, "judged")
    return with_verdict(rows, host_rates(rows.select("host", "q.soft"), "host"), "host").where(_kept()).select("doc.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    from larkspan.llm.common import load

    out = quality_rules(load(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    changed = ~F.col("kept") & ~(F.col("q.base_failed") | F.col("q.hard_failed"))
    return out.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in counts], "kept", changed.alias("host_failed"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i:i+4] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), c AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM g) WHERE k > 1
), v AS (
  SELECT r, count(DISTINCT i + o) AS n FROM c, range(5) AS x(o) GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, len(ws) AS n_words, len(ls) AS n_lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_calls,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(v.n, 0) AS n_repeat_words,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN v ON v.r = w.r
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols * 100 > word_chars * 5 OR n_capitals * 2 > word_chars OR n_calls * 10 > n_words * 3
           OR n_dup_lines * 2 > n_lines OR n_stutter * 10 > n_words * 3 AS hard_failed,
         [(n_symbols * 50 > word_chars)::INT, (n_capitals * 4 > word_chars)::INT, (n_calls * 10 > n_words)::INT,
          (n_dup_lines * 10 > n_lines * 3)::INT, (n_stutter * 10 > n_words)::INT,
          (word_chars < n_words * 2 OR word_chars > n_words * 12)::INT] AS soft
  FROM m
), h AS (
  SELECT source, rule, count(*) AS n, sum(soft[rule]) AS failed FROM f, range(1, 7) AS x(rule) GROUP BY source, rule
), p AS (
  SELECT rule, mean, var - mean * (1 - mean) * each AS between
  FROM (SELECT rule, avg(failed / n) AS mean, var_pop(failed / n) AS var, avg(1 / n) AS each FROM h GROUP BY rule)
), k AS (
  SELECT rule, mean, CASE WHEN between > 0 THEN least(greatest(mean * (1 - mean) / between - 1, 1), 10000) ELSE 10000 END AS k FROM p
), b AS (
  SELECT source, list(rule) FILTER ((failed + mean * k) / (n + k) > least(0.5, mean * 1.5 + 0.05)) AS strict
  FROM h JOIN k USING (rule) GROUP BY source
), z AS (
  SELECT f.*, len(list_filter(coalesce(strict, []), lambda i: soft[i] = 1)) > 0 AS host_failed
  FROM f JOIN b ON b.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR hard_failed OR host_failed) AS kept, host_failed AND NOT (base_failed OR hard_failed) AS host_failed
FROM z
"""
