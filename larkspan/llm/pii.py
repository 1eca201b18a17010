"""Personal data and secrets: base patterns, then identifiers found by bootstrapped contexts.

Base. Four patterns (email, ip, card, phone), leftmost and non-overlapping per kind, each match then checked
(parts of an address, digits and Luhn sum of a card, digits of a phone number). Splitting a text at a
pattern gives the gaps between its matches, and so their places, without leaving the JVM.

Bootstrapping. Seeds are the base matches, and words of a repeated high-entropy shape: LONG letters and digits in a row or more, both among
them, of ENTROPY bits a character at least, if words of MIN_SUPPORT different values have the same length and character class (``secret``
spans: keys and tokens, however they are introduced). The two words before a match, however far back in the text, are its
lexical pattern; words of identifiers (with a digit, or part of a match) are all the same placeholder there. Words that
hold a digit and lie outside all base matches are candidate identifiers. Patterns and instances form a
bipartite graph that Spark scores in rounds: a pattern's confidence is the summed score of its instances over their number
(seeds score 1), if seeds or accepted instances of MIN_SUPPORT different values stand behind it;
an instance's score is 1 - prod(1 - confidence) over its patterns, and instances above ACCEPT count as known in
the next round. Scores never fall, and rounds go on until none is accepted and no score rises. Candidates whose final
score passes ACCEPT are new spans of kind ``context``. Base spans are never changed. So one known token teaches the words that
introduce it, and those teach the next identifier, whatever it looks like.

Patterns start at the beginning of a run of their first class and give nothing back where that cannot
change a match, so matching takes time in proportion to the text, and no match recurses. Only DataFrame
functions. The graph's tables are aggregated before each shuffle, so a context or a value that
a third of all rows share moves as one row per task.

Cases: null text is empty: no counts, the digest of the empty string. Rows that repeat an id are searched
each. An empty table gives an empty result. Texts of any length are searched whole. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.columns import let, small
from larkspan.llm.common import SPACE_CLASS
from larkspan.scratch import materialize

#: A match begins where the character before it is not of its first class, or where the last match ended.
_AT = r"(?:(?<![{0}])|\G)"
PATTERNS = {
    "email": _AT.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _AT.format("0-9") + r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "context", "secret"]
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Stands for every identifier in a pattern. No word has a tab.
IDENTIFIER = "\t"
#: Rounds end when no score rises by more than this.
SETTLED = 1e-6
MIN_SUPPORT = 3
LONG = 20
ENTROPY = 3.0
ACCEPT = 0.7


def _found(text: Column, pattern: str) -> Column:
    """Matches in order, each with the length of the gap before it and the last two words that end in that gap.

    The match before a gap goes with it, each of its words as a digit, so that they can be told as an identifier's.
    Words are null where none ends: then the match is part of the same word as the one before it.
    """
    blank = f"{SPACE_CLASS}+"

    def ended(parts: Column) -> Column:
        whole = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda w: w != "")
        return F.when(F.size(parts) > 1, let(whole, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2)))

    def placed(both: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(both, i - 1)["hit"]
            mark = F.coalesce(F.regexp_replace(last, r"[^\x20\x09-\x0D]+", "0"), F.lit(""))
            return F.struct(
                x["hit"].alias("hit"), F.length(x["gap"]).alias("gap"),
                let(F.split(F.concat(mark, x["gap"]), blank, -1), ended).alias("words"),
            )

        return F.transform(F.filter(both, lambda x: x["hit"].isNotNull()), one)

    return let(F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    ), placed)


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(12, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )


def _context(two: Column) -> Column:
    """Two words in lower case without marks around them, identifiers as IDENTIFIER; null without two words."""
    strip = lambda x: F.lower(F.regexp_replace(x, r"^[.,;!?()]+|[.,;!?()]+$", ""))
    word = lambda x: F.when(x.rlike("[0-9]") | x.rlike(PATTERNS["email"]), F.lit(IDENTIFIER)).otherwise(strip(x))
    return F.when(F.size(two) == 2, F.concat_ws(" ", word(F.get(two, F.lit(0))), word(F.get(two, F.lit(1)))))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, id); spans (row, kind, start, end, hit, two) of valid base matches and of candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = text.rlike("[0-9]")
    needs = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+")), "context": digit}
    patterns = PATTERNS | {"context": CANDIDATE}
    hits = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        *[F.when(needs[k], _found(text, p)).alias(k) for k, p in patterns.items()],
    )
    hits = materialize(hits, "hits")
    each = hits.select(
        "row", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in patterns])).alias("x")
    ).select("row", "x.kind", F.posexplode("x.found").alias("i", "y"))
    own = Window.partitionBy("row", "kind").orderBy("i")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    moved = F.length("y.hit") + F.col("y.gap")
    start = F.coalesce(F.sum(moved).over(before), F.lit(0)) + F.col("y.gap")
    # A gap in which one word ends takes the other from the nearest gap before it in which any ends.
    earlier = F.last(F.col("y.words"), ignorenulls=True).over(before)
    each = each.withColumn("earlier", F.coalesce(earlier, F.array().cast("array<string>")))
    joined = F.concat("earlier", "y.words")
    reach = F.slice(joined, F.greatest(F.size(joined) - 1, F.lit(1)), 2)
    two = F.last(F.when(F.col("y.words").isNotNull(), reach), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    spans = each.select("row", "kind", start.alias("start"), (start + F.length("y.hit")).alias("end"), "y.hit", two.alias("two"))
    return hits.select("row", "id"), spans.where(_valid(F.col("kind"), F.col("hit")))


def _core(hit: Column) -> Column:
    """The first long run of letters and digits that holds both, null without one."""
    run = F.regexp_extract(hit, f"[A-Za-z0-9]{{{LONG},}}", 0)
    return F.when(run.rlike("[0-9]") & run.rlike("[A-Za-z]"), run)


def _entropy(word: Column) -> Column:
    """Bits a character, by the word's own characters."""
    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))

    return let(F.filter(F.split(word, ""), lambda x: x != ""), of)


def _shape(core: Column) -> Column:
    """Length and character class of a high-entropy run; null for others."""
    kind = F.when(core.rlike("^[0-9a-f]*$"), "hex").when(core.rlike("^[0-9A-F]*$"), "HEX").otherwise("alnum")
    return F.when(core.isNotNull() & (_entropy(core) >= ENTROPY), F.concat_ws(":", kind, F.length(core)))


def _discovered(spans: DataFrame) -> DataFrame:
    """Spans (row, kind, start, end) of the candidates that have a seed's shape or that the graph accepts."""
    own = Window.partitionBy("row")
    base = F.col("kind") != "context"
    earlier = own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    # A candidate is free if no base span that begins before its end reaches past its start.
    ends = F.max(F.when(base, F.col("end"))).over(earlier)
    later = own.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    begins = F.min(F.when(base, F.col("start"))).over(later)
    marked = spans.withColumn("ends", ends).withColumn("begins", begins)
    free = base | ((F.coalesce("ends", F.lit(0)) <= F.col("start")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("end"))))
    marked = marked.where(free).withColumn("pattern", _context(F.col("two"))).withColumn("core", F.when(~base, _core(F.col("hit"))))
    marked = marked.withColumn("shape", F.when(F.col("core").isNotNull(), _shape(F.col("core")))).where("pattern is not null or shape is not null")
    marked = materialize(marked.select("row", "kind", "start", "end", "hit", "pattern", "core", "shape"), "marked")

    shapes = marked.where("shape is not null").select("shape", "core").distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("m"))
    shapes = materialize(shapes.where(F.col("m") >= MIN_SUPPORT).select("shape", F.lit(True).alias("secret")), "shapes")
    marked = marked.join(small(shapes), "shape", "left").withColumn("secret", F.coalesce("secret", F.lit(False)))

    seed = (F.max(F.when(base | F.col("secret"), 1.0).otherwise(0.0))).alias("seed")
    edges = materialize(marked.where("pattern is not null").groupBy("pattern", "hit").agg(seed), "graph")
    known = edges.select("pattern", "hit", F.col("seed").alias("score"))
    while True:
        patterns = known.groupBy("pattern").agg(
            (F.sum(F.when(F.col("score") >= ACCEPT, F.col("score")).otherwise(0.0)) / F.count(F.lit(1))).alias("confidence"),
            F.count(F.when(F.col("score") >= ACCEPT, 1)).alias("support"),
        ).where(F.col("support") >= MIN_SUPPORT)
        doubt = F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999999))))
        scored = edges.join(patterns, "pattern").groupBy("hit").agg((F.lit(1.0) - F.exp(doubt)).alias("found"))
        known = known.join(scored, "hit", "left").select(
            "pattern", "hit", F.greatest("score", F.coalesce("found", F.lit(0.0))).alias("score"), F.col("score").alias("was")
        )
        known = materialize(known, "known")
        new = (F.col("score") >= ACCEPT) & (F.col("was") < ACCEPT)
        if not known.agg(F.max(new | (F.col("score") - F.col("was") > SETTLED))).first()[0]:
            break
    accepted = known.where(F.col("score") >= ACCEPT).select("hit").distinct()
    found = marked.where("kind = 'context' and not secret").join(accepted, "hit", "left_semi").select("row", "kind", "start", "end")
    at = F.col("start") + F.instr("hit", F.col("core")) - 1
    secrets = marked.where("secret").select("row", F.lit("secret").alias("kind"), at.alias("start"), (at + F.length("core")).alias("end"))
    return found.unionByName(secrets)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_email, n_ip, n_card, n_phone, n_context, n_secret, base, all).

    base and all: arrays of (start, k, kind, end) ordered by start and kind; places are code points, end exclusive.
    """
    rows, spans = _spans(docs, id_col, text_col)
    spans = materialize(spans, "spans")
    found = spans.where("kind <> 'context'").select("row", "kind", "start", "end").unionByName(_discovered(spans))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", order.alias("k"), "kind", "end")
    per_row = found.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS], F.sort_array(F.collect_list(item)).alias("all")
    )
    out = rows.join(per_row, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,k:bigint,kind:string,end:bigint>>"))
    return out.select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.filter(every, lambda x: ~x["kind"].isin("context", "secret")).alias("base"), every.alias("all"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from larkspan.llm.common import load

    out = personal_data(load(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "n_context", "n_secret",
        F.size("all").cast("long").alias("n_spans"),
    )
