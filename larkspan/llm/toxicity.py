"""Toxicity by maximum-scoring segments of token log-odds.

1. *Log-odds with Dirichlet priors.* On labelled rows, words and word beginnings (PREFIXES characters) are
   counted once per document. With a Dirichlet prior in the proportion of the classes, each feature has a log-odds
   ratio between toxic and clean documents and an interval of ERRORS standard errors to either side. Features whose interval lies above MARGIN are
   toxic, those whose interval lies below zero are clean, and score their ratio. A token scores its feature
   whose interval is farthest from zero; a token without one scores -DRIFT.
2. *Maximum-scoring segments.* One linear pass over the tokens (Ruzzo and Tompa's stack) finds every maximal
   segment, all passages that stand out and not just the best one.
3. *Extreme values.* On clean labelled documents the best segment's score is Gumbel distributed around ln(length); its two parameters are
   fitted by maximum likelihood, documents without a segment entering as censored below zero. They
   turn a segment's score into its surprise, -ln of the expected number of such segments in a clean
   document of that length. A segment is significant if fewer than LEVEL are expected; surprises are added up over the significant segments.
4. *Calibration.* A logistic curve over best and summed surprise gives the score. Both fits use cross-fitted scores: a labelled row is scanned with
   the log-odds of the FOLDS - 1 folds that it is not in. The final log-odds are those of all folds.

Labels come only from rows outside the held-out fold, and from LABELLED of them at most (by hash of the id), the
documented bound of the training sample; everything else covers all rows. Of rows that repeat a labelled id, training takes the one of the
least text hash; equal texts are one text, toxic if any label says so. Only the text enters a score.

Cases: null and empty texts have no segment and get the curve's lowest score. Rows that repeat an id are scored each; null ids
are never training rows, and count as not held out. Labels that are null or lack a document are not used. With no labelled row, or only one class, every
document scores the share of toxic labels (0 without labels). An empty table gives an empty result.
Texts of any length are scanned whole. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.scratch import materialize

#: Labelled rows that training reads at most.
LABELLED = 20_000
PREFIXES = range(3, 9)
DRIFT = 0.03
#: Pseudo-documents of the prior; standard errors to either side of a log-odds ratio.
PRIOR = 1.0
ERRORS = 2.0
#: Log-odds that a toxic feature's interval must exceed: single chance words of a small class reach lower ones.
MARGIN = 1.0
FOLDS = 3
REMEMBERED = 300_000
#: Segments expected by chance in a clean document, below which one counts.
LEVEL = 0.05
SIGNIFICANT = -math.log(LEVEL)

TOKEN = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[str]:
    """The token itself and its beginnings, which carry a mark."""
    return [token, *(f"{token[:k]}*" for k in PREFIXES if len(token) >= k)]


class Scanner:
    """Token scores by a lexicon, feature to (weight, score), and the maximal segments of a text."""

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def score(self, token: str) -> float:
        """The score of the token's feature with the greatest weight; -DRIFT without any."""
        return max((self.lexicon.get(f, (0.0, -DRIFT)) for f in features(token)), key=lambda x: abs(x[0]))[1]

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """(tokens, [(score, first token, last token + 1)]): every maximal segment of positive score."""
        tokens = TOKEN.findall((text or "").lower())
        known = self.known
        # Stack of candidates (sum before, sum after, first, end); sums run over all tokens before.
        stack: list[tuple[float, float, int, int]] = []
        total = 0.0
        for at, token in enumerate(tokens):
            s = known.get(token)
            if s is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                s = known[token] = self.score(token)
            low, total = total, total + s
            if s <= 0:
                continue
            first = at
            while stack:
                # The nearest candidate that begins lower; candidates above it can never grow again.
                j = len(stack) - 1
                while j >= 0 and stack[j][0] >= low:
                    j -= 1
                if j < 0 or stack[j][1] >= total:
                    break
                low, first = stack[j][0], stack[j][2]
                del stack[j:]
            stack.append((low, total, first, at + 1))
        return len(tokens), [(high - low, first, end) for low, high, first, end in stack]


class Model:
    """A lexicon, the Gumbel parameters and the logistic curve."""

    def __init__(self, lexicon, rate: float = 1.0, shift: float = 0.0, curve=(0.0, 0.0, 0.0)):
        self.scanner, self.rate, self.shift, self.curve = Scanner(lexicon), rate, shift, curve

    def surprises(self, n: int, scores: list[float]) -> list[float]:
        """The surprise of every segment of a text of ``n`` tokens."""
        return [self.rate * (s - self.shift) - math.log(max(n, 1)) for s in scores]

    def inputs_of(self, n: int, scores: list[float]) -> tuple[float, float]:
        """The best surprise, and the sum of the significant ones, as the curve takes them."""
        each = self.surprises(n, scores)
        best, total = max(each, default=0.0), sum(x for x in each if x > SIGNIFICANT)
        return max(min(best, 50.0), -20.0) / 10, math.log1p(total)

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(score of the text, its significant passages: first token, last token + 1, surprise)."""
        n, segments = self.scanner.segments(text)
        scores = [s for s, _, _ in segments]
        each = self.surprises(n, scores)
        x, y = self.inputs_of(n, scores)
        a, b, c = self.curve
        z = a + b * x + c * y
        passages = [(f, e, v) for (_, f, e), v in zip(segments, each, strict=True) if v > SIGNIFICANT]
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0, passages


def _fold(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def _counts(rows: DataFrame) -> DataFrame:
    """(text, toxic, fold) to (feature, fold, y1, y0): documents of each class and fold that hold a feature."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = set(TOKEN.findall((text or "").lower()))
                seen.update((f, fold, toxic) for f in {f for t in tokens for f in features(t)})
        names = list({(f, fold) for f, fold, _ in seen})
        for low in range(0, len(names), 50_000):
            part = names[low : low + 50_000]
            columns = [[f for f, _ in part], [k for _, k in part], [seen[f, k, 1] for f, k in part], [seen[f, k, 0] for f, k in part]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["feature", "fold", "y1", "y0"])

    return rows.select("text", "toxic", "fold").mapInArrow(run, "feature string, fold int, y1 long, y0 long")


def lexicons(rows: DataFrame) -> list[dict[str, tuple[float, float]]]:
    """feature to (nearer end of its interval, log-odds ratio) from (text, toxic, fold), for toxic and clean features: without each of the FOLDS
    folds, and of all rows. Exact copies count once, in one fold, as toxic if any label says so.

    The Dirichlet prior gives every feature PRIOR pseudo-documents, shared between the classes as all documents are. The training sample
    bounds the features. A lexicon is empty where a class is missing.
    """
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold"))
    sizes = {r["fold"]: (r["n1"], r["n"]) for r in rows.groupBy("fold").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n")).collect()}
    parts = [F.sum(F.when(F.col("fold") != k, F.col(y)).otherwise(0) if k < FOLDS else F.col(y)).alias(f"{y}_{k}") for k in range(FOLDS + 1) for y in ("y1", "y0")]
    scores = []
    for k in range(FOLDS + 1):
        n1, n = (sum(v[i] for fold, v in sizes.items() if fold != k) for i in (0, 1))
        if not 0 < n1 < n:
            scores.append(F.lit(None).cast("struct<low:double,ratio:double>").alias(f"s{k}"))
            continue
        share = n1 / n
        y1, y0 = F.col(f"y1_{k}") + PRIOR * share, F.col(f"y0_{k}") + PRIOR * (1 - share)
        ratio = F.log(y1 / y0) - F.log(F.lit(share / (1 - share)))
        error = ERRORS * F.sqrt(1 / y1 + 1 / y0)
        near = F.when(ratio - error > MARGIN, ratio - error).when(ratio + error < 0, ratio + error)
        scores.append(F.when(near.isNotNull(), F.struct(near.alias("low"), ratio.alias("ratio"))).alias(f"s{k}"))
    found = _counts(rows).groupBy("feature").agg(*parts).select("feature", *scores)
    names = [f"s{k}" for k in range(FOLDS + 1)]
    kept = found.where(" or ".join(f"{s} is not null" for s in names)).collect()
    return [{r["feature"]: (r[s]["low"], r[s]["ratio"]) for r in kept if r[s] is not None} for s in names]


def gumbel(n, best) -> tuple[float, float]:
    """(rate, shift) by maximum likelihood, where P(best segment < x) = exp(-n exp(-rate (x - shift))) in n tokens.

    A best score of 0 says only that there is no segment. The likelihood's slope in the rate has one zero, found by bisection; RATES
    bounds it. Without two different positive scores the rate is 1.
    """
    import numpy as np

    n, best = np.asarray(n, float), np.asarray(best, float)
    seen = best > 0
    if len(np.unique(best[seen])) < 2:
        return 1.0, 0.0 if not len(n) else -math.log(n.sum())
    mean = best[seen].mean()

    def slope(rate: float) -> float:
        w = n * np.exp(-rate * best)
        return 1 / rate - mean + float((w * best).sum() / w.sum())

    low, high = RATES
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    rate = math.sqrt(low * high)
    return rate, math.log(seen.sum() / float((n * np.exp(-rate * best)).sum())) / rate


#: Least and greatest rate of the Gumbel distribution.
RATES = (0.05, 20.0)


def _logistic(x, y, steps: int = 50):
    """Newton steps for a logistic curve with a light ridge."""
    import numpy as np

    x, y = np.column_stack([np.ones(len(x)), np.asarray(x, float)]), np.asarray(y, float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit a model on labelled rows outside the held-out fold."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    chosen = chosen.where("id is not null and toxic in (0, 1)").where(_fold(F.col("id")) != 0)
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(LABELLED)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # LABELLED rows at most
    # One row of each id, or an id that repeats would make the sample grow with the table.
    rows = found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"), F.max("toxic").alias("toxic")).select("id", "x.text", "toxic")
    rows = materialize(rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(6)), F.lit(FOLDS)).cast("int")), "labelled")
    *fitted, lexicon = lexicons(rows)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanners = [Scanner(x) for x in fitted]
        for batch in batches:
            out = []
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, segments = scanners[fold].segments(text)
                out.append((toxic, tokens, [s for s, _, _ in segments]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["toxic", "n", "scores"])

    scanned = rows.select("text", "toxic", "fold").mapInArrow(scan, "toxic int, n long, scores array<double>").collect()  # LABELLED rows at most
    share = sum(r["toxic"] for r in scanned) / len(scanned) if scanned else 0.0
    if not lexicon or not 0 < share < 1:
        return Model({}, curve=(math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -700.0), 0.0, 0.0))
    clean = [(r["n"], max(r["scores"], default=0.0)) for r in scanned if not r["toxic"] and r["n"]]
    model = Model(lexicon, *gumbel([n for n, _ in clean], [x for _, x in clean]))
    model.curve = _logistic([model.inputs_of(r["n"], r["scores"]) for r in scanned], [r["toxic"] for r in scanned])
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, score, passages); passages are (first token, last token + 1, surprise)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.scanner.lexicon, model.rate, model.shift, model.curve))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Model(*shared.value)
        item = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())])
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1):
                score, found = own.judge(text.as_py())
                scores.append(score)
                passages.append([{"first": f, "end": e, "surprise": x} for f, e, x in found])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(item))], ["id", "score", "passages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, score double, passages array<struct<first:long,end:long,surprise:double>>")
    return out.withColumnRenamed("id", id_col)


def op7_toxic_segments(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from larkspan.llm.common import load

    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"))
    out = toxicity(docs, model)
    return out.select(
        "doc_id", (F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) == 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
