"""Quality rules whose thresholds keep the risk of rejecting good documents below a limit.

Each document gets counts from its whole text, and fails outright by two fixed base rules. Further RULES compare a ratio of
counts with a cutoff, from lenient to strict. For each stratum (by default the language) the labelled documents that pass the base
rules are dealt by a hash of doc_id into two halves.

- Tuning half: every (rule, cutoff) that rejects at least LIFT times as large a share of the bad as of the good documents takes part,
  in ascending order of the share of good documents rejected. The policies are the unions of the first 1, 2, ... of these,
  so each rejects what the one before does.
- Holdout half: policies are tested in this order. One passes if, with k of n good documents rejected, the exact binomial bound holds:
  a policy that rejects a share RISK of good documents rejects no more than k of n with a probability of at most LEVEL, divided by
  the number of strata (Bonferroni). The first failure ends the sequence, so that tests within a stratum need no further
  correction. The last policy that passes is used; without one no further rule applies.

So with a probability of 1 - LEVEL no stratum loses more than a share RISK of its good documents by these rules. All labelled
rows are used; per stratum only counts per rule and cutoff come together, in one task for each stratum.

A null or empty text has no words and fails the base rules. Null lang is ''. Several labels of one doc_id: bad if one says so; rows with
a null label or doc_id are unlabelled. Repeated rows each have a result (and count as labelled each). Without labels only the
base rules apply. Other columns don't matter. Repeated windows of words are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, bytes_of, map_arrow, ship, written
from tickersieve.llm.words import BASE, hash_spans, inside_one, mix, spans, window_hashes

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
RISK = 0.02
LEVEL = 0.05
LIFT = 3
# A rule fires if SCALE times the first count is over (below, if the last is true) a cutoff times the second. Cutoffs are nested.
SCALE = 1000
RULES: dict[str, tuple[str, str | None, tuple[int, ...], bool]] = {
    "symbols": ("n_symbols", "n_words", (2000, 1000, 700, 500, 300, 200, 150, 100, 70, 50, 30, 20, 10), False),
    "dup_lines": ("n_dup_lines", "n_lines", (700, 500, 400, 300, 250, 200, 150, 100), False),
    "repeats": ("n_repeat_words", "n_words", (250, 200, 150, 120, 100, 80, 60, 40, 20), False),
    "long_words": ("word_chars", "n_words", (20000, 15000, 12000, 10000, 9000, 8000), False),
    "short_words": ("word_chars", "n_words", (2000, 2500, 3000, 3500, 4000), True),
    "few_words": ("n_words", None, (25_000, 30_000, 40_000, 50_000, 75_000, 100_000), True),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def _counts(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = bytes_of(chunk.column("text"))
    starts, ends, first = spans(data, offsets)
    n_words = np.diff(first)
    # characters of words: bytes that begin one
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    chars = _per_text(begins[ends] - begins[starts], first)
    # words in a window that occurs again in its text
    repeated = np.zeros(len(starts), bool)
    grams = window_hashes(hash_spans(data, starts, ends), WINDOW)
    if len(grams):
        doc = np.repeat(np.arange(chunk.num_rows, dtype=np.uint64), n_words)[: len(grams)]
        own = np.flatnonzero(inside_one(first, WINDOW, len(starts)))
        found = mix(grams[own] + doc[own] * BASE)
        order = np.argsort(found, kind="stable")
        same = np.flatnonzero(found[order][1:] == found[order][:-1])
        again = np.zeros(len(own), bool)
        again[order[same]] = again[order[same + 1]] = True
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, own[again], 1)
        np.add.at(change, own[again] + WINDOW, -1)
        repeated = np.cumsum(change[:-1]) > 0
    view = data.tobytes()
    lines = [_lines(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    n_lines, dup = (np.array(x, np.int64) for x in zip(*lines))
    values = dict(zip(COUNTS, (n_words, chars, _per_text(_SYMBOL[data], offsets), dup, _per_text(repeated, first), n_lines)))
    yield batch(doc_id=chunk.column("doc_id"), stratum=chunk.column("stratum"), **{k: pa.array(v.astype(np.int64)) for k, v in values.items()})


def _fires(rule: str, cutoff: int) -> Column:
    count, by, _, below = RULES[rule]
    left = F.col(count) * SCALE
    right = F.lit(cutoff) * (F.col(by) if by else F.lit(1))
    return left < right if below else left > right


def _levels() -> Column:
    """For each rule how many of its cutoffs fire."""
    return F.array(*[sum((_fires(rule, c).cast("int") for c in cutoffs), F.lit(0)) for rule, (_, _, cutoffs, _) in RULES.items()])


def measured(docs: DataFrame, stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum, the counts, base_failed and the levels of the rules of each document."""
    by = F.coalesce((F.col("lang") if stratum is None else stratum).cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by.alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = map_arrow(texts, _counts, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return found.withColumn("base_failed", failed).withColumn("levels", _levels())


def _path(rows: pd.DataFrame) -> pd.DataFrame:
    """The policies of a stratum in order: for each rule and level the first policy that rejects it (0: none)."""
    good_all, bad_all = int(rows["good_all"].iloc[0]), int(rows["bad_all"].iloc[0])
    offered = []
    for number, (_, _, cutoffs, _) in enumerate(RULES.values()):
        own = rows[rows["rule"] == number]
        for level in range(1, len(cutoffs) + 1):
            over = own[own["level"] >= level]
            good, bad = int(over["good"].sum()), int(over["bad"].sum())
            if bad and bad * good_all >= LIFT * good * bad_all:
                offered.append((good, -bad, number, level))
    steps = [[0] * (len(cutoffs) + 1) for _, _, cutoffs, _ in RULES.values()]
    for step, (_, _, number, level) in enumerate(sorted(offered), 1):
        for k in range(level, len(steps[number])):
            steps[number][k] = steps[number][k] or step
    return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "steps": [steps], "n_steps": [len(offered)]})


def tail(n: int, k: int, share: float) -> float:
    """The probability of at most k rejections among n, each with this probability."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(min(k, n) + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in log))


def passes(n: int, k: int, share: float, level: float) -> bool:
    """Is the exact bound met? Most k far above the expected number are refused without summing."""
    return k <= n * share and tail(n, k, share) <= level


def _chosen(rows: pd.DataFrame, risk: float, level: float) -> pd.DataFrame:
    """The last policy before the first that fails the test; step 0 of the rows: never rejected."""
    n, last = int(rows["good"].sum()), int(rows["n_steps"].iloc[0])
    by_step = dict(zip(rows["step"], rows["good"]))
    chosen = rejected = kept = 0
    for step in range(1, last + 1):
        rejected += int(by_step.get(step, 0))
        if not passes(n, rejected, risk, level / int(rows["strata"].iloc[0])):
            break
        chosen, kept = step, rejected
    return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "chosen": [chosen], "n_good": [n], "n_rejected": [kept]})


def _first_step() -> Column:
    """The first policy that rejects a document (0: none); needs levels and steps."""
    each = F.zip_with("levels", "steps", lambda level, steps: F.get(steps, level))
    hit = F.filter(each, lambda s: s > 0)
    return F.coalesce(F.array_min(hit), F.lit(0))


def thresholds(found: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, steps (policies by rule and level), chosen, n_good and n_rejected (in the holdout) from measured documents."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    known = found.where("not base_failed").join(marks, "doc_id").withColumn("half", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)))
    known = written(known.select("stratum", "levels", "good", "half"), "labelled")
    count = lambda c: F.count_if(c).alias
    tuning = known.where("half = 0")
    totals = tuning.groupBy("stratum").agg(count(F.col("good"))("good_all"), count(~F.col("good"))("bad_all"))
    by_level = tuning.select("stratum", "good", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level").agg(count(F.col("good"))("good"), count(~F.col("good"))("bad"))
    ship(found.sparkSession)
    path = by_level.join(totals, "stratum").groupBy("stratum").applyInPandas(_path, "stratum string, steps array<array<int>>, n_steps int")
    path = written(path, "policies")
    holdout = known.where("half = 1 and good").join(path, "stratum").withColumn("step", _first_step())
    strata = holdout.select("stratum").distinct().count()
    by_step = holdout.groupBy("stratum", "step", "n_steps").agg(F.count("*").alias("good")).withColumn("strata", F.lit(strata))
    chosen = by_step.groupBy("stratum").applyInPandas(lambda rows: _chosen(rows, risk, level), "stratum string, chosen int, n_good long, n_rejected long")
    return path.join(chosen, "stratum").select("stratum", "steps", "chosen", "n_good", "n_rejected")


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum, the counts, base_failed, kept, and rejected_by: the rules of the chosen policy that fire."""
    found = written(measured(docs, stratum), "measured")
    limits = written(thresholds(found, labels, risk, level), "thresholds")
    joined = found.join(limits.select("stratum", "steps", "chosen"), "stratum", "left")
    names = F.array(*[F.lit(r) for r in RULES])
    fired = F.zip_with("levels", "steps", lambda x, steps: (F.get(steps, x) > 0) & (F.get(steps, x) <= F.col("chosen")))
    by = F.array_compact(F.zip_with(names, fired, lambda name, hit: F.when(hit, name)))
    by = F.when(F.col("base_failed") | F.col("chosen").isNull(), F.array().cast("array<string>")).otherwise(by)
    out = joined.withColumn("rejected_by", by)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return out.select("doc_id", "stratum", *COUNTS, "base_failed", kept.alias("kept"), "rejected_by")
