"""Quality rules by weak supervision.

Each rule votes good (1) or bad (-1) on a document or abstains (0).  Expectation-maximisation estimates for every rule
how often it votes bad on bad and on good documents, and how common bad documents are; a document's posterior
probability of being good decides.  A document that some rules find bad may so stay if those rules are poor, and no
rule has to be passed by all.

The votes are first counted by pattern, of which there are at most 3 ** len(RULES); the rounds of
expectation-maximisation are aggregations over that table.  The estimates are drawn towards PRIOR with a weight in
proportion to the rows, so that the result is alike at every size.  All of it is DataFrame operations; nothing is
shuffled but pattern counts.

Nulls and odd cases: null and empty texts have no words, fail the base check and are not kept; repeated rows are judged
each; a null id is kept as it is; an empty table gives an empty result; other columns are
kept, but for those with the names of measures, votes and verdicts, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACES, Scratch, words

SYMBOLS = "#*$%&|<>"

#: name -> (value, bad if, good if), as SQL over the measures; neither: the rule abstains.
RULES: dict[str, tuple[str, str, str]] = {
    "length": ("n_words", "v < 15", "v >= 40"),
    "word_length": ("word_chars / n_words", "v < 2.5 or v > 13", "v between 3.5 and 10"),
    "symbols": ("n_symbols / n_words", "v > 0.2", "v < 0.05"),
    "symbol_density": ("n_symbols / word_chars", "v > 0.04", "v < 0.01"),
    "repeated_windows": ("n_repeat_words / n_words", "v > 0.2", "v < 0.1"),
    "repeated_lines": ("n_dup_lines / n_lines", "v > 0.3", "v < 0.1"),
    "capitals": ("n_capitals / word_chars", "v > 0.4", "v < 0.15"),
    "exclamations": ("n_exclamations / n_words", "v > 0.5", "v < 0.1"),
}
#: Starting estimates: votes of bad on bad and on good documents, share of bad documents; their weight per row.
PRIOR = (0.3, 0.01, 0.1)
PRIOR_WEIGHT = 0.2
ROUNDS = 15


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_exclamations", "n_repeat_words")


def measures(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_capitals, n_exclamations and
    n_repeat_words (longs), each over the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, SPACES, "")) > 0)

    def count(of: Column, characters: str) -> Column:
        return (F.length(of) - F.length(F.translate(of, characters, ""))).cast("long")

    kept = docs.columns
    out = docs.select("*", words(F.col("text")).alias("_words"), lines.alias("_lines"), F.translate(text, SPACES, "").alias("_solid"))
    out = out.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length("_solid").cast("long").alias("word_chars"),
        count(F.col("_solid"), SYMBOLS).alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        count(F.col("_solid"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count(F.col("_solid"), "!").alias("n_exclamations"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    return repeated_words(out, "_h", 5).drop("_h")


def repeated_words(df: DataFrame, hashes: str, k: int) -> DataFrame:
    """Adds n_repeat_words: how many of the words (an array of hashes) lie in k-word windows found twice or more."""
    kept = df.columns
    at = F.sequence(F.lit(0), F.size(hashes) - k)
    window = F.when(F.size(hashes) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)])))
    df = df.select("*", window.alias("_w"))
    df = df.select(*kept, F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    again = F.expr("filter(_s, (x, i) -> get(_s, i - 1).h <=> x.h or get(_s, i + 1).h <=> x.h)")
    df = df.select(*kept, F.array_sort(F.transform(again, lambda x: x["i"])).alias("_p"))
    covered = F.expr(f"aggregate(_p, named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + cast(p + {k} - greatest(a.e, p) as long), 'e', p + {k}), a -> a.n)")
    return df.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def votes() -> list[Column]:
    out = []
    for name, (value, bad, good) in RULES.items():
        v = value.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)").replace("/ word_chars", "/ nullif(word_chars, 0)")
        out.append(F.expr(f"case when {bad.replace('v ', f'({v}) ')} then -1 when {good.replace('v ', f'({v}) ')} then 1 else 0 end").alias(f"vote_{name}"))
    return out


def log_odds(model: dict) -> Column:
    """Log of the posterior odds of good against bad, from the vote columns."""
    total = F.lit(math.log((1 - model["bad"]) / model["bad"]))
    for name, (hit, false) in model["rules"].items():
        v = F.col(f"vote_{name}")
        total = total + F.when(v == -1, F.lit(math.log(false / hit))).when(v == 1, F.lit(math.log((1 - false) / (1 - hit)))).otherwise(F.lit(0.0))
    return total


def fit(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """Estimates from a table with vote columns: {"bad": share, "rules": {name: (bad | bad, bad | good)}}."""
    names = list(RULES)
    scratch = Scratch(voted.sparkSession, "votes")
    patterns = scratch.keep(voted.groupBy(*[f"vote_{n}" for n in names]).agg(F.count(F.lit(1)).alias("rows")), "patterns").coalesce(1)
    hit, false, bad = PRIOR
    model = {"bad": bad, "rules": {n: (hit, false) for n in names}}
    for _ in range(rounds):
        p = patterns.withColumn("good", F.col("rows") / (1 + F.exp(-log_odds(model)))).withColumn("bad", F.col("rows") - F.col("good"))
        sums = [F.sum("rows").alias("all"), F.sum("bad").alias("bad")]
        for n in names:
            v = F.col(f"vote_{n}")
            sums += [F.sum(F.when(v == -1, F.col(c)).otherwise(0)).alias(f"{n}_{c}_bad") for c in ("bad", "good")]
            sums += [F.sum(F.when(v != 0, F.col(c)).otherwise(0)).alias(f"{n}_{c}_any") for c in ("bad", "good")]
        s = p.agg(*sums).first()
        if not s["all"]:
            break
        weight = PRIOR_WEIGHT * s["all"]

        def rate(n: str, kind: str, prior: float, share: float) -> float:
            w = weight * share
            return min(0.999, max(0.001, (s[f"{n}_{kind}_bad"] + prior * w) / (s[f"{n}_{kind}_any"] + w)))

        model = {"bad": min(0.9, max(0.01, (s["bad"] + bad * weight) / (s["all"] + weight))), "rules": {n: (rate(n, "bad", hit, bad), rate(n, "good", false, 1 - bad)) for n in names}}
    return model


def judge(voted: DataFrame, model: dict) -> DataFrame:
    """Adds base_failed, p_good and kept to a table with measures and votes."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumn("p_good", 1 / (1 + F.exp(-log_odds(model)))).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def with_votes(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with the measures and a column vote_... for each rule; columns of these names in docs are replaced."""
    made = {*MEASURES, *(f"vote_{n}" for n in RULES), "_words", "_lines", "_solid", "_h", "_w", "_s", "_p", "base_failed", "p_good", "kept"}
    measured = measures(docs.select(*[c for c in docs.columns if c.lower() not in made]))
    return measured.select("*", *votes())
