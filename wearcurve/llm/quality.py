"""Quality rules as a bitmask ledger (native expressions only).

Every rule is evaluated once per document. Its outcome is one bit of `failed_bits`, beside the
measurements it came from. Policies are versioned masks over those bits, so that a new policy, or an
ablation ("what if rule r were dropped?"), needs integer operations on the ledger and no text.

Defined results: a null or empty text has no words, so it fails `few_words` (and no ratio rule);
a null doc_id is kept as it is; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Rule name -> failing condition over the measurements; its position is its bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_density": "n_words > 0 AND 10 * n_symbols > n_words",
    "shouting": "n_letters_checked > 0 AND 10 * n_upper > 3 * n_letters_checked",
    "duplicate_lines": "n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "stuttering": "100 * n_stutters > 30 * n_words",
}
#: Version -> names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base": ("few_words", "repeated_windows"), "v1": tuple(RULES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutters"]


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << list(RULES).index(n) for n in names)


def _repeat_words(words: str, window: int) -> Column:
    """Words that lie in a window found twice or more. 64-bit hashes only find texts without a repeat (first of half windows, whose hashes are made of pairs', then of
    whole ones); where there may be one, the windows themselves are sorted and compared."""
    # Arrays that a lambda reads by position are bound by a one-element transform, else the optimizer may move
    # their expression into the lambda, where it would run once per position.
    # slice() copies the whole array each time, so windows are read by position.
    read = lambda a: ", ".join(f"get({a}, i + {k - 1})" for k in range(window))
    at = f"sequence(1, size(w) - {window - 1})"
    repeats = lambda a: f"transform(array({a}), a -> size(array_distinct(a)) < size(a))[0]"
    joined = lambda a, k: f"transform(array({a}), a -> zip_with(a, slice(a, {k + 1}, size(a)), (x, y) -> xxhash64(x, y)))[0]"
    half = joined(joined("h", 1), 2) if window >= 4 else "h"
    whole = f"transform({at}, i -> xxhash64({read('h')}))"
    twice = f"transform(array(transform(w, x -> xxhash64(x))), h -> {repeats(half)} AND {repeats(whole)})[0]"
    keyed = f"array(array_sort(transform({at}, i -> struct(concat_ws(' ', {read('w')}) AS k, i AS i))))"
    found = f"transform({keyed}, s -> array_sort(transform(filter(s, (x, j) -> coalesce(x.k = get(s, j - 1).k, false) OR coalesce(x.k = get(s, j + 1).k, false)), x -> x.i)))"
    covered = f"transform({found}, p -> aggregate(transform(p, (x, j) -> cast(least({window}, coalesce(get(p, j + 1) - x, {window})) AS long)), 0L, (a, x) -> a + x))[0]"
    return F.expr(f"transform(array({words}), w -> if(size(w) > {window}, if({twice}, {covered}, 0L), 0L))[0]")


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + MEASURES + failed_bits (long), one row per row of df; no shuffle."""
    d = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    plain = F.regexp_replace("_text", r"[\x09-\x0D]", " ")  # splitting at one character needs no pattern
    d = d.withColumn("_words", F.filter(F.split(plain, " ", -1), lambda x: x != ""))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    d = d.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.expr("aggregate(_words, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_words", WINDOW).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.expr("transform(array(_words), w -> cast(size(filter(w, (x, i) -> coalesce(x = get(w, i - 1), false))) AS long))[0]").alias("n_stutters"),
    )
    d = d.withColumn("n_letters_checked", F.col("word_chars") - F.col("n_symbols"))
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return d.select(*keep, *MEASURES, bits.alias("failed_bits"))


def apply_policy(scored: DataFrame, policy: str | tuple[str, ...] = "v1", name: str = "kept") -> DataFrame:
    """scored + a boolean column: true where no rule of the policy failed."""
    return scored.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(scored: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Per rule of the policy: documents it fails, and documents that only it rejects (they would return without it).

    The ledger is first folded to its distinct bit patterns (at most 2^rules rows), so nothing else is shuffled.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    folded = scored.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy))).alias("bits")).count()
    ones = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(policy_mask((n,))).cast("long").alias("bit")) for n in names])
    return (
        folded.select("bits", "count", F.explode(ones).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
        )
    )
