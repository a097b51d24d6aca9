"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements; policies are bit masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rules by bit, each an SQL condition on the measurements that holds where a document fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_capitals > word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that count.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines"],
    "v2": list(RULES),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]
#: White space between words.
BLANK = r"[ \t-\r]+"


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def without(text: str, chars: str) -> str:
    return f"translate({text}, '{chars}', '')"


def ledger(docs: DataFrame) -> DataFrame:
    """docs as the struct column row, the measurements (long) and failed, a long with the bit of each failed rule.

    One pass, no shuffle: a document's words become sorted keys "w1 w2 w3 position", so that equal windows of
    three words stand side by side. A null text has no words, as an empty one has. Repeated rows and null ids
    are judged row by row; other columns stay in row and can't clash.
    """
    blank = " \\t\\n\\u000B\\u000C\\r"
    df = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.select(
        "*",
        F.array_remove(F.split("text", BLANK), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    keys = "transform(slice(words, 3, size(words)), (w, i) -> concat_ws(' ', words[i], words[i + 1], w, string(i)))"
    df = df.selectExpr("*", f"sort_array(case when size(words) > 2 then {keys} else array() end) as keys")
    df = df.selectExpr("*", "transform(keys, k -> substring_index(k, ' ', 3)) as windows")
    twice = "coalesce(get(windows, i) = get(windows, i + 1), false) or coalesce(get(windows, i) = get(windows, i - 1), false)"
    found = f"transform(filter(keys, (k, i) -> {twice}), k -> int(substring_index(k, ' ', -1)))"
    df = df.selectExpr("*", f"sort_array({found}) as at")
    steps = "zip_with(at, slice(at, 2, size(at)), (a, b) -> bigint(least(3, coalesce(b - a, 3))))"
    # the row number keeps Catalyst from pushing conditions on the ledger below it, which would repeat all of the above
    df = df.selectExpr(
        "row",
        "bigint(size(words)) + 0 * monotonically_increasing_id() as n_words",
        f"bigint(length({without('text', blank)})) as word_chars",
        f"bigint(length(text) - length({without('text', '#*$%&|<>')})) as n_symbols",
        f"bigint(length(text) - length({without('text', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')})) as n_capitals",
        "bigint(size(lines)) as n_lines",
        "bigint(size(lines) - size(array_distinct(lines))) as n_dup_lines",
        f"case when size(at) = 0 then 0L else aggregate({steps}, 0L, (s, x) -> s + x) end as n_repeat_words",
    )
    bits = " + ".join(f"case when {rule} then {BITS[name]}L else 0L end" for name, rule in RULES.items())
    return df.selectExpr("*", f"{bits} as failed")


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_kept, n_kept_without) for every policy and each rule of it.

    The ledger is first counted by its bits, of which there are at most 2 to the number of rules.
    """
    counts = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = [(p, r, mask(p), BITS[r]) for p in POLICIES for r in POLICIES[p]]
    rules = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, r, m, b in rules))
    rows = counts.select("failed", "n", F.inline(rules))
    n = lambda condition: F.sum(F.expr(f"case when {condition} then n else 0L end"))
    return rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        n("failed & bit <> 0").alias("n_failed"),
        n("failed & mask = 0").alias("n_kept"),
        n("failed & mask & ~bit = 0").alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs that pass the policy, columns as in docs."""
    return ledger(docs).where(passes(F.col("failed"), policy)).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of documents under the base rules and policy v2."""
    return ledger(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("failed"), "base")).alias("base_failed"),
        passes(F.col("failed"), "v2").alias("kept"),
        F.col("failed").alias("failed_rules"), "n_capitals", "n_lines",
    )


BLANK_SQL = r"'[\x09-\x0D\x20]+'"
OP10_SQL = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, {BLANK_SQL}), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) as lines from t),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w),
k as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as window_text from g),
d as (select doc_id, i, count(*) over (partition by doc_id, window_text) as n from k),
r as (select doc_id, count(distinct i + o) as n_repeat_words from d, (select unnest([0, 1, 2]) as o) where n > 1 group by doc_id),
m as (select w.doc_id, len(words)::bigint as n_words,
  length(regexp_replace(text, {BLANK_SQL}, '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_capitals,
  len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join r on w.doc_id = r.doc_id),
b as (select *, ({" + ".join(f"case when {rule} then {BITS[name]} else 0 end" for name, rule in RULES.items())})::bigint as failed_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, failed_rules = 0 as kept, failed_rules, n_capitals, n_lines from b
"""
