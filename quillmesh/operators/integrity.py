"""Data-quality checks of vectors and postings, and cross references between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vector_quality(vectors: DataFrame) -> DataFrame:
    """By shard_id: the shares of vectors with a NaN, with an infinity, and all zero, and the first rule that they break
    with its severity. A vector without a finite element counts as zero too."""
    inf = "abs(x) = cast('infinity' as float)"
    rows = vectors.selectExpr(
        "shard_id", "exists(vector, x -> isnan(x)) as has_nan", f"exists(vector, x -> {inf}) as has_inf",
        f"forall(vector, x -> x = cast(0 as float) or isnan(x) or {inf}) as all_zero",
    )
    out = rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"round(count_if({c}) / count(1), 6)").alias(c) for c in ("has_nan", "has_inf", "all_zero")))
    issue = "case when has_nan > 0.10D then 'nan' when has_inf > 0.05D then 'infinite' when all_zero > 0.50D then 'zero' end"
    out = out.withColumn("issue", F.expr(issue))
    return out.withColumn("severity", F.expr("case issue when 'nan' then 0.8D when 'infinite' then 0.7D when 'zero' then 0.6D end"))


def posting_quality(postings: DataFrame, capacity: int) -> DataFrame:
    """By shard_id: counts of rows that break each rule, and the rules that are broken too often."""
    return postings.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("count_if(document_id is null or document_id = 0)").alias("n_invalid_id"),
        F.expr("count_if(length = 0)").alias("n_zero_length"), F.expr("count_if(length > 10000000)").alias("n_too_long"),
        F.expr("count_if(start + length > 4294967295)").alias("n_overflow"),
    ).withColumn("issues", F.expr(f"""concat_ws(',',
        case when n > {capacity} then 'over capacity' end, case when n_invalid_id > 0.1 * n then 'invalid ids' end,
        case when n_zero_length > 0.05 * n then 'zero lengths' end, case when n_too_long > 0.01 * n then 'too long' end,
        case when n_overflow > 0 then 'overflow' end)"""))  # fmt: skip


def ordering_violations(postings: DataFrame) -> DataFrame:
    """By shard_id: neighbours in writing order whose document ids fall, and whether they are over 30 %."""
    before = F.lag("document_id").over(Window.partitionBy("shard_id").orderBy("seq"))
    rows = postings.withColumn("before", before).groupBy("shard_id")
    out = rows.agg(F.count("before").alias("n_pairs"), F.expr("count_if(document_id < before)").alias("n_violations"))
    return out.withColumn("disordered", F.expr("n_violations > 0.3 * n_pairs"))


def cross_references(postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """By issue: postings without a vector (0.9) and vectors without a posting (0.7); both keyed by seq."""
    both = postings.select("seq", F.lit(1).alias("p")).join(vectors.select("seq", F.lit(1).alias("v")), "seq", "full")
    rows = both.selectExpr("case when v is null then 'posting without vector' when p is null then 'vector without posting' end as issue").where("issue is not null")
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n")).withColumn("severity", F.expr("case issue when 'posting without vector' then 0.9D else 0.7D end"))


#: Fixed by the rules of integrity reports: for each kind of corruption its priority (1 the most urgent), where
#: it depends on severity the limit and the priority above it, its repair difficulty (1 to 5), whether it always
#: blocks, and whether it can be repaired by itself if it is recoverable.
CORRUPTIONS = [
    ("header", 1, None, None, 5, True, False),
    ("data", 2, 0.8, 1, 2, False, True),
    ("truncation", 2, None, None, 5, False, False),
    ("structure", 1, None, None, 4, True, False),
    ("cross_validation", 2, None, None, 3, False, True),
    ("partial", 4, 0.5, 3, 2, False, True),
]


def ranked_issues(issues: DataFrame) -> DataFrame:
    """issues(component, kind, severity, recoverable) with priority, blocking, difficulty and auto_repairable.

    kind is one of CORRUPTIONS; of an unknown kind all four are null, but for blocking where the severity is over 0.9.
    """
    by = lambda i: " ".join(f"when '{c[0]}' then {str(c[i]).lower()}" for c in CORRUPTIONS)
    above = " ".join(f"when kind = '{c[0]}' and severity > {c[2]}D then {c[3]}" for c in CORRUPTIONS if c[2])
    return issues.selectExpr(
        "*", f"case {above} else case kind {by(1)} end end as priority", f"severity > 0.9D or case kind {by(5)} end as blocking",
        f"case kind {by(4)} end as difficulty", f"case kind {by(6)} end and recoverable as auto_repairable",
    )


def found_issues(vectors: DataFrame, postings: DataFrame, capacity: int) -> DataFrame:
    """The issues of all shards (component, shard_id, issue, kind, severity, recoverable), ranked: vectors(shard_id,
    seq, vector) and postings(shard_id, document_id, start, length, seq) against each other and by their own rules."""
    bad = vector_quality(vectors).where("issue is not null").selectExpr("'vectors' as component", "cast(shard_id as bigint) as shard_id", "issue", "'data' as kind", "severity", "true as recoverable")
    rows = posting_quality(postings, capacity).where("issues <> ''")
    posts = rows.selectExpr("'postings' as component", "cast(shard_id as bigint) as shard_id", "explode(split(issues, ',')) as issue")
    posts = posts.selectExpr("*", "case issue when 'over capacity' then 'structure' else 'partial' end as kind", "case issue when 'overflow' then 0.9D when 'over capacity' then 0.8D else 0.6D end as severity", "issue <> 'overflow' as recoverable")
    cross = cross_references(postings, vectors).selectExpr("'references' as component", "cast(null as bigint) as shard_id", "issue", "'cross_validation' as kind", "severity", "true as recoverable")
    return ranked_issues(bad.unionByName(posts).unionByName(cross))


def integrity_summary(issues: DataFrame) -> DataFrame:
    """One row over ranked issues: how many, blocking, to be repaired by themselves, the worst severity, whether all is well."""
    return issues.selectExpr(
        "count(1) as n_issues", "count_if(blocking) as n_blocking", "count_if(auto_repairable) as n_auto_repairable",
        "coalesce(max(severity), 0D) as worst", "coalesce(min(priority), 0) as first_priority", "count(1) = 0 as valid",
    )
