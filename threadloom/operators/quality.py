"""Rubrics of rendered texts and states, archetypes of sources, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Rule words and the order of categories.
VERBS = ("continue", "implement", "fix", "address", "resolve", "pick up", "resume", "build", "add", "create")
CONTENT = (
    ("tutorial", r"\b(learner|tutorial|lesson|module|exercise|chapter)\b"),
    ("coding", r"\b(github|issue|pr |pull request|bug|stack trace|docker|kubernetes|react flow|api)\b"),
    ("research", r"\b(hypothesis|research|evidence|literature)\b"),
    ("medical", r"\b(symptom|patient|diagnos|treatment|medicine|disease|hiv|rash)\b"),
    ("project", r"\b(startup|roadmap|milestone|stakeholder|project manager)\b"),
)
#: (archetype, parts of the whole path, parts of the file's stem)
PATHS = (
    ("tutorial", ("/tutorial/",), ("tutorial",)),
    ("journal", ("/journal/",), ()),
    ("research", ("/research/",), ()),
    ("customer_discovery", ("/customer_discovery/",), ()),
    ("coding", ("/troubleshooting/", "debugging"), ("troubleshoot",)),
    ("project", ("/planning/",), ("startup", "mvp")),
    ("journal", ("/productivity/",), ("career", "interview")),
    ("coding", ("project_issues", "github"), ("discussion_",)),
    ("casual_chat", ("community_discussions", "reddit"), ()),
    ("project", ("replacements",), ("rfc", "enhancements")),
    ("medical", (), ("vitiligo", "hiv", "medical", "rash", "patient")),
    ("tutorial", (), ("neck", "posture")),
)


def _points(condition: Column, n: int = 1) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0))


def _issues(**rules: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name.replace("_", " "))) for name, c in rules.items()]))


def briefing_quality(text: Column) -> Column:
    """{verdict, score, words, issues} of a briefing."""
    low, n = F.lower(T.strip(F.coalesce(text, F.lit("")))), T.word_count(text)
    has = lambda s: low.contains(s)
    score = _points(has("next action"), 2) + _points(has("current position"), 2) + _points(has("completed work")) + _points(has("active problems")) + _points(n >= 80)
    issues = _issues(empty=low == "", missing_next_action=(low != "") & ~has("next action"), missing_position=(low != "") & ~has("current position"), short=(low != "") & (n < 60))
    verdict = F.when((score >= 6) & has("next action"), "pass").when(score >= 4, "partial").otherwise("fail")
    return F.struct(verdict.alias("verdict"), score.alias("score"), n.alias("words"), issues.alias("issues"))


def explain_quality(text: Column) -> Column:
    """{verdict, score, words} of an explanation."""
    low, n = F.lower(T.strip(F.coalesce(text, F.lit("")))), T.word_count(text)
    bleed = low.contains("next action") & low.contains("continue fetch")
    bullets = F.size(F.filter(F.split(low, "\n"), lambda x: T.lstrip(x).startswith("- ")))
    score = sum((_points(low.contains(s)) for s in ("overview", "main topics", "current status", "key takeaways")), F.lit(0)) - _points(bleed) + _points(n >= 80) + _points(bullets >= 3)
    score = F.when(low == "", F.lit(0)).otherwise(score)
    verdict = F.when((score >= 5) & ~bleed, "pass").when(score >= 3, "partial").otherwise("fail")
    return F.struct(verdict.alias("verdict"), score.alias("score"), n.alias("words"))


def _overlap(a: Column, b: Column) -> Column:
    return T.containment(T.content_tokens(a, 4), T.content_tokens(b, 4))


def duplication_rate(completed: Column, active: Column) -> Column:
    """Share of (completed, active) pairs that tell much the same."""
    pairs = F.flatten(F.transform(completed, lambda c: F.transform(active, lambda a: _overlap(c, a) >= 0.45)))
    return F.when(F.size(pairs) == 0, F.lit(0.0)).otherwise(F.size(F.filter(pairs, lambda p: p)) / F.size(pairs))


def next_action_score(action: Column, place: Column) -> Column:
    bare = T.strip(F.coalesce(action, F.lit("")))
    low, n = F.lower(bare), T.word_count(bare)
    score = F.when(bare.endswith("?"), F.lit(1)).otherwise(F.lit(2)) + _points(T.contains_any(low, VERBS), 2) + _points(n.between(6, 30))
    score = score - _points(T.contains_any(low, ("the slice", "the session covers", "the participant"))) - _points(_overlap(bare, F.coalesce(place, F.lit(""))) > 0.7)
    return F.when(bare == "", F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(5), score)))


def active_problems_score(active: Column) -> Column:
    bad = F.aggregate(active, F.lit(0), lambda s, a: s + _points(F.lower(a).rlike("^the (learner|speaker) is")) + _points(a.contains("?")))
    score = 2 - bad - _points(F.size(active) > 5)
    return F.when(F.size(active) == 0, F.lit(2)).otherwise(F.greatest(F.lit(0), F.least(F.lit(5), score)))


def analysed(states: DataFrame) -> DataFrame:
    """States with duplication_rate and the three scores, and the usefulness tier."""
    c = F.col
    out = states.withColumn("_dup", duplication_rate(c("completed_work"), c("active_problems"))).withColumn("next_action_score", next_action_score(c("next_action"), c("current_state"))).withColumn("active_problems_score", active_problems_score(c("active_problems")))
    raw = usefulness(F.size("objective") > 0, ~T.blank(c("current_state")), F.size("completed_work") > 0, F.size("constraints") > 0, c("next_action_score"), c("active_problems_score"), c("_dup"))
    out = out.withColumn("_raw", raw).withColumn("tier", usefulness_tier(c("_raw")))
    return out.withColumn("usefulness", F.greatest(F.lit(0), c("_raw")).cast("int")).withColumn("duplication_rate", T.rounded("_dup", 3)).drop("_dup", "_raw")


def usefulness(goal: Column, place: Column, work: Column, limits: Column, action_score: Column, problems_score: Column, duplication: Column) -> Column:
    """Points for what a state holds, its scores and its repeats."""
    held = _points(goal, 2) + _points(place, 2) + _points(work) + _points(limits)
    return held + F.least(F.lit(2), F.floor(action_score / 2)) + F.least(F.lit(1), F.floor(problems_score / 3)) - F.floor(duplication * 3)


def usefulness_tier(points: Column) -> Column:
    return F.when(points >= 7, "high").when(points >= 4, "medium").otherwise("low")


def proxy_analysed(rows: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows with the columns of ``analysed`` guessed from a transcript alone, where no state was built."""
    own = F.coalesce(F.col(text), F.lit(""))
    out = rows.withColumn("archetype", archetype(F.col(path), own))
    going = F.lower(own).rlike(r"\b(done|completed|finished|next step|blocker|todo|implement)\b")
    asking = own.rlike(r"(?m)\?\s*$") | (F.length(own) - F.length(F.replace(own, F.lit("?"), F.lit(""))) > 8)
    out = out.withColumn("_going", going).withColumn("_asking", asking & ~going)
    g, loose = F.col("_going"), F.col("_asking")
    out = out.withColumn("next_action_score", F.when(g, 2).when(loose, 1).otherwise(2)).withColumn("active_problems_score", F.when(g, 3).otherwise(2)).withColumn("duplication_rate", F.when(loose, 0.35).otherwise(0.1))
    raw = usefulness(g | ~loose, F.length(own) > 500, g, F.lit(False), F.col("next_action_score"), F.col("active_problems_score"), F.col("duplication_rate"))
    out = out.withColumn("_raw", F.greatest(F.lit(0), raw).cast("int"))
    low = loose & F.col("archetype").isin("medical", "informational_QA", "casual_chat")
    tier = F.when(low, "low").otherwise(usefulness_tier(F.col("_raw")))
    return out.withColumn("usefulness", F.when(low, F.least(F.col("_raw"), F.lit(3))).otherwise(F.col("_raw"))).withColumn("tier", tier).drop("_raw", "_going", "_asking")


def path_archetype(path: Column) -> Column:
    low = F.lower(path)
    stem = F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"(?<=.)\.[^.]*$", "")
    rules = []
    for name, parts, stems in PATHS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        for p in stems:
            hit = hit | stem.contains(p)
        rules.append(F.when(hit, F.lit(name)))
    return F.coalesce(*rules, F.lit("other"))


#: Characters of a text that tell its archetype in the rules' first form.
HEAD = 8000


def content_archetype(text: Column, most: int | None = None) -> Column:
    """By the first ``most`` characters; None: by the whole text."""
    own = F.coalesce(text, F.lit(""))
    low = F.lower(own if most is None else F.substring(own, 1, most))
    return F.coalesce(*[F.when(low.rlike(pattern), F.lit(name)) for name, pattern in CONTENT], F.lit("other"))


def archetype(path: Column, text: Column, most: int | None = None) -> Column:
    """By path, and where that tells nothing, by content."""
    by_path = path_archetype(path)
    return F.when(by_path != "other", by_path).otherwise(content_archetype(text, most))


def archetype_report(rows: DataFrame) -> DataFrame:
    """Per archetype: count, mean scores, shares of tiers. Rows (name, source, ...) of one name count once;
    one from the cache goes before others."""
    own = Window.partitionBy("name").orderBy(F.when(F.col("source") == "cache", 0).otherwise(1), "position")
    kept = rows.withColumn("_r", F.row_number().over(own)).where("_r = 1")
    share = lambda tier: T.rounded(100 * F.count_if(F.col("tier") == tier) / F.count("*"), 1)
    return kept.groupBy("archetype").agg(
        F.count("*").alias("n"), *[T.rounded(F.avg(c), 2).alias(f"avg_{c}") for c in ("usefulness", "next_action_score", "active_problems_score")],
        T.rounded(F.avg("duplication_rate"), 3).alias("avg_duplication_rate"), share("high").alias("pct_high"), share("low").alias("pct_low"),
    )


def field_jaccard(a: Column, b: Column) -> Column:
    """Of two lists, lower-cased and trimmed; 1 where both are empty."""
    key = lambda items: F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(T.strip(x))), lambda x: x != ""))
    x, y = key(a), key(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def same_action(a: Column, b: Column) -> Column:
    x, y = F.lower(T.strip(F.coalesce(a, F.lit("")))), F.lower(T.strip(F.coalesce(b, F.lit(""))))
    tokens = lambda s: F.array_distinct(T.words(s))
    return (x == y) | ((x != "") & (y != "") & (T.jaccard(tokens(x), tokens(y)) >= 0.95))


def incremental_verdict(full_s: Column, speedup: Column, quality_ratio: Column, resume_ms: Column) -> Column:
    slow = (full_s > 0.5) & (speedup < 3.0)
    return F.when(slow | (quality_ratio < 0.95) | (resume_ms >= 500), F.lit("fail")).otherwise(F.lit("pass"))


def metrics(records: DataFrame) -> DataFrame:
    """Per conversation: chunks, parse rate, and the shares of records with each field filled."""
    filled = lambda c: F.size(c) > 0 if c not in ("topic", "summary", "current_state", "continuation_context") else ~T.blank(F.col(c))
    rate = lambda x: T.rounded(F.count_if(x) / F.count("*"), 4)
    names = ("topic", "summary", "goals", "decisions", "open_questions", "next_steps", "objective", "current_state")
    return records.groupBy("conv").agg(F.count("*").alias("chunks"), rate(F.col("parse_ok")).alias("parse_rate"), *[rate(filled(n)).alias(f"{n}_rate") for n in names])


def stage_shares(rows: DataFrame) -> DataFrame:
    """Time by stage with its share of the whole, from (stage, ms)."""
    sums = rows.groupBy("stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("calls"))
    total = F.sum("ms").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sums.withColumn("share", T.rounded(100 * F.col("ms") / F.greatest(total, F.lit(1e-9)), 2))
